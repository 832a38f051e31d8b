"""Work that grows with the input is dealt to all tasks, whatever files or keys it comes from."""

from pyspark.sql import functions as F

from groundsearch.functions import lexicons as L
from groundsearch.functions import text as T
from groundsearch.operators import features, planner
from groundsearch.sources import synthetic


def test_pages_of_one_file_go_to_many_tasks(spark, sf):
    assert synthetic.contract_pages(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_features_of_one_partition_go_to_many_tasks(spark):
    c = spark.range(100).coalesce(1).selectExpr("concat('c', id) AS chunk_id", "'d' AS document_id", "'section' AS chunk_type", "'1.1' AS section_number", "'Pump' AS heading", "'body' AS full_text", "1 AS page_start", "1 AS page_end", "CAST(NULL AS string) AS parent_chunk_id", "CAST(id AS int) AS ordinal_in_document")
    assert features.features(c).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_norm_and_clean_are_as_the_plain_forms(spark):
    texts = ["a b", " a  b ", "a\tb", " a   b ", "a\n\nb \n c", "The Guarentees  and guarentee’s", "guarenteeing\tGUARENTEED unguarenteed", "", "   ", "“x”"]
    plain = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))

    def one_by_one(x):
        x = F.lower(F.translate(x, "’“”", "'\"\""))
        for wrong, right in L.MISSPELT.items():
            x = F.regexp_replace(x, rf"\b{wrong}\b", right)
        return plain(x)

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.clean(F.col("t")).alias("c"), plain(F.col("t")).alias("pc"), T.norm(F.col("t")).alias("n"), one_by_one(F.col("t")).alias("pn")).collect()
    assert all(r.c == r.pc and r.n == r.pn == T.norm_py(r.t) for r in rows)


def test_questions_of_one_partition_go_to_many_tasks(spark):
    q = spark.range(50).coalesce(1).selectExpr("id AS question_id", "concat('What is the capacity of pump ', id, '?') AS question")
    planned = planner.plan_batch(q)
    assert planned.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plans = {r.question_id: r.plan.asDict() for r in planned.collect()}
    assert len(plans) == 50 and all({k: tuple(v) if isinstance(v, list) else v for k, v in p.items()} == vars(planner.plan(f"What is the capacity of pump {k}?")) for k, p in plans.items())
