"""Queries over text, full text and vectors, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundsearch.functions import text as T
from groundsearch.operators import fulltext, planner, vectors
from groundsearch.operators.fulltext import And, Or, Phrase
from groundsearch.sources import readers

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_QUOTED = "translate(coalesce(text, ''), '’“”', '''\"\"')"
NORM_SQL = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({_QUOTED}), '\\bguarentees\\b', 'guarantees', 'g'), '\\bguarentee\\b', 'guarantee', 'g'), '\\bguarenteed\\b', 'guaranteed', 'g'), '\\bguarenteeing\\b', 'guaranteeing', 'g'), '\\s+', ' ', 'g'))"
FTS_SQL = "regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '([\\p{L}\\p{N}]+)', 1)"


@query(f"SELECT doc_id, {NORM_SQL} AS normalized FROM documents")
def text_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.norm(F.coalesce("text", F.lit(""))).alias("normalized"))


@query(f"SELECT conv_id, turn, array_to_string(regexp_extract_all({NORM_SQL}, '([a-z0-9]+)', 1), ' ') AS lookup_key FROM conversations")
def text_lookup_key(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.lookup_key(F.coalesce("text", F.lit(""))).alias("lookup_key"))


@query(
    "SELECT doc_id, "
    + ", ".join(f"len(regexp_extract_all({'lower(text)' if k in ('search', 'lookup') else 'text'}, '({p})', 1))::BIGINT AS n_{k}" for k, p in T.TOKENS.items())
    + " FROM documents WHERE text IS NOT NULL"
)
def token_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", *[F.size(T.tokens(F.lower("text") if k in ("search", "lookup") else F.col("text"), k)).cast("long").alias(f"n_{k}") for k in T.TOKENS])


_SENTENCE_SQL = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?;:])\\s+', '\\1' || chr(1), 'g'), '\\s{2,}', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> '')"


@query(f"SELECT doc_id, len(s)::BIGINT AS n_sentences, s[1] AS first_sentence FROM (SELECT doc_id, {_SENTENCE_SQL} AS s FROM documents WHERE text IS NOT NULL)")
def sentence_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.get("s", F.lit(0)).alias("first_sentence"))


@query(
    "SELECT doc_id, len(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g'))::BIGINT AS n_chars_meaningful, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: regexp_matches(w, '\\p{L}')))::BIGINT AS n_words,"
    " len(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) < 120 OR len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: regexp_matches(w, '\\p{L}'))) < 20 AS ocr_used FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
)
def page_quality_gate(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("page_text"))
    chars, words = readers.page_quality(F.col("page_text"))
    return readers.gate_pages(pages).select("doc_id", chars.cast("long").alias("n_chars_meaningful"), words.cast("long").alias("n_words"), "ocr_used")


@query("SELECT doc_id, 'doc_' || substr(sha1(source || '|' || lang), 1, 12) AS document_id, sha256(coalesce(text, '')) AS digest FROM documents")
def document_identity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", readers.document_id(F.col("source"), F.col("lang")).alias("document_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query(f"SELECT term, count(*)::BIGINT AS n_docs, sum(tf)::BIGINT AS n_total FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({FTS_SQL}) AS term FROM documents) GROUP BY doc_id, term) GROUP BY term")
def fts_postings_terms(spark, sf_dir):
    p = fulltext.postings(table(spark, sf_dir, "documents"), "doc_id", ["text"])
    return p.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_total"))


@query(f"SELECT doc_id, len({FTS_SQL})::BIGINT AS n_tokens FROM documents")
def fts_doclen(spark, sf_dir):
    return fulltext.doc_lengths(table(spark, sf_dir, "documents"), "doc_id", ["text"]).select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))


def _phrase_sql(terms: list[str], tokens: str = "w") -> str:
    cond = " AND ".join(f"{tokens}[i + {k}] = '{t}'" for k, t in enumerate(terms))
    return f"len(list_filter(range(1, len({tokens}) + 1), lambda i: {cond}))"


def _bm25_sql(leaves: list[list[str]], holds: str, limit: int) -> str:
    f = ", ".join(f"{_phrase_sql(t)}::DOUBLE AS f{k}" for k, t in enumerate(leaves))
    n = ", ".join(f"count(*) FILTER (f{k} > 0)::DOUBLE AS n{k}" for k in range(len(leaves)))
    idf = [f"CASE WHEN ln((n - n{k} + 0.5::DOUBLE) / (n{k} + 0.5::DOUBLE)) <= 0 THEN 0.000001::DOUBLE ELSE ln((n - n{k} + 0.5::DOUBLE) / (n{k} + 0.5::DOUBLE)) END" for k in range(len(leaves))]
    score = " + ".join(f"CASE WHEN f{k} > 0 THEN ({idf[k]}) * f{k} * 2.2::DOUBLE / (f{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d / avgd)) ELSE 0 END" for k in range(len(leaves)))
    return f"""
WITH t AS (SELECT doc_id, {FTS_SQL} AS w FROM documents), l AS (SELECT doc_id, len(w)::DOUBLE AS d, {f} FROM t),
s AS (SELECT count(*)::DOUBLE AS n, avg(d) AS avgd, {n} FROM l)
SELECT doc_id, round(-({score}), 6) AS score FROM l, s WHERE {holds} ORDER BY round(-({score}), 9), doc_id LIMIT {limit}
"""


def _search(spark, sf_dir, expression, limit):
    d = table(spark, sf_dir, "documents").withColumn("page_text", F.col("text"))
    index, lengths = fulltext.postings(d, "doc_id", ["page_text"], fulltext.terms_of(expression)), fulltext.doc_lengths(d, "doc_id", ["page_text"])
    return fulltext.search(index, lengths, [("q", expression, limit)], "doc_id", fulltext.PAGE_WEIGHTS).select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25_sql([["there"], ["license"]], "f0 > 0 OR f1 > 0", 50))
def fts_match_or(spark, sf_dir):
    return _search(spark, sf_dir, Or((Phrase("there"), Phrase("license"))), 50)


@query(_bm25_sql([["general", "public", "license"]], "f0 > 0", 50))
def fts_match_phrase(spark, sf_dir):
    return _search(spark, sf_dir, Phrase("General Public License"), 50)


@query(_bm25_sql([["all", "rights"], ["the"], ["idiot"]], "f0 > 0 OR (f1 > 0 AND f2 > 0)", 50))
def fts_match_and_or(spark, sf_dir):
    return _search(spark, sf_dir, Or((Phrase("all rights"), And((Phrase("the"), Phrase("idiot"))))), 50)


@query("SELECT doc_id FROM documents WHERE text ILIKE '%general public%' ORDER BY doc_id LIMIT 100")
def like_search(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("full_text", F.col("text"))
    return fulltext.like_search(d, "general public", 100, ("text",), "doc_id").select("doc_id")


@query(
    "WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) AS s FROM q, embeddings)"
    " SELECT query_id, vec_id, round(s, 6) AS score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM s WHERE s > 0) WHERE rank <= 10"
)
def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("vector"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return vectors.nearest(q, e, 10, "vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_BUCKET_SQL = f"""
WITH t AS (SELECT doc_id, regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '^\\s+|\\s+$', '', 'g') AS x FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, 'tok:' || unnest(regexp_extract_all(x, '({T.TOKENS['query']})', 1)) AS f, 1.0::DOUBLE AS w FROM t
 UNION ALL SELECT doc_id, 'tri:' || substr(replace(x, ' ', '_'), i, 3), 0.35::DOUBLE FROM (SELECT doc_id, x, unnest(range(1, length(x) - 1)) AS i FROM t)),
h AS (SELECT doc_id, sha1(f) AS h, sum(w) AS w FROM f GROUP BY doc_id, f)
SELECT doc_id, (('0x' || substr(h, 1, 8))::BIGINT % 64)::INT AS bucket, round(sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN w ELSE -w END), 6) + 0.0::DOUBLE AS value
FROM h GROUP BY 1, 2
"""


@query(_BUCKET_SQL)
def hash_embed_buckets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return vectors.sparse_embedding(d, "doc_id", "text", 64).select("doc_id", "bucket", (F.round("value", 6) + 0.0).alias("value"))


_ALL_BUCKETS = _BUCKET_SQL.replace("WHERE text IS NOT NULL", "").replace("lower(text)", "lower(coalesce(text, ''))").replace("round(sum(CASE", "sum(CASE").replace("END), 6) + 0.0::DOUBLE", "END)")
_ASKED = ", ".join(f"{x!r}::DOUBLE" for x in vectors.embed_py("the and of there", 64))


@query(
    f"""WITH b AS ({_ALL_BUCKETS}), n AS (SELECT doc_id, bucket, (value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE AS v FROM b WHERE value <> 0),
s AS (SELECT doc_id, sum(v * ([{_ASKED}])[bucket + 1]) AS s FROM n GROUP BY doc_id)
SELECT doc_id, round(s, 6) AS score, row_number() OVER (ORDER BY round(s, 12) DESC, doc_id)::INT AS rank FROM s WHERE s > 0 ORDER BY rank LIMIT 20"""
)
def hash_embed_topk(spark, sf_dir):
    d = vectors.embed(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", 64)
    q = spark.createDataFrame([(0, vectors.embed_py("the and of there", 64))], "query_id int, vector array<double>")
    return vectors.nearest(q, d, 20, "doc_id").select("doc_id", F.round("score", 6).alias("score"), "rank")


@query()
def plan_questions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("#", "conv_id", "turn").alias("question_id"), F.coalesce("text", F.lit("")).alias("question"))
    p = planner.plan_batch(c)
    return p.select("question_id", "plan.intent", "plan.request_shape", "plan.retrieval_mode", "plan.attribute_label", F.size("plan.focus_terms").alias("n_focus"))


@query()
def follow_up_anchors(spark, sf_dir):
    t = planner.follow_up_anchors(table(spark, sf_dir, "conversations"))
    return t.where("follow_up").select("conv_id", "turn", "anchor")
