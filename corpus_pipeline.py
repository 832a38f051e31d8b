"""The corpus pipeline: toxicity, near duplicates, repeated passages, source mixing, packing. Each stage reads what the one before wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundsearch.llm import mixing, packing, simhash, substring, toxicity
from groundsearch.llm.common import remove, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. The model is fitted on labelled documents of the input; without labels all stay.

    Null and empty texts score 0 and stay; repeated rows are scored, and stay or go, each; very long texts are scored whole.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one whose doc_id names the group.

    Of rows of the group that repeat that doc_id one stays; rows without a doc_id stay only as the single row of a group that has no other.
    A row is known by its doc_id and a hash of its text, as a doc_id may come with several texts, or be null in many rows.
    """
    version = F.xxhash64(F.col("text").cast("string"))
    groups = simhash.grouped(docs.select("doc_id", "text", version.alias("version")))
    heads = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("doc_id").alias("h"), F.min("version").alias("h_version"))
    here = F.col("doc_id").eqNullSafe(F.col("h")) & (F.col("version") == F.col("h_version"))
    kept = docs.select(*COLUMNS, version.alias("version")).join(heads.select("h", "h_version"), here).drop("h", "h_version")
    # rows equal in doc_id and text are rare: the window's partitions are single rows
    first = Window.partitionBy("doc_id", "version").orderBy(F.col("text").isNull(), "source", "lang", "n_chars")
    return kept.withColumn("k", F.row_number().over(first)).where("k = 1").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from all texts but the first by doc_id; n_chars follows. Null texts stay null, texts that are all repeated stay as
    empty ones; repeated rows count as one document."""
    out = substring.dedup_substrings(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for, at most three; those taken no time go. A null source is one of its own."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, repeated rows each, placed in sequences of 1024 tokens; a null or empty text is a piece of one token."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", clean),
    ("near_duplicates", distinct_documents),
    ("repeated_passages", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]

#: Language models, hashes and rounding: not in SQL. tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and goes when the next stage has written its own.

    Columns of documents other than COLUMNS are left out from the first stage on, whatever their names; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{top}/{k}-{name}")
        if k:
            remove(spark, f"{top}/{k - 1}-{STAGES[k - 1][0]}")
        docs = spark.read.schema(out.schema).parquet(f"{top}/{k}-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
