"""Streaming ingest: arriving pages replace their documents in a corpus. An extension of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundsearch.operators.corpus import Corpus
from groundsearch.sources.readers import gate_pages


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Pages (document_id, page_num, page_text) that arrive as Parquet files in a folder."""
    schema = "document_id string, page_num int, page_text string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, corpus: Corpus, checkpoint: str, once: bool = True):
    """Start the stream: each batch's documents are rebuilt from their stored pages and the new ones, a page's latest text counting.

    A batch that is repeated after a failure gives the same tables.
    """

    def batch(new: DataFrame, _: int) -> None:
        if not new.take(1):
            return
        new = gate_pages(new.groupBy("document_id", "page_num").agg(F.max("page_text").alias("page_text")))
        old = corpus.table("pages").join(new.select("document_id").distinct(), "document_id", "left_semi").join(new.select("document_id", "page_num"), ["document_id", "page_num"], "left_anti")
        corpus.replace_documents(old.unionByName(new))

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
