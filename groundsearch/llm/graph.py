"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundsearch.llm.common import materialised


def _state(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """Label each node of the links (a, b) with the smallest node that it reaches.

    Returns (node, root) for every node that has a link to another node; links to oneself and null ends are ignored, repeated links and
    either direction are fine. Each round is a few partial aggregations and joins on node ids, and ends in a checkpoint, so a lost executor
    costs one round. Rounds grow with the logarithm of the longest path. rows: about how many links there may be, if known; from the first
    round on the number is known.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    e = materialised(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows)
    state = _state(e)
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        e = materialised(small.select("e.a", "e.b").where("a <> b").distinct(), state["n"])
        now = _state(e)
        if now == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
        state = now
