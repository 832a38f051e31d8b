"""Search features of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundsearch.functions import lexicons as L
from groundsearch.functions import text as T


def features(chunks: DataFrame) -> DataFrame:
    """A row for each chunk: the parent's heading, normalised and search text, actor, action and topic tags, noise flags.

    The parent is one equi-join on chunk id; everything else is within the row, much work for each, for which rows are dealt anew.
    """
    parents = chunks.select(F.col("chunk_id").alias("p_id"), F.col("heading").alias("parent_heading"))
    c = chunks.join(parents, F.col("parent_chunk_id") == F.col("p_id"), "left").withColumn("parent_heading", F.coalesce("parent_heading", F.lit("")))
    c = c.repartition(chunks.sparkSession.sparkContext.defaultParallelism * 4, "chunk_id")
    heading, parent, body = T.norm(F.col("heading")), T.norm(F.col("parent_heading")), T.norm(F.col("full_text"))
    c = c.withColumns({"n_h": heading, "n_p": parent, "n_b": body})
    some = lambda *xs: F.filter(F.array(*xs), lambda x: x != "")
    number = F.coalesce("section_number", F.lit(""))
    c = c.withColumn("normalized_text", F.array_join(some(number, "n_h", "n_p", "n_b"), " "))
    for name, lexicon in (("actor_tags", L.ACTORS), ("action_tags", L.ACTIONS), ("topic_tags", L.TOPICS)):
        c = c.withColumn(name, F.array_join(T.labels(F.col("normalized_text"), lexicon), " "))
    dots = (F.length("full_text") - F.length(F.replace("full_text", F.lit("...."), F.lit("")))) / 4
    flags = F.array_compact(
        F.array(
            F.when(F.contains("heading", F.lit("....")) | (dots >= 3), "toc"),
            F.when((F.col("page_start") <= 20) & F.col("section_number").isNull(), "front_matter"),
            F.when(F.regexp_like(F.trim("heading"), F.lit(r"^\d{1,2}-[A-Za-z]{3}-\d{2}$")), "date_heading"),
            F.when((F.size(T.tokens(F.col("n_h"), "search")) <= 1) & (F.size(T.tokens(F.col("n_b"), "search")) <= 8), "thin"),
        )
    )
    search = F.array_join(F.array_distinct(some(number, "n_h", "n_p", "n_b", "actor_tags", "action_tags", "topic_tags", "chunk_type")), " ")
    return c.select(
        "chunk_id", "document_id", "section_number", "heading", "parent_heading", search.alias("search_text"), "normalized_text", F.col("chunk_type").alias("clause_type"), "actor_tags",
        "action_tags", "topic_tags", F.array_join(flags, " ").alias("noise_flags"),
    )
