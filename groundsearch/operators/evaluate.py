"""Evaluation of answers against cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundsearch.functions import lexicons as L


def answer_mode(text: Column) -> Column:
    """How an answer was made, by its wording."""
    return (
        F.when(F.trim(text) == L.REFUSAL, "refusal")
        .when(text.startswith("The contract addresses this in:"), "broad_topic_summary")
        .when(text.startswith("Answer: ") | F.contains(text, F.lit("\nEvidence: ")), "grounded_fact")
        .when(text.startswith("- "), "grouped_list")
        .otherwise("generated")
    )


def check_cases(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """cases (readers.CASES) joined with answers (question_id = name, text, refused, n_citations, top_ids, sections, pages): a column for
    each assertion, and passed."""
    j = cases.join(answers, F.col("name") == F.col("question_id"), "left")
    low = F.lower("text")
    checks = {
        "ok_refusal": F.when(F.col("expect_refusal"), F.col("refused")).otherwise(True),
        "ok_contains": F.forall("expected_answer_contains", lambda s: F.contains(low, F.lower(s))),
        "ok_citations": ~F.col("require_citations") | (F.col("n_citations") > 0),
        "ok_top": (F.size("expected_top_chunk_ids") == 0) | F.arrays_overlap("expected_top_chunk_ids", "top_ids"),
        "ok_section": F.col("expected_section").isNull() | F.array_contains("sections", F.col("expected_section")),
        "ok_page": F.col("expected_page").isNull() | F.array_contains("pages", F.col("expected_page")),
    }
    for name, c in checks.items():
        j = j.withColumn(name, F.coalesce(c, F.lit(False)))
    passed = F.lit(True)
    for name in checks:
        passed = passed & F.col(name)
    return j.withColumn("passed", passed)


def summary(checked: DataFrame) -> DataFrame:
    return checked.groupBy("category").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"))
