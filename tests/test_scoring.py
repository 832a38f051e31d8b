from groundsearch.operators import planner, scoring
from pyspark.sql import functions as F

SCHEMA = "question_id string, chunk_id string, chunk_type string, clause_type string, section_number string, heading string, parent_heading string, full_text string, actor_tags string, action_tags string, topic_tags string, noise_flags string, page_start int"


def scores(spark, plans, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.question_id, r.chunk_id): r.row_score for r in scoring.score_rows(df, scoring.plan_rows(spark, plans), F.lit(0.0), F.lit(0.0)).collect()}


def row(q, c, heading, body, kind="section", parent="", section="3.1", tags=("", "", ""), noise="", page=30):
    return (q, c, kind, None, section, heading, parent, body, *tags, noise, page)


def test_rules_add_up(spark):
    p = planner.Plan("Section 4.1", "section 4.1", "", section_number="4.1", focus_terms=("delay", "damages"), topic_terms=("schedule",))
    rows = [
        row("q", "section", "Other", "Nothing here at all.", section="4.1"), row("q", "heading", "Delay Damages", "Nothing here at all."), row("q", "parent", "Other", "Nothing here at all.", parent="Delay Damages"),
        row("q", "tag", "Other", "Nothing here at all.", tags=("", "", "schedule")), row("q", "dots", "Other .... 5", "Nothing here at all.", noise="thin date_heading"), row("q", "null", None, None, section=None),
    ]
    got = scores(spark, {"q": p}, rows)
    want = {"section": 1.2, "heading": 0.75 + 0.55 + 2 * 0.16, "parent": 0.25 + 0.35 + 2 * 0.16, "tag": 0.8 + 0.12, "dots": -0.45 - 0.75 - 0.2, "null": 0.0}
    assert {c: round(v, 9) for (_, c), v in got.items()} == {c: round(v, 9) for c, v in want.items()}


def test_system_and_attribute_belong_together(spark):
    p = planner.Plan("q", "q", "", system_phrase="feed pump", system_terms=("feed", "pump"), attribute_label="power", attribute_terms=("power",))
    rows = [row("q", "both", "Feed Pump", "Its motor takes 75 hp and 20 kw."), row("q", "system", "Feed Pump", "It is blue and large."), row("q", "attribute", "Heater", "Its motor takes 75 hp."), row("q", "none", "Heater", "It is blue and large."), row("q", "thin", "Feed Pump", "3.1")]
    got = {c: round(v, 9) for (_, c), v in scores(spark, {"q": p}, rows).items()}
    assert got == {"both": round(1.8 + 0.44 + 1.2 + 0.5 + 1.25, 9), "system": round(1.8 + 0.44 - 0.95, 9), "attribute": round(1.2 + 0.25 - 0.95, 9), "none": -1.35, "thin": round(1.8 + 0.44 - 0.95 - 2.5, 9)}


def test_bundles(spark):
    p = planner.Plan("feed pump", "feed pump", "", system_phrase="feed pump")
    base = "question_id string, primary_id string, at int, chunk_id string, score double, row_score double, chunk_type string, section_number string, heading string, full_text string, page_start int, parent_chunk_id string"
    rows = [("q", "a", 0, "a", 1.0, 2.0, "exhibit", "1", "Feed Pump", "A pump of some kind.", 1, None), ("q", "a", 2, "b", 1.0, 3.0, "section", "1.1", "Child", "More about it here.", 1, "a")]
    (got,) = scoring.score_bundles(spark.createDataFrame(rows, base), scoring.plan_rows(spark, {"q": p})).collect()
    from groundsearch.operators import vectors

    cosine = sum(a * b for a, b in zip(vectors.embed_py("feed pump"), vectors.embed_py("Feed Pump A pump of some kind. Child More about it here."), strict=True))
    assert abs(got.bundle_score - (0.22 * 3 + 0.18 + 1.35 * cosine + 0.55 + 0.08 + 0.15 + 0.12 + 0.15)) < 1e-6
    assert abs(got.confidence - min(1, 0.46 + 0.35 * cosine + 0.08 + 0.05)) < 1e-6
