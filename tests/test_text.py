import sqlite3

import pytest
from pyspark.sql import functions as F

from groundsearch.functions import text as T
from groundsearch.operators import fulltext as FT
from groundsearch.operators import vectors as V

NAMES = ["Closed Cooling Water Systems", "CCW", "dew point heaters", "Condensate Transfer Pumps", "fire water pump system", "main steam line systems", "pumps", "glass", "", "The  Boss's unit", "air compressor trains"]
ATTRIBUTES = ["duty", "Throughput", "ratings", "rated", "design_conditions", "flow rates", "Configuration / Arrangement", "colours", "", "models"]


def column(spark, values, f, other=None):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("name", ["norm", "lookup_key", "system_name", "attribute_name", "sentences", "exact_value", "fts_tokens"])
def test_column_and_plain_forms_agree(spark, name):
    values = NAMES + ATTRIBUTES + ["It’s a  GUARENTEE. Yes; no:  “ok”\nÉté über 4X50 ,.", "a. B! c"]
    assert column(spark, values, getattr(T, name)) == [getattr(T, f"{name}_py")(v) for v in values]


def test_names():
    assert T.system_name_py("Closed cooling water system") == "closed cooling water" == T.system_name_py("ccw")
    assert T.system_name_py("Condensate Transfer Pumps") == "condensate transfer pump"
    assert T.system_name_py("fire water pump system") == "fire water pump"
    assert T.system_aliases_py("dew point heater")[0] == "dew point heater" and "dew point heater system" in T.system_aliases_py("dew point heater")
    assert T.attribute_name_py("duty") == "service" and T.attribute_name_py("throughput") == "flow" and T.attribute_name_py("rated") == "power" and T.attribute_name_py("models") == "type"
    assert T.attribute_terms_py("flow rate") == ("flow", "flow rate", "flowrate", "throughput")


def test_phrases_and_hits(spark):
    assert not T.has_phrase_py("the heater.", "heater") and T.has_phrase_py("The  Heater works", "heater")
    assert T.hit_count_py("the heater.", ["heat", "heater", "", "pump"]) == 2
    df = spark.createDataFrame([("the heater. works pump", ["heat", "pump"])], "x string, t array<string>")
    r = df.select(T.has_phrase(F.col("x"), "works").alias("a"), T.hit_count(F.col("x"), F.col("t")).alias("b"), T.ordered_hits(F.col("x"), F.col("t")).alias("c"), T.short(F.col("x"), 10).alias("d"), T.html_escape(F.lit("<a & 'b'>")).alias("e"), T.compact_heading(F.lit("A ..... B |-")).alias("g"), T.page_range(F.lit(2), F.lit(4)).alias("h"), T.number_count(F.lit("2 x 50% at 600 psig")).alias("n")).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.h, r.n) == (True, 2, True, "the hea...", "&lt;a &amp; &#x27;b&#x27;&gt;", "2-4", 3)
    assert r.g == "A . B"


DOCS = [(1, "Pump heading", "the pump shall be rated. the PUMP. Über-pump"), (2, "Other", "shall be the pump rated at"), (3, "", "nothing here"), (4, "pump", "x"), (5, "shall", "be rated shall be rated shall be rated")]


@pytest.mark.parametrize(
    "expression,match",
    [
        (FT.Phrase("pump"), '"pump"'), (FT.Phrase("shall be rated"), '"shall be rated"'), (FT.Phrase("pump", ("h",)), 'h : "pump"'),
        (FT.Or((FT.And((FT.Phrase("the"), FT.Phrase("rated"))), FT.Phrase("uber"))), '("the" AND "rated") OR "uber"'), (FT.Phrase("5.4"), '"5.4"'),
    ],
)
def test_bm25_against_sqlite(spark, expression, match):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(h, b, tokenize = 'unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO f(rowid, h, b) VALUES (?, ?, ?)", DOCS)
    want = {i: round(s, 9) for i, s in con.execute("SELECT rowid, bm25(f, 3.0, 1.0) FROM f WHERE f MATCH ?", (match,))}
    df = spark.createDataFrame(DOCS, "id long, h string, b string")
    w = {"h": 3.0, "b": 1.0}
    got = FT.search(FT.postings(df, "id", ["h", "b"]), FT.doc_lengths(df, "id", ["h", "b"]), [("p", expression, 10)], "id", w).collect()
    assert {r.id: round(r.score, 9) for r in got} == want
    assert [(r.id, round(r.score, 9)) for r in FT.scan_search(df, "id", expression, w, 10).collect()] == [(r.id, round(r.score, 9)) for r in sorted(got, key=lambda r: r["rank"])]


def test_snippet_and_like(spark):
    text = " ".join(f"w{i}" for i in range(60)) + " the pump runs " + " ".join(f"v{i}" for i in range(60))
    df = spark.createDataFrame([("k1", text, 2), ("k2", "50% of É", 1)], "chunk_id string, full_text string, ordinal_in_document int")
    s = df.where("chunk_id = 'k1'").select(FT.snippet(F.col("full_text"), ["pump"], 10)).first()[0]
    assert "[pump]" in s and len(s.split()) <= 12
    hits = FT.like_search_many(df, [("a", "PUMP", 5), ("b", "50% of", 5), ("c", "absent", 5)], fields=("full_text",)).collect()
    assert {(h.id, h.chunk_id) for h in hits} == {("a", "k1"), ("b", "k2")}


def test_embedder(spark):
    v = V.embed_py("The pump, the PUMP")
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and V.embed_py("") == [0.0] * 512
    df = spark.createDataFrame([(1, "The pump, the PUMP"), (2, None), (3, "ab"), (4, "of an engine")], "id long, t string")
    sparse = {}
    for r in V.sparse_embedding(df.where("t IS NOT NULL"), "id", "t").collect():
        sparse.setdefault(r.id, {})[r.bucket] = r.value
    for i, t in ((1, "The pump, the PUMP"), (4, "of an engine")):
        norm = sum(x * x for x in sparse[i].values()) ** 0.5
        assert all(abs(sparse[i].get(k, 0) / norm - x) < 1e-9 for k, x in enumerate(V.embed_py(t)))
    e = V.embed(df, "t")
    q = spark.createDataFrame([(9, v)], "query_id long, vector array<double>")
    got = V.nearest(q, e, 2, "id").orderBy("rank").collect()
    assert got[0].id == 1 and abs(got[0].score - 1) < 1e-6 and len(got) <= 2
    assert spark.range(1).select(V.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0)))).first()[0] == 3.0
