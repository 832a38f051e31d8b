import re

import duckdb

from groundsearch.llm import quality as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + o for i, g in enumerate(grams) if grams.count(g) > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed)


ROWS = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "a b c a b c", "b"), (5, "the the the the", "b"), (6, "x\ny\nx\n \nx", "b"),
    (7, " ".join(f"w{i % 40}" for i in range(400)), "c"), (8, " ".join(f"w{i}" for i in range(20000)), "c"), (8, "é 𝄞 #* <b>|", "c"), (None, "one two", "c"),
    (9, "a b c\x0bd\x0ce\r\nf a b c d a b", None),
]


def test_rules_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("n_words", Q.F.lit("clash"))
    got = Q.apply_rules(df).collect()
    key = lambda x: str(x)
    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key)
    assert have == sorted(((i, *brute(t)) for i, t, _ in ROWS), key=key)


GOOD = " ".join(f"w{i}" for i in range(60))


def hosts(counts):
    """Rows of hosts given as {name: (rows, failing rows)}."""
    return [(k, "short" if k < bad else GOOD, h) for h, (n, bad) in counts.items() for k in range(n)]


def test_host_verdicts(spark):
    """Rows that are equal by themselves are kept or not by their host; at least one host is rejected, and small ones are shrunk enough to stay."""
    rows = hosts({"good": (31, 1), "bad": (40, 38), "new": (1, 0)})
    got = Q.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", Q.F.col("source")))
    by = {(r.kept, r.base_failed, round(r.host_rate, 6)) for r in got.collect()}
    assert {(k, b) for k, b, r in by if r > 0.8} == {(False, True), (False, False)} and {(k, b) for k, b, r in by if r < 0.5} == {(False, True), (True, False)}


def test_verdicts_by_the_formula_and_in_sql(spark, tmp_path):
    """Forty hosts of differing rates and sizes, one with a third of all rows: the verdicts follow the fitted prior, in Python and in SQL."""
    import math
    import random

    rng = random.Random(7)
    counts = {f"h{i}": (n := rng.randint(1, 120), sum(rng.random() < 0.1 for _ in range(n))) for i in range(36)}
    counts |= {"hot": (1100, 120), "spam": (200, 150), "worse": (60, 58), "tiny": (2, 2)}
    df = spark.createDataFrame(hosts(counts), "doc_id long, text string, source string")
    got = {r.host: r for r in Q.host_rates(Q.document_rules(df, "source")).collect()}
    raw = [b / n for n, b in counts.values()]
    m = sum(raw) / len(raw)
    v = sum((x - m) ** 2 for x in raw) / len(raw) - m * (1 - m) * sum(1 / n for n, _ in counts.values()) / len(raw)
    prior = min(max(m * (1 - m) / v - 1, 2), 1000)
    limit = min(m + 2 * math.sqrt(m * (1 - m) / (prior + 1)), (1 + m) / 2)
    for h, (n, bad) in counts.items():
        rate = (bad + m * prior) / (n + prior)
        assert abs(got[h].rate - rate) < 1e-9 and abs(got[h].limit - limit) < 1e-9
        assert got[h].rejected == (rate - 2 * math.sqrt(rate * (1 - rate) / (n + prior + 1)) > limit)
    assert {h for h, r in got.items() if r.rejected} == {"spam", "worse"}
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    out = Q.op8_quality(spark, str(tmp_path))
    cols = sorted(out.columns)
    assert sorted(tuple(r[c] for c in cols) for r in out.collect()) == sorted(con.sql(Q.OP8_SQL).select(*cols).fetchall())
    assert out.where("NOT base_failed AND NOT kept").count() == 52


def test_hosts_that_are_all_alike_stay(spark):
    rows = hosts({f"h{i}": (100, 40 + i % 3) for i in range(12)})
    assert Q.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("kept <> (NOT base_failed)").count() == 0


def test_empty_table(spark):
    assert Q.apply_rules(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_query_matches_sql_and_stays_native(spark, sf):
    df = Q.op8_quality(spark, sf)
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(Q.OP8_SQL)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(want.select(*cols).fetchall())
