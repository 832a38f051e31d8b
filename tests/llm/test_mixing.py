import numpy as np

from groundsearch.llm import mixing as M


def brute_targets(sizes):
    keys = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    weight = {k: (1, 2, 3)[i % 3] for i, k in enumerate(keys)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        open_w = sum(weight[k] for k in keys if k not in capped)
        share = {k: rest * weight[k] / open_w for k in keys if k not in capped} if open_w else {}
        over = [k for k in share if share[k] > 3 * sizes[k]]
        if not over:
            return capped | share
        capped |= {k: 3 * sizes[k] for k in over}


def table(spark, rng, n=3000):
    rows = []
    for i in range(n):
        s = rng.choice(["a", "b", "tiny", "é", None, "hot", "hot", "hot"]) if i else "tiny"
        s = None if s == "None" or s is None else str(s)
        if s == "tiny" and i > 3:
            s = "hot"
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 90))) if i % 50 else None, s, "extra"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def check(got, block):
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
    want = brute_targets(sizes)
    for s, t in want.items():
        assert abs(target[s] - t) < 1e-6 * max(1, t)
        assert abs(taken[s] - t) <= 90, (s, taken[s], t)
    for r in got:
        assert r.source_size == sizes[r.source]


def test_targets_and_words_taken(spark):
    df = table(spark, np.random.default_rng(1))
    for block in (4096, 64):
        check(M.mix(df, block).collect(), block)


def test_reruns_agree_however_rows_are_dealt(spark):
    df = table(spark, np.random.default_rng(2), 600)
    a = sorted((r.doc_id, r.taken) for r in M.mix(df, 64).collect())
    b = sorted((r.doc_id, r.taken) for r in M.mix(df.repartition(7, "text"), 64).collect())
    assert a == b and len(a) == 600


def test_rounding_keeps_expectations():
    size, part = np.array([5, 7, 1, 9, 3]), np.array([0.3, 0.5, 0.2, 0.7, 0.9])
    got = np.mean([M.pivot(size, part, np.random.default_rng(i), False) for i in range(4000)], axis=0)
    assert np.abs(got - part).max() < 0.04


def test_edge_rows(spark):
    schema = "doc_id long, text string, source string"
    assert M.mix(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c", None), (1, None, "s"), (1, "x y", "s"), (1, "x y", "s"), (2, "", "empty")]
    df = spark.createDataFrame(rows, schema)
    got = M.mix(df).collect()
    assert len(got) == 5 and all(r.taken <= 3 * r["size"] for r in got)
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    assert sum(len(t.split()) for t, in out.select("text").collect() if t) == sum(r.taken for r in got)
