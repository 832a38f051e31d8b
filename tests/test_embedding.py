"""The hashing embedder: many texts at once, each different feature hashed once."""

import hashlib

from groundsearch.functions import text as T
from groundsearch.operators import vectors as V

TEXTS = ["The pump, the PUMP", "", "ab", "a", "É ï 😀😀 x/y-1\tz", "  spaced   out ", "valve " * 3000, None, "x\ny"]


def plain(text, dimension):
    """Bucket to value, feature by feature."""
    low, out = " ".join((text or "").lower().split()), {}
    flat = low.replace(" ", "_")
    for f, w in [*((f"tok:{t}", 1.0) for t in T.tokens_py(low)), *((f"tri:{flat[i : i + 3]}", 0.35) for i in range(max(0, len(flat) - 2)))]:
        h = hashlib.sha1(f.encode()).digest()
        b = int.from_bytes(h[:4], "big") % dimension
        out[b] = out.get(b, 0.0) + (w if h[4] % 2 == 0 else -w)
    return out


def test_sums_of_many_texts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").coalesce(1)
    got = {}
    for r in V.sparse_embedding(df, "id", "t", 64).collect():
        got.setdefault(r.id, {})[r.bucket] = r.value
    vectors = {r.id: r.vector for r in V.embed(df, "t", 64).collect()}
    for k, t in enumerate(TEXTS):
        want = plain(t, 64)
        norm = sum(x * x for x in want.values()) ** 0.5
        assert got.get(k, {}).keys() == want.keys() and all(abs(got[k][b] - x) < 1e-6 for b, x in want.items())
        assert all(abs(vectors[k][b] - (want.get(b, 0.0) / norm if norm else 0.0)) < 1e-6 for b in range(64))


def test_each_feature_is_hashed_once():
    V.hashed.cache_clear()
    V.sums(["valve seat " * 2000] * 50, 64)
    assert V.hashed.cache_info().misses < 30 and V.hashed.cache_info().hits < 30
