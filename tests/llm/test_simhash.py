import random

import numpy as np
import pytest
import xxhash

from groundsearch.llm import simhash as S


def brute_fp(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(ids))]


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(1)
    for free in ((1 << 64) - 1, rng.getrandbits(64), 0xFFFF):
        bits = [i for i in range(64) if free >> i & 1]
        masks = S.covering_masks(free, 4)
        for _ in range(2000):
            diff = sum(1 << b for b in rng.sample(bits, rng.randint(0, 4)))
            assert any(not diff & m for m in masks)


def test_every_mask_fixes_a_bit():
    """Without this a large bucket would be divided into itself, for ever."""
    rng = random.Random(5)
    for n in range(5, 65):
        free = sum(1 << b for b in rng.sample(range(64), n))
        assert all(S.covering_masks(free, 4))


def test_a_large_group_ends_and_is_whole(spark):
    """6000 fingerprints that share 50 bits, in buckets of at most 512: many divisions; against union-find over all pairs."""
    rng = np.random.default_rng(6)
    fps = np.unique((0x5A5A5A5A5A5A5A5A & ~((1 << 14) - 1) & ((1 << 63) - 1)) | rng.choice(1 << 14, 6000, replace=False).astype(np.int64))
    from groundsearch.llm.graph import connected_components

    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    got = {r.node: r.root for r in connected_components(S.fingerprint_links(df, 4, 512, len(fps))).collect()}
    want, left = {}, set(fps.tolist())
    while left:
        todo, group = [left.pop()], []
        while todo:
            x = todo.pop()
            group.append(x)
            rest = np.fromiter(left, np.int64, len(left))
            near = rest[np.bitwise_count(rest ^ x) <= 4].tolist()
            left -= set(near)
            todo += near
        want |= dict.fromkeys(group, min(group))
    assert {int(x): got.get(int(x), int(x)) for x in fps} == want


def test_fingerprint_matches_brute_force():
    rng = random.Random(2)
    words = ["Alpha", "beta", "É", "x y", "DELTA", "the"]
    for n in (0, 1, 3, 4, 5, 50, 40000):
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", "\t\x0b "]) for _ in range(n))
        assert S.fingerprint(text.encode()) == brute_fp(text)
    assert S.fingerprint(None) == 0 == S.fingerprint(b" \n")


@pytest.mark.parametrize("bucket", [4096, 10])
def test_components_against_brute_force(spark, bucket):
    """With buckets of 10 every larger bucket takes the finer masks; nothing may be lost."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = list(base)
    for _ in range(60):
        x = rng.choice(fps[:9])
        for b in rng.sample(range(64), rng.randint(0, 5)):
            x ^= 1 << b
        fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long")
    from groundsearch.llm.graph import connected_components

    got = {r.node: r.root for r in connected_components(S.fingerprint_links(df, 4, bucket)).collect()}
    want = brute_components([S._signed(x) for x in fps], fps)
    assert [got.get(S._signed(x), S._signed(x)) for x in fps] == want


def test_query_edge_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60000))
    rows = [(5, None, "x"), (3, "", "y"), (9, "One two three four five", None), (8, "one TWO three four five", "y"), (8, "one TWO three four five", "y"), (None, long, "z"), (7, long + " tail", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id or 0), r.fp, r.component_id) for r in S.near_duplicates(df).collect())
    fps = [brute_fp(r[1]) for r in rows]
    want = sorted(((r[0] or 0), S._signed(f), c) for r, f, c in zip(rows, fps, brute_components([r[0] for r in rows], fps), strict=True))
    assert got == want
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_whole_table_against_brute_force(spark, sf):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op1_simhash(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_fp(d.text) for d in docs]
    want = brute_components([d.doc_id for d in docs], fps)
    assert got == {d.doc_id: (f"{f:016x}", c) for d, f, c in zip(docs, fps, want, strict=True)}


def test_near_links_joins_chains():
    x = np.array([0, 0b1111, 0b11111111, 1 << 40], np.int64)
    assert {frozenset(p) for p in S.near_links(x, 4)} == {frozenset((0, 15)), frozenset((15, 255)), frozenset((0, 1 << 40))}
