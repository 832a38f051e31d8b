import itertools
import random

import numpy as np

from groundsearch.llm import language as L


def brute(model, word, lang):
    """P(word): the sum over every way to cut it into pieces."""
    total, col = 0.0, model.languages.index(lang)
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        parts, at = [], 0
        for k, c in enumerate(cuts, 1):
            if c:
                parts.append(word[at:k])
                at = k
        parts.append(word[at:])
        p = 1.0
        for x in parts:
            i = model.index.get(x, len(model.pieces) if len(x) == 1 else None)
            p *= 0 if i is None else model.theta[i, col]
        total += p
    return total


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "bb"]
    theta = rng.random((len(pieces) + 1, 2))
    theta /= theta.sum(axis=0)
    m = L.Model(["x", "y"], pieces, theta)
    words = ["▁a", "▁abba", "▁ababab", "▁zb", "▁bab"]
    got = m.log_words(words)
    for w, row in zip(words, got, strict=True):
        assert np.allclose(np.exp(row), [brute(m, w, "x"), brute(m, w, "y")])
    long = m.log_words(["▁" + "ab" * 400])
    assert np.isfinite(long).all() and (long < -100).all()


def test_fit_raises_likelihood():
    counts = {"x": L.Counter({"abab": 9, "ab": 5}), "y": L.Counter({"ba": 7, "bbb": 3})}
    pieces = ["a", "ab", "b", "ba", "bb", "▁", "▁ab", "▁b"]
    like = [sum(n * m.log_words(["▁" + w])[0, k] for k, lang in enumerate(m.languages) for w, n in counts[lang].items()) for m in (L.fit(counts, pieces, r, 1e-6) for r in (1, 2, 4))]
    assert like[0] < like[1] < like[2]
    assert np.allclose(m_theta(L.fit(counts, pieces)), 1)


def test_words_of_over_40_letters_count_in_fitting():
    """Expected counts of a long word equal those by plain sums, which still hold at this length."""
    pieces = ["a", "ab", "b", "ba", "bb", "▁", "▁ab", "▁b"]
    m = L.fit({"x": L.Counter({"abab": 9}), "y": L.Counter({"bba": 7})}, pieces)
    word = "▁" + "abba" * 12
    got = m.expected([word], np.ones((1, 2)))
    n, theta = len(word), np.vstack([m.theta, np.zeros(2)])
    at = {(i, j): m.index.get(word[i:j], len(pieces) if j == i + 1 else -1) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1)}
    a, b = np.zeros((n + 1, 2)), np.zeros((n + 1, 2))
    a[0] = b[n] = 1
    for j in range(1, n + 1):
        a[j] = sum(a[i] * theta[at[i, j]] for i in range(max(0, j - 3), j))
    for i in reversed(range(n)):
        b[i] = sum(theta[at[i, j]] * b[j] for j in range(i + 1, min(n, i + 3) + 1))
    want = np.zeros_like(m.theta)
    for (i, j), p in at.items():
        if p >= 0:
            want[p] += a[i] * theta[p] * b[j] / a[n]
    assert np.allclose(got, want)
    assert np.isfinite(m.expected(["▁" + "ab" * 3000], np.ones((1, 2)))).all() and m.expected(["▁" + "ab" * 3000], np.ones((1, 2))).sum() > 1000


def test_numerals_are_no_letters():
    m = L.fit({"x": L.Counter({"abab": 9}), "y": L.Counter({"ba": 7})}, ["a", "b", "▁"])
    assert L.score_texts(m, ["² ½", "① Ⅳ", "12 _", None, ""], {}, []) == [("und", 0.0)] * 5
    assert L.words_of("a²b x² é") == {"a": 1, "b": 1, "x": 1, "é": 1}


def m_theta(m):
    return m.theta.sum(axis=0)


def test_held_out_accuracy_and_rows(spark, sf):
    got = {r.doc_id: r for r in L.op9_language(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()
    assert len(got) == len(docs)
    held = [(d.lang, got[d.doc_id].lang_pred) for d in docs if got[d.doc_id].held_out]
    assert len(held) > 20 and np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edge_rows(spark):
    rng = random.Random(1)
    en = ["the cat sat on the mat", "a dog and the house", "the end of the road"]
    fr = ["le chat est sur la table", "une maison et le chien", "la fin de la route"]
    rows = [(i, rng.choice(en), "en") for i in range(30)] + [(100 + i, rng.choice(fr), "fr") for i in range(30)] + [(None, None, None), (200, "", "en"), (200, "123 !?", None), (201, "the cat " * 20000, None), (202, "ß" * 500, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", L.F.lit("clash"))
    model = L.train(df, L.F.coalesce(L.remainder(5) == 0, L.F.lit(False)))
    got = L.identify(df, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[201].lang_pred == "en" and by[202].lang_pred in ("en", "fr")
    assert by[None].lang_pred == "und" and by[None].score == 0 and {r.lang_pred for r in got if r.doc_id == 200} == {"und"}
    assert L.train(df.limit(0), L.F.lit(False)) is None
    assert {r.lang_pred for r in L.identify(df, None).collect()} == {"und"}
