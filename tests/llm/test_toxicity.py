import random

import numpy as np

from groundsearch.llm import toxicity as X


def corpus(n, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    out = []
    for i in range(n):
        s = [[rng.choice(vocab) for _ in range(rng.randint(3, 9))] for _ in range(rng.randint(1, 12))]
        y = int(rng.random() < 0.2)
        if y:
            rng.choice(s).insert(0, rng.choice(["zonk", "zonked", "vile"]))
        out.append((i, ". ".join(" ".join(x) for x in s) + ".", y))
    return out


def test_learns_from_document_labels_and_finds_the_sentence():
    data = [([sorted({w for w in X.WORD.findall(t[a:b])}) for a, b in X.sentences(t)], y) for _, t, y in corpus(800, 1)]
    m = X.fit(data)
    good = 0
    for _, t, y in corpus(300, 2):
        p, spans = m.score(t)
        good += (p >= X.THRESHOLD) == y
        if y and spans:
            assert any(w in t[spans[0][0] : spans[0][1]] for w in ("zonk", "vile"))
    assert good > 290
    low, high = m.score("abc. def."), m.score("abc. Zonk def. zonking.")
    assert low[0] < 0.1 < high[0] and len(high[1]) == 2


def test_noisy_or():
    m = X.Model({"a": 1.0, "b": 2.0}, -3.0)
    s = lambda z: 1 / (1 + np.exp(-z))
    want = 1 - (1 - s(-2)) * (1 - s(0)) * (1 - s(-3))
    assert abs(m.score("a a x! B a\nq")[0] - want) < 1e-12
    assert m.score(None) == (0.0, []) == m.score("") == m.score("...\n")


def test_query_rows_and_held_out_quality(spark, sf):
    import zlib

    rows = corpus(1500, 3)
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(None, None, ""), (5000, "", ""), (5001, "abc " * 30000 + ". zonk.", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    m = X.train(docs, labels)
    got = {r.doc_id: r for r in X.score_toxicity(docs, m).collect()}
    assert len(got) == 1503 and got[5001].predicted == 1 and got[None].score == 0 == got[5000].predicted
    held = [(y, got[i].predicted) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert X.train(docs.limit(0), labels) is None and X.score_toxicity(docs.limit(0), m).count() == 0
    q = X.op5_toxicity(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in q)


def test_query_against_a_plain_version(spark, sf):
    """Every score of the query from the model's weights, a sentence at a time; held-out quality on the table's own labels."""
    import math
    import re
    import zlib

    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = X.train(docs, labels)
    got = {r.doc_id: r for r in X.op5_toxicity(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for d in rows:
        clean = 1.0
        for s in re.split(r"[.!?\n]", (d.text or "").lower()):
            words = set(re.findall(r"[^\W_]+", s))
            if words:
                z = m.bias + sum(m.weights.get(f, 0.0) for w in words for f in [w, *(w[:k] + "~" for k in (3, 4, 5) if len(w) > k)])
                clean *= 1 - 1 / (1 + math.exp(-z))
        assert abs(got[d.doc_id].score - (1 - clean)) < 1e-9
    held = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    hit = sum(a and b for a, b in held)
    assert hit >= 0.5 * sum(a for a, _ in held) and hit >= 0.9 * sum(b for _, b in held)


def test_repeated_doc_ids_count_once(spark):
    rows = corpus(300, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = X.train(docs, labels), X.train(docs.union(docs).union(docs), labels.union(labels))
    assert a.weights == b.weights and a.bias == b.bias
