import math

import corpus_pipeline as C
import numpy as np
from groundsearch.llm import mixing, packing, simhash, substring, toxicity
from test_mixing import brute_targets
from test_packing import check
from test_simhash import brute_components, brute_fp
from test_substring import brute


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.collect()

    step = C.clean(spark, docs, sf).cache()
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert rows(step) == sorted((tuple(r) for r in before if model is None or model.score(r.text)[0] < 0.3), key=str)

    before = step.collect()
    step2 = C.distinct_documents(spark, step, sf).cache()
    comp = brute_components([r.doc_id for r in before], [brute_fp(r.text) for r in before])
    assert rows(step2) == sorted((tuple(r) for r, c in zip(before, comp, strict=True) if r.doc_id == c), key=str)
    assert step2.columns == docs.columns

    before = step2.collect()
    step3 = C.without_repeats(spark, step2, sf).cache()
    texts = brute([(r.doc_id, r.text) for r in before])
    assert rows(step3.select("doc_id", "text")) == sorted(((r.doc_id, t) for r, t in zip(before, texts, strict=True)), key=str)
    assert all(r.n_chars == len(r.text) for r in step3.collect())

    before = step3.collect()
    step4 = C.mixed(spark, step3, sf).cache()
    size, got = {}, {}
    for out, data in ((size, before), (got, step4.collect())):
        for r in data:
            out[r.source] = out.get(r.source, 0) + len(r.text.split())
    for s, t in brute_targets(size).items():
        assert abs(got.get(s, 0) - t) <= max(400, 0.1 * t), s
    originals = {tuple(r) for r in before}
    assert {tuple(r) for r in step4.collect()} <= originals and step4.columns == docs.columns

    docs5 = [(r.doc_id, r.text) for r in step4.collect()]
    n, _ = check(C.packed(spark, step4, sf).collect(), docs5)
    assert n > 0


def test_run_and_edge_rows(spark, sf, tmp_path):
    good = "the quick brown fox and some other words that differ "
    rows_ = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, good * 3, "en", "a", 1), (2, good * 3, "en", "a", 1), (3, good * 3, "en", "b", 1), (4, "unrelated text " * 3000, "en", None, 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("some", rows_), ("none", [])):
        d = tmp_path / name
        spark.createDataFrame(data, schema).withColumn("extra", substring.F.lit("clash")).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        out = C.run(spark, str(d))
        assert "sequence_id" in out.columns
        assert out.count() == 0 if name == "none" else out.count() > 0
    total = C.run(spark, sf)
    assert total.count() > 0 and math.isfinite(np.mean([r.length for r in total.collect()]))
    assert mixing and packing and simhash


def test_each_group_keeps_a_document_without_or_with_repeated_ids(spark, sf):
    """Clean different documents without doc_id all stay; a doc_id with two texts stands for each group that it names, and for no other."""
    text = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(12)]
    data = [(None, text[k]) for k in range(6)] + [(None, text[0])]  # five groups without ids, and one twice
    data += [(7, text[6]), (7, text[7]), (3, text[7])]  # 7 is the head of its first text's group only
    data += [(8, text[8]), (8, text[9])]  # 8 is the head of two groups
    data += [(None, text[10]), (9, text[10]), (9, text[10]), (None, None), (None, "")]
    docs = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text or "") for r in C.distinct_documents(spark, docs, sf).collect()), key=str)
    want = [(None, text[k]) for k in range(6)] + [(7, text[6]), (3, text[7]), (8, text[8]), (8, text[9]), (9, text[10]), (None, "")]
    assert got == sorted(want, key=str)
