"""Postings of a question's terms, made within the rows, are those of the whole index; a retriever without an index finds the same."""

import corpus_fixture as fixture

from groundsearch.operators import corpus as C
from groundsearch.operators import fulltext as FT
from groundsearch.operators import planner, segment
from groundsearch.operators.recall import Retriever, merge


def test_postings_of_wanted_terms(spark):
    df = spark.createDataFrame([(1, "The Pump, the pump", "é valve"), (2, None, ""), (3, "valve the", "pump")], "id long, h string, b string")
    rows = lambda p: {(r.id, r.field, r.term, tuple(r.positions), r.tf) for r in p.collect()}
    whole = FT.postings(df, "id", ["h", "b"])
    for terms in (["the", "pump"], ["e"], ["absent"], []):
        assert rows(FT.postings(df, "id", ["h", "b"], terms)) == {r for r in rows(whole) if r[2] in terms}
    assert "Exchange" not in FT.postings(df, "id", ["h", "b"], ["the"])._jdf.queryExecution().executedPlan().toString()


def test_retriever_without_an_index(spark):
    chunks = segment.chunks(fixture.pages(spark))
    made = {k: v.cache() for k, v in C.derive_from_chunks(chunks).items()}
    fields = list(FT.FEATURE_WEIGHTS)
    index = FT.postings(made["features"], "chunk_id", fields), FT.doc_lengths(made["features"], "chunk_id", fields)
    plans = {k: planner.plan(fixture.QUESTIONS[k][0]) for k in ("capacity", "permit", "section")}
    got = []
    for r in (Retriever(chunks, made["features"], made["embeddings"], made["facts"], None, index), Retriever(chunks, made["features"], made["embeddings"], None, None)):
        merged = merge(r.candidates(plans)).collect()
        b = r.retrieve(plans).collect()
        got.append(({(x.question_id, x.chunk_id, round(x.score, 9), x["rank"]) for x in merged}, {(x.question_id, x.primary_id, x.chunk_id, x.bundle_rank, x.depth, x.position) for x in b}))
    assert got[0] == got[1] and len(got[0][0]) > 10 < len(got[0][1])
