import corpus_fixture as fixture
import pytest

from groundsearch import schemas
from groundsearch.operators import evaluate, planner, vocabulary
from groundsearch.operators.answer import Assistant
from groundsearch.operators.corpus import Corpus
from groundsearch.operators.recall import Retriever
from groundsearch.plans import registry
from groundsearch.sources import readers
from groundsearch.streaming import ingest


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    c = Corpus(spark, str(tmp_path_factory.mktemp("corpus")))
    assert c.validate()["error"] == "missing"
    counts = c.replace_documents(readers.gate_pages(fixture.pages(spark)))
    assert counts["chunks"] == counts["features"] == counts["embeddings"] > 0 < counts["facts"]
    return c


@pytest.fixture(scope="module")
def assistant(corpus):
    t = corpus.table
    r = Retriever(t("chunks"), t("features"), t("embeddings"), t("facts"), t("pages"), corpus.build_index())
    return Assistant(r, [x.asDict() for x in vocabulary.vocabulary(t("chunks")).orderBy("rank").collect()])


def test_questions_and_refusals(spark, assistant):
    asked = {k: q for k, (q, _) in fixture.QUESTIONS.items()} | fixture.UNKNOWN
    got = {r.question_id: r for r in assistant.ask_batch(asked).collect()}
    for k, (_, want) in fixture.QUESTIONS.items():
        assert want.lower() in got[k].text.lower() and got[k].n_citations and not got[k].refused, (k, got[k].text)
    for k in fixture.UNKNOWN:
        assert got[k].refused and got[k].n_citations == 0
    cases = [(k, "known", q, [], [w], None, None, None, True, False) for k, (q, w) in fixture.QUESTIONS.items()] + [(k, "unknown", q, [], [], None, None, None, False, True) for k, q in fixture.UNKNOWN.items()]
    answers = spark.createDataFrame([(r.question_id, r.text, r.refused, r.n_citations, [], [], []) for r in got.values()], "question_id string, text string, refused boolean, n_citations int, top_ids array<string>, sections array<string>, pages array<int>")
    rates = {r.category: (r.n, r.n_passed) for r in evaluate.summary(evaluate.check_cases(spark.createDataFrame(cases, readers.CASES), answers)).collect()}
    assert rates == {"known": (12, 12), "unknown": (3, 3)}


def test_single_question_with_history(assistant):
    a = assistant.ask("what section is that", [{"role": "user", "content": "What are the liquidated damages for delay?"}, {"role": "assistant", "content": "..."}])
    assert "4.1" in a.text and a.citations


def test_replace_refresh_validate(spark, corpus):
    first = corpus.version()
    more = readers.gate_pages(fixture.pages(spark, "doc_u").where("page_num <= 3"))
    corpus.replace_documents(more)
    assert corpus.version() != first and {r.document_id for r in corpus.table("chunks").select("document_id").distinct().collect()} == {"doc_t", "doc_u"}
    n = corpus.table("features").count()
    assert corpus.refresh("doc_u")["features"] and corpus.table("features").count() == n
    v = corpus.validate()
    assert v["ready"] and v["counts"]["chunks"] == n and corpus.active_document() in ("doc_t", "doc_u")


def test_a_write_that_ends_early_leaves_the_old_version(spark, tmp_path):
    c = Corpus(spark, str(tmp_path))
    rows = lambda *xs: spark.createDataFrame([(x, x, "", "", "", 1, None) for x in xs], schemas.TABLES["documents"])
    seen = lambda: sorted(r.document_id for r in c.table("documents").collect())
    first = c._commit({"documents": rows("a")})
    halted = c._write({"documents": rows("a", "b")})  # a crash between writing and publishing
    (tmp_path / "_next-halted").mkdir()  # and one while publishing
    assert c.version() == first and seen() == ["a"]
    assert c._publish(halted) == c.version() and seen() == ["a", "b"]
    third = c._commit({"documents": rows("c")})
    assert c.version() == third and seen() == ["c"] and not (tmp_path / first).exists() and (tmp_path / halted).exists()


def test_streaming_ingest(spark, tmp_path):
    src = str(tmp_path / "in")
    fixture.pages(spark).write.parquet(src)
    c = Corpus(spark, str(tmp_path / "out"))
    ingest.ingest(ingest.page_stream(spark, src), c, str(tmp_path / "cp")).awaitTermination()
    assert c.table("pages").count() == 5 and c.validate()["ready"]
    spark.createDataFrame([("doc_t", 6, "5.1 Added Section\nThe Contractor shall furnish each spare feed pump rated at 5 HP.")], "document_id string, page_num int, page_text string").write.mode("append").parquet(src)
    ingest.ingest(ingest.page_stream(spark, src), c, str(tmp_path / "cp")).awaitTermination()
    assert c.table("pages").count() == 6 and c.table("chunks").where("heading = 'Added Section'").count() >= 1


@pytest.mark.parametrize(
    "question,shape,mode,attribute",
    [
        ("What is the configuration of the feed pump?", "scalar", "fact_lookup", "configuration"), ("Section 5.2", "reference_lookup", "section_lookup", None), ("Summarize the permit requirements", "broad_topic", "topic_summary", None),
        ("What are the emission guarantees?", "grouped_list", "grouped_list", None), ("How many boilers do we have", "direct_text", "direct_text", None), ("Who is responsible for permits", "responsibility", "fallback", "responsibility"),
        ("Define substantial completion", "definition", "fallback", None), ("How does the heater work", "scalar", "fallback", "function"),
    ],
)
def test_plans(question, shape, mode, attribute):
    p = planner.plan(question)
    assert (p.request_shape, p.retrieval_mode, p.attribute_label) == (shape, mode, attribute)


def test_passes():
    p = planner.plan("What is the capacity of the dew point heaters?")
    assert p.system_phrase == "dew point heater" and "dew point heaters" in p.system_aliases
    names = [n for n, _, _ in planner.search_passes(p)]
    assert names[:4] == ["exact_system_attribute", "heading_system_attribute", "exact_system_heading", "exact_system_text"] and "alias_system" in names and names[-1] == "general"
    assert planner.exact_terms("How many my feed pumps do we have?")[:2] == ["feed pumps", "feed pump"]


def test_follow_ups(spark):
    rows = [("c", 0, "user", "What is the capacity of the feed pump?"), ("c", 1, "assistant", "5"), ("c", 2, "user", "and that one"), ("d", 0, "user", "what about it")]
    got = {(r.conv_id, r.turn): (r.follow_up, r.anchor) for r in planner.follow_up_anchors(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()}
    assert got[("c", 2)] == (True, "the capacity of the feed pump") and got[("d", 0)] == (True, None) and got[("c", 0)] == (False, None)


def test_every_query_runs(spark, sf):
    for name, q in registry.QUERIES.items():
        df = q(spark, sf)
        assert len(set(df.columns)) == len(df.columns) and df.count() >= 0, name
