import test_engine
from corpus_fixture import QUESTIONS

from groundsearch.operators import answer as A
from groundsearch.operators import planner
from groundsearch.operators.answer import Assistant

corpus, assistant = test_engine.corpus, test_engine.assistant


def row(chunk_id, text, rank=1, depth=0, score=0.9, bundle=5.0, confidence=0.9, heading="Heat Trace Panel", section="3.9", page=7):
    return {"chunk_id": chunk_id, "document_id": "d", "section_number": section, "heading": heading, "full_text": text, "page_start": page, "page_end": page, "bundle_rank": rank, "depth": depth, "score": score, "bundle_score": bundle, "confidence": confidence, "ordinal_in_document": depth}


TABLE = "3.9\nHeat Trace Panel\nCharacteristic\nSpecification\nLocation\nOutdoor\nAmbient range\n-10 to 104 degF\nSupply\n480 V\nEnclosure\nNEMA 4X\nA long remark on the cells that stand above in this table\n• see also the notes\nIgnored\n5"


def test_table_entries():
    got = A.table_entries(TABLE, "3.9", "Heat Trace Panel")
    assert got == [("Location", "Outdoor"), ("Ambient range", "-10 to 104 degF"), ("Supply", "480 V"), ("Enclosure", "NEMA 4X")]
    assert A.table_entries("") == [] and A.table_entries("one line") == [] and A.table_entries("• a\n• b") == []


def test_design_conditions_answer():
    p = planner.plan("What are the heat trace panel design conditions?")
    assert p.attribute_label == "design_conditions"
    a = A.answer(p, [row("c1", TABLE.replace("Heat Trace Panel", "Heat Trace Panel Design Conditions"), heading="Heat Trace Panel Design Conditions")], [])
    assert a.mode == "design_conditions" and "- Supply: 480 V" in a.text and "Section 3.9" in a.text and a.citations[0].chunk_id == "c1"
    short = A.answer(p, [row("c1", "Heat Trace Panel design conditions\nSupply\n480 V")], [])
    assert short.mode != "design_conditions"


def test_requirement_order():
    p = planner.plan("what are the heat trace panel requirements")
    assert A.asks_requirement(p)
    weak, strong = row("w", "The heat trace panel is a basis for design of other parts.", 1), row("s", "The heat trace panel shall provide 20 % spare circuits, consisting of breakers.", 2)
    assert [r["chunk_id"] for r in A.requirement_order(p, [weak, strong])] == ["s", "w"]
    assert [r["chunk_id"] for r in A.requirement_order(p, [row("w", strong["full_text"], 1), strong])] == ["w", "s"]  # a tie changes nothing
    plain = planner.plan("Where is the heat trace panel")
    assert A.requirement_order(plain, [weak, strong]) == [weak, strong] and A.requirement_order(p, []) == []


def test_a_chooser_settles_close_bundles_only():
    close = [row("a", "first text", 1, bundle=5.0), row("b", "second text", 2, bundle=4.9), row("c", "third text", 3, bundle=4.0), row("d", "fourth text", 4, bundle=3.0)]
    seen = []

    def choose(question, texts):
        seen.append(texts)
        return 1

    assert [r["chunk_id"] for r in A.chosen_first("q", close, choose)] == ["b", "a", "c", "d"] and len(seen[0]) == 3
    assert A.chosen_first("q", [close[0], row("b", "x", 2, bundle=1.0)], choose) == [close[0], row("b", "x", 2, bundle=1.0)] and len(seen) == 1
    for bad in (lambda q, t: None, lambda q, t: 7, lambda q, t: -1, lambda q, t: "b", lambda q, t: int("x")):
        assert A.chosen_first("q", close, bad) == close
    assert A.chosen_first("q", close, None) == close


def test_contexts():
    p = planner.plan("Summarize the permit requirements")
    text = "The weather was fine. The permit requirements of the authority apply. Lunch is at noon."
    assert A.compressed(p, text) == "The permit requirements of the authority apply."
    assert A.compressed(p, "Nothing here. Nor here.") == "Nothing here. Nor here."
    rows = [row(str(k), text, k + 1, page=k) for k in range(8)]
    page = lambda k: {"document_id": "d", "page_num": k, "page_text": "word " * 400}
    plain = A.prompt_context(p, rows, [page(1)], [page(2)])
    assert plain.count("[Section 3.9") == A.SUMMARY_PARTS and "[Page" not in plain and "weather" not in plain
    deep = A.prompt_context(p, rows, [page(1), page(2), page(3)], [page(2), page(4), page(5), page(6), page(7)], deep=True)
    assert deep.count("[Section 3.9") == A.DEEP_PARTS and [f"[Page {k}]" in deep for k in range(1, 8)] == [True, True, False, True, True, True, False]
    assert max(len(b) for b in deep.split("\n\n") if b.startswith("[Page")) <= A.WINDOW + len("[Page 1]\n")
    assert A.prompt_context(p, rows, [], [page(4)], previous="Earlier words.").startswith("Previous answer:\nEarlier words.\n\nEvidence:\n[Section")


def test_widened_answers(assistant):
    vocabulary_free = Assistant(assistant.retriever, None, lambda q, context: context)
    question = QUESTIONS["late"][0]
    short = assistant.ask(question)
    wide = vocabulary_free.ask(question, expand_answer=True, previous_answer=short.text)
    assert wide.mode == "generated" and wide.text.startswith("Previous answer:\n") and "[Page 5]" in wide.text and wide.citations
    last = vocabulary_free.ask(question, [{"role": "user", "content": question}, {"role": "assistant", "content": "Turn before."}], expand_answer=True)
    assert "Turn before." in last.text
    without = assistant.ask(question, expand_answer=True, previous_answer=short.text)
    assert not without.refused and len(without.text) >= len(short.text)
