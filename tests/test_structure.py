from pyspark.sql import functions as F

from groundsearch.operators import corpus as C
from groundsearch.operators import facts as X
from groundsearch.operators import recall as R
from groundsearch.operators import segment as S
from groundsearch.sources import readers


def chunk_rows(spark, *pages):
    df = spark.createDataFrame([("d", n, t) for n, t in pages], "document_id string, page_num int, page_text string")
    return S.chunks(df).orderBy("ordinal_in_document").collect()


def test_sections_parents_pages(spark):
    got = chunk_rows(spark, (1, "cover\nARTICLE 5\n \nScope\n5.1 Pumps\nbody one\n14.457 psia"), (3, "5.1.2\nSeals\nbody two\nEXHIBIT A: Lists\n6.1 Other\nsee \"Plant\" means the whole plant and its equipment."))
    base = [(c.chunk_type, c.section_number, c.heading, c.page_start, c.page_end) for c in got if c.chunk_type not in ("definition", "line_item_group")]
    assert base == [
        ("section", None, "Front Matter", 1, 1), ("article", "5", "Scope", 1, 1), ("subsection", "5.1", "Pumps", 1, 2), ("subsection", "5.1.2", "Seals", 3, 3), ("exhibit", "A", "Lists", 3, 3),
        ("subsection", "6.1", "Other", 3, 3),
    ]
    by = {c.section_number: c for c in got if c.chunk_type != "definition"}
    assert by["5.1"].parent_chunk_id == by["5"].chunk_id and by["5.1.2"].parent_chunk_id == by["5.1"].chunk_id and by["6.1"].parent_chunk_id == by["A"].chunk_id
    assert by["5.1"].full_text == "5.1 Pumps\nbody one\n14.457 psia" and by["5.1.2"].full_text == "5.1.2\nbody two"
    (d,) = [c for c in got if c.chunk_type == "definition"]
    assert d.heading == "Plant" and d.full_text.endswith("equipment.") and d.parent_chunk_id == by["6.1"].chunk_id
    assert [c.ordinal_in_document for c in got] == list(range(1, len(got) + 1))


def test_a_taken_line_begins_nothing(spark):
    got = chunk_rows(spark, (1, "1.1\n2.2 Real heading\nbody\n3.1\n4.1\n5.1 Third title\nend"))
    assert [(c.section_number, c.heading) for c in got if c.chunk_type == "subsection"] == [("1.1", "2.2 Real heading"), ("3.1", "5.1 Third title")]
    assert [c.full_text for c in got if c.chunk_type == "subsection"] == ["1.1\nbody", "3.1\nend"]


def test_bullets_tables_groups(spark):
    assert [S.group_sizes(n, 3) for n in range(8)] == [[], [], [2], [3], [2, 2], [3, 2], [3, 3], [3, 2, 2]]
    assert [S.group_sizes(n, 2) for n in range(7)] == [[], [], [2], [3], [2, 2], [2, 3], [2, 2, 2]]
    got = chunk_rows(spark, (1, "1.1 List\nThe following parts shall be delivered by the Contractor to the site of the plant before startup.\n- one part\nmore of one\n- two parts\n- three parts\n1.2 Table\nParameter\nRated flow\n450 gpm\nPressure drop\n300 psig"))
    kinds = [(c.chunk_type, c.heading, c.full_text) for c in got if c.chunk_type in ("bullet_group", "schedule_block")]
    assert kinds[0] == ("bullet_group", "List - Bullets: one part", "- one part\nmore of one\n- two parts\n- three parts")
    assert kinds[1] == ("schedule_block", "Table - Schedule: Rated flow", "Parameter\nRated flow\n450 gpm\nPressure drop\n300 psig")


def test_empty_pages(spark):
    df = spark.createDataFrame([("d", 1, ""), ("d", 2, None), ("e", 1, " \n ")], "document_id string, page_num int, page_text string")
    assert S.chunks(df).count() == 0
    assert {r.ocr_used for r in readers.gate_pages(df).collect()} == {True}


def test_fact_patterns():
    f = {(s, a, v) for s, a, v, _ in X.chunk_facts("Feed Pump", "Configuration: 2 x 50%\nCirculating Water Pump | Capacity | 900 gpm\nThe main lube oil pump shall be rated at 40 HP.\nFuel heater | FG2200")}
    assert ("feed pump", "configuration", "2 x 50%") in f and ("circulating water pump", "capacity", "900 gpm") in f and ("fuel heater", "model", "FG2200") in f
    assert any(s.endswith("lube oil pump") and a == "rating" and v == "40 HP" for s, a, v in f)


def test_fact_gate(spark):
    schema = "question_id string, score double, system_names array<string>, " + "fact_seq long, document_id string, system string, system_normalized string, attribute string, attribute_normalized string, value string, evidence_text string, source_chunk_id string, page_start int, page_end int"
    row = lambda q, score, s, v, n=1: (q, score, ["a pump"], n, "d", s, s, "flow", "flow", v, "e", "c", 1, 1)
    rows = [row("one", 2.5, "a pump", "5 gpm"), row("one", 2.5, "a pump", "5  GPM", 2), row("two", 2.5, "a pump", "5"), row("two", 2.5, "a pump", "6"), row("low", 1.3, "a pump", "5"), row("none", 0.0, "a pump", "5")]
    got = {r.question_id: r.reason for r in X.fact_hits(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"one": None, "two": "conflicting_fact_values", "low": "low_confidence_fact_match"}
    facts = spark.createDataFrame([rows[0][3:], rows[0][3:]], schema.split(", ", 3)[3])
    assert X.insert_ignore(facts, facts).count() == 1


def test_citation_coverage_and_interleave(spark):
    df = spark.createDataFrame([([(1, 3), (2, 2), (3, 5), (5, 5)],)], "cs array<struct<first:int,last:int>>")
    assert [tuple(c) for c in df.select(R.covering_citations(F.col("cs"))).first()[0]] == [(1, 3), (3, 5)]
    b = spark.createDataFrame([("q", 1, 0, "a"), ("q", 1, 1, "b"), ("q", 2, 0, "b"), ("q", 2, 1, "c"), ("q", 1, 2, "d")], "question_id string, bundle_rank int, depth int, chunk_id string")
    assert [r.chunk_id for r in R.interleave(b, 3).orderBy("position").collect()] == ["a", "b", "c"]


def test_json_cases(spark, tmp_path):
    p = tmp_path / "cases.json"
    p.write_text('[{"name": "n", "category": "c", "question": "q"}]')
    r = readers.read_cases(spark, str(p)).first()
    assert r.expected_top_chunk_ids == [] and r.require_citations is False
    (tmp_path / "c.json").write_text('[{"chunk_id": "1", "section_number": "1", "heading": "h", "full_text": "t", "page_start": 4}]')
    c = readers.read_chunks_json(spark, str(tmp_path / "c.json")).first()
    assert (c.page_end, c.ordinal_in_document, c.chunk_type) == (4, 4, "section")
    (tmp_path / "a.txt").write_text("one\ftwo")
    assert [r.page_text for r in readers.read_text_documents(spark, str(tmp_path / "a.txt")).orderBy("page_num").collect()] == ["one", "two"]
    files, pages = readers.read_binary_documents(spark, str(tmp_path / "a.txt"), lambda b: b.decode().split("\f"))
    assert pages.count() == 2 and len(files.first().sha256) == 64


def test_joins(spark):
    c = spark.createDataFrame([("r", "d", "exhibit", 1, 1, 2, None), ("s", "d", "section", 2, 9, 17, "r"), ("t", "d", "section", 3, 18, 18, "s")], "chunk_id string, document_id string, chunk_type string, ordinal_in_document int, page_start int, page_end int, parent_chunk_id string")
    assert {(r.chunk_id, r.exhibit_id) for r in C.exhibits_of(c).collect()} == {("r", "r"), ("s", "r"), ("t", "r")}
    spans = spark.createDataFrame([("k", "d", 2, 17)], "key string, document_id string, first int, last int")
    assert [r.chunk_id for r in C.page_overlap(c, spans, 5).orderBy("rank").collect()] == ["r", "s"]
    label = C.attachment_label(F.lit("APPENDIX b-2 list"), F.lit("x"))
    assert spark.range(1).select(label).first()[0] == "Appendix b-2"
