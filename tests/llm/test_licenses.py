import re

import duckdb
import pytest

from groundsearch.llm import licenses as L

MIT = """Copyright (c) 2020 Jane Doe. PERMISSION is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. More."""


def test_all_mandatory_wording_must_match():
    got = L.scan(MIT)
    assert got["labels"] == "mit" and got["score"] == 1
    (span,) = got["spans"]
    words = L.words_of(MIT)
    assert words[span[1]] == "permission" and words[span[2] - 1] == "software" and words[span[2]] == "more"
    assert L.scan(MIT.replace("without limitation", "without any limitation"))["labels"] == ""
    assert L.scan(MIT.replace("this software", "one two three four five six seven software"))["labels"] == ""
    assert L.scan(MIT.split("\n\n")[0])["labels"] == "" == L.scan(" ".join(MIT.split("\n\n")[:2]))["labels"]  # without the disclaimer


BSD = dict(L.TEMPLATES)["bsd"]


@pytest.mark.parametrize("clauses", [2, 3])
def test_optional_clause(clauses):
    """Both texts of the license come from the one template, as does one with a holder's name; a changed condition is none."""
    third = "3. Neither the name of the holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    text = re.sub(r"\[\[\[\[.*?permission\.\]\]", third if clauses == 3 else "", BSD, flags=re.S)
    text = re.sub(r"\[\[|\]\]|\|\w", "", re.sub(r"\{\{\d+\}\}", "THE ACME CORPORATION", text))
    assert L.scan(text)["labels"] == "bsd"
    assert L.scan(text.replace("must reproduce", "may reproduce"))["labels"] == ""


def test_phrases():
    got = L.scan("CC-BY cc by by cc by. All Rights Reserved general public license")
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (13, 5, 0, 10)
    assert got["base_labels"] == "cc-by,gpl,reserved"
    assert L.scan("all rights reserved all rights reserved")["n_base"] == 2
    for empty in (None, "", " .!"):
        got = L.scan(empty)
        assert (got["n_words"], got["n_base"], got["first_word"], got["labels"], got["score"]) == (0, 0, None, "", 0)


@pytest.mark.parametrize("label,template", L.TEMPLATES)
def test_automaton_agrees_with_regular_expression(label, template):
    a, pattern = L.Automaton(template), re.compile(L._pattern(template))
    full = L.words_of(re.sub(r"\[\[|\]\]|\{\{\d+\}\}", " ", re.sub(r"\|[^\[\]]*", "", template)))
    bare, depth = [], 0
    for part in re.findall(r"\[\[|\]\]|[^\[\]]+", template):
        depth += {"[[": 1, "]]": -1}.get(part, 0)
        if not depth and part not in ("[[", "]]"):
            bare += L.words_of(re.sub(r"\{\{\d+\}\}", " ", part))
    for words in (full, bare, ["x", *bare, "y"], bare[:-1], bare[1:], [*bare[: len(bare) // 2], "other", *bare[len(bare) // 2 :]], bare + bare):
        got = a.spans(words)
        m = pattern.search(f" {' '.join(words)} ")
        assert bool(got) == bool(m), words
        if m:
            assert got[0][0] == f" {' '.join(words)} "[: m.start() + 1].count(" ") - 1


def test_operator_rows(spark):
    rows = [(1, None, 0), (1, "", 0), (None, "Released under the MIT License.", 1), (2, "w " * 30000 + "cc by", 1), (2, "all rights reserved", 1), (2, "all rights reserved", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = L.scan_licenses(df).collect()
    assert len(got) == 6 and sorted(r.labels for r in got) == ["", "", "cc-by", "ref-mit", "reserved", "reserved"]
    assert L.scan_licenses(df.limit(0)).count() == 0


def test_query_matches_sql(spark, sf):
    df = L.op10_licenses(spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want, cols = con.sql(L.op10_sql()), sorted(df.columns)
    assert cols == sorted(want.columns)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted(want.select(*cols).fetchall(), key=str)
