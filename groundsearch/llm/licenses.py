"""License scans: phrases, and license texts by template markup compiled to token automata."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundsearch.llm.common import documents, map_arrow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

#: The phrases of the contract and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: The wording of public licenses and notices, as (label, template). [[ ... ]] is optional ([[a|b]]: one of them or none), {{n}}
#: stands for any 0 to n words (names, years, addresses), everything else is mandatory. A text is a license only where all its mandatory
#: wording stands in order: the grant, the conditions and the disclaimer. A ref- label is a statement that names a license.
TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of {{6}} software and associated documentation
        files {{4}} to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
        so, subject to the following conditions: The above copyright notice and this permission notice [[(including the next paragraph)]]
        shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
        KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
        TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, [[and/or|and]] distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
        {{12}} ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
        SHALL {{12}} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
        USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
        THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: [[1.|a.]] Redistributions of source code must retain the above copyright notice, this list of conditions and
        the following disclaimer. [[2.|b.]] Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        [[[[3.|c.]] {{12}} may be used to endorse or promote products derived from this software without specific prior written
        permission.]] THIS SOFTWARE IS PROVIDED BY {{12}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{12}} BE LIABLE FOR
        ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
        THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will {{6}} be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: [[1.]] The origin of
        this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
        product, an acknowledgment in the product documentation would be appreciated but is not required. [[2.]] Altered source versions
        must be plainly marked as such, and must not be misrepresented as being the original software. [[3.]] This notice may not be
        removed or altered from any source distribution."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this {{3}} except in compliance with the
        License. You may obtain a copy of the License at {{10}} Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at"""),
    ("gpl-notice", """is free software [[: you can|; you may]] redistribute it and/or modify it under the terms of the GNU
        [[Lesser|Affero|Library]] General Public License as published by the Free Software Foundation [[, either|;]] version {{3}} of the
        License [[, or (at your option) any later version]]"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means."""),
    ("boost-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit
        the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do
        so, all subject to the following"""),
    ("ref-mit", "[[released|licensed|distributed|available]] under the [[terms of the]] MIT License"),
    ("ref-bsd", "[[released|licensed|distributed|available]] under the [[2 clause|3 clause|new|simplified]] BSD License"),
    ("ref-apache", "[[released|licensed|distributed|available]] under the [[terms of the]] Apache License [[, Version 2.0]]"),
    ("ref-boost", "Distributed under the Boost Software License, Version 1.0."),
    ("ref-gpl", "licensed under the [[terms of the]] GNU [[Lesser|Affero|Library]] General Public License [[version 2|version 3]]"),
    ("ref-cc-by-nc", "[[licensed|released|distributed]] under [[a|the]] CC BY NC [[4.0|3.0|2.5|2.0]]"),
    ("ref-cc", """[[is|are]] licensed under [[a|the]] Creative Commons Attribution {{4}} [[International|Unported|Generic]] License"""),
)


def words_of(text: str) -> list[str]:
    """The words of a text, A-Z lower-cased."""
    return WORD.findall(text.translate(_LOWER))


class Automaton:
    """A template as a nondeterministic automaton over words.

    States are numbered; `step` has for each state the words that lead on, `skip` the moves that take no word, `any` the moves by any word.
    """

    def __init__(self, template: str):
        self.step, self.skip, self.any, self.n = {}, {}, {}, 1
        self.mandatory: list[list[str]] = [[]]
        end = self._sequence(re.findall(r"\[\[|\]\]|\||\{\{\d+\}\}|[^\[\]|{}]+", template), 0, 0)
        self.final = end
        self.anchor = max((" ".join(r) for r in self.mandatory if r), key=len)
        self._closure = {}

    def _state(self) -> int:
        self.n += 1
        return self.n - 1

    def _sequence(self, parts: list[str], at: int, depth: int) -> int:
        while parts:
            part = parts.pop(0)
            if part == "[[":
                self.mandatory.append([])
                ends, start = [], at
                while True:
                    ends.append(self._sequence(parts, start, depth + 1))
                    if parts.pop(0) != "|":
                        break
                at = self._state()
                for e in [*ends, start]:
                    self.skip.setdefault(e, []).append(at)
                self.mandatory.append([])
            elif part in ("]]", "|"):
                parts.insert(0, part)
                return at
            elif part.startswith("{{"):
                self.mandatory.append([])
                first = at
                out = self._state()
                self.skip.setdefault(first, []).append(out)
                for _ in range(int(part[2:-2])):
                    nxt = self._state()
                    self.any.setdefault(first, []).append(nxt)
                    self.skip.setdefault(nxt, []).append(out)
                    first = nxt
                at = out
            else:
                for w in words_of(part):
                    nxt = self._state()
                    self.step.setdefault(at, {}).setdefault(w, []).append(nxt)
                    if not depth:
                        self.mandatory[-1].append(w)
                    at = nxt
        return at

    def closure(self, states: frozenset) -> frozenset:
        found = self._closure.get(states)
        if found is None:
            seen, todo = set(states), list(states)
            while todo:
                for x in self.skip.get(todo.pop(), ()):
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            found = self._closure[states] = frozenset(seen)
        return found

    def spans(self, words: list[str]) -> list[tuple[int, int]]:
        """Places (first word, word after the last) where the template matches: from each start the longest match, none within another.

        Every start is tried whose first word can begin the template; all live starts run together, one pass over the words. At most as
        many starts live as the longest match has words.
        """
        live: dict[frozenset, int] = {}  # states -> earliest start
        begin = self.closure(frozenset([0]))
        found: dict[int, int] = {}
        firsts = {w for s in begin for w in self.step.get(s, ())}
        wild = any(s in self.any for s in begin)
        for k, w in enumerate(words):
            if wild or w in firsts:
                live.setdefault(begin, k)
            if not live:
                continue
            moved: dict[frozenset, int] = {}
            for states, start in live.items():
                to = {x for s in states for x in (*self.step.get(s, {}).get(w, ()), *self.any.get(s, ()))}
                if to:
                    to = self.closure(frozenset(to))
                    moved[to] = min(start, moved.get(to, start))
                    if self.final in to:
                        found[start] = k + 1
            live = moved
        out: list[tuple[int, int]] = []
        for start, end in sorted(found.items()):
            if not out or start >= out[-1][1]:
                out.append((start, end))
        return out


_COMPILED: dict[str, Automaton] = {}


def automata(templates=TEMPLATES) -> list[tuple[str, Automaton]]:
    for _, template in templates:
        if template not in _COMPILED:
            _COMPILED[template] = Automaton(template)
    return [(label, _COMPILED[template]) for label, template in templates]


def scan(text: str | None, templates=TEMPLATES) -> dict:
    """Words, phrase places, labels, matched license spans (label, first word, word after the last) and score of one whole text."""
    low = (text or "").translate(_LOWER)
    words = WORD.findall(low)
    padded = f" {' '.join(words)} "
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        needle, at, seen, last = f" {phrase} ", padded.find(f" {phrase} "), 0, 0
        while at >= 0:
            seen += padded.count(" ", last, at)
            last = at
            starts.append(seen)
            labels.add(label)
            at = padded.find(needle, at + 1)
    base, spans = sorted(labels), []
    for name, a in automata(templates):
        if f" {a.anchor} " in padded:  # the longest mandatory run of words; without it there is no match
            spans += [(name, s, e) for s, e in a.spans(words)]
    labels |= {s[0] for s in spans}
    score = 1.0 if spans else 1 - 0.5 ** len(starts)
    return {
        "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(base),
        "labels": ",".join(sorted(labels)), "score": score, "spans": sorted(spans, key=lambda s: (s[1], s[2], s[0])),
    }


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id and the scan of every row's whole text (doc_id, text, any others): no shuffle, one row each; a null text is an empty one.

    score is 1 where a template matches, else 1 - 2^-n for n phrase places. spans are (label, first word, word after the last). Repeated rows
    give one row each, ties of places can't arise, other columns play no part, and an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan(t, templates) for t in batch.column("text").to_pylist()]
        cols = {k: [r[k] for r in rows] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        arrays = [batch.column("doc_id"), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items())]
        arrays.append(pa.array([[{"label": a, "start": b, "stop": c} for a, b, c in r["spans"]] for r in rows], span))
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", *cols, "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,stop:long>>"
    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, schema)


def op10_licenses(spark, sf_dir):
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of all documents."""
    return scan_licenses(documents(spark, sf_dir)).drop("spans")


def _pattern(template: str) -> str:
    """The template as a regular expression over words that each end in a space."""
    out = []
    for part in re.findall(r"\[\[|\]\]|\||\{\{\d+\}\}|[^\[\]|{}]+", template):
        if part.startswith("{{"):
            out.append("(?:[^ ]+ ){0,%s}" % part[2:-2])
        else:
            out.append({"[[": "(?:", "]]": ")?", "|": "|"}.get(part) or "".join(w + " " for w in words_of(part)))
    return " " + "".join(out)


def op10_sql(templates=TEMPLATES) -> str:
    place = {p: " AND ".join(f"w[i + {k}] = '{w}'" for k, w in enumerate(p.split())) for p in PHRASES}
    at = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: {c})" for c in place.values())
    base = ", ".join(f"CASE WHEN contains(p, ' {p} ') THEN '{label}' END" for p, label in PHRASES.items())
    more = ", ".join(f"CASE WHEN regexp_matches(p, '{_pattern(t)}') THEN '{label}' END" for label, t in templates)
    names = lambda x: f"array_to_string(list_sort(list_distinct(list_filter({x}, lambda l: l IS NOT NULL))), ',')"
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS p, list_sort(flatten([{at}])) AS s FROM t),
l AS (SELECT *, [{base}] AS b, [{more}] AS m FROM p)
SELECT doc_id, len(w)::BIGINT AS n_words, len(s)::BIGINT AS n_base, s[1] - 1 AS first_word, s[len(s)] - 1 AS last_word,
  {names('b')} AS base_labels, {names('list_concat(b, m)')} AS labels,
  CASE WHEN len(list_filter(m, lambda l: l IS NOT NULL)) > 0 THEN 1.0 ELSE 1 - pow(0.5, len(s)) END AS score
FROM l
"""
