"""Answers from evidence: extractive, with citations, or a refusal. Works on one question's evidence, which is a few dozen rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundsearch.functions import lexicons as L
from groundsearch.functions import text as T
from groundsearch.operators import planner
from groundsearch.operators.facts import VALUES, fact_hits, fact_scores
from groundsearch.operators.planner import Plan
from groundsearch.operators.recall import Retriever, low_content_py
from groundsearch.operators.segment import has_value, is_table_header
from groundsearch.sources.scratch import stored

# fixed values: limits, and the patterns of values and of evidence
EXCERPT, DEEP_EXCERPT, PAGE_EXCERPT, QUOTE = 650, 900, 700, 340
_UNIT = r"(?:gpm|lb/hr|scfm|cfm|acfm|mmscfd|mw|kw|hp|tph|tpd|bpd|mbh|mmbtu/hr|kg/hr|lbm/hr|ft3/min|m3/hr|gal/min|gpd|%)"
_RATED = r"(\d+(?:\.\d+)?\s*(?:kv|v|volts?|a|amps?|ka|kva|mva|mw|kw|hp|psi|psig|psia|inch(?:es)?|mm|ft|%))\b"
_COUNT = r"(?:one|two|three|four|five|six|seven|eight|nine|ten|\(?\d+\)?)"
_DUTY = r"(?:standby|continuous|intermittent|lead/lag|lead-lag|lead lag|duplex|simplex|primary|backup|spare)"
TYPED = {
    "configuration": (r"(?i)\b(\d+\s*x\s*\d+(?:\.\d+)?\s*%)", rf"(?i)\b({_DUTY}\s+(?:configuration|arrangement))\b"),
    "capacity": (r"(?i)\b(\d+(?:\.\d+)?\s*%\s*capacity)\b", rf"(?i)\bcapacity\W+(?:of|is|shall be|=)?\s*(\d+(?:\.\d+)?\s*{_UNIT})", rf"(?i)\brated\s+at\s+(\d+(?:\.\d+)?\s*{_UNIT})"),
    "type": (r"\bmodel(?:\s+\w+){0,3}\s+(?:shall be|is|:)?\s*([A-Z]{2,}[A-Z0-9\-]*\d[A-Z0-9\-]*)\b", r"\b([A-Z]{2,}[A-Z0-9\-]*\d[A-Z0-9\-]*)\b"),
    "size": (rf"(?i)\b(?:size|rating|diameter)(?:\s+of|\s+is|:)?\s*{_RATED}", rf"(?i)\brated\s+at\s+{_RATED}"),
    "power": (rf"(?i)\b(?:rated\s+(?:at|for)|power(?:\s+of|\s+is|:)?)\s*{_RATED}", r"(?i)\b(\d+(?:\.\d+)?\s*(?:hp|kw|mw))\b"),
    "service": (rf"(?i)\b(?:duty|service)(?:\s+of|\s+is|:)?\s*({_DUTY}[A-Za-z0-9 /&()%-]*)\b", rf"(?i)\b({_DUTY}\s+(?:duty|service))\b", r"(?i)\bfor\s+([^.;\n]{1,60}?)\s+service\b"),
    "pressure": (f"({VALUES['pressure'][4:]})",), "temperature": (f"({VALUES['temperature'][4:]})",), "flow": (f"({VALUES['flow'][4:]})",),
    "quantity": (rf"(?i)\b({_COUNT}(?:\s*x\s*\d+%\s*(?:capacity)?|\s+\d+%\s+capacity)?)\b",),
}
DUTIES = r"(?i)\b(?:shall|must|responsible|required|provide|furnish|supply|perform|deliver|submit)\b"
LIMITS = r"(?i)\b(?:guarantee[sd]?|shall not exceed|not exceed|limits?)\b"
DEFINES = r"(?i)\bmeans\b|\bdefined as\b|\bdefinition\b"
TABLE_HEADS, TABLE_WORDS = ("characteristic", "specification"), ("yes", "no", "indoor", "outdoor", "inside", "outside", "n/a", "na")
BULLETS, TABLE_LEAST, TABLE_MOST = ("\u2022", "\uf0b7"), 4, 8
REQUIREMENT_WORDS = ("required", "requirement", "shall", "must", "responsible", "obligation")
# weights of what makes an excerpt answer a requirement question, each counted once
REQUIREMENT_WEIGHTS = (
    (1.2, r"\b(?:shall|must|required|responsible|obligated|provide|perform|submit|deliver|maintain|comply)\b"),
    (1.0, r"\b\d+(?:\.\d+)?\s*%"),
    (1.2, r"\bmixture of\b|\bconsist(?:s|ing)? of\b|\bcomprised of\b"),
    (-1.0, r"\bbasis for design\b|\bdesigned to provide\b|\bmeet the needs of\b"),
)
REQUIREMENT_SYSTEM, REQUIREMENT_CONCEPT, REQUIREMENT_NUMBER, REQUIREMENT_SHORT, REQUIREMENT_MARGIN = 1.4, 0.8, 0.35, (0.35, 220), 1.0
# when a chooser is asked: the first bundle's lead over the second, or its confidence, is below these; it sees this many
CHOOSE_GAP, CHOOSE_CONFIDENCE, CHOOSE_FROM = 0.35, 0.62, 3
# of a generator's context: sections of a summary, of a deep answer, page hits, page windows and their length
SUMMARY_PARTS, DEEP_PARTS, DEEP_HITS, DEEP_WINDOWS, WINDOW = 5, 6, 2, 3, 500


@dataclass
class Citation:
    chunk_id: str
    section_number: str | None
    heading: str
    page_start: int
    page_end: int
    quote: str
    attachment: str | None = None


@dataclass
class Answer:
    text: str
    citations: list[Citation] = field(default_factory=list)
    refused: bool = False
    mode: str = "extractive"


def refusal() -> Answer:
    return Answer(L.REFUSAL, [], True, "refusal")


def pages_of(a: int, b: int) -> str:
    return str(a) if a == b else f"{a}-{b}"


def cite(row: dict) -> Citation:
    return Citation(row["chunk_id"], row.get("section_number"), row["heading"], row["page_start"], row["page_end"], T.short_py(row.get("full_text") or "", QUOTE), row.get("attachment"))


def citations(rows: list[dict], most: int = 5) -> list[Citation]:
    """Citations of the rows in order, without those whose pages earlier ones cover."""
    out, seen = [], set()
    for r in rows:
        pages = set(range(r["page_start"], max(r["page_start"], r["page_end"]) + 1))
        if pages - seen and len(out) < most:
            seen |= pages
            out.append(cite(r))
    return out


# --- values -----------------------------------------------------------------------------------------------------------------------
def typed_value(text: str, kind: str) -> str | None:
    """The value of a kind in a text, by the first pattern that finds one."""
    one = " ".join(text.split())
    return next((T.exact_value_py(m[1]) for p in TYPED.get(kind, ()) if (m := re.search(p if kind not in ("pressure", "temperature", "flow") else f"(?i){p}", one))), None)


def labelled_value(lines: list[str], terms: tuple[str, ...], system: str = "") -> str | None:
    """The value of a row `label: value`, `label | value` or of the line after a label."""
    wanted = {T.norm_py(t) for t in terms}

    def is_label(x: str) -> bool:
        x = T.norm_py(x).strip(" :")
        return x in wanted or any(x.endswith(f" {t}") and (not system or system in x) for t in wanted)

    for k, line in enumerate(lines):
        cells = [c.strip() for c in re.split(r"\s*\|\s*", line) if c.strip()]
        for i, c in enumerate(cells[:-1]):
            if is_label(c):
                return T.exact_value_py(cells[i + 1])
        label, _, value = line.partition(":")
        if value.strip() and is_label(label):
            return T.exact_value_py(value)
        if is_label(line) and k + 1 < len(lines) and has_value(lines[k + 1]) and not is_table_header(lines[k + 1]):
            return T.exact_value_py(lines[k + 1])
    return None


def count_value(question: str, texts: list[str]) -> str | None:
    """How many of the things asked for: a stated count, else the different numbers that such things have."""
    item = re.sub(planner.EXACT_TAILS, "", T.norm_py(question).removeprefix("how many ").strip(" ?.")).strip()
    if not item:
        return None
    names = [re.escape(n) for n in dict.fromkeys((item, item[:-1] if item.endswith("s") and len(item) > 4 else item))]
    shapes = (r"((?:\w+\s+)?\(?\d+\)?\s*x\s*\d+%[^.]*?{n})", rf"({_COUNT}" + r"[^.]*?{n})", r"({n}[^.]*?\(?\d+\)?\s*x\s*\d+%)")
    for text in texts:
        one = " ".join(text.split())
        for shape in shapes:
            for n in names:
                if m := re.search("(?i)" + (r"\b" if shape[1] != "{" else "") + shape.replace("{n}", n), one):
                    return " ".join(m[1].split())
    numbers = {x for text in texts for x in re.findall(rf"(?i){names[-1]}\s+(\d+)", text)}
    return str(len(numbers)) if numbers else None


def excerpt_around(text: str, needle: str, limit: int = PAGE_EXCERPT) -> str:
    one = " ".join(text.split())
    at = one.lower().find(needle.lower())
    first = max(0, at - limit // 3) if at >= 0 else 0
    cut = one[first : first + limit]
    return ("..." if first else "") + cut + ("..." if first + limit < len(one) else "")


# --- evidence ---------------------------------------------------------------------------------------------------------------------
def sentence_score(p: Plan, sentence: str) -> float:
    has = T.has_phrase_py
    low = re.sub(r"[^\w%./-]+", " ", sentence.lower())
    s = 1.1 * bool(p.system_phrase and has(low, p.system_phrase)) + 0.3 * T.hit_count_py(sentence, p.system_significant_terms) + 0.9 * has(low, *p.attribute_terms)
    s += 0.35 * T.hit_count_py(sentence, p.concept_terms) + 0.2 * T.hit_count_py(sentence, p.focus_terms)
    if p.attribute_label and typed_value(sentence, p.attribute_label):
        s += 0.9
    if p.intent == "responsibility" and re.search(DUTIES, sentence) or p.intent == "definition" and re.search(DEFINES, sentence) or p.answer_family and re.search(LIMITS, sentence):
        s += 0.8
    return s


def best_excerpt(p: Plan, text: str, limit: int) -> str:
    """The sentence that says most about the question, with its neighbours as far as the limit goes."""
    parts = T.sentences_py(text) or [text]
    scores = [sentence_score(p, s) for s in parts]
    k = max(range(len(parts)), key=lambda i: (scores[i], -i))
    first = last = k
    while True:
        wider = [(first - 1, last), (first, last + 1)]
        fits = [(a, b) for a, b in wider if a >= 0 and b < len(parts) and b - a <= 4 and len(" ".join(parts[a : b + 1])) <= limit]
        if not fits:
            break
        first, last = max(fits, key=lambda ab: (scores[ab[0]] if ab[0] < first else scores[ab[1]], ab[1]))
    return T.short_py(" ".join(parts[first : last + 1]), limit)


def matches(p: Plan, row: dict) -> bool:
    """Whether a chunk speaks of what is asked strongly enough to answer from."""
    value = bool(p.attribute_label in L.EXACT_VALUE_ATTRIBUTES or p.count_question)
    least = 0.56 if p.attribute_label or p.count_question else 0.5 if p.request_shape == "grouped_list" else 0.48 if p.direct_text_question or p.system_phrase else 0.42
    text = " ".join(filter(None, (row["heading"], row.get("parent_heading"), row["full_text"])))
    low, clean = text.lower(), re.sub(r"[^\w%./\-]+", " ", text.lower()).replace(". ", " ")
    n = lambda terms: sum(T.has_phrase_py(clean, t) or t in low for t in terms)
    if row["score"] < least:
        return False
    if p.direct_text_question and n(p.focus_terms) < min(2, len(p.focus_terms)) or p.request_shape == "grouped_list" and n(p.concept_terms) < max(1, min(len(p.concept_terms), 2)):
        return False
    named = len(p.system_significant_terms) if p.attribute_label in L.EXACT_VALUE_ATTRIBUTES else (len(p.system_significant_terms) + 1) // 2
    if p.system_phrase and p.system_phrase not in low and n(p.system_significant_terms) + n(p.expansion_terms) * (not value) < named:
        return False
    if p.attribute_label and not n(p.attribute_terms) and not typed_value(text, p.attribute_label):
        return False
    if p.scope_terms and not n(p.scope_terms) or p.intent == "definition" and not re.search(DEFINES, text) or p.intent == "responsibility" and not re.search(DUTIES, text):
        return False
    asked = [t for t in p.focus_terms if t not in ("who", "happens", "can")]
    if not value and asked and not p.section_number:
        return n(asked) + n(p.expansion_terms) * (n(asked) > 0) >= max(1, (len(asked) + 1) // 2)
    return True


def useful(row: dict) -> bool:
    return len(row["full_text"] or "") >= 35 and not low_content_py(row["full_text"] or "", row.get("section_number"))


def table_entries(text: str, section: str | None = None, heading: str = "") -> list[tuple[str, str]]:
    """The (label, value) rows of a table whose cells stand line by line; it ends where a bullet takes a value's place."""
    lines = [x for x in (" ".join(line.split()) for line in text.splitlines()) if x]
    for title in ((section or "").strip().strip("."), " ".join(heading.split()).lower()):
        if title and lines and title in (lines[0].strip("."), lines[0].lower()):
            del lines[0]
    found, label = [], None
    for line in lines:
        head = line.lower() in TABLE_HEADS or is_table_header(line)
        if label is not None and line.startswith(BULLETS):
            break
        if label is not None and not head and _is_cell(line):
            found.append((label, line))
            label = None
        else:
            label = None if head else line
    return found


def _is_cell(line: str) -> bool:
    low = line.lower()
    return not low.endswith("conditions") and (any(c.isdigit() for c in line) or low in TABLE_WORDS or len(T.tokens_py(line)) <= 4)


def conditions_answer(p: Plan, strong: list[dict]) -> Answer | None:
    """Design conditions as a table, of the first strong chunk that holds one."""
    if p.attribute_label != "design_conditions":
        return None
    for r in strong[:4]:
        rows = table_entries(r["full_text"], r.get("section_number"), r["heading"])
        if len(rows) >= TABLE_LEAST:
            lines = "\n".join(f"- {a}: {b}" for a, b in rows[:TABLE_MOST])
            return Answer(f"{r['heading'] or 'Design Conditions'}:\n{lines}\n{_place(r)}", citations([r, *strong]), mode="design_conditions")
    return None


def asks_requirement(p: Plan) -> bool:
    plain = p.request_shape == "scalar" and not (p.attribute_label or p.count_question or p.direct_text_question)
    return plain and bool(p.intent == "responsibility" or p.answer_family or any(w in p.normalized_query for w in REQUIREMENT_WORDS))


def requirement_score(p: Plan, row: dict) -> float:
    said = best_excerpt(p, row["full_text"] or "", EXCERPT)
    low = said.lower()
    s = row["score"] + REQUIREMENT_SYSTEM * bool(p.system_phrase and p.system_phrase in low) + REQUIREMENT_CONCEPT * sum(t in low for t in p.concept_terms)
    s += REQUIREMENT_NUMBER * len(re.findall(T.NUMBER_WITH_UNIT, said)) + REQUIREMENT_SHORT[0] * (len(said) <= REQUIREMENT_SHORT[1])
    return s + sum(w for w, pattern in REQUIREMENT_WEIGHTS if re.search(pattern, low))


def requirement_order(p: Plan, ranked: list[dict]) -> list[dict]:
    """The rows by how well they answer a requirement question, if one of the first six is better by a margin than the first bundle's best
    three; else as they are."""
    if len(ranked) < 2 or not asks_requirement(p):
        return ranked
    score = {r["chunk_id"]: requirement_score(p, r) for r in ranked}
    first = sorted((r for r in ranked if r.get("bundle_rank") == 1), key=lambda r: r.get("depth", 0))[:3]
    if not first or max(score[r["chunk_id"]] for r in ranked[:6]) < max(score[r["chunk_id"]] for r in first) + REQUIREMENT_MARGIN:
        return ranked
    return sorted(ranked, key=lambda r: -score[r["chunk_id"]])


def chosen_first(question: str, ranked: list[dict], choose: Callable[[str, list[str]], int | None] | None) -> list[dict]:
    """Where the first bundles are close, the one that a chooser (question, texts -> index or None) picks goes first. Its failures and
    answers out of range change nothing."""
    heads = {}
    for r in ranked:
        if r.get("bundle_rank") is not None:
            heads.setdefault(r["bundle_rank"], r)
    best = [heads[k] for k in sorted(heads)][:CHOOSE_FROM]
    if choose is None or len(best) < 2 or best[0]["bundle_score"] - best[1]["bundle_score"] >= CHOOSE_GAP and best[0]["confidence"] >= CHOOSE_CONFIDENCE:
        return ranked
    try:
        k = choose(question, [f"{_place(r)}\n{T.short_py(r['full_text'], EXCERPT)}" for r in best])
    except (OSError, RuntimeError, ValueError):
        return ranked
    if not isinstance(k, int) or not 0 <= k < len(best):
        return ranked
    return sorted(ranked, key=lambda r: r.get("bundle_rank") != best[k]["bundle_rank"])


def compressed(p: Plan, text: str) -> str:
    """The sentences that name the system or the attribute, or two of the question's words (one, if it has but one); all, if none does."""
    names = tuple(filter(None, (p.system_phrase, *p.system_aliases, *p.system_significant_terms, *p.attribute_terms)))
    least = min(2, len(p.focus_terms))
    kept = [s for s in T.sentences_py(text) if names and T.hit_count_py(s, names) or least and T.hit_count_py(s, p.focus_terms) >= least]
    return " ".join(kept) or " ".join(text.split())


def evidence_pack(rows: list[dict], windows: list[dict], most: int) -> str:
    """Sections and page windows as blocks of text for a generator."""
    blocks = [f"[{_place(r)}]\n{r['text']}" for r in rows]
    return "\n\n".join(blocks + [f"[Page {w['page_num']}]\n{T.short_py(w['page_text'], WINDOW)}" for w in windows[:most]])


def prompt_context(p: Plan, strong: list[dict], hits: list[dict], windows: list[dict], deep: bool = False, previous: str | None = None) -> str:
    """What a generator reads: a topic's compressed sections, or excerpts; for a deep or wider answer exact pages and page windows too, and
    the answer that is to be widened first."""
    topic = p.retrieval_mode == "topic_summary"
    wide = deep or previous is not None
    text = lambda r: compressed(p, r["full_text"]) if topic else r["full_text"]
    rows = [r | {"text": T.short_py(text(r), DEEP_EXCERPT if wide else EXCERPT)} for r in strong[: DEEP_PARTS if wide else SUMMARY_PARTS]]
    shown = hits[:DEEP_HITS] if wide else []
    numbers = {(h.get("document_id"), h["page_num"]) for h in shown}
    rest = [w for w in windows if (w.get("document_id"), w["page_num"]) not in numbers][:DEEP_WINDOWS] if wide else []
    pack = evidence_pack(rows, [*shown, *rest], DEEP_HITS + DEEP_WINDOWS)
    return f"Previous answer:\n{previous}\n\nEvidence:\n{pack}" if previous else pack


# --- the cascade ------------------------------------------------------------------------------------------------------------------
def fact_answer(fact: dict, rows: list[dict]) -> Answer:
    own = next((r for r in rows if r["chunk_id"] == fact["source_chunk_id"]), None)
    heading = own["heading"] if own else "Contract evidence"
    section = own.get("section_number") if own else None
    place = f"Section {section} - {heading}" if section else heading
    text = f"\"{fact['value']}\"\n{place}\nPages: {pages_of(fact['page_start'], fact['page_end'])}\nEvidence: \"{fact['evidence_text']}\""
    first = Citation(fact["source_chunk_id"], section, heading, fact["page_start"], fact["page_end"], fact["evidence_text"])
    return Answer(text, [first, *(c for c in citations([r for r in rows if r["chunk_id"] != fact["source_chunk_id"]], 3))], mode="grounded_fact")


def page_answer(p: Plan, hits: list[dict]) -> Answer | None:
    """From pages that hold the very words: a count, a typed value, or the pages' text for direct questions."""
    if not hits:
        return None
    kind = p.attribute_label if p.attribute_label in L.EXACT_VALUE_ATTRIBUTES else None
    if not (p.count_question or p.direct_text_question or re.match(r"(?:find|where does|which page) ", p.normalized_query) or kind and p.system_phrase):
        return None
    texts = [h["page_text"] for h in hits]
    value = count_value(p.raw_query, texts) if p.count_question else None
    if kind and not value:
        near = [t for t in texts if not p.system_phrase or p.system_phrase in t.lower()]
        value = next((v for t in near if (v := labelled_value(t.split("\n"), p.attribute_terms, p.system_phrase) or typed_value(_about(p, t), kind))), None)
    if not value and not p.direct_text_question and not re.match(r"(?:find|where does|which page) ", p.normalized_query):
        return None
    term = planner.exact_terms(p.raw_query)[0]
    parts = [f"Answer: {value}"] if value else ["Direct contract text:"]
    parts += [f"Page {h['page_num']}: \"{excerpt_around(h['page_text'], term, 520 if value else PAGE_EXCERPT)}\"" for h in hits[:4]]
    return Answer("\n".join(parts), [Citation(h.get("page_key", ""), None, f"Page {h['page_num']}", h["page_num"], h["page_num"], excerpt_around(h["page_text"], term, QUOTE)) for h in hits[:4]], mode="grounded_page")


def _about(p: Plan, text: str) -> str:
    return " ".join(s for line in text.split("\n") for s in T.sentences_py(line) if not p.system_phrase or p.system_phrase in s.lower()) or text


def answer(
    p: Plan, ranked: list[dict], hits: list[dict], fact: dict | None = None, deep: bool = False, generate: Callable[[str, str], str] | None = None,
    windows: list[dict] | None = None, previous: str | None = None, choose: Callable[[str, list[str]], int | None] | None = None,
) -> Answer:
    """The answer to one question: a fact, exact page text, a reference, a list, a value, a table, an extract; a generator's words if one is
    given and the evidence is strong; else the refusal. previous: an answer to be widened, which a generator does from it and the evidence;
    without one the answer is a deep one."""
    deep = deep or previous is not None
    if fact and not (previous and generate):
        return fact_answer(fact, ranked)
    if not fact:
        ranked = requirement_order(p, chosen_first(p.raw_query, ranked, choose))
    strong = [r for r in ranked[:8] if useful(r) and matches(p, r)]
    if previous and generate is not None and strong and (said := _said(p, strong, hits, windows, deep, generate, previous)):
        return said
    if fact:
        return fact_answer(fact, ranked)
    if p.section_number:
        own = [r for r in ranked if r.get("section_number") == p.section_number]
        if not own:
            return refusal()
        return _extract(p, sorted(own, key=lambda r: r["ordinal_in_document"])[:2], deep, "section")
    if re.match(r"(?:what|which) (?:section|page)\b", p.normalized_query):
        if not strong:
            return refusal()
        r = strong[0]
        place = f"Pages {pages_of(r['page_start'], r['page_end'])}" if "page" in p.normalized_query.split()[1] else f"Section {r['section_number'] or '-'}"
        return Answer(f"{place} - {r['heading']}\n\"{best_excerpt(p, r['full_text'], EXCERPT)}\"", citations(strong), mode="reference")
    exact = page_answer(p, hits)
    if exact and (p.retrieval_mode != "fact_lookup" or exact.text.startswith("Answer: ")):
        return exact
    if not strong:
        return refusal()
    if p.request_shape == "grouped_list":
        found = list(dict.fromkeys(s for r in strong[:4] for s in T.sentences_py(r["full_text"]) if (re.search(LIMITS, s) or has_value(s)) and T.hit_count_py(s, p.concept_terms)))[:6]
        if found:
            return Answer("\n".join(f"- {T.short_py(s, QUOTE)}" for s in found), citations(strong), mode="grouped_list")
    if p.request_shape == "broad_topic":
        lines = [f"- {r['heading']}: \"{best_excerpt(p, r['full_text'], 320)}\"" for r in strong[:4]]
        return Answer("\n".join(["The contract addresses this in:", *lines]), citations(strong), mode="broad_topic_summary")
    if table := conditions_answer(p, strong):
        return table
    if p.attribute_label in TYPED:
        for r in strong[:3]:
            v = labelled_value(r["full_text"].split("\n"), p.attribute_terms, p.system_phrase) or typed_value(_about(p, r["full_text"]), p.attribute_label)
            if v:
                return Answer(f"\"{v}\"\n{_place(r)}\nEvidence: \"{best_excerpt(p, r['full_text'], 320)}\"", citations([r, *strong]), mode="compact")
        return refusal()
    if generate is not None and (said := _said(p, strong, hits, windows, deep, generate, previous)):
        return said
    return _extract(p, strong[:2 if deep else 1], deep, "extractive")


def _said(p: Plan, strong: list[dict], hits: list[dict], windows: list[dict] | None, deep: bool, generate, previous: str | None) -> Answer | None:
    """A generator's answer; none if it fails or says nothing."""
    try:
        said = generate(p.raw_query, prompt_context(p, strong, hits, windows or [], deep, previous)).strip()
    except (OSError, RuntimeError, ValueError):
        return None
    return Answer(said, citations(strong), said == L.REFUSAL, "generated") if said else None


def _place(r: dict) -> str:
    name = f"Section {r['section_number']} - {r['heading']}" if r.get("section_number") else r["heading"]
    return f"{name} (pages {pages_of(r['page_start'], r['page_end'])})"


def _extract(p: Plan, rows: list[dict], deep: bool, mode: str) -> Answer:
    return Answer("\n\n".join(f"{_place(r)}\n\"{best_excerpt(p, r['full_text'], DEEP_EXCERPT if deep else EXCERPT)}\"" for r in rows), citations(rows), mode=mode)


_ANSWERS = "question_id string, text string, mode string, refused boolean, n_citations int, citations string"


class Assistant:
    """Answers questions over a corpus, one by one or in batches."""

    def __init__(self, retriever: Retriever, vocabulary: list[dict] | None = None, generate: Callable[[str, str], str] | None = None, choose: Callable[[str, list[str]], int | None] | None = None):
        self.retriever, self.match, self.generate, self.choose = retriever, planner.best_system(vocabulary) if vocabulary else None, generate, choose

    def plan(self, question: str, anchor: str | None = None) -> Plan:
        return planner.plan(planner.grounded_question(planner.resolved(question, anchor)), self.match)

    def fact_hits(self, plans: dict[str, Plan]) -> DataFrame:
        """(question_id, fact, reason) of the questions that ask for a value of a system."""
        spark = self.retriever.chunks.sparkSession
        rows = []
        for q, p in plans.items():
            if p.retrieval_mode == "fact_lookup":
                names = sorted({T.system_name_py(a) for a in (p.system_phrase, *p.system_aliases, *T.system_aliases_py(p.system_phrase))} - {""})
                rows.append((q, p.system_phrase, names, list(p.system_significant_terms), list(p.system_terms), p.attribute_label or "", p.content_query))
        schema = "question_id string, system_phrase string, system_names array<string>, significant array<string>, system_terms array<string>, attribute_label string, content_query string"
        asked = spark.createDataFrame(rows, schema)
        lookups = asked.withColumn("name", F.explode("system_names"))
        found = self.retriever.facts.join(F.broadcast(lookups), (F.col("system_normalized") == F.col("name")) & (F.col("attribute_normalized") == F.col("attribute_label")))  # a few rows for each question
        return fact_hits(found.drop("name").withColumn("score", fact_scores(found)))

    def ask_batch(self, questions: dict[str, str], deep: bool = False, anchors: dict[str, str] | None = None, previous: dict[str, str] | None = None) -> DataFrame:
        """Answers to a stated set of questions {id: text}. All questions share each step's job; confident facts skip recall; each
        question's evidence, a few dozen rows, meets in one group at the end. previous: answers to be widened, by question."""
        previous = previous or {}
        plans = {q: self.plan(t, (anchors or {}).get(q)) for q, t in questions.items()}
        spark = self.retriever.chunks.sparkSession
        sure = {r["question_id"]: r["fact"].asDict() for r in self.fact_hits(plans).where("fact IS NOT NULL").collect()}
        open_ = {q: p for q, p in plans.items() if q not in sure or q in previous} or plans
        evidence = self.retriever.retrieve(open_, deep).where("position IS NOT NULL").groupBy("question_id", "chunk_id").agg(F.max_by(F.struct("*"), F.col("bundle_score")).alias("e")).select("e.*")
        wide = self.generate is not None and (deep or bool(previous))  # only a generator reads page windows
        if wide:
            evidence = stored(evidence, "evidence")
        hits = self.retriever.page_hits(plans)
        own = spark.createDataFrame([(q, f["source_chunk_id"]) for q, f in sure.items()], "question_id string, chunk_id string")
        sources = self.retriever.rows.join(F.broadcast(own), "chunk_id")  # one row for each question
        dump = lambda df: df.select("question_id", F.to_json(F.struct("*")).alias("j"))
        kinds = [dump(evidence).withColumn("kind", F.lit("chunk")), dump(hits).withColumn("kind", F.lit("page")), dump(sources).withColumn("kind", F.lit("source")), spark.createDataFrame([(q, "{}", "question") for q in plans], "question_id string, j string, kind string")]
        if wide:
            kinds.append(dump(self.page_windows(evidence)).withColumn("kind", F.lit("window")))
        every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3])
        for x in kinds[4:]:
            every = every.unionByName(x)
        shared = spark.sparkContext.broadcast(({q: asdict(p) for q, p in plans.items()}, sure))
        generate, choose = self.generate, self.choose

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            dumped, facts = shared.value
            q = pdf.question_id[0]
            p = Plan(**{k: tuple(v) if isinstance(v, list) else v for k, v in dumped[q].items()})
            load = lambda kind: [json.loads(j) for j in pdf.j[pdf.kind == kind]]
            blank = {"section_number": None, "parent_heading": None, "parent_chunk_id": None}
            ranked = [blank | r for r in sorted(load("chunk"), key=lambda r: r["position"])] + [blank | r for r in load("source")]
            pages = sorted(load("page"), key=lambda r: r["rank"])
            windows = sorted(load("window"), key=lambda r: (r["position"], r["page_num"]))
            a = answer(p, ranked, pages, facts.get(q), deep, generate, windows, previous.get(q), choose)
            return pd.DataFrame([(q, a.text, a.mode, a.refused, len(a.citations), json.dumps([asdict(c) for c in a.citations]))], columns=["question_id", "text", "mode", "refused", "n_citations", "citations"])

        return every.groupBy("question_id").applyInPandas(run, _ANSWERS)

    def page_windows(self, evidence: DataFrame) -> DataFrame:
        """(question_id, document_id, page_num, page_text, position): the first two pages of each question's first four chunks, each once."""
        w = evidence.where("position <= 4").withColumn("page_num", F.explode(F.sequence("page_start", F.least(F.greatest("page_start", "page_end"), F.col("page_start") + 1))))
        w = w.groupBy("question_id", "document_id", "page_num").agg(F.min("position").alias("position"))
        return self.retriever.pages.select("document_id", "page_num", "page_text").join(F.broadcast(w), ["document_id", "page_num"])  # at most eight rows a question

    def ask(self, question: str, history: list[dict] | None = None, deep: bool = False, expand_answer: bool = False, previous_answer: str | None = None) -> Answer:
        """The answer to one question; history: earlier turns {role, content}, for follow-ups. expand_answer widens previous_answer, or else
        the last answer of the history."""
        anchor = None
        if history:
            turns = [("c", k, h.get("role"), h.get("content")) for k, h in enumerate(history[-planner.HISTORY :])] + [("c", 10**6, "user", question)]
            t = planner.follow_up_anchors(self.retriever.chunks.sparkSession.createDataFrame(turns, "conv_id string, turn long, role string, text string"))
            row = t.where("turn = 1000000").first()
            anchor = row["anchor"] if row and row["follow_up"] else None
        earlier = previous_answer or next((h.get("content") or "" for h in reversed(history or []) if h.get("role") == "assistant"), "")
        r = self.ask_batch({"q": question}, deep, {"q": anchor} if anchor else None, {"q": earlier} if expand_answer else None).first()
        return Answer(r["text"], [Citation(**c) for c in json.loads(r["citations"])], r["refused"], r["mode"])
