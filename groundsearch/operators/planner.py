"""Questions to query plans: what is asked, of which system, and the search passes that look for it."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundsearch.functions import lexicons as L
from groundsearch.functions import text as T
from groundsearch.operators.fulltext import And, Or, Phrase

# fixed values: request shapes, retrieval modes, patterns and markers of questions
SECTION_REF = r"(?i)\b(?:section|sec\.?)\s*(\d+(?:\.\d+){0,5})\b"
BARE_SECTION = r"^\s*(\d+(?:\.\d+){0,5})\s*$"
SCOPE = r"(?i)\b(?:appendix|exhibit|attachment)(?:\s+[A-Za-z0-9.\-]+)?\b"
RESPONSIBLE = r"\b(?:who is responsible|who provides|who furnishes|who supplies|provided by|responsible for|required to provide|required to furnish|required to supply)\b"
FAMILY_MARKERS = ("guarantee", "guarantees", "guaranteed", "limit", "limits")
AGGREGATE_TERMS = ("guarantees", "limits", "requirements", "values")
BROAD_MARKERS = ("requirements", "requirement", "permits", "permit", "permitting", "environmental", "compliance")
BROAD_SIGNALS = ("requirements", "required", "shall", "must", "permit", "permits", "compliance", "test", "testing", "demonstrate")
FAMILY_TERMS = ("guarantee", "guarantees", "shall not exceed", "nox", "co", "ppmvd", "emissions")
EXACT_PREFIXES = ("how many ", "what does the contract say about ", "what does it say about ", "what is ", "what are ", "define ", "tell me about ", "show me ")
EXACT_TAILS = r"\b(?:do we have|do we use|are we using|are there|is there|do we need|do we require)$"


@dataclass(frozen=True)
class Profile:
    name: str
    results: int
    fts: int
    keyword: int
    semantic: int
    expand: bool = False


NORMAL, DEEP = Profile("normal", 8, 24, 18, 64), Profile("deep", 10, 40, 30, 64, True)
KEEP_PER_SOURCE, KEEP_MERGED, KEEP_MERGED_WIDE = 20, 24, 40


@dataclass(frozen=True)
class Plan:
    raw_query: str
    normalized_query: str
    content_query: str
    intent: str = "general_topic"
    retrieval_mode: str = "fallback"
    request_shape: str = "scalar"
    section_number: str | None = None
    count_question: bool = False
    direct_text_question: bool = False
    focus_terms: tuple[str, ...] = ()
    concept_terms: tuple[str, ...] = ()
    scope_terms: tuple[str, ...] = ()
    actor_terms: tuple[str, ...] = ()
    action_terms: tuple[str, ...] = ()
    topic_terms: tuple[str, ...] = ()
    expansion_terms: tuple[str, ...] = ()
    aggregate_requested: bool = False
    answer_family: str | None = None
    system_phrase: str = ""
    system_terms: tuple[str, ...] = ()
    system_aliases: tuple[str, ...] = ()
    attribute_label: str | None = None
    attribute_terms: tuple[str, ...] = ()
    system_significant_terms: tuple[str, ...] = ()

    @property
    def all_terms(self) -> tuple[str, ...]:
        groups = (self.concept_terms, self.scope_terms, self.system_terms, self.attribute_terms, self.focus_terms, self.actor_terms, self.action_terms, self.topic_terms, self.expansion_terms)
        return T.dedupe_py(t for g in groups for t in g)


_LISTS = {f.name for f in fields(Plan) if "tuple" in str(f.type)}
_FLAGS = {f.name for f in fields(Plan) if f.type == "bool"}
PLAN_STRUCT = ", ".join(f"{f.name} {'array<string>' if f.name in _LISTS else 'boolean' if f.name in _FLAGS else 'string'}" for f in fields(Plan))


def content_of(low: str) -> str:
    """The question without its opening words, end marks and closing words."""
    out = next((low[len(p) :] for p in L.QUERY_PREFIXES if low.startswith(p)), low).strip(" ?.!")
    for tail in L.QUERY_TAILS:
        out = re.sub(rf"\b{tail}$", "", out).strip()
    return out or low


def focus(content: str) -> tuple[str, ...]:
    return T.dedupe_py(t for t in T.tokens_py(content) if len(t) > 2 and T.norm_py(t) not in L.STOPWORDS and T.norm_py(t) not in L.ACTORS)


def attribute_of(low: str, content: str) -> str | None:
    """The attribute that is asked for; where aliases belong to two labels, the first label counts."""
    if low.startswith(("how does ", "how do ")) or content.endswith((" work", " works")):
        return "function"
    if re.search(r"\bwe (?:are )?using\b", low) or re.search(r"\b(?:using|used)\b", content):
        return "type"
    if re.search(RESPONSIBLE, low):
        return "responsibility"
    return next((T.attribute_name_py(label) for label, aliases in L.ATTRIBUTE_ALIASES.items() if any(f" {T.norm_py(a)} " in f" {x} " for a in aliases for x in (low, content))), None)


def intent_of(low: str, attribute: str | None, section: str | None, direct: bool) -> str:
    has = lambda *ws: any(w in low for w in ws)
    asks = low.startswith(("what is ", "define ", "meaning of ")) or has(" definition", " defined as ", " means ")
    rules = (
        ("section_lookup", bool(section)), ("direct_text", direct), ("definition", attribute == "definition" or attribute is None and asks),
        ("responsibility", has("responsible for") or low.startswith("who ")), ("payment_liability", has("pay", "cost", "liable")),
        ("termination", has("terminate", "termination", "end the contract")), ("delay_schedule", has("delay", "late", "weather", "schedule")),
    )
    return next((name for name, holds in rules if holds), "general_topic")


def is_broad(low: str, system: str, attribute: str | None, direct: bool, grouped: bool, terms: tuple[str, ...]) -> bool:
    if direct or attribute is not None or grouped:
        return False
    if low.startswith(L.BROAD_PREFIXES) or low.startswith("do we have ") and len(terms) >= 2:
        return True
    return any(m in terms for m in BROAD_MARKERS) and len(T.tokens_py(system)) < 3


def plan(question: str, match=None) -> Plan:
    """The plan of one question. match(content, phrase), if given, is the corpus vocabulary: a dict of the best system, or None."""
    low = T.norm_py(question)
    content = content_of(low)
    m = re.search(SECTION_REF, question) or re.match(BARE_SECTION, question.strip())
    section = m[1] if m else None
    count, quoted = low.startswith("how many "), low.startswith(L.DIRECT_PREFIXES)
    terms, attribute = focus(content), attribute_of(low, content)
    a_terms = T.attribute_terms_py(attribute) if attribute else ()
    found = [T.norm_py(x) for text in (low, content) for x in re.findall(SCOPE, text)]
    scope = T.dedupe_py(y for x in found for y in (x, x.split()[0]))
    both = f" {low} {content} "
    family = any(f" {w} " in both for w in FAMILY_MARKERS) or "shall not exceed" in both and any(t in terms for t in ("emission", "emissions", "nox", "co"))
    aggregate = attribute is None and (any(p in f" {low} " for p in (" all ", " list ")) or low.startswith("what are ") and family or any(t in AGGREGATE_TERMS for t in terms))
    skip = {w for p in a_terms for w in T.tokens_py(p)} | ({"work", "works", "operate", "operation"} if attribute == "function" else set()) | set(L.SYSTEM_FILLER)
    extracted = T.system_name_py(" ".join(t for t in map(T.norm_py, T.tokens_py(content)) if t not in skip))
    matched = match(content, extracted) if match and extracted else None
    grouped = aggregate and family
    broad = is_broad(low, matched["canonical_phrase"] if matched else extracted, attribute, count or quoted, grouped, terms)
    intent = intent_of(low, attribute, section, count or quoted)
    shape = next(
        name
        for name, holds in (
            ("reference_lookup", bool(section)), ("grouped_list", grouped), ("broad_topic", broad), ("direct_text", count or quoted), ("definition", intent == "definition"),
            ("responsibility", intent == "responsibility"), ("scalar", True),
        )
        if holds
    )
    topics = T.labels_py(content, L.TOPICS, True)
    if intent != "responsibility" and not any(w in x for w in ("responsible", "responsibility", "obligation") for x in (low, content)):
        topics = tuple(t for t in topics if t != "responsibility")
    s_tokens, a_tokens = {w for s in scope for w in T.tokens_py(s)}, {T.norm_py(w) for p in a_terms for w in T.tokens_py(p)}
    pool = [t for t in map(T.norm_py, T.tokens_py(content)) if t not in L.STOPWORDS] if shape == "grouped_list" else terms
    concept = T.dedupe_py(t for t in pool if t not in a_tokens and t not in s_tokens)
    if shape in ("grouped_list", "broad_topic"):
        extracted, matched = "", None
    phrase = matched["canonical_phrase"] if matched else T.system_name_py(extracted)
    s_terms = tuple(matched["terms"]) if matched else focus(phrase)
    own = T.system_aliases_py(extracted or phrase)
    aliases = T.dedupe_py(a for a in (*own, *(matched["aliases"] if matched else ())) if a != phrase)
    significant = tuple(t for t in s_terms if t not in L.GENERIC_SYSTEM_TERMS) or s_terms
    exact = shape == "scalar" and attribute in L.EXACT_VALUE_ATTRIBUTES and bool(phrase) and intent not in ("definition", "responsibility")
    mode = {"reference_lookup": "section_lookup", "grouped_list": "grouped_list", "broad_topic": "topic_summary", "direct_text": "direct_text"}.get(shape, "fact_lookup" if exact else "fallback")
    return Plan(
        question, low, content, "attribute_value" if exact else intent, mode, shape, section, count, quoted, terms, concept, scope, T.labels_py(content, L.ACTORS, True), T.labels_py(content, L.ACTIONS, True),
        topics, T.expansions_py(low), aggregate, "guarantee_or_limit" if family else None, phrase, s_terms, aliases, attribute, a_terms, significant,
    )


def best_system(vocabulary_rows: list[dict]):
    """A match function for plan() over the vocabulary of one document: rows (canonical_phrase, terms, significant_terms, aliases) in rank order."""

    def match(content: str, fallback: str) -> dict | None:
        low = T.norm_py(content)
        have, extra = ({T.singular_py(t) for t in T.tokens_py(T.norm_py(x))} for x in (low, fallback))
        best, top = None, 0.0
        for v in vocabulary_rows:
            s = 8.0 + len(v["terms"]) if T.has_phrase_py(low, v["canonical_phrase"]) else 0.0
            alias = next((a for a in v["aliases"] if T.has_phrase_py(low, a)), None)
            s += 6.0 + len(T.tokens_py(alias)) if alias else 0.0
            if len(v["significant_terms"]) >= 2 and set(v["significant_terms"]) <= have:
                s += 5.5 + len(v["significant_terms"]) + T.ordered_hits_py(low, v["significant_terms"])
            elif set(v["terms"]) <= have:
                s += 4.5 + len(v["terms"])
            s += 1.5 if extra and set(v["significant_terms"]) <= extra else 0.0
            if s > top:
                best, top = v, s
        return best if top >= 4.0 else None

    return match


def plan_batch(questions: DataFrame, systems: DataFrame | None = None) -> DataFrame:
    """questions (question_id, question) with a column `plan`. systems (question_id, canonical_phrase, terms, aliases), if given, is what the
    vocabulary matched for each question (operators.vocabulary.match), joined by question. Rows are dealt anew: much work for each."""
    q = questions.select("question_id", "question").repartition(questions.sparkSession.sparkContext.defaultParallelism * 4)
    if systems is not None:
        s = systems.select("question_id", F.struct("canonical_phrase", "terms", "aliases").alias("system"))
        q = q.join(s, "question_id", "left")
    else:
        q = q.withColumn("system", F.lit(None).cast("struct<canonical_phrase:string,terms:array<string>,aliases:array<string>>"))

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                system = r.system if isinstance(r.system, dict) else None
                p = plan(r.question or "", (lambda c, f, s=system: s) if system else None)
                rows.append({"question_id": r.question_id, "question": r.question, "plan": {k: list(v) if isinstance(v, tuple) else v for k, v in vars(p).items()}})
            yield pd.DataFrame(rows, columns=["question_id", "question", "plan"])

    kind = dict(questions.dtypes)["question_id"]
    return q.mapInPandas(run, f"question_id {kind}, question string, plan struct<{', '.join(x.replace(' ', ':', 1) for x in PLAN_STRUCT.split(', '))}>")


# --- search passes ----------------------------------------------------------------------------------------------------------------
def phrases_of(terms: tuple[str, ...]) -> tuple[str, ...]:
    """The leading three terms, and the first three pairs of neighbours."""
    if len(terms) < 2:
        return ()
    return T.dedupe_py([" ".join(terms[:3]), *(" ".join(terms[i : i + 2]) for i in range(min(3, len(terms) - 1)))])


def pairs_of(terms: tuple[str, ...]) -> tuple[str, ...]:
    """All pairs of neighbours, and the leading three terms: for scoring."""
    if len(terms) < 2:
        return ()
    return tuple(dict.fromkeys([*(" ".join(terms[i : i + 2]) for i in range(len(terms) - 1)), *([" ".join(terms[:3])] if len(terms) > 2 else [])]))


def _any(terms, columns: tuple[str, ...] = ()):
    parts = tuple(Phrase(t, columns) for t in terms if t)
    return Or(parts) if parts else None


def raw_pass(query: str):
    """The question's own words: all of them as a phrase, or any."""
    words = [t for t in T.tokens_py(query.lower()) if len(t) > 2]
    if not words:
        return Phrase(query.strip()) if query.strip() else None
    return Or(((Phrase(" ".join(words[:6])),) if len(words) > 1 else ()) + tuple(map(Phrase, words)))


def general_passes(p: Plan) -> list:
    out = [Phrase(p.section_number, ("section_number",))] if p.section_number else []
    heads = (*p.scope_terms, *p.concept_terms, *p.topic_terms, *p.action_terms, *p.expansion_terms)[:6]
    if heads:
        out.append(Or(tuple(Phrase(t, ("heading",)) for t in heads) + tuple(Phrase(t, ("parent_heading",)) for t in heads[:3])))
    tags = tuple(Phrase(t, (f"{k}_tags",)) for k, ts in (("actor", p.actor_terms), ("action", p.action_terms), ("topic", p.topic_terms)) for t in ts)
    if tags:
        out.append(Or(tags))
    if p.all_terms:
        out.append(_any((*phrases_of(p.focus_terms), *p.all_terms[:12])))
    return out


def like_text(p: Plan) -> str:
    if p.system_phrase and p.attribute_terms:
        parts = [p.system_phrase, *p.attribute_terms[:3]]
    elif p.concept_terms:
        parts = [*p.scope_terms[:2], *p.concept_terms[:4]] if p.scope_terms else p.concept_terms[:6]
    elif p.system_phrase:
        parts = [p.system_phrase]
    else:
        parts = p.all_terms[:8] or [p.content_query]
    return " ".join(parts).strip()


def query_variants(p: Plan) -> list[str]:
    """Other wordings of the question for expansion."""
    out = [p.raw_query, p.content_query, p.system_phrase, " ".join(p.scope_terms), " ".join(p.concept_terms), *phrases_of(p.focus_terms)]
    return list(dict.fromkeys(v for v in out if v))


def profile_for(p: Plan, deep: bool = False) -> Profile:
    base = DEEP if deep else NORMAL
    if p.request_shape == "grouped_list":
        return replace(base, fts=max(base.fts, 36), keyword=max(base.keyword, 24))
    if p.request_shape == "broad_topic":
        return replace(base, fts=max(base.fts, 40), keyword=max(base.keyword, 24), expand=True)
    return base


def search_passes(p: Plan, profile: Profile = NORMAL) -> list[tuple[str, object, float]]:
    """(name, expression, bonus) of each pass over the feature index, in order; equal expressions once."""
    both = ("heading", "parent_heading")
    attribute, concept, scope = _any(p.attribute_terms[:4]), _any(p.concept_terms[:5]), _any(p.scope_terms[:3])
    titled = Phrase(" ".join(p.concept_terms[:4]), both)
    out: list[tuple[str, object, float]] = []

    def add(name, bonus, *parts):
        if all(x is not None for x in parts):
            out.append((name, parts[0] if len(parts) == 1 else And(parts), bonus))

    if p.request_shape == "grouped_list" and concept:
        family = _any([t for t in p.expansion_terms if t in FAMILY_TERMS][:6]) if p.answer_family else None
        add("grouped_heading_concept", 1.55, titled)
        add("grouped_concept", 1.1, concept)
        add("grouped_scope_concept", 1.65, concept, scope)
        add("grouped_heading_scope", 1.95, *((titled, scope) if scope else (None,)))
        add("grouped_guarantee_family", 1.45, family)
        add("grouped_scope_guarantee_family", 1.9, family, scope)
    if p.request_shape == "broad_topic" and concept:
        add("broad_topic_heading_concept", 1.25, titled)
        add("broad_topic_concept", 0.95, concept)
        add("broad_topic_requirement_signal", 1.45, concept, _any(T.dedupe_py((*p.concept_terms, *p.focus_terms, *BROAD_SIGNALS))[:8]))
        add("broad_topic_scope_concept", 1.55, concept, scope)
    if p.system_phrase:
        name, titled = Phrase(p.system_phrase), Phrase(p.system_phrase, both)
        add("exact_system_attribute", 1.55, name, attribute)
        add("heading_system_attribute", 1.8, titled, attribute)
        add("exact_system_heading", 1.25, titled)
        add("exact_system_text", 0.95, name)
    add("attribute_only", 0.45, attribute)
    for alias in p.system_aliases[:2]:
        add("alias_system_attribute", 0.7, Phrase(alias), attribute)
        add("alias_system", 0.35, Phrase(alias))
    for v in [p, *(plan(v) for v in query_variants(p))] if profile.expand else [p]:
        for e in general_passes(v):
            add("general", 0.0, e)
    seen: set[str] = set()
    return [x for x in out if not (repr(x[1]) in seen or seen.add(repr(x[1])))]


def like_passes(p: Plan, profile: Profile = NORMAL) -> list[str]:
    texts = [like_text(p), *(like_text(plan(v)) for v in query_variants(p))] if profile.expand else [like_text(p)]
    return [t for t in dict.fromkeys(texts) if t]


def exact_terms(query: str) -> list[str]:
    """Wordings under which pages are searched for what is asked."""
    raw = " ".join(query.lower().split())
    raw = next((raw[len(x) :] for x in EXACT_PREFIXES if raw.startswith(x)), raw).strip(" ?.")
    raw = re.sub(EXACT_TAILS, "", re.sub(r"\b(?:my|our|the)\b\s+", "", raw).strip()).strip()
    out = [raw, raw[:-1] if raw.endswith("s") and len(raw) > 4 else "", " ".join(t for t in T.tokens_py(raw) if len(t) > 2)]
    return list(dict.fromkeys(x for x in out if x))


# --- follow-ups -------------------------------------------------------------------------------------------------------------------
# fixed values: how a follow-up begins and what it refers by
FOLLOW_UP_STARTS = (
    "what about", "how about", "what section", "which section", "what page", "which page", "where ", "when ", "who ", "quote that", "show me that", "does it ", "is it ", "is that ",
    "are those ", "and ", "also ",
)
REFERENTIAL = (" it ", " that ", " this ", " these ", " those ", " they ", " them ", " same ")
HISTORY = 8


def grounded_question(question: str) -> str:
    """The question without requests on how to word the answer."""
    one = " ".join(question.split())
    out = re.sub(r"(?i)^(?:can you\s+)?(?:please\s+)?(?:summari[sz]e|explain)\s+", "", one)
    return re.sub(r"(?i)\s+in plain english$", "", out) or one or question


def content_column(question):
    """content_of() as a column."""
    low = T.norm(question)
    out = F.regexp_replace(low, "^(?:" + "|".join(L.QUERY_PREFIXES) + ")", "")
    out = F.regexp_replace(out, r"^[ ?.!]+|[ ?.!]+$", "")
    for tail in L.QUERY_TAILS:
        out = F.trim(F.regexp_replace(out, rf"\b{tail}$", ""))
    return F.when(out != "", out).otherwise(low)


def follow_up_anchors(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with follow_up and anchor: for a follow-up by the user, what the latest user turn among the HISTORY
    turns before it asked that is none itself. One window per conversation; a conversation's turns are few."""
    t = turns.withColumns({"c_low": F.lower(T.clean(F.coalesce("text", F.lit("")))), "c_content": content_column(F.coalesce("text", F.lit("")))})
    keep = lambda w: (F.length(w) > 2) & ~w.isin(*L.STOPWORDS) & ~w.isin(*L.ACTORS)
    t = t.withColumn("c_focus", F.array_distinct(F.filter(T.tokens(F.col("c_content"), "query"), keep)))
    padded = F.concat(F.lit(" "), F.col("c_low"), F.lit(" "))
    refers, starts = F.lit(False), F.lit(False)
    for w in REFERENTIAL:
        refers = refers | F.contains(padded, F.lit(w))
    for w in FOLLOW_UP_STARTS:
        starts = starts | F.col("c_low").startswith(w)
    section = (F.regexp_extract("text", SECTION_REF, 1) != "") | (F.regexp_extract("text", BARE_SECTION, 1) != "")
    few = (F.size("c_focus") < 2) & (F.size(F.split("c_content", " ")) < 4)
    vague = (F.size("c_focus") == 0) | ((F.size("c_focus") == 1) & F.get("c_focus", F.lit(0)).isin("section", "page"))
    t = t.withColumn("follow_up", (F.col("role") == "user") & (F.col("c_low") != "") & ~section & (starts | (refers & (vague | few))))
    own = F.regexp_replace(F.regexp_replace("c_content", r"^(?:summari[sz]e|explain)\s+", ""), r"\s+in plain english$", "")
    own = F.when((F.col("role") == "user") & ~F.col("follow_up") & (own != ""), own)
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-HISTORY, -1)
    return t.withColumn("anchor", F.when(F.col("follow_up"), F.last(own, True).over(w))).drop("c_low", "c_content", "c_focus")


def resolved(question: str, anchor: str | None) -> str:
    """A follow-up with what it is about."""
    if not anchor or " ".join(anchor.lower().split()) in " ".join(question.lower().split()):
        return question
    return f"{question.rstrip(' ?.!')} regarding {anchor}"
