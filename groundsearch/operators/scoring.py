"""Scores of chunks, and of evidence bundles, for question plans: rule tables, evaluated as columns over rows that are joined with their plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundsearch.functions import text as T
from groundsearch.operators import planner, vectors
from groundsearch.operators.planner import Plan

GENERIC_SCOPE = ("appendix", "appendices", "attachment", "attachments", "exhibit", "exhibits")
#: Term groups of a plan that rules speak of.
GROUPS = {
    "system": lambda p: (p.system_phrase,), "aliases": lambda p: p.system_aliases, "words": lambda p: p.system_terms, "telling": lambda p: p.system_significant_terms if p.system_terms else (),
    "attribute": lambda p: p.attribute_terms, "concept": lambda p: p.concept_terms, "scope": lambda p: p.scope_terms, "named": lambda p: tuple(t for t in p.scope_terms if t.strip().lower() not in GENERIC_SCOPE),
    "content": lambda p: (p.content_query,), "focus": lambda p: p.focus_terms, "pairs": lambda p: planner.pairs_of(p.focus_terms), "actor": lambda p: p.actor_terms, "action": lambda p: p.action_terms,
    "topic": lambda p: p.topic_terms, "expansion": lambda p: p.expansion_terms, "doing": lambda p: p.topic_terms + p.action_terms, "subject": lambda p: p.concept_terms + p.scope_terms,
    "context": lambda p: p.actor_terms + p.action_terms + p.topic_terms + p.expansion_terms,
}
_FACTS = ("intent", "request_shape", "section_number", "answer_family", "attribute_label", "system_phrase", "normalized_query")
_FLAGS = ("count_question", "direct_text_question")


def has(field: str, group: str) -> str:
    """SQL: one of the group's terms stands in the field as a phrase."""
    return f"exists(phrases.{group}, t -> contains({field}, t))"


def hits(group: str) -> str:
    """SQL: how many of the group's terms are substrings of anything in the row."""
    return f"size(filter(terms.{group}, t -> contains(low_all, t)))"


def asked(group: str) -> str:
    return f"size(terms.{group}) > 0"


def matches(pattern: str, field: str) -> str:
    return f"{field} rlike r'{pattern}'"


def count(pattern: str, field: str) -> str:
    return f"regexp_count({field}, r'{pattern}')"


def label(name: str) -> str:
    return f"plan.attribute_label = '{name}'"


# --- fixed values: what a row must have, and what that weighs -------------------------------------------------------------------------
DESIGN = r"\bdesign conditions?\b|\bdesign basis\b|\boperating conditions?\b"
MODEL = r"\b[A-Z]{2,}[A-Z0-9\-]*\d[A-Z0-9\-]*\b"
QUANTITY = r"\b\d+(?:\.\d+)?\s*(?:psi|psig|psia|degf|deg c|°f|°c|gpm|lb/hr|scfm|mw|mva|hp)\b"
#: What an attribute looks like in a body.
LABELS = {
    "configuration": (r"\bconfiguration\b|\bconfigured\b|\barrangement\b", 1.0),
    "type": (r"\bmodel\b|\btype\b|\bselected\b|\bmanufacturer\b|\bvendor\b", 1.0),
    "size": (r"\bsize\b|\bdiameter\b|\brating\b|\b(?:inch|inches|mm|ft)\b", 0.95),
    "power": (r"\bhorse\s*power\b|\bhp\b|\bkw\b|\bkilowatt", 1.2),
    "function": (r"\b(?:receives|supplies|provides|distributes|used to|serves to|operates)\b", 0.8),
    "responsibility": (r"\b(?:shall|must|responsible|provide|furnish|supply|required)\b", 0.65),
}
#: Intent: what a body must say, its weight, and (asked for, terms, weight) of what it should have then.
INTENTS = {
    "responsibility": (r"\b(?:shall|must|responsible|required)\b", 0.55, (("(array_contains(terms.action, 'permit') OR array_contains(terms.topic, 'permitting'))", ("permit", "permits", "permitting", "approval", "approvals"), 0.8),)),
    "payment_liability": (r"\b(?:pay|payment|cost|compensation|damages)\b", 0.5, (("contains(plan.normalized_query, 'late')", ("late", "delay", "completion", "liquidated damages", "substantial completion"), 0.75),)),
    "termination": (r"\b(?:terminate|termination|convenience|default)\b", 0.5, (("array_contains(terms.actor, 'owner')", ("owner",), 0.4), ("contains(plan.normalized_query, 'convenience')", ("convenience",), 0.55))),
    "delay_schedule": (r"\b(?:delay|weather|completion|schedule|liquidated)\b", 0.5, (("contains(plan.normalized_query, 'weather')", ("weather",), 0.6),)),
}
BROAD = ("shall", "must", "required", "permit", "permits", "compliance", "testing", "test", "demonstrate", "environmental", "emissions?", "guarantees?", "limits?")

#: Signals, each from those before it. `attribute` also holds where a LABELS or an AttributeRule matched.
SIGNALS = {
    "in_system": f"{has('heading_n', 'system')} OR {has('parent_n', 'system')} OR {has('all_n', 'system')}",
    "exact": f"in_system OR {asked('words')} AND CASE WHEN {asked('telling')} THEN {hits('telling')} >= size(terms.telling) ELSE {hits('words')} >= greatest(1, least(size(terms.words), 2)) END",
    "quantities": count(QUANTITY, "low_body"),
    "attribute": " OR ".join(
        f"({x})" for x in (
            *(f"{has(f, 'attribute')}" for f in ("heading_n", "parent_n", "all_n")), *(f"{label(k)} AND {matches(p, 'low_body')}" for k, (p, _) in LABELS.items()), f"{label('type')} AND {matches(MODEL, 'body')}",
            f"{label('design_conditions')} AND ({matches(DESIGN, 'low_title')} OR {matches(DESIGN, 'low_body')} OR quantities >= 3 OR array_contains(terms.focus, 'site') AND contains(heading_n, ' site '))",
        )
    ),
    "concept": f"{asked('concept')} AND {hits('concept')} >= greatest(1, least(size(terms.concept), 2))",
    "in_scope": f"CASE WHEN {asked('named')} THEN {has('heading_n', 'named')} OR {has('parent_n', 'named')} ELSE {has('heading_n', 'scope')} OR {has('parent_n', 'scope')} END",
    "scope": f"{asked('scope')} AND (in_scope OR kind = 'exhibit' AND NOT {asked('named')})",
    "grouped": "plan.request_shape = 'grouped_list'",
    "broad": "plan.request_shape = 'broad_topic'",
}
_NAMED, _EXHIBIT = asked("named"), f"{asked('scope')} AND kind = 'exhibit'"

#: (weight, condition): counts once where the condition holds.
RULES = [
    # the system, its aliases, and what is asked of it
    (1.8, has("heading_n", "system")), (1.15, f"NOT {has('heading_n', 'system')} AND {has('parent_n', 'system')}"), (0.8, f"NOT {has('heading_n', 'system')} AND NOT {has('parent_n', 'system')} AND {has('all_n', 'system')}"),
    (0.55, f"{has('heading_n', 'aliases')} OR {has('parent_n', 'aliases')}"),
    *((w, f"{label(k)} AND {matches(p, 'low_body')}") for k, (p, w) in LABELS.items()),
    (0.75, f"{label('type')} AND {matches(MODEL, 'body')}"),
    (1.0, f"{label('design_conditions')} AND {matches(DESIGN, 'low_title')}"), (1.1, f"{label('design_conditions')} AND {matches(DESIGN, 'low_body')}"), (0.45, f"{label('design_conditions')} AND quantities >= 3"),
    (0.45, f"{label('design_conditions')} AND array_contains(terms.focus, 'site') AND contains(heading_n, ' site ')"),
    # concepts and scopes
    (1.1, has("heading_n", "concept")), (0.8, has("parent_n", "concept")),
    (1.25, f"{_NAMED} AND {has('heading_n', 'named')}"), (1.0, f"{_NAMED} AND {has('parent_n', 'named')}"), (1.2, f"NOT {_NAMED} AND {has('heading_n', 'scope')}"), (0.9, f"NOT {_NAMED} AND {has('parent_n', 'scope')}"),
    (0.35, _EXHIBIT), (0.15, f"{_EXHIBIT} AND {_NAMED} AND NOT in_scope AND ({has('heading_n', 'scope')} OR {has('parent_n', 'scope')})"),
    # limits and guarantees
    (0.9, f"plan.answer_family IS NOT NULL AND {matches(r'\bguarantee(?:s|d)?\b', 'low_whole')}"), (1.1, f"plan.answer_family IS NOT NULL AND {matches(r'\bshall not exceed\b|\bnot exceed\b|\blimits?\b', 'low_whole')}"),
    (0.95, f"plan.answer_family IS NOT NULL AND {matches(r'\b\d+(?:\.\d+)?\s*(?:ppmvd|ppmv|lb/hr|mg/nm3|%)', 'low_whole')}"),
    # places and words of the question
    (1.2, "section_number = plan.section_number"),
    (0.7, has("heading_n", "content")), (0.35, f"NOT {has('heading_n', 'content')} AND {has('parent_n', 'content')}"), (0.45, f"NOT {has('heading_n', 'content')} AND NOT {has('parent_n', 'content')} AND {has('body_n', 'content')}"),
    (0.75, has("heading_n", "focus")), (0.25, has("parent_n", "focus")), (0.8, has("heading_n", "doing")), (0.4, has("parent_n", "topic")), (0.9, has("all_n", "expansion")),
    (0.75, has("actor_n", "actor")), (0.65, has("action_n", "action")), (0.8, has("topic_n", "topic")), (0.45, has("topic_n", "concept")),
    # what goes together, and what is missing
    (1.25, "exact AND attribute"), (-0.95, "plan.system_phrase <> '' AND size(terms.attribute) > 0 AND exact <> attribute"), (-1.35, "plan.system_phrase <> '' AND size(terms.attribute) > 0 AND NOT exact AND NOT attribute"),
    (-1.05, "plan.system_phrase <> '' AND size(terms.attribute) = 0 AND NOT exact"), (-0.55, "plan.system_phrase = '' AND size(terms.attribute) > 0 AND NOT attribute"),
    (-1.2, "grouped AND NOT concept"), (-0.45, f"grouped AND {asked('scope')} AND NOT scope"), (-0.45, "broad AND NOT concept"), (-0.6, f"broad AND {asked('scope')} AND NOT scope"),
    # lists of terms, bare references and thin bodies
    (-1.45, f"broad AND {matches(r'\b(?:common acronyms|acronyms|abbreviations?)\b', 'low_title')}"),
    (-0.8, f"broad AND {matches(r'\b(?:defined as|definition|definitions?)\b', 'low_body')} AND NOT {matches(r'\b(?:shall|must|required|permit|compliance|testing|guarantee|limit)\b', 'low_body')}"),
    (-0.9, "broad AND kind = 'exhibit' AND thin_body"), (-0.75, f"broad AND {matches(r'^(?:appendix|attachment|exhibit)\s+[a-z0-9.\-]+$', 'trim(low_title)')}"),
    (-0.45, "contains(heading, '....')"), (-0.45, f"page_start <= 20 AND {count(r'\.\.\.\.', 'body')} >= 3"), (-0.75, "array_contains(flags, 'date_heading')"), (-0.2, "array_contains(flags, 'thin')"), (-0.55, "trim(section_number) = '0'"),
    (-2.5, "thin AND (plan.system_phrase <> '' OR plan.attribute_label IS NOT NULL OR plan.count_question OR plan.direct_text_question OR grouped)"),
    # intents
    (1.0, "plan.intent = 'definition' AND kind = 'definition'"), *((w, f"plan.intent = '{k}' AND {matches(p, 'low_body')}") for k, (p, w, _) in INTENTS.items()),
    *((-w, f"plan.intent = '{k}' AND {matches(p, 'low_body')} AND {need} AND NOT ({' OR '.join(f"contains(all_n, ' {t} ')" for t in terms)})") for k, (p, _, misses) in INTENTS.items() for need, terms, w in misses),
    (-0.45, f"plan.intent = 'payment_liability' AND {matches(INTENTS['payment_liability'][0], 'low_body')} AND {asked('expansion')} AND NOT {has('all_n', 'expansion')}"),
]

#: (weight, number, most or None): the weight for each, up to `most` in all.
COUNTED = [
    (0.22, hits("words"), None), (0.34, hits("telling"), None), (0.28, hits("concept"), 1.4), (0.16, hits("focus"), None), (0.18, hits("subject"), None), (0.12, hits("context"), None),
    (0.95, "size(filter(phrases.attribute, t -> contains(heading_n, t) OR contains(parent_n, t)))", None), (0.45, "size(filter(phrases.attribute, t -> NOT contains(heading_n, t) AND NOT contains(parent_n, t) AND contains(all_n, t)))", None),
    (0.55, "size(filter(phrases.pairs, t -> contains(heading_n, t)))", None), (0.35, "size(filter(phrases.pairs, t -> NOT contains(heading_n, t) AND contains(parent_n, t)))", None),
    (0.25, f"if({label('power')}, {count(r'\b\d+(?:\.\d+)?\s*(?:hp|kw|kilowatts?)\b', 'low_body')}, 0)", 0.9), (0.22, f"if({label('design_conditions')}, quantities, 0)", 1.1),
    (0.1, f"if(broad, {' + '.join(f"2 * int({matches(rf'\b{x}\b', 'low_whole')})" for x in BROAD)} + int(kind = 'exhibit'), 0)", 1.6),
]

#: Bundles: (part, weight, condition or number over the bundle's text and its rows).
SUPPORTS = {
    "design_conditions": (DESIGN, 0.45),
    "configuration": (r"\bconfiguration\b|\bconfigured\b|\barrangement\b|\bduplex\b|\bredun|\bstandby\b|\blead\b|\blag\b", 0.42),
    "type": (r"\bmodel\b|\btype\b|\bselected\b|\bmanufacturer\b|\bvendor\b", 0.42),
    "function": (r"\b(?:receives|supplies|provides|distributes|conditions|transports|serves|operates)\b", 0.35),
}
_IN = "size(filter(raw.{}, t -> contains(low_bundle, t)))"
BINDING = [
    ("system", 0.55, "int(plan.system_phrase <> '' AND contains(low_bundle, plan.system_phrase))"), ("system", 0.12, _IN.format("words")), ("system", 0.18, _IN.format("telling")),
    ("attribute", 0.1, _IN.format("attribute")), *(("attribute", w, f"int({label(k)} AND {matches(p, 'low_bundle')})") for k, (p, w) in SUPPORTS.items()),
    ("attribute", 0.3, f"int(plan.attribute_label IN ('pressure', 'temperature', 'flow', 'size', 'capacity', 'power') AND {matches(r'\b\d', 'low_bundle')})"),
    ("support", 0.08, "int(has_parent)"), ("support", 0.15, "int(has_child)"), ("support", 0.12, "int(n_rows > 1 AND n_pages = 1)"),
    ("support", 0.18, f"int(plan.answer_family IS NOT NULL AND {matches(r'\bguarantee\b|\bshall not exceed\b|\bnot exceed\b|\blimits?\b', 'low_bodies')})"),
]
# --------------------------------------------------------------------------------------------------------------------------------------


def plan_rows(spark: SparkSession, plans: dict[str, Plan], dimension: int = vectors.DIMENSION) -> DataFrame:
    """(question_id, plan, phrases, terms, raw, query_vector): a row for each question; term groups padded as phrases, lower-cased, and as they are."""
    arrays = ", ".join(f"{g}: array<string>" for g in GROUPS)
    kinds = ", ".join([*(f"{k}: string" for k in _FACTS), *(f"{k}: boolean" for k in _FLAGS)])
    rows = []
    for q, p in plans.items():
        groups = [[t for t in of(p) if t] for of in GROUPS.values()]
        facts = tuple([*(getattr(p, k) or (None if k in ("section_number", "answer_family", "attribute_label") else "") for k in _FACTS), *(getattr(p, k) for k in _FLAGS)])
        rows.append((q, facts, tuple([f" {T.norm_py(t)} " for t in g] for g in groups), tuple([t.lower() for t in g] for g in groups), tuple(groups), vectors.embed_py(p.raw_query, dimension)))
    return spark.createDataFrame(rows, f"question_id string, plan struct<{kinds}>, phrases struct<{arrays}>, terms struct<{arrays}>, raw struct<{arrays}>, query_vector array<double>")


def low_content(text: Column, section: Column) -> Column:
    """A body of two words and less, or of its section number alone."""

    def rule(body: Column) -> Column:
        return (body == "") | ((F.coalesce(section, F.lit("")) != "") & (body == F.regexp_replace(F.coalesce(section, F.lit("")), r"^\.+|\.+$", ""))) | (F.size(T.tokens(body, "query")) <= 2)

    return T.let(F.regexp_replace(T.clean(text), r"^\.+|\.+$", ""), rule)


def weigh(rules: list[tuple[float, str]], counted: list[tuple[float, str, float | None]]) -> Column:
    """The sum of the rules that hold and of the counts."""
    parts = [f"if(coalesce({c}, false), {w!r}D, 0D)" for w, c in rules]
    for w, n, most in counted:
        value = f"{w!r}D * coalesce({n}, 0)"
        parts.append(value if most is None else f"least({most!r}D, {value})")
    return F.expr(" + ".join(f"({x})" for x in parts))


def score_rows(rows: DataFrame, plans: DataFrame, lexical: Column, semantic: Column) -> DataFrame:
    """rows (question_id, chunk and feature columns) with row_score: RULES and COUNTED over heading, parent heading, body and tags. JVM only;
    plans, a row for each question, are broadcast."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    tags = [text(f"{k}_tags") for k in ("actor", "action", "topic")]
    pad = lambda c: F.concat(F.lit(" "), T.norm(c), F.lit(" "))
    everything = F.concat_ws(" ", text("heading"), text("parent_heading"), text("full_text"), *tags)
    views = {
        "body": text("full_text"), "heading_n": pad(text("heading")), "parent_n": pad(text("parent_heading")), "body_n": pad(text("full_text")), "all_n": pad(everything), "low_all": F.lower(everything),
        "low_body": F.lower(text("full_text")), "low_title": F.lower(F.concat_ws(" ", text("heading"), text("parent_heading"))), "low_whole": F.lower(F.concat_ws(" ", text("heading"), text("parent_heading"), text("full_text"))),
        "actor_n": pad(tags[0]), "action_n": pad(tags[1]), "topic_n": pad(tags[2]), "kind": F.coalesce(F.when(F.col("clause_type") != "", F.col("clause_type")), F.col("chunk_type"), F.lit("")),
        "flags": F.split(text("noise_flags"), r"\s+"), "thin": low_content(text("full_text"), F.col("section_number")), "thin_body": low_content(text("full_text"), F.lit("")),
    }
    out = rows.join(F.broadcast(plans.drop("query_vector", "raw")), "question_id").withColumns(views)  # plans: a row for each question
    for name, condition in SIGNALS.items():
        out = out.withColumn(name, F.coalesce(F.expr(condition), F.lit(0 if name == "quantities" else False)))
    score = weigh(RULES, COUNTED) + 0.55 * lexical + 0.15 * semantic
    return out.withColumn("row_score", score).drop(*views, *SIGNALS, "plan", "phrases", "terms")


def score_bundles(rows: DataFrame, plans: DataFrame, dimension: int = vectors.DIMENSION) -> DataFrame:
    """(question_id, primary_id, bundle_score, confidence) from scored rows (question_id, primary_id, at, score, row_score, chunk columns), of
    which the one at 0 is the primary. A bundle is a few dozen rows at most; its text is embedded in Arrow batches, the rest stays JVM-side."""
    first = F.col("at") == 0
    own = lambda c: F.max(F.when(first, c))
    line = F.concat_ws(" ", F.coalesce("heading", F.lit("")), F.coalesce("full_text", F.lit("")))
    b = rows.groupBy("question_id", "primary_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "chunk_id", line.alias("line"), F.coalesce("full_text", F.lit("")).alias("body")))).alias("parts"), F.max("row_score").alias("best"), own(F.col("score")).alias("own_score"),
        own((F.col("chunk_type") == "exhibit").cast("int")).alias("own_exhibit"), own(low_content(F.coalesce("full_text", F.lit("")), F.col("section_number")).cast("int")).alias("own_thin"),
        F.max(F.coalesce(F.col("parent_chunk_id"), F.lit("")) != "").alias("has_parent"), F.max(~first & F.coalesce(F.col("parent_chunk_id") == F.col("primary_id"), F.lit(False))).alias("has_child"),
        F.count("*").alias("n_rows"), F.size(F.collect_set("page_start")).alias("n_pages"),
    )
    b = b.withColumn("bundle_text", F.array_join(F.transform("parts", lambda x: x["line"]), " ")).withColumn("low_bodies", F.lower(F.array_join(F.transform("parts", lambda x: x["body"]), " "))).drop("parts")
    b = vectors.embed(b, "bundle_text", dimension, "bundle_vector", spread=False).withColumn("low_bundle", F.lower("bundle_text"))
    b = b.join(F.broadcast(plans), "question_id").withColumn("cosine", vectors.dot(F.col("query_vector"), F.col("bundle_vector")))
    parts = {k: F.expr(" + ".join(f"{w!r}D * coalesce({n}, 0)" for part, w, n in BINDING if part == k)) for k in ("system", "attribute", "support")}
    b = b.withColumns({f"b_{k}": v for k, v in parts.items()})
    total = 0.22 * F.col("best") + 0.18 * F.col("own_score") + 1.35 * F.col("cosine") + F.col("b_system") + F.col("b_attribute") + F.col("b_support") + 0.15 * F.col("own_exhibit") - 0.4 * F.col("own_thin")
    sure = 0.46 + 0.35 * F.col("cosine") + 0.08 * (F.col("b_system") > 0).cast("int") + 0.08 * (F.col("b_attribute") > 0).cast("int") + 0.05 * (F.col("b_support") > 0).cast("int")
    return b.select("question_id", "primary_id", total.alias("bundle_score"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence"))
