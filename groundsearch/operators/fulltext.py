"""Full-text search: postings, phrase expressions, BM25, snippets and LIKE."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundsearch.functions import text as T
from groundsearch.sources.scratch import stored

#: Weights of the feature index's fields.
FEATURE_WEIGHTS = {"section_number": 10.0, "heading": 7.0, "parent_heading": 4.0, "search_text": 1.2, "actor_tags": 4.0, "action_tags": 4.0, "topic_tags": 4.0}
CHUNK_WEIGHTS = {"section_number": 5.0, "heading": 3.0, "full_text": 1.0}
PAGE_WEIGHTS = {"page_text": 1.0}
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Phrase:
    """Consecutive terms in one field, or in any."""

    text: str
    fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


def leaves(expression) -> list[Phrase]:
    return [expression] if isinstance(expression, Phrase) else [x for p in expression.parts for x in leaves(p)]


def terms_of(*expressions) -> list[str]:
    """The different terms of the expressions."""
    return sorted({t for e in expressions for p in leaves(e) for t in T.fts_tokens_py(p.text)})


def postings(rows: DataFrame, key: str, fields: list[str], terms: list[str] | None = None) -> DataFrame:
    """(key, field, term, positions, tf) of the rows' fields: the inverted index. Partition it by term when writing it.

    terms, if given, are all that is wanted, as for a stated query over texts without an index: others end where they are read, and a row's
    postings are made within the row.
    """
    cols = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("text")) for f in fields])
    texts = rows.select(key, F.explode(cols).alias("c"))
    if terms is not None:
        wanted = lambda h: h["term"].isin(terms) if terms else F.lit(False)
        hits = F.filter(F.transform(T.fts_tokens(F.col("c.text")), lambda t, i: F.struct(t.alias("term"), i.alias("pos"))), wanted)
        places = lambda hs, t: F.transform(F.filter(hs, lambda h: h["term"] == t), lambda h: h["pos"])
        each = T.let(hits, lambda hs: F.transform(F.array_distinct(F.transform(hs, lambda h: h["term"])), lambda t: F.struct(t.alias("term"), places(hs, t).alias("positions"))))
        return texts.select(key, "c.field", F.explode(each).alias("p")).select(key, "field", "p.term", "p.positions", F.size("p.positions").cast("long").alias("tf"))
    tokens = texts.select(key, "c.field", F.posexplode(T.fts_tokens(F.col("c.text"))).alias("pos", "term"))
    return tokens.groupBy(key, "field", "term").agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.count("*").alias("tf"))


def doc_lengths(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, n_tokens): tokens of all indexed fields together."""
    n = sum((F.size(T.fts_tokens(F.coalesce(F.col(f).cast("string"), F.lit("")))) for f in fields), F.lit(0))
    return rows.select(key, n.alias("n_tokens"))


def search(index: DataFrame, lengths: DataFrame, passes: list[tuple[str, object, int]], key: str, weights: dict[str, float]) -> DataFrame:
    """(pass_id, key, score, rank) of each pass (id, expression, limit): rows that match it, best BM25 first (scores are negative).

    All passes run as one plan over the postings of their terms: each different leaf is joined by term (an equality on the index's order,
    against a table with a row for each query term) once, phrases count the starts at which all their terms meet, and one aggregation per
    row evaluates every expression. Corpus figures are of the whole index.
    """
    spark = index.sparkSession
    known: dict[tuple, int] = {}
    uses, shape = [], {}
    for pass_id, expression, _ in passes:
        shape[pass_id] = expression
        for number, leaf in enumerate(leaves(expression)):
            what = tuple(T.fts_tokens_py(leaf.text)), tuple(f for f in (leaf.fields or tuple(weights)) if f in weights)
            uses.append((pass_id, number, known.setdefault(what, len(known))))
    one = [(leaf, terms[0], f) for (terms, fs), leaf in known.items() if len(terms) == 1 for f in fs]
    many = [(leaf, len(terms), k, t, f) for (terms, fs), leaf in known.items() if len(terms) > 1 for k, t in enumerate(terms) for f in fs]
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    # the broadcast tables have a row for each term, or leaf, of the stated passes
    single = index.join(F.broadcast(spark.createDataFrame(one, "leaf int, term string, field string")), ["term", "field"])
    tf = single.select("leaf", key, (F.element_at(weight, F.col("field")) * F.col("tf")).alias("f"))
    if many:
        hits = index.join(F.broadcast(spark.createDataFrame(many, "leaf int, n_terms int, at int, term string, field string")), ["term", "field"])
        starts = hits.select("leaf", "n_terms", key, "field", F.explode(F.transform("positions", lambda p: p - F.col("at"))).alias("start"))
        whole = starts.groupBy("leaf", key, "field", "start", "n_terms").agg(F.count("*").alias("have")).where("have = n_terms")
        tf = tf.unionByName(whole.select("leaf", key, F.element_at(weight, F.col("field")).alias("f")))
    tf = stored(tf.groupBy("leaf", key).agg(F.sum("f").alias("f")), "leaf-matches")  # counted and scored: found once
    matches = tf.groupBy("leaf").agg(F.count("*").cast("double").alias("n_match"))
    corpus = lengths.agg(F.count("*").cast("double").alias("n_rows"), F.avg("n_tokens").alias("avg_tokens"))
    scored = tf.join(F.broadcast(matches), "leaf").join(lengths, key).join(F.broadcast(corpus), F.lit(True))  # a row for each leaf; one row
    idf = F.log((F.col("n_rows") - F.col("n_match") + 0.5) / (F.col("n_match") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n_tokens") / F.col("avg_tokens")))
    used = F.broadcast(spark.createDataFrame(uses, "pass_id string, number int, leaf int"))
    flat = scored.select("leaf", key, part.alias("part")).join(used, "leaf").groupBy("pass_id", key).agg((-F.sum("part")).alias("score"), F.collect_set("number").alias("have"))
    cases = [F.when(F.col("pass_id") == p, _holds(shape[p], iter(range(len(leaves(shape[p])))))) for p in shape]
    limit = F.create_map(*[F.lit(x) for p, _, n in passes for x in (p, n)])
    order = Window.partitionBy("pass_id").orderBy(F.round("score", 9), key)
    out = flat.where(F.coalesce(*cases, F.lit(False))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(n for _, _, n in passes))  # known before the rows move
    return out.where(F.col("rank") <= F.element_at(limit, F.col("pass_id"))).select("pass_id", key, "score", "rank")


def _holds(expression, numbers) -> Column:
    if isinstance(expression, Phrase):
        return F.array_contains("have", F.lit(next(numbers)))
    parts = [_holds(p, numbers) for p in expression.parts]
    out = parts[0] if parts else F.lit(False)
    for p in parts[1:]:
        out = out & p if isinstance(expression, And) else out | p
    return out


def scan_search(rows: DataFrame, key: str, expression, weights: dict[str, float], limit: int) -> DataFrame:
    """search() of one expression without an index, from the texts themselves: for small corpora, and to check the index against."""
    phrases = leaves(expression)
    fields = {f: T.fts_tokens(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in weights}
    base = rows.select(key, *[c.alias(f"t_{f}") for f, c in fields.items()])

    def count(field: str, terms: list[str]) -> Column:
        want = F.array(*map(F.lit, terms))
        t = F.col(f"t_{field}")
        at = F.when(F.size(t) >= len(terms), F.sequence(F.lit(1), F.size(t) - len(terms) + 1)).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(at, lambda i: F.slice(t, i, len(terms)) == want)).cast("double")

    cols = {}
    for k, p in enumerate(phrases):
        terms = T.fts_tokens_py(p.text)
        cols[f"f_{k}"] = sum((count(f, terms) * w for f, w in weights.items() if not p.fields or f in p.fields), F.lit(0.0)) if terms else F.lit(0.0)
    base = base.select(key, sum((F.size(f"t_{f}") for f in weights), F.lit(0)).alias("n_tokens"), *[c.alias(k) for k, c in cols.items()])
    stats = base.agg(F.count("*").cast("double").alias("n_rows"), F.avg("n_tokens").alias("avg_tokens"), *[F.count_if(F.col(k) > 0).cast("double").alias(f"n_{k}") for k in cols])
    both = base.join(F.broadcast(stats), F.lit(True))  # one row
    score = F.lit(0.0)
    for k in cols:
        idf = F.log((F.col("n_rows") - F.col(f"n_{k}") + 0.5) / (F.col(f"n_{k}") + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        score = score - F.when(F.col(k) > 0, idf * F.col(k) * (K1 + 1) / (F.col(k) + K1 * (1 - B + B * F.col("n_tokens") / F.col("avg_tokens")))).otherwise(0.0)
    have = F.array_compact(F.array(*[F.when(F.col(k) > 0, F.lit(i)) for i, k in enumerate(cols)]))
    hits = both.withColumns({"score": score, "have": have}).where(_holds(expression, iter(range(len(phrases)))))
    return hits.orderBy(F.round("score", 9), key).limit(limit).select(key, "score")


def snippet(text: Column, terms: list[str], most: int = 28) -> Column:
    """A part of at most `most` words with the densest hits of the terms; hits stand in [ ], cuts are marked by dots."""
    hit = lambda w: F.exists(F.array(*map(F.lit, terms)), lambda t: F.array_contains(T.fts_tokens(w), t))

    def cut(words: Column) -> Column:  # of structs: word, whether it is a hit
        n = F.size(words)
        at = F.sequence(F.lit(1), F.greatest(n - most + 1, F.lit(1)))
        counted = F.transform(at, lambda i: F.struct(F.size(F.filter(F.slice(words, i, most), lambda w: w["h"])).alias("c"), (-i).alias("i")))
        return T.let(-F.array_max(counted)["i"], lambda best: shown(words, n, best))

    def shown(words: Column, n: Column, best: Column) -> Column:
        body = F.array_join(F.transform(F.slice(words, best, most), lambda w: F.when(w["h"], F.concat(F.lit("["), w["w"], F.lit("]"))).otherwise(w["w"])), " ")
        return F.concat(F.when(best > 1, "...").otherwise(""), body, F.when(best + most - 1 < n, "...").otherwise(""))

    return T.let(F.transform(F.split(T.clean(text), " "), lambda w: F.struct(w.alias("w"), hit(w).alias("h"))), cut)


LIKE_FIELDS = ("heading", "full_text", "section_number", "parent_heading", "search_text", "topic_tags")


def like_search(rows: DataFrame, text: str, limit: int, fields: tuple[str, ...] = LIKE_FIELDS, order: str = "ordinal_in_document") -> DataFrame:
    """Rows with the text somewhere in one of the fields, any case; % and _ in the text are wildcards. In document order, with a snippet."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.col(f).ilike(f"%{text}%"), F.lit(False))
    return rows.where(hit).orderBy(order).limit(limit).withColumn("snippet", F.substring("full_text", 1, 240) if "full_text" in rows.columns else F.lit(None))


def like_search_many(rows: DataFrame, wanted: list[tuple[str, str, int]], key: str = "chunk_id", fields: tuple[str, ...] = LIKE_FIELDS, order: str = "ordinal_in_document") -> DataFrame:
    """like_search() for (id, text, limit) triples in one scan: (id, key, rank)."""
    cases = []
    for i, t, n in wanted:  # literal patterns, each compiled once
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.col(f).ilike(f"%{t}%"), F.lit(False))
        cases.append(F.when(hit, F.struct(F.lit(i).alias("id"), F.lit(n).alias("limit"))))
    found = rows.select(key, order, F.explode(F.array_compact(F.array(*cases))).alias("p")).select("p.id", "p.limit", key, order).distinct()
    w = Window.partitionBy("id").orderBy(order, key)
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(n for _, _, n in wanted))  # known before the rows move
    return found.where("rank <= limit").select("id", key, "rank")
