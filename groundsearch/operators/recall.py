"""Recall, fusion, evidence bundles and ranking of chunks for questions."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundsearch.functions import text as T
from groundsearch.operators import corpus as C
from groundsearch.operators import fulltext, planner, vectors
from groundsearch.operators.planner import KEEP_MERGED, KEEP_MERGED_WIDE, KEEP_PER_SOURCE, Plan
from groundsearch.operators.scoring import low_content, plan_rows, score_bundles, score_rows
from groundsearch.sources.scratch import stored

# fixed values: weights of what recall sources give a chunk
W_SEMANTIC, W_LEXICAL, SECTION_BONUS, THIN_PENALTY = 0.62, 0.38, 0.75, 0.15


def recall_score(lexical: Column, semantic: Column, bonus: Column, same_section: Column, low_content: Column) -> Column:
    """What a recall source gives a chunk."""
    return W_SEMANTIC * semantic + W_LEXICAL * lexical + bonus + F.when(same_section, SECTION_BONUS).otherwise(0.0) - F.when(low_content, THIN_PENALTY).otherwise(0.0)


def low_content_py(text: str, section: str | None) -> bool:
    body = " ".join(text.split()).strip(".")
    return not body or bool(section) and body == section.strip().strip(".") or len(T.tokens_py(body)) <= 2


def merge(candidates: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """(question_id, chunk_id, score, semantic, sources, rank): each chunk once, with its best score and the names of its sources.

    keep (question_id, keep), if given, bounds the ranks of each question.
    """
    order = F.struct("score", "semantic")
    m = candidates.groupBy("question_id", "chunk_id").agg(F.max("score").alias("score"), F.max_by("semantic", order).alias("semantic"), F.array_sort(F.collect_set("source")).alias("sources"))
    w = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    m = m.withColumn("rank", F.row_number().over(w))
    return m if keep is None else m.join(F.broadcast(keep), "question_id").where("rank <= keep").drop("keep")  # a row for each question


def per_source_top(candidates: DataFrame, most: int = KEEP_PER_SOURCE) -> DataFrame:
    """The best candidates of each source of each question, for the trace."""
    w = Window.partitionBy("question_id", "source").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return candidates.withColumn("source_rank", F.row_number().over(w)).where(F.col("source_rank") <= most)


def interleave(bundles: DataFrame, most: int) -> DataFrame:
    """(question_id, chunk_id, position) from (question_id, bundle_rank, depth, chunk_id): all bundles' first chunks, then their second, ...
    each chunk once, `most` for each question."""
    first = bundles.groupBy("question_id", "chunk_id").agg(F.min(F.struct("depth", "bundle_rank")).alias("at"))
    w = Window.partitionBy("question_id").orderBy("at", "chunk_id")
    return first.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).select("question_id", "chunk_id", "position")


def distinct_locations(citations: DataFrame, most: int) -> DataFrame:
    """The first citation of each (section, first page, last page) of a question, `most` for each: (question_id, rank, section_number,
    page_start, page_end, ...)."""
    w = Window.partitionBy("question_id", "section_number", "page_start", "page_end").orderBy("rank")
    c = citations.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    return c.withColumn("position", F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))).where(F.col("position") <= most)


def covering_citations(citations: Column, most: int = 5) -> Column:
    """An array of (first, last, ...) citations without those all of whose pages are covered by earlier ones; `most` of them."""
    kind = "array<int>"

    def step(acc: Column, c: Column) -> Column:
        pages = F.sequence(c["first"], F.greatest(c["first"], c["last"]))
        fresh = (F.size(F.array_except(pages, acc["seen"])) > 0) & (F.size(acc["kept"]) < most)
        return F.struct(F.when(fresh, F.array_union(acc["seen"], pages)).otherwise(acc["seen"]).alias("seen"), F.when(fresh, F.concat(acc["kept"], F.array(c))).otherwise(acc["kept"]).alias("kept"))

    start = F.struct(F.array().cast(kind).alias("seen"), F.slice(citations, 1, 0).alias("kept"))
    return F.aggregate(citations, start, step, lambda a: a["kept"])


def context_enrichment(chunks: DataFrame, primary: DataFrame, radius: int = 2, most: int = 6) -> DataFrame:
    """(chunk_id, other, role, position) for primary chunks (chunk_id, document_id, ordinal_in_document, chunk_type): the parent, the chunk
    itself, neighbours in document order, and for a section its first children; each chunk once, `most` of them."""
    near = C.neighbours(chunks, primary, radius).where("distance <> 0")
    kids = C.children(chunks, 6).join(primary.where("chunk_type = 'section'").select("chunk_id"), "chunk_id", "left_semi")
    parts = (
        C.parents(chunks).join(primary.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "other", F.lit("parent").alias("role"), F.lit(0).alias("at")),
        primary.select("chunk_id", F.col("chunk_id").alias("other"), F.lit("primary").alias("role"), F.lit(1).alias("at")),
        near.select("chunk_id", "other", F.lit("neighbour").alias("role"), (F.col("distance") + 20).alias("at")),
        kids.select("chunk_id", "other", F.lit("child").alias("role"), (F.col("rank") + 50).alias("at")),
    )
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    first = every.join(chunks.select(F.col("chunk_id").alias("other")), "other", "left_semi").groupBy("chunk_id", "other").agg(F.min_by("role", "at").alias("role"), F.min("at").alias("at"))
    w = Window.partitionBy("chunk_id").orderBy("at", "other")
    return first.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).drop("at")


def with_parents(ranked: DataFrame, chunks: DataFrame, most: int = 5, of_first: int = 6) -> DataFrame:
    """(question_id, chunk_id, position): ranked chunks (question_id, chunk_id, rank), then the parents of the first `of_first` that are not
    among them, `most` in all."""
    up = ranked.where(F.col("rank") <= of_first).join(C.parents(chunks), "chunk_id").select("question_id", F.col("other").alias("chunk_id"), (F.col("rank") + 100_000).alias("rank"))
    every = ranked.select("question_id", "chunk_id", "rank").unionByName(up).groupBy("question_id", "chunk_id").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("question_id").orderBy("rank", "chunk_id")
    return every.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).select("question_id", "chunk_id", "position")


def trace(plans: dict[str, Plan], candidates: DataFrame, merged: DataFrame, bundles: DataFrame) -> DataFrame:
    """(question_id, plan, recall_sources, merged_ranking, bundles): how each question's evidence was found; plan as JSON, recall_sources a
    map from source to its best chunks. Full-text hits of the question and of the plan's hints are sources of their own."""
    group = F.when(F.col("source").startswith("hint:"), "planner_hints").otherwise(F.col("source"))
    top = per_source_top(candidates.withColumn("source", group).groupBy("question_id", "source", "chunk_id").agg(F.max("score").alias("score")))
    listed = top.groupBy("question_id", "source").agg(F.array_sort(F.collect_list(F.struct("source_rank", "chunk_id", "score"))).alias("hits"))
    sources = listed.groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("source", "hits"))).alias("recall_sources"))
    ranking = merged.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score", "sources"))).alias("merged_ranking"))
    found = bundles.where("is_primary").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("bundle_rank", F.col("primary_id").alias("chunk_id"), "bundle_score", "confidence"))).alias("bundles"))
    asked = candidates.sparkSession.createDataFrame([(q, json.dumps(asdict(p))) for q, p in plans.items()], "question_id string, plan string")
    return asked.join(sources, "question_id", "left").join(ranking, "question_id", "left").join(found, "question_id", "left")


class Retriever:
    """Retrieval over a corpus for a stated set of questions.

    index (postings, lengths) is the feature index; without postings, or without an index, those of the questions' terms are made for each set
    of questions. rows are the chunks with their features, where they are stored joined. What a step finds for the questions is a few rows
    for each: it is stored, so that the corpus is read once for a step, and joins with the corpus broadcast it.
    """

    def __init__(
        self, chunks: DataFrame, features: DataFrame, embeddings: DataFrame, facts: DataFrame | None, pages: DataFrame, index: tuple[DataFrame | None, DataFrame] | None = None,
        dimension: int = vectors.DIMENSION, rows: DataFrame | None = None,
    ):
        self.rows = C.with_features(chunks, features) if rows is None else rows
        self.chunks, self.features, self.embeddings, self.facts, self.pages, self.dimension = chunks, features, embeddings, facts, pages, dimension
        self.postings, self.lengths = index or (None, fulltext.doc_lengths(features, "chunk_id", list(fulltext.FEATURE_WEIGHTS)))

    def _postings(self, passes: list[tuple[str, object, int]]) -> DataFrame:
        if self.postings is not None:
            return self.postings
        return stored(fulltext.postings(self.features, "chunk_id", list(fulltext.FEATURE_WEIGHTS), fulltext.terms_of(*(e for _, e, _ in passes))), "postings")

    def candidates(self, plans: dict[str, Plan], deep: bool = False) -> DataFrame:
        """(question_id, chunk_id, source, lexical, semantic, bonus, score) from all sources: section, the question's own words, the plan's
        passes, LIKE, and vectors. Full-text ranks decide which chunks are in, and weigh the same once they are."""
        spark = self.chunks.sparkSession
        passes, names = [], []
        for q, p in plans.items():
            profile = planner.profile_for(p, deep)
            raw = planner.raw_pass(p.raw_query)
            todo = [("raw_fts", raw, 0.0, KEEP_PER_SOURCE)] if raw is not None else []
            todo += [(f"hint:{n}", e, min(b, 0.8) * 0.2, profile.fts) for n, e, b in planner.search_passes(p, profile)]
            for k, (name, e, bonus, limit) in enumerate(todo):
                passes.append((f"{q}|{k}", e, limit))
                names.append((f"{q}|{k}", q, name, bonus))
        out = []
        if passes:
            hit = fulltext.search(self._postings(passes), self.lengths, passes, "chunk_id", fulltext.FEATURE_WEIGHTS)
            named = F.broadcast(spark.createDataFrame(names, "pass_id string, question_id string, source string, bonus double"))  # a row for each pass
            out.append(hit.join(named, "pass_id").select("question_id", "chunk_id", "source", F.lit(1.0).alias("lexical"), F.lit(0.0).alias("semantic"), "bonus"))
        sections = [(q, p.section_number) for q, p in plans.items() if p.section_number]
        if sections:
            s = F.broadcast(spark.createDataFrame(sections, "question_id string, section_number string"))  # a row for each question
            out.append(self.chunks.join(s, "section_number").select("question_id", "chunk_id", F.lit("section_lookup").alias("source"), F.lit(1.0).alias("lexical"), F.lit(0.85).alias("semantic"), F.lit(0.9).alias("bonus")))
        likes = [(q, t, planner.profile_for(p, deep).keyword) for q, p in plans.items() for t in planner.like_passes(p, planner.profile_for(p, deep))]
        if likes:
            numbered = [(str(k), t, n) for k, (_, t, n) in enumerate(likes)]
            asked_by = F.broadcast(spark.createDataFrame([(str(k), q) for k, (q, _, _) in enumerate(likes)], "id string, question_id string"))  # a row for each text
            hit = fulltext.like_search_many(self.rows, numbered).join(asked_by, "id")
            out.append(hit.select("question_id", "chunk_id", F.lit("keyword").alias("source"), F.lit(0.2).alias("lexical"), F.lit(0.0).alias("semantic"), F.lit(0.0).alias("bonus")))
        vectors_ = spark.createDataFrame([(q, vectors.embed_py(p.raw_query, self.dimension)) for q, p in plans.items()], "query_id string, vector array<double>")
        near = vectors.nearest(vectors_, self.embeddings, planner.NORMAL.semantic, "chunk_id")
        out.append(near.select(F.col("query_id").alias("question_id"), "chunk_id", F.lit("semantic").alias("source"), F.lit(0.0).alias("lexical"), F.col("score").alias("semantic"), F.lit(0.0).alias("bonus")))
        c = out[0]
        for x in out[1:]:
            c = c.unionByName(x)
        asked = spark.createDataFrame([(q, p.section_number) for q, p in plans.items()], "question_id string, asked string")
        about = self.chunks.select("chunk_id", "section_number", low_content(F.col("full_text"), F.col("section_number")).alias("low"))  # texts stay where they are
        c = c.join(F.broadcast(asked), "question_id").join(about, "chunk_id")  # asked: a row for each question
        score = recall_score(F.col("lexical"), F.col("semantic"), F.col("bonus"), F.coalesce(F.col("section_number") == F.col("asked"), F.lit(False)), F.col("low"))
        return c.select("question_id", "chunk_id", "source", "lexical", "semantic", "bonus", score.alias("score"))

    def bundles(self, plans: dict[str, Plan], merged: DataFrame, deep: bool = False) -> DataFrame:
        """(question_id, bundle_rank, primary_id, bundle_score, confidence, depth, chunk_id, score, semantic, is_primary, chunk columns).

        A bundle is a merged chunk with its parent, four children, neighbours and six chunks of its pages (of an exhibit twelve, to four
        pages on): unions of equi-joins. Its chunks are scored by the rule tables of scoring.py, as columns; the best 8 (10) bundles of a
        question stay.
        """
        m = merged.select("question_id", F.col("chunk_id").alias("primary_id"), "score", "semantic")
        me = self.chunks.select(F.col("chunk_id").alias("primary_id"), "document_id", "ordinal_in_document", "chunk_type", "page_start", "page_end")
        wanted = stored(me.join(F.broadcast(m.select("primary_id").distinct()), "primary_id"), "primary")  # the merged chunks, a few dozen for each question
        primary = wanted.select(F.col("primary_id").alias("chunk_id"), "document_id", "ordinal_in_document")
        exhibit = F.col("chunk_type") == "exhibit"
        spans = wanted.select(F.col("primary_id").alias("key"), "document_id", F.col("page_start").alias("first"), F.when(exhibit, F.col("page_end") + 4).otherwise(F.col("page_end")).alias("last"))
        only = primary.select("chunk_id")
        pages = C.page_overlap(self.chunks, spans, 12).join(wanted.select(F.col("primary_id").alias("key"), exhibit.alias("ex")), "key").where("ex OR rank <= 6")
        related = (
            primary.select("chunk_id", F.col("chunk_id").alias("other"), F.lit(0).alias("at"))
            .unionByName(C.parents(self.chunks).join(only, "chunk_id").withColumn("at", F.lit(1)))
            .unionByName(C.children(self.chunks.join(F.broadcast(only.withColumnRenamed("chunk_id", "parent_chunk_id")), "parent_chunk_id", "left_semi"), 4).select("chunk_id", "other", (F.col("rank") + 1).alias("at")))
            .unionByName(C.neighbours(self.chunks, primary, 1).where("distance <> 0").select("chunk_id", "other", (F.col("distance") + 7).alias("at")))
            .unionByName(pages.select(F.col("key").alias("chunk_id"), F.col("chunk_id").alias("other"), (F.col("rank") + 20).alias("at")))
        )
        related = related.groupBy("chunk_id", "other").agg(F.min("at").alias("at")).select(F.col("chunk_id").alias("primary_id"), F.col("other").alias("chunk_id"), "at")
        related = stored(m.join(related, "primary_id"), "related")
        joined = self.rows.join(F.broadcast(related), "chunk_id")  # a bundle's chunks, a few dozen for each merged one
        own = F.col("chunk_id") == F.col("primary_id")
        limit, asked = (planner.DEEP if deep else planner.NORMAL).results, plan_rows(self.chunks.sparkSession, plans, self.dimension)
        joined = joined.withColumn("row_semantic", F.when(own, F.col("semantic")).otherwise(0.0)).withColumn("is_primary", own)
        rows = stored(score_rows(joined, asked, own.cast("double"), F.col("row_semantic")), "scored")
        inside = Window.partitionBy("question_id", "primary_id").orderBy(F.desc(F.round("row_score", 9)), F.desc("row_semantic"), F.desc("is_primary"), "ordinal_in_document", "chunk_id")
        rows = rows.withColumn("depth", F.row_number().over(inside) - 1)
        columns = ["chunk_id", "document_id", "chunk_type", "section_number", "heading", "full_text", "page_start", "page_end", "parent_chunk_id", "ordinal_in_document", "parent_heading"]
        b = rows.join(score_bundles(rows, asked, self.dimension), ["question_id", "primary_id"])
        b = b.select("question_id", "primary_id", "bundle_score", "confidence", "depth", F.col("row_score").alias("score"), "row_semantic", "is_primary", *columns)
        order = Window.partitionBy("question_id").orderBy(F.desc(F.round("bundle_score", 9)), "primary_id")
        return b.withColumn("bundle_rank", F.dense_rank().over(order)).where(F.col("bundle_rank") <= limit)

    def retrieve(self, plans: dict[str, Plan], deep: bool = False) -> DataFrame:
        """The ranked chunks of each question: bundles, with `position` for the interleaved list (null for chunks that it leaves out)."""
        wide = [(q, KEEP_MERGED_WIDE if p.request_shape in ("grouped_list", "broad_topic") else KEEP_MERGED) for q, p in plans.items()]
        keep = self.chunks.sparkSession.createDataFrame(wide, "question_id string, keep int")
        merged = stored(merge(self.candidates(plans, deep), keep), "merged")
        b = self.bundles(plans, merged, deep)
        listed = interleave(b, (planner.DEEP if deep else planner.NORMAL).results)
        return b.join(listed, ["question_id", "chunk_id"], "left")

    def page_hits(self, plans: dict[str, Plan], most: int = 6) -> DataFrame:
        """(question_id, page_num, snippet, variant, rank): pages that hold one of the exact wordings; a page counts for its first wording."""
        spark, passes, names = self.chunks.sparkSession, [], []
        for q, p in plans.items():
            for k, term in enumerate(planner.exact_terms(p.raw_query)):
                passes.append((f"{q}|{k}", fulltext.Phrase(term), most))
                names.append((f"{q}|{k}", q, k, term))
        schema = "pass_id string, question_id string, variant int, term string"
        keyed = self.pages.withColumn("page_key", F.concat_ws("#", "document_id", "page_num"))
        wanted = fulltext.terms_of(*(e for _, e, _ in passes))
        hits = fulltext.search(stored(fulltext.postings(keyed, "page_key", ["page_text"], wanted), "page-postings"), fulltext.doc_lengths(keyed, "page_key", ["page_text"]), passes, "page_key", fulltext.PAGE_WEIGHTS) if passes else spark.createDataFrame([], "pass_id string, page_key string, score double, rank int")
        h = hits.join(F.broadcast(spark.createDataFrame(names, schema)), "pass_id")  # a row for each wording
        h = h.groupBy("question_id", "page_key").agg(F.min(F.struct("variant", "rank")).alias("at"))
        w = Window.partitionBy("question_id").orderBy("at", "page_key")
        h = h.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
        return keyed.join(F.broadcast(h), "page_key").select("question_id", "document_id", "page_num", F.col("at.variant").alias("variant"), "rank", "page_text")
