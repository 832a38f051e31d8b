"""A corpus on disk: its tables, writing and replacing documents, and the joins around a chunk."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundsearch import schemas
from groundsearch.operators import facts as X
from groundsearch.operators import features as features_
from groundsearch.operators import fulltext, segment, vectors


# --- joins around chunks ----------------------------------------------------------------------------------------------------------
def with_features(chunks: DataFrame, features: DataFrame) -> DataFrame:
    """Chunks with their features; a chunk without features keeps null ones."""
    extra = ["parent_heading", "search_text", "normalized_text", "clause_type", "actor_tags", "action_tags", "topic_tags", "noise_flags"]
    return chunks.join(features.select("chunk_id", *extra), "chunk_id", "left")


def section_lookup(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks of the sections (question_id, document_id, section_number), in document order."""
    return chunks.join(sections, ["document_id", "section_number"])


def neighbours(chunks: DataFrame, primary: DataFrame, radius: int = 1) -> DataFrame:
    """(chunk_id, other, distance): chunks within `radius` ordinals of the primary ones (chunk_id, document_id, ordinal_in_document).

    The range becomes an equality: each primary names the ordinals it wants.
    """
    radius = max(0, min(12, radius))
    want = primary.select(F.col("chunk_id").alias("p"), "document_id", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("distance"), "ordinal_in_document")
    want = want.withColumn("ordinal_in_document", F.col("ordinal_in_document") + F.col("distance"))
    found = want.join(chunks.select("document_id", "ordinal_in_document", F.col("chunk_id").alias("other")), ["document_id", "ordinal_in_document"])
    return found.select(F.col("p").alias("chunk_id"), "other", "distance")


def parents(chunks: DataFrame) -> DataFrame:
    """(chunk_id, other): each chunk's parent."""
    return chunks.where("parent_chunk_id IS NOT NULL").select("chunk_id", F.col("parent_chunk_id").alias("other"))


def children(chunks: DataFrame, most: int) -> DataFrame:
    """(chunk_id, other, rank): each chunk's first children."""
    w = Window.partitionBy("parent_chunk_id").orderBy("ordinal_in_document", "chunk_id")
    c = chunks.where("parent_chunk_id IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return c.select(F.col("parent_chunk_id").alias("chunk_id"), F.col("chunk_id").alias("other"), "rank")


def page_overlap(chunks: DataFrame, spans: DataFrame, most: int, bucket: int = 8) -> DataFrame:
    """(key, chunk_id, rank): the first chunks on any page of spans (key, document_id, first, last).

    An interval join by buckets of pages: both sides name the buckets they touch, and meet in the first one that they share.
    """
    touch = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.greatest(F.col(a), F.col(b)) / bucket)))
    s = spans.select("key", "document_id", "first", "last", touch("first", "last").alias("b"))
    c = chunks.select("chunk_id", "document_id", "page_start", "page_end", "ordinal_in_document", touch("page_start", "page_end").alias("b"))
    both = s.join(c, ["document_id", "b"]).where("NOT (page_end < first OR page_start > last)").where(F.col("b") == F.floor(F.greatest("first", "page_start") / bucket))
    w = Window.partitionBy("key").orderBy("ordinal_in_document", "chunk_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("key", "chunk_id", "rank")


def page_window(pages: DataFrame, spans: DataFrame, pad: int, most: int) -> DataFrame:
    """(key, page_num, page_text, rank): pages from `pad` before to `pad` after spans (key, document_id, first, last)."""
    want = spans.select("key", "document_id", F.explode(F.sequence(F.greatest(F.lit(1), F.col("first") - pad), F.greatest(F.greatest(F.lit(1), F.col("first") - pad), F.greatest(F.col("last"), F.col("last") + pad)))).alias("page_num"))
    w = Window.partitionBy("key").orderBy("page_num")
    return want.join(pages, ["document_id", "page_num"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("key", "page_num", "page_text", "rank")


def exhibits_of(chunks: DataFrame, depth: int = 7) -> DataFrame:
    """(chunk_id, exhibit_id): the nearest ancestor, the chunk itself included, that is an exhibit. Steps are joins, `depth` at most."""
    up = chunks.select(F.col("chunk_id").alias("u_id"), F.col("parent_chunk_id").alias("u_parent"), F.col("chunk_type").alias("u_type"))
    at = chunks.select("chunk_id", F.col("chunk_id").alias("at"))
    found = None
    for _ in range(depth):
        here = at.join(up, F.col("at") == F.col("u_id"))
        hit = here.where("u_type = 'exhibit'").select("chunk_id", F.col("at").alias("exhibit_id"))
        found = hit if found is None else found.unionByName(hit)
        at = here.where("u_type <> 'exhibit' AND u_parent IS NOT NULL").select("chunk_id", F.col("u_parent").alias("at"))
    return found


def attachment_label(heading: Column, section: Column) -> Column:
    """What an exhibit is called in a citation."""
    name, number = (F.regexp_extract(heading, r"(?i)^(attachment|appendix|exhibit)\s+([A-Z0-9.\-]+)\b", k) for k in (1, 2))
    short = (F.length(section) <= 4) & F.regexp_like(section, F.lit(r"^\p{L}+$"))
    return F.when(name != "", F.concat_ws(" ", F.initcap(name), number)).when(short, F.concat(F.lit("Appendix "), F.upper(section))).otherwise(heading)


# --- the tables -------------------------------------------------------------------------------------------------------------------
def derive(pages: DataFrame, dimension: int = vectors.DIMENSION) -> dict[str, DataFrame]:
    """The tables of the pages of some documents: chunks, features, facts, embeddings."""
    chunks = segment.chunks(pages)
    return {"pages": pages, "chunks": chunks} | derive_from_chunks(chunks, dimension)


def embeddings(chunks: DataFrame, dimension: int = vectors.DIMENSION) -> DataFrame:
    text = vectors.index_text(F.col("section_number"), F.col("heading"), F.col("full_text"))
    e = vectors.embed(chunks.select("document_id", "chunk_id", text.alias("t")), "t", dimension)
    return e.select("document_id", "chunk_id", F.lit(f"hashing-embedder-{dimension}").alias("model_name"), F.lit(dimension).alias("dimension"), "vector")


def derive_from_chunks(chunks: DataFrame, dimension: int = vectors.DIMENSION) -> dict[str, DataFrame]:
    return {"features": features_.features(chunks), "facts": X.facts(chunks), "embeddings": embeddings(chunks, dimension)}


class Corpus:
    """The tables of a corpus in a folder, each partitioned by document_id.

    A version of the tables is a folder of its own. Readers see the one that the highest numbered folder of `_versions` names; that folder is
    put there last, whole, by a rename to a name that was not there, and nothing is deleted before. So a write that ends anywhere, or is
    repeated, leaves the old version in sight. The version before the present one stays for readers that began with it; older ones go.
    """

    DERIVED = ("pages", "chunks", "features", "facts", "embeddings")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _pointers(self) -> list[str]:
        fs, Path = self._fs()
        top = Path(f"{self.path}/_versions")
        return sorted(n for n in (str(x.getPath().getName()) for x in fs.listStatus(top)) if n.isdigit()) if fs.exists(top) else []

    def _named(self, pointer: str) -> str:
        return self.spark.read.text(f"{self.path}/_versions/{pointer}").first()[0]

    def version(self) -> str | None:
        found = self._pointers()
        return self._named(found[-1]) if found else None

    def table(self, name: str) -> DataFrame:
        v = self.version()
        fs, Path = self._fs()
        where = f"{self.path}/{v}/{name}"
        if v is None or not fs.exists(Path(where)):
            schema = schemas.TABLES[name]
            return self.spark.createDataFrame([], schema if "document_id" in schema or name == "metadata" else schema + ", document_id string")
        return self.spark.read.parquet(where)

    def _commit(self, tables: dict[str, DataFrame]) -> str:
        return self._publish(self._write(tables))

    def _write(self, tables: dict[str, DataFrame]) -> str:
        """A new version's folder, which no reader sees yet."""
        version = f"v-{uuid.uuid4().hex}"
        for name, df in tables.items():
            writer = df.write.mode("overwrite")
            (writer.partitionBy("document_id") if name in self.DERIVED else writer).parquet(f"{self.path}/{version}/{name}")
        return version

    def _publish(self, version: str) -> str:
        """Let readers see a version; of two writers at once the second fails."""
        fs, Path = self._fs()
        before = self._pointers()
        tmp, new = f"{self.path}/_next-{version}", f"{self.path}/_versions/{int(before[-1]) + 1 if before else 1:019d}"
        self.spark.createDataFrame([(version,)], "value string").coalesce(1).write.text(tmp)
        fs.mkdirs(Path(f"{self.path}/_versions"))
        if fs.exists(Path(new)) or not fs.rename(Path(tmp), Path(new)):
            fs.delete(Path(tmp), True)
            raise RuntimeError(f"another writer published {new} first")
        for old in before[:-1]:
            gone = self._named(old)
            fs.delete(Path(f"{self.path}/_versions/{old}"), True)
            fs.delete(Path(f"{self.path}/{gone}"), True)
        return version

    def replace_documents(self, pages: DataFrame, documents: DataFrame | None = None) -> dict[str, int]:
        """Write the documents of pages anew, with all that is derived from them; others stay. Returns the rows written for each table.

        documents (document_id, display_name, version_label, file_path, sha256) describes them; missing ones get their id as their name.
        """
        # chunks feed three tables: they are computed once, and the others derived from what is written
        staged = f"{self.path}/_staging-{uuid.uuid4().hex}"
        segment.chunks(pages).write.parquet(staged)
        chunks = self.spark.read.schema(schemas.CHUNKS).parquet(staged)
        new = {"pages": pages, "chunks": chunks} | derive_from_chunks(chunks)
        ids = pages.select("document_id").distinct()
        counted = pages.groupBy("document_id").agg(F.count("*").cast("int").alias("page_count"))
        about = documents if documents is not None else ids.selectExpr("document_id", "document_id AS display_name", "'' AS version_label", "'' AS file_path", "'' AS sha256")
        rows = about.join(counted, "document_id").withColumn("created_at", F.current_timestamp())
        tables = {name: self._merged(name, df, ids) for name, df in ({"documents": rows} | new).items()}
        counts = self._finish(tables, list(new))
        fs, Path = self._fs()
        fs.delete(Path(staged), True)
        return counts

    def _merged(self, name: str, new: DataFrame, ids: DataFrame) -> DataFrame:
        old = self.table(name)
        return old.join(ids, "document_id", "left_anti").unionByName(new, allowMissingColumns=True)

    def _finish(self, tables: dict[str, DataFrame], counted: list[str]) -> dict[str, int]:
        meta = self.spark.createDataFrame([("search_schema_version", str(schemas.SCHEMA_VERSION))], schemas.METADATA)
        tables = tables | {"metadata": upsert(self.table("metadata"), meta, "key")}
        self._commit(tables)
        counts = {name: self.table(name).count() for name in counted}
        if counts.get("chunks") and not counts.get("facts"):
            raise ValueError("chunks were written but no facts were found")
        return counts

    def refresh(self, document_id: str | None = None) -> dict[str, int]:
        """Derive features, facts and embeddings again from the stored chunks, of one document or all."""
        chunks = self.table("chunks")
        chunks = chunks.where(F.col("document_id") == document_id) if document_id else chunks
        ids = chunks.select("document_id").distinct()
        new = derive_from_chunks(chunks)
        tables = {n: self.table(n) for n in ("documents", "pages", "chunks")} | {n: self._merged(n, df, ids) for n, df in new.items()}
        return self._finish(tables, ["chunks", *new])

    def metadata(self, key: str) -> str | None:
        row = self.table("metadata").where(F.col("key") == key).first()
        return row["value"] if row else None

    def active_document(self) -> str | None:
        row = self.table("documents").orderBy(F.desc("created_at"), F.desc("document_id")).first()
        return row["document_id"] if row else None

    def chunk_features(self) -> DataFrame:
        return with_features(self.table("chunks"), self.table("features"))

    def build_index(self) -> tuple[DataFrame, DataFrame]:
        """(postings, lengths) of the feature index, written beside the tables: postings by field, sorted by term, so a search reads few files."""
        f, base = self.table("features"), f"{self.path}/{self.version()}"
        fields = list(fulltext.FEATURE_WEIGHTS)
        postings = fulltext.postings(f, "chunk_id", fields).repartitionByRange("field", "term").sortWithinPartitions("field", "term")
        postings.write.mode("overwrite").parquet(f"{base}/postings")
        fulltext.doc_lengths(f, "chunk_id", fields).write.mode("overwrite").parquet(f"{base}/lengths")
        return self.spark.read.parquet(f"{base}/postings"), self.spark.read.parquet(f"{base}/lengths")

    def counts(self) -> DataFrame:
        """(table_name, n, n_documents)."""
        out = None
        for name in self.DERIVED:
            one = self.table(name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n"), F.count_distinct("document_id").alias("n_documents"))
            out = one if out is None else out.unionByName(one)
        return out

    def validate(self) -> dict:
        """ready, the first failed check (missing, no_document, schema_version, no_chunks, no_features, no_facts), and the counts."""
        if self.version() is None:
            return {"ready": False, "error": "missing", "counts": {}}
        n = {r["table_name"]: r["n"] for r in self.counts().collect()}
        checks = (
            ("no_document", self.active_document() is not None), ("schema_version", self.metadata("search_schema_version") == str(schemas.SCHEMA_VERSION)), ("no_chunks", n["chunks"] > 0),
            ("no_features", n["features"] == n["chunks"]), ("no_facts", n["facts"] > 0),
        )
        return {"ready": all(ok for _, ok in checks), "error": next((k for k, ok in checks if not ok), None), "counts": n}


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new; where both have a key, new's."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
