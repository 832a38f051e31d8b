"""Sources: page tables, text files, binary files with a page extractor, JSON corpora and case files."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A page needs so many letters and digits, and words with a letter, to do without recognition.
MIN_CHARS, MIN_WORDS = 120, 20


def page_quality(text: Column) -> tuple[Column, Column]:
    """(letters and digits, words with a letter) of a page's text."""
    chars = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: F.regexp_like(w, F.lit(r"\p{L}"))))
    return chars, words


def needs_recognition(text: Column) -> Column:
    chars, words = page_quality(text)
    return (chars < MIN_CHARS) | (words < MIN_WORDS)


def gate_pages(pages: DataFrame, recognise: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """pages (document_id, page_num, page_text) with ocr_used: true where the native text is too thin.

    recognise, if given, adds a column recognised_text to those pages; it replaces the text where it is longer.
    """
    gated = pages.withColumn("page_text", F.coalesce("page_text", F.lit(""))).withColumn("ocr_used", needs_recognition(F.col("page_text")))
    if recognise is None:
        return gated
    thin = recognise(gated.where("ocr_used"))
    better = F.length(F.coalesce("recognised_text", F.lit(""))) > F.length("page_text")
    done = thin.withColumn("page_text", F.when(better, F.col("recognised_text")).otherwise(F.col("page_text"))).drop("recognised_text")
    return gated.where("NOT ocr_used").unionByName(done)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A page table: document_id, page_num, page_text."""
    return gate_pages(spark.read.format(fmt).load(path).selectExpr("document_id", "int(page_num) AS page_num", "page_text"))


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text files as documents, one page for each form feed; the document's id is of its path."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value")
    pages = whole.select(document_id(F.col("file_path"), F.lit("")).alias("document_id"), F.posexplode(F.split("value", "\f")).alias("page", "page_text"))
    return gate_pages(pages.select("document_id", (F.col("page") + 1).cast("int").alias("page_num"), F.trim("page_text").alias("page_text")))


def read_binary_documents(spark: SparkSession, path: str, extract: Callable[[bytes], Iterable[str]]) -> tuple[DataFrame, DataFrame]:
    """(files, pages) of binary files; extract gives the texts of a file's pages. files has the SHA-256 of each file's content."""
    raw = spark.read.format("binaryFile").load(path)
    files = raw.select(document_id(F.col("path"), F.lit("")).alias("document_id"), F.col("path").alias("file_path"), F.sha2("content", 256).alias("sha256"))

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rows = [(r.document_id, k, text.strip()) for k, text in enumerate(extract(bytes(r.content)), 1)]
                yield type(pdf)(rows, columns=["document_id", "page_num", "page_text"])

    pages = raw.select(document_id(F.col("path"), F.lit("")).alias("document_id"), "content").mapInPandas(run, "document_id string, page_num int, page_text string")
    return files, gate_pages(pages)


def document_id(name: Column, version: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha1(F.concat_ws("|", name, version)), 1, 12))


def read_chunks_json(spark: SparkSession, path: str, default_document: str = "doc_corpus") -> DataFrame:
    """A chunk corpus in a JSON array; optional fields get their defaults."""
    schema = "chunk_id string, document_id string, chunk_type string, section_number string, heading string, full_text string, page_start int, page_end int, parent_chunk_id string, ordinal_in_document int"
    c = spark.read.schema(schema).json(path, multiLine=True)
    return c.select(
        "chunk_id", F.coalesce("document_id", F.lit(default_document)).alias("document_id"), F.coalesce("chunk_type", F.lit("section")).alias("chunk_type"), "section_number", "heading",
        "full_text", "page_start", F.coalesce("page_end", "page_start").alias("page_end"), "parent_chunk_id", F.coalesce("ordinal_in_document", "page_start").alias("ordinal_in_document"),
    )


CASES = "name string, category string, question string, expected_top_chunk_ids array<string>, expected_answer_contains array<string>, expected_section string, expected_page int, expected_exact_hit_page int, require_citations boolean, expect_refusal boolean"
BEHAVIOUR_CASES = "name string, question string, history array<struct<role:string,content:string>>, deep_think boolean, expand_answer boolean, previous_answer string, expected_request_shape string, expected_answer_mode string, expected_refused boolean, required_snippets array<string>, banned_snippets array<string>, expected_sections array<string>, banned_headings array<string>, min_citations int"


def read_cases(spark: SparkSession, path: str, schema: str = CASES) -> DataFrame:
    """Evaluation cases in a JSON array; absent lists are empty, absent flags false."""
    cases = spark.read.schema(schema).json(path, multiLine=True)
    for f in cases.schema.fields:
        kind = f.dataType.simpleString()
        if kind.startswith("array"):
            cases = cases.withColumn(f.name, F.coalesce(f.name, F.array().cast(kind)))
        elif kind == "boolean" and f.name != "expected_refused":
            cases = cases.withColumn(f.name, F.coalesce(f.name, F.lit(False)))
    return cases
