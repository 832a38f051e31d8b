"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundsearch.llm.common import documents, files_for, map_arrow, utf8, written
from groundsearch.llm.graph import connected_components

BITS = 64
#: Buckets with more fingerprints than this are divided again by finer masks. As many are compared with numpy in a few seconds, and half a
#: megabyte; a second division leaves about 16 bits free, so it ends there.
BUCKET = 1 << 16
#: Parts of a component that are labelled apart.
SALT = 16


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text: bit by bit the majority of the XXH64 hashes of its word shingles (repeats count).

    A-Z are lower-cased and words are runs without ASCII white space. Fewer words than a shingle has make one shingle; no words (or null)
    give 0.
    """
    parts = (text or b"").lower().split()
    n = len(parts)
    if not n:
        return 0
    joined = b" ".join(parts)
    if n <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: n - words + 1].tolist()
    stops = ends[words - 1 :].tolist()
    digest, m = xxhash.xxh64_intdigest, len(starts)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, m, 1 << 15):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)], strict=True)], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * votes > m).tobytes(), "big")


def covering_masks(free: int, radius: int) -> list[int]:
    """Masks over the bits of `free` such that two values that differ in at most `radius` of these bits agree under some mask.

    Each free bit gets a vector of radius + 1 bits; for every non-zero vector v there is the mask of the bits whose vector has an odd
    inner product with v. The vectors of at most `radius` differing bits span less than the whole space, so some v is orthogonal to all
    of them: its mask has none of these bits. The first bits get the unit vectors, so with more than `radius` free bits the vectors span
    the space, no v is orthogonal to all of them, and no mask is zero: every mask fixes a bit that was free.
    """
    bits = [i for i in range(BITS) if free >> i & 1]
    units = [1 << k for k in range(radius + 1)]
    order = [*units, *(v for v in range(1, 2 << radius) if v not in units)]
    vectors = {b: order[k % len(order)] for k, b in enumerate(bits)}
    masks = {sum(1 << b for b in bits if (vectors[b] & v).bit_count() & 1) for v in range(1, 2 << radius)}
    return sorted(masks)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def near_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the values (distinct int64) which differ in at most `radius` bits, directly or by others: a spanning forest."""
    left, out = np.unique(values).view(np.uint64), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                out += [(int(x.view(np.int64)), int(y.view(np.int64))) for y in left[near]]
                todo += list(left[near])
                left = left[~near]
    return out


def fingerprint_links(values: DataFrame, radius: int = 4, bucket: int = BUCKET, rows: int = 0) -> DataFrame:
    """Links (a, b) between fingerprints that make the same components as all pairs within `radius` differing bits.

    values: one column `fp` of distinct int64, about `rows` of them. Every fingerprint goes to one bucket per covering mask. Buckets are counted by a partial
    aggregation first: single ones end there, two members are a pair, up to `bucket` members meet in one row and give a spanning forest.
    Larger ones, as very large groups of near copies make, are divided by covering masks over the bits that their own mask left free, and
    so on until every bucket is small. Each division fixes a bit at least, and a bucket of n fingerprints has log2(n) free bits at least, so
    this ends: with at most `radius` free bits all are linked and are not divided. No pair is lost at any level.
    """
    spark = values.sparkSession
    full = (1 << BITS) - 1
    found = []
    live, paths = values.select("fp", F.lit(0).alias("path")), {0: 0}
    while True:
        tables = [(path, k, _signed(fixed | m)) for path, fixed in paths.items() for k, m in enumerate(covering_masks(full & ~fixed, radius))]
        tables = [(path, i, mask) for i, (path, _, mask) in enumerate(tables)]
        if len(paths) == 1:
            cells = F.array(*[F.struct(F.lit(i).alias("path"), F.col("fp").bitwiseAND(F.lit(mask)).alias("fixed")) for _, i, mask in tables])
            cells = live.select("fp", F.explode(cells).alias("c")).select("fp", "c.path", "c.fixed")
        else:  # a few thousand masks at most: their number depends on the radius alone
            masks = F.broadcast(spark.createDataFrame(tables, "path int, next int, mask long"))
            cells = live.join(masks, "path").select("fp", F.col("next").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("fixed"))
        sizes = cells.groupBy("path", "fixed").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
        sizes = written(sizes.repartition(files_for(rows)), "simhash-buckets")
        found.append(sizes.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        # members of the buckets that need a closer look
        wide = sizes.where("n > 2").select("path", "fixed", "n")
        members = cells.join(wide, ["path", "fixed"])
        whole = [i for i, _, mask in tables if (full & ~(mask % (1 << BITS))).bit_count() <= radius]
        fine = (F.col("n") <= bucket) | F.col("path").isin(whole) if whole else F.col("n") <= bucket
        small = members.where(fine).groupBy("path", "fixed").agg(F.collect_list("fp").alias("fps")).select("fps")

        def links(batch: pa.RecordBatch) -> pa.RecordBatch:
            pairs = [p for fps in batch.column("fps").to_pylist() for p in near_links(np.array(fps, np.int64), radius)]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

        found.append(map_arrow(small, links, "a long, b long"))
        large = wide.where(~fine)
        hot = [r.path for r in large.select("path").distinct().collect()]  # table numbers, not rows: at most as many as there are masks
        if not hot:
            break
        live = written(members.where(~fine).select("fp", "path"), "simhash-live")
        paths = {k: tables[k][2] % (1 << BITS) for k in hot}  # the finer masks keep the fixed bits, so a bucket's rows stay apart from others
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def with_fingerprint(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp int64), and the other columns, of every row, computed once from the whole text and kept in the shared folder."""
    names = [c for c in docs.columns if c not in ("text", "fp")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, words) for t in utf8(batch, "text")], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fps)], [*names, "fp"])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
    return written(map_arrow(docs.select(*names, F.col("text").cast("string").alias("text")), run, f"{schema}, fp long"), "simhash")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text, any others).

    Fingerprints link at `radius` or fewer differing bits; component_id is the smallest doc_id that a row reaches, itself included.
    Equal fingerprints are one node from the start, so groups of exact copies never meet pairwise. Null text counts as no words, which is
    fingerprint 0, linked like any other. Null doc_ids are left out of the smallest id (null only if the whole component has none).
    Repeated rows get one result row each; an empty table gives an empty result.
    """
    return grouped(docs.select("doc_id", "text"), words, radius, bucket).select("doc_id", "fp", "component_id")


def grouped(docs: DataFrame, words: int = 4, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """near_duplicates() with the other columns of docs, which should be narrow, and root: the group's smallest fingerprint, which names it
    also where several groups have one component_id or none has an id."""
    fps = with_fingerprint(docs, words)
    n = fps.count()  # from the table's footers
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(fingerprint_links(nodes.select("fp"), radius, bucket, n), rows=n).withColumnsRenamed({"node": "fp"})
    # fingerprints with links only; a component's label is copied SALT times, so that a large one is several keys
    joined = roots.join(nodes, "fp").select("fp", "first", "root", F.pmod(F.xxhash64("fp"), F.lit(SALT)).alias("salt"))
    first = joined.groupBy("root").agg(F.min("first").alias("label")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    linked = joined.join(first, ["root", "salt"]).select("fp", "root", "label")
    linked = nodes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("label")).alias("component_id"))
    return fps.join(linked, "fp")


def op1_simhash(spark, sf_dir):
    """doc_id, fingerprint, component_id of all documents."""
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
