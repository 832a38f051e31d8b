"""Substring dedup: lines, and windows of words, are hashed and grouped globally; the earliest occurrence stays."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundsearch.llm.common import arrow_batches, documents, map_arrow, utf8, written

#: Words of a seed: windows are compared only where the lowest seed in them is repeated.
SEED = 8
#: Words of a window, and the step from one window to the next: every window is looked at.
WINDOW, STEP = 40, 1
#: Adjacent repeated units are removed where they have at least so many words together.
MIN_WORDS = 20

#: Rows that a worker gathers before it hands them on.
ROWS = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """The words of a UTF-8 text, and its units: byte starts and ends of the words; units begin at the words `first` and have `count` words.

    A line of fewer than `window` words is a unit, and so is every window of `window` adjacent words, whatever lines they stand in. A repeated
    passage of at least `window` words is thus covered by units that are repeated, up to its ends.

    A window's seed is the lowest hash of SEED adjacent words in it (of equal ones the first), so equal windows have equal seeds. The windows
    that have their seed at one place begin at adjacent words, since a seed that is lowest in two windows is lowest in all between: they make
    a bundle, and bundles of equal words consist of equal windows.
    """

    def __init__(self, text: bytes, window: int = WINDOW):
        self.text, self.window, a = text, window, np.frombuffer(text, np.uint8)
        edge = np.diff(np.concatenate(([True], _SPACE[a], [True])).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.size = k = len(self.starts)
        line = np.searchsorted(np.flatnonzero(a == 10), self.starts)
        head = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))[:k])
        size = np.diff(np.append(head, k))
        #: First words and sizes of the lines that are units; number of windows.
        self.lines, self.sizes, self.windows = head[size < window], size[size < window], max(0, k - window + 1)

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.lower().split()

    @cached_property
    def joined(self) -> bytes:
        return b" ".join(self.words)

    @cached_property
    def place(self) -> np.ndarray:
        """Where the words begin in `joined`."""
        return np.concatenate(([0], np.cumsum(np.fromiter(map(len, self.words), np.int64, self.size) + 1)))

    @cached_property
    def _order(self) -> np.ndarray:
        return np.argsort(np.concatenate((np.arange(self.windows), self.lines)), kind="stable")

    @cached_property
    def first(self) -> np.ndarray:
        return np.concatenate((np.arange(self.windows), self.lines))[self._order]

    @cached_property
    def count(self) -> np.ndarray:
        return np.concatenate((np.full(self.windows, self.window), self.sizes))[self._order]

    @cached_property
    def bundles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows, place of the seed and its hash, of each bundle in order."""
        k, m = self.size, min(SEED, self.window)
        if not self.windows:
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(0, np.uint64)
        h = np.fromiter(map(zlib.crc32, self.words), np.uint64, k)
        h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        x = np.zeros(k - m + 1, np.uint64)
        for j in range(m):
            x = x * np.uint64(0xC2B2AE3D27D4EB4F) + h[j : k - m + 1 + j]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        at = lowest(x, self.window - m + 1)
        begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        return begin, np.diff(np.append(begin, len(at))), at[begin], x[at[begin]]

    def bytes_of(self, first: np.ndarray, count: np.ndarray | int) -> Iterator[bytes]:
        """The `count` words from each of `first` on, A-Z lower-cased and joined by single spaces."""
        text, begin, stop = self.joined, self.place[first], self.place[first + count] - 1
        return (text[s:e] for s, e in zip(begin.tolist(), stop.tolist(), strict=True))

    def hashes(self, first: np.ndarray, count: np.ndarray | int) -> np.ndarray:
        """64-bit digests of these words."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.bytes_of(first, count)), np.uint64, len(first)).view(np.int64)

    def digests(self, which: np.ndarray) -> list[bytes]:
        """16-byte digests of the words of the units `which`."""
        return list(map(xxhash.xxh3_128_digest, self.bytes_of(self.first[which], self.count[which])))

    def line_digests(self) -> np.ndarray:
        """The two halves of the 16-byte digests of the lines."""
        return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.bytes_of(self.lines, self.sizes))), "<i8").reshape(-1, 2)


def lowest(x: np.ndarray, n: int) -> np.ndarray:
    """For each n adjacent values of x the place of the lowest, of equal ones the first."""
    at, span = np.arange(len(x)), 1
    while span < n:
        step = min(span, n - span)
        left, right = at[:-step], at[step:]
        at = np.where(x[right] < x[left], right, left)
        span += step
    return at


def units(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Byte start, byte end and words of each unit of a UTF-8 text in order, and its 16-byte digest."""
    w = Words(text)
    return w.starts[w.first], w.ends[w.first + w.count - 1], w.count, w.digests(np.arange(len(w.first)))


def repeats_within(digests: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which of the units, in order, the text had before, where the earliest of their digest does not overlap them."""
    _, where, which = np.unique(digests, return_index=True, return_inverse=True)
    early = where[which]
    return (early < np.arange(len(digests))) & (first >= first[early] + count[early])


def windows_of(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """First words of the windows of bundles."""
    stop = np.cumsum(n)
    return np.arange(stop[-1] if len(n) else 0) - np.repeat(stop - n - begin, n)


def bundle_table(docs: DataFrame, window: int) -> DataFrame:
    """A row for each bundle and each line of each text of docs (doc_id, key, text): doc_id, key, h (hash of the seed), d (digest of all its
    words; h and d make 128 bits), at (twice its first word, plus 1 for a line) and n (its windows, or words of the line). Rows without h are
    what the text had before, see repeats_within: a line, or n windows from `at` on.
    """

    def run(batches):
        for batch in batches:
            owner, columns, waiting = [], [], 0

            def done():
                h, d, at, n = (np.concatenate([np.zeros(0, np.int64), *(c[i] for c in columns)]) for i in range(4))
                rows = pa.array(np.concatenate([np.zeros(0, np.int64), *owner]))
                arrays = [batch.column("doc_id").take(rows), batch.column("key").take(rows), pa.array(h, mask=n < 0), pa.array(d, mask=n < 0), pa.array(at, pa.int32()), pa.array(np.abs(n), pa.int32())]
                return pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "h", "d", "at", "n"])

            for k, text in enumerate(utf8(batch, "text")):
                w = Words(text or b"", window)
                begin, n, _, value = w.bundles
                both = w.line_digests()
                rows = [(value.view(np.int64), w.hashes(begin, n + window - 1), 2 * begin, n), (both[:, 0], both[:, 1], 2 * w.lines + 1, w.sizes)]
                # equal windows have equal seeds, so only seeds that the text has again are looked at
                _, which, times = np.unique(value, return_inverse=True, return_counts=True)
                again = times[which] > 1
                if again.any():
                    first = windows_of(begin[again], n[again])
                    first = first[repeats_within(w.hashes(first, window), first, np.full(len(first), window))]
                    head = np.flatnonzero(np.diff(first, prepend=-2) != 1)
                    rows.append((first[head], first[head], 2 * first[head], -np.diff(np.append(head, len(first)))))
                again = repeats_within(both[:, 1], w.lines, w.sizes)
                rows.append((w.lines[again], w.lines[again], 2 * w.lines[again] + 1, -w.sizes[again]))
                columns += rows
                owner += [np.full(len(r[0]), k) for r in rows]
                waiting += sum(len(r[0]) for r in rows)
                if waiting >= ROWS:
                    yield done()
                    owner, columns, waiting = [], [], 0
            yield done()

    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow_batches(docs.sparkSession)
    return docs.select("doc_id", "key", "text").mapInArrow(run, f"doc_id {kind}, key long, h long, d long, at int, n int")


def window_table(docs: DataFrame, window: int) -> DataFrame:
    """A row for each window of the `bundles` (array of h, at, n) of each text of docs (doc_id, key, text): doc_id, key, h, x (digest of its
    words; h and x make 128 bits) and at (twice its first word)."""

    def run(batches):
        for batch in batches:
            owner, columns, waiting = [], [], 0

            def done():
                h, x, first = (np.concatenate([np.zeros(0, np.int64), *(c[i] for c in columns)]) for i in range(3))
                rows = pa.array(np.concatenate([np.zeros(0, np.int64), *owner]))
                arrays = [batch.column("doc_id").take(rows), batch.column("key").take(rows), pa.array(h), pa.array(x), pa.array(2 * first, pa.int32())]
                return pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "h", "x", "at"])

            for k, (text, bundles) in enumerate(zip(utf8(batch, "text"), batch.column("bundles"), strict=True)):
                w = Words(text or b"", window)
                h, at, n = (bundles.values.field(c).to_numpy() for c in ("h", "at", "n"))
                first = windows_of(at // 2, n)
                columns.append((np.repeat(h, n), w.hashes(first, window), first))
                owner.append(np.full(len(first), k))
                waiting += len(first)
                if waiting >= ROWS:
                    yield done()
                    owner, columns, waiting = [], [], 0
            yield done()

    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow_batches(docs.sparkSession)
    return docs.select("doc_id", "key", "text", "bundles").mapInArrow(run, f"doc_id {kind}, key long, h long, x long, at int")


def repeated_units(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, key, at, n) of all units of docs (doc_id, key, text) that are not the first of their words: as in bundle_table.

    Of bundles of equal words all windows of those not in the first document are repeated, whatever else has them. So single windows need
    comparing only among the bundles of the first documents, and there only where bundles of different words have one seed.
    """
    table = written(bundle_table(docs, window), "substring-bundles")
    within = table.where("h IS NULL").select("doc_id", "key", "at", "n")
    table = table.where("h IS NOT NULL")
    often = table.groupBy("h").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("h")
    table = written(table.join(often, "h").select(*table.columns), "substring-repeated")
    equal = table.groupBy("h", "d").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first"))
    mixed = equal.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h", F.lit(True).alias("mixed"))
    equal = equal.join(mixed, "h", "left").where("rows > 1 OR mixed").select("h", "d", "first", F.coalesce("mixed", F.lit(False)).alias("mixed"))
    stays = F.col("doc_id").eqNullSafe(F.col("first"))
    joined = written(table.join(equal, ["h", "d"]).where(~stays | F.col("mixed") & (F.col("at") % 2 == 0)).select("doc_id", "key", "h", "at", "n", (~stays).alias("later")), "substring-compared")
    later = joined.where("later").select("doc_id", "key", "at", "n")
    looked = joined.where("NOT later").groupBy(F.col("doc_id").alias("b_doc"), F.col("key").alias("b_key")).agg(F.collect_set(F.struct("h", "at", "n")).alias("bundles"))
    looked = docs.join(looked, F.col("doc_id").eqNullSafe(F.col("b_doc")) & (F.col("key") == F.col("b_key")))
    windows = written(window_table(looked, window), "substring-windows")
    groups = windows.groupBy("h", "x").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first")).where("rows > 1").select("h", "x", "first")
    single = windows.join(groups, ["h", "x"]).where(~stays).select("doc_id", "key", "at", F.lit(1).alias("n"))
    return later.union(single).union(within)


def spans_of(text: bytes, repeated: list[dict] | None, min_words: int, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(start, stop, units) of runs of adjacent or overlapping repeated units, as of repeated_units, that have at least min_words words.

    None: the whole text is repeated.
    """
    w = Words(text, window)
    if repeated is None:
        return [(int(w.starts[0]), int(w.ends[-1]), w.windows + len(w.lines))] if w.size >= min_words else []
    at, n = (np.array([u[c] for u in repeated], np.int64) for c in ("at", "n"))
    line, first = at % 2 == 1, at // 2
    # windows and lines by their first words, and how many units cover each word
    begins = np.zeros((2, w.size + 1), np.int64)
    np.add.at(begins[0], first[~line], 1)
    np.add.at(begins[0], (first + n)[~line], -1)
    begins = np.stack((np.cumsum(begins[0]) > 0, begins[1])).astype(np.int64)
    begins[1, first[line]] = 1
    cover = begins[0].copy()
    wide = np.flatnonzero(begins[0])
    cover[wide + window] -= 1
    lines, one = np.unique(first[line], return_index=True)
    cover[lines] += 1
    cover[lines + n[line][one]] -= 1
    edge = np.diff(np.concatenate(([0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0])))
    counted = np.concatenate(([0], np.cumsum(begins.sum(axis=0))))
    return [(int(w.starts[s]), int(w.ends[e - 1]), int(counted[e] - counted[s])) for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True) if e - s >= min_words]


def without(text: bytes, spans: list[tuple[int, int, int]]) -> bytes:
    """The text without the spans; of the white space around each, what stood before it stays, or else what follows."""
    kept, at = [], 0
    for start, stop, _ in spans:
        kept.append(text[at:start])
        at = stop
        if start == 0 or text[start - 1 : start].isspace():
            while at < len(text) and text[at : at + 1].isspace():
                at += 1
    kept.append(text[at:])
    out = b"".join(kept)
    return out.rstrip() if at >= len(text) and spans else out


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """The columns of docs (doc_id, text, any others) with repeated passages cut out of text, and n_removed (units), removed (array of
    start, stop: code points in the original text).

    Units are the lines of fewer than `window` words and all windows of `window` adjacent words. They are grouped by their words over the whole
    table; of each group the unit of the smallest doc_id (null last), and there the first, stays, with those that overlap it, as in a word
    over and over. Others are removed where they form runs of at least min_words words, so short lines that recur by chance stay. Of rows
    whose whole text is equal those of the smallest doc_id stay, and the others count as repeated throughout, without a look at their units.

    Equal units have equal seeds, and seeds are fewer, so first the seeds that come more than once in different texts are found, and only
    units that have one of those are compared: first as bundles of windows, then the windows of unequal bundles. Groups are counted by partial
    aggregation and join back as rows, never as lists, so a unit that a third of all documents share is no hot task beyond what skew handling
    splits. Rows with one doc_id count as one document: repeated rows give equal results. Null texts stay null, a text that is all repeated
    becomes empty; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    names = [c for c in docs.columns if c not in ("n_removed", "removed")]
    docs = docs.select(*[text.alias("text") if c == "text" else c for c in names])
    key, other = F.xxhash64(F.coalesce("text", F.lit(""))), F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))
    keyed = docs.select("doc_id", "text", key.alias("key"), other.alias("other"))
    # equal whole texts, by 128 bits
    narrow = docs.select("doc_id", key.alias("key"), other.alias("other"))
    heads = narrow.groupBy("key", "other").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "other", "head")
    copies = narrow.join(heads, ["key", "other"]).where(~F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "key").distinct()
    # rows that are equal in doc_id and text give their units twice; one is enough
    found = repeated_units(keyed.select("doc_id", "key", "text"), window).groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "n")).alias("units"))
    found = found.select("doc_id", "key", "units", F.lit(False).alias("copy")).union(copies.select("doc_id", "key", F.lit(None).cast(found.schema["units"].dataType), F.lit(True)))
    found = found.groupBy(F.col("doc_id").alias("u_doc"), F.col("key").alias("u_key")).agg(F.first("units", ignorenulls=True).alias("u_units"), F.max("copy").alias("u_copy"))
    joined = docs.withColumn("u_k", key).join(found, F.col("doc_id").eqNullSafe(F.col("u_doc")) & (F.col("u_k") == F.col("u_key")), "left").select(*names, "u_units", "u_copy")
    arrow_batches(spark)
    where = T.ArrayType(T.StructType().add("start", "integer").add("stop", "integer"))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_removed", T.IntegerType()), T.StructField("removed", where)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        for batch in batches:
            texts, out, counts, places = utf8(batch, "text"), [], [], []
            for text, repeated, copy in zip(texts, batch.column("u_units").to_pylist(), batch.column("u_copy").to_pylist(), strict=True):
                spans = spans_of(text, None if copy else repeated, min_words, window) if text and (copy or repeated) else []
                out.append(without(text, spans) if spans else text)
                counts.append(sum(n for *_, n in spans))
                chars = [(len(text[:s].decode()), len(text[s:e].decode())) for s, e, _ in spans]
                places.append([{"start": s, "stop": s + n} for s, n in chars])
            columns = {c: batch.column(c) for c in names} | {"text": pa.array(out, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(counts, pa.int32()), pa.array(places, kind)], [*names, "n_removed", "removed"])

    return joined.mapInArrow(run, schema)


def op6_substring(spark, sf_dir):
    """doc_id, text (without repeated passages), n_removed, removed of all documents."""
    return dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
