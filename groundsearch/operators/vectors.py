"""Vectors: the hashing embedder, similarity, and exact nearest neighbours."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.pandas.types import to_arrow_type

from groundsearch.functions import text as T

DIMENSION, TOKEN_WEIGHT, TRIGRAM_WEIGHT = 512, 1.0, 0.35


#: Characters and rows that are embedded together.
SLICE_CHARS, SLICE_ROWS = 1 << 20, 1024


@lru_cache(1 << 17)
def hashed(feature: str) -> tuple[int, int]:
    """(number, sign) of a feature by its SHA-1; the number modulo the dimension is its bucket."""
    h = hashlib.sha1(feature.encode()).digest()
    return int.from_bytes(h[:4], "big"), 1 - 2 * (h[4] % 2)


def _slices(texts: list[str]):
    first = chars = 0
    for k, t in enumerate(texts):
        if k > first and (chars + len(t) > SLICE_CHARS or k - first >= SLICE_ROWS):
            yield texts[first:k]
            first, chars = k, 0
        chars += len(t)
    if texts[first:]:
        yield texts[first:]


def _counted(codes: np.ndarray, rows: np.ndarray, names: list[str], n: int, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of signs, whether touched) of each row's buckets; codes: each feature's place in names, which is hashed once."""
    number, sign = (np.fromiter(x, np.int64, len(names)) for x in (zip(*map(hashed, names), strict=True) if names else ((), ())))
    at = rows * dimension + (number % dimension)[codes]
    return np.bincount(at, sign[codes].astype(float), n * dimension).reshape(n, dimension), np.bincount(at, minlength=n * dimension).reshape(n, dimension) > 0


def sums(lows: list[str], dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, touched), a row for each cleaned, lower-cased text: the weights of its tokens and character trigrams, with repeats, added up in
    their buckets. Signs are counted as whole numbers, so that equal texts have equal values; each different feature is hashed once."""
    n = len(lows)
    flats = [x.replace(" ", "_") for x in lows]
    points = np.frombuffer("".join(flats).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(n), [len(x) for x in flats])
    inside = rows[:-2] == rows[2:]
    codes, kinds = pd.factorize(((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])[inside])
    tri, t1 = _counted(codes, rows[:-2][inside], [f"tri:{chr(k >> 42)}{chr(k >> 21 & 0x1FFFFF)}{chr(k & 0x1FFFFF)}" for k in kinds.tolist()], n, dimension)
    words = [T.tokens_py(x) for x in lows]
    seen: dict[str, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for ws in words for w in ws), np.int64)
    tok, t2 = _counted(codes, np.repeat(np.arange(n), [len(ws) for ws in words]), [f"tok:{w}" for w in seen], n, dimension)
    return tok * TOKEN_WEIGHT + tri * TRIGRAM_WEIGHT, t1 | t2


def _spread(df: DataFrame) -> DataFrame:
    """The rows dealt anew, for tables of few files: much work for each row."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 4)


def sparse_embedding(df: DataFrame, key: str, text: str, dimension: int = DIMENSION) -> DataFrame:
    """(key, bucket, value): the embedding before normalising, of every bucket that a feature falls into. Texts are hashed in Arrow batches,
    which leave at most `dimension` rows of a text to move; one aggregation joins rows of equal keys."""
    kind = df.schema[key].dataType

    def run(batches):
        for batch in batches:
            keys, lows, first = batch.column(0), batch.column(1).to_pylist(), 0
            for part in _slices(lows):
                value, touched = sums(part, dimension)
                row, bucket = np.nonzero(touched)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row + first)), pa.array(bucket.astype(np.int32)), pa.array(value[row, bucket])], ["key", "bucket", "value"])
                first += len(part)

    low = _spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).select("key", F.coalesce(T.clean(F.lower("text")), F.lit("")).alias("low"))
    found = low.mapInArrow(run, f"key {kind.simpleString()}, bucket int, value double")
    return found.groupBy(F.col("key").alias(key), "bucket").agg(F.sum("value").alias("value"))


def embedded(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """A unit vector for each text; zeros for one without features."""
    value = np.concatenate([np.zeros((0, dimension)), *(sums(part, dimension)[0] for part in _slices([" ".join(t.lower().split()) for t in texts]))])
    norm = np.sqrt((value * value).sum(1, keepdims=True))
    return np.divide(value, norm, out=np.zeros_like(value), where=norm > 0)


def embed_py(text: str, dimension: int = DIMENSION) -> list[float]:
    return embedded([text], dimension)[0].tolist()


def embed(df: DataFrame, text: str, dimension: int = DIMENSION, out: str = "vector", spread: bool = True) -> DataFrame:
    """df with a column of unit vectors (zeros for a text without features), in Arrow batches. spread deals the rows anew first, for tables of
    few partitions, as small corpora are: much work for each row."""

    @F.pandas_udf(T_.ArrayType(T_.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedded([t or "" for t in texts], dimension).astype(np.float32)), dtype=object)

    return (_spread(df) if spread else df).withColumn(out, run(F.col(text)))


def dot(a: Column, b: Column) -> Column:
    """The dot product over the shorter length; 0 if either is empty or null."""
    n = F.least(F.size(a), F.size(b))
    product = F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.coalesce(n, F.lit(0)) > 0, product).otherwise(0.0)


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows of `width` numbers: cut, or filled with zeros."""
    n = len(vectors)
    flat = vectors.flatten()
    if not vectors.null_count and not flat.null_count and len(flat) == n * width and (np.diff(vectors.offsets.to_numpy()) == width).all():
        return flat.to_numpy().astype(float).reshape(n, width)
    m = np.zeros((n, width))
    for i, v in enumerate(vectors.to_pylist()):
        v = np.asarray(v or (), float)[:width]
        m[i, : len(v)] = v
    return m


def nearest(queries: DataFrame, items: DataFrame, k: int, item_key: str = "item_id", vector: str = "vector", tie: str | None = None) -> DataFrame:
    """The k items with the largest positive dot product for each query: query_id, item_key, score, rank. Exact: every item is compared.

    queries (query_id, vector) are a stated set: they go to the executors as one matrix in blocks, each Arrow batch of items is one matrix
    product, and only a batch's best k of each query go on; a window ranks what is left. Items are read once and don't move.
    """
    rows = queries.select("query_id", vector).collect()
    block = 256
    ids = [r["query_id"] for r in rows]
    width = max((len(r[vector] or ()) for r in rows), default=0)
    matrix = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        matrix[i, : len(r[vector] or ())] = r[vector] or ()
    shared = queries.sparkSession.sparkContext.broadcast((ids, matrix))
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields} | {f.name: f.dataType.simpleString() for f in items.schema.fields}
    names = ["query_id", item_key, "score"]
    types = [to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(items.schema[item_key].dataType), pa.float64()]

    def run(batches):
        ids, matrix = shared.value
        for batch in batches:
            keys = batch.column(item_key).to_pylist()
            if not ids or not keys:
                continue
            m = _matrix(batch.column(vector), matrix.shape[1])
            place = np.argsort(np.argsort(np.array(keys)))
            out: list[list] = [[], [], []]
            for s in range(0, len(ids), block):
                for q, row in enumerate(matrix[s : s + block] @ m.T, s):
                    order = np.lexsort((place, -np.round(row, 12)))[:k]
                    order = order[row[order] > 0]
                    out[0] += [ids[q]] * len(order)
                    out[1] += [keys[i] for i in order]
                    out[2] += row[order].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names)

    found = items.select(item_key, vector).mapInArrow(run, f"query_id {kinds['query_id']}, {item_key} {kinds[item_key]}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), item_key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def index_text(section: Column, heading: Column, body: Column) -> Column:
    """What of a chunk is embedded."""
    return F.concat(F.coalesce(section, F.lit("")), F.lit(" "), heading, F.lit("\n"), body)
