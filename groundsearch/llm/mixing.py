"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundsearch.llm.common import SPACE, arrow_batches, documents, files_for, written

#: Rows that one task rounds at once; more rows of a source meet through further levels of the tree.
BLOCK = 4096
#: A target stops at so many times its source's size.
MOST = 3


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source, by weighted sharing of the total under a cap.

    Sources in code point order (null last) weigh `cycle`, repeating. A target is weight x level, or most x source_size where that is less;
    the level is such that the targets share the whole total. Sorted by cap per weight, the first source that the level leaves below its
    cap fixes the level: two windows over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order)
    weight = F.element_at(F.array(*map(F.lit, cycle)), F.pmod(rank - 1, F.lit(len(cycle))).cast("int") + 1)
    cap = F.col("source_size") * most
    before = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "source").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = sizes.select("source", "source_size", weight.cast("double").alias("weight")).withColumn("ratio", cap / F.col("weight"))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(after)
    t = t.withColumn("level", level).withColumn("level", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), True).over(every))
    target = F.least(cap.cast("double"), F.col("level") * F.col("weight"))
    return t.select("source", "source_size", F.coalesce(target, cap.cast("double")).alias("target"))


def pivot(size: np.ndarray, part: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """Round the fractional copies `part` of one block, in the order given; what they take in words (size x copies) stays the same.

    Neighbours pair up, level by level: words move from one to the other, by a random choice that keeps every expectation, until one is
    integral; the other goes on to the next level. All but one come out integral. If `last`, that one is rounded to the nearer side, and
    what it misses is made up by turning over ever smaller rows while that brings the sum closer.
    """
    out, eps = part.astype(float).copy(), 1e-9
    integral = lambda i: min(abs(out[i]), abs(out[i] - 1)) < eps
    live = []
    for i in range(len(out)):
        if integral(i) or not size[i]:
            out[i] = np.round(out[i])
        else:
            live.append(i)
    while len(live) > 1:
        keep = [live[-1]] if len(live) % 2 else []
        for i, j in zip(live[0::2], live[1::2], strict=False):
            up = min((1 - out[i]) * size[i], out[j] * size[j])
            down = min(out[i] * size[i], (1 - out[j]) * size[j])
            move = up if rng.random() * (up + down) < down else -down
            out[i] += move / size[i]
            out[j] -= move / size[j]
            for k in (i, j):
                if integral(k):
                    out[k] = np.round(out[k])
                else:
                    keep.append(k)
        live = sorted(keep)
    if last and live:
        i = live[0]
        short = (out[i] - np.round(out[i])) * size[i]
        out[i] = np.round(out[i])
        for k in np.argsort(-size, kind="stable"):
            s = size[k]
            if k != i and s and abs(short) >= 0.5 and s < 2 * abs(short) and out[k] == (0 if short > 0 else 1):
                short -= s if short > 0 else -s
                out[k] = 1 - out[k]
    return out


def mix(docs: DataFrame, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of docs (doc_id, text, source, any others).

    size is the number of words `[^\\x20\\x09-\\x0D]+` (null text: 0); a source's rows expect target / source_size copies each, 0 to 3. The
    whole part is certain; the fraction is rounded by pivot(): rows of a source are dealt by a hash of doc_id and size to blocks of about
    `block`, each block leaves one fractional row at most, and these meet in the next level's blocks until a source has one block. A source
    with a third of all rows is therefore many tasks. Random choices depend on the source and block alone, rows are ordered by size, doc_id
    and text digest, so reruns agree and equal rows are interchangeable. Null sources are one source; null doc_ids hash as their own value;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.size(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")).cast("long")
    rows = written(docs.select("doc_id", "source", words.alias("size"), F.xxhash64(text).alias("digest")), "mix-rows")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = written(source_targets(totals.select("source", "source_size")).join(totals.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s").coalesce(1), "mix-targets")
    total = rows.count()  # from the table's footers
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = rows.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate)
    plan = plan.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    # blocks of a source: as many as its rows ask for, at every level
    live = plan.select("doc_id", "source", "size", "digest", "part", "n")
    done, level = None, 0
    while True:
        blocks = F.ceil(F.col("n") / F.lit(block)).cast("long")
        live = live.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "digest", F.lit(level)), "blocks"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "doc_id", "digest", "part"], kind="stable", ignore_index=True)
            source = pdf.source[0]
            key = f"{seed}|{level}|{'' if source is None else 's' + str(source)}|{pdf.block[0]}"
            rng = np.random.default_rng(zlib.crc32(key.encode()))
            pdf["part"] = pivot(pdf["size"].to_numpy(), pdf.part.to_numpy(), rng, bool(pdf.blocks[0] == 1))
            return pdf

        schema = live.schema
        live = written(live.groupBy("source", "block").applyInPandas(run, schema).coalesce(files_for(total)), f"mix-level{level}")
        whole = F.abs(F.col("part") - F.round("part")) < 1e-9
        ended = live.where(whole).select("doc_id", "source", "size", "digest", F.round("part").cast("int").alias("extra"))
        done = ended if done is None else done.union(ended)
        left = live.where(~whole)
        counts = left.groupBy("source").agg(F.count("*").alias("m"))
        if not left.take(1):
            break
        live = left.drop("n", "blocks", "block").join(counts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("m", "n").select("doc_id", "source", "size", "digest", "part", "n")
        level += 1
    t = targets.withColumnRenamed("source", "s").select("s", "source_size", "target")
    out = done.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + F.col("extra")).cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", "digest", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """The rows of docs, each as many times as mix() takes it, with the columns of docs.

    Rows are matched to their copies by doc_id, source and text; among repeated rows the copies are dealt in any order, as these are equal.
    """
    digest = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    taken = mix(docs, block, seed).groupBy("doc_id", "source", "digest").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    taken = taken.select(F.col("doc_id").alias("m_doc"), F.col("source").alias("m_source"), F.col("digest").alias("m_digest"), "copies", "rows")
    one = docs.withColumn("m_d", digest)
    on = F.col("doc_id").eqNullSafe(F.col("m_doc")) & F.col("source").eqNullSafe(F.col("m_source")) & (F.col("m_d") == F.col("m_digest"))
    # of r equal rows each gives copies / r, and the first copies % r one more
    nth = Window.partitionBy("doc_id", "source", "m_d").orderBy(F.lit(1))
    both = one.join(taken, on).withColumn("m_k", F.when(F.col("rows") > 1, F.row_number().over(nth)).otherwise(F.lit(1)))
    times = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("m_k") <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    return both.withColumn("m_t", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)


def op7_mix(spark, sf_dir):
    """doc_id, size, source_size, target, taken of all documents."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
