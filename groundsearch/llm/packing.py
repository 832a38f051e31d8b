"""Packing documents into sequences of bounded length by a grouping genetic algorithm on islands."""

from __future__ import annotations

import base64
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundsearch.llm.common import arrow_batches, documents, files_for, written

LENGTH, EOS = 1024, 2
#: Items that are packed together; islands of each such block, epochs between migrations, generations of an epoch, solutions of an island.
BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 16384, 2, 2, 12, 4
#: Bins of a new solution in which displaced items are tried in the place of others; items of which pairs are tried.
SWAPS, PAIRS = 24, 16
#: Sequences that leave more tokens free than this are packed again, with those of other blocks.
SLACK = 8
#: Packing again ends where it would take more than this share of a round's items once more.
AGAIN = 0.9


def tokenizer(path: str | None = None):
    """text -> ids of the byte-level BPE of public_tokenizers.path("byte_bpe_50k.json"), special tokens in a text included, none added.

    The ids are computed by tiktoken from the same vocabulary's rank file (path), which gives equal ids at a third of the time; the tests
    hold them against the tokenizers library.
    """
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {"<|endoftext|>": 50256}
    model = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: model.encode(text, allowed_special="all")


class Packing:
    """One solution: bins of items. Best fit finds the fullest bin that an item fits into by a bit mask over the free room of all bins."""

    def __init__(self, sizes: list[int], length: int):
        self.sizes, self.length, self.bins, self.room = sizes, length, {}, {}
        self.free: dict[int, list[int]] = {}  # room -> bins that had it; entries may be out of date
        self.mask, self.next = 0, 0

    def add_bin(self, items: list[int]) -> int:
        k, self.next = self.next, self.next + 1
        self.bins[k] = items
        self._set(k, self.length - sum(self.sizes[i] for i in items))
        return k

    def _set(self, k: int, room: int) -> None:
        self.room[k] = room
        if room:
            self.free.setdefault(room, []).append(k)
            self.mask |= 1 << room

    def put(self, item: int) -> None:
        size = self.sizes[item]
        while True:
            fits = self.mask >> size
            if not fits:
                self.add_bin([item])
                return
            room = size + (fits & -fits).bit_length() - 1
            stack = self.free[room]
            while stack:
                k = stack.pop()
                if self.room.get(k) == room:
                    self.bins[k].append(item)
                    if not stack:
                        self.mask &= ~(1 << room)
                    self._set(k, room - size)
                    return
            self.mask &= ~(1 << room)

    def drop(self, k: int) -> list[int]:
        del self.room[k]
        return self.bins.pop(k)

    def copy(self) -> Packing:
        new = Packing(self.sizes, self.length)
        new.bins = {k: list(b) for k, b in self.bins.items()}
        new.room, new.mask, new.next = dict(self.room), self.mask, self.next
        new.free = {r: list(s) for r, s in self.free.items()}
        return new

    def cost(self) -> tuple[int, int]:
        """Bins, then the fuller the fewer: less the sum of squared fills."""
        return len(self.bins), -sum((self.length - r) ** 2 for r in self.room.values())


def best_fit(sizes: list[int], length: int, order) -> Packing:
    p = Packing(sizes, length)
    for i in order:
        p.put(i)
    return p


def crossover(a: Packing, b: Packing, rng: random.Random, share: float = 0.1) -> Packing:
    """a with some of b's well-filled bins: a's bins that hold any of their items go, and what else these held is put in by best fit."""
    child = a.copy()
    place = {i: k for k, items in child.bins.items() for i in items}
    full = [k for k, r in b.room.items() if r <= SLACK]
    chosen = rng.sample(full, min(len(full), max(1, int(share * len(b.bins))))) if full else []
    injected, homeless = set(), []
    for k in chosen:
        injected.update(b.bins[k])
    for k in {place[i] for i in injected}:
        homeless += [i for i in child.drop(k) if i not in injected]
    for k in chosen:
        child.add_bin(list(b.bins[k]))
    return settle(child, homeless, rng)


def settle(child: Packing, homeless: list[int], rng: random.Random) -> Packing:
    """Empty a few of the least filled bins as well; let displaced items take the place of smaller ones where that fills a bin better; and put
    what is displaced then in by best fit, longest first."""
    worst = sorted(child.room, key=lambda k: (-child.room[k], k))[: 2 + len(child.room) // 50]
    for k in rng.sample(worst, min(len(worst), 1 + len(worst) // 2)):
        homeless += child.drop(k)
    open_ = [k for k in sorted(child.room) if child.room[k]]
    for k in rng.sample(open_, min(len(open_), SWAPS)):
        homeless = exchange(child, k, homeless)
    homeless.sort(key=lambda i: (-child.sizes[i], i))
    for i in homeless:
        child.put(i)
    return child


def exchange(p: Packing, k: int, homeless: list[int]) -> list[int]:
    """Replace one or two items of bin k by one or two displaced items that are longer together, by as much as fits; the displaced items then."""
    sizes, room, items = p.sizes, p.room[k], p.bins[k]
    near = sorted(homeless, key=lambda i: (sizes[i], i))
    new = [((), 0), *(((i,), sizes[i]) for i in near)]
    if len(near) <= PAIRS:
        new += [((a, b), sizes[a] + sizes[b]) for n, a in enumerate(near) for b in near[n + 1 :]]
    best, gain = None, 0
    mine = sorted(items[-PAIRS:])
    for old in [*((i,) for i in mine), *((a, b) for n, a in enumerate(mine) for b in mine[n + 1 :])]:
        out = sum(sizes[i] for i in old)
        for group, size in new:
            if gain < size - out <= room and len(group) <= len(old) + 1:
                best, gain = (old, group), size - out
        if gain == room:
            break
    if best is None:
        return homeless
    old, group = best
    p.drop(k)
    p.add_bin([i for i in items if i not in old] + list(group))
    return [i for i in homeless if i not in group] + list(old)


def complement_fit(sizes: list[int], length: int) -> Packing:
    """Bins begun by the longest item left and closed by the two items, or the one, that come nearest to filling it; the rest by best fit."""
    left: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), reverse=True):
        left.setdefault(sizes[i], []).append(i)
    count = np.zeros(length + 1, np.int64)
    for s, items in left.items():
        count[s] = len(items)
    p, small = Packing(sizes, length), []
    for s in range(length, 0, -1):
        while count[s]:
            count[s] -= 1
            first, room = left[s].pop(), length - s
            have = np.flatnonzero(count[: room + 1] > 0)
            have = have[have > 0]
            if not len(have):
                small.append(first)
                continue
            # for each second item the longest third that still fits; a size serves twice only where two items have it
            third = np.searchsorted(have, room - have, side="right") - 1
            third = np.where((third >= 0) & (have[third] == have) & (count[have] < 2), third - 1, third)
            total = have + np.where(third >= 0, have[third], 0)
            pick = int(total.argmax())
            items = [first]
            for x in (have[pick], *([have[third[pick]]] if third[pick] >= 0 else [])):
                count[x] -= 1
                items.append(left[int(x)].pop())
            p.add_bin(items)
    for i in small:
        p.put(i)
    return p


def evolve(sizes: list[int], seeds: list[list[int]], rng: random.Random, length: int = LENGTH, generations: int = GENERATIONS, population: int = POPULATION) -> list[int]:
    """The bin number of each item in the best solution of an island; seeds: solutions to begin with, as bin numbers.

    It ends early where the sum of the sizes allows no fewer bins.
    """
    least = -(-sum(sizes) // length)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    pool = []
    for s in seeds:
        p, by = Packing(sizes, length), {}
        for i, k in enumerate(s):
            by.setdefault(k, []).append(i)
        for items in by.values():
            p.add_bin(items)
        pool.append(p)
    if not pool:
        pool.append(best_fit(sizes, length, order))
        if len(pool[0].bins) > least:
            pool.append(complement_fit(sizes, length))
    while len(pool) < population and min(p.cost()[0] for p in pool) > least:
        pool.append(best_fit(sizes, length, sorted(order, key=lambda i: -sizes[i] * (1 + 0.1 * rng.random()))))
    pool.sort(key=Packing.cost)
    for _ in range(generations):
        if len(pool[0].bins) <= least:
            break
        a, b = rng.sample(range(len(pool)), 2) if len(pool) > 1 else (0, 0)
        child = crossover(pool[min(a, b)], pool[max(a, b)], rng)
        pool = sorted([*pool, child], key=Packing.cost)[:population]
    out = [0] * len(sizes)
    for n, k in enumerate(sorted(pool[0].bins)):
        for i in pool[0].bins[k]:
            out[i] = n
    return out


def token_pieces(docs: DataFrame, length: int = LENGTH, eos: int = EOS, path: str | None = None) -> DataFrame:
    """(doc_id, n_ids, crcs, uid) of every row: its ids and eos are counted, cut from the end into pieces of `length` (the first may be
    shorter), and each piece's CRC-32 is kept. uid numbers a row's first piece; the next pieces have the numbers after it.

    The table is written to the shared folder, so the numbers hold from then on.
    """
    arrow_batches(docs.sparkSession)

    def run(batches):
        encode, at = tokenizer(path), TaskContext.get().partitionId() << 33
        for batch in batches:
            counts, crcs, uids = [], [], []
            for text in batch.column("text").to_pylist():
                ids = np.array([*encode(text or ""), eos], "<u4")
                cuts = list(range(len(ids) % length, len(ids) + 1, length))
                cuts = cuts if cuts[0] == 0 else [0, *cuts]
                counts.append(len(ids))
                crcs.append([zlib.crc32(ids[s:e].tobytes()) for s, e in zip(cuts, cuts[1:], strict=False)])
                uids.append(at)
                at += len(crcs[-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(uids, pa.int64())], ["doc_id", "n_ids", "crcs", "uid"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return written(docs.mapInArrow(run, f"doc_id {kind}, n_ids long, crcs array<long>, uid long"), "pack-pieces")


_ISLAND = "block long, island int, uids array<long>, sizes array<int>, bins array<int>, n_bins int, fill double"


def pack_items(items: DataFrame, n: int, level: int, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """(uid, size, block, bin, offset, used) for items (uid, size), n of them: one round of islands over blocks of about `block` items.

    An island is a row with its block's sizes and its elite; each epoch runs all islands in parallel, then every elite migrates to the next
    island of its block.
    """
    spark = items.sparkSession
    blocks = max(1, -(-n // block))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks)))

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        row = {"block": pdf.block.iloc[0], "uids": pdf.uid.tolist(), "sizes": pdf["size"].tolist(), "bins": [], "n_bins": 0, "fill": 0.0}
        return pd.DataFrame([row | {"island": i} for i in range(ISLANDS)])[["block", "island", "uids", "sizes", "bins", "n_bins", "fill"]]

    def epoch(number: int):
        def run(batches):
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    sizes = [int(s) for s in r.sizes]
                    seeds = [[int(x) for x in s] for s in (r.bins, getattr(r, "migrant", None)) if s is not None and len(s)]
                    bins = evolve(sizes, seeds, random.Random(f"{level}|{number}|{r.block}|{r.island}"), length)
                    used = np.bincount(bins, sizes)
                    out.append((r.block, r.island, list(map(int, r.uids)), sizes, bins, len(used), float((used**2).sum())))
                yield pd.DataFrame(out, columns=["block", "island", "uids", "sizes", "bins", "n_bins", "fill"])

        return run

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # rows here are whole blocks
    wide = min(blocks * ISLANDS, 4096)
    state = dealt.groupBy("block").applyInPandas(begin, _ISLAND).repartition(wide, "block", "island").mapInPandas(epoch(0), _ISLAND)
    state = written(state, f"pack-islands-{level}-0")
    for e in range(1, EPOCHS):
        least = F.ceil(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, s: a + s) / length)
        if not state.where(F.col("n_bins") > least).take(1):
            break
        migrant = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("bins").alias("migrant"))
        state = written(state.join(migrant, ["block", "island"]).repartition(wide, "block", "island").mapInPandas(epoch(e), _ISLAND), f"pack-islands-{level}-{e}")
    best = state.groupBy("block").agg(F.min_by(F.struct("uids", "sizes", "bins"), F.struct("n_bins", -F.col("fill"), "island")).alias("b")).select("block", "b.*")

    def place(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                bins, sizes = np.asarray(r.bins, np.int64), np.asarray(r.sizes, np.int64)
                order = np.argsort(bins, kind="stable")
                run = np.cumsum(sizes[order]) - sizes[order]
                first = np.concatenate(([True], bins[order][1:] != bins[order][:-1]))
                offset = run - np.maximum.accumulate(np.where(first, run, 0))
                used = np.bincount(bins, sizes).astype(np.int64)
                yield pd.DataFrame({"uid": np.asarray(r.uids, np.int64)[order], "size": sizes[order], "block": r.block, "bin": bins[order], "offset": offset, "used": used[bins[order]]})

    out = written(best.mapInPandas(place, "uid long, size int, block long, bin long, offset long, used long").coalesce(files_for(n)), f"pack-placed-{level}")
    arrow_batches(spark)
    return out


def pack(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, path: str | None = None) -> DataFrame:
    """A row for each piece of each row of docs (doc_id, text, any others): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces of full length are sequences by themselves; a document's shorter first piece is an item to pack. Items are dealt by hash to
    blocks, whose islands evolve packings; the sequences of a round that are full up to SLACK tokens stay, and the items of the others are
    packed again with those of all blocks, in fewer blocks, until one block holds them or a round leaves nearly all its items (AGAIN) in
    ill-filled sequences, so that another could not gain. Only sizes and numbers move. A null text is an empty one, which is the eos alone;
    repeated rows are packed each, in any order where sizes tie; other columns play no part; an empty table gives no rows.
    """
    pieces = token_pieces(docs, length, path=path)
    first = F.when(F.col("n_ids") < length, F.col("n_ids")).otherwise(F.col("n_ids") % length)
    pieces = pieces.withColumn("head", first)
    items, level, placed = pieces.where("head > 0").select("uid", F.col("head").cast("int").alias("size")), 0, []
    n = items.count()
    while n:
        got = pack_items(items, n, level, length, block)
        again = got.where(length - F.col("used") > SLACK)
        m = again.count() if n > block else 0
        if m and m < AGAIN * n:
            placed.append((level, got.where(length - F.col("used") <= SLACK)))
            items, n = again.select("uid", "size"), m
            level += 1
        else:
            placed.append((level, got))
            n = 0
    empty = pieces.sparkSession.createDataFrame([], "uid long, seq long, offset long")
    for k, got in placed:
        seq = (F.lit(k).cast("long") * (1 << 50)) + F.col("block") * (1 << 20) + F.col("bin")
        empty = empty.union(got.select("uid", seq.alias("seq"), "offset"))
    joined = pieces.join(empty, "uid", "left")
    rows = joined.select("doc_id", "n_ids", "uid", "head", "seq", "offset", F.posexplode("crcs").alias("piece", "crc"))
    whole = (F.col("piece") > 0) | (F.col("head") == 0)
    start = F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.when(F.col("head") > 0, F.col("head") + (F.col("piece") - 1) * length).otherwise(F.col("piece") * length))
    return rows.select(
        "doc_id", "piece", start.cast("long").alias("start"), F.when(whole, F.lit(length)).otherwise(F.col("head")).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"), F.when(whole, -1 - F.col("uid") - F.col("piece")).otherwise(F.col("seq")).alias("sequence_id"),
        F.when(whole, F.lit(0)).otherwise(F.col("offset")).cast("long").alias("offset"),
    )


def op2_packing(spark, sf_dir):
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all documents."""
    return pack(documents(spark, sf_dir))
