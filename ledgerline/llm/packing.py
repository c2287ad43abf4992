"""Packing documents into sequences by a grouping genetic algorithm.

Each document's ids, closed by one end id, are cut only beyond ``capacity``.
Full pieces are sequences of their own.  The others are dealt into blocks of
about ``block_items`` pieces by a hash of a row number; each block has
``islands`` populations.  In a population, crossover injects well-filled bins
of one parent into the other, drops the bins that then hold a piece twice, and
puts displaced pieces back by best fit; between epochs the best solution of
each island migrates to the next.  Each epoch evolves ``generations``
generations; where the best has reached the lower bound by then, no later
generation could gain, and only ``least`` of them are evolved.
The emptiest bin of every block is dissolved and such pieces are packed again,
``merge`` blocks together, so blocks cost next to no extra sequence.

Memory: a task holds one block's sizes.  Nothing but counts reaches the
driver.  Defined results: a null or empty text is the end id alone; repeated
rows and ids are packed as often as they occur; an empty table gives no row;
extra columns aren't read.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialize
from .textkit import chunks
from .wordbpe import shared

CAPACITY = 4096


class Bins:
    """Bins of a solution with best-fit insertion."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: dict[int, list[int]] = {}
        self.bits = 0

    def _file(self, b: int) -> None:
        room = self.room[b]
        own = self.by_room.setdefault(room, [])
        own.append(b)
        if len(own) == 1:
            self.bits |= 1 << room

    def add_bin(self, items: list[int]) -> None:
        """Take a whole bin over."""
        self.items.append(list(items))
        self.room.append(self.capacity - sum(self.sizes[i] for i in items))
        self._file(len(self.items) - 1)

    def best_fit(self, i: int) -> None:
        """Put item i where the least room is left over; open a bin if it fits nowhere."""
        size = self.sizes[i]
        rest = self.bits >> size
        if not rest:
            self.add_bin([i])
            return
        room = size + (rest & -rest).bit_length() - 1
        own = self.by_room[room]
        b = own.pop()
        if not own:
            self.bits &= ~(1 << room)
        self.items[b].append(i)
        self.room[b] = room - size
        self._file(b)

    def key(self) -> tuple[int, float]:
        """Fewer bins first, then the more unevenly filled."""
        return len(self.items), -sum((1 - r / self.capacity) ** 2 for r in self.room)


def build(sizes: list[int], capacity: int, order: list[int]) -> Bins:
    """Best fit in the given order."""
    out = Bins(sizes, capacity)
    for i in order:
        out.best_fit(i)
    return out


def crossover(a: Bins, b: Bins, rng: random.Random) -> Bins:
    """A child of a that holds some well-filled bins of b whole."""
    well = sorted(range(len(b.items)), key=b.room.__getitem__)[: max(1, len(b.items) // 2)]
    chosen = rng.sample(well, max(1, len(well) // 2))
    child, placed = Bins(a.sizes, a.capacity), set()
    for k in chosen:
        child.add_bin(b.items[k])
        placed.update(b.items[k])
    loose = []
    for items in a.items:
        if placed.isdisjoint(items):
            child.add_bin(items)
        else:
            loose += [i for i in items if i not in placed]
    for i in sorted(loose, key=a.sizes.__getitem__, reverse=True):
        child.best_fit(i)
    return child


def mutate(a: Bins, rng: random.Random) -> Bins:
    """A copy with its emptiest bin and a few others dissolved and put back by best fit."""
    order = sorted(range(len(a.items)), key=a.room.__getitem__)
    gone = {order[-1], *rng.sample(order, min(len(order), 3))}
    child = Bins(a.sizes, a.capacity)
    for k in range(len(a.items)):
        if k not in gone:
            child.add_bin(a.items[k])
    for i in sorted((i for k in gone for i in a.items[k]), key=a.sizes.__getitem__, reverse=True):
        child.best_fit(i)
    return child


def from_labels(sizes: list[int], capacity: int, labels: list[int]) -> Bins:
    """A solution from each item's bin number."""
    groups: dict[int, list[int]] = {}
    for i, k in enumerate(labels):
        groups.setdefault(int(k), []).append(i)
    out = Bins(sizes, capacity)
    for items in groups.values():
        out.add_bin(items)
    return out


def to_labels(solution: Bins) -> list[int]:
    """Each item's bin number."""
    out = [0] * len(solution.sizes)
    for k, items in enumerate(solution.items):
        for i in items:
            out[i] = k
    return out


def evolve(sizes: list[int], capacity: int, seeds: list[list[int]], *, population: int = 4, generations: int = 12, least: int = 3, seed: int = 0) -> tuple[list[Bins], int]:
    """(the population after some generations, best first; number of crossovers); ``seeds`` are solutions to begin with.

    Newcomers are built by best fit in an order that is falling for the first
    and disturbed for the others.  A generation crosses the best with another
    and two others, and changes the best; what is worse than all makes room.
    """
    rng = random.Random(seed)
    bound = -(-sum(sizes) // capacity)
    pool = [from_labels(sizes, capacity, s) for s in seeds]
    falling = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    while len(pool) < population:
        order = falling if not pool else sorted(range(len(sizes)), key=lambda i: -sizes[i] * rng.uniform(0.8, 1.2))
        pool.append(build(sizes, capacity, order))
    pool.sort(key=Bins.key)
    crossed = 0
    for turn in range(generations):
        if turn >= least and len(pool[0].items) <= bound or len(pool) < 2:
            break
        a, b = rng.sample(pool[1:], 2) if len(pool) > 2 else (pool[1], pool[0])
        children = [crossover(pool[0], a, rng), crossover(b, a, rng), mutate(pool[0], rng)]
        crossed += 2
        pool = sorted([*pool, *children], key=Bins.key)[:population]
    return pool, crossed


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every row of ``docs`` (doc_id, text)."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(tokenizer)
        for batch in batches:
            for low, _, data, at in chunks(batch.column(1)):
                ids, row_at = bpe.encode(data, at)
                n = len(at) - 1
                closed = np.insert(ids, row_at[1:], end_id).astype("<u4")
                raw = memoryview(closed).cast("B")
                first = row_at[:-1] + np.arange(n)
                total = np.diff(row_at) + 1
                count = -(-total // capacity)
                row = np.repeat(np.arange(n), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, total[row] - start)
                begin = (first[row] + start) * 4
                crc = [zlib.crc32(raw[b : b + s]) for b, s in zip(begin.tolist(), (length * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, n).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def solve(items: DataFrame, capacity: int, islands: int, epochs: int, generations: int = 12) -> DataFrame:
    """``items`` (block, rows: array of structs with length) with a bin number per row, in column bins, and the number of crossovers."""
    state = items.select("block", F.col("rows.length").alias("sizes")).select("block", "sizes", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    state = state.withColumns({"seeds": F.array().cast("array<array<int>>"), "crossed": F.lit(0).cast("long")})
    shape = "block long, sizes array<long>, island int, seeds array<array<int>>, crossed long"

    def run(epoch: int):
        def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                solved, crossed = [], []
                for r in frame.itertuples():
                    pool, n = evolve([int(x) for x in r.sizes], capacity, [list(x) for x in r.seeds], generations=generations, seed=hash((int(r.block), int(r.island), epoch)))
                    solved.append([to_labels(s) for s in pool[:2]])
                    crossed.append(int(r.crossed) + n)
                yield frame.assign(seeds=solved, crossed=crossed)

        return step

    for epoch in range(epochs):
        state = materialize(state.mapInPandas(run(epoch), shape), f"islands{epoch}")
        if epoch + 1 < epochs:  # the elite of each island migrates to the next one
            elite = state.select("block", ((F.col("island") + 1) % islands).cast("int").alias("island"), F.col("seeds")[0].alias("elite"))
            state = state.join(elite, ["block", "island"]).select("block", "sizes", "island", F.concat("seeds", F.array("elite")).alias("seeds"), "crossed")
    found = state.select("block", "island", F.col("seeds")[0].alias("bins"), "crossed").groupBy("block")
    best = found.agg(F.min_by("bins", F.struct(F.array_max("bins"), F.col("island"))).alias("bins"), F.sum("crossed").alias("crossed"))
    return items.join(best, "block")


def number(solved: DataFrame) -> DataFrame:
    """One row per piece: block, bin, offset in the bin, fill of the bin, and the piece's columns."""
    entry = F.arrays_zip(F.col("rows").alias("r"), F.col("bins").alias("bin"))
    flat = solved.select("block", F.posexplode(entry).alias("place", "e")).select("block", "place", F.col("e.r.*"), F.col("e.bin").alias("bin"))
    from pyspark.sql import Window

    whole = Window.partitionBy("block", "bin")  # a bin holds at most ``capacity`` pieces
    before = whole.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return flat.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).withColumn("fill", F.sum("length").over(whole))


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = 1, block_items: int = 4096, islands: int = 2, epochs: int = 2, merge: int = 64) -> DataFrame:
    """Pieces of ``docs`` with sequence_id and offset: see the module."""
    cut = materialize(pieces(docs, tokenizer, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = cut.filter(F.col("length") == capacity).select(*columns, (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    small = cut.filter(F.col("length") < capacity)
    blocks = max(1, -(-small.count() // block_items))
    entry = F.struct("length", "row", "doc_id", "piece", "start", "ids_crc32")

    def gather(rows: DataFrame, block) -> DataFrame:
        return materialize(rows.select(block.cast("long").alias("block"), entry.alias("e")).groupBy("block").agg(F.sort_array(F.collect_list("e")).alias("rows")), "blocks")

    first = materialize(number(solve(gather(small, F.pmod(F.xxhash64("row"), F.lit(blocks))), capacity, islands, epochs)), "packed")
    from pyspark.sql import Window

    worst = first.groupBy("block").agg(F.min_by("bin", F.struct("fill", "bin")).alias("worst"))
    marked = first.join(worst, "block").withColumn("loose", F.col("bin") == F.col("worst"))
    stays = marked.filter(~F.col("loose")).select(*columns, (F.col("block") * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset")
    again = gather(marked.filter("loose"), F.floor(F.col("block") / merge))
    last = number(solve(again, capacity, islands, epochs)).select(*columns, ((F.col("block") + blocks) * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset")
    return full.unionByName(stays).unionByName(last)
