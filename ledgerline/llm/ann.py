"""Nearest neighbours by inner product with an inverted multi-index.

Vectors are cut into two halves; each half has its own centroids, fitted by
k-means on a bounded sample; their number grows with the square root of the
number of vectors, so that the work of finding cells and that of ranking
entries grow alike.  A vector lies in the cell of its two nearest
centroids.  For a query the cells come in order of summed distance from a heap
over centroid pairs (the multi-sequence walk) until the cells taken hold
``reach`` of all vectors and ``least`` vectors; every vector of those cells is
ranked by the exact inner product in double precision.  Unit vectors make the
order by distance the order by inner product; others are scaled to the longest
norm's sphere by one more coordinate in the second half, which keeps it so.

Equal vectors form one entry that keeps the smallest ids a result could need
(k+1 rows' ids), so a vector that a third of the rows share is ranked once; no
result changes by that.  Entries are grouped by their first centroid and dealt into
blocks of ``block`` rows, queries likewise; a task ranks one block against one
block.  What the driver gets is the number of entries per cell, at most
``centroids`` squared numbers, and the sample.

Defined results: vectors null, zero, of another length than most, or with null
or non-finite components take no part, nor do null ids; ties go to the smaller
id; every row but the query's own is a candidate, so rows with equal ids are
each other's, and each is a query of its own, with results under the same
query_id; with fewer candidates than k all are returned; an empty table gives
no row.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct rows of x."""
    rng = np.random.default_rng(seed)
    rows = np.unique(x, axis=0)
    centres = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        for j in range(x.shape[1]):
            total = np.bincount(near, x[:, j], len(centres))
            centres[:, j] = np.where(count > 0, total / np.maximum(count, 1), centres[:, j])
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centroid of each row, in blocks."""
    return np.concatenate([distances(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


class MultiIndex:
    """Centroids of both halves and the number of entries in every cell."""

    def __init__(self, sample: np.ndarray, centroids: int, longest: float):
        self.dim, self.longest = sample.shape[1], longest
        self.half = self.dim // 2
        a, b = self.halves(sample)
        self.first, self.second = kmeans(a, centroids), kmeans(b, centroids, seed=4)
        self.counts = np.zeros((len(self.first), len(self.second)), np.int64)

    def halves(self, x: np.ndarray, query: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Both halves; stored vectors get the coordinate that brings them to the longest norm, queries a 0."""
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.longest**2 - (x * x).sum(1)))
        return x[:, : self.half], np.concatenate([x[:, self.half :], rest[:, None]], 1)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each stored vector."""
        a, b = self.halves(x)
        return nearest(a, self.first), nearest(b, self.second)

    def walk(self, query: np.ndarray, wanted: int) -> list[tuple[int, int]]:
        """Cells in order of summed distance until they hold ``wanted`` entries."""
        a, b = self.halves(query[None, :] * (self.longest / max(1e-300, float(np.sqrt(query @ query)))), True)
        da, db = distances(a, self.first)[0], distances(b, self.second)[0]
        oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
        da, db = da[oa].tolist(), db[ob].tolist()
        heap, out, held = [(da[0] + db[0], 0, 0)], [], 0
        pushed = {(0, 0)}
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            n = int(self.counts[oa[i], ob[j]])
            if n:
                out.append((int(oa[i]), int(ob[j])))
                held += n
            for p, q in ((i + 1, j), (i, j + 1)):
                if p < len(da) and q < len(db) and (p, q) not in pushed:
                    pushed.add((p, q))
                    heapq.heappush(heap, (da[p] + db[q], p, q))
        return out


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id and v (array of doubles) of the rows that take part."""
    v = F.col("v")
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & good)
    return rows.filter(F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim) if len(column) else np.zeros((0, dim))


def search(vectors: DataFrame, is_query, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20, centroids: int | None = None, sample: int = 8192, reach: float = 0.55, least: int = 4000, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each row of ``vectors`` for which ``is_query`` (a column over vec_id) holds; ``centroids`` of a half: a quarter of the square root of the number of distinct vectors, as a power of two from 16 to 1024, unless given."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    shape = rows.select(F.size("v").alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").head()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if shape is None:
        return none
    dim = shape["d"]
    rows = rows.filter(F.size("v") == dim)
    # One entry per distinct vector, with the k+1 smallest ids that bear it, repeats included.
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    entries = materialize(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    facts = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm")).head()
    # Entries are distinct, so a share of their hashes' range is a sample of bounded size.
    if centroids is None:
        centroids = int(min(1024, max(16, 2 ** round(math.log2(max(1.0, math.sqrt(facts["n"]) / 4))))))
    sample = max(sample, 16 * centroids)
    share = min(1.0, sample / facts["n"])
    taken = sorted(r["v"] for r in entries.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 40)) <= int(share * (1 << 40))).select("v").limit(2 * sample).collect())
    index = MultiIndex(np.array(taken, float), centroids, float(np.sqrt(facts["norm"])))
    sent = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = sent.value.cells(matrix(batch.column(0), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["v", "ids", "a", "b"])

    placed = materialize(entries.mapInArrow(place, "v array<double>, ids array<long>, a int, b int"), "cells")
    held = placed.groupBy("a", "b").count().toPandas()  # at most centroids**2 rows
    index.counts[held["a"], held["b"]] = held["count"]
    full = spark.sparkContext.broadcast(index)
    wanted = max(least, int(reach * facts["n"]))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per query and first centroid visited, with the second centroids."""
        own = full.value
        for batch in batches:
            at, first, second = [], [], []
            for i, q in enumerate(matrix(batch.column(1), dim)):
                groups: dict[int, list[int]] = {}
                for a, b in own.walk(q, wanted):
                    groups.setdefault(a, []).append(b)
                at += [i] * len(groups)
                first += groups
                second += groups.values()
            pick = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pick) for k in range(3)), pa.array(first, pa.int32()), pa.array(second, pa.list_(pa.int32()))], names=["query_id", "v", "nth", "a", "bs"])

    # Rows of equal id and vector get equal results: one is asked, ``nth`` times answered.
    asked = rows.filter(is_query(F.col("id"))).groupBy(F.col("id").alias("query_id"), "v").agg(F.count(F.lit(1)).alias("nth"))
    # The walk is work per query, not per byte: a number of its own keeps small rows from being put into one task.
    parts = min(10_000, -(-max(1, asked.count()) // 128))
    visits = materialize(asked.repartition(parts, "query_id").mapInArrow(visit, "query_id long, v array<double>, nth long, a int, bs array<int>"), "visits")
    # Both sides of a centroid are dealt into blocks of bounded size; each pair of blocks meets in one task.
    blocks_of = lambda df: df.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
    sizes = blocks_of(placed).withColumnRenamed("n", "nv").join(blocks_of(visits).withColumnRenamed("n", "nq"), "a")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(sizes, "a").withColumn("q", F.pmod(F.xxhash64("query_id", "v"), F.col("nq")).cast("int")).select("query_id", "v", "nth", F.xxhash64("v").alias("vh"), "a", "bs", "q", upto("nv").alias("p"))
    right = placed.join(sizes, "a").withColumn("p", F.pmod(F.xxhash64("v"), F.col("nv")).cast("int")).select("v", "ids", "a", "b", "p", upto("nq").alias("q"))

    def rank(asked: pa.Table, stored: pa.Table) -> pa.Table:
        out_q, out_v, out_s, out_n, out_h = [], [], [], [], []
        if asked.num_rows and stored.num_rows:
            x = matrix(stored["v"].combine_chunks(), dim)
            b = stored["b"].to_numpy()
            ids = stored["ids"].combine_chunks()
            flat, ends = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
            second, names, times, hashes = asked["bs"].to_pylist(), asked["query_id"].to_numpy(), asked["nth"].to_numpy(), asked["vh"].to_numpy()
            queries = matrix(asked["v"].combine_chunks(), dim)

            def keep(i: int, mine: np.ndarray) -> None:
                """The k best of some entries for query i; summed in one fixed order, so equal vectors get equal scores."""
                exact = (x[mine] * queries[i]).sum(1)
                found = []
                for e, s in zip(mine, exact, strict=True):
                    own = flat[ends[e] : ends[e + 1]].tolist()
                    if names[i] in own and (x[e] == queries[i]).all():
                        own.remove(names[i])  # the query's own row, one of its equals
                    found += [(-s, v) for v in own]
                for s, v in sorted(found)[:k]:
                    out_q.append(int(names[i]))
                    out_v.append(v)
                    out_s.append(-s)
                    out_n.append(int(times[i]))
                    out_h.append(int(hashes[i]))

            for low in range(0, len(names), 256):
                part = queries[low : low + 256]
                seen = np.zeros((len(part), int(b.max()) + 1 if len(b) else 1), bool)
                for i in range(len(part)):
                    mine = np.asarray(second[low + i])
                    seen[i, mine[mine < seen.shape[1]]] = True
                rough = np.where(seen[:, b], part @ x.T, -np.inf)
                # The query itself may be one of the best k+1; a margin covers the product's rounding.
                cut = np.partition(rough, rough.shape[1] - k - 1, axis=1)[:, rough.shape[1] - k - 1] if rough.shape[1] > k + 1 else np.full(len(part), -np.inf)
                for i in range(len(part)):
                    mine = np.flatnonzero((rough[i] >= cut[i] - 1e-9 * (1 + abs(cut[i]))) & np.isfinite(rough[i])) if np.isfinite(cut[i]) else np.flatnonzero(np.isfinite(rough[i]))
                    keep(low + i, mine)
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vh": pa.array(out_h, pa.int64()), "nth": pa.array(out_n, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    pairs = left.groupBy("a", "p", "q").cogroup(right.groupBy("a", "p", "q")).applyInArrow(rank, "query_id long, vh long, nth long, vec_id long, score double")
    best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "vh").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "nth"))).drop("col")
