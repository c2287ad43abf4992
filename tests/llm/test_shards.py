"""Shards: the smallest capacity by trying all, whole groups, gapless slots."""

import numpy as np

from ledgerline.llm import queries as Q
from ledgerline.llm import shards as S


def test_minimax():
    rng = np.random.default_rng(0)
    for _ in range(200):
        sums = rng.integers(1, 50, rng.integers(1, 40))
        k = int(rng.integers(1, 9))
        capacity, ends = S.minimax(sums, k)
        parts = [int(sums[a:b].sum()) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        assert ends[-1] == len(sums) and len(ends) <= k and max(parts) <= capacity
        assert next(c for c in range(1, int(sums.sum()) + 1) if S.feasible(sums, c, k) is not None) == capacity
    assert S.minimax(np.zeros(0, np.int64), 4) == (0, [])


def test_least_capacity_over_groups(spark):
    """Cells are split until the capacity is that of all groups in order, however few bits they begin with."""
    rng = np.random.default_rng(5)
    for trial in range(6):
        n, k = [(400, 7), (400, 16), (60, 16), (300, 5), (1, 3), (900, 4)][trial]
        h = rng.integers(-(2**63), 2**63 - 1, n)
        h[: n // 3] = (h[0] >> 20 << 20) + np.arange(n // 3) * (trial % 3)  # a crowded cell, or one group
        size = rng.integers(1, 2000, n)
        size[n // 2] = [1, 60_000, 4000, 10**6, 5, 300_000][trial]
        rows = spark.createDataFrame(list(zip(h.tolist(), size.tolist(), strict=True)), "h long, size long")
        groups = np.array([size[h == g].sum() for g in np.unique(h)])
        best = S.minimax(groups, k)[0]
        for bits in (1, 4, 18):
            capacity, bounds = S.cuts(rows, k, bits)
            assert capacity == best and len(bounds) < k
            assert max(size[np.searchsorted(bounds, h) == j].sum() for j in range(k)) <= capacity
    assert S.cuts(spark.createDataFrame([], "h long, size long"), 4) == (0, [])


def test_few_cells_are_split():
    """With no heavy cell only those near cuts are split."""
    rng = np.random.default_rng(1)
    sums = rng.integers(500, 1500, 1 << 18)
    assert 0 < len(S.unclear(sums, np.zeros(len(sums), bool), 16)) < 2000
    assert not len(S.unclear(sums, np.ones(len(sums), bool), 16))


def check(rows, texts):
    of, slots, sizes = {}, {}, {}
    for r in rows:
        of.setdefault(texts[r["doc_id"]] or "", set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert all(len(x) == 1 for x in of.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return sizes


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = Q.op9_sharding(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts) and all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 for r in rows)
    sizes = check(rows, texts)
    assert len(sizes) == 16 and max(sizes.values()) < 1.05 * sum(sizes.values()) / 16


def test_odd_rows(spark, odd):
    found = S.shard(odd, "text", 4)
    assert found.count() == odd.count() and set(found.columns) == set(odd.columns) and found.filter("shard between 0 and 3").count() == odd.count()
    assert S.shard(odd.limit(0), "text", 4).count() == 0
    hot = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(600)], "doc_id long, text string")
    check(S.shard(hot.selectExpr("*", "length(text) + 1 as size"), "text", 4).collect(), {r["doc_id"]: r["text"] for r in hot.collect()})
