"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from ledgerline.llm import ann as A
from ledgerline.llm import queries as Q


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = (x * x[ids.index(q)]).sum(1)
        order = sorted((-s[i], ids[i]) for i in range(len(ids)) if ids[i] != q)[:k]
        out[q] = [(v, -n) for n, v in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, exact):
    return np.mean([len({v for v, _ in got[q]} & {v for v, _ in e}) / len(e) for q, e in exact.items()])


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    exact = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    got = found(Q.op6_ann_search(spark, "/root/testdata/sf0.1"))
    assert recall(got, exact) >= 0.9 and all(len(v) == 20 for v in got.values())


@pytest.mark.parametrize("scale", [1.0, 3.0])
def test_part_of_the_cells(spark, scale):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)) * rng.uniform(1, scale, (3000, 1))
    x[100:1100] = x[100]
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    exact = brute(list(range(3000)), x, range(0, 3000, 100), 10)
    got = found(A.search(d, lambda i: i % 100 == 0, k=10, centroids=16, least=600, reach=0.5, block=200))
    assert recall(got, exact) >= 0.9
    assert [v for v, _ in got[200]][:5] == [v for v, _ in exact[200]][:5]
    assert all(abs(s - x[v] @ x[q]) < 1e-9 for q, r in got.items() for v, s in r)


def test_recall_of_the_registered_parameters(spark):
    """64 dimensions, nearly random, and more vectors than the least number ranked: the index visits a part of its cells."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(20_000, 64)) + 0.5 * rng.normal(size=(40, 64))[rng.integers(0, 40, 20_000)]
    x /= np.sqrt((x * x).sum(1))[:, None]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    x = np.float32(x).astype(float)
    asked = range(0, 20_000, 400)
    exact = {q: [(int(v), 0.0) for v in np.lexsort((np.arange(len(x)), -(x @ x[q]))) if v != q][:20] for q in asked}
    got = found(A.search(d, lambda i: i % 400 == 0))
    assert 0.9 <= recall(got, exact) < 1


def test_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (5, [0.8, 0.6]), (6, [0.6, 0.8])]
    got = [tuple(r) for r in A.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 0, k=3).collect()]
    twice = [(0, 1, 0, 1.0), (0, 2, 5, 0.8), (0, 3, 6, 0.6)]
    assert sorted(got) == sorted([*twice, *twice, (0, 1, 6, 0.8), (0, 2, 5, 0.6), (0, 3, 0, 0.0)])


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [float("inf"), 0.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [])]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rank int, score int")
    got = found(A.search(d, lambda i: i % 20 == 0, k=20))
    assert got == {0: [(8, 1.0), (8, 1.0), (20, 1.0), (1, 0.5)], 20: [(0, 1.0), (8, 1.0), (8, 1.0), (1, 0.5)]}
    assert A.search(d.limit(0), lambda i: i % 20 == 0).count() == 0
