"""Near-duplicates against all pairs."""

import random
import re

import numpy as np

from ledgerline.llm import neardup as N
from ledgerline.llm import queries as Q
from ledgerline.llm.textkit import U


def shingle_set(t):
    w = re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", re.sub(r"[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def all_pairs(docs, threshold=0.8):
    """Classes by comparing every pair."""
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i, _ in docs if sets[i]]
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i, _ in docs}


def test_all_pairs(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r["doc_id"]: r["class_id"] for r in Q.op5_near_duplicates(spark, "/root/testdata/sf0.01").collect()}
    assert got == all_pairs(docs)


def test_chain_and_group(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    docs = [(i, " ".join(w if rng.random() > 0.012 else f"x{rng.randrange(10**6)}" for w in base)) for i in range(120)]
    docs += [(500 + i, " ".join(base[:100] + [f"y{rng.randrange(10**6)}" for _ in range(100)])) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in N.classes(df).collect()}
    assert got == all_pairs(docs)
    assert N.keep_one(df).count() == len(set(got.values()))


def test_bridge_between_tight_groups(spark):
    rng = random.Random(4)
    fresh = lambda: f"w{rng.randrange(10**9)}"
    docs = []
    for g in range(6):
        base = [fresh() for _ in range(900)]
        other = [*base[:820], *(fresh() for _ in range(80))]
        for k, group in enumerate((base, other)):
            docs += [(100 * g + 50 * k + i, " ".join([*group[:400], fresh(), *group[401:]])) for i in range(4 if g % 2 else 8)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expected = all_pairs(docs)
    assert len(set(expected.values())) == 6
    assert {r["doc_id"]: r["class_id"] for r in N.classes(df).collect()} == expected


def test_similarity_estimate():
    rng = np.random.default_rng(3)
    both, a, b = (rng.integers(0, 2**63, n).astype(U) for n in (900, 50, 50))
    rows = [np.concatenate([both, a]), np.concatenate([both, b]), both[:3]]
    row = np.repeat(np.arange(3), [len(r) for r in rows])
    s = N.probminhash(row, np.concatenate(rows), np.ones(len(row)), 3, 512)
    assert abs((s[0] == s[1]).mean() - 0.9) < 0.05
    assert set(s[2].tolist()) == set(both[:3].tolist())


def test_bands_of_the_verified_measure():
    """Share of pairs of set similarity 0.8 that meet in a band, though the sketch weighs repeated shingles more."""
    rng = np.random.default_rng(8)
    met = 0
    for _ in range(40):
        both, a, b = (rng.integers(0, 2**63, n).astype(U) for n in (160, 20, 20))
        times = np.exp(rng.exponential(1.0, 160)).astype(int).clip(1, 9)
        h = np.concatenate([both, a, both, b])
        s = N.probminhash(np.repeat([0, 1], 180), h, 1 + np.log(np.concatenate([times, np.ones(20), times, np.ones(20)])), 2)
        met += any((s[0, k : k + 4] == s[1, k : k + 4]).all() for k in range(0, 64, 4))
    assert met == 40


def test_bridges_of_large_groups(spark):
    """Two groups of twelve joined only by a chain of two middle texts: as many classes as by all pairs, in every case."""
    rng = random.Random(11)
    fresh = lambda: f"w{rng.randrange(10**9)}"
    docs = []
    for g in range(12):
        end = [fresh() for _ in range(1000)]
        chain = [end]
        for _ in range(3):
            at = rng.randrange(0, 900)
            chain.append([*chain[-1][:at], *(fresh() for _ in range(85)), *chain[-1][at + 85 :]])
        texts = [[*end[:k], fresh(), *end[k + 1 :]] for k in rng.sample(range(1000), 12)] + [chain[1], chain[2]] + [[*chain[3][:k], fresh(), *chain[3][k + 1 :]] for k in rng.sample(range(1000), 12)]
        docs += [(100 * g + i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in N.classes(df).collect()} == all_pairs(docs)


def test_null_ids(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(None, text), (7, text), (9, text), (None, "other words stand here alone today my friend")], "doc_id long, text string")
    assert [r["class_id"] for r in N.classes(df).orderBy("digest", "doc_id").collect()].count(7) == 3
    assert sorted(str(r["doc_id"]) for r in N.keep_one(df).collect()) == ["7", "None"]


def test_odd_rows(odd):
    found = {(r["doc_id"], r["class_id"], r["class_size"]) for r in N.classes(odd.select("doc_id", "text")).collect()}
    assert (1, 1, 2) in found and (3, 3, 1) in found and (4, 4, 1) in found
    kept = N.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert N.classes(odd.limit(0).select("doc_id", "text")).count() == 0
    assert N.keep_one(odd.limit(0)).count() == 0
