"""State, classes and gaps against goldens and a sequential fold."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerline.operators import state as St
from ledgerline.schemas import CHANGES
from tests.conftest import rows

GOLD = [
    (1, 0, "bank", b"\x01", b"A", False), (1, 1, "bank", b"\x02", b"B", False), (1, 2, "lockup", b"\x01", b"C", False), (2, 0, "bank", b"\x01", b"D", False), (2, 1, "bank", b"\x02", None, True),
    (2, 2, "bank", b"\x02", b"E", False), (3, 0, "bank", b"\x01", None, True), (3, 1, "bank", b"\x09", None, True), (3, 2, "lockup", b"\x80", b"F", False),
]


def frame(spark, data):
    return spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in r) for r in data], CHANGES)


def state(df):
    return {(r["store_key"], bytes(r["key"])): bytes(r["value"]) for r in df.collect()}


def test_goldens(spark):
    c = frame(spark, GOLD)
    b, k = "bank", "lockup"
    assert state(St.state_as_of(c, 1)) == {(b, b"\x01"): b"A", (b, b"\x02"): b"B", (k, b"\x01"): b"C"}
    assert state(St.state_as_of(c, 2)) == {(b, b"\x01"): b"D", (b, b"\x02"): b"E", (k, b"\x01"): b"C"}
    assert state(St.latest_state(c)) == {(b, b"\x02"): b"E", (k, b"\x01"): b"C", (k, b"\x80"): b"F"}
    ops = St.classify(c)
    assert rows(ops.groupBy("op").count()) == [("create", 5), ("delete", 2), ("noop", 1), ("update", 1)]
    assert rows(St.live_size(ops)) == [(1, 3), (2, 3), (3, 3)]
    assert rows(St.ops_per_version(c)) == [(1, 3), (2, 3), (3, 3)]
    assert rows(St.version_gaps(c.filter("version <> 2"))) == [(3, 2)]
    assert [bytes(r["key"]) for r in c.filter("store_key = 'lockup'").orderBy("key").collect()] == [b"\x01", b"\x80"]


def test_checks(spark):
    c = frame(spark, GOLD)
    stores = spark.createDataFrame([("bank",), ("lockup",)], "store_key string")
    St.check_changes(c, stores)
    with pytest.raises(ValueError, match="lockup"):
        St.check_changes(c, stores.filter("store_key = 'bank'"))
    with pytest.raises(ValueError, match="twice"):
        St.check_changes(c, stores.union(stores))
    with pytest.raises(ValueError, match="version 2 is missing"):
        St.check_changes(c.filter("version <> 2"), stores)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_fold(spark, seed):
    rng = random.Random(seed)
    data = [(v, s, rng.choice("ab"), bytes([rng.randrange(6)]), None if gone else bytes([rng.randrange(256)]), gone) for v in range(1, 6) for s in range(12) for gone in [rng.random() < 0.4]]
    live, sizes, classes = {}, {}, {"create": 0, "update": 0, "delete": 0, "noop": 0}
    for v, _, store, key, value, gone in data:
        there = (store, key) in live
        classes["noop" if gone and not there else "delete" if gone else "update" if there else "create"] += 1
        if gone:
            live.pop((store, key), None)
        else:
            live[store, key] = value
        sizes[v] = len(live)
    mixed = data[:]
    rng.shuffle(mixed)
    c = frame(spark, mixed)
    assert state(St.latest_state(c)) == live
    ops = St.classify(c)
    assert {r[0]: r[1] for r in St.live_size(ops).collect()} == sizes
    assert {k: n for k, n in classes.items() if n} == {r["op"]: r["count"] for r in ops.groupBy("op").count().collect()}
    late = St.merge_state(St.last_changes(c.filter("version > 2")), c.filter("version <= 2"))
    assert state(late.filter("not is_delete")) == live
