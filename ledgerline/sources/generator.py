"""Synthetic workloads: exact plans, and changes made store by store.

The plan of a store is a sequential recurrence over its versions and is
computed on the driver (one number per version).  Updates and deletes choose
among the keys live at that moment, so a store's changes are made in order in
one task; stores run side by side.  Bytes are random, seeded by store.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CHANGES


@dataclass(frozen=True)
class StoreParams:
    """Shape of one store's workload."""

    store_key: str
    key_mean: int
    key_std_dev: int
    value_mean: int
    value_std_dev: int
    initial_size: int
    final_size: int
    versions: int
    change_per_version: int
    delete_fraction: float


# The presets.
BANK = StoreParams("bank", 56, 3, 100, 1200, 35_000, 2_200_200, 0, 1840, 0.25)
LOCKUP = StoreParams("lockup", 56, 3, 1936, 29_261, 35_000, 2_600_200, 0, 363, 0.29)
STAKING = StoreParams("staking", 24, 2, 12_263, 22_967, 35_000, 1_600_696, 0, 305, 0.25)
LIVE_CHAIN_SIZE, LIVE_CHAIN_VERSIONS = 20_000_000, 1_000_000


def profile(name: str, versions: int, scale: float = 1.0) -> list[StoreParams]:
    """Stores of a profile: ``mixed`` (three stores) or ``osmo`` (two large bank stores); the names are fixed values."""
    if name == "mixed":
        return [replace(p, versions=versions, final_size=int(p.final_size * scale)) for p in (BANK, STAKING, LOCKUP)]
    if name == "osmo":
        first = int(LIVE_CHAIN_SIZE * scale)
        return [replace(BANK, store_key=k, initial_size=first, final_size=int(1.5 * first), versions=LIVE_CHAIN_VERSIONS) for k in ("bank", "bank2")]
    raise ValueError(f"unknown profile {name!r}")


def schedule(p: StoreParams) -> Iterator[tuple[int, int, int, int]]:
    """(version, creates, updates, deletes) of every version.

    Growth per version is fractional; its whole part is taken out of an
    accumulator, truncated toward zero.  Counts that aren't positive mean none.
    """
    yield 1, p.initial_size, 0, 0
    if p.versions < 2:
        return
    growth = (p.final_size - p.initial_size) / (p.versions - 1)
    deletes = int(p.delete_fraction * p.change_per_version)
    waiting = 0.0
    for v in range(2, p.versions + 1):
        waiting += growth
        whole = int(waiting)
        waiting -= whole
        yield v, whole + deletes, p.change_per_version - deletes, deletes


def plan_frame(spark: SparkSession, stores: list[StoreParams]) -> DataFrame:
    """The schedules of all stores: store_key, version, creates, updates, deletes."""
    rows = [(p.store_key, *x) for p in stores for x in schedule(p)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["store_key", "version", "creates", "updates", "deletes"]), "store_key string, version bigint, creates bigint, updates bigint, deletes bigint")


def random_bytes(rng: np.random.Generator, mean: int, spread: int) -> bytes:
    """Bytes of a normally distributed length; one under 1 is drawn again with a third of the mean as spread, and is 1 at least."""
    n = int(rng.normal(mean, spread))
    if n < 1:
        n = max(1, int(rng.normal(mean, mean // 3)))
    return rng.bytes(n)


def store_changes(p: StoreParams, plan: pd.DataFrame, seed: int, *, no_keys_is_error: bool = True) -> Iterator[tuple]:
    """(version, position in the store's version, key, value, is_delete) of one store.

    Kinds are drawn evenly among those that are left, not by their numbers.
    A delete without a live key makes one instead; an update without one
    raises, or makes one if ``no_keys_is_error`` is off.
    """
    rng = np.random.default_rng([seed, *p.store_key.encode()])
    live: list[bytes] = []
    there: dict[bytes, int] = {}

    def fresh() -> bytes:
        while (k := random_bytes(rng, p.key_mean, p.key_std_dev)) in there:
            pass
        there[k] = len(live)
        live.append(k)
        return k

    for r in plan.sort_values("version").itertuples():
        left = {k: int(n) for k, n in (("create", r.creates), ("update", r.updates), ("delete", r.deletes)) if n > 0}
        at = 0
        while left:
            kinds = sorted(left)
            kind = kinds[int(rng.integers(len(kinds)))]
            left[kind] -= 1
            if not left[kind]:
                del left[kind]
            if kind != "create" and not live:
                if kind == "update" and no_keys_is_error:
                    raise ValueError(f"store {p.store_key} has no key to update")
                kind = "create"
            if kind == "create":
                change = (fresh(), random_bytes(rng, p.value_mean, p.value_std_dev), False)
            elif kind == "update":
                change = (live[int(rng.integers(len(live)))], random_bytes(rng, p.value_mean, p.value_std_dev), False)
            else:
                k = live[int(rng.integers(len(live)))]
                gap, last = there.pop(k), live.pop()
                if last != k:
                    live[gap], there[last] = last, gap
                change = (k, None, True)
            yield (r.version, at, *change)
            at += 1


def generate(spark: SparkSession, stores: list[StoreParams], seed: int = 0) -> DataFrame:
    """``changes`` of a workload; within a version the stores take turns, drawn evenly among those with changes left."""
    by_name = {p.store_key: p for p in stores}
    plan = plan_frame(spark, stores)

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if not parts:
            return
        whole = pd.concat(parts)
        for store, own in whole.groupby("store_key"):
            rows = []
            for row in store_changes(by_name[store], own, seed):
                rows.append((row[0], row[1], store, *row[2:]))
                if len(rows) == 5000:
                    yield pd.DataFrame(rows, columns=["version", "at", "store_key", "key", "value", "is_delete"])
                    rows = []
            yield pd.DataFrame(rows, columns=["version", "at", "store_key", "key", "value", "is_delete"])

    def turns(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0])])
        left = {s: int(n) for s, n in sorted(zip(frame.store_key, frame.n, strict=True)) if n > 0}
        order, taken = [], dict.fromkeys(left, 0)
        while left:
            names = sorted(left)
            s = names[int(rng.integers(len(names)))]
            order.append((int(key[0]), s, taken[s], len(order)))
            taken[s] += 1
            left[s] -= 1
            if not left[s]:
                del left[s]
        return pd.DataFrame(order, columns=["version", "store_key", "at", "seq"])

    made = plan.repartition(max(1, len(stores)), "store_key").mapInPandas(make, "version bigint, at bigint, store_key string, key binary, value binary, is_delete boolean")
    positive = lambda c: F.greatest(F.col(c), F.lit(0))
    counts = plan.select("version", "store_key", (positive("creates") + positive("updates") + positive("deletes")).alias("n"))
    placed = counts.groupBy("version").applyInPandas(turns, "version bigint, store_key string, at bigint, seq bigint")
    return made.join(placed, ["version", "store_key", "at"]).select(CHANGES.names)


def params_rows(stores: list[StoreParams]) -> list[dict]:
    """Stores in the manifest's form."""
    return [asdict(p) for p in stores]
