"""State of versioned key-value stores derived from their changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import previous, running_sum

KEYS = ("store_key", "key")
ORDER = ("version", "seq")


def last_changes(changes: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, value: str = "value", is_delete: str = "is_delete") -> DataFrame:
    """The last change of each key, deletes included: what a merge with later changes needs."""
    last = F.max_by(F.struct(F.col(value).alias("v"), F.col(is_delete).alias("d"), *(F.col(o) for o in order)), F.struct(*order))
    found = changes.groupBy(*keys).agg(last.alias("_l"))
    return found.select(*keys, F.col("_l.v").alias(value), F.col("_l.d").alias(is_delete), *(F.col(f"_l.{o}").alias(o) for o in order))


def latest_state(changes: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, value: str = "value", is_delete: str = "is_delete") -> DataFrame:
    """Live keys with their values."""
    return last_changes(changes, keys, order, value, is_delete).filter(~F.col(is_delete)).select(*keys, value, *order)


def state_as_of(changes: DataFrame, version: int, **columns) -> DataFrame:
    """Live keys as they were after ``version``; partitions of later versions aren't read."""
    order = columns.get("order", ORDER)
    return latest_state(changes.filter(F.col(order[0]) <= version), **columns)


def merge_state(state: DataFrame, changes: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, value: str = "value", is_delete: str = "is_delete") -> DataFrame:
    """``last_changes`` of a kept state and more changes, in any order of arrival."""
    columns = [*keys, value, is_delete, *order]
    return last_changes(state.select(columns).unionByName(changes.select(columns)), keys, order, value, is_delete)


def classify(changes: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, is_delete: str = "is_delete") -> DataFrame:
    """Changes with op: create, update, delete, or noop for the delete of a key that isn't live."""
    dead = F.coalesce(F.lag(is_delete).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(True))
    op = F.when(~F.col(is_delete) & dead, "create").when(~F.col(is_delete), "update").when(~dead, "delete").otherwise("noop")
    return changes.withColumn("op", op)


def live_size(classified: DataFrame, by: Sequence[str] = (), version: str = "version") -> DataFrame:
    """Number of live keys after each version: sums per version first, then one running sum over the versions."""
    step = F.when(F.col("op") == "create", 1).when(F.col("op") == "delete", -1).otherwise(0)
    steps = classified.groupBy(*by, version).agg(F.sum(step).alias("_s"))
    return running_sum(steps, by, version, "_s", "_live").select(*by, version, F.col("_live").cast("bigint").alias("live_size"))


def ops_per_version(changes: DataFrame, version: str = "version") -> DataFrame:
    """Changes of each version."""
    return changes.groupBy(version).agg(F.count(F.lit(1)).alias("ops"))


def progress_marks(changes: DataFrame, every: int = 10_000, version: str = "version") -> DataFrame:
    """version and count, for every ``every``-th change of a version: the marks that a long version leaves in a log."""
    ops = ops_per_version(changes, version).filter(F.col("ops") >= every)
    return ops.select(version, F.explode(F.sequence(F.lit(every).cast("bigint"), F.col("ops"), F.lit(every).cast("bigint"))).alias("count"))


def version_gaps(changes: DataFrame, version: str = "version", by: Sequence[str] = ()) -> DataFrame:
    """Versions that don't follow the one before: version and the one expected."""
    seen = previous(changes.select(*by, version).distinct(), by, version, "_b")
    return seen.filter(F.col("_b").isNotNull() & (F.col(version) != F.col("_b") + 1)).select(*by, version, (F.col("_b") + 1).alias("expected"))


def unknown_stores(changes: DataFrame, stores: DataFrame) -> DataFrame:
    """Store keys that the manifest lacks."""
    return changes.select("store_key").distinct().join(stores.select("store_key"), "store_key", "left_anti")


def check_changes(changes: DataFrame, stores: DataFrame) -> None:
    """Raise ValueError on an unknown store, a store named twice or a missing version."""
    bad = unknown_stores(changes, stores).limit(5).collect()
    if bad:
        raise ValueError(f"unknown stores: {', '.join(r[0] for r in bad)}")
    twice = duplicate_names(stores, "store_key").limit(5).collect()
    if twice:
        raise ValueError(f"stores named twice: {', '.join(r[0] for r in twice)}")
    gap = version_gaps(changes).limit(1).collect()
    if gap:
        raise ValueError(f"version {gap[0]['expected']} is missing before {gap[0]['version']}")


def duplicate_names(frame: DataFrame, name: str) -> DataFrame:
    """Names that occur more than once, with their number."""
    return frame.groupBy(name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
