"""Phases of background snapshots, correlated by adjacency in file order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Messages that open a snapshot record and that mark its phases.
START = "start rewriting snapshot"
REWRITTEN = "finished rewriting snapshot"
CAUGHT_UP = "finished best-effort WAL catchup"
SWITCHED = "switched to new snapshot"


def phases(
    events: DataFrame, run: str = "run", order: Sequence[str] = ("line",), time: str = "time", msg: str = "msg", version: str = "version", *,
    start: str = START, rewritten: str = REWRITTEN, caught_up: str = CAUGHT_UP, switched: str = SWITCHED, strict: bool = False,
) -> DataFrame:
    """One row per opened snapshot with its times, its phases in microseconds, and switch_version.

    A later event belongs to the last one opened before it in ``order``; a
    repeated event replaces the one before.  ``strict`` raises on an event
    before any start, which else is left out, and on one whose phase before
    hasn't ended, which else has no duration.
    """
    known = events.filter(F.col(msg).isin(start, rewritten, caught_up, switched))
    opened = F.sum((F.col(msg) == start).cast("int")).over(Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    numbered = known.withColumn("_s", opened)
    if strict:
        numbered = numbered.withColumn("_s", F.when(F.col("_s") == 0, F.raise_error("a snapshot event before any start")).otherwise(F.col("_s")))
        early = F.lit(False)
        for text, needed in ((caught_up, rewritten), (switched, caught_up)):
            so_far = F.max(F.col(msg) == needed).over(Window.partitionBy(run, "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
            early = early | ((F.col(msg) == text) & ~so_far)
        numbered = numbered.withColumn("_early", early).withColumn("_s", F.when(F.col("_early"), F.raise_error("a snapshot event before the one that it follows")).otherwise(F.col("_s"))).drop("_early")
    key = F.struct(*order)
    last = lambda value, text: F.max_by(F.col(value), F.when(F.col(msg) == text, key))
    found = numbered.filter("_s > 0").groupBy(run, "_s").agg(
        last(version, start).alias("version"), last(time, start).alias("start_time"), last(time, rewritten).alias("end_time"), last(time, caught_up).alias("best_effort_wal_time"),
        last(time, switched).alias("switch_time"), last(version, switched).alias("switch_version"),
    )
    micros = lambda a, b: F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))
    return found.select(
        run, "version", "start_time", "end_time", micros("start_time", "end_time").alias("snapshot_us"), "best_effort_wal_time", micros("end_time", "best_effort_wal_time").alias("best_effort_wal_us"),
        "switch_time", micros("best_effort_wal_time", "switch_time").alias("wal_sync_us"), "switch_version",
    )
