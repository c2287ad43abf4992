"""Order-dependent columns without a task per group: rows are numbered, summed and carried by ranges of their order.

A group's rows are cut into ranges by quantiles of the first order column, the
work of a window is done range by range, and what a range hands to the next
one comes from a table of one row per group and range.  So a run that holds
most rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = "_range"


def rank_number(frame: DataFrame, name: str) -> Column | None:
    """A number that rises with a column's order (of bytes and texts their first seven bytes); None for other types."""
    c, kind = F.col(name), frame.select(name).schema[0].dataType
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("double")
    return None


def ranged(frame: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """``frame`` with its range by ``order``; nulls are in the first one."""
    number = rank_number(frame, order)
    if number is None:
        return frame.withColumn(RANGE, F.lit(0))
    n = ranges or int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = frame.agg(F.percentile_approx(number, [k / n for k in range(1, n)], 1000)).head()[0] if n > 1 else None
    if not cuts:
        return frame.withColumn(RANGE, F.lit(0))
    cuts = sorted({float(x) for x in cuts})

    def place(low: int, high: int) -> Column:
        """The number of cuts under the value, known to lie between ``low`` and ``high``."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(number <= cuts[middle], place(low, middle)).otherwise(place(middle + 1, high))

    return frame.withColumn(RANGE, F.when(number.isNull(), 0).otherwise(place(0, len(cuts))))


def handed_on(cut: DataFrame, by: Sequence[str], total: Column, over) -> DataFrame:
    """``cut`` with column _before: ``over(column of totals)`` of the ranges before a row's own, by group."""
    names = [f"_by{k}" for k in range(len(by))]
    totals = cut.groupBy(RANGE, *by).agg(total.alias("_total")).toDF("_at", *names, "_total")
    w = Window.partitionBy(*names).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_at", *names, over(F.col("_total")).over(w).alias("_before"))
    same = F.col(RANGE) == F.col("_at")
    for a, b in zip(by, names, strict=True):
        same = same & F.col(a).eqNullSafe(F.col(b))
    return cut.join(before, same, "left").drop("_at", *names)


def numbered(frame: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``frame`` with each row's place in its group, from 1, in column ``name``."""
    cut = handed_on(ranged(frame, order[0]), by, F.count(F.lit(1)), F.sum)
    local = F.row_number().over(Window.partitionBy(RANGE, *by).orderBy(*order))
    return cut.withColumn(name, local + F.coalesce("_before", F.lit(0))).drop(RANGE, "_before")


def running_sum(frame: DataFrame, by: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """``frame`` with the sum of ``value`` up to each row in column ``name``."""
    cut = handed_on(ranged(frame, order), by, F.sum(value), F.sum)
    local = F.sum(value).over(Window.partitionBy(RANGE, *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn(name, local + F.coalesce("_before", F.lit(0))).drop(RANGE, "_before")


def previous(frame: DataFrame, by: Sequence[str], order: str, name: str) -> DataFrame:
    """``frame`` with the value of ``order`` before each row's own in column ``name``; null for the first."""
    cut = handed_on(ranged(frame, order), by, F.max(order), F.max)
    local = F.lag(order).over(Window.partitionBy(RANGE, *by).orderBy(order))
    return cut.withColumn(name, F.coalesce(local, F.col("_before"))).drop(RANGE, "_before")


def last_known(frame: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``frame`` with the last value of ``value`` that isn't null up to each row in column ``name``."""
    latest = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
    cut = handed_on(ranged(frame, order[0]), by, latest, lambda c: F.last(c, ignorenulls=True))
    local = F.last(value, ignorenulls=True).over(Window.partitionBy(RANGE, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn(name, F.coalesce(local, F.col("_before"))).drop(RANGE, "_before")
