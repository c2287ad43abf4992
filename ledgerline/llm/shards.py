"""Sharding by minimax contiguous partition.

Rows with equal texts form atomic groups, ordered by the hash of their text.
Group sizes are summed by cells of the hash range (``2**cell_bits`` at first),
whose number doesn't grow with the data, so the sums fit the driver.  The
smallest capacity for which a greedy sweep needs at most ``shards`` shards is
found by binary search, and a second sweep that may cut cells of several groups
anywhere gives a capacity that no cut can beat.  While the two differ, the
cells that a cut may fall in are split in 256 and summed again, so the capacity
is the least over all groups, whatever their number.  Within it each cut takes
an even share of what is left, so the last shard isn't the only one to run
short.

Defined results: a null text has size 1 and is grouped with other nulls; an
empty table gives no rows; a group larger than total/shards fills a shard of
its own; repeated rows keep their own slots; unused shards stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialize


def feasible(sums: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Ends of the shards of a greedy sweep over ordered atoms, or None if more than ``shards`` are needed."""
    reach = np.concatenate([[0], np.cumsum(sums)])
    at, ends = 0, []
    while at < len(sums):
        if len(ends) == shards:
            return None
        end = int(np.searchsorted(reach, reach[at] + capacity, "right")) - 1
        if end == at:
            return None
        ends.append(end)
        at = end
    return ends


def minimax(sums: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """(smallest feasible capacity, shard ends) for positive atom sizes in order."""
    if not len(sums):
        return 0, []
    low, high = int(max(sums.max(), -(-int(sums.sum()) // shards))), int(sums.sum())
    while low < high:
        middle = (low + high) // 2
        if feasible(sums, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low, even_ends(sums, low, shards)


def even_ends(sums: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Shard ends within ``capacity``, each cut as near to an even share of what is left as the rest allows."""
    reach = np.concatenate([[0], np.cumsum(sums)])
    at, ends = 0, []
    for left in range(shards, 0, -1):
        if at == len(sums):
            break
        furthest = int(np.searchsorted(reach, reach[at] + capacity, "right")) - 1
        share = reach[at] + (reach[-1] - reach[at]) / left
        near = int(np.searchsorted(reach, share))
        near -= near > at + 1 and share - reach[near - 1] < reach[min(near, len(sums))] - share
        end = min(max(near, at + 1), furthest)
        if left == 1 or feasible(sums[end:], capacity, left - 1) is None:
            end = furthest
        ends.append(end)
        at = end
    return ends


def furthest(reach: np.ndarray, single: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Ends, in bytes, of a sweep that may cut every atom but the ``single`` ones anywhere; None if more than ``shards`` are needed."""
    x, ends = 0, []
    while x < reach[-1]:
        y = min(x + capacity, int(reach[-1]))
        if y < reach[-1]:
            i = int(np.searchsorted(reach, y, "right")) - 1
            y = int(reach[i]) if single[i] else y
        if y <= x or len(ends) == shards:
            return None
        ends.append(y)
        x = y
    return ends


def unclear(sums: np.ndarray, single: np.ndarray, shards: int, heavy: int = 1024) -> np.ndarray:
    """Atoms of several groups that must be split before the least capacity is known; none if it is.

    Atoms of over a ``heavy``-th of the whole come first; without them few
    atoms lie where a cut may fall.
    """
    total = int(sums.sum())
    big = np.flatnonzero(~single & (sums > total / heavy))
    if len(big) or not len(sums):
        return big
    reach = np.concatenate([[0], np.cumsum(sums)])
    high, _ = minimax(sums, shards)
    low, top = -(-total // shards), high
    while low < top:
        middle = (low + top) // 2
        if furthest(reach, single, middle, shards) is None:
            low = middle + 1
        else:
            top = middle
    maybe = np.zeros(len(sums), bool)
    if low < high:
        last, least = furthest(reach, single, high, shards), 0
        for k in range(shards - 1):
            least = max(least, int(reach[np.searchsorted(reach, least + low, "right") - 1]))
            most = last[k] if k < len(last) else total
            maybe |= (reach[:-1] < most) & (reach[1:] > least)
    return np.flatnonzero(maybe & ~single)


def cell_sums(rows: DataFrame, bits: int, within: list[int] | None = None, above: int = 0) -> pd.DataFrame:
    """Size, least and greatest hash of the cells of ``rows`` (h, size) by their leading ``bits``, of all or those ``within`` cells of ``above`` bits."""
    if within is not None:
        chosen = rows.sparkSession.createDataFrame([(int(c),) for c in within], "_in long")
        # As many rows as cells to split.
        rows = rows.join(F.broadcast(chosen), F.shiftright("h", 64 - above) == F.col("_in"), "left_semi")
    cell = F.shiftright("h", 64 - bits).alias("cell")
    return rows.groupBy(cell).agg(F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high")).toPandas().assign(bits=bits)


def cuts(rows: DataFrame, shards: int, cell_bits: int = 18) -> tuple[int, list[int]]:
    """(least capacity over all groups, last hash of each shard but the last) of ``rows`` (h, size)."""
    atoms = cell_sums(rows, cell_bits).sort_values("low", ignore_index=True)
    while len(split := unclear(atoms["size"].to_numpy(np.int64), (atoms["low"] == atoms["high"]).to_numpy(bool), shards)):
        parts = [atoms.drop(index=split)]
        for bits, own in atoms.loc[split].groupby("bits"):
            parts.append(cell_sums(rows, min(64, int(bits) + 8), own["cell"].tolist(), int(bits)))
        atoms = pd.concat(parts).sort_values("low", ignore_index=True)
    capacity, ends = minimax(atoms["size"].to_numpy(np.int64), shards)
    return capacity, [int(atoms["high"].iloc[e - 1]) for e in ends[:-1]]


def shard(docs: DataFrame, text: str = "text", shards: int = 16, *, cell_bits: int = 18, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with columns shard and slot, gapless from 0 within a shard, in place of any of those names."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 1
    # Texts are read once where they needn't be carried; sums by cells are taken from this table.
    sized = materialize(docs.select(*(carry or []), h.alias("_h"), size.alias("_size")), "sizes")
    _, bounds = cuts(sized.select(F.col("_h").alias("h"), F.col("_size").alias("size")), shards, cell_bits)
    source, own = (sized, F.col("_h")) if carry else (docs, h)
    number = sum((F.when(own > b, 1).otherwise(0) for b in bounds), F.lit(0)).cast("int")
    return number_slots(source.select(*(carry or docs.columns), number.alias("shard")), spark)


def number_slots(placed: DataFrame, spark) -> DataFrame:
    """Add slot: rows are counted once per written part, and each part is then shifted by those before it."""
    schema = T.StructType([*placed.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])
    numbered = placed.withColumn("_part", F.spark_partition_id())
    shard_at, part_at = numbered.columns.index("shard"), numbered.columns.index("_part")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: dict[int, int] = {}
        for batch in batches:
            numbers = batch.column(shard_at).to_numpy(zero_copy_only=False)
            at = np.empty(len(numbers), np.int64)
            for s in np.unique(numbers):
                mine = np.flatnonzero(numbers == s)
                first = used.get(int(s), 0)
                at[mine] = first + np.arange(len(mine))
                used[int(s)] = first + len(mine)
            yield pa.RecordBatch.from_arrays([*batch.columns[:part_at], batch.column(part_at), pa.array(at)], names=[f.name for f in schema])

    kept = materialize(numbered.mapInArrow(count, schema), "slots")
    from pyspark.sql import Window

    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = kept.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    shift = totals.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    # One row per part and shard; Spark broadcasts it only under its own checked limit.
    return kept.join(shift, ["shard", "_part"]).withColumn("slot", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
