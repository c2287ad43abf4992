"""Shared storage for intermediate tables.

A table written here cuts lineage: an executor lost later re-reads files and
doesn't recompute the work behind them.  The folder is the cluster's
``spark.checkpoint.dir``; a folder of our own is used only where that setting
is empty and the session is local, as in tests.
"""

from __future__ import annotations

import atexit
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import shared_dir

_WRITTEN: list[tuple[SparkSession, str]] = []
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return it read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerline-{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _WRITTEN.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
    _PATHS[back] = path
    return back


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(table: DataFrame, part: str = "") -> None:
    """Delete a table that ``materialize`` returned, or a part of it (a folder below), when nothing will read it again."""
    remove(table.sparkSession, f"{_PATHS[table]}/{part}".rstrip("/"))


def clear() -> None:
    """Delete every table written by this process; results still unread are lost."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended; the files are scratch
            continue


atexit.register(clear)
