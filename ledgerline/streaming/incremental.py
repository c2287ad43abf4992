"""Incremental forms: state kept up to date by micro-batches, and rates of growing logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.expr import ceil_bucket, rate, run_name
from ..operators.state import KEYS, ORDER, last_changes, merge_state
from ..schemas import CHANGES, LOG_LINE


class StreamedState:
    """Last change of every key, deletes included, under ``path``; batches may come in any order of version.

    Each batch is merged into a new folder and then the marker moves, so a
    batch that is run again after a failure changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> int:
        """Number of the last merged batch; -1 before the first."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs, root = self._fs(), hadoop(self.path)
        if not fs.exists(root):
            return -1
        done = [s.getPath().getName() for s in fs.listStatus(root)]
        return max((int(n[6:]) for n in done if n.startswith("batch=") and fs.exists(hadoop(f"{self.path}/{n}/_SUCCESS"))), default=-1)

    def last(self) -> DataFrame | None:
        """Last changes as of the last merged batch."""
        at = self.current()
        return self.spark.read.parquet(f"{self.path}/batch={at}").select(*KEYS, "value", "is_delete", *ORDER) if at >= 0 else None

    def live(self) -> DataFrame:
        """Live keys."""
        return self.last().filter(~F.col("is_delete")).select(*KEYS, "value", *ORDER)

    def merge(self, batch: DataFrame, number: int) -> None:
        """foreachBatch body."""
        if number <= self.current():
            return
        now = self.last()
        merged = last_changes(batch) if now is None else merge_state(now, batch)
        merged.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def start(self, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Begin to merge a stream of changes."""
        return changes.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_changes(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of the changes in a Parquet folder."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_batch_rate(spark: SparkSession, path: str, batch: int = 100) -> DataFrame:
    """Running rate per run and bucket of versions of a folder of growing logs; for complete or update mode."""
    lines = spark.readStream.option("pathGlobFilter", "*.jsonl").format("text").load(path)
    e = F.from_json("value", LOG_LINE)
    commits = lines.select(run_name(F.col("_metadata.file_name")).alias("run"), e.alias("e")).filter(F.col("e.msg") == "committed version")
    typed = commits.select("run", F.col("e.version").try_cast("bigint").alias("v"), F.col("e.count").try_cast("bigint").alias("c"), F.col("e.duration").try_cast("bigint").alias("d"))
    sums = typed.groupBy("run", ceil_bucket("v", batch).alias("version")).agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    return sums.select("run", "version", rate("c", "d").alias("ops_per_sec"))


def stream_event_rate(events: DataFrame, ts: str, key: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Extension: counts per event-time window and key, with late rows dropped after ``late``."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("n"))
