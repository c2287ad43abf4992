"""Benchmark-run logs: line-delimited JSON demultiplexed into typed tables.

A line's order in its file is (start of its split, a number that rises within
the split): no shuffle is needed to get it, and everything that depends on
file order sorts or picks by it.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import parse_iso, parse_size, run_name
from ..schemas import COUNT_FIELDS, LEGACY_FIELDS, LOG_LINE, MEMORY_FIELDS, SIZE_FIELDS

#: Messages of the log format, in the order in which a line is matched.
MESSAGES = {
    "starting run": "header",
    "benchmark run complete": "footer",
    "committed version": "commit",
    "mem stats": "memory",
    "disk usage": "disk",
    "full post-commit stats": "legacy_memory",
}


def message_kind(msg: Column) -> Column:
    """Kind of a line by its message; the first match wins, other messages give null."""
    kind = F.lit(None).cast("string")
    for text, name in reversed(MESSAGES.items()):
        kind = F.when(msg == text, name).otherwise(kind)
    return kind


def read_events(spark: SparkSession, path: str | list[str], *, strict: bool = True) -> DataFrame:
    """Every line as run, line (its order), kind and the fields of ``LOG_LINE``; all ``*.jsonl`` of a folder.

    ``strict`` raises on a blank or malformed line; else such lines are kept
    with their text in ``corrupt`` and no other field.  A folder without a log
    gives no row.  Of equal keys in a line the last one holds.
    """
    text = spark.read.option("pathGlobFilter", "*.jsonl").text(path)
    lines = text.select(
        run_name(F.col("_metadata.file_name")).alias("run"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("line"),
        F.col("value"),
    )
    schema = LOG_LINE.add("_corrupt", "string") if "_corrupt" not in LOG_LINE.names else LOG_LINE
    mode = "FAILFAST" if strict else "PERMISSIVE"
    value = F.when(F.trim("value") == "", F.lit("{")).otherwise(F.col("value")) if strict else F.col("value")
    parsed = lines.withColumn("e", F.from_json(value, schema, {"mode": mode, "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("e").isNull() | F.col("e._corrupt").isNotNull() | (F.trim("value") == "")
    out = parsed.select("run", "line", F.when(bad, F.col("value")).alias("corrupt"), *(F.when(~bad, F.col(f"e.{n}")).alias(n) for n in LOG_LINE.names if n != "_corrupt"))
    return out.withColumn("kind", message_kind(F.col("msg")))


@dataclass
class RunLogs:
    """Tables of a set of logs; each has the columns run and line."""

    events: DataFrame
    strict: bool = True
    duration_type: str = "bigint"

    def _to(self, c: Column, kind: str) -> Column:
        return c.cast(kind) if self.strict else c.try_cast(kind)

    def _of(self, kind: str) -> DataFrame:
        return self.events.filter(F.col("kind") == kind)

    @property
    def headers(self) -> DataFrame:
        """The last header of each run."""
        fields = ["time", "start_version", "target_version", "changeset_dir", "changeset_info", "db_dir", "db_options", "tree_type"]
        last = self._of("header").groupBy("run").agg(F.max_by(F.struct(*fields), "line").alias("h")).select("run", "h.*")
        return last.withColumns({"start_version": self._to(F.col("start_version"), "bigint"), "target_version": self._to(F.col("target_version"), "bigint"), "started": parse_iso("time", self.strict)})

    @property
    def footers(self) -> DataFrame:
        """The last footer of each run."""
        last = self._of("footer").groupBy("run").agg(F.max_by(F.struct("time", "versions_applied"), "line").alias("f")).select("run", "f.*")
        return last.select("run", parse_iso("time", self.strict).alias("completed"), self._to(F.col("versions_applied"), "bigint").alias("versions_applied"))

    @property
    def versions(self) -> DataFrame:
        """Commits: version, ts_raw, ts, duration (ns), count, ops_per_sec."""
        c = self._of("commit")
        return c.select(
            "run", "line", self._to(F.col("version"), "bigint").alias("version"), F.col("time").alias("ts_raw"), parse_iso("time", self.strict).alias("ts"), self._to(F.col("duration"), self.duration_type).alias("duration"),
            self._to(F.col("count"), "bigint").alias("count"), self._to(F.col("ops_per_sec"), "double").alias("ops_per_sec"),
        )

    @property
    def memory(self) -> DataFrame:
        """Memory samples of both formats, sizes in bytes."""
        base = ["run", "line", self._to(F.col("version"), "bigint").alias("version"), F.col("time").alias("ts_raw")]
        own = {n: parse_size(n) for n in SIZE_FIELDS} | {n: self._to(F.col(n), "bigint") for n in COUNT_FIELDS} | {"gc_cpu_fraction": self._to(F.col("gc_cpu_fraction"), "double")}
        now = self._of("memory").select(*base, *(own[n].alias(n) for n in MEMORY_FIELDS))
        old = self._of("legacy_memory").filter(F.col("mem_stats").isNotNull())
        old = old.select(*base, *(self._to(F.col(f"mem_stats.{LEGACY_FIELDS[n]}"), "double" if n == "gc_cpu_fraction" else "bigint").alias(n) for n in MEMORY_FIELDS))
        return now.unionByName(old)

    @property
    def disk(self) -> DataFrame:
        """Disk samples, those inside commits of the older format included."""
        base = ["run", "line", self._to(F.col("version"), "bigint").alias("version"), F.col("time").alias("ts_raw")]
        inline = self._of("commit").filter(F.col("disk_usage").isNotNull()).select(*base, parse_size("disk_usage").alias("size"))
        return inline.unionByName(self._of("disk").select(*base, parse_size("size").alias("size")))

    def snapshot_events(self, modules: list[str] | None = None) -> DataFrame:
        """Lines of no known message from ``modules`` (any module, if None): run, line, time, msg, version."""
        rest = self.events.filter(F.col("kind").isNull() & F.col("corrupt").isNull())
        rest = rest.filter(F.col("module").isin(modules)) if modules is not None else rest.filter(F.col("module").isNotNull())
        return rest.select("run", "line", parse_iso("time", self.strict).alias("time"), "msg", self._to(F.col("version"), "bigint").alias("version"))

    @property
    def store_params(self) -> DataFrame:
        """One row per run and store of the headers' manifests."""
        return self.headers.select("run", F.inline("changeset_info.store_params"))

    @property
    def status(self) -> DataFrame:
        """Per run: complete (a footer and no panic), and the number of unreadable lines."""
        marks = self.events.groupBy("run").agg(
            F.max(F.coalesce(F.col("kind") == "footer", F.lit(False))).alias("ended"), F.max(F.coalesce(F.col("msg") == "panic occurred", F.lit(False))).alias("panicked"), F.count("corrupt").alias("corrupt_lines")
        )
        return marks.select("run", (F.col("ended") & ~F.col("panicked")).alias("complete"), "corrupt_lines")

    @property
    def cpu(self) -> DataFrame:
        """Extension: CPU load per core over time."""
        return self.events.filter(F.col("cpu_percents").isNotNull()).select("run", "line", self._to(F.col("version"), "bigint").alias("version"), F.posexplode("cpu_percents").alias("core", "percent"))


def read_logs(spark: SparkSession, path: str | list[str], *, strict: bool = True) -> RunLogs:
    """Logs of a file, a list of files or a folder."""
    return RunLogs(read_events(spark, path, strict=strict), strict)


def results_dir() -> str:
    """Folder of logs named by the environment variable BENCHMARK_RESULTS; raises if it is unset."""
    found = os.environ.get("BENCHMARK_RESULTS")
    if not found:
        raise KeyError("BENCHMARK_RESULTS isn't set")
    return found
