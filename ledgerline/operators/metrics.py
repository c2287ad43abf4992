"""Run metrics over any table with the right columns.

Every function takes column names, so parsed logs and other tables share one
code path.  Rates are ratios of sums, never means of ratios.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ceil_bucket, gigabytes, minutes_between, parse_iso, parse_size, rate
from ..schemas import LEGACY_FIELDS
from .ordered import last_known, numbered

MEMORY_CHOICES = ("alloc", "sys", "heap_inuse", "heap_idle", "heap_released")


def total_rate(commits: DataFrame, run: str, count: str, duration: str, out: str = "ops_per_sec") -> DataFrame:
    """Operations per second of each whole run; 0 for a run without time."""
    sums = commits.groupBy(run).agg(F.sum(count).alias("_c"), F.sum(duration).alias("_d"))
    return sums.select(run, F.coalesce(rate("_c", "_d"), F.lit(0.0)).alias(out))


def batch_rate(commits: DataFrame, version: str, count: str, duration: str, batch: int = 100, by: Sequence[str] = (), out: str = "ops_per_sec") -> DataFrame:
    """Rate per bucket of ``batch`` versions, by the columns ``by``; null for a bucket without time.  Not sorted."""
    sums = commits.groupBy(*by, ceil_bucket(version, batch).alias("version")).agg(F.sum(count).alias("_c"), F.sum(duration).alias("_d"))
    return sums.select(*by, "version", rate("_c", "_d").alias(out))


def row_rate(commits: DataFrame, count: str, duration: str, out: str = "ops_per_sec") -> DataFrame:
    """Each row with its own rate."""
    return commits.withColumn(out, rate(count, duration))


def peak_gb(samples: DataFrame, run: str, size: str, out: str) -> DataFrame:
    """Largest size of each run in gigabytes."""
    return samples.groupBy(run).agg(F.coalesce(gigabytes(F.max(size)), F.lit(0.0)).alias(out))


def commit_count(commits: DataFrame, run: str, out: str = "versions_applied") -> DataFrame:
    """Commit rows of each run, repeats included."""
    return commits.groupBy(run).agg(F.count(F.lit(1)).alias(out))


def span_minutes(lines: DataFrame, run: str, order: str, time: str, out: str) -> DataFrame:
    """Minutes from each run's first line to its last in ``order``."""
    return lines.groupBy(run).agg(minutes_between(F.min_by(time, order), F.max_by(time, order)).alias(out))


def kind_counts(lines: DataFrame, kind: str, order: str) -> DataFrame:
    """Lines of each kind, with the first and the last one's place."""
    return lines.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_line"), F.max(order).alias("last_line"))


def tagged(frames: dict[str, DataFrame], run: str = "run") -> DataFrame:
    """Tables with equal columns as one, each row tagged with its table's name; repeats stay."""
    named = [f.withColumn(run, F.lit(n)) for n, f in frames.items()]
    out = named[0]
    for f in named[1:]:
        out = out.unionByName(f)
    return out


def elapsed(headers: DataFrame, footers: DataFrame, commits: DataFrame) -> DataFrame:
    """run, elapsed_time_minutes: from the header to the footer, else to the last commit in file order; 0 if either end is missing."""
    last = commits.groupBy("run").agg(F.max_by("ts", "line").alias("last"))
    known = headers.select("run", "started").join(footers.select("run", "completed"), "run", "full").join(last, "run", "full")
    return known.select("run", F.coalesce(minutes_between("started", F.coalesce("completed", "last")), F.lit(0.0)).alias("elapsed_time_minutes"))


def missing_runs(frame: DataFrame, names: Sequence[str], run: str = "run") -> DataFrame:
    """Those of ``names`` that no row bears."""
    asked = frame.sparkSession.createDataFrame([(n,) for n in names], "name string")
    there = frame.filter(F.col(run).isin(list(names))).select(F.col(run).alias("name")).distinct()
    return asked.join(there, "name", "left_anti")


def require_runs(frame: DataFrame, names: Sequence[str], run: str = "run") -> None:
    """Raise KeyError for names that no row bears; the names asked for bound what is collected."""
    gone = {r["name"] for r in missing_runs(frame, names, run).collect()} if names else set()
    missing = [n for n in names if n in gone]
    if missing:
        raise KeyError(f"unknown runs: {', '.join(missing)}")


def folded(logs) -> DataFrame:
    """run, n, c, d (commits and their sums), elapsed_time_minutes, max_mem_gb and max_disk_gb: one aggregate over one scan of the lines."""
    cast = lambda c, kind: c.cast(kind) if logs.strict else c.try_cast(kind)
    kind = F.col("kind")
    commit, ts = kind == "commit", parse_iso("time", logs.strict)
    alloc = F.when(kind == "memory", parse_size("alloc")).when(kind == "legacy_memory", cast(F.col(f"mem_stats.{LEGACY_FIELDS['alloc']}"), "bigint"))
    size = F.when(kind == "disk", parse_size("size")).when(commit, parse_size("disk_usage"))
    at = lambda which: F.max_by(F.when(which, ts), F.when(which, F.col("line")))
    sums = logs.events.groupBy("run").agg(
        F.count(F.when(commit, 1)).alias("n"), F.sum(F.when(commit, cast(F.col("count"), "bigint"))).alias("c"), F.sum(F.when(commit, cast(F.col("duration"), "bigint"))).alias("d"),
        at(kind == "header").alias("started"), at(kind == "footer").alias("completed"), at(commit).alias("last"), F.max(alloc).alias("m"), F.max(size).alias("s"),
    )
    minutes = F.coalesce(minutes_between("started", F.coalesce("completed", "last")), F.lit(0.0))
    peak = lambda c: F.coalesce(gigabytes(c), F.lit(0.0))
    return sums.select("run", "n", "c", "d", minutes.alias("elapsed_time_minutes"), peak("m").alias("max_mem_gb"), peak("s").alias("max_disk_gb"))


def summary(logs, names: Sequence[str] | None = None) -> DataFrame:
    """One row per run with its commits, minutes, rate and peaks, in the order of ``names`` (else by name)."""
    runs = folded(logs)
    if names is not None:
        require_runs(logs.events, names)
        wanted = logs.events.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "run string, place int")
        runs = wanted.join(runs.filter(F.col("run").isin(list(names))), "run")
    out = runs.orderBy("place" if names is not None else "run")
    rates = F.coalesce(rate("c", "d"), F.lit(0.0))
    return out.select(F.col("run").alias("name"), F.col("n").cast("bigint").alias("versions_applied"), "elapsed_time_minutes", rates.alias("ops_per_sec"), "max_mem_gb", "max_disk_gb")


def pivot_mean(samples: DataFrame, version: str, run: str, value: str, names: Sequence[str]) -> DataFrame:
    """Mean value by version (rows) and run (columns); null where a run has none."""
    return samples.groupBy(version).pivot(run, list(names)).agg(F.avg(value)).orderBy(version)


def memory_series(memory: DataFrame, field: str, names: Sequence[str]) -> DataFrame:
    """Memory in gigabytes, one of ``MEMORY_CHOICES``, by version and run."""
    if field not in MEMORY_CHOICES:
        raise ValueError(f"unknown memory field {field!r}")
    return pivot_mean(memory.withColumn("_gb", gigabytes(field)), "version", "run", "_gb", names)


def truncate_to_shortest(frame: DataFrame, run: str, order: Sequence[str]) -> DataFrame:
    """The first rows of each run in ``order``, as many as the shortest run has."""
    sizes = frame.groupBy(run).agg(F.count(F.lit(1)).alias("_n"))
    least = sizes.agg(F.min("_n").alias("_least"))  # one row
    ranked = numbered(frame, [run], order, "_r")
    return ranked.join(F.broadcast(least), F.col("_r") <= F.col("_least")).drop("_r", "_least")


def rank_aligned(frame: DataFrame, run: str, order: Sequence[str], value: str, names: Sequence[str]) -> DataFrame:
    """Runs side by side by position: rank, and the value of each run's row of that rank."""
    ranked = numbered(frame, [run], order, "rank").withColumn("rank", F.col("rank").cast("int"))
    return ranked.groupBy("rank").pivot(run, list(names)).agg(F.first(value))


def kth(frame: DataFrame, run: str, order: Sequence[str], k: int, name: str = "seq") -> DataFrame:
    """Each run's row at place ``k``, from 1, in ``order``; its place is in column ``name``."""
    return numbered(frame, [run], order, name).filter(F.col(name) == k)


def ends(frame: DataFrame, run: str, order: str, value: str) -> DataFrame:
    """run, first_value and last_value in ``order``."""
    return frame.groupBy(run).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"))


def byte_ranked(frame: DataFrame, key: str, ties: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Rows with their place, from 1, in the order of the key's unsigned bytes, a prefix first."""
    return numbered(frame.withColumn("_bytes", F.col(key).cast("binary")), [], ["_bytes", *ties], name).drop("_bytes")


def version_aligned(frame: DataFrame, run: str, version: str, value: str, names: Sequence[str]) -> DataFrame:
    """Runs side by side by version."""
    return pivot_mean(frame, version, run, value, names)


def select_runs(frame: DataFrame, run: str, names: Sequence[str] | None) -> DataFrame:
    """Rows of the named runs, of all if None; an unknown name raises."""
    if names is None:
        return frame
    require_runs(frame, names, run)
    return frame.filter(F.col(run).isin(list(names)))


def version_range(frame: DataFrame, version: str, after: int, target: int = 0) -> DataFrame:
    """Rows of versions over ``after`` up to ``target``; no upper end if ``target`` isn't positive."""
    out = frame.filter(F.col(version) > after)
    return out.filter(F.col(version) <= target) if target > 0 else out


def inconsistent_dirs(headers: DataFrame, column: str = "changeset_dir") -> DataFrame:
    """One row with the number of distinct folders and whether runs disagree."""
    return headers.agg(F.countDistinct(column).alias("n_dirs"), (F.countDistinct(column) > 1).alias("inconsistent"))


def moving_rate(commits: DataFrame, run: str, ts: str, count: str, seconds: int = 3600) -> DataFrame:
    """Extension: operations per second over the window of ``seconds`` that ends at each commit.

    Time is cut into spans of that length; a span's window also sees the rows
    of the span before, so no task holds more than two spans of a run.
    """
    span = seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    own = commits.withColumns({"_at": at, "_span": F.floor(at / span)})
    both = own.withColumn("_in", F.explode(F.when(F.col("_at").isNull(), F.array(F.col("_span"))).otherwise(F.array(F.col("_span"), F.col("_span") + 1))))
    w = Window.partitionBy(run, "_in").orderBy("_at").rangeBetween(-span, 0)
    summed = both.withColumn("moving_rate", F.sum(count).over(w) / F.lit(float(seconds)))
    return summed.filter(F.col("_in").eqNullSafe(F.col("_span"))).drop("_at", "_span", "_in")


def sample_asof(samples: DataFrame, commits: DataFrame, run: str, ts: str, version: str) -> DataFrame:
    """Samples with the last version committed at or before their time: one sort of the union, no range join."""
    s = samples.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast("bigint"))
    c = commits.select(run, ts, F.col(version).cast("bigint").alias("_v")).withColumn("_side", F.lit(0))
    both = last_known(s.unionByName(c, allowMissingColumns=True), [run], [ts, "_side", "_v"], "_v", "asof_version")
    return both.filter("_side = 1").drop("_side", "_v")


def directory_size(spark, path: str) -> DataFrame:
    """Sum of the sizes of all files under a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files"))
