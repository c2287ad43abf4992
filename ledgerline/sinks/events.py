"""Writing of log events as line-delimited JSON or as text, and the frames that figures are drawn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files


def text_line(events: DataFrame):
    """A row as ``key=value`` pairs, absent fields left out; values with blanks, quotes or = are quoted."""
    parts = []
    for n in events.columns:
        c = F.col(n).cast("string")
        shown = F.when(c.rlike(r'[\s"=]') | (c == ""), F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(c)
        parts.append(F.when(c.isNotNull(), F.concat(F.lit(f"{n}="), shown)))
    return F.concat_ws(" ", *parts)


def write_events(events: DataFrame, path: str, order: str | None = None, level: str = "INFO", form: str = "json") -> None:
    """Rows as lines of JSON or of text (``form``), absent fields left out; ``order`` sorts them into one file; rows under ``level`` are dropped."""
    if form not in ("json", "text"):
        raise ValueError(f"unknown form {form!r}")
    rank = {"DEBUG": 0, "INFO": 1, "WARN": 2, "ERROR": 3}
    if "level" in events.columns:
        own = F.lit(1)
        for name, n in rank.items():
            own = F.when(F.upper("level") == name, n).otherwise(own)
        events = events.filter(own >= rank[level])
    out = events.coalesce(1).sortWithinPartitions(order) if order else events
    if form == "text":
        out.select(text_line(out).alias("value")).write.mode("errorifexists").text(path)
    else:
        out.write.mode("errorifexists").option("ignoreNullFields", "true").json(path)


def write_run_logs(lines: DataFrame, folder: str, order: str) -> None:
    """``lines`` (run, ``order``, value) as one log ``<run>.jsonl`` per run in a new folder; a run's lines are sorted in one task, as one file holds them."""
    spark = lines.sparkSession
    if files.exists(folder, spark):
        raise FileExistsError(folder)
    lines.repartition("run").sortWithinPartitions("run", order).select("run", "value").write.partitionBy("run").text(f"{folder}/parts")
    for name in files.names(f"{folder}/parts", spark):
        if name.startswith("run="):
            part = next(n for n in files.names(f"{folder}/parts/{name}", spark) if n.startswith("part-"))
            files.move(f"{folder}/parts/{name}/{part}", f"{folder}/{name[4:]}.jsonl", spark)
    files.delete(f"{folder}/parts", spark)


def tidy(frame: DataFrame, run: str, version: str, metrics: list[str]) -> DataFrame:
    """(run, version, metric, value) rows: what a line figure draws."""
    return frame.select(F.col(run).alias("run"), F.col(version).cast("double").alias("version"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m")).select("run", "version", "m.metric", "m.value")


def dashboard(logs, names: list[str], batch: int = 100, memory_field: str = "alloc") -> dict[str, DataFrame]:
    """One frame per panel: the summary, rates (by version and by rank), memory, disk, and run facts."""
    from ..operators import metrics as M

    rates = M.batch_rate(M.select_runs(logs.versions, "run", names), "version", "count", "duration", batch, by=["run"])
    return {
        "summary": M.summary(logs, names),
        "rates": tidy(rates, "run", "version", ["ops_per_sec"]),
        "rates_by_version": M.version_aligned(rates, "run", "version", "ops_per_sec", names),
        "rates_by_rank": M.rank_aligned(rates, "run", ["version"], "ops_per_sec", names),
        "memory": M.memory_series(logs.memory, memory_field, names),
        "disk": M.pivot_mean(logs.disk.withColumn("_gb", F.col("size") / 1e9), "version", "run", "_gb", names),
        "headers": logs.headers,
        "stores": logs.store_params,
        "consistency": M.inconsistent_dirs(logs.headers),
    }
