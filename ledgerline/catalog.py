"""Registered queries of the engine over the standard tables, and the SQL they are held against.

The tables stand in for logs and changes: ``lineitem`` for commits (version
l_orderkey, count l_quantity, duration l_extendedprice) and ``events`` for log
lines and changes (order event_id, message and run event_type, key user_id).
Doubles that are summed are rounded on both sides, as their sums depend on the
order of addition.

Queries of logs and changesets first write ``events`` as such files to the
shared folder, once per session and data folder, and then read those by the
engine's own sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expr as E
from .operators import metrics as M
from .operators import snapshots as S
from .operators import state as St
from .plans.run_plan import TableBackend, TableOptions, replay
from .sinks import events as K
from .sources import changesets, files
from .sources.generator import BANK, StoreParams, generate, params_rows, schedule
from .sources.logs import RunLogs, message_kind, read_logs

TYPES = ["click", "error", "purchase", "signup", "view"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A standard table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an aware timestamp in column at."""
    return table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes: version = event_id div 100, seq = event_id, key = user_id, deletes where event_type is error."""
    e = table(spark, sf_dir, "events")
    return e.select(F.floor(F.col("event_id") / 100).alias("version"), F.col("event_id").alias("seq"), F.col("user_id").alias("key"), "value", (F.col("event_type") == "error").alias("is_delete"))


STATE = {"keys": ["key"], "order": ["version", "seq"]}
CHANGES_SQL = "(SELECT event_id // 100 AS version, event_id AS seq, user_id AS key, value, event_type = 'error' AS is_delete FROM events)"
R = 6


@query("SELECT version, round(c / (d / 1e9), 2) AS ops_per_sec FROM (SELECT ceil(l_orderkey / 100) * 100 AS version, sum(l_quantity) AS c, sum(l_extendedprice) AS d FROM lineitem GROUP BY 1)")
def batch_rate_100(spark, d):
    out = M.batch_rate(table(spark, d, "lineitem"), "l_orderkey", "l_quantity", "l_extendedprice", 100)
    return out.withColumn("ops_per_sec", F.round("ops_per_sec", 2))


@query("SELECT l_returnflag, version, round(c / (d / 1e9), 2) AS ops_per_sec FROM (SELECT l_returnflag, ceil(l_orderkey / 25) * 25 AS version, sum(l_quantity) AS c, sum(l_extendedprice) AS d FROM lineitem GROUP BY 1, 2)")
def batch_rate_by_run_25(spark, d):
    out = M.batch_rate(table(spark, d, "lineitem"), "l_orderkey", "l_quantity", "l_extendedprice", 25, by=["l_returnflag"])
    return out.withColumn("ops_per_sec", F.round("ops_per_sec", 2))


@query("SELECT l_returnflag AS run, round(coalesce(sum(l_quantity) / nullif(sum(l_extendedprice) / 1e9, 0), 0.0), 2) AS ops_per_sec FROM lineitem GROUP BY 1")
def total_rate(spark, d):
    out = M.total_rate(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "run"), "run", "l_quantity", "l_extendedprice")
    return out.withColumn("ops_per_sec", F.round("ops_per_sec", 2))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / nullif(l_extendedprice / 1e9, 0), 3) AS ops_per_sec FROM lineitem")
def row_rate(spark, d):
    out = M.row_rate(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("ops_per_sec", 3).alias("ops_per_sec"))


@query("""
WITH runs AS (SELECT DISTINCT event_type AS run FROM events),
commits AS (SELECT event_type AS run, count(*)::BIGINT AS n, sum(user_id)::BIGINT AS c FROM events WHERE event_type <> 'signup' GROUP BY 1),
mem AS (SELECT event_type AS run, max(value) / 1e9 AS m FROM events GROUP BY 1),
span AS (SELECT event_type AS run, (epoch_us(arg_max(ts, event_id)) - epoch_us(arg_min(ts, event_id))) / 6e7 AS e FROM events GROUP BY 1)
SELECT run AS name, coalesce(n, 0) AS versions_applied, coalesce(c, 0) AS total, m AS max_mem_gb, round(e, 6) AS elapsed_time_minutes
FROM runs LEFT JOIN commits USING (run) LEFT JOIN mem USING (run) LEFT JOIN span USING (run)""")
def run_summary(spark, d):
    e = events(spark, d).withColumnRenamed("event_type", "run")
    commits = e.filter("run <> 'signup'")
    n, c = M.commit_count(commits, "run", "n"), commits.groupBy("run").agg(F.sum("user_id").alias("c"))
    spans = M.span_minutes(e, "run", "event_id", "at", "e")
    out = M.peak_gb(e, "run", "value", "max_mem_gb").join(n, "run", "left").join(c, "run", "left").join(spans, "run", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(F.col("run").alias("name"), F.coalesce("n", zero).alias("versions_applied"), F.coalesce("c", zero).alias("total"), "max_mem_gb", F.round("e", R).alias("elapsed_time_minutes"))


@query("SELECT event_type AS run, max(value) / 1e9 AS peak_gb FROM events GROUP BY 1")
def peak_value_gb(spark, d):
    return M.peak_gb(table(spark, d, "events").withColumnRenamed("event_type", "run"), "run", "value", "peak_gb")


@query("SELECT event_type AS run, count(*) AS versions_applied FROM events GROUP BY 1")
def commit_count(spark, d):
    return M.commit_count(table(spark, d, "events").withColumnRenamed("event_type", "run"), "run")


@query("SELECT event_type AS run, round((epoch_us(arg_max(ts, event_id)) - epoch_us(arg_min(ts, event_id))) / 6e7, 6) AS elapsed_minutes FROM events GROUP BY 1")
def elapsed_minutes(spark, d):
    out = M.span_minutes(events(spark, d).withColumnRenamed("event_type", "run"), "run", "event_id", "at", "elapsed_minutes")
    return out.withColumn("elapsed_minutes", F.round("elapsed_minutes", R))


@query("SELECT user_id, " + ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{t}'), 6) AS \"{t}\"" for t in TYPES) + " FROM events GROUP BY 1")
def pivot_mean(spark, d):
    out = M.pivot_mean(table(spark, d, "events"), "user_id", "event_type", "value", TYPES)
    return out.select("user_id", *(F.round(t, R).alias(t) for t in TYPES))


TRUNCATED = "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type))"


@query(f"SELECT event_id, event_type, value FROM ({TRUNCATED})")
def truncate_to_shortest(spark, d):
    return M.truncate_to_shortest(table(spark, d, "events"), "event_type", ["event_id"]).select("event_id", "event_type", "value")


@query("SELECT r AS rank, " + ", ".join(f"max(value) FILTER (WHERE event_type = '{t}') AS \"{t}\"" for t in TYPES) + " FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id)::INTEGER AS r FROM events) GROUP BY 1")
def rank_aligned_series(spark, d):
    return M.rank_aligned(table(spark, d, "events"), "event_type", ["event_id"], "value", TYPES)


@query("SELECT event_id // 50 AS version, " + ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{t}'), 6) AS \"{t}\"" for t in TYPES) + " FROM events GROUP BY 1")
def version_aligned_series(spark, d):
    e = table(spark, d, "events").withColumn("version", F.floor(F.col("event_id") / 50))
    return M.version_aligned(e, "event_type", "version", "value", TYPES).select("version", *(F.round(t, R).alias(t) for t in TYPES))


@query("SELECT event_type AS msg, count(*) AS n, min(event_id) AS first_line, max(event_id) AS last_line FROM events GROUP BY 1")
def demux_counts(spark, d):
    return M.kind_counts(table(spark, d, "events").withColumnRenamed("event_type", "msg"), "msg", "event_id")


@query("SELECT event_id AS line, user_id AS version, value AS duration FROM events WHERE event_type = 'purchase'")
def demux_project(spark, d):
    e = table(spark, d, "events").select(F.lit("all").alias("run"), F.col("event_id").alias("line"), F.lit(None).cast("string").alias("time"), F.col("user_id").alias("version"), F.col("value").alias("duration"), F.lit(0).alias("count"), F.lit(0).alias("ops_per_sec"), F.when(F.col("event_type") == "purchase", "commit").alias("kind"))
    return RunLogs(e, duration_type="double").versions.select("line", "version", "duration")


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'commit' WHEN event_type = 'error' THEN 'memory' WHEN user_id % 2 = 0 THEN 'snapshot' ELSE 'other' END AS kind FROM events")
def demux_first_match(spark, d):
    msg = F.when(F.col("event_type") == "view", F.lit("committed version")).when(F.col("event_type") == "error", F.lit("mem stats")).otherwise(F.col("event_type"))
    kind = F.coalesce(message_kind(msg), F.when(F.col("user_id") % 2 == 0, "snapshot").otherwise("other"))
    return table(spark, d, "events").select("event_id", kind.alias("kind"))


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('view', 'click')")
def run_select(spark, d):
    return M.select_runs(table(spark, d, "events"), "event_type", ["view", "click"]).select("event_id", "event_type", "value")


@query("SELECT event_id, user_id FROM events WHERE event_id > 100 AND event_id <= 400")
def version_range(spark, d):
    return M.version_range(table(spark, d, "events"), "event_id", 100, 400).select("event_id", "user_id")


@query("SELECT name FROM (VALUES ('view'), ('none'), ('gone')) t(name) WHERE name NOT IN (SELECT event_type FROM events)")
def missing_run_check(spark, d):
    return M.missing_runs(table(spark, d, "events"), ["view", "none", "gone"], "event_type")


@query("SELECT n_nationkey AS id, n_name AS name, 'nation' AS run FROM nation UNION ALL SELECT r_regionkey, r_name, 'region' FROM region")
def union_tagged(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return M.tagged({"nation": a, "region": table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))})


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_field_extract(spark, d):
    return table(spark, d, "events").select("event_id", E.json_field("props", "k").cast("bigint").alias("k"))


@query("SELECT r_name AS run, p.store_key, p.versions FROM region, (SELECT unnest([{'store_key': 'bank', 'versions': 10}, {'store_key': 'staking', 'versions': 20}]) AS p)")
def params_inline(spark, d):
    params = F.expr("array(named_struct('store_key', 'bank', 'versions', 10), named_struct('store_key', 'staking', 'versions', 20))")
    return table(spark, d, "region").select(F.col("r_name").alias("run"), F.inline(params))


PHASES_SQL = """
WITH e AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s
  FROM events WHERE event_type IN ('signup', 'view', 'click', 'purchase')),
g AS (SELECT user_id, s, max(event_id) FILTER (WHERE event_type = 'signup') AS version, arg_max(ts, event_id) FILTER (WHERE event_type = 'signup') AS a,
  arg_max(ts, event_id) FILTER (WHERE event_type = 'view') AS b, arg_max(ts, event_id) FILTER (WHERE event_type = 'click') AS c,
  arg_max(ts, event_id) FILTER (WHERE event_type = 'purchase') AS f, max(event_id) FILTER (WHERE event_type = 'purchase') AS switch_version FROM e WHERE s > 0 GROUP BY 1, 2)
SELECT user_id, version, epoch_us(b) - epoch_us(a) AS snapshot_us, epoch_us(c) - epoch_us(b) AS best_effort_wal_us, epoch_us(f) - epoch_us(c) AS wal_sync_us, switch_version FROM g"""


def _phases(spark, d):
    return S.phases(events(spark, d), "user_id", ["event_id"], "at", "event_type", "event_id", start="signup", rewritten="view", caught_up="click", switched="purchase")


@query(PHASES_SQL)
def snapshot_phases(spark, d):
    return _phases(spark, d).select("user_id", "version", "snapshot_us", "best_effort_wal_us", "wal_sync_us", "switch_version")


@query(f"SELECT user_id, version, snapshot_us // 60000000 AS minutes FROM ({PHASES_SQL}) WHERE snapshot_us >= 0")
def snapshot_phase_minutes(spark, d):
    return _phases(spark, d).filter("snapshot_us >= 0").select("user_id", "version", E.whole_minutes("snapshot_us").alias("minutes"))


LATEST_SQL = "SELECT key, value, version, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM {}) WHERE r = 1 AND NOT is_delete"


@query(LATEST_SQL.format(CHANGES_SQL))
def latest_state(spark, d):
    return St.latest_state(changes(spark, d), **STATE)


@query(LATEST_SQL.format(f"(SELECT * FROM {CHANGES_SQL} WHERE version <= 5)"))
def state_as_of(spark, d):
    return St.state_as_of(changes(spark, d), 5, **STATE)


@query(LATEST_SQL.format(CHANGES_SQL))
def state_merge(spark, d):
    c = changes(spark, d)
    kept = St.last_changes(c.filter("version % 2 = 1"), **STATE)
    return St.merge_state(kept, c.filter("version % 2 = 0"), **STATE).filter("not is_delete").select("key", "value", "version", "seq")


CLASSES_SQL = f"""SELECT *, CASE WHEN NOT is_delete AND coalesce(lag(is_delete) OVER w, true) THEN 'create' WHEN NOT is_delete THEN 'update'
WHEN NOT coalesce(lag(is_delete) OVER w, true) THEN 'delete' ELSE 'noop' END AS op FROM {CHANGES_SQL} WINDOW w AS (PARTITION BY key ORDER BY seq)"""


@query(f"SELECT version, (sum(s) OVER (ORDER BY version))::BIGINT AS live_size FROM (SELECT version, sum(CASE op WHEN 'create' THEN 1 WHEN 'delete' THEN -1 ELSE 0 END) AS s FROM ({CLASSES_SQL}) GROUP BY 1)")
def live_size_by_version(spark, d):
    return St.live_size(St.classify(changes(spark, d), **STATE))


@query(f"SELECT op, count(*) AS n FROM ({CLASSES_SQL}) GROUP BY 1")
def op_class_counts(spark, d):
    return St.classify(changes(spark, d), **STATE).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT version, b + 1 AS expected FROM (SELECT version, lag(version) OVER (ORDER BY version) AS b FROM (SELECT DISTINCT event_id AS version FROM events WHERE event_type <> 'error')) WHERE version <> b + 1")
def version_gap_check(spark, d):
    return St.version_gaps(table(spark, d, "events").filter("event_type <> 'error'").withColumnRenamed("event_id", "version"))


@query(f"SELECT version, count(*) AS ops FROM {CHANGES_SQL} GROUP BY 1")
def ops_per_version(spark, d):
    return St.ops_per_version(changes(spark, d))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, d):
    return St.duplicate_names(table(spark, d, "part"), "p_name")


@query("SELECT s_nationkey::BIGINT AS store FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY 1")
def unknown_stores(spark, d):
    c = table(spark, d, "supplier").select(F.col("s_nationkey").cast("bigint").alias("store_key"))
    stores = table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").cast("bigint").alias("store_key"))
    return St.unknown_stores(c, stores).withColumnRenamed("store_key", "store")


@query("SELECT count(DISTINCT event_type) AS n_dirs, count(DISTINCT event_type) > 1 AS inconsistent FROM events")
def changeset_dir_consistency(spark, d):
    return M.inconsistent_dirs(table(spark, d, "events"), "event_type")


PLAN = StoreParams(**{**BANK.__dict__, "versions": 100})


@query("""
WITH RECURSIVE p(version, acc, k) AS (
  SELECT 1::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT version + 1, (acc + (2200200 - 35000)::DOUBLE / 99) - trunc(acc + (2200200 - 35000)::DOUBLE / 99), trunc(acc + (2200200 - 35000)::DOUBLE / 99) FROM p WHERE version < 100)
SELECT version, CASE WHEN version = 1 THEN 35000 ELSE k::BIGINT + 460 END::BIGINT AS creates, CASE WHEN version = 1 THEN 0 ELSE 1380 END::BIGINT AS updates, CASE WHEN version = 1 THEN 0 ELSE 460 END::BIGINT AS deletes FROM p""")
def plan_schedule(spark, d):
    return spark.createDataFrame(list(schedule(PLAN)), "version bigint, creates bigint, updates bigint, deletes bigint")


@query("SELECT event_id, lpad(event_id::VARCHAR, 9, '0') || '.delimpb' AS file, event_id AS version FROM events")
def filename_codec(spark, d):
    file = E.version_filename("event_id")
    return table(spark, d, "events").select("event_id", file.alias("file"), E.filename_version(F.concat(F.lit("/x/"), file)).alias("version"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN user_id WHEN 'click' THEN user_id * 1000 WHEN 'signup' THEN user_id * 1000000 WHEN 'error' THEN NULL ELSE user_id * 1000000000 + 500000000 END::BIGINT AS bytes FROM events""")
def size_parse(spark, d):
    n = F.col("user_id").cast("string")
    t = F.col("event_type")
    text = F.when(t == "view", F.concat(n, F.lit(" B"))).when(t == "click", F.concat(n, F.lit(" kB"))).when(t == "signup", F.concat(n, F.lit("MB"))).when(t == "error", F.concat(n, F.lit(" KiB"))).otherwise(F.concat(n, F.lit(".5 GB")))
    return table(spark, d, "events").select("event_id", E.parse_size(text).alias("bytes"))


@query("SELECT user_id AS bytes, CASE WHEN user_id < 1000 THEN user_id || ' B' WHEN round(user_id / 1000, 1) < 10 THEN format('{:.1f} kB', user_id / 1000) ELSE format('{:.0f} kB', user_id / 1000) END AS shown FROM (SELECT DISTINCT user_id FROM events)")
def size_humanize(spark, d):
    return table(spark, d, "events").select("user_id").distinct().select(F.col("user_id").alias("bytes"), E.humanize_bytes("user_id").alias("shown"))


@query("SELECT event_id, epoch_us(ts) AS micros FROM events")
def iso_parse(spark, d):
    text = F.concat(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return events(spark, d).select("event_id", F.unix_micros(E.parse_iso(text)).alias("micros"))


@query("SELECT event_id, format('{:,}', event_id * 1000) AS shown FROM events")
def grouped_thousands(spark, d):
    return table(spark, d, "events").select("event_id", E.thousands(F.col("event_id") * 1000).alias("shown"))


@query("""
SELECT event_id, asof_version FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (ORDER BY ts, event_type <> 'purchase', event_id) AS asof_version
FROM events WHERE event_type IN ('purchase', 'view')) WHERE event_type = 'view'""")
def sample_asof_version(spark, d):
    e = events(spark, d).withColumn("run", F.lit("all"))
    out = M.sample_asof(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'"), "run", "at", "event_id")
    return out.select("event_id", "asof_version")


@query("SELECT event_id, (sum(1) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW))::BIGINT / 3600.0::DOUBLE AS moving_rate FROM events")
def moving_avg_1h(spark, d):
    return M.moving_rate(events(spark, d).withColumn("one", F.lit(1)), "event_type", "ts", "one").select("event_id", "moving_rate")


@query("SELECT event_type AS run, arg_max(value, event_id) AS last_value, arg_min(value, event_id) AS first_value FROM events GROUP BY 1")
def last_in_order(spark, d):
    return M.ends(table(spark, d, "events").withColumnRenamed("event_type", "run"), "run", "event_id", "value")


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY encode(p_name), p_partkey) AS rank FROM part")
def byte_order(spark, d):
    return M.byte_ranked(table(spark, d, "part"), "p_name", ["p_partkey"]).select("p_partkey", "p_name", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT event_type AS run, seq, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq FROM events) WHERE seq = 7")
def kth_in_order(spark, d):
    return M.kth(table(spark, d, "events").withColumnRenamed("event_type", "run"), "run", ["event_id"], 7).select("run", F.col("seq").cast("bigint").alias("seq"), "user_id")


@query("SELECT event_type AS run, event_id::DOUBLE AS version, unnest(['user', 'value']) AS metric, unnest([user_id::DOUBLE, value]) AS value FROM events")
def tidy_series(spark, d):
    from .sinks.events import tidy

    return tidy(table(spark, d, "events").withColumnRenamed("user_id", "user"), "event_type", "event_id", ["user", "value"])


# Logs: events as lines of run logs, whose run is the event type, and those read back.

_WRITTEN: dict[tuple, str] = {}


def once(spark: SparkSession, d: str, what: str, write: Callable[[str], None]) -> str:
    """Folder of files made of a data folder's tables: written to the shared folder at first use in a session."""
    key = (spark.sparkContext.applicationId, d, what)
    if key not in _WRITTEN or not files.exists(_WRITTEN[key], spark):
        folder = files.scratch_folder(spark, what)
        write(folder)
        _WRITTEN[key] = folder
    return _WRITTEN[key]


LINES_SQL = """(SELECT event_id AS e, user_id AS u, event_type AS run, ts, CASE WHEN event_id % 1000 = 4 THEN 'header' WHEN event_id % 1000 = 5 AND event_type IN ('view', 'click') THEN 'footer'
WHEN event_id % 10 = 0 THEN 'memory' WHEN event_id % 10 = 1 THEN 'disk' WHEN event_id % 10 = 2 THEN 'legacy' WHEN event_id % 10 = 3 THEN 'snapshot' ELSE 'commit' END AS kind FROM events)"""


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as log lines: run, event_id and value, a line's JSON."""
    e, u = F.col("event_id"), F.col("user_id")
    digit = e % 10
    kind = F.when(e % 1000 == 4, "header").when((e % 1000 == 5) & F.col("event_type").isin("view", "click"), "footer")
    for k, name in enumerate(("memory", "disk", "legacy", "snapshot")):
        kind = kind.when(digit == k, name)
    kind = kind.otherwise("commit")
    only = lambda names, value: F.when(F.col("kind").isin(names), value)
    phase = F.element_at(F.array(*(F.lit(x) for x in (S.START, S.REWRITTEN, S.CAUGHT_UP, S.SWITCHED))), (F.floor(e % 40 / 10) + 1).cast("int"))
    msg = F.when(F.col("kind") == "header", "starting run").when(F.col("kind") == "footer", "benchmark run complete").when(F.col("kind") == "memory", "mem stats").when(F.col("kind") == "disk", "disk usage")
    msg = msg.when(F.col("kind") == "legacy", "full post-commit stats").when(F.col("kind") == "snapshot", phase).otherwise("committed version")
    params = F.array(F.struct(F.lit("bank").alias("store_key"), e.alias("versions")), F.struct(F.lit("staking").alias("store_key"), u.alias("versions")))
    text = lambda c, unit: F.concat(c.cast("string"), F.lit(f" {unit}"))
    line = F.struct(
        F.concat(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("time"), msg.alias("msg"), F.when(F.col("kind") == "snapshot", "store").otherwise("runner").alias("module"),
        only(["commit", "memory", "disk", "legacy", "snapshot"], e).alias("version"), only(["commit"], (u + 1) * 1_000_000).alias("duration"), only(["commit"], u).alias("count"), only(["commit"], u * 1.5).alias("ops_per_sec"),
        F.when((F.col("kind") == "commit") & (digit == 6), text(u, "B")).alias("disk_usage"), only(["disk"], text(u, "kB")).alias("size"), only(["memory"], text(u, "MB")).alias("alloc"), only(["memory"], text(u, "kB")).alias("sys"),
        only(["memory"], u % 7).alias("num_gc"), only(["memory"], F.lit(0.25)).alias("gc_cpu_fraction"),
        only(["legacy"], F.struct((u * 1000).alias("Alloc"), (u * 2000).alias("Sys"), (u % 5).alias("NumGC"), F.lit(0.5).alias("GCCPUFraction"))).alias("mem_stats"),
        only(["header"], F.lit(0)).alias("start_version"), only(["header"], e).alias("target_version"), only(["header"], F.concat(F.lit("/d"), (e % 2).cast("string"))).alias("changeset_dir"), only(["header"], F.lit("table")).alias("tree_type"),
        only(["header"], F.struct(e.alias("versions"), F.array(F.lit("bank"), F.lit("staking")).alias("store_names"), params.alias("store_params"))).alias("changeset_info"), only(["footer"], u).alias("versions_applied"),
    )
    return events(spark, d).withColumn("kind", kind).select(F.col("event_type").alias("run"), "event_id", F.to_json(line).alias("value"))


def logs(spark: SparkSession, d: str) -> RunLogs:
    """The logs of a data folder, read strictly from their files."""
    return read_logs(spark, once(spark, d, "logs", lambda folder: K.write_run_logs(log_lines(spark, d), folder, "event_id")))


MEM_SQL = f"(SELECT run, e, CASE kind WHEN 'memory' THEN u * 1000000 ELSE u * 1000 END AS alloc, CASE kind WHEN 'memory' THEN u * 1000 ELSE u * 2000 END AS sys, CASE kind WHEN 'memory' THEN u % 7 ELSE u % 5 END AS num_gc, CASE kind WHEN 'memory' THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS gc_cpu_fraction FROM {LINES_SQL} WHERE kind IN ('memory', 'legacy'))"
DISK_SQL = f"(SELECT run, e, CASE kind WHEN 'disk' THEN u * 1000 ELSE u END AS size FROM {LINES_SQL} WHERE kind = 'disk' OR (kind = 'commit' AND e % 10 = 6))"
HEADER_SQL = f"(SELECT run, arg_max(e, e) AS e, arg_max(u, e) AS u, arg_max(ts, e) AS ts FROM {LINES_SQL} WHERE kind = 'header' GROUP BY 1)"
FOOTER_SQL = f"(SELECT run, arg_max(u, e) AS u, arg_max(ts, e) AS ts FROM {LINES_SQL} WHERE kind = 'footer' GROUP BY 1)"
COMMIT_SQL = f"(SELECT * FROM {LINES_SQL} WHERE kind = 'commit')"
ELAPSED_SQL = f"""(SELECT r.run, round(CASE WHEN h.ts IS NULL OR coalesce(f.ts, c.ts) IS NULL THEN 0.0 ELSE (epoch_us(coalesce(f.ts, c.ts)) - epoch_us(h.ts)) / 6e7 END, 6) AS minutes
FROM (SELECT DISTINCT run FROM {LINES_SQL}) r LEFT JOIN {HEADER_SQL} h USING (run) LEFT JOIN {FOOTER_SQL} f USING (run) LEFT JOIN (SELECT run, arg_max(ts, e) AS ts FROM {COMMIT_SQL} GROUP BY 1) c USING (run))"""


@query(f"SELECT run, e AS version, epoch_us(ts) AS micros, (u + 1) * 1000000 AS duration, u AS count, u * 1.5::DOUBLE AS ops_per_sec FROM {COMMIT_SQL}")
def log_versions(spark, d):
    return logs(spark, d).versions.select("run", "version", F.unix_micros("ts").alias("micros"), "duration", "count", "ops_per_sec")


@query(f"SELECT run, e AS version, alloc, sys, num_gc, gc_cpu_fraction FROM {MEM_SQL}")
def log_memory(spark, d):
    return logs(spark, d).memory.select("run", "version", "alloc", "sys", "num_gc", "gc_cpu_fraction")


@query(f"SELECT run, e AS version, size FROM {DISK_SQL}")
def log_disk(spark, d):
    return logs(spark, d).disk.select("run", "version", "size")


@query(f"SELECT run, 0::BIGINT AS start_version, e AS target_version, '/d' || (e % 2) AS changeset_dir, 'table' AS tree_type, epoch_us(ts) AS started FROM {HEADER_SQL}")
def log_headers(spark, d):
    return logs(spark, d).headers.select("run", "start_version", "target_version", "changeset_dir", "tree_type", F.unix_micros("started").alias("started"))


@query(f"SELECT run, u AS versions_applied, epoch_us(ts) AS completed FROM {FOOTER_SQL}")
def log_footers(spark, d):
    return logs(spark, d).footers.select("run", "versions_applied", F.unix_micros("completed").alias("completed"))


@query(f"SELECT run, store_key, versions FROM (SELECT run, 'bank' AS store_key, e AS versions FROM {HEADER_SQL} UNION ALL SELECT run, 'staking', u FROM {HEADER_SQL})")
def log_store_params(spark, d):
    return logs(spark, d).store_params.select("run", "store_key", "versions")


@query(f"SELECT count(DISTINCT e % 2) AS n_dirs, count(DISTINCT e % 2) > 1 AS inconsistent FROM {HEADER_SQL}")
def log_dir_consistency(spark, d):
    return M.inconsistent_dirs(logs(spark, d).headers)


@query(f"SELECT run, minutes AS elapsed_time_minutes FROM {ELAPSED_SQL}")
def log_elapsed(spark, d):
    own = logs(spark, d)
    return M.elapsed(own.headers, own.footers, own.versions).withColumn("elapsed_time_minutes", F.round("elapsed_time_minutes", R))


SUMMARY_SQL = f"""SELECT run AS name, coalesce(n, 0) AS versions_applied, minutes AS elapsed_time_minutes, round(coalesce(c / (d / 1e9), 0.0), 6) AS ops_per_sec, coalesce(m / 1e9, 0.0) AS max_mem_gb, coalesce(s / 1e9, 0.0) AS max_disk_gb
FROM {ELAPSED_SQL} LEFT JOIN (SELECT run, count(*) AS n, sum(u) AS c, sum((u + 1) * 1000000) AS d FROM {COMMIT_SQL} GROUP BY 1) USING (run)
LEFT JOIN (SELECT run, max(alloc) AS m FROM {MEM_SQL} GROUP BY 1) USING (run) LEFT JOIN (SELECT run, max(size) AS s FROM {DISK_SQL} GROUP BY 1) USING (run)"""


@query(SUMMARY_SQL)
def log_summary(spark, d):
    return M.summary(logs(spark, d)).withColumns({"elapsed_time_minutes": F.round("elapsed_time_minutes", R), "ops_per_sec": F.round("ops_per_sec", R)})


@query(f"SELECT name, versions_applied, max_mem_gb FROM ({SUMMARY_SQL}) WHERE name IN ('view', 'click')")
def log_summary_of_named(spark, d):
    return M.summary(logs(spark, d), ["view", "click"]).select("name", "versions_applied", "max_mem_gb")


@query(f"SELECT e AS version, round(avg(CASE WHEN run = 'view' THEN sys / 1e9 END), 9) AS view, round(avg(CASE WHEN run = 'click' THEN sys / 1e9 END), 9) AS click FROM {MEM_SQL} WHERE run IN ('view', 'click') GROUP BY 1")
def log_memory_series(spark, d):
    names = ["view", "click"]
    out = M.memory_series(M.select_runs(logs(spark, d).memory, "run", names), "sys", names)
    return out.select("version", *(F.round(n, 9).alias(n) for n in names))


@query(f"SELECT run, bool_or(kind = 'footer') AS complete, 0::BIGINT AS corrupt_lines FROM {LINES_SQL} GROUP BY 1")
def log_status(spark, d):
    return logs(spark, d).status


@query(f"""
WITH s AS (SELECT run, e, ts, (e % 40) // 10 AS p, sum((e % 40 = 3)::INT) OVER (PARTITION BY run ORDER BY e ROWS UNBOUNDED PRECEDING) AS k FROM {LINES_SQL} WHERE kind = 'snapshot'),
g AS (SELECT run, k, max(e) FILTER (WHERE p = 0) AS version, arg_max(ts, e) FILTER (WHERE p = 0) AS a, arg_max(ts, e) FILTER (WHERE p = 1) AS b, arg_max(ts, e) FILTER (WHERE p = 2) AS c, arg_max(ts, e) FILTER (WHERE p = 3) AS f, max(e) FILTER (WHERE p = 3) AS switch_version FROM s WHERE k > 0 GROUP BY 1, 2)
SELECT run, version, epoch_us(b) - epoch_us(a) AS snapshot_us, epoch_us(c) - epoch_us(b) AS best_effort_wal_us, epoch_us(f) - epoch_us(c) AS wal_sync_us, switch_version FROM g""")
def log_snapshot_phases(spark, d):
    return S.phases(logs(spark, d).snapshot_events(["store"])).select("run", "version", "snapshot_us", "best_effort_wal_us", "wal_sync_us", "switch_version")


# Changesets: events as files of one version each, read back, replayed and generated.

STORED_SQL = "(SELECT event_id // 1000 + 1 AS version, event_id % 1000 AS seq, event_type AS store_key, user_id, value, event_id % 9 = 0 AS is_delete FROM events)"


def stored(spark: SparkSession, d: str) -> DataFrame:
    """Events as changes with binary keys and values."""
    e, gone = table(spark, d, "events"), F.col("event_id") % 9 == 0
    value = F.when(~gone, F.round("value", 3).cast("string").cast("binary"))
    return e.select((F.floor(F.col("event_id") / 1000) + 1).alias("version"), (F.col("event_id") % 1000).alias("seq"), F.col("event_type").alias("store_key"), F.col("user_id").cast("string").cast("binary").alias("key"), value.alias("value"), gone.alias("is_delete"))


STORES = [StoreParams(t, 8, 0, 8, 0, 40, 40, 5, 8, 0.25) for t in TYPES]


def changeset_folder(spark: SparkSession, d: str) -> str:
    """The folder of a data folder's changesets; Parquet where the shared folder can't be mounted."""

    def write(folder: str) -> None:
        if changesets.is_mounted(folder):
            changesets.write_changes(stored(spark, d), folder, params_rows(STORES))
        else:
            changesets.write_parquet(stored(spark, d), folder)

    return once(spark, d, "changesets", write)


def changes_of(spark: SparkSession, d: str) -> DataFrame:
    """The changes read back."""
    folder = changeset_folder(spark, d)
    return changesets.read_changes(spark, folder) if changesets.is_mounted(folder) else spark.read.parquet(folder)


PLAIN = ["version", "seq", "store_key", "user_id", "value", "is_delete"]


def plain(c: DataFrame) -> DataFrame:
    """Changes with their keys and values as numbers."""
    return c.withColumns({"user_id": F.col("key").cast("string").cast("bigint"), "value": F.col("value").cast("string").cast("double")})


@query(f"SELECT version, seq, store_key, user_id, CASE WHEN NOT is_delete THEN round(value, 3) END AS value, is_delete FROM {STORED_SQL}")
def changeset_scan(spark, d):
    return plain(changes_of(spark, d)).select(PLAIN)


@query(f"SELECT version, seq, store_key, user_id, CASE WHEN NOT is_delete THEN round(value, 3) END AS value, is_delete FROM {STORED_SQL} WHERE version > 2 AND version <= 5")
def changeset_version_range(spark, d):
    return plain(M.version_range(changes_of(spark, d), "version", 2, 5)).select(PLAIN)


@query(f"SELECT store_key, user_id, round(value, 3) AS value, version, seq FROM (SELECT *, row_number() OVER (PARTITION BY store_key, user_id ORDER BY version DESC, seq DESC) AS r FROM {STORED_SQL}) WHERE r = 1 AND NOT is_delete")
def replay_state(spark, d):
    """All versions replayed in five commits by two backends, the second resuming at the first one's marker."""
    changes, folder = changes_of(spark, d), files.scratch_folder(spark, "replay")
    top = changes.agg(F.max("version")).head()[0] or 0
    step = max(1, -(-top // 5))
    for target in (min(top, 2 * step), top):
        backend = TableBackend(spark, folder, TableOptions(checkpoint_interval=2))
        replay(backend, changes, target, step=step)
    state = backend.state() if top else St.last_changes(changes)
    return plain(state.filter(~F.col("is_delete"))).select("store_key", "user_id", "value", "version", "seq")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', 8, 40, 5::BIGINT, 8, 0.25::DOUBLE)" for t in TYPES) + ") t(store_key, key_mean, initial_size, versions, change_per_version, delete_fraction)")
def manifest_stores(spark, d):
    folder = changeset_folder(spark, d)
    found = changesets.manifest_stores(changesets.read_manifest(spark, folder)) if changesets.is_mounted(folder) else spark.createDataFrame(params_rows(STORES))
    return found.select("store_key", "key_mean", "initial_size", "versions", "change_per_version", "delete_fraction")


@query("SELECT s.store_key, v.version, o.op, o.n FROM (VALUES " + ", ".join(f"('{t}')" for t in TYPES) + ") s(store_key), (SELECT unnest(range(1, 6)) AS version) v, (VALUES ('create', 40::BIGINT, 1), ('create', 2, 2), ('update', 6, 2), ('delete', 2, 2)) o(op, n, least) WHERE (v.version = 1) = (o.least = 1)")
def generated_ops(spark, d):
    made = St.classify(generate(spark, STORES, seed=3))
    return made.groupBy("store_key", "version", "op").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT version, unnest(range(100, n + 1, 100))::BIGINT AS count FROM (SELECT event_id // 2500 AS version, count(*) AS n FROM events GROUP BY 1)")
def progress_marks(spark, d):
    return St.progress_marks(table(spark, d, "events").withColumn("version", F.floor(F.col("event_id") / 2500)), 100)
