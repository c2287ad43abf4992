"""Files, manifests, the generator, plans and streams."""

import io
import json
import os
import random
from dataclasses import replace

import pytest

from ledgerline.operators import state as St
from ledgerline.plans import run_plan as P
from ledgerline.sources import changesets as C
from ledgerline.sources import generator as G
from ledgerline.streaming.incremental import StreamedState, stream_batch_rate, stream_changes
from tests.conftest import rows
from tests.test_logs import ALPHA, write
from tests.test_state import GOLD, frame, state


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    C.write_changes(frame(spark, GOLD), path)
    back = C.read_changes(spark, path)
    flat = lambda df: rows(df.selectExpr("version", "seq", "store_key", "hex(key)", "hex(value)", "is_delete"))
    assert flat(back) == flat(frame(spark, GOLD))
    assert C.read_changes(spark, path, 1, 2).select("version").distinct().collect()[0][0] == 2
    with pytest.raises(FileExistsError):
        C.write_changes(frame(spark, GOLD), path)
    C.write_parquet(frame(spark, GOLD), str(tmp_path / "native"))
    assert spark.read.parquet(str(tmp_path / "native")).count() == len(GOLD)


def test_cut_off_file(spark, tmp_path):
    whole = C.encode("s", b"k", b"v" * 300, False) + C.encode("s", b"k", None, True)
    (tmp_path / C.file_name(1)).write_bytes(whole)
    assert C.read_changes(spark, str(tmp_path)).count() == 2
    (tmp_path / C.file_name(1)).write_bytes(whole[:-1])
    with pytest.raises(Exception, match="ends inside"):
        C.read_changes(spark, str(tmp_path)).collect()


def test_manifest_and_marker(spark, tmp_path):
    stores = G.params_rows(G.profile("mixed", 10))
    C.write_manifest(str(tmp_path), 3, stores)
    m = C.read_manifest(spark, str(tmp_path))
    assert (m.head()["versions"], m.head()["store_names"]) == (3, ["bank", "staking", "lockup"])
    assert C.manifest_stores(m).count() == 3
    assert C.load_version(str(tmp_path)) == 0
    C.save_version(str(tmp_path), 7)
    assert C.load_version(str(tmp_path)) == 7


@pytest.mark.parametrize(("name", "live", "ops"), [("bank", 2200199, 25197899), ("staking", 1600696, 5410315), ("lockup", 2600200, 7279732)])
def test_schedules(name, live, ops):
    p = next(s for s in G.profile("mixed", 10_000) if s.store_key == name)
    plan = list(G.schedule(p))
    assert plan[0] == (1, 35000, 0, 0)
    assert plan[1][2:] == {"bank": (1380, 460), "staking": (229, 76), "lockup": (258, 105)}[name]
    assert sum(c - d for _, c, _, d in plan) == live
    assert sum(c + u + d for _, c, u, d in plan) == ops


def test_schedule_edges():
    assert list(G.schedule(replace(G.BANK, versions=1))) == [(1, 35000, 0, 0)]
    small = next(s for s in G.profile("mixed", 100, 0.01) if s.store_key == "staking")
    assert all(c <= 0 for _, c, _, _ in list(G.schedule(small))[1:])
    with pytest.raises(ValueError, match="profile"):
        G.profile("none", 1)


def test_generate(spark):
    stores = [replace(G.BANK, initial_size=200, final_size=260, versions=6, change_per_version=40), replace(G.STAKING, value_mean=50, value_std_dev=10, initial_size=100, final_size=120, versions=6, change_per_version=20)]
    c = G.generate(spark, stores, seed=4).cache()
    planned = {(p.store_key, v): (n, u, d) for p in stores for v, n, u, d in G.schedule(p)}
    ops = {}
    for r in St.classify(c).groupBy("store_key", "version", "op").count().collect():
        ops.setdefault((r["store_key"], r["version"]), {})[r["op"]] = r["count"]
    assert {k: (x.get("create", 0), x.get("update", 0), x.get("delete", 0)) for k, x in ops.items()} == planned
    assert c.filter("length(key) < 1").count() == 0
    for v, n, top in c.groupBy("version").agg({"seq": "count", "*": "count"}).selectExpr("version", "`count(1)`", "`count(seq)` - 1").collect():
        assert c.filter(f"version = {v}").selectExpr("max(seq)", "count(distinct seq)").head()[:] == (top, n)
    assert rows(c.selectExpr("version", "seq", "hex(key)")) == rows(G.generate(spark, stores, seed=4).selectExpr("version", "seq", "hex(key)"))


def test_update_without_keys():
    plan = __import__("pandas").DataFrame([(1, 0, 1, 0)], columns=["version", "creates", "updates", "deletes"])
    with pytest.raises(ValueError, match="no key"):
        list(G.store_changes(G.BANK, plan, 0))
    assert [r[4] for r in G.store_changes(G.BANK, plan, 0, no_keys_is_error=False)] == [False]


def test_plan_file(tmp_path):
    (tmp_path / "p.jsonc").write_text('{ // runs\n "runs": [ {"name": "a//b", "runner": "table", /* x */ "options": {"checkpoint_interval": 2,}}, ]}')
    assert P.read_plan(str(tmp_path / "p.jsonc")) == [P.Run("a//b", "table", {"checkpoint_interval": 2})]
    with pytest.raises(ValueError, match="unknown options: z"):
        P.strict_options(P.TableOptions, {"z": 1})
    with pytest.raises(ValueError, match="unknown"):
        P.strict_options(None, {"z": 1})


def test_replay_and_resume(spark, tmp_path):
    c = frame(spark, GOLD)
    C.write_changes(c, str(tmp_path / "in"))
    events = []
    b = P.TableBackend(spark, str(tmp_path / "db"))
    assert P.replay(b, C.read_changes(spark, str(tmp_path / "in")), 2, events) == 2
    again = P.TableBackend(spark, str(tmp_path / "db"))
    assert again.version() == 2
    P.replay(again, C.read_changes(spark, str(tmp_path / "in"), after=2), 3)
    assert state(again.state().filter("not is_delete")) == state(St.latest_state(c))
    assert [(e["version"], e["count"]) for e in events] == [(1, 3), (2, 3)]
    with pytest.raises(RuntimeError, match="expected version 5"):
        P.replay(again, c.withColumn("version", c.version * 2), 5)
    found = P.run_all(spark, [P.Run("x", "none"), P.Run("y", "table"), P.Run("z", "table", {"bad": 1})], str(tmp_path / "in"), 3, {"table": P.TableBackend}, str(tmp_path / "runs"))
    assert found["y"] == "complete" and found["x"].startswith("failed") and found["z"].startswith("failed")


def test_streamed_state_in_any_order(spark, tmp_path):
    c = frame(spark, GOLD)
    source = str(tmp_path / "in")
    kept = StreamedState(spark, str(tmp_path / "state"))
    for v in (3, 1, 2):
        c.filter(f"version = {v}").write.mode("append").parquet(source)
        kept.start(stream_changes(spark, source, 1), str(tmp_path / "ck")).awaitTermination()
    assert state(kept.live()) == state(St.latest_state(c))
    before = kept.current()
    kept.merge(c, before)
    assert kept.current() == before


def test_streamed_rate(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    folder = write(tmp_path / "logs", alpha=ALPHA)
    q = stream_batch_rate(spark, folder, 2).writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("rates")) == [("alpha", 2.0, 150.0), ("alpha", 4.0, 160.0), ("alpha", 6.0, 100.0)]


def test_sink(spark, tmp_path):
    from ledgerline.sinks.events import write_events

    e = spark.createDataFrame([(1, "INFO", "b"), (0, "DEBUG", "a"), (2, "ERROR", None)], "n int, level string, msg string")
    write_events(e, str(tmp_path / "o"), "n")
    text = "".join(f.read_text() for f in (tmp_path / "o").glob("part-*"))
    assert [json.loads(x) for x in text.splitlines()] == [{"n": 1, "level": "INFO", "msg": "b"}, {"n": 2, "level": "ERROR"}]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from ledgerline import __main__ as cli
    from ledgerline.sources import generator

    monkeypatch.setattr(cli, "session", lambda: spark)
    small = [replace(G.BANK, initial_size=20, final_size=30, versions=3, change_per_version=8)]
    monkeypatch.setattr(generator, "profile", lambda *a: small)
    out, db = str(tmp_path / "in"), str(tmp_path / "db")
    cli.main(["gen-changesets", out, "--versions", "3"])
    cli.main(["bench", "--changeset-dir", out, "--db-dir", db])
    assert [json.loads(x)["version"] for x in capsys.readouterr().out.splitlines()] == [1, 2, 3]
    (tmp_path / "plan.jsonc").write_text('{"runs": [{"name": "a", "runner": "table"}]}')
    cli.main(["bench-all", str(tmp_path / "plan.jsonc"), "--changeset-dir", out, "--out", str(tmp_path / "o")])
    assert json.loads(capsys.readouterr().out) == {"a": "complete"}
    monkeypatch.delenv("BENCHMARK_RESULTS", raising=False)
    with pytest.raises(KeyError, match="BENCHMARK_RESULTS"):
        cli.main(["summary"])
    (tmp_path / "logs").mkdir()
    monkeypatch.setenv("BENCHMARK_RESULTS", write(tmp_path / "logs", alpha=ALPHA))
    cli.main(["summary"])


def test_directory_size_and_asof(spark, tmp_path):
    from ledgerline.operators import metrics as M

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x").write_bytes(b"12345")
    (tmp_path / "a" / "b" / "y").write_bytes(b"123")
    assert M.directory_size(spark, str(tmp_path / "a")).head()[:] == (8, 2)
    samples = spark.createDataFrame([("r", 5, "m"), ("r", 15, "n"), ("q", 1, "o")], "run string, ts int, s string")
    commits = spark.createDataFrame([("r", 5, 1), ("r", 10, 2)], "run string, ts int, version long")
    assert rows(M.sample_asof(samples, commits, "run", "ts", "version").select("s", "asof_version")) == [("m", 1), ("n", 2), ("o", None)]


def test_filters_choose_files(spark, tmp_path):
    folder = str(tmp_path / "in")
    made = spark.createDataFrame([(v, i, "s", b"k%d" % i, b"v", False) for v in range(1, 9) for i in range(3)], "version long, seq long, store_key string, key binary, value binary, is_delete boolean")
    C.write_changes(made, folder, G.params_rows([G.BANK]))
    assert C.read_manifest(spark, folder).head()["versions"] == 8
    whole = C.read_changes(spark, folder)
    for condition, versions in (("version = 3", [3]), ("version in (2, 5) and seq = 1", [2, 5]), ("version > 2 and version <= 4", [3, 4]), ("version >= 7", [7, 8]), ("version < 1", []), ("version = 3 and version = 4", [])):
        part = whole.filter(condition)
        assert sorted({r["version"] for r in part.collect()}) == versions
        assert part.rdd.getNumPartitions() <= max(1, len(versions)), condition
    assert rows(C.read_remote(spark, f"file://{folder}", 2, 4).selectExpr("version", "seq", "hex(key)")) == rows(whole.filter("version > 2 and version <= 4").selectExpr("version", "seq", "hex(key)"))
    assert C.read_remote(spark, f"file://{folder}", 8).count() == 0
    with pytest.raises(ValueError, match="mounted"):
        C.write_changes(made, "hdfs://x/y")


def test_decode_across_pieces():
    rng = random.Random(4)
    entries = [(rng.choice(["", "bank", "x" * 300]), rng.randbytes(rng.choice([0, 1, 200, 5000])), None if gone else rng.randbytes(rng.choice([0, 3, 130])), gone) for gone in rng.choices([False, True], k=300)]
    raw = b"".join(C.encode(*e) for e in entries)
    for piece in (1, 7, 129, 4096, 1 << 20):
        assert list(C.decode(io.BytesIO(raw).read, piece=piece)) == entries
    for cut in (1, len(C.encode(*entries[-1])) - 1):
        with pytest.raises(ValueError, match="ends inside"):
            list(C.decode(io.BytesIO(raw[:-cut] if entries[-1][1] else raw[:-1]).read, piece=64))
    with pytest.raises(ValueError, match="number"):
        list(C.decode(io.BytesIO(b"\x80").read))
    with pytest.raises(ValueError, match="behind"):
        list(C.decode(io.BytesIO(C.put_varint(3) + bytes([3 << 3 | 2, 9, 1])).read))
    got = list(C.decoded_batches(io.BytesIO(raw).read, 7, (1, 2, 3, 4), rows=64, size=20_000))
    assert [r for b in got for r in zip(*(c.to_pylist() for c in b.columns), strict=True)] == [(7, i, *e) for i, e in enumerate(entries)]
    assert max(b.num_rows for b in got) <= 64 and len(got) > 5


def test_files_are_shared_out(spark, tmp_path):
    assert C.share_out([], 4) == []
    assert C.share_out([10] * 8, 4, opening=0, most=20) == [0, 2, 4, 6]
    assert C.share_out([1 << 30, 5, 5, 1 << 30, 5], 2) == [0, 1, 3, 4]
    rng = random.Random(1)
    for _ in range(50):
        sizes, tasks = [rng.randrange(1, 1 << 26) for _ in range(rng.randrange(1, 200))], rng.randrange(1, 40)
        begins = C.share_out(sizes, tasks)
        runs = [sizes[a:b] for a, b in zip(begins, [*begins[1:], len(sizes)], strict=True)]
        assert begins[0] == 0 and [x for r in runs for x in r] == sizes
        assert all(len(r) == 1 or sum(r) <= 128 << 20 for r in runs) and len(runs) <= 2 * max(tasks, sum(sizes) >> 26) + 1
    folder = str(tmp_path / "many")
    made = spark.range(2000).selectExpr("id div 4 + 1 as version", "id % 4 as seq", "'s' as store_key", "cast(cast(id as string) as binary) as key", "cast('v' as binary) as value", "false as is_delete")
    C.write_changes(made, folder)
    back = C.read_changes(spark, folder)
    assert rows(back) == rows(made) and back.rdd.getNumPartitions() <= 20
    reader = C._Reader({"path": folder, "after": "490", "tasks": "3"})
    assert [v for p in reader.partitions() for v, _ in p.files] == list(range(491, 501)) and len(reader.partitions()) <= 10


def test_checkpoint_interval(spark, tmp_path):
    folder = str(tmp_path / "in")
    made = spark.createDataFrame([(v, i, "s", b"k%d" % (i * v % 5), None if i == 2 else b"v%d" % v, i == 2) for v in range(1, 8) for i in range(4)], "version long, seq long, store_key string, key binary, value binary, is_delete boolean")
    C.write_changes(made, folder)
    kept = {}
    for interval in (1, 3, 0):
        backend = P.TableBackend(spark, str(tmp_path / f"db{interval}"), P.TableOptions(interval))
        events = []
        P.replay(backend, C.read_changes(spark, folder), 4, events)
        backend = P.TableBackend(spark, str(tmp_path / f"db{interval}"), P.TableOptions(interval))
        P.replay(backend, C.read_changes(spark, folder), 7, events)
        assert [e["count"] for e in events] == [4] * 7 and backend.version() == 7
        kept[interval] = sorted(n for n in os.listdir(tmp_path / f"db{interval}") if n[0] in "sc")
        assert rows(backend.state().selectExpr("hex(key)", "hex(value)", "is_delete", "version")) == rows(St.last_changes(made).selectExpr("hex(key)", "hex(value)", "is_delete", "version"))
    assert kept == {1: ["s7"], 3: ["c7", "s6"], 0: [f"c{v}" for v in range(1, 8)]}
