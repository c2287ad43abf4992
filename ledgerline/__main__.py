"""Command line: generate a workload, replay it, run a plan, or print a summary of logs."""

from __future__ import annotations

import argparse
import json
import os

from .operators import metrics
from .plans.run_plan import TableBackend, TableOptions, read_plan, replay, run_all, strict_options
from .session import session
from .sources import changesets, generator
from .sources.logs import read_logs, results_dir


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ledgerline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    g = commands.add_parser("gen-changesets")
    g.add_argument("out")
    g.add_argument("--versions", type=int, default=100)
    g.add_argument("--profile", choices=["mixed", "osmo"], default="mixed")
    g.add_argument("--scale", type=float, default=1.0)
    g.add_argument("--seed", type=int, default=0)
    b = commands.add_parser("bench")
    b.add_argument("--changeset-dir", required=True)
    b.add_argument("--db-dir", required=True)
    b.add_argument("--db-options", default="{}")
    b.add_argument("--target-version", type=int, default=0)
    b.add_argument("--log-file")
    a = commands.add_parser("bench-all")
    a.add_argument("plan")
    a.add_argument("--changeset-dir", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--target-version", type=int, default=0)
    a.add_argument("--dry-run", action="store_true")
    s = commands.add_parser("summary")
    s.add_argument("path", nargs="?")
    s.add_argument("--runs", nargs="*")
    given = parser.parse_args(args)
    spark = session()
    if given.command == "gen-changesets":
        stores = generator.profile(given.profile, given.versions, given.scale)
        changesets.write_changes(generator.generate(spark, stores, given.seed), given.out, generator.params_rows(stores))
    elif given.command == "bench":
        target = given.target_version or changesets.read_manifest(spark, given.changeset_dir).head()["versions"]
        backend = TableBackend(spark, given.db_dir, strict_options(TableOptions, json.loads(given.db_options)))
        events: list = []
        replay(backend, changesets.read_changes(spark, given.changeset_dir, backend.version(), target), target, events)
        text = "".join(json.dumps(e) + "\n" for e in events)
        if given.log_file:
            with open(given.log_file, "a") as f:
                f.write(text)
        else:
            print(text, end="")
    elif given.command == "bench-all":
        target = given.target_version or changesets.read_manifest(spark, given.changeset_dir).head()["versions"]
        os.makedirs(given.out, exist_ok=True)
        print(json.dumps(run_all(spark, read_plan(given.plan), given.changeset_dir, target, {"table": TableBackend}, given.out, given.dry_run)))
    else:
        metrics.summary(read_logs(spark, given.path or results_dir()), given.runs).show(1000, False)


if __name__ == "__main__":
    main()
