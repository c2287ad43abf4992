"""Run plans: JSON with comments, strict options, and the loop over runs."""

from __future__ import annotations

import dataclasses
import json
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.state import last_changes
from ..sources import files
from ..sources.changesets import load_version, read_changes, save_version

log = logging.getLogger(__name__)


def strip_comments(text: str) -> str:
    """JSON text without // and /* */ comments and without commas before a closing bracket; strings are left alone."""
    out, at, n = [], 0, len(text)
    while at < n:
        c = text[at]
        if c == '"':
            end = at + 1
            while end < n and text[end] != '"':
                end += 2 if text[end] == "\\" else 1
            out.append(text[at : end + 1])
            at = end + 1
        elif text.startswith("//", at):
            at = text.find("\n", at) if "\n" in text[at:] else n
        elif text.startswith("/*", at):
            end = text.find("*/", at + 2)
            at = n if end < 0 else end + 2
        else:
            if c in "]}":
                k = len(out) - 1
                while k >= 0 and not out[k].strip():
                    k -= 1
                if k >= 0 and out[k] == ",":
                    out[k] = ""
            out.append(c)
            at += 1
    return "".join(out)


@dataclass
class Run:
    """One run of a plan."""

    name: str
    runner: str
    options: dict = field(default_factory=dict)


def read_plan(path: str) -> list[Run]:
    """Runs of a plan file."""
    plan = json.loads(strip_comments(files.read_text(path)))
    return [Run(r["name"], r["runner"], r.get("options") or {}) for r in plan["runs"]]


def strict_options(kind: type | None, given: dict) -> Any:
    """Options as ``kind``, a dataclass; an unknown one, or any if there is no kind, raises."""
    known = {f.name for f in dataclasses.fields(kind)} if kind else set()
    if extra := sorted(set(given) - known):
        raise ValueError(f"unknown options: {', '.join(extra)}")
    return kind(**given) if kind else None


class StateBackend(Protocol):
    """A store that changes are replayed into, version by version; ``applied`` is the number of changes of the last commit."""

    applied: int

    def version(self) -> int: ...

    def apply(self, changes: DataFrame) -> None: ...

    def commit(self) -> int: ...

    def close(self) -> None: ...


@dataclass
class TableOptions:
    """Options of the table backend: commits between two whole states (0: the default of 16)."""

    checkpoint_interval: int = 0


class TableBackend:
    """State as Parquet: a whole state at every ``checkpoint_interval``-th commit and the last changes of each commit since.

    A commit writes its own changes, read once, and then the marker; the
    merged state is written only at the interval, after which the files that
    it replaces are deleted.  So disk holds one state and an interval's
    changes, and a commit cut off by a failure leaves the one before it.
    Deletes are kept, so late changes merge rightly.
    """

    options = TableOptions

    def __init__(self, spark: SparkSession, path: str, options: TableOptions | None = None):
        self.spark, self.path, self.opts = spark, path.rstrip("/"), options or TableOptions()
        self.interval = self.opts.checkpoint_interval or 16
        files.make_folder(self.path, spark)
        self.at = load_version(self.path)
        self.waiting: DataFrame | None = None
        self.applied = 0

    def version(self) -> int:
        """Last committed version."""
        return self.at

    def _kept(self) -> tuple[str | None, list[str]]:
        """(folder of the last whole state, folders of later changes) up to the committed version."""
        found = {kind: sorted(int(n[1:]) for n in files.names(self.path, self.spark) if n[0] == kind and n[1:].isdigit() and int(n[1:]) <= self.at) for kind in "sc"}
        base = max(found["s"], default=0)
        return f"{self.path}/s{base}" if base else None, [f"{self.path}/c{v}" for v in found["c"] if v > base]

    def state(self) -> DataFrame | None:
        """Last change of every key at the committed version; None before the first commit."""
        base, later = self._kept()
        if base is None and not later:
            return None
        parts = [p for p in (base, *later) if p]
        found = self.spark.read.parquet(*parts)
        return last_changes(found) if len(parts) > 1 else found

    def apply(self, changes: DataFrame) -> None:
        """Take the changes of later versions; nothing is written before commit."""
        self.waiting = changes if self.waiting is None else self.waiting.unionByName(changes)

    def commit(self) -> int:
        """Write the changes and then the marker; the version is the largest applied."""
        self.applied = 0
        if self.waiting is None:
            return self.at
        seen = Observation()
        watched = self.waiting.observe(seen, F.max("version").alias("top"), F.count(F.lit(1)).alias("n"))
        new = f"{self.path}/new"
        last_changes(watched).write.mode("overwrite").parquet(new)
        top, self.applied = seen.get["top"], seen.get["n"]
        self.waiting = None
        if top is None:
            files.delete(new, self.spark)
            return self.at
        files.delete(f"{self.path}/c{top}", self.spark)  # what a commit cut off before its marker left
        files.move(new, f"{self.path}/c{top}", self.spark)
        save_version(self.path, top)
        self.at = top
        base, later = self._kept()
        if len(later) >= self.interval:
            self.state().write.mode("overwrite").parquet(new)
            files.move(new, f"{self.path}/s{top}", self.spark)
            for old in (base, *later):
                if old:
                    files.delete(old, self.spark)
        return self.at

    def close(self) -> None:
        """Nothing is held open."""


def replay(backend: StateBackend, changes: DataFrame, target: int, events: list | None = None, step: int = 1) -> int:
    """Apply the versions after the backend's own up to ``target``, ``step`` at a time, and commit each time.

    Filters on the version reach the source, so a commit reads its own
    versions' files, once.  A committed version other than the one expected
    raises.  Each commit adds a log event with its version, duration (ns),
    count and rate.
    """
    at = backend.version()
    while at < target:
        upto = min(target, at + step)
        began = time.perf_counter_ns()
        backend.apply(changes.filter((F.col("version") > at) & (F.col("version") <= upto)))
        got = backend.commit()
        if got != upto:
            raise RuntimeError(f"expected version {upto}, the store is at {got}")
        spent, count = time.perf_counter_ns() - began, backend.applied
        if events is not None:
            events.append({"msg": "committed version", "version": upto, "duration": spent, "count": count, "ops_per_sec": count / (spent / 1e9)})
        at = upto
    return at


def run_all(spark: SparkSession, runs: list[Run], changeset_dir: str, target: int, make: dict[str, Callable], folder: str, dry: bool = False) -> dict[str, str]:
    """Run a plan's runs one after the other; a failing run is logged and the next one goes on.  Returns each run's outcome."""
    outcome = {}
    for run in runs:
        if dry:
            log.info("would run %s with %s", run.name, run.runner)
            outcome[run.name] = "dry"
            continue
        try:
            kind = make[run.runner]
            backend = kind(spark, f"{folder}/{run.name}", strict_options(getattr(kind, "options", None), run.options))
            try:
                replay(backend, read_changes(spark, changeset_dir, backend.version(), target), target)
            finally:
                backend.close()
            outcome[run.name] = "complete"
        except Exception as e:  # noqa: BLE001 - one run must not end the plan
            log.exception("run %s failed", run.name)
            outcome[run.name] = f"failed: {e}"
    return outcome
