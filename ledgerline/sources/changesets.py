"""Changesets: one file of length-delimited entries per version, and their manifest.

``register(spark)`` adds the format ``changeset`` for folders that every
machine mounts; its reader plans tasks of neighbouring version files, an even
share of the bytes each (option ``tasks``, 128 MB at most unless one file is
larger), within the bounds given as options ``after`` and ``target`` and by
pushed filters on the version, so other versions aren't opened, and streams
each file.  Folders of
other file systems are read by Spark itself, a whole file at a time (2 GB at
most), again only those within the bounds.  Entry fields are numbered by the
option ``fields`` (store, delete, key, value).
"""

from __future__ import annotations

import io
import itertools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..schemas import CHANGES, MANIFEST
from . import files

FIELDS = "1,2,3,4"
MANIFEST_NAME = "changeset_info.json"
MARKER_NAME = "info.json"


def put_varint(n: int) -> bytes:
    """An unsigned integer in base 128, low groups first."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    """The integer at a place, and the place behind it; raises IndexError where the bytes end inside."""
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        if b < 128:
            return n | b << shift, at
        n |= (b & 127) << shift
        shift += 7


def encode(store_key: str, key: bytes, value: bytes | None, is_delete: bool, fields: tuple[int, ...] = (1, 2, 3, 4)) -> bytes:
    """One entry with its length before it; empty fields are left out."""
    store, delete, k, v = fields
    parts = []
    for number, data in sorted(((store, store_key.encode()), (k, bytes(key)), (v, bytes(value or b"")), (delete, is_delete)), key=lambda x: x[0]):
        if data is True:
            parts.append(put_varint(number << 3) + b"\x01")
        elif data:
            parts.append(put_varint(number << 3 | 2) + put_varint(len(data)) + data)
    body = b"".join(parts)
    return put_varint(len(body)) + body


def decode(read, fields: tuple[int, ...] = (1, 2, 3, 4), piece: int = 1 << 20) -> Iterator[tuple[str, bytes, bytes | None, bool]]:
    """Entries of a byte reader, ``piece`` bytes read at a time; unknown fields are skipped, a cut-off entry raises."""
    store_n, delete_n, key_n, value_n = fields
    held, at = read(piece), 0
    while at < len(held):
        try:
            size, begin = get_varint(held, at)
        except IndexError:
            size, begin = 0, len(held) + 1
        if begin + size > len(held):
            more = read(max(piece, begin + size - len(held)))
            if not more:
                raise ValueError("the file ends inside an entry" if begin <= len(held) else "the file ends inside a number")
            held, at = held[at:] + more, 0
            continue
        body = held[begin : begin + size]
        at = begin + size
        if at == len(held):
            held, at = read(piece), 0
        place, found = 0, {store_n: b"", delete_n: 0, key_n: b"", value_n: b""}
        while place < size:
            tag, place = get_varint(body, place)
            kind = tag & 7
            if kind == 2:
                n, place = get_varint(body, place)
                value = body[place : place + n]
                place += n
            elif kind == 0:
                value, place = get_varint(body, place)
            elif kind in (1, 5):
                value = None
                place += 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind} isn't known")
            if place > size:
                raise ValueError("a field ends behind its entry")
            if tag >> 3 in found:
                found[tag >> 3] = value
        gone = bool(found[delete_n])
        yield found[store_n].decode(), found[key_n], None if gone else found[value_n], gone


def decoded_batches(read, version: int, fields: tuple[int, ...], rows: int = 10_000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """One version's entries as Arrow batches of at most ``rows`` rows and about ``size`` bytes."""
    held, seq, weight = [], 0, 0

    def batch() -> pa.RecordBatch:
        first = seq - len(held)
        store, key, value, gone = zip(*held, strict=True)
        columns = [pa.array([version] * len(held), pa.int64()), pa.array(range(first, seq), pa.int64()), pa.array(store, pa.string()), pa.array(key, pa.binary()), pa.array(value, pa.binary()), pa.array(gone, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=CHANGES.names)

    for entry in decode(read, fields):
        held.append(entry)
        seq += 1
        weight += len(entry[1]) + len(entry[2] or b"")
        if len(held) == rows or weight > size:
            yield batch()
            held, weight = [], 0
    if held:
        yield batch()


def file_name(version: int) -> str:
    """Name of a version's file."""
    return f"{version:09d}.delimpb"


@dataclass
class VersionFiles(InputPartition):
    """(version, path) of the files that one task reads, in order of version."""

    files: list[tuple[int, str]]


def share_out(sizes: list[int], tasks: int, most: int = 128 << 20, opening: int = 1 << 18) -> list[int]:
    """First file of each task: runs of whole files of about an even share of the bytes, ``most`` at the most if files are smaller; ``opening`` is a file's cost."""
    share = min(most, max(opening * 4, sum(x + opening for x in sizes) // max(tasks, 1)))
    begins, weight = [], 0
    for k, x in enumerate(sizes):
        if not begins or weight + x + opening > share:
            begins.append(k)
            weight = 0
        weight += x + opening
    return begins


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.after, self.target = int(options.get("after", 0)), int(options.get("target", 0))
        self.fields = tuple(map(int, options.get("fields", FIELDS).split(",")))
        self.tasks = int(options.get("tasks", 8))
        self.only: set[int] | None = None

    def pushFilters(self, filters):
        """Bounds on the version choose the files; Spark applies every other filter."""
        for f in filters:
            if getattr(f, "attribute", None) != ("version",):
                yield f
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.after = max(self.after, f.value - isinstance(f, GreaterThanOrEqual))
            elif isinstance(f, LessThan | LessThanOrEqual):
                least = f.value - isinstance(f, LessThan)
                self.only = set() if least < 1 else self.only
                self.target = least if self.target <= 0 else min(self.target, least)
            elif isinstance(f, EqualTo | In):
                these = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = these if self.only is None else self.only & these
            else:
                yield f

    def partitions(self):
        found = []
        with os.scandir(self.path) as entries:
            for entry in entries:
                if m := re.fullmatch(r"(\d{9,})\.delimpb", entry.name):
                    v = int(m[1])
                    if v > self.after and (self.target <= 0 or v <= self.target) and (self.only is None or v in self.only):
                        found.append((v, entry.path, entry.stat().st_size))
        found.sort()
        begins = share_out([size for _, _, size in found], self.tasks)
        return [VersionFiles([(v, path) for v, path, _ in found[a:b]]) for a, b in itertools.pairwise([*begins, len(found)])] or [VersionFiles([])]

    def read(self, partition):
        for version, path in partition.files:
            with open(path, "rb", buffering=0) as f:
                yield from decoded_batches(f.read, version, self.fields)


@dataclass
class _Wrote(WriterCommitMessage):
    files: list


class _Writer(DataSourceArrowWriter):
    """Writes one file per version; the rows of a version must come in one partition, in order of seq."""

    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.fields = tuple(map(int, options.get("fields", FIELDS).split(",")))
        self.stores = json.loads(options.get("stores", "null"))

    def write(self, batches):
        from pyspark import TaskContext

        task = TaskContext.get().taskAttemptId()
        os.makedirs(self.path, exist_ok=True)
        files, out, now = [], None, None
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("version", "store_key", "key", "value", "is_delete")]
            for version, store, key, value, gone in zip(*columns, strict=True):
                if version != now:
                    if out:
                        out.close()
                    now = version
                    files.append((os.path.join(self.path, f".{task}.{file_name(now)}"), os.path.join(self.path, file_name(now))))
                    out = open(files[-1][0], "wb")  # noqa: SIM115
                out.write(encode(store, key, value, gone, self.fields))
        if out:
            out.close()
        return _Wrote(files)

    def commit(self, messages):
        for a, b in sorted((pair for m in messages if m for pair in m.files), key=lambda pair: pair[1]):
            os.replace(a, b)
            if self.stores is not None:  # after each version, so that what is there can be read at any time
                write_manifest(self.path, int(os.path.basename(b).split(".")[0]), self.stores)

    def abort(self, messages):
        for m in messages:
            for a, _ in m.files if m else []:
                if os.path.exists(a):
                    os.remove(a)


class ChangesetSource(DataSource):
    """The format ``changeset``."""

    @classmethod
    def name(cls):
        return "changeset"

    def schema(self):
        return CHANGES

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed to it."""
    spark.dataSource.register(ChangesetSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def is_mounted(path: str) -> bool:
    """Whether a path has no scheme other than that of local or mounted folders."""
    return path.startswith("file:") or "://" not in path


def read_remote(spark: SparkSession, path: str, after: int = 0, target: int = 0, fields: str = FIELDS) -> DataFrame:
    """As ``read_changes``, by Spark's own readers, from any file system."""
    known = [(int(m[1]), n) for n in files.names(path, spark) if (m := re.fullmatch(r"(\d{9,})\.delimpb", n))]
    chosen = [f"{path}/{n}" for v, n in sorted(known) if v > after and (target <= 0 or v <= target)]
    if not chosen:
        return spark.createDataFrame([], CHANGES)
    numbers = tuple(map(int, fields.split(",")))

    def each(batches):
        for batch in batches:
            for where, content in zip(batch.column(0), batch.column(1), strict=True):
                version = int(os.path.basename(where.as_py()).split(".")[0])
                yield from decoded_batches(io.BytesIO(content.as_py()).read, version, numbers)

    return spark.read.format("binaryFile").load(chosen).select("path", "content").mapInArrow(each, CHANGES)


def read_changes(spark: SparkSession, path: str, after: int = 0, target: int = 0) -> DataFrame:
    """Changes of the versions over ``after`` up to ``target`` (to the end, if not positive)."""
    if not is_mounted(path):
        return read_remote(spark, path, after, target)
    register(spark)
    return spark.read.format("changeset").option("after", after).option("target", target).option("tasks", 2 * spark.sparkContext.defaultParallelism).load(path)


def write_changes(changes: DataFrame, path: str, stores: list[dict] | None = None) -> None:
    """One file per version into a mounted folder that must not exist yet; with ``stores`` also the manifest, anew for each version."""
    if not is_mounted(path):
        raise ValueError(f"{path} isn't a mounted folder; use write_parquet")
    if os.path.exists(path.removeprefix("file://")):
        raise FileExistsError(path)
    register(changes.sparkSession)
    dealt = changes.select(CHANGES.names).repartition("version").sortWithinPartitions("version", "seq")
    dealt.write.format("changeset").option("stores", json.dumps(stores)).mode("append").save(path)


def write_parquet(changes: DataFrame, path: str) -> None:
    """The native form: Parquet in one folder per version; the target must not exist yet."""
    changes.select(CHANGES.names).repartition("version").sortWithinPartitions("seq").write.mode("errorifexists").partitionBy("version").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The one-row manifest of a changeset folder."""
    return spark.read.schema(MANIFEST).json(os.path.join(path, MANIFEST_NAME), multiLine=True)


def manifest_stores(manifest: DataFrame) -> DataFrame:
    """One row per store of a manifest."""
    return manifest.select(F.inline("store_params"))


def write_manifest(path: str, versions: int, stores: list[dict]) -> None:
    """Write the manifest of a mounted folder anew."""
    whole = os.path.join(path.removeprefix("file://"), MANIFEST_NAME)
    with open(f"{whole}.new", "w") as f:
        json.dump({"versions": versions, "store_names": [s["store_key"] for s in stores], "store_params": stores}, f)
    os.replace(f"{whole}.new", whole)


def load_version(path: str) -> int:
    """Version in a folder's marker; 0 if there is none."""
    try:
        return int(json.loads(files.read_text(f"{path}/{MARKER_NAME}"))["version"])
    except FileNotFoundError:
        return 0


def save_version(path: str, version: int) -> None:
    """Replace a folder's marker in one step."""
    files.write_text(f"{path}/{MARKER_NAME}", json.dumps({"version": version}))
