"""Small files on any file system that Spark can reach, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder where none is set and the session is local, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: driver and executors need a shared folder")
        found = _OWN.setdefault("dir", "") or f"file://{tempfile.mkdtemp(prefix='ledgerline-')}"
        _OWN["dir"] = found
    return found.rstrip("/")


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A name in the shared folder, not made yet; what is written there is deleted when this process ends."""
    folder = f"{shared_dir(spark)}/ledgerline-{what}-{uuid.uuid4().hex}"
    _MADE.append((spark, folder))
    return folder


@atexit.register
def clear() -> None:
    """Delete all scratch folders of this process."""
    while _MADE:
        spark, folder = _MADE.pop()
        try:
            delete(folder, spark)
        except Exception:  # noqa: BLE001 - the session may have ended; the files are scratch
            continue


def _open(path: str, spark: SparkSession | None = None):
    """(file system, path) of the Hadoop API."""
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(path: str, spark: SparkSession | None = None) -> bool:
    """Whether there is a file or folder."""
    fs, where = _open(path, spark)
    return bool(fs.exists(where))


def names(path: str, spark: SparkSession | None = None) -> list[str]:
    """Names in a folder."""
    fs, where = _open(path, spark)
    return sorted(s.getPath().getName() for s in fs.listStatus(where))


def make_folder(path: str, spark: SparkSession | None = None) -> None:
    """Make a folder and those above it."""
    fs, where = _open(path, spark)
    fs.mkdirs(where)


def delete(path: str, spark: SparkSession | None = None) -> None:
    """Delete a file or a folder with all in it."""
    fs, where = _open(path, spark)
    fs.delete(where, True)


def move(path: str, to: str, spark: SparkSession | None = None) -> None:
    """Rename a file."""
    fs, where = _open(path, spark)
    if not fs.rename(where, _open(to, spark)[1]):
        raise OSError(f"{path} can't be moved to {to}")


def read_text(path: str, spark: SparkSession | None = None) -> str:
    """A small file as text; raises FileNotFoundError if there is none."""
    fs, where = _open(path, spark)
    if not fs.exists(where):
        raise FileNotFoundError(path)
    size = fs.getFileStatus(where).getLen()
    stream = fs.open(where)
    try:
        return bytes(stream.readNBytes(size)).decode()
    finally:
        stream.close()


def write_text(path: str, text: str, spark: SparkSession | None = None) -> None:
    """Replace a small file: what is read is the old text or the new one."""
    fs, where = _open(path, spark)
    new = _open(f"{path}.new", spark)[1]
    stream = fs.create(new, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(new, where):  # some file systems don't replace a file
        fs.delete(where, False)
        if not fs.rename(new, where):
            raise OSError(f"{path} can't be replaced")
