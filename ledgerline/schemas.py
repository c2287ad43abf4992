"""Explicit schemas: nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType, "int": T.IntegerType, "bigint": T.LongType, "double": T.DoubleType, "binary": T.BinaryType, "boolean": T.BooleanType}


def _struct(text: str) -> T.StructType:
    """A struct from ``name type, ...``; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(n, _TYPES[k]()) for n, k in (x.split() for x in text.split(", "))])


STORE_PARAMS = _struct(
    "store_key string, key_mean int, key_std_dev int, value_mean int, value_std_dev int, initial_size int, final_size int, versions bigint, change_per_version int, delete_fraction double"
)
MANIFEST = T.StructType([T.StructField("versions", T.LongType()), T.StructField("store_names", T.ArrayType(T.StringType())), T.StructField("store_params", T.ArrayType(STORE_PARAMS))])
CHANGES = _struct("version bigint, seq bigint, store_key string, key binary, value binary, is_delete boolean")

#: Memory fields of a log line, and the names that an older format gives them.
SIZE_FIELDS = ["alloc", "total_alloc", "sys", "gc_sys", "heap_sys", "heap_idle", "heap_inuse", "heap_released"]
COUNT_FIELDS = ["num_gc", "heap_objects", "gc_pause_total"]
LEGACY_FIELDS = {
    "alloc": "Alloc", "total_alloc": "TotalAlloc", "sys": "Sys", "num_gc": "NumGC", "gc_sys": "GCSys", "heap_sys": "HeapSys", "heap_idle": "HeapIdle",
    "heap_inuse": "HeapInuse", "heap_released": "HeapReleased", "heap_objects": "HeapObjects", "gc_pause_total": "PauseTotalNs", "gc_cpu_fraction": "GCCPUFraction",
}
MEMORY_FIELDS = list(LEGACY_FIELDS)

#: One superset of all log lines.  Leaves whose type differs by kind of line are text until the line is routed.
LOG_LINE = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("time", "level", "msg", "module", "version", "duration", "count", "ops_per_sec", "disk_usage", "size", "start_version", "target_version", "versions_applied", "error")),
    *(T.StructField(n, T.StringType()) for n in MEMORY_FIELDS),
    T.StructField("mem_stats", T.StructType([T.StructField(n, T.StringType()) for n in LEGACY_FIELDS.values()])),
    *(T.StructField(n, T.StringType()) for n in ("changeset_dir", "db_dir", "db_options", "tree_type")),
    T.StructField("changeset_info", MANIFEST),
    T.StructField("cpu_percents", T.ArrayType(T.DoubleType())),
    T.StructField("disk_io_counters", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))),
])
