"""Scalar expressions."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import expr as E


@pytest.mark.parametrize(("text", "size"), [("0 B", 0), ("7 B", 7), ("1.2 GB", 1200000000), ("83 MB", 83000000), ("1.0 kB", 1000), ("12", 12), ("1 KiB", None), ("junk", None), (None, None)])
def test_parse_size(spark, text, size):
    assert spark.range(1).select(E.parse_size(F.lit(text).cast("string"))).head()[0] == size


def test_scalars(spark):
    r = spark.range(1).select(
        E.ceil_bucket(F.lit(101), 100), E.rate(F.lit(100), F.lit(2_000_000_000)), E.rate(F.lit(1), F.lit(0)), E.whole_minutes(F.lit(395_000_000)), E.thousands(F.lit(1234567)), E.version_filename(F.lit(12)),
        E.filename_version(F.lit("/a/000000012.delimpb")), E.filename_version(F.lit("x.txt")), E.run_name(F.lit("/p/alpha.jsonl")), F.unix_micros(E.parse_iso(F.lit("2025-01-01T00:00:00.123456789+01:00"))),
        E.humanize_bytes(F.lit(1_234_567)), E.gigabytes(F.lit(5_000_000_000)),
    ).head()
    assert list(r) == [200.0, 50.0, None, 6, "1,234,567", "000000012.delimpb", 12, None, "alpha", 1735686000123456, "1.2 MB", 5.0]


def test_sizes_round_by_exact_value(spark):
    sizes = [0, 999, 1000, 1049, 1050, 1250, 1450, 1650, 1750, 2250, 9949, 9950, 9951, 10500, 11500, 12500, 999499, 1450000, 2_500_000_000]
    shown = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in sizes], "n bigint").select("n", E.humanize_bytes("n")).collect()}
    for n in sizes:
        power, unit = next((p, u) for p, u in ((9, "GB"), (6, "MB"), (3, "kB"), (0, "B")) if n >= 10**p or not p)
        x = n / 10**power
        assert shown[n] == (f"{x:.1f} {unit}" if power and math.floor(x * 10 + 0.5) < 100 else f"{x:.0f} {unit}"), n
