"""Column expressions for log and changelog data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal size units and their powers of ten.
SIZE_UNITS = {"": 0, "B": 0, "KB": 3, "MB": 6, "GB": 9, "TB": 12, "PB": 15, "EB": 18}
SIZE_PATTERN = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_size(text: Column | str) -> Column:
    """Bytes of a humanized size such as ``1.2 GB`` or plain digits; null if the unit is unknown."""
    text = _col(text)
    amount = F.regexp_extract(text, SIZE_PATTERN, 1)
    unit = F.upper(F.regexp_extract(text, SIZE_PATTERN, 2))
    factor = F.lit(None).cast("decimal(19,0)")
    for name, power in SIZE_UNITS.items():
        factor = F.when(unit == name, F.lit(10**power).cast("decimal(19,0)")).otherwise(factor)
    return F.floor(amount.try_cast("decimal(19,6)") * factor).try_cast("bigint")


def nearest_tenth(value: Column) -> Column:
    """Tenths of a non-negative double, rounded by its exact value, an exact half to the even tenth.

    Formatting rounds the shortest decimal text of a double instead, which
    differs for 1.45 (in binary a little less).  The fraction is exact and is
    cut into two parts whose products with ten are exact.
    """
    whole = F.floor(value).cast("double")
    high = F.floor((value - whole) * float(1 << 26)) / float(1 << 26)
    low = (value - whole) - high
    under = F.floor(high * 10 + low * 10).cast("double")
    over = (high * 10 - under - 0.5) + low * 10
    up = (over > 0) | ((over == 0) & (F.pmod(under, F.lit(2.0)) == 1))
    return whole * 10 + under + F.when(up, 1.0).otherwise(0.0)


def humanize_bytes(size: Column | str) -> Column:
    """A size as text in decimal units: one decimal under ten units, else none; rounded by exact values, halves to even."""
    size = _col(size).cast("double")
    out = F.concat(F.format_string("%.0f", F.rint(size)), F.lit(" B"))
    for name, power in list(SIZE_UNITS.items())[2:]:
        shown = size / F.lit(float(10**power))
        label = "kB" if name == "KB" else name
        # The tenths are an integral double, so dividing by ten gives the double whose shortest text has one decimal.
        text = F.when(F.floor(shown * 10 + 0.5) < 100, F.format_string("%.1f", nearest_tenth(shown) / 10)).otherwise(F.format_string("%.0f", F.rint(shown)))
        out = F.when(size >= 10**power, F.concat(text, F.lit(f" {label}"))).otherwise(out)
    return out


def parse_iso(text: Column | str, strict: bool = True) -> Column:
    """Timestamp of an RFC 3339 text, zone-aware; ``strict`` raises on malformed text."""
    return _col(text).cast("timestamp") if strict else _col(text).try_cast("timestamp")


def ceil_bucket(value: Column | str, size: int) -> Column:
    """Upper edge of the bucket of ``size`` that a version falls in, as a double."""
    return (F.ceil(_col(value) / F.lit(size)) * F.lit(size)).cast("double")


def seconds(nanos: Column | str) -> Column:
    """Nanoseconds as seconds."""
    return _col(nanos) / F.lit(1e9)


def gigabytes(size: Column | str) -> Column:
    """Bytes as decimal gigabytes."""
    return _col(size) / F.lit(1e9)


def rate(count: Column | str, nanos: Column | str) -> Column:
    """Operations per second; null for no time."""
    return F.try_divide(_col(count).cast("double"), seconds(nanos))


def minutes_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed minutes between two timestamps."""
    return (F.unix_micros(_col(end)) - F.unix_micros(_col(start))) / F.lit(6e7)


def whole_minutes(micros: Column | str) -> Column:
    """Whole minutes of a duration in microseconds, rounded toward zero."""
    return (_col(micros) / F.lit(60_000_000)).cast("bigint")


def thousands(value: Column | str) -> Column:
    """An integer with grouped digits."""
    return F.format_number(_col(value), 0)


def version_filename(version: Column | str) -> Column:
    """Name of a version's changeset file."""
    return F.format_string("%09d.delimpb", _col(version).cast("bigint"))


def filename_version(name: Column | str) -> Column:
    """Version of a changeset file's name or path; null if it isn't one."""
    return F.regexp_extract(_col(name), r"(?:^|/)(\d{9,})\.delimpb$", 1).try_cast("bigint")


def json_field(text: Column | str, *path: str) -> Column:
    """Text of a field of a JSON text, by its path; null where any part of it is missing."""
    return F.get_json_object(_col(text), "$" + "".join(f"['{p}']" for p in path))


def run_name(path: Column | str) -> Column:
    """Run name of a log file: its base name without ``.jsonl``."""
    return F.regexp_replace(F.regexp_extract(_col(path), r"([^/]*)$", 1), r"\.jsonl$", "")
