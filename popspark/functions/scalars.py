"""Scalar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def codes(c: Column, separator: str = "|") -> Column:
    """The parts of a delimited string, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, f"\\Q{separator}\\E"), lambda x: F.trim(x)), lambda x: x != "")


def table_name(c: Column) -> Column:
    """Lower case, everything but ASCII letters, digits and ``_`` replaced by ``_``."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9_]", "_")


def preview(c: Column, size: int = 60) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def date_prefix(c: Column, size: int = 10) -> Column:
    """The day (10) or the year (4) of an ISO date string."""
    return F.substring(c, 1, size)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def has_bits(c: Column, bits: int) -> Column:
    """Whether a bit set shares a bit with ``bits``; null is the empty set."""
    return F.coalesce(c, F.lit(0)).bitwiseAND(F.lit(bits)) != 0


def bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position.cast("int"))


def hash_bucket(c: Column, buckets: int) -> Column:
    """A bucket from the first 32 bits of SHA-256: the same in every engine."""
    return F.pmod(F.conv(F.substring(F.sha2(c.cast("string"), 256), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def json_safe(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
