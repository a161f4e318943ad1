"""Packages by what they hold: rows, a bitmap of members alone, or references to tables; one way to read each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Definition
from ..operators import aggregates
from . import package
from .package import Package, PackageError

#: The label of a bitmap's dataset.
MEMBERS = "_members"


@dataclass(frozen=True)
class Variant:
    name: str
    fits: Callable[[Package], bool]
    read: Callable[[SparkSession, Package], dict[str, DataFrame]]


def write_bitmap(spark: SparkSession, path: str, definition: Definition, rows: DataFrame, key: str) -> Package:
    """A package of nothing but the set of its keys, whole numbers; null is not in it."""
    return package.write_package(spark, path, definition, {MEMBERS: aggregates.key_bitmap(rows, key)})


def read_ids(spark: SparkSession, p: Package, key: str = "id") -> DataFrame:
    return aggregates.bitmap_keys(package.read_dataset(spark, p, MEMBERS), key)


VARIANTS: list[Variant] = [
    Variant("bitmap", lambda p: [d.label for d in p.datasets] == [MEMBERS], lambda s, p: {"members": read_ids(s, p)}),
    Variant("references", lambda p: bool(p.datasets) and all(d.format == "table" for d in p.datasets), package.read_all),
    Variant("rows", lambda p: True, package.read_all),
]


def variant(p: Package) -> Variant:
    return next(v for v in VARIANTS if v.fits(p))


def register(v: Variant) -> None:
    """A further variant; it is tried before those that are there."""
    if v.name in {x.name for x in VARIANTS}:
        raise PackageError(f"there is a variant {v.name!r}")
    VARIANTS.insert(0, v)


def read_any(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Datasets by label, or the ids of a bitmap as ``members``."""
    p = package.open_package(spark, path)
    return variant(p).read(spark, p)


def inspect_any(spark: SparkSession, path: str) -> DataFrame:
    """As ``package.inspect``, with the variant's name; no data are read."""
    name = variant(package.open_package(spark, path)).name
    return package.inspect(spark, path).withColumn("variant", F.lit(name))
