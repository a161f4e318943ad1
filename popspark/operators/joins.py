"""Joins that SQL has no one-word form for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in ``order``. A running minimum, so no key's rows are gathered."""
    own = [F.col(f"`{c}`") for c in df.columns]
    marked = df.select(*[F.col(k) for k in keys], F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("__n"), F.struct(*own).alias("__row"))
    return marked.where("__n = 1").select("__row.*")


def lookup_first(hits: DataFrame, table: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``hits`` with the first row of ``table`` of each key, if there is one."""
    return hits.join(first_per_key(table.join(hits.select(key).distinct(), key, "left_semi"), [key], order), key, "left")


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` at or before its time.

    Both sides are laid over each other and read in order of time, one shuffle by ``by``; no pair is ever made.
    """
    own = left.columns
    a = left.select(*[F.col(k).alias(f"__b{i}") for i, k in enumerate(by)], F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*own).alias("__left"), F.lit(None).cast(right.select(F.struct(right_time, *values)).schema[0].dataType).alias("__right"))
    b = right.select(*[F.col(k).alias(f"__b{i}") for i, k in enumerate(by)], F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*own)).schema[0].dataType).alias("__left"), F.struct(right_time, *values).alias("__right"))
    w = Window.partitionBy(*[f"__b{i}" for i in range(len(by))]).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__last", F.last("__right", ignorenulls=True).over(w)).where("__side = 1")
    return both.select("__left.*", *[F.col(f"__last.{v}").alias(v) for v in values])


def interval_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points in [low, high]. Ranges are laid over buckets of ``width``, so the join is on equal bucket numbers."""
    a = points.withColumn("__bucket", F.floor(F.col(point) / width).cast("long"))
    b = ranges.where(F.col(low) <= F.col(high)).withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))))
    return a.join(b, "__bucket").where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("__bucket")
