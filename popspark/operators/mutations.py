"""Rows appended, deleted and replaced by key, as new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import drop_keys
from .sets import union


def append(base: DataFrame, rows: DataFrame) -> DataFrame:
    return union([base, rows])


def delete_rows(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return drop_keys(base, keys, key)


def upsert(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key comes anew go; all that come are added as they are, repeats and null keys too."""
    return union([drop_keys(base, rows.select(key), key), rows])


def upsert_counted(base: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """An upsert on several columns, and a row (updated, inserted) of counts of the rows that come."""
    known = base.select(*keys).distinct().withColumn("__there", F.lit(1))
    counts = rows.join(known, keys, "left").agg(F.count("__there").alias("updated"), (F.count(F.lit(1)) - F.count("__there")).alias("inserted"))
    kept = base.join(rows.select(*keys).distinct(), keys, "left_anti")
    return union([kept, rows]), counts


def increment(base: DataFrame, steps: list[tuple[DataFrame | None, DataFrame | None]], key: str) -> DataFrame:
    """Steps in order: keys to delete, then rows to add; a later deletion meets earlier additions.

    All at once: a row of step s goes if its key is deleted in a later step. One join, however many steps.
    """
    rows = [base.withColumn("__s", F.lit(-1))] + [add.withColumn("__s", F.lit(i)) for i, (_, add) in enumerate(steps) if add is not None]
    all_rows = union(rows)
    gone = [keys.select(F.col(keys.columns[0]).alias(key)).withColumn("__d", F.lit(i)) for i, (keys, _) in enumerate(steps) if keys is not None]
    if not gone:
        return all_rows.drop("__s")
    last = union(gone).groupBy(key).agg(F.max("__d").alias("__d"))
    return all_rows.join(last, key, "left").where(F.col("__d").isNull() | (F.col("__d") <= F.col("__s"))).select(*base.columns)
