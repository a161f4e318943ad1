"""Aggregations: column ranking, key bitmaps, sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import scratch

#: Keys of one bucket of a bitmap, as ``bitmap_bucket_number`` deals them.
BUCKET = 32_768


def cardinality_rank(df: DataFrame) -> DataFrame:
    """column, distinct values, rank; booleans and columns of nulls left out. One pass."""
    kinds = [c for c, t in df.dtypes if t != "boolean"]
    counts = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(c) for c in kinds])
    long = counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*[F.col(f"`{c}`") for c in kinds]))).alias("column_name", "distinct_values"))
    return long.where("distinct_values > 0").withColumn("rank", F.rank().over(Window.orderBy(F.desc("distinct_values"))))


def key_bitmap(df: DataFrame, key: str) -> DataFrame:
    """bucket, bitmap of a column of whole numbers: exact, null not in it, mergeable with ``bitmap_or_agg``."""
    k = F.col(key).cast("long")
    return df.where(k.isNotNull()).groupBy(F.bitmap_bucket_number(k).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("bitmap"))


def bitmap_size(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).cast("long").alias("cardinality"))


def bitmap_keys(bitmaps: DataFrame, key: str) -> DataFrame:
    """The whole numbers in bitmaps, one row each. A bucket above 0 starts at 1 and counts up, the others count down."""
    import pandas as pd

    def ids(batches):
        for b in batches:
            for bucket, bits in zip(b["bucket"], b["bitmap"], strict=True):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")).astype(np.int64)
                yield pd.DataFrame({key: (bucket - 1) * BUCKET + at + 1 if bucket > 0 else bucket * BUCKET - at})

    return bitmaps.select("bucket", "bitmap").mapInPandas(ids, f"`{key}` bigint")


def bitmap_union(bitmaps: list[DataFrame]) -> DataFrame:
    out = bitmaps[0]
    for b in bitmaps[1:]:
        out = out.unionByName(b)
    return out.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bitmap_intersection(bitmaps: list[DataFrame]) -> DataFrame:
    """Buckets that are in every bitmap, ANDed; none for no bitmap."""
    if not bitmaps:
        raise ValueError("no bitmaps")
    out = bitmaps[0]
    for b in bitmaps[1:]:
        out = out.unionByName(b)
    return out.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bitmap_and_agg("bitmap").alias("bitmap")).where(F.col("n") == len(bitmaps)).drop("n")


def stride_sample(df: DataFrame, order: list[Column], size: int, rows: int | None = None) -> DataFrame:
    """``size`` rows at even distances in ``order``: numbers ``i * (rows // size)``.

    Rows are numbered without meeting in one task: range partitions are counted, then numbered from their offsets.
    """
    total = df.count() if rows is None else rows
    step = max(1, total // max(1, size))
    placed = numbered(df, order)
    return placed.where((F.col("__n") % step == 0) & (F.col("__n") / step < size)).drop("__n")


def numbered(df: DataFrame, order: list[Column], name: str = "__n") -> DataFrame:
    """``df`` with row numbers from 0 in ``order``."""
    parts, path = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), scratch(df.sparkSession, "numbered")
    # Range partitions are drawn by sampling, so they are written once: counts and numbers must be of the same ones.
    df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()).write.parquet(path)
    dealt = df.sparkSession.read.parquet(path)
    before = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__c")).withColumn("__base", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return dealt.withColumn("__i", inside).join(F.broadcast(before), "__p").withColumn(name, F.col("__base") + F.col("__i")).drop("__p", "__i", "__base")
