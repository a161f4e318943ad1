"""Set algebra on datasets and on key sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import keep_keys, key_set


def union(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts. Columns must be the same by name and type."""
    if not parts:
        raise ValueError("No input files")
    first = {f.name: f.dataType for f in parts[0].schema}
    for p in parts[1:]:
        if {f.name: f.dataType for f in p.schema} != first:
            raise ValueError(f"Schema mismatch: {parts[0].schema.simpleString()} and {p.schema.simpleString()}")
    return reduce(DataFrame.unionByName, parts)


def widened_union(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts by name; missing columns are null, whole numbers take the wider type."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def shared_keys(parts: list[DataFrame], key: str) -> DataFrame:
    """Keys that are in every part. One shuffle: each part's distinct keys are counted."""
    tagged = reduce(DataFrame.unionByName, [p.select(key).where(F.col(key).isNotNull()).withColumn("__i", F.lit(i)) for i, p in enumerate(parts)])
    return tagged.distinct().groupBy(key).agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") == len(parts)).select(key)


def intersect(parts: list[DataFrame], key: str) -> DataFrame:
    """Every part's rows whose key is in all parts; a shared key brings the rows of each part."""
    if len(parts) < 2:
        raise ValueError("intersect needs at least 2 inputs")
    keys = shared_keys(parts, key)
    return union([keep_keys(p, keys, key) for p in parts])


def members(parts: list[DataFrame], key: str, operation: str) -> DataFrame:
    """The keys of a union, an intersection, a difference (of two) or one part."""
    if operation == "difference" and len(parts) != 2:
        raise ValueError("difference takes 2 inputs")
    if operation == "single" and len(parts) != 1:
        raise ValueError("single takes 1 input")
    if operation in ("union", "single"):
        return key_set(reduce(DataFrame.unionByName, [p.select(key) for p in parts]), key)
    if operation == "intersection":
        return shared_keys(parts, key)
    if operation == "difference":
        return key_set(parts[0], key).join(key_set(parts[1], key), key, "left_anti")
    raise ValueError(f"unknown operation {operation!r}")


def _masks(parts: list[DataFrame], key: str) -> DataFrame:
    """Each key, null among them, with the bit set of the parts that have it."""
    tagged = reduce(DataFrame.unionByName, [p.select(key).withColumn("__bit", F.lit(1 << i).cast("long")) for i, p in enumerate(parts)])
    return tagged.groupBy(key).agg(F.bit_or("__bit").alias("mask"))


def overlap_regions(parts: list[DataFrame], key: str) -> DataFrame:
    """mask, intersection_size, exclusive_size for each of the 2**n - 1 regions. Null counts as a key.

    Keys are shuffled once. The sums over supersets take n steps over at most 2**n counts: step i adds each region that
    has part i to the one that lacks it.
    """
    sizes = _masks(parts, key).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
    regions = parts[0].sparkSession.range(1, 1 << len(parts)).select(F.col("id").alias("mask"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("own"))
    sums = regions.unionByName(sizes.select("mask", "n", F.col("n").alias("own")))
    sums = sums.groupBy("mask").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
    for i in range(len(parts)):
        bit = F.lit(1 << i).cast("long")
        itself = F.struct("mask", "own")
        lacking = F.struct(F.col("mask").bitwiseXOR(bit).alias("mask"), F.lit(0).cast("long").alias("own"))
        both = F.when(F.col("mask").bitwiseAND(bit) != 0, F.array(itself, lacking)).otherwise(F.array(itself))
        sums = sums.select("n", F.inline(both)).groupBy("mask").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
    return sums.where("mask > 0").select("mask", F.col("n").alias("intersection_size"), F.col("own").alias("exclusive_size"))


def overlap_matrix(parts: list[DataFrame], key: str) -> DataFrame:
    """i, j, shared for each pair of parts, i = j the part's own size."""
    sizes = _masks(parts, key).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
    index = parts[0].sparkSession.range(len(parts))
    pairs = index.select(F.col("id").alias("i")).crossJoin(index.select(F.col("id").alias("j"))).withColumn("pair", F.expr("shiftleft(1L, cast(i as int)) | shiftleft(1L, cast(j as int))"))
    met = pairs.join(F.broadcast(sizes), F.col("mask").bitwiseAND(F.col("pair")) == F.col("pair"), "left")
    return met.groupBy("i", "j").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("shared"))


def overlap_stats(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts, Jaccard similarity and overlap coefficient of two key sets; 0 where nothing divides."""
    m = _masks([left.where(F.col(key).isNotNull()), right.where(F.col(key).isNotNull())], key)
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    mask = F.col("mask")
    counts = m.agg(n(mask.bitwiseAND(1) != 0).alias("left_keys"), n(mask.bitwiseAND(2) != 0).alias("right_keys"), n(mask == 3).alias("shared"), n(mask == 1).alias("left_only"), n(mask == 2).alias("right_only"))
    every, least = F.col("shared") + F.col("left_only") + F.col("right_only"), F.least("left_keys", "right_keys")
    return counts.select("*", F.when(every > 0, F.col("shared") / every).otherwise(0.0).alias("jaccard_similarity"), F.when(least > 0, F.col("shared") / least).otherwise(0.0).alias("overlap_coefficient"))
