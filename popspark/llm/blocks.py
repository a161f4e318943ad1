"""Comparing the members of groups that are too large for one task, in blocks.

A group's sets are cut into blocks by size band and hash, each small enough for one task. Sets that can be alike are in
one band or in two next to each other. First each block is compared within itself, together with some hubs of its own
and the neighbouring bands; that settles most members of a group of copies. Then the members that are left meet all
blocks of near bands. What moves is each set once, the hubs once for each block, and once more each set for every block
of members that are left.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def _many(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _near(band: str) -> Column:
    return F.explode(F.sequence(F.col(band) - 1, F.col(band) + 1))


def _hubs(members: DataFrame, least: bool, n: int) -> DataFrame:
    """Some members of each band: those of least hash, or the least one."""
    order = [F.struct(F.col("node"))] if least else [F.struct(F.xxhash64(F.lit(i), "node"), "node") for i in range(n)]
    picked = members.groupBy("group", "band").agg(*[F.min(x).alias(f"hub{i}") for i, x in enumerate(order)])
    names = F.array_distinct(F.array(*[F.col(f"hub{i}.node") for i in range(len(order))]))
    return picked.select("group", "band", F.explode(names).alias("node"))


def compared(
    sets: DataFrame,
    similarity: float,
    most_members: int,
    most_elements: int,
    found_in: Callable[[DataFrame], DataFrame],
    left_of: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]],
    hubs: int = 8,
    least_hubs: bool = False,
) -> DataFrame:
    """What ``found_in`` finds in rows (group, size, node, value, label), over all blocks of ``sets`` (node, group, size,
    value). ``left_of`` gets the members and what was found first, and gives the members that are left to be compared
    and all members, both with a label."""
    members = sets.withColumn("band", F.floor(F.ln("size") / max(-math.log(similarity), 1e-9)))
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / most_members, F.sum("size") / most_elements)).cast("long")
    bands = written(members.groupBy("group", "band").agg(parts.alias("parts")), "blocks-bands")
    placed = members.join(bands, ["group", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))

    def in_block(rows: DataFrame, key: list[str], label: Column) -> DataFrame:
        named = F.md5(F.concat_ws("/", F.hex("group"), *key[1:]))
        return rows.select(named.alias("group"), "size", "node", "value", label.alias("label"))

    none, block = F.lit(None).cast("binary"), ["group", "band", "part"]
    met = _hubs(members, least_hubs, hubs).join(members.select("group", "node", "size", "value"), ["group", "node"])
    met = met.withColumn("band", _near("band")).join(bands, ["group", "band"]).withColumn("part", _many(F.col("parts")))
    first = written(found_in(in_block(placed, block, none).unionByName(in_block(met, block, none))), "blocks-first")
    left, everyone = left_of(placed, first)
    left = left.drop("parts", "part")
    left_bands = written(left.groupBy("group", "band").agg(parts.alias("left_parts")), "blocks-left")
    if left_bands.isEmpty():
        return first
    left = left.join(left_bands, ["group", "band"])
    left = left.withColumn("left_part", F.pmod(F.xxhash64("node"), F.col("left_parts"))).withColumnRenamed("band", "left_band")
    pairs = left_bands.select("group", F.col("band").alias("left_band"), _many(F.col("left_parts")).alias("left_part"))
    blocks = bands.select("group", "band", _many(F.col("parts")).alias("part"))
    pairs = pairs.withColumn("band", _near("left_band")).join(blocks, ["group", "band"])
    key = ["group", "left_band", "left_part", "band", "part"]
    a = left.join(pairs, ["group", "left_band", "left_part"])
    b = everyone.join(pairs, block)
    label = F.col("label")
    return first.unionByName(found_in(in_block(a, key, label).unionByName(in_block(b, key, label))))
