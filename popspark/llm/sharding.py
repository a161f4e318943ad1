"""Sharding by a hierarchical weighted hash tree.

A tree names regions, racks and shards; a shard has a weight. Each shard draws for each document an exponential
variable with its weight as the rate, -ln(u) / weight, with u a hash of the document's key and the shard's path. A rack
draws the least of its shards' draws and a region the least of its racks' draws: the least of exponentials is an
exponential whose rate is the sum, so every level is a weighted hash draw with the subtree's weight. A document goes
down the tree to the region, the rack and the shard with the least draw. A draw depends on nothing but key, path and
weight: changed weights move documents only into or out of the subtrees that they belong to, and a new shard, wherever
it hangs, takes documents only into itself.

Only DataFrame functions run. Defined cases: a null key is a key like any other; rows with equal keys share a shard;
a null or empty text has size 1; an empty table gives an empty table; the caller's columns stay, and names that clash
with the added ones are refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

ADDED = ("region", "rack", "shard")
#: Rows in a group whose slots one task numbers.
GROUP_ROWS = 200_000


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, racks: int = 2, per_rack: int = 2) -> list[Shard]:
    """``shards`` shards of weight 1, filling racks and regions in order: tree n is the start of tree n + 1."""
    return [Shard(f"region{i // (racks * per_rack)}", f"rack{i // per_rack}", i) for i in range(shards)]


def _draw(key: Column, leaf: Shard) -> Column:
    bits = F.xxhash64(key, F.lit(f"{leaf.region}/{leaf.rack}/{leaf.shard}"))
    u = (F.shiftrightunsigned(bits, 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))
    return -F.ln(u) / F.lit(float(leaf.weight))


def _least(draws: list[Column]) -> Column:
    """The least of some structs; the draw is their innermost first field, so it decides."""
    return F.least(*draws) if len(draws) > 1 else draws[0]


def placed(docs: DataFrame, tree: list[Shard], key: str = "doc_id", names: tuple[str, str, str] = ADDED) -> DataFrame:
    """``docs`` with the region, rack and shard of each row under ``names``. No shuffle."""
    if not tree:
        raise ValueError("a tree needs a shard")
    if any(s.weight <= 0 for s in tree) or len({s.shard for s in tree}) < len(tree):
        raise ValueError("weights must be above 0 and shard numbers different")
    if clash := {n.lower() for n in (*names, "__least")} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} exist")
    own, regions = docs.columns, {}
    for s in tree:
        regions.setdefault(s.region, {}).setdefault(s.rack, []).append(F.struct(_draw(F.col(f"`{key}`"), s).alias("draw"), F.lit(s.shard).alias("shard")))
    of_racks = {region: [F.struct(_least(some).alias("least"), F.lit(rack).alias("rack")) for rack, some in racks.items()] for region, racks in regions.items()}
    least = _least([F.struct(_least(some).alias("least"), F.lit(region).alias("region")) for region, some in of_racks.items()])
    found = F.col("__least")
    at = (found["region"], found["least"]["rack"], found["least"]["least"]["shard"].cast("int"))
    return docs.select("*", least.alias("__least")).select(*[F.col(f"`{c}`") for c in own], *[x.alias(n) for x, n in zip(at, names, strict=True)])


def with_slots(rows: DataFrame, order: list[str], shard: str = "shard", slot: str = "slot", group_rows: int = GROUP_ROWS) -> DataFrame:
    """``rows`` (narrow: no texts) numbered from 0 without gaps in each shard.

    Equal rows are counted into one before the shuffle, so no key, however hot, meets in one task; the rest is dealt to
    groups by a hash of ``order``, numbered there, and moved by the number of rows in the shard's groups before.
    """
    own = rows.columns
    counted = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.groupBy().agg(F.count(F.lit(1)).alias("n"))  # one row; groups follow the table's size
    counted = counted.crossJoin(F.broadcast(total.select(F.greatest(F.lit(1), F.ceil(F.col("n") / group_rows)).cast("long").alias("__of"))))
    counted = counted.withColumn("__group", F.pmod(F.xxhash64(F.lit("slots"), *order), F.col("__of"))).drop("__of")
    before = Window.partitionBy(shard).orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    groups = counted.groupBy(shard, "__group").agg(F.sum("__n").alias("__size")).withColumn("__base", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    inside = Window.partitionBy(shard, "__group").orderBy(*own).rowsBetween(Window.unboundedPreceding, -1)
    based = counted.withColumn("__first", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(groups, [shard, "__group"])
    first = F.col("__base") + F.col("__first")
    return based.select(*own, F.explode(F.sequence(first, first + F.col("__n") - 1)).alias(slot))


def write_shards(docs: DataFrame, tree: list[Shard], path: str, key: str = "doc_id") -> None:
    """The documents themselves, one folder of Parquet files for each shard."""
    placed(docs, tree, key).write.partitionBy("shard").parquet(path)


def op4_hash_tree_shards(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    now = placed(docs, even_tree(shards))
    then = placed(now, even_tree(shards + 1), names=("__region", "__rack", "grown_shard"))
    out = with_slots(then.select("doc_id", "size", "text_crc32", "region", "rack", "shard", "grown_shard"), ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")
