"""Connected components of an edge table by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _pairs(a, b) -> list:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``edges(a, b)`` -> node, root: the least node that it is joined to. Nodes without edges are not there.

    A large step joins a node's greater neighbours to the least of its neighbours and itself, a small one the lesser
    neighbours and itself to the least of them, until each node has one edge and that is to its root. All is done in
    tables; each step is written, and the one before it is deleted.
    """
    now = written(edges.where("a <> b").select(*_pairs("a", "b")).distinct(), "edges")
    before = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").select(*_pairs("a", "b"))
        old, now = now, written(small.distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        discard(old)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("a").agg(F.min("b").alias("root"))
    out = roots.select(F.col("a").alias("node"), "root")
    return out.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
