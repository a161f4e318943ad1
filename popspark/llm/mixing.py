"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies that each of its documents would get. The whole part is
given at once; the fractional part is a probability of one more copy. Documents with fractional probabilities meet,
the largest one first: mass, counted in words, moves between it and its partner until one of them is 0 or 1. A move up
by x is drawn with the probability y / (x + y), where y is the move down, and each meeting draws anew. So the expected
copies of every document stay target / size exactly, and the words that a source gives stay at its target until one
document is left, which is rounded by its own probability.

A partner is the next document, or, where they have room for both moves, several next ones together, each with a part
of the move in proportion to its room. Then it is always the larger document that becomes integral, and what is left
at a source's end is small. Groups of documents (dealt by hash) round in parallel and hand on their last document;
these residuals meet in groups of the next level of a tree, until each source has one.

Draws come from a hash of seed, source, level and group over sorted rows: reruns agree. Defined cases: a document
without words takes none; rows that are equal in all columns are counted into one before any shuffle and share copies
evenly; a null source is a source like others, last in order; a very long text is one document of that size; ties are
broken by the row's hash; a table without words takes nothing; extra columns pass, and names that clash with the added
ones are refused.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import refuse, row_keys, table, words, written

#: Rows that one task rounds, and residuals that meet at a node of the tree.
GROUP_ROWS, FAN = 10_000, 64
#: Fixed value: most copies of a document, and so the most of its size that a source gives.
MOST = 3
#: Probabilities this near to 0 or 1 are integral.
EPS = 1e-9


def sizes(docs: DataFrame, text: str = "text") -> Column:
    return F.size(words(F.col(f"`{text}`"))).cast("long")


def targets(per_source: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """``source, source_size`` -> with target. One row a source; shares of all sizes by weight, filled up to the cap.

    Sources in order of cap / weight are capped first; what the capped ones leave is shared by weight among the rest.
    """
    order = Window.partitionBy(F.lit(0))
    ranked = per_source.withColumn("__rank", F.row_number().over(order.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("__w", weight.cast("double")).withColumn("__cap", (F.col("source_size") * most).cast("double"))
    ranked = ranked.withColumn("__ratio", F.col("__cap") / F.col("__w"))
    before = order.orderBy("__ratio", "__rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(order) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (F.sum("__w").over(order) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("__level", level)
    fill = F.min(F.when(F.col("__ratio") >= F.col("__level"), F.struct("__ratio", "__rank", "__level"))).over(order)["__level"]
    return ranked.select("source", "source_size", F.least(F.col("__cap"), F.col("__w") * fill).alias("target"))


def _room(p: float) -> float:
    """How far a probability can go up and down alike."""
    return min(p, 1.0 - p) if EPS < p < 1 - EPS else 0.0


def _pivot(size: list[int], p: list[float], draw: random.Random) -> int | None:
    """Rounds ``p`` in place, sizes falling; gives the place that is left, if any."""
    room = [s * _room(x) for s, x in zip(size, p, strict=True)]
    behind, at, after, n = sum(room), 0, 0, len(p)

    def moved(i: int, words: float) -> None:
        p[i] += words / size[i]
        room[i] = size[i] * _room(p[i])

    while at < n:
        behind -= room[at]
        if not room[at]:
            at += 1
            continue
        up, down = (1 - p[at]) * size[at], p[at] * size[at]
        need, partners, found = max(up, down), [], 0.0
        if behind >= need * (1 + EPS):
            other = at + 1
            while other < n and found < need:
                if room[other]:
                    partners.append(other)
                    found += room[other]
                other += 1
        if found >= need:
            move = up if draw.random() < down / (up + down) else -down
            for i in partners:
                behind -= room[i]
                moved(i, -move * room[i] / found)
                behind += room[i]
            p[at] = 1.0 if move > 0 else 0.0
            room[at] = 0.0
            at += 1
            continue
        after = max(after, at + 1)
        while after < n and not room[after]:
            after += 1
        if after == n:
            return at
        other = after
        up, down = min(up, p[other] * size[other]), min(down, (1 - p[other]) * size[other])
        move = up if draw.random() < down / (up + down) else -down
        behind -= room[other]
        moved(other, -move)
        moved(at, move)
        if room[at]:
            behind += room[at]  # it meets the next one
            if room[other]:
                raise ArithmeticError("a meeting ended without a whole number")
        else:
            behind += room[other]
            at += 1
    return None


def _level(level: int, seed: int, last: bool):
    """Rounds one group; with ``last`` the row that is left is rounded by its own probability."""

    def rounded(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "row_key"], ascending=False, kind="stable").reset_index(drop=True)
        draw = random.Random(f"{seed} {level} {group['source_key'].iat[0]} {group['bucket'].iat[0]}")
        size, p = group["size"].tolist(), group["p"].tolist()
        left = _pivot(size, p, draw)
        extra = [int(x > 0.5) for x in p]
        if left is not None:
            extra[left] = int(draw.random() < p[left]) if last else -1
        return group.assign(extra=extra, p=p)[["row_key", "source_key", "bucket", "size", "p", "extra"]]

    return rounded


ROWS = "row_key string, source_key string, bucket long, size long, p double, extra long"


def copies(docs: DataFrame, size: str, source: str = "source", seed: int = 0, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """Counted rows of ``docs`` (all its columns; narrow ones are best) with source_size, target, rows and copies.

    ``rows`` is how many equal rows there are and ``copies`` how many the mix has of them together.
    """
    own = docs.columns
    refuse(docs, {"rows", "row_key", "source_size", "target", "copies"})
    same_size, same_source = F.col(f"`{size}`"), F.col(f"`{source}`")
    counted = docs.groupBy(*[F.col(f"`{c}`") for c in own]).agg(F.count(F.lit(1)).alias("rows"))
    key = F.concat_ws(":", *[F.lpad(F.hex(x), 16, "0") for x in row_keys(docs)])
    counted = written(counted.withColumn("row_key", key), "mix-rows")
    per_source = counted.groupBy(same_source.alias("source")).agg(F.sum(same_size * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("__n"))
    wanted = written(targets(per_source.drop("__n"), weights, most).join(per_source.select(F.col("source").alias("__s"), "__n"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s"), "mix-targets")
    met = counted.alias("d").join(wanted.alias("t"), F.col(f"d.`{source}`").eqNullSafe(F.col("t.source")))
    rate = F.when(F.col("t.source_size") > 0, F.least(F.col("t.target") / F.col("t.source_size"), F.lit(float(most)))).otherwise(0.0)
    met = met.select(*[F.col(f"d.`{c}`") for c in own], "d.rows", "d.row_key", "t.source_size", "t.target", "t.__n", rate.alias("__rate"))
    # Equal rows share the mass of all of them: the whole part at once, the rest as one probability.
    mass = F.round(F.col("__rate") * F.col("rows"), 9)
    met = met.withColumn("__whole", F.when(same_size > 0, F.floor(mass)).otherwise(0).cast("long")).withColumn("p", F.when(same_size > 0, mass - F.col("__whole")).otherwise(0.0))
    open_rows = met.where(F.col("p") > 1e-9).select("row_key", F.coalesce(F.concat(F.lit("="), same_source.cast("string")), F.lit("null")).alias("source_key"), F.pmod(F.xxhash64(F.lit(seed), "row_key"), F.ceil(F.col("__n") / GROUP_ROWS).cast("long")).alias("bucket"), same_size.alias("size"), "p", F.lit(-1).cast("long").alias("extra"))
    levels, buckets = 1, (wanted.agg(F.max("__n")).first()[0] or 0) // GROUP_ROWS + 1
    while FAN ** (levels - 1) < buckets:
        levels += 1
    done = None
    for level in range(levels):
        one = open_rows.groupBy("source_key", "bucket").applyInPandas(_level(level, seed, level == levels - 1), ROWS)
        one = written(one, f"mix-level{level}")
        ended = one.where("extra >= 0").select("row_key", "extra")
        done = ended if done is None else done.unionByName(ended)
        open_rows = one.where("extra < 0").withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))
    out = met.join(done, "row_key", "left").withColumn("copies", F.col("__whole") + F.coalesce("extra", F.lit(0)))
    return out.select(*[F.col(f"`{c}`") for c in own], "row_key", "source_size", "target", "rows", "copies")


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """The documents of the mix, each row as often as the mix has it; columns as given."""
    own = docs.columns
    k1, k2 = row_keys(docs)
    slim = docs.select(k1.alias("__a"), k2.alias("__b"), sizes(docs, text).alias("__size"), F.col(f"`{source}`").alias("__source"))
    drawn = copies(slim, "__size", "__source", seed).select("__a", "__b", "copies", "rows")
    keyed = docs.select(k1.alias("__a"), k2.alias("__b"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("__doc"))
    single = keyed.join(drawn.where("rows = 1 AND copies > 0"), ["__a", "__b"])
    # Rows that are there more than once: their first one stands for all.
    many = keyed.join(drawn.where("rows > 1 AND copies > 0"), ["__a", "__b"]).groupBy("__a", "__b").agg(F.first("__doc").alias("__doc"), F.first("copies").alias("copies"))
    return single.select("__doc", "copies").unionByName(many.select("__doc", "copies")).select("__doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__doc.*")


def op7_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", "source", sizes(docs).alias("size"))
    drawn = copies(slim, "size")
    each = F.col("copies") / F.col("rows")
    one = F.floor(each).cast("long") + (F.col("i") < F.col("copies") % F.col("rows")).cast("long")
    return drawn.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * one).alias("taken"))
