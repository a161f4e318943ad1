"""Quality rules: fixed limits on a text's statistics, then robust multivariate outliers per language and source.

For each (language, source) the minimum-covariance-determinant estimate of the statistics' location and scatter is
found by concentration steps: from two starts (medians and absolute deviations; plain mean and covariance) keep the
part of the rows with the least Mahalanobis distances, take mean and covariance of these, repeat, and in the end keep
the start with the smaller determinant. A row is rejected when its squared distance is beyond a chi-square quantile
and it lies on the bad side (more symbols, more repetition, odd words) of the centre.

Only DataFrame functions run; every step is an aggregation with partial sums, so a hot group stays spread out, and
what is joined back has one row for each group. Defined cases: a null or empty text has no words and fails the base
limits; rows of a null language or source form a group like others; a group of fewer rows than ``least_rows`` is judged
by the estimate of its language, and if that has too few rows, too, by that of all rows; very long texts are taken whole;
repeated and tied rows are judged alike; extra columns pass through, clashing names are refused. Quantiles are those of
Spark's sketches, so a row right at a limit may be judged differently when rows are dealt to tasks in another way.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, let, refuse, table, words, written

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
X = tuple(f"__x{i}" for i in range(5))


@dataclass(frozen=True)
class Params:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Share of rows that an estimate rests on, and the factor that makes its covariance consistent for normal data in
    #: five dimensions: share / P(chi2_7 <= quantile of chi2_5 at share).
    share: float = 0.75
    consistency: float = 1.412
    steps: int = 3
    least_rows: int = 50
    #: Squared distance beyond which a row is an outlier: chi2_5 at about 1 - 1e-12.
    cut: float = 66.0
    #: Least standard deviations of the five transformed statistics; most texts have no symbols or repeats at all.
    floor: tuple[float, ...] = (0.05, 0.5, 0.5, 0.5, 0.5)


def _repeat_words(parts: Column) -> Column:
    """Words in windows of three that occur twice or more. Exact: hashes only tell which texts have repeats at all."""
    n = F.size(parts)

    def exact(ws: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: (a["h"] == b["h"]) & (a["w"] == b["w"]))
            marked = let(same, lambda e: F.arrays_zip(F.transform(s, lambda x: x["i"]).alias("i"), F.concat(F.array(F.lit(False)), e).alias("l"), F.concat(e, F.array(F.lit(False))).alias("r")))
            at = F.sort_array(F.transform(F.filter(marked, lambda z: z["l"] | z["r"]), lambda z: z["i"]))
            return let(at, lambda p: F.when(F.size(p) == 0, 0).otherwise(3 + F.aggregate(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(F.lit(3), b - a)), F.lit(0), lambda t, x: t + x)))

        return let(F.sort_array(F.transform(ws, lambda w, i: F.struct(F.xxhash64(w["a"], w["b"], w["c"]).alias("h"), w.alias("w"), i.alias("i")))), of_sorted)

    def of_windows(ws: Column) -> Column:
        hashes = F.transform(ws, lambda w: F.xxhash64(w["a"], w["b"], w["c"]))
        return F.when(let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h)), exact(ws)).otherwise(0)

    zipped = F.arrays_zip(F.slice(parts, 1, n - 2).alias("a"), F.slice(parts, 2, n - 2).alias("b"), F.slice(parts, 3, n - 2).alias("c"))
    named = zipped.cast("array<struct<a:string,b:string,c:string>>")
    return F.when(n < 4, 0).otherwise(let(named, of_windows))


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with STATS, each over the whole text."""
    refuse(docs, {*STATS, "__words", "__row"})
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    w = F.col("__words")
    lines = let(F.filter(F.split(whole, "\n"), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0), lambda a: F.size(a) - F.size(F.array_distinct(a)))
    return docs.withColumn("__words", words(F.col(f"`{text}`"))).select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
    )


def base_failed(p: Params) -> Column:
    return (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words"))


def _transformed() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    rate = lambda c: F.log1p(100.0 * F.col(c) / n)
    return [F.ln(F.greatest(F.col("word_chars"), F.lit(1)) / n), rate("n_symbols"), rate("n_dup_lines"), rate("n_repeat_words"), F.ln(n.cast("double"))]


def _same_group(a: str, b: str, keys: tuple[str, ...]) -> Column:
    return reduce(and_, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def _decomposed(est: DataFrame, p: Params, keys: tuple[str, ...]) -> DataFrame:
    """Mean and covariance -> mean, Cholesky factor ``l<i><j>`` and log determinant, one column after the other."""
    out = est
    for i in range(5):
        for j in range(i + 1):
            rest = F.col(f"c{j}{i}" if j < i else f"c{i}{i}") * F.lit(p.consistency if i != j else 1.0)
            if i == j:
                rest = F.greatest(F.col(f"c{i}{i}") * p.consistency, F.lit(0.0)) + F.lit(p.floor[i] ** 2)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    det = sum((F.ln(F.col(f"l{i}{i}")) for i in range(1, 5)), F.ln("l00"))
    return out.select(*keys, "n", *[f"m{i}" for i in range(5)], *[f"l{i}{j}" for i in range(5) for j in range(i + 1)], det.alias("log_det"))


def _distance() -> Column:
    z: list[Column] = []
    for i in range(5):
        r = F.col(X[i]) - F.col(f"m{i}")
        for k in range(i):
            r = r - F.col(f"l{i}{k}") * z[k]
        z.append(r / F.col(f"l{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _moments(keys: tuple[str, str]) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(X)], *[F.covar_pop(X[i], X[j]).alias(f"c{i}{j}") for i in range(5) for j in range(i, 5)]]


def fit(stats: DataFrame, p: Params | None = None, keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """One row for each group with at least ``least_rows`` rows that pass the base limits: centre, factor, size."""
    p = p or Params()
    rows = stats.where(~base_failed(p)).select(*keys, *[x.alias(n) for x, n in zip(_transformed(), X, strict=True)])
    middle = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(x, 0.5).alias(f"m{i}") for i, x in enumerate(X)]).where(F.col("n") >= p.least_rows)
    spread = rows.alias("r").join(middle.alias("g"), _same_group("r", "g", keys)).groupBy(*[F.col(f"g.{k}").alias(k) for k in keys]).agg(F.first("n").alias("n"), *[F.first(f"m{i}").alias(f"m{i}") for i in range(5)], *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5).alias(f"d{i}") for i, x in enumerate(X)])
    robust = spread.select(*keys, "n", *[f"m{i}" for i in range(5)], *[(F.pow(1.4826 * F.col(f"d{i}"), 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(5) for j in range(i, 5)])
    plain = rows.groupBy(*keys).agg(*_moments(keys)).where(F.col("n") >= p.least_rows)
    # Both starts go through the steps together, so the driver plans each step once.
    each = (*keys, "__start")
    starts = [_decomposed(first, p, keys).withColumn("__start", F.lit(i)) for i, first in enumerate((robust, plain))]
    est = written(starts[0].unionByName(starts[1]), "mcd-start")
    for _ in range(p.steps):
        near = rows.alias("r").join(est.alias("g"), _same_group("r", "g", keys)).select(*[F.col(f"g.{k}").alias(k) for k in each], *X, _distance().alias("__d"))
        limit = near.groupBy(*each).agg(F.percentile_approx("__d", p.share, 1000).alias("__most"))
        kept = near.alias("r").join(limit.alias("g"), _same_group("r", "g", each)).where(F.col("__d") <= F.col("__most")).select(*[F.col(f"r.{k}").alias(k) for k in each], *X)
        est = written(_decomposed(kept.groupBy(*each).agg(*_moments(keys)), p, each), "mcd-step")
    best = F.min(F.struct("log_det", "n", *[f"m{i}" for i in range(5)], *[f"l{i}{j}" for i in range(5) for j in range(i + 1)])).alias("b")
    return est.groupBy(*keys).agg(best).select(*keys, "b.*")


def fit_all(stats: DataFrame, p: Params | None = None, keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """A row as of ``fit`` for each group that has rows, its own estimate or that of a larger group that it is part of:
    all rows of its language, else all rows. Without an estimate even of all rows a group has no row."""
    p = p or Params()
    own = written(fit(stats, p, keys), "mcd-own")
    same = lambda a, b, some: reduce(and_, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in some])
    groups = stats.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))  # one row for each group
    small = written(groups.alias("r").join(own.alias("g"), same("r", "g", keys), "left_anti").select(*keys), "mcd-small")
    if small.isEmpty():
        return own
    blank = lambda k: F.lit(None).cast(stats.schema[k].dataType).alias(k)
    rest = [c for c in stats.columns if c not in keys]
    found = own
    for level in (keys[:1], ()):
        wider = stats.select(*[F.col(k) if k in level else blank(k) for k in keys], *[F.col(f"`{c}`") for c in rest])
        est = written(fit(wider, p, keys), "mcd-wider")
        one = [F.col(f"r.{k}").alias(k) for k in keys] + [F.col(f"g.{c}").alias(c) for c in own.columns if c not in keys]
        met = small.alias("r").join(est.alias("g"), same("r", "g", level) if level else F.lit(True)).select(*one)
        found = found.unionByName(met)
        small = written(small.alias("r").join(found.alias("g"), same("r", "g", keys), "left_anti").select("r.*"), "mcd-small")
        if small.isEmpty():
            break
    return written(found, "mcd-groups")


def judged(stats: DataFrame, groups: DataFrame, p: Params | None = None, keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """``stats`` with base_failed, distance (null where a group has no estimate) and kept."""
    p = p or Params()
    own = [F.col(f"r.`{c}`") for c in stats.columns]
    x = _transformed()
    rows = stats.select("*", *[v.alias(n) for v, n in zip(x, X, strict=True)])
    met = rows.alias("r").join(groups.alias("g"), _same_group("r", "g", keys), "left")
    worse = (F.abs(F.col(X[0]) - F.col("m0")) > 3 * F.col("l00")) | (F.col(X[1]) > F.col("m1")) | (F.col(X[2]) > F.col("m2")) | (F.col(X[3]) > F.col("m3"))
    out = F.coalesce((F.col("distance") > p.cut) & F.col("__worse"), F.lit(False))
    return met.select(*own, base_failed(p).alias("base_failed"), _distance().alias("distance"), worse.alias("__worse")).select(*[F.col(f"`{c}`") for c in stats.columns], "base_failed", "distance", (~F.col("base_failed") & ~out).alias("kept"))


def kept_documents(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """The documents that pass, columns as given. Statistics are worked out twice, so no text is shuffled or stored."""
    narrow = written(with_stats(docs.select("lang", "source", "text")).drop("text"), "quality")
    # Filters don't move below a row number, so the statistics are not worked out again for them.
    whole = judged(with_stats(docs).withColumn("__row", F.monotonically_increasing_id()), fit_all(narrow, p), p)
    return whole.where("kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(with_stats(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")).drop("text"), "quality")
    return judged(stats, fit_all(stats)).select("doc_id", *STATS, "base_failed", "kept", "lang", "source", F.round("distance", 3).alias("distance"))
