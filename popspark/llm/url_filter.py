"""URL filters by a sort-merge range join.

The host of a url or of a rule is written with its labels reversed, each followed by a character that sorts below all
others (``com.example`` -> ``com\\0example\\0``). A rule's host is then a prefix of the keys of all its subdomains, so it
covers an interval of keys, and intervals nest or are apart. Urls are cut into ranges of about equal size at key
positions taken from a bounded sample; a rule goes to each range that its interval meets. Inside a range a sorted sweep
keeps a stack of the active rule hosts, each with its rules by path and the lengths of the paths. For a url every active host is looked up
for its longest fitting path, and the longest rule wins: most characters of host and path together, then the longer
host, then block before allow.

The sample only sets where ranges begin. The cut positions go on to the page id's hash, so one hot host, or even one
hot url, is spread over many ranges. Defined cases: very long urls are taken whole; extra columns of any name don't
matter, as only id and url are read; null urls and urls without ``://`` have empty host and path; an
empty host fits no rule; rows repeat as given; without rules every verdict is the default.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RULES = "host string, path string, verdict string"
#: Keys that the cut positions are taken from.
SAMPLE = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, text: str) -> Rule:
        verdict, where = text.split(" ")
        host, slash, path = where.partition("/")
        return cls(verdict, host.lower(), slash + path)


#: The rules of the registered query.
DEFAULT_RULES = ("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_key(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\0"), F.lit("\0")))


class Sweep:
    """The stack of rule hosts whose intervals hold the present key."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, dict[str, tuple[str, str]], list[int]]] = []

    def _leave(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def enter(self, key: str, host: str, path: str, verdict: str) -> None:
        self._leave(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, len(host), {}, []))
        _, _, rules, lengths = self.stack[-1]
        if path not in rules and len(path) not in lengths:
            bisect.insort(lengths, len(path))
        if path not in rules or verdict == "block":
            rules[path] = (host + path, verdict)

    def judge(self, key: str, path: str) -> tuple[str, str] | None:
        self._leave(key)
        best, rank = None, (-1, -1)
        for _, n, rules, lengths in self.stack:
            for m in reversed(lengths[: bisect.bisect_right(lengths, len(path))]):
                if (head := path[:m]) in rules:
                    if (n + m, n) > rank:
                        best, rank = rules[head], (n + m, n)
                    break
        return best


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep, at = Sweep(), None
    for batch in batches:
        out: dict[str, list] = {"page_id": [], "host": [], "path": [], "rule": [], "verdict": []}
        for cut, key, is_page, page, host, path, verdict in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if cut != at:
                sweep, at = Sweep(), cut
            if not is_page:
                sweep.enter(key, host, path, verdict)
                continue
            rule, said = (key and sweep.judge(key, path)) or (None, verdict)
            for k, v in zip(out, (page, host, path, rule, said), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["page_id"], pa.int64()), *[pa.array(out[k], pa.string()) for k in ("host", "path", "rule", "verdict")]], names=list(out))


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", page_id: str = "page_id", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; ``rules`` has host, path and verdict."""
    spark = pages.sparkSession
    n = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    u = F.col(f"`{url}`")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    rows = rows.withColumn("key", reversed_key(F.col("host"))).withColumn("tie", F.hex(F.xxhash64("page_id", "path")))
    place = F.concat(F.col("key"), F.lit("￿"), F.col("tie"))
    # About SAMPLE rows by their hash, and never many more, whatever repeats.
    part = F.pmod(F.xxhash64("p"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / max(1, pages.count()))))
    seen = sorted(r[0] for r in rows.select(place.alias("p")).where(part).limit(4 * SAMPLE).collect())
    cuts = sorted({seen[i * len(seen) // n] for i in range(1, n)}) if seen else []

    @F.pandas_udf("int")
    def range_of(places: pd.Series) -> pd.Series:
        return places.map(lambda x: bisect.bisect_right(cuts, x)).astype("int32")

    paged = rows.select(range_of(place).alias("cut"), "key", F.lit(1).alias("is_page"), "page_id", "host", "path", F.lit(default).alias("verdict"), "tie")
    given = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''").withColumn("key", reversed_key(F.col("host")))
    given = given.select(F.explode(F.sequence(range_of(F.col("key")), range_of(F.concat("key", F.lit("\U0010ffff"))))).alias("cut"), "key", F.lit(0).alias("is_page"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict", F.lit("").alias("tie"))
    dealt = paged.unionByName(given).repartition(n, "cut").sortWithinPartitions("cut", "key", "is_page", "tie")
    return dealt.drop("tie").mapInArrow(_swept, "page_id long, host string, path string, rule string, verdict string")


def rule_table(spark: SparkSession, rules: tuple[str, ...] = DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame([(r.host, r.path, r.verdict) for r in map(Rule.parse, rules)], RULES)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark))


#: The same by a plain match of five rules; DuckDB.
OP1_SQL = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, row_number() OVER () AS i FROM pages),
r(v, h, q) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT i, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (i)
"""
