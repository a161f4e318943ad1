"""Universes: the vectors and the members of a package's dataset, kept to be searched again and again.

``<folder>/_universe.json`` names the current Parquet folders of vectors and members and what they were made from. An
index that was made from the same folders with the same embedder is used as it is; anything else is built anew beside
it, so a search that runs keeps its files.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import norm, preview
from ..operators import aggregates, similarity
from ..operators.filters import key_set
from . import package, store
from .package import PackageError

WHOLE = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Universe:
    folder: str
    key: str
    vectors: str
    members: str
    bitmap: bool  # members are a bitmap of whole numbers, else a table of keys
    num_vectors: int
    dimension: int
    cardinality: int
    version: int  # the package's revision
    source: str  # what it was made from
    elapsed_ms: int = 0


def open_universe(spark: SparkSession, folder: str) -> Universe:
    return Universe(**json.loads(store.read_text(spark, f"{folder.rstrip('/')}/_universe.json")))


def build(
    spark: SparkSession,
    path: str,
    label: str,
    key: str,
    folder: str,
    *,
    text: Column | None = None,
    embedding: str | None = None,
    embed: Callable | None = None,
    embedder: str = "hashed_terms",
) -> Universe:
    """The universe of a dataset: a vector of each row, from ``text`` by ``embed`` or as column ``embedding`` has it,
    and the set of its keys. ``embedder`` is the name by which an index is known again; name each one differently.
    Rows without a vector are members that no search finds; null keys are not members."""
    if (text is None) == (embedding is None):
        raise PackageError("give a text or a column of vectors")
    began, folder = time.time(), folder.rstrip("/")
    p = package.open_package(spark, path)
    d = p.dataset(label)
    folders = [p.path, label, key, embedding or str(text), embedder, *[x for x, _ in d.folders]]
    source = json.dumps(folders)
    if d.format == "parquet" and store.exists(spark, f"{folder}/_universe.json"):
        old = open_universe(spark, folder)
        if old.source == source:
            return old
    df = package.frame(spark, p, d)
    shown = preview(text) if text is not None else F.lit(None).cast("string")
    rows = df.select(F.col(f"`{key}`").alias("key"), shown.alias("metadata"), (text if embedding is None else F.col(f"`{embedding}`")).alias("of"))
    rows = similarity.with_embedding(rows, F.col("of"), embed) if embedding is None else rows.withColumn("embedding", F.col("of").cast("array<float>"))
    rows = rows.where(F.col("embedding").isNotNull()).select("key", "metadata", "embedding")
    seen, vectors, members = Observation(), f"vectors-{uuid.uuid4().hex[:12]}", f"members-{uuid.uuid4().hex[:12]}"
    sizes = (F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"))
    rows.observe(seen, *sizes).write.option("compression", "zstd").parquet(f"{folder}/{vectors}")
    got = seen.get
    if got["n"] and got["low"] != got["high"]:
        raise PackageError(f"vectors have {got['low']} to {got['high']} dimensions")
    bitmap = dict(df.dtypes).get(key) in WHOLE
    found = aggregates.key_bitmap(df, key) if bitmap else key_set(df.select(F.col(f"`{key}`").alias("key")), "key")
    found.write.parquet(f"{folder}/{members}")
    there = spark.read.parquet(f"{folder}/{members}")
    cardinality = aggregates.bitmap_size(there).first()[0] if bitmap else there.count()
    took = int(1000 * (time.time() - began))
    made = Universe(folder, key, vectors, members, bitmap, int(got["n"]), int(got["high"] or 0), int(cardinality), p.definition.revision, source, took)
    store.write_text(spark, f"{folder}/_universe.json", json.dumps(made.__dict__))
    return made


def vectors_of(spark: SparkSession, u: Universe) -> DataFrame:
    return spark.read.parquet(f"{u.folder}/{u.vectors}")


def members_of(spark: SparkSession, u: Universe) -> DataFrame:
    """The keys, one row each."""
    found = spark.read.parquet(f"{u.folder}/{u.members}")
    return aggregates.bitmap_keys(found, u.key) if u.bitmap else found.select(F.col("key").alias(u.key))


def _best(u: Universe, hits: DataFrame, top_k: int) -> DataFrame:
    """The best vector of each key: key, score, metadata; ties by key, then by text."""
    best = hits.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "metadata")).alias("b"))
    out = best.select(F.col("key").alias(u.key), (-F.col("b.s")).alias("score"), F.col("b.metadata").alias("metadata"))
    return out.orderBy(F.desc("score"), u.key).limit(top_k)


def search_by_text(spark: SparkSession, u: Universe, text: str, top_k: int = 10, embed: Callable | None = None) -> DataFrame:
    """The ``top_k`` keys nearest to a text, embedded as the universe was."""
    vectors = vectors_of(spark, u)
    query = similarity.query_vector(vectors, "key", text=text, embed=embed)
    return _best(u, similarity.cosine_scores(vectors, query, "key", exclude=False), top_k)


def search_by_key(spark: SparkSession, u: Universe, value: object, top_k: int = 10) -> DataFrame:
    """The ``top_k`` other keys nearest to a key's first vector that isn't zero; none for an unknown key."""
    vectors = vectors_of(spark, u)
    own = vectors.where((F.col("key") == F.lit(value)) & (norm(F.col("embedding")) > 0))
    return _best(u, similarity.cosine_scores(vectors, own.orderBy("metadata", "embedding").limit(1), "key"), top_k)
