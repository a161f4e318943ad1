"""Texts of records, their embeddings, and search by cosine."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import codes, dot, norm, preview
from .filters import match
from .joins import lookup_first


def record_text(df: DataFrame, parts: list[tuple[str, str]], lists: list[tuple[str, str]] = (), default: str = "no data") -> Column:
    """``Label: value`` for each column that isn't null or empty, joined by ``. ``; delimited columns by commas."""
    there = set(df.columns)
    shown = [F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"{label}: "), F.col(c).cast("string"))) for label, c in parts if c in there]
    shown += [F.when(F.size(codes(F.col(c))) > 0, F.concat(F.lit(f"{label}: "), F.array_join(codes(F.col(c)), ", "))) for label, c in lists if c in there]
    joined = F.concat_ws(". ", *shown)
    return F.when(joined == "", default).otherwise(joined)


def hashed_terms(dimension: int = 256) -> Callable[[pd.Series], list[np.ndarray]]:
    """An embedder that needs no model: signed counts of hashed lower-case words."""
    import zlib

    def embed(texts: pd.Series) -> list[np.ndarray]:
        out = []
        for text in texts:
            v = np.zeros(dimension, np.float32)
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                v[h % dimension] += 1 if h >> 31 else -1
            out.append(v / (np.linalg.norm(v) or 1))
        return out

    return embed


def with_embedding(df: DataFrame, text: Column, embed: Callable[[pd.Series], list[np.ndarray]] | None = None, name: str = "embedding") -> DataFrame:
    """``df`` with a normalised vector; any embedder from texts to arrays, called on Arrow batches."""
    used = embed or hashed_terms()

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([v.tolist() for v in used(texts)])

    return df.withColumn(name, vectors(text))


def cosine_scores(
    vectors: DataFrame,
    query: DataFrame,
    key: str,
    embedding: str = "embedding",
    filters: dict[str, Any] | None = None,
    exclude: bool = True,
) -> DataFrame:
    """Every row with its ``score`` against the one row of ``query`` (key, embedding), which is broadcast; the query's
    own key is left out."""
    q = query.limit(1).select(F.col(key).alias("__key"), F.col(embedding).alias("__vector"))
    met = match(vectors, filters or {}).crossJoin(F.broadcast(q))
    if exclude:
        met = met.where(~F.col(key).eqNullSafe(F.col("__key")))
    lengths = norm(F.col(embedding)) * norm(F.col("__vector"))
    score = F.when(lengths > 0, dot(F.col(embedding), F.col("__vector")) / lengths).otherwise(0.0)
    return met.withColumn("score", score).drop("__key", "__vector")


def cosine_topk(
    vectors: DataFrame,
    query: DataFrame,
    k: int,
    key: str,
    embedding: str = "embedding",
    filters: dict[str, Any] | None = None,
    exclude: bool = True,
) -> DataFrame:
    """The ``k`` rows nearest to the query, ties by key; each task keeps its best ``k``."""
    return cosine_scores(vectors, query, key, embedding, filters, exclude).orderBy(F.desc("score"), key).limit(k)


def query_vector(vectors: DataFrame, key: str, value: Any = None, text: str | None = None, vector: list[float] | None = None, embedding: str = "embedding", embed: Callable | None = None) -> DataFrame:
    """One row (key, embedding) from a row's key, a text or a vector; one of the three must be given."""
    if value is not None:
        return vectors.where(F.col(key) == F.lit(value)).select(key, embedding).limit(1)
    if text is None and vector is None:
        raise ValueError("give a key, a text or a vector")
    found = vector if vector is not None else (embed or hashed_terms())(pd.Series([text]))[0].tolist()
    kind = vectors.schema[key].dataType
    return vectors.sparkSession.createDataFrame([([float(x) for x in found],)], "v array<float>").select(F.lit(None).cast(kind).alias(key), F.col("v").alias(embedding))


def best_per_key(hits: DataFrame, key: str, score: str = "score") -> DataFrame:
    return hits.groupBy(key).agg(F.max(score).alias(score))


def hits_with_rows(hits: DataFrame, table: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """Best score of each key with the key's first row of ``table``, best first."""
    return lookup_first(best_per_key(hits, key), table, key, order).orderBy(F.desc("score"), key).limit(k)


def preview_list(df: DataFrame, key: str, text: Column, k: int, size: int = 60) -> DataFrame:
    return df.select(key, preview(text, size).alias("preview")).orderBy(key).limit(k)
