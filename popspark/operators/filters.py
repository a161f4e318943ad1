"""Rows kept or dropped by keys, selectors and bit sets."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import has_bits
from ..model import Selector
from ..plans.predicates import of_selectors


def key_set(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys, null not among them."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def keep_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``keys``; a null key never is. Spark broadcasts small key sets by itself."""
    return df.join(keys.select(F.col(keys.columns[0]).alias(key)), key, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ``keys``; rows with a null key stay."""
    return df.join(keys.select(F.col(keys.columns[0]).alias(key)), key, "left_anti")


def keys_frame(df: DataFrame, key: str, values: list[Any]) -> DataFrame:
    """Literals as a table of ``df``'s key type; what can't be one is dropped."""
    kind = df.schema[key].dataType.simpleString()
    texts = df.sparkSession.createDataFrame([(None if v is None else str(v),) for v in values], "k string")
    return texts.select(F.col("k").try_cast(kind).alias(key)).where(F.col(key).isNotNull())


def select_rows(df: DataFrame, selectors: list[Selector], logic: str = "AND") -> DataFrame:
    return df.where(of_selectors(selectors, logic).column())


def match(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    """Rows equal to all given values."""
    for c, v in values.items():
        df = df.where(F.col(c) == F.lit(v))
    return df


def with_bits(df: DataFrame, column: str, bits: int) -> DataFrame:
    return df.where(has_bits(F.col(column), bits))
