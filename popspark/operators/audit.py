"""An audit log as an append-only table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "timestamp timestamp, user_id string, query_type string, rows_returned long, elapsed_ms double, success boolean"


def record(spark: SparkSession, path: str, entries: list[tuple]) -> None:
    spark.createDataFrame(entries, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def logs(log: DataFrame, limit: int, user_id: str | None = None) -> DataFrame:
    return (log.where(F.col("user_id") == user_id) if user_id is not None else log).orderBy(F.desc("timestamp"), "user_id").limit(limit)


def stats(log: DataFrame) -> DataFrame:
    """Totals, success rate, average time and rows."""
    ok = F.sum(F.when(F.col("success"), 1).otherwise(0))
    n = F.count(F.lit(1))
    return log.agg(n.alias("total"), F.coalesce(ok, F.lit(0)).cast("long").alias("succeeded"), (n - F.coalesce(ok, F.lit(0))).cast("long").alias("failed"), F.when(n > 0, ok / n).otherwise(0.0).alias("success_rate"), F.coalesce(F.avg("elapsed_ms"), F.lit(0.0)).alias("avg_elapsed_ms"), F.coalesce(F.sum("rows_returned"), F.lit(0)).cast("long").alias("rows_returned"))


def by_type(log: DataFrame) -> DataFrame:
    return log.groupBy("query_type").agg(F.count(F.lit(1)).alias("total"))
