"""Streams into packages, and windows over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import package, store


def into_package(stream: DataFrame, path: str, label: str, checkpoint: str, key: str | None = None, before: Callable[[DataFrame], DataFrame] | None = None, **trigger) -> StreamingQuery:
    """Each micro-batch is appended to a dataset, or upserted by ``key``.

    A batch is named in the revision's message, so one that comes again after a failure is not written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"batch {number} of {checkpoint}"
        if store.exists(spark, f"{path.rstrip('/')}/_manifest.json") and any(r.message == name for r in package.open_package(spark, path).definition.history):
            return
        rows = before(batch) if before else batch
        if key:
            package.upsert(spark, path, label, key, rows, message=name)
        else:
            package.append(spark, path, rows, label, message=name)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(events: DataFrame, time: str, by: list[Column], length: str, slide: str | None = None, late: str | None = None, *aggregates: Column) -> DataFrame:
    """Tumbling or sliding windows; ``late`` sets a watermark for streams."""
    t = events.select("*", F.col(time).cast("timestamp").alias("__t"))
    t = t.withWatermark("__t", late) if late else t
    return t.groupBy(F.window("__t", length, slide), *by).agg(*(aggregates or [F.count(F.lit(1)).alias("n")]))


def sessions(events: DataFrame, time: str, by: list[Column], gap: str, late: str | None = None, *aggregates: Column) -> DataFrame:
    t = events.select("*", F.col(time).cast("timestamp").alias("__t"))
    t = t.withWatermark("__t", late) if late else t
    return t.groupBy(F.session_window("__t", gap), *by).agg(*(aggregates or [F.count(F.lit(1)).alias("n")]))
