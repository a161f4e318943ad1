"""How common hashed elements are: a table of 2**20 counts of fixed size, summed over all rows.

It only orders elements, rare ones first, for prefix filters, which are exact under any fixed order. An element far
more common than its slot's other elements by chance (a few times the square root of their number) comes late, however
large the input: only such elements make large candidate groups.

The tasks that count are at most ``TASKS``, whatever the number of input splits, and hand on only the slots that they
have seen, so partial tables stay small beside the input; they are added in a tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

BITS, BLOCK = 20, 1 << 16
#: Partial tables that one task adds up, and tasks that make them.
FAN, TASKS = 32, 4096
PARTS = "task long, block int, counts binary"


def slots(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def packed(counts: np.ndarray) -> bytes:
    """BLOCK counts: a width, a flag, then all of them or the places and values of those above 0."""
    width = next(w for w in (1, 2, 4, 8) if int(counts.max()) < 1 << (8 * w))
    at = np.flatnonzero(counts)
    if len(at) * (2 + width) < BLOCK * width:
        return bytes([width, 1]) + at.astype("<u2").tobytes() + counts[at].astype(f"<u{width}").tobytes()
    return bytes([width, 0]) + counts.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width, sparse = data[0], data[1]
    if not sparse:
        return np.frombuffer(data, f"<u{width}", BLOCK, 2).astype(np.uint64)
    n, out = (len(data) - 2) // (2 + width), np.zeros(BLOCK, np.uint64)
    out[np.frombuffer(data, "<u2", n, 2).astype(np.int64)] = np.frombuffer(data, f"<u{width}", n, 2 + 2 * n)
    return out


def table_of(rows: DataFrame, elements: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> Broadcast:
    """``elements`` gives arrays of unsigned 64-bit elements of a batch."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, waiting = np.zeros(1 << BITS, np.int64), [], 0
        for batch in batches:
            for x in elements(batch):
                held.append(x)
                waiting += len(x)
                if waiting > 1 << BITS:
                    total += np.bincount(slots(np.concatenate(held)), minlength=1 << BITS)
                    held, waiting = [], 0
        if held:
            total += np.bincount(slots(np.concatenate(held)), minlength=1 << BITS)
        task = TaskContext.get().partitionId()
        for i in range(0, 1 << BITS, BLOCK):
            part = total[i : i + BLOCK]
            if part.any():
                row = [pa.array([task], pa.int64()), pa.array([i // BLOCK], pa.int32()), pa.array([packed(part)], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["task", "block", "counts"])

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.uint64)
        for x in group["counts"]:
            total += unpacked(x)
        return pd.DataFrame({"task": [group["task"].iat[0]], "block": [group["block"].iat[0]], "counts": [packed(total)]})

    parts = written(rows.coalesce(TASKS).mapInArrow(counted, PARTS), "rarity")
    while (parts.agg(F.max("task")).first()[0] or 0) > 0:
        fewer = parts.withColumn("task", F.floor(F.col("task") / FAN).cast("long"))
        old, parts = parts, written(fewer.groupBy("task", "block").applyInPandas(added, PARTS), "rarity")
        discard(old)
    full = np.zeros(1 << BITS, np.uint64)
    for r in parts.collect():  # 16 rows of 512 KB at most
        full[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = unpacked(r["counts"])
    discard(parts)
    return rows.sparkSession.sparkContext.broadcast(full)


def rare_first(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``x`` in the global order: rarer slots first, then by value."""
    return x[np.lexsort((x, counts[slots(x)]))]
