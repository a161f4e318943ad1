"""What several operators share: word patterns, the shared folder, and tables written to it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of the white space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "[ \\t-\\r]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, seen by driver and executors.

    Where it is unset, a local master gets a temporary folder; on a cluster that is an error, as executors could not
    see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        named = "file://" + tempfile.mkdtemp(prefix="popspark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/popspark-{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and safe when executors are lost."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.popspark_path = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for path, spark in ((x.popspark_path, x.sparkSession) for x in tables if x is not None):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


@contextmanager
def small_batches(spark: SparkSession, mb: int = 8, rows: int = 2000) -> Iterator[None]:
    """Arrow batches of bounded size for what runs inside, so that long rows don't add up in a Python worker."""
    ours = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
        "spark.sql.execution.arrow.maxBytesPerBatch": str(mb << 20),
    }
    before = {k: spark.conf.get(k, None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """All runs of characters other than SPACES; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def refuse(docs: DataFrame, names: set[str]) -> None:
    """An error if ``docs`` has one of the columns that an operator adds."""
    if clash := names & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} exist")


def row_keys(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a whole row."""
    bare = [F.col(f"`{c}`") for c in docs.columns]
    return F.xxhash64(*bare), F.xxhash64(F.lit(1), *bare)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
