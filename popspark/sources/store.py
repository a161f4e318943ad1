"""Small text files in any store that Spark reads, through Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside its place first, then moved over it in one step: readers see the old text or the new one."""
    jvm, (fs, p) = spark._jvm, _at(spark, path)
    fs.mkdirs(p.getParent())
    tmp = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex[:8]}.new")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    how = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(how, 1)
    over[0] = how.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(fs.makeQualified(tmp), fs.makeQualified(p), over)


def folder(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.mkdirs(p)


def move(spark: SparkSession, old: str, new: str) -> None:
    """A folder moved to a place where nothing is."""
    (fs, a), (_, b) = _at(spark, old), _at(spark, new)
    fs.mkdirs(b.getParent())
    if fs.exists(b) or not fs.rename(a, b):
        raise OSError(f"could not move {old} to {new}")


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str, recursive: bool = False) -> bool:
    fs, p = _at(spark, path)
    return fs.delete(p, recursive)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, p = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def size(spark: SparkSession, path: str) -> int:
    fs, p = _at(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; on a cluster that is an error, as executors could not
    see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="popspark-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
