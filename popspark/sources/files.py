"""Data from files, databases and load specifications."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Definition, Lineage
from ..operators import mutations
from . import package, store
from .package import Package, PackageError

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*(\.[A-Za-z_][A-Za-z0-9_$]*){0,2}")


def read_file(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet, CSV, Arrow or Feather file, or a package of one dataset."""
    if store.exists(spark, f"{path.rstrip('/')}/_manifest.json"):
        p = package.open_package(spark, path)
        if len(p.datasets) != 1:
            raise PackageError(f"{path} has {len(p.datasets)} datasets")
        return package.frame(spark, p, p.datasets[0])
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "csv":
        return (reader if schema else reader.option("inferSchema", "true")).option("header", "true").csv(path)
    if kind in ("arrow", "ipc", "feather"):
        from .arrow import ArrowFiles

        spark.dataSource.register(ArrowFiles)
        return spark.read.format("arrow_files").load(path)
    if kind == "vortex":
        raise PackageError("vortex files aren't supported")
    raise PackageError(f"unsupported file type {kind!r}")


def checked_name(name: str) -> str:
    if not NAME.fullmatch(name):
        raise PackageError(f"bad identifier {name!r}")
    return name


def read_table(spark: SparkSession, name: str, columns: list[str] | None = None, limit: int | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """A catalog table, or with ``options`` (format, url, ...) one of a database through Spark's connector."""
    checked_name(name)
    if options:
        rest = dict(options)
        df = spark.read.format(rest.pop("format", "jdbc")).options(dbtable=name, **rest).load()
    else:
        df = spark.table(name)
    df = df.select(*[checked_name(c) for c in columns]) if columns else df
    return df.limit(limit) if limit is not None else df


def extract(spark: SparkSession, path: str, definition: Definition, queries: dict[str, str], index: str | None = None) -> Package:
    """A package of the results of some SQL queries, one dataset for each label."""
    import hashlib

    digest = hashlib.sha256("\n".join(f"{k}={v}" for k, v in sorted(queries.items())).encode()).hexdigest()
    line = Lineage(definition.lineage.source_system, definition.lineage.source_tables, digest, definition.lineage.extraction_date, definition.lineage.job_id, definition.lineage.parents, "extract")
    return package.write_package(spark, path, Definition(**{**definition.__dict__, "lineage": line}), {k: spark.sql(q) for k, q in queries.items()}, index=index)


def write_table(df: DataFrame, name: str, mode: str = "append") -> int:
    """Rows to a catalog table, made if it isn't there; nanoseconds are no issue, as Spark has microseconds."""
    if mode not in ("append", "overwrite"):
        raise PackageError(f"unknown mode {mode!r}")
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).saveAsTable(checked_name(name))
    return int(seen.get["n"])


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    rows = [(t.namespace[0] if t.namespace else None, t.name, t.tableType) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "namespace string, name string, kind string")


def list_namespaces(spark: SparkSession) -> DataFrame:
    rows = [(d.catalog, d.name) for d in spark.catalog.listDatabases()]
    return spark.createDataFrame(rows, "catalog string, namespace string")


def discover(spark: SparkSession, database: str, detailed: bool = False) -> DataFrame:
    """Columns of all tables of a database; ``detailed`` adds least, greatest and distinct values, a pass for each table."""
    rows: list[tuple[Any, ...]] = []
    for t in spark.catalog.listTables(database):
        name = f"{database}.{t.name}" if not t.isTemporary else t.name
        df = spark.table(name)
        found: dict[str, tuple] = {}
        if detailed:
            plain = [c for c, k in df.dtypes if not k.startswith(("array", "map", "struct", "binary", "variant"))]
            got = df.agg(*[f(F.col(f"`{c}`")).alias(f"{i}_{k}") for i, c in enumerate(plain) for k, f in (("a", lambda x: F.min(x).cast("string")), ("b", lambda x: F.max(x).cast("string")), ("c", F.approx_count_distinct))]).first() if plain else None
            found = {c: (got[f"{i}_a"], got[f"{i}_b"], got[f"{i}_c"]) for i, c in enumerate(plain)}
        rows += [(t.name, c, k, *found.get(c, (None, None, None))) for c, k in df.dtypes]
    return spark.createDataFrame(rows, "table string, column string, type string, low string, high string, distinct_values long")


@dataclass(frozen=True)
class Step:
    """An increment: keys to delete (a query of one column) and rows to add (a query)."""

    delete: str | None = None
    add: str | None = None


@dataclass(frozen=True)
class LoadSpec:
    """A base table or query, increments on it in order, and further datasets."""

    definition: Definition
    label: str
    base: str
    key: str | None = None
    steps: tuple[Step, ...] = ()
    extra: dict[str, str] = field(default_factory=dict)
    index: str | None = None


def load(spark: SparkSession, spec: LoadSpec, path: str) -> Package:
    """A package by its specification; columns of increments are matched by name, missing ones are null."""
    query = lambda q: spark.table(q) if NAME.fullmatch(q) else spark.sql(q)
    data = query(spec.base)
    if spec.steps:
        if not spec.key:
            raise PackageError("increments need a key")
        adds = [query(s.add) if s.add else None for s in spec.steps]
        wide = data
        for a in (a for a in adds if a is not None):
            wide = wide.unionByName(a.limit(0), allowMissingColumns=True)
        fit = lambda df: wide.limit(0).unionByName(df, allowMissingColumns=True)
        data = mutations.increment(fit(data), [(query(s.delete) if s.delete else None, fit(a) if a is not None else None) for s, a in zip(spec.steps, adds, strict=True)], spec.key)
    return package.write_package(spark, path, spec.definition, {spec.label: data} | {k: query(q) for k, q in spec.extra.items()}, index=spec.index)


def load_template(name: str, label: str, splits: dict[str, str], base: str) -> dict[str, LoadSpec]:
    """A specification for each split: a condition on one base table."""
    return {k: LoadSpec(Definition(f"{name} {k}", lineage=Lineage(source_tables=(base,))), label, f"SELECT * FROM {checked_name(base)} WHERE {c}") for k, c in splits.items()}
