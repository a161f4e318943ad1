"""Datasets of many packages as tables, read only as far as a condition needs.

A table is the datasets of one label in all packages of a folder, joined by name with whole numbers widened. Before a
scan is built, packages are left out whose verified selectors contradict the condition, or whose key index has none of
the keys that it asks for. Within what is left Catalyst pushes the condition into Parquet, and Parquet skips row groups.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, ShortType, StructField, StructType

from ..sources import package, store
from ..sources.package import Dataset, Package
from .predicates import Opaque, Predicate, from_sql, impossible, key_literals, of_expression

WHOLE: tuple[type[DataType], ...] = (ByteType, ShortType, IntegerType, LongType)


def table_name(label: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() else "_" for c in label.lower())


def widened(schemas: list[StructType]) -> StructType:
    """Columns by name, first come first; whole numbers take the wider type, others must agree."""
    found: dict[str, StructField] = {}
    for f in (f for s in schemas for f in s):
        old = found.setdefault(f.name.lower(), StructField(f.name, f.dataType, True))
        if old.dataType != f.dataType:
            kinds = [type(old.dataType), type(f.dataType)]
            if not all(k in WHOLE for k in kinds):
                raise ValueError(f"column {f.name!r} is {old.dataType.simpleString()} and {f.dataType.simpleString()}")
            found[f.name.lower()] = StructField(old.name, max(kinds, key=WHOLE.index)(), True)
    return StructType(list(found.values()))


class Catalog:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.packages: list[Package] = []
        self.refresh()

    def refresh(self) -> int:
        """Reads the manifests anew; gives the number of packages."""
        names = [n for n in sorted(store.names(self.spark, self.folder)) if not n.startswith(("_", "."))]
        paths = [f"{self.folder}/{n}" for n in names if store.exists(self.spark, f"{self.folder}/{n}/_manifest.json")]
        self.packages = [package.open_package(self.spark, p) for p in paths]
        return len(self.packages)

    def add(self, path: str) -> None:
        self.packages = [p for p in self.packages if p.path != path.rstrip("/")] + [package.open_package(self.spark, path)]

    def _labels(self) -> dict[str, str]:
        """Table names and labels; two labels of one name are an error."""
        found: dict[str, str] = {}
        for label in (d.label for p in self.packages for d in p.datasets):
            if found.setdefault(table_name(label), label) != label:
                raise ValueError(f"labels {found[table_name(label)]!r} and {label!r} have one table name")
        return found

    def tables(self) -> list[str]:
        return sorted(self._labels())

    def entries(self, label: str) -> list[tuple[Package, Dataset]]:
        return [(p, d) for p in self.packages for d in p.datasets if label in (d.label, table_name(d.label))]

    def schema(self, label: str) -> StructType:
        found = self.entries(label)
        if not found:
            raise ValueError(f"no table {label!r}")
        return widened([StructType.fromJson(json.loads(d.schema)) for _, d in found])

    def count(self, label: str) -> int:
        """Rows of a table from the manifests, without a job where they know."""
        return sum(d.num_rows if d.num_rows is not None else package.frame(self.spark, p, d).count() for p, d in self.entries(label))

    def stats(self) -> DataFrame:
        rows = [(p.path, d.label, d.num_rows, sum(store.size(self.spark, f"{p.path}/{f}") for f, _ in d.folders) if d.format == "parquet" else None) for p in self.packages for d in p.datasets]
        return self.spark.createDataFrame(rows, "package string, label string, num_rows long, num_bytes long")

    def surviving(self, label: str, where: Predicate) -> list[tuple[Package, Dataset]]:
        """Entries that may have a row that fits."""
        entries = self.entries(label)
        kept = self._may_have([(p, d, where) for p, d in entries])
        return [e for e, keep in zip(entries, kept, strict=True) if keep]

    def _may_have(self, asked: list[tuple[Package, Dataset, Predicate]]) -> list[bool]:
        """Whether each dataset may have a row that fits its condition, by verified selectors and key indexes."""
        kept, lookups = [], []
        for i, (p, d, where) in enumerate(asked):
            fields = StructType.fromJson(json.loads(d.schema))
            kinds = {f.name.lower(): f.dataType.simpleString() for f in fields}
            kept.append(not impossible(list(d.verified), where, kinds))
            if kept[-1] and p.index and p.index.column.lower() in kinds:
                keys = key_literals(where, p.index.column)
                if keys is not None:
                    lookups.append((i, p, keys))
        # All lookups are one job: a few keys against sorted files with bloom filters.
        jobs = []
        for i, p, keys in lookups:
            index = self.spark.read.parquet(f"{p.path}/{p.index.path}")
            kind = index.schema["key"].dataType.simpleString()
            if any(isinstance(k, str) != (kind == "string") and kind in ("string", "boolean") for k in keys):
                continue  # Spark casts the column then, not the literal
            if kind.startswith("decimal") and any(isinstance(k, float) for k in keys):
                continue
            text = self.spark.createDataFrame([(str(k),) for k in keys], "k string")
            values = [r[0] for r in text.select(F.col("k").try_cast(kind).alias("k")).collect()]
            if any(v is None for v in values):  # a literal that isn't of the key's type: no proof
                continue
            kept[i] = False
            if values:
                jobs.append(index.where(F.col("key").isin(values)).limit(1).select(F.lit(i).alias("i")))
        for r in reduce(DataFrame.unionAll, jobs).collect() if jobs else []:
            kept[r[0]] = True
        return kept

    def scan(self, label: str, where: Predicate | str | None = None, columns: list[str] | None = None) -> DataFrame:
        """The rows of a table that fit, from the packages that may have some."""
        schema = self.schema(label)
        p = from_sql(self.spark, where) if isinstance(where, str) else where
        found = self.surviving(label, p) if p is not None else self.entries(label)
        df = self._joined(found, schema)
        df = df.where(p.column()) if p is not None else df
        return df.select(*columns) if columns else df

    def _joined(self, found: list[tuple[Package, Dataset]], schema: StructType) -> DataFrame:
        parts = []
        for p, d in found:
            df = package.frame(self.spark, p, d)
            there = {c.lower(): c for c in df.columns}
            parts.append(df.select(*[(F.col(f"`{there[f.name.lower()]}`") if f.name.lower() in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]))
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], schema)

    def register(self, without: set[tuple[str, str]] = frozenset()) -> list[str]:
        """Temporary views of all tables, each row with the package that it is from in ``_package``.

        The package is a constant of each branch, so a condition on it drops branches in Catalyst. ``without``: (package,
        dataset) paths that are left out.
        """
        for name, label in self._labels().items():
            schema = self.schema(label)
            found = [e for e in self.entries(label) if (e[0].path, e[1].path) not in without]
            parts = [self._joined([e], schema).withColumn("_package", F.lit(e[0].path)) for e in found]
            none = self._joined([], schema).withColumn("_package", F.lit(""))
            reduce(DataFrame.unionAll, parts or [none]).createOrReplaceTempView(name)
        return self.tables()

    def sql(self, query: str) -> DataFrame:
        """A query over all tables, without the datasets that can have no row for it.

        Catalyst moves the query's conditions down to each dataset's scan; there they are held against its verified
        selectors and its package's key index, as in ``scan``. A dataset that is read more than once goes only if every
        one of its scans can have no row.
        """
        self.register()
        df = self.spark.sql(query)
        datasets = {d.path: (p, d) for p in self.packages for d in p.datasets if d.format == "parquet"}
        asked = [(*datasets[path], where) for path, where in _scans(df) if path in datasets]
        kept = {(p.path, d.path) for (p, d, _), keep in zip(asked, self._may_have(asked), strict=True) if keep}
        gone = {(p.path, d.path) for p, d, _ in asked} - kept
        if not gone:
            return df
        try:
            self.register(gone)
            return self.spark.sql(query)
        finally:
            self.register()

    def preview(self, label: str, rows: int = 500) -> DataFrame:
        return self.scan(label).limit(rows)


def _scans(df: DataFrame) -> list[tuple[str, Predicate]]:
    """Each scan of a package's dataset in the optimized plan: the dataset's path in its package, and the condition that
    stands right above it."""
    found: list[tuple[str, Predicate]] = []

    def walk(node, where: Predicate) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "LogicalRelation":
            relation = node.relation()
            if relation.getClass().getSimpleName() == "HadoopFsRelation":
                paths = relation.location().rootPaths()  # a dataset is named by its first folder
                if paths.size():
                    found.append(("/".join(paths.apply(0).toString().split("/")[-2:]), where))
            return
        if kind == "Filter":
            where = where & of_expression(node.condition())
        else:
            where = Opaque("true")
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), where)
        subqueries = node.subqueries()
        for i in range(subqueries.size()):
            walk(subqueries.apply(i), Opaque("true"))

    walk(df._jdf.queryExecution().optimizedPlan(), Opaque("true"))
    return found
