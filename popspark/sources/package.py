"""Packages: named datasets as Parquet folders with a manifest of definition, statistics and revisions.

``<pkg>/_manifest.json`` names the current file of ``<pkg>/_rev/``; a dataset is a list of folders ``<pkg>/data/<write>``
and key indexes are in ``<pkg>/_index/<write>``. A mutation writes new folders and swaps the manifest, so what is being
read is never written over, unchanged folders are shared by revisions, and every revision can still be read. An append
writes its own rows only; deletions and upserts write anew only the folders that have some of their keys; ``compact``
makes one folder of a dataset's many.

Each dataset's entry has its row count and schema and the selectors that all its rows were seen to fit when it was
written. Only such selectors prune (``plans.catalog``), so unions, appends and upserts can't make pruning wrong.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import model
from ..model import Definition, Selector
from ..operators import mutations, sets
from ..operators.filters import keys_frame
from ..plans.predicates import of_selector
from . import store

FORMAT = 1
AUTHOR = "popspark"
#: Rows of a file, and of a part made by ``partition``.
PART_ROWS = 3_000_000
CODECS = ("zstd", "snappy", "gzip", "lz4", "none")


class PackageError(ValueError):
    pass


@dataclass(frozen=True)
class Dataset:
    label: str
    path: str
    num_rows: int | None
    schema: str  # JSON
    verified: tuple[Selector, ...] = ()
    format: str = "parquet"  # or "table": a catalog table that is only referred to
    added: tuple[tuple[str, int], ...] = ()  # folders after the first, and their rows

    @property
    def folders(self) -> tuple[tuple[str, int], ...]:
        return ((self.path, (self.num_rows or 0) - sum(n for _, n in self.added)), *self.added)

    @property
    def columns(self) -> list[dict[str, Any]]:
        return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in StructType.fromJson(json.loads(self.schema))]


@dataclass(frozen=True)
class KeyIndex:
    column: str
    path: str
    num_keys: int
    low: str | None
    high: str | None


@dataclass(frozen=True)
class Package:
    path: str
    definition: Definition
    datasets: tuple[Dataset, ...]
    index: KeyIndex | None = None

    def dataset(self, label: str) -> Dataset:
        """The first dataset of a label, its case not counted if no label is exactly so."""
        found = next((d for d in self.datasets if d.label == label), None) or next((d for d in self.datasets if d.label.lower() == label.lower()), None)
        if not found:
            raise PackageError(f"no dataset {label!r} in {self.path}: {[d.label for d in self.datasets]}")
        return found

    @property
    def num_rows(self) -> int:
        return sum(d.num_rows or 0 for d in self.datasets)


def _to_json(p: Package) -> str:
    selector = lambda s: Definition("", selectors=(s,)).to_dict()["selectors"][0]
    rows = [{"label": d.label, "path": d.path, "num_rows": d.num_rows, "schema": json.loads(d.schema), "verified": [selector(s) for s in d.verified], "format": d.format, "added": d.added} for d in p.datasets]
    return json.dumps({"format": FORMAT, "definition": p.definition.to_dict(), "datasets": rows, "index": p.index.__dict__ if p.index else None}, default=str)


def _commit(spark: SparkSession, p: Package) -> Package:
    name = f"{p.definition.revision:06d}-{uuid.uuid4().hex[:8]}.json"
    store.write_text(spark, f"{p.path}/_rev/{name}", _to_json(p))
    store.write_text(spark, f"{p.path}/_manifest.json", json.dumps({"format": FORMAT, "current": name}))
    return p


def open_package(spark: SparkSession, path: str, revision: int | None = None) -> Package:
    """The package as its manifest says, no data read; at ``revision`` as it was then."""
    path = path.rstrip("/")
    try:
        manifest = json.loads(store.read_text(spark, f"{path}/_manifest.json"))
    except json.JSONDecodeError as e:
        raise PackageError(f"{path} has a broken manifest") from e
    if manifest.get("format") != FORMAT:
        raise PackageError(f"{path}: unknown format {manifest.get('format')}")
    name = manifest["current"]
    if revision is not None:
        found = sorted(n for n in store.names(spark, f"{path}/_rev") if n.startswith(f"{revision:06d}-"))
        if not found:
            raise PackageError(f"{path} has no revision {revision}")
        name = found[-1]
    d = json.loads(store.read_text(spark, f"{path}/_rev/{name}"))
    rows = tuple(Dataset(x["label"], x["path"], x["num_rows"], json.dumps(x["schema"]), tuple(Selector(**s) for s in x["verified"]), x["format"], tuple((a, n) for a, n in x.get("added", ()))) for x in d["datasets"])
    return Package(path, Definition.from_dict(d["definition"]), rows, KeyIndex(**d["index"]) if d["index"] else None)


def read_dataset(spark: SparkSession, p: Package, label: str) -> DataFrame:
    return frame(spark, p, p.dataset(label))


def frame(spark: SparkSession, p: Package, d: Dataset) -> DataFrame:
    if d.format == "table":
        return spark.table(d.path)
    return _of_folders(spark, p, d, [path for path, _ in d.folders])


def _of_folders(spark: SparkSession, p: Package, d: Dataset, folders: list[str]) -> DataFrame:
    return spark.read.schema(StructType.fromJson(json.loads(d.schema))).parquet(*[f"{p.path}/{x}" for x in folders])


def read_all(spark: SparkSession, p: Package) -> dict[str, DataFrame]:
    return {d.label: frame(spark, p, d) for d in p.datasets}


def _written(root: str, label: str, df: DataFrame, selectors: tuple[Selector, ...], codec: str = "zstd") -> Dataset:
    """Writes a dataset; the rows, and those that a selector doesn't fit, are counted on the way."""
    if codec not in CODECS:
        raise PackageError(f"unknown codec {codec!r}; there are {CODECS}")
    there = {c.lower() for c in df.columns}
    tested = [s for s in selectors if s.field.lower() in there and not s.is_exclusion]
    seen = Observation()
    fits = [F.sum(F.when(F.coalesce(of_selector(s).column(), F.lit(False)), 0).otherwise(1)).alias(f"misses_{i}") for i, s in enumerate(tested)]
    path = f"data/{uuid.uuid4().hex[:12]}"
    kinds = dict(df.dtypes)
    stored = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if kinds[c] == "void" else F.col(f"`{c}`") for c in df.columns])
    stored.observe(seen, F.count(F.lit(1)).alias("rows"), *fits).write.option("compression", codec).option("maxRecordsPerFile", PART_ROWS).parquet(f"{root}/{path}")
    got = seen.get
    verified = tuple(s for i, s in enumerate(tested) if not got.get(f"misses_{i}"))
    return Dataset(label, path, int(got["rows"]), json.dumps(json.loads(stored.schema.json())), verified)


def _indexed(spark: SparkSession, p: Package, column: str) -> KeyIndex:
    """The distinct keys of all datasets that have the column, sorted, so a lookup reads few row groups."""
    parts = [frame(spark, p, d) for d in p.datasets if any(c["name"].lower() == column.lower() for c in d.columns)]
    if not parts:
        raise PackageError(f"no dataset has the key column {column!r}")
    keys = sets.members([x.select(F.col(column).alias("key")) for x in parts], "key", "union")
    path, seen = f"_index/{uuid.uuid4().hex[:12]}", Observation()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys.repartitionByRange(n, "key").sortWithinPartitions("key").observe(seen, F.count(F.lit(1)).alias("n"), F.min("key").cast("string").alias("low"), F.max("key").cast("string").alias("high")).write.option(f"parquet.bloom.filter.enabled#key", "true").parquet(f"{p.path}/{path}")
    got = seen.get
    return KeyIndex(column, path, int(got["n"]), got["low"], got["high"])


def write_package(spark: SparkSession, path: str, definition: Definition, datasets: dict[str, DataFrame], codec: str = "zstd", index: str | None = None) -> Package:
    path = path.rstrip("/")
    rows = tuple(_written(path, label, df, definition.selectors if definition.logic.upper() == "AND" else (), codec) for label, df in datasets.items())
    p = Package(path, definition, rows)
    if definition.history:
        definition = replace(definition, history=(*definition.history[:-1], replace(definition.history[-1], size=p.num_rows)))
    else:
        definition = replace(definition, history=(model.Revision(definition.revision, "Create", definition.created_by or AUTHOR, model.now(), (), p.num_rows),))
    p = replace(p, definition=definition)
    return _commit(spark, replace(p, index=_indexed(spark, p, index) if index else None))


def reference_package(spark: SparkSession, path: str, definition: Definition, tables: dict[str, str]) -> Package:
    """A package of metadata that points at catalog tables."""
    rows = tuple(Dataset(label, t, None, spark.table(t).schema.json(), (), "table") for label, t in tables.items())
    return _commit(spark, Package(path.rstrip("/"), definition, rows))


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """One row for each dataset, from the manifest alone."""
    p = open_package(spark, path)
    rows = [(p.definition.name, p.definition.revision, d.label, d.format, d.num_rows, len(d.columns), [f"{c['name']}: {c['type']}" for c in d.columns], p.index.column if p.index else None) for d in p.datasets]
    return spark.createDataFrame(rows, "name string, revision int, label string, format string, num_rows long, num_columns int, columns array<string>, key_index string")


def revisions(spark: SparkSession, path: str) -> DataFrame:
    history = open_package(spark, path).definition.history
    return spark.createDataFrame([(r.number, r.message, r.author, r.date, r.size, len(r.deltas), r.origin) for r in history], "revision int, message string, author string, date string, size long, deltas int, origin string")


# Mutations. Each writes what changes, and swaps the manifest. ``output`` makes a new package instead.


def _changed(spark: SparkSession, p: Package, datasets: tuple[Dataset, ...], message: str, author: str, output: str | None, definition: Definition | None = None, data_changed: bool = True) -> Package:
    if output and output.rstrip("/") != p.path:
        target = output.rstrip("/")
        copied = tuple(d if d.format == "table" or store.exists(spark, f"{target}/{d.path}") else replace(_written(target, d.label, frame(spark, p, d), d.verified), label=d.label) for d in datasets)
        p, datasets, data_changed = Package(target, p.definition, copied), copied, True
    size = sum(d.num_rows or 0 for d in datasets)
    definition = definition or model.bump(p.definition, message, author, size)
    # An index describes the data of one revision; it never outlives a change of them.
    return _commit(spark, Package(p.path, definition, datasets, None if data_changed else p.index))


def _root(p: Package, output: str | None) -> str:
    return (output or p.path).rstrip("/")


def append(spark: SparkSession, path: str, rows: DataFrame, label: str | None = None, *, output: str | None = None, message: str = "Append", author: str = AUTHOR) -> Package:
    """Rows added to a dataset, made if its label is new. Without a label: to the one dataset of just this schema."""
    p = open_package(spark, path)
    kind = {f.name: f.dataType for f in rows.schema}
    if label is None:
        fits = [d for d in p.datasets if {f.name: f.dataType for f in StructType.fromJson(json.loads(d.schema))} == kind]
        if len(fits) != 1:
            raise PackageError(f"{len(fits)} datasets have this schema; give a label")
        label = fits[0].label
    old = next((d for d in p.datasets if d.label == label), None)
    data = mutations.append(frame(spark, p, old), rows) if old else rows  # refuses another schema
    if old and old.format == "parquet" and _root(p, output) == p.path:
        new = _grown(old, old.folders, _written(p.path, label, rows.select(*data.columns), old.verified))
    else:
        new = _written(_root(p, output), label, data, p.definition.selectors)
    return _changed(spark, p, tuple(new if d.label == label else d for d in p.datasets) if old else (*p.datasets, new), message, author, output)


def _grown(old: Dataset, kept: tuple[tuple[str, int], ...], new: Dataset) -> Dataset:
    """``old`` with its folders ``kept`` and those of ``new``; verified is what both are."""
    folders = (*kept, *(new.folders if new.num_rows or not kept else ()))
    verified = tuple(s for s in old.verified if s in new.verified) if new.num_rows else old.verified
    return replace(old, path=folders[0][0], num_rows=sum(n for _, n in folders), verified=verified, added=tuple(folders[1:]))


def _met(spark: SparkSession, p: Package, d: Dataset, keys: DataFrame, on: list[str]) -> list[str]:
    """The folders of a dataset that have a row of ``keys``. Only the key columns are read."""
    if len(d.folders) == 1:
        return [d.path]
    at = F.regexp_extract(F.col("_metadata.file_path"), "(data/[^/]+)/[^/]*$", 1).alias("__folder")
    rows = frame(spark, p, d).select(*[F.col(f"`{c}`") for c in on], at)
    found = rows.join(keys.select(*[F.col(f"`{c}`") for c in on]).distinct(), on, "left_semi").select("__folder").distinct()
    return [r[0] for r in found.collect()]  # one short text for each folder


def _rewritten(spark: SparkSession, p: Package, d: Dataset, root: str, keys: DataFrame, on: list[str], change: Callable[[DataFrame], DataFrame]) -> Dataset:
    """A dataset whose rows ``change`` alters only where they have one of ``keys``; it may also add rows."""
    if d.format == "table" or root != p.path:
        return _written(root, d.label, change(frame(spark, p, d)), p.definition.selectors)
    met = _met(spark, p, d, keys, on)
    kept = tuple(f for f in d.folders if f[0] not in met)
    base = _of_folders(spark, p, d, met) if met else spark.createDataFrame([], frame(spark, p, d).schema)
    new = _written(root, d.label, change(base), d.verified if kept else p.definition.selectors)
    return _grown(d, kept, new) if kept else new


def compact(spark: SparkSession, path: str, label: str, *, message: str = "Compact", author: str = AUTHOR) -> Package:
    """One folder for a dataset's many; the rows are the same, and its key index stays."""
    p = open_package(spark, path)
    d = p.dataset(label)
    if d.format == "table" or len(d.folders) == 1:
        return p
    new = _written(p.path, d.label, frame(spark, p, d), p.definition.selectors)
    return _changed(spark, p, tuple(new if x == d else x for x in p.datasets), message, author, None, data_changed=False)


def delete_rows(spark: SparkSession, path: str, key: str, values: list[Any], *, output: str | None = None, message: str = "Delete rows", author: str = AUTHOR) -> Package:
    """Rows of these keys deleted from every dataset; each must have the key. Emptied datasets go."""
    p, out = open_package(spark, path), []
    for d in p.datasets:
        if key.lower() not in {c["name"].lower() for c in d.columns}:
            raise PackageError(f"dataset {d.label!r} has no column {key!r}")
    for d in p.datasets:
        keys = keys_frame(frame(spark, p, d), key, values)
        new = _rewritten(spark, p, d, _root(p, output), keys, [key], lambda data, keys=keys: mutations.delete_rows(data, keys, key))
        out += [new] if new.num_rows else []
    return _changed(spark, p, tuple(out), message, author, output)


def delete_dataset(spark: SparkSession, path: str, label: str, *, output: str | None = None, message: str = "Delete dataset", author: str = AUTHOR) -> Package:
    p = open_package(spark, path)
    gone = p.dataset(label)
    return _changed(spark, p, tuple(d for d in p.datasets if d != gone), message, author, output)


def delete_selectors(spark: SparkSession, path: str, ids: list[str], *, output: str | None = None, message: str = "Delete selectors", author: str = AUTHOR) -> Package:
    return annotate(spark, path, remove=ids, output=output, message=message, author=author)


def annotate(spark: SparkSession, path: str, *, name: str | None = None, description: str | None = None, add: list[Selector] = (), remove: list[str] = (), output: str | None = None, message: str = "Annotate", author: str = AUTHOR) -> Package:
    p = open_package(spark, path)
    d = model.annotated(p.definition, name=name, description=description, add=add, remove=remove, message=message, author=author, size=p.num_rows)
    return _changed(spark, p, p.datasets, message, author, output, d, data_changed=False)


def upsert(spark: SparkSession, path: str, label: str, key: str, rows: DataFrame, *, output: str | None = None, message: str = "Upsert", author: str = AUTHOR) -> Package:
    p = open_package(spark, path)
    old = next((d for d in p.datasets if d.label == label), None)
    if old:
        new = _rewritten(spark, p, old, _root(p, output), rows, [key], lambda data: mutations.upsert(data, rows, key))
    else:
        new = _written(_root(p, output), label, rows, p.definition.selectors)
    return _changed(spark, p, tuple(new if d.label == label else d for d in p.datasets) if old else (*p.datasets, new), message, author, output)


def upsert_keys(spark: SparkSession, path: str, label: str, rows: DataFrame, keys: list[str] | None = None, **kw) -> tuple[int, int]:
    """An upsert on several columns, or the package's primary keys; gives rows updated and inserted."""
    p = open_package(spark, path)
    keys = keys or list(p.definition.primary_keys)
    if not keys:
        raise PackageError("no keys given and no primary keys set")
    old = p.dataset(label)
    updated, inserted = mutations.upsert_counted(frame(spark, p, old), rows, keys)[1].first()
    new = _rewritten(spark, p, old, p.path, rows, keys, lambda data: mutations.upsert_counted(data, rows, keys)[0])
    _changed(spark, p, tuple(new if d == old else d for d in p.datasets), kw.get("message", "Upsert"), kw.get("author", AUTHOR), None)
    return int(updated), int(inserted)


def append_package(spark: SparkSession, source: str, target: str, label: str | None = None, **kw) -> int:
    """One dataset of a package added to another; gives its rows."""
    if source.rstrip("/") == target.rstrip("/"):
        raise PackageError("a package can't be appended to itself")
    p = open_package(spark, source)
    if label is None and len(p.datasets) != 1:
        raise PackageError("choose one of the datasets")
    d = p.dataset(label) if label else p.datasets[0]
    append(spark, target, frame(spark, p, d), d.label, **kw)
    return d.num_rows if d.num_rows is not None else frame(spark, p, d).count()


def increment(spark: SparkSession, path: str, label: str, key: str, steps: list[tuple[DataFrame | None, DataFrame | None]], *, message: str = "Increment", author: str = AUTHOR) -> Package:
    p = open_package(spark, path)
    d = p.dataset(label)
    new = _written(p.path, d.label, mutations.increment(frame(spark, p, d), steps, key), p.definition.selectors)
    return _changed(spark, p, tuple(new if x == d else x for x in p.datasets), message, author, None)


def apply_revision(spark: SparkSession, path: str, entry: model.Revision) -> Package:
    p = open_package(spark, path)
    return _commit(spark, replace(p, definition=model.apply_revision(p.definition, entry)))


# Set algebra on packages.


def _combined(spark: SparkSession, paths: list[str], output: str, name: str | None, operation: str, combine: Callable[[str, list[DataFrame]], DataFrame | None], every: bool) -> Package:
    parts = [open_package(spark, x) for x in paths]
    labels = sorted({d.label for p in parts for d in p.datasets})
    if every:
        labels = [x for x in labels if all(any(d.label == x for d in p.datasets) for p in parts)]
    names = [p.definition.name for p in parts]
    title = name or f"{operation} of {', '.join(names)}"
    draft = model.merged([(p.path, p.definition) for p in parts], title, operation.lower(), f"{operation} of {', '.join(names)}", AUTHOR, 0)
    root, out = output.rstrip("/"), []
    for label in labels:
        new = _written(root, label, combine(label, [read_dataset(spark, p, label) for p in parts if any(d.label == label for d in p.datasets)]), draft.selectors)
        if new.num_rows or not every:
            out.append(new)
    done = Package(root, draft, tuple(out))
    history = (*draft.history[:-1], replace(draft.history[-1], size=done.num_rows))
    return _commit(spark, replace(done, definition=replace(draft, history=history)))


def union(spark: SparkSession, paths: list[str], output: str, name: str | None = None) -> Package:
    if not paths:
        raise PackageError("No input files")
    return _combined(spark, paths, output, name, "Union", lambda _, parts: sets.union(parts), False)


merge = union


def intersect(spark: SparkSession, paths: list[str], output: str, on: str, name: str | None = None) -> Package:
    """Rows of labels that all inputs have, with keys that all inputs have in that label."""
    if len(paths) < 2:
        raise PackageError("intersect needs at least 2 inputs")
    parts = [open_package(spark, x) for x in paths]
    indexes = [p.index for p in parts]
    if all(i and i.column.lower() == on.lower() for i in indexes):
        keys = [spark.read.parquet(f"{p.path}/{p.index.path}") for p in parts]
        if sets.shared_keys(keys, "key").isEmpty():  # indexes cover all datasets, so no label can share a key
            names = [p.definition.name for p in parts]
            empty = model.merged([(p.path, p.definition) for p in parts], name or f"Intersect of {', '.join(names)}", "intersect", "Intersect", AUTHOR, 0)
            return _commit(spark, Package(output.rstrip("/"), empty, ()))
    return _combined(spark, paths, output, name, "Intersect", lambda _, frames: sets.intersect(frames, on), True)


def merge_references(spark: SparkSession, paths: list[str], output: str, name: str | None = None) -> Package:
    """Packages of table references joined without moving data; a table once."""
    parts = [open_package(spark, x) for x in paths]
    tables = {d.path: d for p in parts for d in p.datasets}
    if any(d.format != "table" for d in tables.values()):
        raise PackageError("only packages of references can be merged without moving data")
    d = model.merged([(p.path, p.definition) for p in parts], name or "Merge", "merge", "Merge", AUTHOR, 0)
    return _commit(spark, Package(output.rstrip("/"), d, tuple(tables.values())))


def partition(spark: SparkSession, path: str, output: str, key: str, parts: int | None = None, rows: int | None = None) -> list[Package]:
    """Packages of rising key ranges, the same ranges for all datasets; ``parts``, or about ``rows`` rows each."""
    p = open_package(spark, path)
    n = parts or (math.ceil(p.num_rows / rows) if rows else max(spark.sparkContext.defaultParallelism, math.ceil(p.num_rows / PART_ROWS)))
    if n <= 1:
        raise PackageError("one part is no partition")
    keys = sets.members([frame(spark, p, d).select(F.col(key).alias("key")) for d in p.datasets], "key", "union")
    edges = [r[0] for r in keys.repartitionByRange(n, "key").groupBy(F.spark_partition_id()).agg(F.max("key").alias("m")).orderBy("m").select("m").collect()]  # one for each part
    roots = [f"{output.rstrip('/')}/part-{i:05d}" for i in range(len(edges))]
    dealt = [_dealt(spark, p, x, key, edges[:-1], roots) for x in p.datasets]
    out = []
    for i, root in enumerate(roots):
        d = replace(p.definition, name=f"{p.definition.name} part {i + 1} of {len(edges)}", lineage=replace(p.definition.lineage, parents=(p.path,), operation="partition"))
        part = Package(root, d, tuple(x[i] for x in dealt))
        entry = model.Revision(d.revision, "Create", d.created_by or AUTHOR, model.now(), (), part.num_rows)
        history = (*d.history[:-1], replace(d.history[-1], size=part.num_rows)) if d.history else (entry,)
        out.append(_commit(spark, replace(part, definition=replace(d, history=history))))
    return out


def _dealt(spark: SparkSession, p: Package, d: Dataset, key: str, edges: list[Any], roots: list[str]) -> list[Dataset]:
    """A dataset cut at ``edges`` into one dataset for each root: one pass over its rows, one folder moved to each root.

    Null keys are in the first part. Rows are dealt by part and a hash, so that a key which many rows have is written by
    several tasks.
    """
    df = frame(spark, p, d)
    k, kinds = F.col(key), dict(df.dtypes)
    if "__part" in map(str.lower, kinds):
        raise PackageError(f"dataset {d.label!r} has a column __part")
    bounds = F.array(*map(F.lit, edges)).cast(f"array<{next(t for c, t in kinds.items() if c.lower() == key.lower())}>")
    number = F.when(k.isNull() | F.lit(not edges), 0).otherwise(F.size(F.filter(bounds, lambda e: e < k)))
    shape = [F.col(f"`{c}`").cast("string").alias(c) if kind == "void" else F.col(f"`{c}`") for c, kind in kinds.items()]
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c, kind in kinds.items() if "map<" not in kind])
    name, at = f"data/{uuid.uuid4().hex[:12]}", f"{roots[0].rsplit('/', 1)[0]}/_dealt-{uuid.uuid4().hex[:12]}"
    stored = df.select(*shape)
    files = max(len(roots), int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = stored.withColumn("__part", number.cast("int")).repartitionByRange(files, F.col("__part"), hashed)
    placed.write.option("compression", "zstd").option("maxRecordsPerFile", PART_ROWS).partitionBy("__part").parquet(at)
    there = {c.lower() for c in kinds}
    tested = [s for s in (p.definition.selectors if p.definition.logic.upper() == "AND" else ()) if s.field.lower() in there and not s.is_exclusion]
    misses = [F.sum(F.when(F.coalesce(of_selector(s).column(), F.lit(False)), 0).otherwise(1)).alias(f"misses_{i}") for i, s in enumerate(tested)]
    schema = StructType([*stored.schema.fields, StructField("__part", IntegerType())])
    seen = {r["__part"]: r for r in spark.read.schema(schema).parquet(at).groupBy("__part").agg(F.count(F.lit(1)).alias("rows"), *misses).collect()}
    out = []
    for i, root in enumerate(roots):
        r = seen.get(i)
        if r:
            store.move(spark, f"{at}/__part={i}", f"{root}/{name}")
        else:
            store.folder(spark, f"{root}/{name}")
        verified = tuple(s for j, s in enumerate(tested) if not r or not r[f"misses_{j}"])
        out.append(Dataset(d.label, name, int(r["rows"]) if r else 0, json.dumps(json.loads(stored.schema.json())), verified))
    store.delete(spark, at, True)
    return out


# Comparison.


def content_hash(df: DataFrame) -> tuple[int, int]:
    """Rows and a hash that doesn't depend on their order."""
    n, h = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns]).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return int(n), int(h)


def diff(spark: SparkSession, left: str, right: str, key: str | None = None) -> dict[str, Any]:
    """What differs between two packages: texts, selectors, lineage, each dataset, and the overlap of their keys."""
    a, b = open_package(spark, left), open_package(spark, right)
    status, x, y = {}, {d.label: d for d in a.datasets}, {d.label: d for d in b.datasets}
    for label in sorted(x.keys() | y.keys()):
        if label not in y or label not in x:
            status[label] = "removed" if label not in y else "added"
        else:
            p, q = x[label], y[label]
            same = (p.num_rows, [(c["name"], c["type"]) for c in p.columns]) == (q.num_rows, [(c["name"], c["type"]) for c in q.columns])
            status[label] = "same" if same and ((a.path, p.path) == (b.path, q.path) or content_hash(frame(spark, a, p)) == content_hash(frame(spark, b, q))) else "modified"
    overlap = None
    if a.index and b.index and a.index.column.lower() == b.index.column.lower() and (key is None or key.lower() == a.index.column.lower()):
        overlap = sets.overlap_stats(*[spark.read.parquet(f"{p.path}/{p.index.path}") for p in (a, b)], "key").first().asDict()
    p, q = a.definition, b.definition
    return {"name": None if p.name == q.name else (p.name, q.name), "description": None if p.description == q.description else (p.description, q.description), "selectors": model.selector_changes(p.selectors, q.selectors), "lineage": None if p.lineage == q.lineage else (p.lineage, q.lineage), "datasets": status, "overlap": overlap}


def diff_text(d: dict[str, Any]) -> str:
    lines = [f"{k}: {d[k][0]!r} -> {d[k][1]!r}" for k in ("name", "description") if d[k]]
    lines += [f"+ selector {s.selector_id}" for s in d["selectors"]["added"]] + [f"- selector {s.selector_id}" for s in d["selectors"]["removed"]]
    lines += [f"~ selector {i}.{f}: {x!r} -> {y!r}" for i, f, x, y in d["selectors"]["modified"]]
    lines += ["lineage differs"] * bool(d["lineage"]) + [f"dataset {k}: {v}" for k, v in d["datasets"].items()]
    if d["overlap"]:
        lines.append("overlap: " + ", ".join(f"{k}={v}" for k, v in d["overlap"].items()))
    return "\n".join(lines) or "no differences"


def inspect_text(spark: SparkSession, path: str) -> str:
    p = open_package(spark, path)
    d = p.definition
    lines = [f"{d.name} (revision {d.revision})", d.description, f"logic: {d.logic}"]
    lines += [f"selector {s.selector_id}: {'not ' if s.is_exclusion else ''}{s.field} {s.operator} {s.values}" for s in d.selectors]
    lines += [f"dataset {x.label}: {x.num_rows} rows, {len(x.columns)} columns" for x in p.datasets]
    return "\n".join(x for x in lines if x)
