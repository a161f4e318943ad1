"""Command line over packages: ``python -m popspark.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import json

from .model import Definition, Selector
from .plans.catalog import Catalog
from .session import session
from .sources import files, package


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="popspark", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, /, *arguments: str, **options: dict) -> None:
        p = sub.add_parser(name)
        for a in arguments:
            p.add_argument(a, **({"nargs": "+"} if a in ("inputs", "values", "ids") else {}))
        for o, kw in options.items():
            p.add_argument(f"--{o.replace('_', '-')}", **kw)

    command("write", "output", "label", "data", name={"default": "population"}, index={})
    command("inspect", "path")
    command("revisions", "path")
    command("read", "path", "label", limit={"type": int, "default": 20})
    command("union", "output", "inputs", name={})
    command("intersect", "output", "on", "inputs", name={})
    command("diff", "left", "right")
    command("diff-revisions", "path", "a", "b")
    command("append", "path", "data", label={})
    command("upsert", "path", "label", "key", "data")
    command("delete-rows", "path", "key", "values")
    command("delete-dataset", "path", "label")
    command("delete-selectors", "path", "ids")
    command("annotate", "path", name={}, description={}, add={"action": "append", "default": [], "help": "a selector as JSON"}, remove={"action": "append", "default": []})
    command("partition", "path", "output", "key", parts={"type": int}, rows={"type": int})
    command("tables", "folder")
    command("schema", "folder", "label")
    command("sql", "folder", "query", limit={"type": int, "default": 500})
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session("popspark-cli")
    done = lambda p: print(f"{p.path}: revision {p.definition.revision}, {p.num_rows} rows")
    match a.command:
        case "write":
            done(package.write_package(spark, a.output, Definition(a.name), {a.label: files.read_file(spark, a.data)}, index=a.index))
        case "inspect":
            print(package.inspect_text(spark, a.path))
        case "revisions":
            package.revisions(spark, a.path).show(truncate=False)
        case "read":
            package.read_dataset(spark, package.open_package(spark, a.path), a.label).limit(a.limit).show(a.limit, truncate=False)
        case "union":
            done(package.union(spark, a.inputs, a.output, a.name))
        case "intersect":
            done(package.intersect(spark, a.inputs, a.output, a.on, a.name))
        case "diff":
            print(package.diff_text(package.diff(spark, a.left, a.right)))
        case "diff-revisions":
            from .model import diff_revisions

            print(json.dumps(diff_revisions(package.open_package(spark, a.path).definition, int(a.a), int(a.b)), default=lambda x: x.__dict__))
        case "append":
            done(package.append(spark, a.path, files.read_file(spark, a.data), a.label))
        case "upsert":
            done(package.upsert(spark, a.path, a.label, a.key, files.read_file(spark, a.data)))
        case "delete-rows":
            done(package.delete_rows(spark, a.path, a.key, a.values))
        case "delete-dataset":
            done(package.delete_dataset(spark, a.path, a.label))
        case "delete-selectors":
            done(package.delete_selectors(spark, a.path, a.ids))
        case "annotate":
            done(package.annotate(spark, a.path, name=a.name, description=a.description, add=[Selector(**json.loads(s)) for s in a.add], remove=a.remove))
        case "partition":
            for p in package.partition(spark, a.path, a.output, a.key, a.parts, a.rows):
                done(p)
        case "tables":
            print("\n".join(Catalog(spark, a.folder).tables()))
        case "schema":
            print("\n".join(f"{f.name}: {f.dataType.simpleString()}" for f in Catalog(spark, a.folder).schema(a.label)))
        case "sql":
            Catalog(spark, a.folder).sql(a.query).limit(a.limit).show(a.limit, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
