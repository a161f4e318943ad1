"""Where packages come from, as nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.package import Package


def graph(spark: SparkSession, packages: list[Package]) -> tuple[DataFrame, DataFrame]:
    """nodes(id, kind, name) and edges(source, target, kind): systems, tables, packages and their parents."""
    nodes: dict[str, tuple[str, str, str]] = {}
    edges: dict[tuple[str, str, str], None] = {}

    def node(kind: str, name: str) -> str:
        nodes.setdefault(f"{kind}:{name}", (f"{kind}:{name}", kind, name))
        return f"{kind}:{name}"

    for p in packages:
        line, me = p.definition.lineage, node("package", p.path)
        for t in line.source_tables:
            edges[(node("table", t), me, "extracted")] = None
            for s in line.source_system:
                edges[(node("system", s), node("table", t), "holds")] = None
        if not line.source_tables:
            for s in line.source_system:
                edges[(node("system", s), me, "extracted")] = None
        for parent in line.parents:
            edges[(node("package", parent), me, line.operation or "derived")] = None
    return spark.createDataFrame(sorted(nodes.values()), "id string, kind string, name string"), spark.createDataFrame(sorted(edges), "source string, target string, kind string")
