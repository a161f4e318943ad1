"""Packages: round trips, mutations, history, set algebra, pruning."""

import os

import pytest
from pyspark.sql import functions as F

from popspark import cli
from popspark.model import Definition, Delta, Lineage, ModelError, Revision, Selector
from popspark.operators import lineage
from popspark.plans.catalog import Catalog
from popspark.sources import files, package, store, universe, variants
from popspark.sources.package import PackageError

KEYS = "patient_id int, diagnosis string"


def rows(spark, ids, dx="E11.0"):
    return spark.createDataFrame([(i, dx) for i in ids], KEYS)


def make(spark, path, ids, index=None, dx="E11.0", selectors=(), label="Claims-v1", **kw):
    return package.write_package(spark, str(path), Definition(path.name, selectors=selectors, **kw), {label: rows(spark, ids, dx)}, index=index)


def ids_of(spark, p, label="Claims-v1"):
    return sorted((r[0] for r in package.read_dataset(spark, p, label).collect()), key=lambda x: (x is None, x))


def test_round_trip_and_inspect(spark, tmp_path):
    p = make(spark, tmp_path / "a", [1, 2, 3], "patient_id")
    again = package.open_package(spark, p.path)
    assert again == p and ids_of(spark, again) == [1, 2, 3] and again.num_rows == 3 and again.definition.history[0].size == 3
    assert (again.index.num_keys, again.index.low, again.index.high) == (3, "1", "3")
    r = package.inspect(spark, p.path).first()
    assert (r.label, r.num_rows, r.num_columns, r.key_index) == ("Claims-v1", 3, 2, "patient_id")
    assert package.read_dataset(spark, p, "CLAIMS-V1").count() == 3 and "3 rows" in package.inspect_text(spark, p.path)
    with pytest.raises(PackageError):
        p.dataset("none")


def test_broken_manifests_are_refused(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        package.open_package(spark, str(tmp_path / "none"))
    for text in ("{", '{"format": 9, "current": "x"}'):
        store.write_text(spark, str(tmp_path / "bad/_manifest.json"), text)
        with pytest.raises(PackageError):
            package.open_package(spark, str(tmp_path / "bad"))
    p = make(spark, tmp_path / "a", [1])
    with pytest.raises(PackageError, match="no revision"):
        package.open_package(spark, p.path, 7)
    with pytest.raises(PackageError, match="codec"):
        package.write_package(spark, str(tmp_path / "c"), Definition("c"), {"x": rows(spark, [1])}, codec="vortex")


def test_union(spark, tmp_path):
    a, b = make(spark, tmp_path / "a", [1, 2, 3]), make(spark, tmp_path / "b", [1, 2, 3])
    u = package.union(spark, [a.path, b.path], str(tmp_path / "u"))
    assert u.num_rows == 6 and u.definition.name.startswith("Union of") and u.definition.history[-1].size == 6 and u.definition.revision == 2
    with pytest.raises(PackageError, match="No input files"):
        package.union(spark, [], str(tmp_path / "n"))
    other = package.write_package(spark, str(tmp_path / "s"), Definition("s"), {"Claims-v1": spark.createDataFrame([("1", "x")], "patient_id string, diagnosis string")})
    with pytest.raises(ValueError, match="Schema mismatch"):
        package.union(spark, [a.path, other.path], str(tmp_path / "m"))


@pytest.mark.parametrize("index", [None, "patient_id"])
def test_intersect(spark, tmp_path, index):
    a, b, c = make(spark, tmp_path / "a", [1, 2, 3, None], index), make(spark, tmp_path / "b", [2, 3, 4, None], index), make(spark, tmp_path / "c", [8], index)
    both = package.intersect(spark, [a.path, b.path], str(tmp_path / "i"), "patient_id")
    assert ids_of(spark, both) == [2, 2, 3, 3]
    assert package.intersect(spark, [a.path, c.path], str(tmp_path / "n"), "patient_id").datasets == ()
    with pytest.raises(PackageError, match="at least 2"):
        package.intersect(spark, [a.path], str(tmp_path / "x"), "patient_id")


def test_append_rules(spark, tmp_path):
    p = make(spark, tmp_path / "a", [1, 2])
    package.append(spark, p.path, rows(spark, [2]))
    package.append(spark, p.path, rows(spark, [9]), "New")
    p = package.open_package(spark, p.path)
    assert ids_of(spark, p) == [1, 2, 2] and ids_of(spark, p, "New") == [9] and p.definition.revision == 3
    with pytest.raises(PackageError, match="2 datasets"):
        package.append(spark, p.path, rows(spark, [1]))
    with pytest.raises(PackageError, match="0 datasets"):
        package.append(spark, p.path, spark.range(1))
    assert ids_of(spark, package.open_package(spark, p.path, 1)) == [1, 2]  # time travel


def test_changes_write_only_the_folders_they_meet(spark, tmp_path):
    p = make(spark, tmp_path / "c/a", [1, 2, None], "patient_id", selectors=(Selector("s", "diagnosis", "eq", "E11.0"),))
    for ids in ([3, 4], [5, 6]):
        p = package.append(spark, p.path, rows(spark, ids))
    first, second, third = p.datasets[0].folders
    assert [first[1], second[1], third[1]] == [3, 2, 2] and p.num_rows == 7 and [s.selector_id for s in p.datasets[0].verified] == ["s"]
    assert package.open_package(spark, p.path) == p and ids_of(spark, p) == [1, 2, 3, 4, 5, 6, None]
    p = package.delete_rows(spark, p.path, "patient_id", [4])
    assert first in p.datasets[0].folders and third in p.datasets[0].folders and second not in p.datasets[0].folders
    assert package.delete_rows(spark, p.path, "patient_id", [99]).datasets == p.datasets
    p = package.upsert(spark, p.path, "Claims-v1", "patient_id", rows(spark, [5, None, 8], "new"))
    assert first in p.datasets[0].folders and third not in p.datasets[0].folders and p.datasets[0].verified == ()
    assert ids_of(spark, p) == [1, 2, 3, 5, 6, 8, None, None] and p.num_rows == 8
    assert package.upsert_keys(spark, p.path, "Claims-v1", rows(spark, [1, 9]), ["patient_id"]) == (1, 1)
    c = Catalog(spark, str(tmp_path / "c"))
    assert sorted(r[0] for r in c.sql("SELECT patient_id FROM claims_v1 WHERE diagnosis = 'new' AND patient_id > 0").collect()) == [5, 8]
    q = package.compact(spark, p.path, "Claims-v1")
    assert len(q.datasets[0].folders) == 1 and ids_of(spark, q) == [1, 2, 3, 5, 6, 8, 9, None, None]
    assert ids_of(spark, package.open_package(spark, p.path, 1)) == [1, 2, None]
    copy = package.append(spark, q.path, rows(spark, [7]), output=str(tmp_path / "copy"))
    assert ids_of(spark, copy) == [1, 2, 3, 5, 6, 7, 8, 9, None, None] and ids_of(spark, package.open_package(spark, q.path)) == ids_of(spark, q)


def test_pruning_after_appends_is_sound(spark, tmp_path):
    p = make(spark, tmp_path / "c/a", [1], dx="A", selectors=(Selector("s", "diagnosis", "eq", "A"),))
    package.append(spark, p.path, rows(spark, [2], "A"))
    c = Catalog(spark, str(tmp_path / "c"))
    assert c.sql("SELECT * FROM claims_v1 WHERE diagnosis = 'B'").count() == 0 and c.scan("Claims-v1", "diagnosis = 'A'").count() == 2
    package.append(spark, p.path, rows(spark, [3], "B"))
    c.refresh()
    assert c.sql("SELECT * FROM claims_v1 WHERE diagnosis = 'B'").count() == 1 and c.scan("Claims-v1", "diagnosis = 'B'").count() == 1


def test_text_is_replaced(spark, tmp_path):
    for text in ("one", "two"):
        store.write_text(spark, str(tmp_path / "d/x.json"), text)
        assert store.read_text(spark, str(tmp_path / "d/x.json")) == text
    assert [n for n in store.names(spark, str(tmp_path / "d")) if n.endswith(".new")] == []


def test_delete_rows_keeps_null_keys_and_drops_emptied_datasets(spark, tmp_path):
    p = package.write_package(spark, str(tmp_path / "a"), Definition("a"), {"A": rows(spark, [1, 2, None]), "B": rows(spark, [2])})
    p = package.delete_rows(spark, p.path, "patient_id", ["2", "x"])
    assert ids_of(spark, p, "A") == [1, None] and [d.label for d in p.datasets] == ["A"]
    with pytest.raises(PackageError, match="no column"):
        package.delete_rows(spark, p.path, "none", [1])
    with pytest.raises(PackageError):
        package.delete_dataset(spark, p.path, "B")
    assert package.delete_dataset(spark, p.path, "A", output=str(tmp_path / "copy")).datasets == ()
    assert ids_of(spark, package.open_package(spark, p.path), "A") == [1, None]


def test_upsert_adds_what_comes_as_it_is(spark, tmp_path):
    p = make(spark, tmp_path / "a", [1, 2, 3])
    p = package.upsert(spark, p.path, "Claims-v1", "patient_id", rows(spark, [2, 2, None, 7], "new"))
    assert ids_of(spark, p) == [1, 2, 2, 3, 7, None]
    again = package.upsert(spark, p.path, "Claims-v1", "patient_id", rows(spark, [2, 2, 7], "new"))
    assert ids_of(spark, again) == [1, 2, 2, 3, 7, None]
    assert package.upsert_keys(spark, p.path, "Claims-v1", rows(spark, [1, 99], "E11.0"), ["patient_id", "diagnosis"]) == (1, 1)
    with pytest.raises(PackageError, match="no keys"):
        package.upsert_keys(spark, p.path, "Claims-v1", rows(spark, [1]))


def test_increment_is_a_fold_of_deletes_and_adds(spark, tmp_path):
    p = make(spark, tmp_path / "a", [1, 2, 3, None])
    steps = [(rows(spark, [1]).select("patient_id"), rows(spark, [1, 5])), (rows(spark, [5]).select("patient_id"), rows(spark, [6])), (None, rows(spark, [5]))]
    assert ids_of(spark, package.increment(spark, p.path, "Claims-v1", "patient_id", steps)) == [1, 2, 3, 5, 6, None]


def test_append_package(spark, tmp_path):
    a, b = make(spark, tmp_path / "a", [1]), make(spark, tmp_path / "b", [2, 3])
    assert package.append_package(spark, b.path, a.path) == 2 and ids_of(spark, package.open_package(spark, a.path)) == [1, 2, 3]
    with pytest.raises(PackageError, match="itself"):
        package.append_package(spark, a.path, a.path)


def test_annotate_keeps_data_and_index(spark, tmp_path):
    p = make(spark, tmp_path / "a", [1], "patient_id", selectors=(Selector("s", "diagnosis", "eq", "E11.0"),))
    q = package.annotate(spark, p.path, name="n", add=[Selector("t", "patient_id", "gt", 0)], remove=["s"])
    assert q.datasets == p.datasets and q.index == p.index and q.definition.name == "n" and [s.selector_id for s in q.definition.selectors] == ["t"]
    q = package.delete_selectors(spark, p.path, ["t", "none"])
    assert q.definition.selectors == () and q.definition.revision == 3
    q = package.apply_revision(spark, p.path, Revision(4, deltas=(Delta("add", "z", body=Selector("z", "x", "eq", 1)),)))
    assert package.open_package(spark, p.path).definition.selector("z")
    with pytest.raises(ModelError):
        package.apply_revision(spark, p.path, Revision(9))


def test_partition_by_key_ranges(spark, tmp_path):
    p = package.write_package(spark, str(tmp_path / "a"), Definition("a"), {"A": rows(spark, [*range(40), None]), "B": rows(spark, [*range(20, 60)])})
    made = package.partition(spark, p.path, str(tmp_path / "parts"), "patient_id", parts=3)
    assert len(made) == 3 and sum(x.num_rows for x in made) == 81
    spans = [sorted(i for d in ("A", "B") for i in ids_of(spark, x, d) if i is not None) for x in made]
    assert all(a[-1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert None in ids_of(spark, made[0], "A") and all(x.num_rows == sum(len(ids_of(spark, x, d.label)) for d in x.datasets) for x in made)
    assert [x.definition.history[-1].size for x in made] == [x.num_rows for x in made] and package.open_package(spark, made[1].path) == made[1]
    hot = package.write_package(spark, str(tmp_path / "hot"), Definition("hot", selectors=(Selector("s", "diagnosis", "eq", "x"),)), {"A": rows(spark, [5] * 300, "x"), "B": rows(spark, [1, 9], "y")})
    parts = package.partition(spark, hot.path, str(tmp_path / "hot-parts"), "patient_id", parts=3)
    assert sum(x.num_rows for x in parts) == 302 and sum(x.dataset("A").num_rows == 300 for x in parts) == 1
    assert all([s.selector_id for s in x.dataset("A").verified] == ["s"] for x in parts) and not store.exists(spark, str(tmp_path / "hot-parts/_dealt"))
    with pytest.raises(PackageError):
        package.partition(spark, p.path, str(tmp_path / "one"), "patient_id", parts=1)


@pytest.mark.parametrize(("a", "b", "jaccard", "shared"), [([1, 2, 3], [1, 2, 3], 1.0, 3), ([1, 2, 3], [2, 3, 4], 0.5, 2), ([1, 2], [3, 4], 0.0, 0)])
def test_diff_overlap(spark, tmp_path, a, b, jaccard, shared):
    p, q = make(spark, tmp_path / "a", a, "patient_id"), make(spark, tmp_path / "b", b, "patient_id")
    d = package.diff(spark, p.path, q.path)
    assert d["overlap"]["jaccard_similarity"] == jaccard and d["overlap"]["shared"] == shared
    assert d["datasets"] == {"Claims-v1": "same" if a == b else "modified"} and "overlap" in package.diff_text(d)
    assert package.diff(spark, p.path, make(spark, tmp_path / "c", b).path)["overlap"] is None


def test_pruning_uses_only_what_was_verified(spark, tmp_path):
    a = make(spark, tmp_path / "c/a", [1, 2], dx="A", selectors=(Selector("s", "DIAGNOSIS", "eq", "A"),))
    make(spark, tmp_path / "c/b", [3], dx="B", selectors=(Selector("s", "diagnosis", "eq", "B"),))
    make(spark, tmp_path / "c/lie", [4], dx="A", selectors=(Selector("s", "diagnosis", "eq", "B"),))
    c = Catalog(spark, str(tmp_path / "c"))
    from popspark.plans.predicates import Cmp

    assert [os.path.basename(p.path) for p, _ in c.surviving("Claims-v1", Cmp("diagnosis", "=", "A"))] == ["a", "lie"]
    assert sorted(r[0] for r in c.scan("Claims-v1", "diagnosis = 'A'").collect()) == [1, 2, 4]
    package.union(spark, [f"{tmp_path}/c/a", f"{tmp_path}/c/b"], str(tmp_path / "c/u"))
    package.append(spark, a.path, rows(spark, [7], "B"))
    c.refresh()
    assert sorted(r[0] for r in c.scan("claims_v1", "diagnosis = 'B'").collect()) == [3, 3, 7]


def test_pruning_by_key_index(spark, tmp_path):
    make(spark, tmp_path / "c/a", [10, 20, None], "patient_id")
    make(spark, tmp_path / "c/b", [30, 40], "patient_id")
    c = Catalog(spark, str(tmp_path / "c"))
    names = lambda text: [os.path.basename(p.path) for p, _ in c.surviving("Claims-v1", __import__("popspark.plans.predicates", fromlist=["x"]).from_sql(spark, text))]
    assert names("patient_id IN (20, 31)") == ["a"] and names("patient_id = 5") == [] and names("patient_id > 5") == ["a", "b"]
    assert names("patient_id = 40 AND diagnosis = 'x'") == ["b"] and names("patient_id = 'x'") == ["a", "b"]
    assert c.scan("Claims-v1", "patient_id = 5").columns == ["patient_id", "diagnosis"]
    assert c.scan("Claims-v1", "patient_id = 5").count() == 0


def test_catalog_tables(spark, tmp_path):
    make(spark, tmp_path / "c/a", [1, 2], label="Claims-v1")
    package.write_package(spark, str(tmp_path / "c/b"), Definition("b"), {"Claims-v1": spark.createDataFrame([("x", 5_000_000_000)], "diagnosis string, patient_id bigint"), "Rx": spark.range(3)})
    c = Catalog(spark, str(tmp_path / "c"))
    assert c.tables() == ["claims_v1", "rx"] and dict((f.name, f.dataType.simpleString()) for f in c.schema("claims_v1")) == {"patient_id": "bigint", "diagnosis": "string"}
    assert c.count("Claims-v1") == 3 and sorted(r[0] for r in c.sql("SELECT patient_id FROM claims_v1").collect()) == [1, 2, 5_000_000_000]
    assert c.sql("SELECT count(*) FROM claims_v1 WHERE _package LIKE '%/a'").first()[0] == 2
    assert {r.label: r.num_rows for r in c.stats().where("package LIKE '%/b'").collect()} == {"Claims-v1": 1, "Rx": 3} and c.preview("rx", 2).count() == 2
    with pytest.raises(ValueError, match="no table"):
        c.schema("none")
    make(spark, tmp_path / "c/d", [1], label="claims v1")
    c.refresh()
    with pytest.raises(ValueError, match="one table name"):
        c.tables()


def test_universes_are_kept_and_searched(spark, tmp_path):
    df = spark.createDataFrame([(1, "red apple"), (1, "blue"), (2, "red pear"), (3, "green"), (-40000, ""), (None, "red apple")], "k int, t string")
    p = package.write_package(spark, str(tmp_path / "a"), Definition("a"), {"T": df})
    u = universe.build(spark, p.path, "T", "k", str(tmp_path / "u"), text=F.col("t"))
    assert (u.num_vectors, u.dimension, u.cardinality, u.version) == (6, 256, 4, 1)
    assert universe.build(spark, p.path, "T", "k", str(tmp_path / "u"), text=F.col("t")) == u == universe.open_universe(spark, u.folder)
    assert ids_in(universe.members_of(spark, u)) == [-40000, 1, 2, 3]
    found = universe.search_by_text(spark, u, "red apple", 3).collect()
    assert {(r.k, round(r.score, 6), r.metadata) for r in found[:2]} == {(1, 1.0, "red apple"), (None, 1.0, "red apple")} and found[2].k == 2
    assert [r.k for r in universe.search_by_key(spark, u, 2, 2).where("k IS NOT NULL").collect()] == [1] and universe.search_by_key(spark, u, 77).count() == 0
    package.append(spark, p.path, spark.createDataFrame([(9, "red")], "k int, t string"))
    again = universe.build(spark, p.path, "T", "k", str(tmp_path / "u"), text=F.col("t"))
    assert (again.num_vectors, again.version, again.vectors != u.vectors) == (7, 2, True)
    with pytest.raises(PackageError):
        universe.build(spark, p.path, "T", "k", str(tmp_path / "u"))


def ids_in(df):
    return sorted(r[0] for r in df.collect())


def test_variants(spark, tmp_path):
    ids = [-65536, -32768, -5, 0, 1, 5, 32768, 32769, 2**40]
    df = spark.createDataFrame([(i,) for i in [*ids, *ids, None]], "k bigint")
    variants.write_bitmap(spark, str(tmp_path / "b"), Definition("b"), df, "k")
    assert ids_in(variants.read_any(spark, str(tmp_path / "b"))["members"]) == ids
    rowed = make(spark, tmp_path / "r", [1, 2])
    assert list(variants.read_any(spark, rowed.path)) == ["Claims-v1"] and variants.variant(rowed).name == "rows"
    spark.range(3).createOrReplaceTempView("variant_t")
    package.reference_package(spark, str(tmp_path / "t"), Definition("t"), {"T": "variant_t"})
    assert [variants.inspect_any(spark, str(tmp_path / n)).first().variant for n in "brt"] == ["bitmap", "rows", "references"]
    with pytest.raises(PackageError, match="there is"):
        variants.register(variants.VARIANTS[0])
    assert "default" in {r.namespace for r in files.list_namespaces(spark).collect()}


def test_lineage_edges(spark, tmp_path):
    a = make(spark, tmp_path / "a", [1], lineage=Lineage(("sys",), ("t1", "t2")))
    u = package.union(spark, [a.path, a.path], str(tmp_path / "u, v"))
    nodes, edges = lineage.graph(spark, [package.open_package(spark, x.path) for x in (a, u)])
    assert ("package:" + a.path, "package:" + u.path, "union") in {tuple(r) for r in edges.collect()} and nodes.where("kind = 'table'").count() == 2


def test_references(spark, tmp_path):
    spark.range(5).createOrReplaceTempView("ref_t")
    p = package.reference_package(spark, str(tmp_path / "r"), Definition("r"), {"T": "ref_t"})
    q = package.reference_package(spark, str(tmp_path / "q"), Definition("q"), {"T": "ref_t"})
    assert ids_of(spark, p, "T") == [0, 1, 2, 3, 4] and len(package.merge_references(spark, [p.path, q.path], str(tmp_path / "m")).datasets) == 1
    with pytest.raises(PackageError):
        package.merge_references(spark, [p.path, make(spark, tmp_path / "a", [1]).path], str(tmp_path / "n"))


def test_files(spark, tmp_path):
    df = rows(spark, [1, 2])
    df.coalesce(1).write.parquet(str(tmp_path / "x.parquet"))
    df.coalesce(1).write.option("header", "true").csv(str(tmp_path / "x.csv"))
    from popspark.sources.arrow import write_arrow

    assert write_arrow(df, str(tmp_path / "x.arrow")) == 2 and write_arrow(df, str(tmp_path / "x.feather"), "zstd") == 2
    make(spark, tmp_path / "p", [1, 2])
    for name in ("x.parquet", "x.csv", "x.arrow", "x.feather", "p"):
        got = files.read_file(spark, str(tmp_path / name))
        assert sorted(map(tuple, got.collect())) == [(1, "E11.0"), (2, "E11.0")], name
    for name in ("x.vortex", "x.txt"):
        with pytest.raises(PackageError):
            files.read_file(spark, str(tmp_path / name))
    with pytest.raises(PackageError, match="identifier"):
        files.read_table(spark, "t; DROP TABLE t")


def test_load_and_extract(spark, tmp_path):
    rows(spark, [1, 2, 3]).createOrReplaceTempView("base_t")
    spec = files.LoadSpec(Definition("l"), "Claims", "base_t", "patient_id", (files.Step("SELECT 1 AS k", "SELECT 1 AS patient_id, 'z' AS diagnosis, 5 AS extra"),), {"Other": "SELECT * FROM base_t WHERE patient_id > 2"}, "patient_id")
    p = files.load(spark, spec, str(tmp_path / "l"))
    assert ids_of(spark, p, "Claims") == [1, 2, 3] and p.dataset("Claims").columns[2]["name"] == "extra" and ids_of(spark, p, "Other") == [3]
    e = files.extract(spark, str(tmp_path / "e"), Definition("e"), {"Q": "SELECT * FROM base_t LIMIT 2"})
    assert e.definition.lineage.query_hash and e.num_rows == 2
    assert set(files.load_template("n", "L", {"a": "x = 1", "b": "x = 2"}, "base_t")) == {"a", "b"}
    assert files.list_tables(spark).where("name = 'base_t'").count() == 1


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda *_: spark)
    rows(spark, [1, 2]).coalesce(1).write.parquet(str(tmp_path / "d.parquet"))
    path = str(tmp_path / "c/p")
    for argv in (["write", path, "Claims", str(tmp_path / "d.parquet"), "--index", "patient_id"], ["inspect", path], ["append", path, str(tmp_path / "d.parquet")], ["delete-rows", path, "patient_id", "1"], ["union", str(tmp_path / "c/u"), path, path], ["diff", path, str(tmp_path / "c/u")], ["annotate", path, "--name", "x"], ["tables", str(tmp_path / "c")], ["schema", str(tmp_path / "c"), "claims"], ["sql", str(tmp_path / "c"), "SELECT count(*) FROM claims"], ["revisions", path], ["diff-revisions", path, "1", "2"], ["read", path, "Claims"]):
        assert cli.main(argv) == 0
    assert "revision 3, 2 rows" in capsys.readouterr().out
