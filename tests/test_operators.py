"""Null keys, ties, laws of set algebra and mutation, policies, streams."""

import random

import pytest
from pyspark.sql import functions as F

from popspark.functions import scalars as X
from popspark.model import Definition, Selector
from popspark.operators import aggregates, audit, filters, joins, mutations, policy, sets, similarity
from popspark.sources import package
from popspark.streaming import increments


def keys(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "k int")


def values(df):
    return sorted((r[0] for r in df.collect()), key=lambda x: (x is None, x))


def test_null_keys(spark):
    df, some = keys(spark, 1, 2, None), keys(spark, 2, None)
    assert values(filters.keep_keys(df, some, "k")) == [2]
    assert values(filters.drop_keys(df, some, "k")) == [1, None]
    assert values(filters.key_set(keys(spark, 1, 1, None), "k")) == [1]
    assert values(filters.keys_frame(df, "k", ["1", "x", None, 2])) == [1, 2]


def test_selected_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "x int, y string")
    assert values(filters.select_rows(df, [Selector("1", "y", "neq", "a")])) == [2]
    assert values(filters.select_rows(df, [Selector("1", "x", "between", [2, 3]), Selector("2", "y", "eq", "b", is_exclusion=True)])) == []


def test_overlap_regions_of_four_sets(spark):
    sets_of = [set(range(0, 40, 2)), set(range(0, 40, 3)), set(range(5, 25)), {7, 100}]
    got = {r.mask: (r.intersection_size, r.exclusive_size) for r in sets.overlap_regions([keys(spark, *s) for s in sets_of], "k").collect()}
    every = set().union(*sets_of)
    mask = {k: sum(1 << i for i, s in enumerate(sets_of) if k in s) for k in every}
    assert got == {m: (sum(x & m == m for x in mask.values()), sum(x == m for x in mask.values())) for m in range(1, 16)}


def test_overlap_counts_null_as_a_key(spark):
    parts = [keys(spark, 1, 2, None), keys(spark, 2, 3, None), keys(spark, 2)]
    got = {r.mask: (r.intersection_size, r.exclusive_size) for r in sets.overlap_regions(parts, "k").collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (2, 1), 4: (1, 0), 5: (1, 0), 6: (1, 0), 7: (1, 1)}
    assert {(r.i, r.j): r.shared for r in sets.overlap_matrix(parts, "k").collect()}[(0, 1)] == 2
    empty = sets.overlap_stats(keys(spark).limit(0), keys(spark).limit(0), "k").first()
    assert (empty.jaccard_similarity, empty.overlap_coefficient) == (0.0, 0.0)


def test_set_laws(spark):
    rng = random.Random(2)
    for _ in range(3):
        a, b = ([rng.choice([None, *range(6)]) for _ in range(8)] for _ in range(2))
        x, y = keys(spark, *a), keys(spark, *b)
        assert sets.union([x, y]).count() == len(a) + len(b)
        both = {*a} & {*b} - {None}
        assert values(sets.intersect([x, y], "k")) == values(sets.intersect([y, x], "k")) == sorted(k for k in a + b if k in both)
        assert values(sets.members([x, y], "k", "difference")) == sorted({*a} - {*b} - {None})
    for operation, n in (("difference", 3), ("single", 2), ("none", 1)):
        with pytest.raises(ValueError):
            sets.members([keys(spark, 1)] * n, "k", operation)


def test_increment_equals_its_fold(spark):
    rng = random.Random(3)
    for _ in range(3):
        base = keys(spark, *[rng.choice([None, *range(8)]) for _ in range(10)])
        steps = [(keys(spark, *rng.sample(range(8), 2)) if rng.random() < 0.8 else None, keys(spark, *[rng.randint(0, 7) for _ in range(3)]) if rng.random() < 0.8 else None) for _ in range(4)]
        slow = base
        for gone, add in steps:
            slow = filters.drop_keys(slow, gone, "k") if gone is not None else slow
            slow = sets.union([slow, add]) if add is not None else slow
        assert values(mutations.increment(base, steps, "k")) == values(slow)
    assert values(mutations.increment(base, [], "k")) == values(base)


def test_bitmaps(spark):
    a, b = keys(spark, 1, 40000, 40000, None), keys(spark, 40000, 7)
    size = lambda x: aggregates.bitmap_size(x).first()[0]
    maps = [aggregates.key_bitmap(x, "k") for x in (a, b)]
    assert size(maps[0]) == 2 and size(aggregates.bitmap_intersection(maps)) == 1 and size(aggregates.bitmap_union(maps)) == 3
    assert size(aggregates.key_bitmap(a.limit(0), "k")) == 0


def test_asof_and_intervals(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 9)], "id int, g string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 10, "z"), ("a", 6, None)], "g string, u int, v string")
    assert sorted((r.id, r.v) for r in joins.asof(left, right, ["g"], "t", "u", ["v"]).collect()) == [(1, "y"), (2, None), (3, None), (4, None)]
    points, ranges = spark.createDataFrame([(0.0,), (9.9,), (10.0,), (-3.0,), (None,)], "p double"), spark.createDataFrame([(1, -5.0, 9.9), (2, 10.0, 10.0), (3, 7.0, 3.0)], "r int, low double, high double")
    assert sorted((r.p, r.r) for r in joins.interval_join(points, ranges, "p", "low", "high", 4.0).collect()) == [(-3.0, 1), (0.0, 1), (9.9, 1), (10.0, 2)]


def test_ranking_leaves_out_booleans_and_nulls(spark):
    df = spark.createDataFrame([(1, True, None, "a"), (1, False, None, "b")], "x int, b boolean, n int, s string")
    assert [(r.column_name, r.distinct_values, r["rank"]) for r in aggregates.cardinality_rank(df).orderBy("rank").collect()] == [("s", 2, 1), ("x", 1, 2)]


def test_stride_sample_has_even_distances(spark):
    assert values(aggregates.stride_sample(spark.range(103), [F.col("id")], 10)) == list(range(0, 100, 10))
    assert values(aggregates.stride_sample(spark.range(3), [F.col("id")], 10)) == [0, 1, 2]


def test_cosine_ties_zero_vectors_and_exclusion(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0]), (1, [1.0, 1.0])], "id int, embedding array<float>")
    q = similarity.query_vector(v, "id", 2)
    assert [(r.id, round(r.score, 3)) for r in similarity.cosine_topk(v, q, 3, "id").collect()] == [(1, 1.0), (1, 0.707), (3, 0.0)]
    assert [r.id for r in similarity.cosine_topk(v, similarity.query_vector(v, "id", vector=[0, 5]), 1, "id").collect()] == [4]
    with pytest.raises(ValueError):
        similarity.query_vector(v, "id")


def test_record_text_and_embedding(spark):
    df = spark.createDataFrame([(1, "TX", "a | b||"), (2, None, None)], "id int, state string, codes string")
    text = similarity.record_text(df, [("State", "state")], [("Codes", "codes")])
    assert [r[0] for r in df.orderBy("id").select(text).collect()] == ["State: TX. Codes: a, b", "no data"]
    vectors = similarity.with_embedding(df, text)
    assert vectors.select(F.round(X.norm(F.col("embedding")), 3)).distinct().first()[0] == 1.0


def test_policies(spark, tmp_path):
    df = spark.createDataFrame([(i, "TX" if i % 2 else "CA", i % 4 if i % 3 else None) for i in range(12)], "id int, state string, SOURCES_BITSET int")
    p = policy.Policy("p", predicate="state = 'TX'", source_bitset=2, masked_columns=("STATE",), max_rows=2)
    assert [tuple(r) for r in policy.apply_policy(df, p, [F.col("id")]).collect()] == [(7, "***MASKED***", 3), (11, "***MASKED***", 3)]
    both = [policy.Policy("m", max_rows=3, priority=9), policy.Policy("f", predicate="state = 'CA'")]
    assert values(policy.apply_policies(df, both, [F.col("id")])) == [0, 2, 4]  # the limit comes after every filter
    s = policy.PolicyStore(spark, str(tmp_path / "policies"))
    s.create(p)
    s.create(policy.Policy("off", enabled=False))
    assert s.get("p") == p and [x.policy_id for x in s.list(True)] == ["p"] and len(s.list()) == 2 and s.delete("off") and not s.delete("off")
    for bad in ("", "../x", "a/b"):
        with pytest.raises(ValueError):
            s.get(bad)
    with pytest.raises(ValueError):
        policy.Policy("x", type="none")


def test_audit_of_nothing(spark, tmp_path):
    log = spark.createDataFrame([], audit.SCHEMA)
    assert audit.stats(log).first().asDict() == {"total": 0, "succeeded": 0, "failed": 0, "success_rate": 0.0, "avg_elapsed_ms": 0.0, "rows_returned": 0}
    import datetime

    at = datetime.datetime(2024, 1, 1)
    audit.record(spark, str(tmp_path / "log"), [(at, "u", "sql", 3, 1.5, True), (at, "v", "sql", 1, 0.5, False)])
    log = spark.read.parquet(str(tmp_path / "log"))
    assert audit.stats(log).first().success_rate == 0.5 and audit.logs(log, 5, "u").count() == 1 and audit.by_type(log).first().total == 2


def test_scalars(spark):
    df = spark.createDataFrame([("A b-É|x | ", float("nan"), None), (None, 1.5, 6)], "s string, d double, n int")
    r = df.select(X.codes(F.col("s")).alias("c"), X.table_name(F.col("s")).alias("t"), X.json_safe(F.col("d")).alias("j"), X.has_bits(F.col("n"), 2).alias("b")).collect()
    assert r[0].c == ["A b-É", "x"] and r[0].t == "a_b___x___" and r[0].j is None and not r[0].b and r[1].c is None and r[1].j == 1.5 and r[1].b


def test_stream_into_a_package_once(spark, tmp_path):
    path, source = str(tmp_path / "p"), str(tmp_path / "in")
    package.write_package(spark, path, Definition("s"), {"Events": keys(spark, 1)})
    for batch in ([2, 3], [3, 4]):
        keys(spark, *batch).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k int").parquet(source)
        increments.into_package(stream, path, "Events", str(tmp_path / "check"), "k").awaitTermination()
    p = package.open_package(spark, path)
    assert values(package.read_dataset(spark, p, "Events")) == [1, 2, 3, 4] and p.definition.revision == 3


def test_windows_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("2024-01-01 00:10:00", "u"), ("2024-01-01 00:50:00", "u"), ("2024-01-01 05:00:00", "u")]
    spark.createDataFrame(rows, "ts string, u string").select(F.col("ts").cast("timestamp").alias("ts"), "u").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, u string").parquet(source)
    for name, df in (("tumbling", increments.windowed(stream, "ts", [F.col("u")], "1 hour", None, "10 minutes")), ("sessions", increments.sessions(stream, "ts", [F.col("u")], "1 hour", "10 minutes"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "tumbling" else "append").start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.n for r in spark.table("tumbling").collect()) == [1, 2] and spark.table("sessions").count() >= 1
