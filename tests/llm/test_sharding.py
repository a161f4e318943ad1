import collections
import zlib

import pytest
from pyspark.sql import functions as F

from popspark.llm import sharding as S


def shards(df, tree):
    return {r.doc_id: r.shard for r in S.placed(df, tree).select("doc_id", "shard").collect()}


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(4000).select(F.col("id").alias("doc_id")).cache()


@pytest.mark.parametrize("n", [1, 3, 8, 9])
def test_one_more_shard_takes_rows_only_into_itself(ids, n):
    a, b = shards(ids, S.even_tree(n)), shards(ids, S.even_tree(n + 1))
    moved = [i for i in a if a[i] != b[i]]
    assert {b[i] for i in moved} == {n} and 0.6 < len(moved) * (n + 1) / 4000 < 1.4


def test_weights_set_shares_and_confine_movement(ids):
    tree = [S.Shard("r0", "a", 0, 1), S.Shard("r0", "a", 1, 2), S.Shard("r0", "b", 2, 1), S.Shard("r1", "c", 3, 4)]
    heavier = [*tree[:1], S.Shard("r0", "a", 1, 3), *tree[2:]]
    a, b = shards(ids, tree), shards(ids, heavier)
    n = collections.Counter(a.values())
    assert abs(n[3] / 4000 - 0.5) < 0.05 and abs(n[1] / 4000 - 0.25) < 0.04
    assert {b[i] for i in a if a[i] != b[i]} == {1}


def test_levels_are_of_the_tree(ids):
    tree = {s.shard: (s.region, s.rack) for s in S.even_tree(8)}
    assert all(tree[r.shard] == (r.region, r["rack"]) for r in S.placed(ids, S.even_tree(8)).collect())


def test_bad_trees_and_clashing_names(ids):
    for bad in ([], [S.Shard("r", "a", 0, 0.0)], [S.Shard("r", "a", 0), S.Shard("r", "b", 0)]):
        with pytest.raises(ValueError):
            S.placed(ids, bad)
    with pytest.raises(ValueError, match="exist"):
        S.placed(ids.withColumn("Shard", F.lit(1)), S.even_tree(2))


@pytest.mark.parametrize("group", [2, 10**6])
def test_slots_have_no_gaps(spark, odd, empty, group):
    placed = S.placed(odd.drop("text"), S.even_tree(3))
    got = S.with_slots(placed, ["doc_id"], group_rows=group).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == 16 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert S.with_slots(S.placed(empty.drop("text"), S.even_tree(3)), ["doc_id"]).count() == 0


def test_query(spark, tmp_path, odd, odd_rows):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = S.op4_hash_tree_shards(spark, str(tmp_path)).collect()
    expect = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows]
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == sorted(map(str, expect))
    assert all(r.law == "key" and r.grown_shard in (r.shard, 8) for r in got)
    S.write_shards(odd, S.even_tree(3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 16
