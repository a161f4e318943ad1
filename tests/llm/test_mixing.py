import collections
import random

import pytest
from pyspark.sql import functions as F

from popspark.llm import mixing as M

from .conftest import SCHEMA, WORD, sentence


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            open_.remove(s)
            left -= target[s]
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 5, 100, 10_000]) for s in [None, *"abcdefg"]}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in M.targets(df).collect()}
    expect = brute_targets(sizes)
    assert got.keys() == expect.keys() and all(got[s] == pytest.approx(expect[s]) for s in got)


def rows(spark, n=1500):
    rng = random.Random(8)
    return spark.createDataFrame([(i, sentence(rng, rng.choice([0, 3, 20, 60, 200])) or None, "en", rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(n)], SCHEMA).repartition(4)


@pytest.mark.parametrize("group", [100, 50_000])
def test_words_taken_are_near_the_targets(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(M, "GROUP_ROWS", group)
    monkeypatch.setattr(M, "FAN", 2)
    docs = rows(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = M.op7_pivotal_mix(spark, str(tmp_path)).collect()
    again = M.op7_pivotal_mix(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == 1500
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r["size"] and (r.taken % r["size"] == 0 if r["size"] else r.taken == 0)
    assert all(abs(taken[s] - target[s]) <= 200 for s in target) and target == pytest.approx(brute_targets(sizes))
    assert all(r.source_size == sizes[r.source] for r in got)


def test_repeated_and_odd_rows(spark, odd, empty):
    got = M.copies(odd.select("doc_id", "source", M.sizes(odd).alias("size")), "size").collect()
    assert sum(r.rows for r in got) == 16 and all(r.copies <= 3 * r.rows for r in got)
    assert M.copies(empty.select("doc_id", "source", M.sizes(empty).alias("size")), "size").count() == 0
    assert M.mixed_documents(empty).count() == 0
    many = spark.createDataFrame([(1, "x y z", "en", "a", 0)] * 90 + [(2, sentence(random.Random(1), 400), "en", "b", 0)], SCHEMA)
    got = {r.source: r for r in M.copies(many.select("source", M.sizes(many).alias("size")), "size").collect()}
    assert got["a"].rows == 90 and abs(got["a"].copies * 3 - got["a"].target) <= 3
    mixed = M.mixed_documents(many)
    assert mixed.columns == many.columns and mixed.where("source = 'a'").count() == got["a"].copies


def test_mixed_documents_are_the_copies(spark):
    docs = rows(spark, 300).withColumn("size", F.lit("clash"))
    drawn = M.mixed_documents(docs)
    n = collections.Counter(r.doc_id for r in drawn.collect())
    sizes = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    per, taken = collections.Counter(), collections.Counter()
    for r in docs.collect():
        per[r.source] += sizes[r.doc_id]
        taken[r.source] += n[r.doc_id] * sizes[r.doc_id]
    assert drawn.columns == docs.columns and all(abs(taken[s] - t) <= 200 for s, t in brute_targets(per).items())


@pytest.mark.parametrize("sizes", [[100] * 16, [900, 400, 250, 90, 60, 40, 40, 30, 25, 10, 10, 5, 3, 2, 1, 1]])
def test_each_document_keeps_its_expected_copies(sizes):
    """Means over seeds are within four standard errors of the probabilities, and sums are those of the targets."""
    rng, n = random.Random(5), 20_000
    start = [0.3] * 8 + [rng.uniform(0.05, 0.95) for _ in range(8)]
    total = [0] * 16
    for seed in range(n):
        draw, p = random.Random(seed), list(start)
        left = M._pivot(sizes, p, draw)
        assert sum(x * s for x, s in zip(p, sizes, strict=True)) == pytest.approx(sum(x * s for x, s in zip(start, sizes, strict=True)))
        assert all(x < 1e-6 or x > 1 - 1e-6 or i == left for i, x in enumerate(p))
        for i, x in enumerate(p):
            total[i] += (draw.random() < x) if i == left else round(x)
    for mean, q in zip([x / n for x in total], start, strict=True):
        assert abs(mean - q) <= 4 * (q * (1 - q) / n) ** 0.5


def test_expected_copies_hold_through_the_tree(spark, monkeypatch):
    monkeypatch.setattr(M, "GROUP_ROWS", 5)
    monkeypatch.setattr(M, "FAN", 2)
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, rng.choice("ab"), rng.choice([1, 7, 30, 80])) for i in range(24)], "doc_id long, source string, size long").coalesce(1)
    got, n = collections.defaultdict(list), 24
    for seed in range(n):
        for r in M.copies(docs, "size", seed=seed).collect():
            got[r.doc_id].append((r.copies, r.target / r.source_size))
    errors = [(sum(c for c, _ in x) / n - x[0][1]) for x in got.values()]
    assert all(abs(e) <= 5 * 0.5 / n**0.5 for e in errors) and abs(sum(errors)) / len(errors) < 0.15


def test_names_that_clash_are_refused(spark):
    with pytest.raises(ValueError, match="copies"):
        M.copies(spark.createDataFrame([(1, "a", 5)], "copies long, source string, size long"), "size")
