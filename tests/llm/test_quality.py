import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from popspark.llm import quality as Q

from .conftest import SCHEMA, WORD, sentence


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    n, at = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for k in range(len(w) - 2):
        if n[tuple(w[k : k + 3])] > 1:
            at |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(at)


def test_statistics(spark, odd_rows):
    rng = random.Random(3)
    texts = [t for _, t, *_ in odd_rows] + ["a b a b a b", "x x x", "x x x x", "a\na\n\n a\n \n", "\x0b\x0ca\r b"] + ["".join(rng.choice("ab \n|é") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: tuple(r[c] for c in Q.STATS) for r in Q.with_stats(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def corpus(seed=5):
    rng, rows = random.Random(seed), []
    for i in range(900):
        lang, source = rng.choice(["en", None]), rng.choice(["a", None])
        words = sentence(rng, rng.randint(60, 300)).split()
        if i % 50 == 0:
            words = [w + "###" if k % 2 else w for k, w in enumerate(words)]
        rows.append((i, " ".join(words), lang, source, 0))
    return rows


def test_outliers_go_and_clean_documents_stay(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.op5_robust_outliers(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got if not r.kept} == set(range(0, 900, 50)) and not any(r.base_failed for r in got)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = Q.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == 882


def test_estimate_is_one_of_concentration_steps(spark):
    """The same steps in numpy, from the better of the two starts, end with the same centre."""
    stats = Q.with_stats(spark.createDataFrame([r for r in corpus() if r[2] == "en" and r[3] == "a"], SCHEMA)).drop("text").cache()
    p = Q.Params()
    row = Q.fit(stats, p).first()
    x = np.array([list(r) for r in stats.where(~Q.base_failed(p)).select(*Q._transformed()).collect()], float)
    ends = []
    for start in range(2):
        mean = np.sort(x, axis=0)[(len(x) - 1) // 2] if start == 0 else x.mean(0)
        cov = np.diag((1.4826 * np.sort(np.abs(x - mean), axis=0)[(len(x) - 1) // 2]) ** 2) if start == 0 else np.cov(x.T, bias=True)
        for step in range(p.steps + 1):
            s = cov * p.consistency + np.diag(np.array(p.floor) ** 2)
            if step == p.steps:
                break
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(s), x - mean)
            near = x[d <= np.sort(d)[int(np.ceil(p.share * len(x))) - 1]]
            mean, cov = near.mean(0), np.cov(near.T, bias=True)
        ends.append((np.linalg.slogdet(s)[1], mean, s))
    _, mean, s = min(ends, key=lambda e: e[0])
    assert np.allclose([row[f"m{i}"] for i in range(5)], mean, atol=0.01)
    chol = np.array([[row[f"l{max(i, j)}{min(i, j)}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    assert np.allclose(chol @ chol.T, s, rtol=0.05, atol=0.01)


def test_odd_rows(spark, odd, empty):
    stats = Q.with_stats(odd)
    got = Q.judged(stats, Q.fit(stats)).collect()
    assert len(got) == 16 and all(not r.kept for r in got if r.n_words < 50) and all(r.distance is None for r in got)
    assert Q.kept_documents(empty).count() == 0
    with pytest.raises(ValueError, match="exist"):
        Q.with_stats(odd.withColumn("N_words", F.lit(1)))


def test_small_groups_are_judged_by_larger_ones(spark):
    rows = [(i, t, "en", f"s{i % 90}", 0) for i, t, *_ in corpus()]  # ten rows a source
    rows += [(1000 + i, t, f"l{i}", "a", 0) for i, t, *_ in corpus(6)[49:52]]  # a language of one row each
    stats = Q.with_stats(spark.createDataFrame(rows, SCHEMA).repartition(4)).drop("text")
    assert Q.fit(stats).count() == 0
    got = Q.judged(stats, Q.fit_all(stats)).collect()
    assert {r.doc_id for r in got if not r.kept} == {*range(0, 900, 50), 1050} and all(r.distance is not None for r in got)


def test_both_starts_share_the_steps_that_the_driver_plans(spark, monkeypatch):
    rng, kinds = random.Random(41), []
    rows = [(i, sentence(rng, rng.randint(60, 90)), "en", "s", 0) for i in range(120)]
    real = Q.written
    monkeypatch.setattr(Q, "written", lambda df, kind: kinds.append(kind) or real(df, kind))
    assert Q.fit(Q.with_stats(spark.createDataFrame(rows, SCHEMA))).count() == 1
    assert len(kinds) == Q.Params().steps + 1
