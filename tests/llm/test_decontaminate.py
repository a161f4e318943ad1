import random

import numpy as np
import pytest

from popspark.llm import decontaminate as D

from .conftest import SCHEMA, sentence


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.randint(15, 70)) + ". " + sentence(rng, 6) + ".") for i in range(25)]
    docs, truth = [], set()
    for d in range(120):
        words = sentence(rng, rng.randint(30, 400)).split()
        if d % 3 == 0:
            i, text = rng.choice(items)
            part = text.split()
            if d % 2:  # a paraphrase: every sixth word another, one left out
                part = [w if k % 6 else "zzz" for k, w in enumerate(part)]
                del part[3]
            at = rng.randint(0, len(words))
            words[at:at] = part
            truth.add((d, i))
        docs.append((d, " ".join(words).upper() if d % 9 == 0 else " ".join(words), "en", "s", 0))
    return items, docs, truth


def test_planted_passages_are_found_and_nothing_else(spark, planted):
    items, docs, truth = planted
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, SCHEMA).repartition(4)
    got = {(r.doc_id, r.item_id) for r in D.matches(table, benchmark).collect()}
    assert got == truth
    blocks = {(r.doc_id, r.item_id) for r in D.matches(table, benchmark, D.Params(block_words=300)).collect()}
    assert blocks == truth
    kept = D.clean(table, benchmark)
    assert {r.doc_id for r in kept.collect()} == {d for d, *_ in docs} - {d for d, _ in truth} and kept.columns == table.columns


def test_odd_rows(spark, odd, empty, odd_rows):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, odd_rows[6][1])], "item_id long, text string")
    got = D.matches(odd, benchmark).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(["7", "7", "8", "None", "9", "12"]) and {r.item_id for r in got} == {4}
    assert D.matches(empty, benchmark).count() == 0 and D.clean(empty, benchmark).count() == 0
    assert D.matches(odd, benchmark.limit(0)).count() == 0 and D.clean(odd, benchmark.limit(0)).count() == odd.count()


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 20))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert D._lcs(masks, len(a), b) == t[-1, -1]


def test_singular_vectors_are_those_of_the_matrix(spark):
    rng = random.Random(2)
    texts = [sentence(rng, 64, [f"w{i}" for i in range(12)]) for _ in range(60)]
    p = D.Params(rank=6, extra=30, common_part=9, common_corpus=9)
    b = D.block_of(D.queries_of([(1, " ".join(f"w{i}" for i in range(12)))], p), p)
    latent = D.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), b, p)
    count = np.array([[t.split().count(f"w{i}") for i in range(12)] for t in texts], float)
    columns = [int(b.slot[np.searchsorted(b.terms, D._hashes(f"w{i}")[0])]) for i in range(12)]
    a = count * latent.idf[columns]
    own = np.ones((1, 12)) * latent.idf[columns]
    times = max(1.0, ((count > 0).sum(0) * latent.idf[columns] ** 2).sum() / (own**2).sum())
    _, _, vt = np.linalg.svd(np.vstack([a, np.sqrt(times) * own]), full_matrices=False)
    cosines = np.linalg.svd(vt[:6] @ latent.vectors[columns])[1]
    assert cosines.min() > 0.99


def test_paraphrases_of_items_with_short_answers(spark):
    rng = random.Random(8)
    items = [(i, sentence(rng, 40) + f". Answer{i}" + (" indeed." if i % 2 else ".")) for i in range(6)]
    docs = []
    for i, text in items:
        part = [w if k % 3 or k > 38 else "zzz" for k, w in enumerate(text.split())]  # two thirds stay, and the answer
        docs.append((i, " ".join([sentence(rng, 50), *part, sentence(rng, 50)]), "en", "s", 0))
        docs.append((100 + i, " ".join([sentence(rng, 50), *part[:40], sentence(rng, 50)]), "en", "s", 0))
    got = D.matches(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(6)} and sum(r.kind == "paraphrase" for r in got) >= 4
