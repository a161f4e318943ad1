import random
from itertools import combinations

import pytest

from popspark.llm import jaccard_join as J

from .conftest import SCHEMA, WORD, sentence

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def grams(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, p):
    sets = [grams(t, p.n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and p.den * len(sets[a] & sets[b]) >= p.num * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(str((i, len(sets[k]), least.get(find(k)) if sets[k] else i)) for k, (i, _) in enumerate(rows))


def documents(seed):
    rng, rows = random.Random(seed), []
    bases = [sentence(rng, rng.choice([4, 30, 90, 200])) for _ in range(10)]
    for i in range(160):
        w = rng.choice(bases).split()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(["neu", "NEU", "alt"])
        rows.append((i, " ".join(w[rng.choice([0, 0, 1, 3]) :])))
    passage = sentence(rng, 40)  # many texts share it and little else
    rows += [(200 + i, sentence(rng, rng.randint(5, 30)) + " " + passage) for i in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("p", "tile"), [(J.Params(), 32), (J.Params(), 3), (J.Params(5, 80, 100), 3)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, p, tile):
    monkeypatch.setattr(J, "SMALL_TILE", tile)
    rows = documents(p.n + tile)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in J.grouped(df, p).collect()) == brute(rows, p)


def test_odd_rows(spark, odd, empty, odd_rows):
    rows = [(i, t) for i, t, *_ in odd_rows]
    got = J.grouped(odd.withColumnRenamed("n_chars", "node")).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(rows, J.Params())
    assert J.grouped(empty).count() == 0


def test_one_of_each_group_stays(spark, odd):
    p = J.Params(5, 80, 100)
    kept = J.one_of_each(odd, p)
    # The rows with the base text (twice, or in lines) are one group, and another text of id 7 is none of it.
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "6", "7", "7", "10", "11", "None"])
    assert J.one_of_each(kept, p).count() == kept.count()
