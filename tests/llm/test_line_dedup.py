import random
from collections import defaultdict

import pytest

from popspark.llm import line_dedup as L

from .conftest import SCHEMA, WORD, sentence


def brute(rows, least=3):
    seen, out = [], {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        cut = []
        for n, line in enumerate((t or "").split("\n")):
            s = frozenset(WORD.findall(line))
            if len(s) >= least:
                if any(100 * len(s & x) >= 80 * len(s | x) for x in seen):
                    cut.append(n)
                seen.append(s)
        out[i] = cut
    return out


@pytest.mark.parametrize(("seed", "small"), [(0, False), (1, False), (2, True)])
def test_against_brute_force(spark, monkeypatch, seed, small):
    if small:  # long lists are joined as they are, and large groups go in blocks
        monkeypatch.setattr(L, "MOST_MEMBERS", 3)
        monkeypatch.setattr(L, "POSTINGS", 20)
    rng = random.Random(seed)
    pool = [sentence(rng, rng.randint(1, 25)) for _ in range(60)]

    def near(line):
        w = line.split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(["neu", w[0]])
        return " ".join(w)

    docs = [(i, "\n".join(near(rng.choice(pool)) if rng.random() < 0.5 else sentence(rng, rng.randint(0, 20)) for _ in range(rng.randint(0, 8)))) for i in range(150)]
    docs.append((None, pool[3]))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA).repartition(4)
    got = L.deduplicated(df).collect()
    expect = brute(docs)
    assert {r.doc_id: r.removed_lines for r in got} == expect and sum(map(len, expect.values())) > 100
    for r in got:
        lines = dict(docs)[r.doc_id].split("\n")
        assert r.text == "\n".join(x for n, x in enumerate(lines) if n not in expect[r.doc_id]) and len(r.source_doc_ids) == len(r.removed_lines)


def test_odd_rows(spark, odd, empty, odd_rows):
    got = L.deduplicated(odd).collect()
    assert len(got) == 16 and [r.text for r in got if r.doc_id == 1] == [None]
    cut = defaultdict(list)
    for r in got:
        cut[r.doc_id].append(r.removed_lines)
    assert sorted(cut[7]) == [[], [], [0]]  # the second of two equal rows is a later copy
    assert cut[8] == [[0]] and cut[9] == [[0, 1]] and cut[12] == [[]] and cut[6] == [[]]
    assert L.deduplicated(empty).count() == 0


def test_query_cuts_later_copies_of_short_lines(spark, tmp_path):
    rng = random.Random(3)
    docs = [(i, "\n".join(rng.choice(["Home", "Read more", "more Read", "ha ha ha", "Les.", "a b c", "a b c d", "", sentence(rng, 9)]) for _ in range(6)), "en", "s", 0) for i in range(60)]
    spark.createDataFrame(docs, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.removed_lines for r in L.op8_line_dedup(spark, str(tmp_path)).collect()}
    expect = brute([d[:2] for d in docs], 1)
    assert got == expect and sum(map(len, expect.values())) > 150


def test_equal_rows_keep_one_copy_of_each_line(spark):
    rows = [(1, "a b c d\nshort\ne f g", "en", "s", 0)] * 3 + [(2, "a b c d", "en", "s", 0)]
    got = sorted((r.doc_id, r.removed_lines, r.text) for r in L.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    assert got == [(1, [], rows[0][1]), (1, [0, 2], "short"), (1, [0, 2], "short"), (2, [0], "")]


def test_names_that_clash_are_refused(spark, odd):
    with pytest.raises(ValueError, match="removed_lines"):
        L.deduplicated(odd.withColumnRenamed("lang", "Removed_Lines"))
