import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, normalizers
from tokenizers.models import Unigram

from popspark.llm import token_counts as C

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces, byte_fallback):
    t = Tokenizer(Unigram(pieces, 0, byte_fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_counts_are_the_librarys(spark, odd_rows):
    pieces = C.vocabulary(MODEL)
    count, exact, rng = C.Counter(pieces), library(pieces, True), random.Random(1)
    texts = [t for _, t, *_ in odd_rows if t] + ["   ", "a\n\n b", "<s> hi <0x41>", "▁x  y", "a\tb"] + ["".join(rng.choice("ab cd\n é日😀\t<>0x") for _ in range(rng.randint(1, 50))) for _ in range(800)]
    assert [count(t) for t in texts] == [exact(t) for t in texts]


@pytest.mark.parametrize("scores", [(-1.0, -2.0), (-1.5, -2.25, -3.1)])
def test_ties_and_unknown_characters(scores):
    rng = random.Random(len(scores))
    pieces = [("<unk>", 0.0)] + [(s, rng.choice(scores)) for s in ("a", "b", "ab", "▁a", "ba", "▁", "c", "abc", "cab", "aa", "bb▁")]
    count, exact = C.Counter(pieces), library(pieces, False)
    for _ in range(1500):
        text = "".join(rng.choice("abc dx") for _ in range(rng.randint(1, 30)))
        assert count(text) == exact(text), text


def test_odd_rows(spark, odd, empty, odd_rows):
    exact = library(C.vocabulary(MODEL), True)
    got = C.token_counts(odd.withColumnRenamed("lang", "n_tokens"), MODEL).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, exact(t) if t else 0)) for i, t, *_ in odd_rows)
    assert C.token_counts(empty, MODEL).count() == 0
