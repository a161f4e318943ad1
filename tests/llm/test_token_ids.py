import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from popspark.llm import token_ids as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(text):
    return library.t.encode(text or "", add_special_tokens=False).ids


library.t = Tokenizer.from_file(PATH)


@pytest.mark.parametrize("seed", range(6))
def test_elias_fano(seed):
    rng = random.Random(seed)
    n = rng.choice([0, 1, 7, 300, 1000])
    values = np.array(sorted(rng.randint(0, rng.choice([5, 10**4, 10**9])) for _ in range(n)), np.int64)
    top = int(values[-1]) if n else 0
    ef = T.EliasFano.of(values, top)
    again, used = T.EliasFano.read(memoryview(ef.to_bytes()), n, top)
    assert used == len(ef.to_bytes()) and again.all().tolist() == values.tolist() and [again.select(i) for i in range(n)] == values.tolist()
    if n == 1000:
        assert used * 8 <= n * (3 + max(1, top // n).bit_length()) + 32 * (n // 256 + 1) + 64
    with pytest.raises(IndexError):
        again.select(n)


def test_ids_are_the_librarys():
    rng, e = random.Random(1), T.Encoder(PATH)
    odd = ["", " ", "\n", "a  b", "a \n b", " a", "a ", "<|endoftext|> x", "a\tb", "don't  we're\n\n\n x  ", "日本 語\n", "a\u2028 b", "x \x1f y"]
    texts = odd + ["".join(rng.choice("ab \n 'st1é!日\t") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    got = []
    for i in range(0, len(texts), 40):
        got += e.encode(texts[i : i + 40])
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [library(t) for t in texts]


def test_memory_of_chunks_may_be_dropped(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 5)
    e = T.Encoder(PATH)
    texts = ["one two three four", "one five six seven eight", "two nine ten"] * 3
    assert [np.frombuffer(b, "<u4").tolist() for t in texts for b in e.encode([t])] == [library(t) for t in texts]


def test_files_hold_what_was_written(spark, odd, empty, odd_rows, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_IDS", 500)
    T.write_ids(odd, str(tmp_path / "ids"), PATH)
    got = T.read_index(spark, str(tmp_path / "ids")).collect()
    expect = [(i, [*library(t), 0]) for i, t, *_ in odd_rows]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == sorted(str((i, len(ids), crc(ids))) for i, ids in expect)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    T.write_ids(empty, str(tmp_path / "none"), PATH)
    assert T.read_index(spark, str(tmp_path / "none")).count() == 0


def test_block_round_trip():
    ids = np.array([5, 70000, 0, 9, 0], "<u4")
    doc_ids, ef, back = T.parsed(T.block([3, None], [3, 2], ids.tobytes()))
    assert doc_ids == [3, None] and ef.all().tolist() == [3, 5] and back.tolist() == ids.tolist()
    with pytest.raises(ValueError):
        T.parsed(b"none" + bytes(30))


def test_marks_part_words_as_in_the_library():
    rng, e = random.Random(3), T.Encoder(PATH)
    texts = ["".join(rng.choice("abÉß.,#*'_—€1² \n[]^`-s×µª") for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    got = []
    for i in range(0, len(texts), 40):
        got += e.encode(texts[i : i + 40])
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [library(t) for t in texts]
