"""Benchmark decontamination by latent semantic retrieval.

The benchmark is cut into passages of at most 64 words and handled in blocks, each one job over all documents.

1. Weights. The terms are the block's words; those common in the benchmark or the corpus get no weight, so that what
   is retrieved shares rare words. One pass over all
   documents counts in how many of their passages each term is, and takes a randomised sketch of the term-by-term
   matrix A'A of the TF-IDF matrix A of all passages: each task adds up T'(T W) for its passages T and a random W, and
   tasks' sums are added in a tree. Inverse document frequencies scale rows afterwards, so one pass is enough.
2. Decomposition. From the sketch, on the driver, the leading right singular vectors of A (Nystroem form of the
   randomised SVD). Their number is fixed and so is the size of what is broadcast.
3. Search. In a second pass each passage of 64 words, a new one every 32, is projected; benchmark passages of cosine
   0.45 or more are candidates. What the terms alone can't tell (benchmark passages with almost no weighted term) is a
   candidate for every passage that shares half of its words.
4. Check. Around the best place, the longest common subsequence of words. A copy has 70 % of the benchmark passage in
   order and 60 % of its weight; a paraphrase has 50 % in order and nearly all words of its answer, its last sentence (of one to four words, all).

A passage longer than a block's words is in several blocks' terms by hashing. Everything in a pass is done within a
document, so nothing is shuffled but the sums. Defined cases: null or empty texts and items match nothing; items of
fewer than ``least_words`` words are left out, as chance finds them everywhere; repeated rows are found each; an empty
benchmark or corpus gives no rows; extra columns pass through ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .wordhash import Words, words_of

WINDOW, STRIDE = 64, 32
MATCHES = "doc_id long, item_id long, first_word long, n_words long, common_words long, share double, cosine double, kind string"


@dataclass(frozen=True)
class Params:
    rank: int = 96
    extra: int = 16
    cosine: float = 0.45
    copy_share: float = 0.7
    copy_weight: float = 0.6
    loose_share: float = 0.5
    answer_share: float = 0.8
    least_words: int = 8
    #: A term in more than this part of a block's passages (and in more than two), or of the corpus, has no weight.
    common_part: float = 0.01
    common_corpus: float = 0.001
    #: Words of a block of the benchmark, and slots of its terms.
    block_words: int = 20_000
    slots: int = 1 << 14


@dataclass
class Query:
    item_id: int
    words: np.ndarray  # hashes
    answer: np.ndarray
    masks: dict[int, int] = field(default_factory=dict)


@dataclass
class Block:
    terms: np.ndarray  # sorted hashes of all words
    slot: np.ndarray  # of each term
    prior: np.ndarray  # of each slot, 0 for none
    queries: list[Query]


def _hashes(text: str) -> np.ndarray:
    return words_of(pa.array([text]), True, True).hash


def queries_of(items: list[tuple[int, str | None]], p: Params) -> list[Query]:
    out = []
    for item_id, text in items:
        words = _hashes(text or "")
        if len(words) < p.least_words:
            continue
        sentences = [h for h in map(_hashes, re.split(r"[.?!:\n]+", text)) if len(h)]
        parts = np.array_split(words, -(-len(words) // WINDOW))
        out += [Query(item_id, x, sentences[-1][-10:]) for x in parts]
    for q in out:
        for i, w in enumerate(q.words.tolist()):
            q.masks[w] = q.masks.get(w, 0) | 1 << i
    return out


def block_of(queries: list[Query], p: Params) -> Block:
    sets = [np.unique(q.words) for q in queries]
    terms, seen = np.unique(np.concatenate(sets), return_counts=True)
    slot = np.arange(len(terms)) if len(terms) <= p.slots else (terms % np.uint64(p.slots)).astype(np.int64)
    weight = np.where(seen > max(2, p.common_part * len(queries)), 0.0, np.log1p(len(queries) / seen))
    prior = np.zeros(int(slot.max()) + 1)
    np.maximum.at(prior, slot, weight)
    return Block(terms, slot, prior, queries)


#: Terms are looked up by the top bits of their hash first.
FILTER_BITS = 20


def _hits(words: np.ndarray, b: Block, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that are terms, and their slots."""
    at = np.flatnonzero(known[(words >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    found = np.minimum(np.searchsorted(b.terms, words[at]), len(b.terms) - 1)
    same = b.terms[found] == words[at]
    return at[same], b.slot[found[same]]


def _known(b: Block) -> np.ndarray:
    known = np.zeros(1 << FILTER_BITS, bool)
    known[(b.terms >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return known


def _summed(rows: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` by ``key``, which may come in any order."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(key):
        order = np.argsort(key, kind="stable")
        k = key[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        out[k[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def _passage_of(w: Words, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the passages of ``size`` words that places are in (texts apart), and each text's first number."""
    per = -(-np.diff(w.first) // size)
    begin = np.concatenate([[0], np.cumsum(per)])
    text = np.searchsorted(w.first, at, side="right") - 1
    return begin[text] + (at - w.first[text]) // size, begin


def _statistics(b: Block, noise: np.ndarray):
    """Sums over a task's passages: of each slot the passages that have it, and the sketch's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = _known(b), len(b.prior)
        total, passages = np.zeros((n, noise.shape[1] + 1)), 0
        for batch in batches:
            w = words_of(batch.column(0), True, True)
            at, slot = _hits(w.hash, b, known)
            passage, begin = _passage_of(w, at, WINDOW)
            passages += int(begin[-1])
            pair, times = np.unique(passage * n + slot, return_counts=True)
            passage, slot = pair // n, pair % n
            total[:, 0] += np.bincount(slot, minlength=n)
            open_ = b.prior[slot] > 0
            passage, slot, times = passage[open_], slot[open_], times[open_]
            for i in range(0, len(slot), 1 << 16):
                p, s = passage[i : i + (1 << 16)], slot[i : i + (1 << 16)]
                value = (times[i : i + (1 << 16)] * b.prior[s]).astype(np.float32)[:, None]
                _, local = np.unique(p, return_inverse=True)
                z = _summed(value * noise[s], local, int(local.max()) + 1)
                total[:, 1:] += _summed(value * z[local], s, n)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([passages], pa.int64()), pa.array([total.astype("<f4").tobytes()], pa.binary())], names=["task", "passages", "sums"])

    return run


def _added(group: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x, "<f4").astype(np.float64) for x in group["sums"]], axis=0)
    return pd.DataFrame({"task": [group["task"].iat[0]], "passages": [group["passages"].sum()], "sums": [total.astype("<f4").tobytes()]})


#: Tasks' sums that are added in one task.
FAN = 16


@dataclass
class Latent:
    idf: np.ndarray
    vectors: np.ndarray  # slots x rank


def fit(texts: DataFrame, b: Block, p: Params, seed: int = 7) -> Latent:
    """Document frequencies over all passages, and the leading right singular vectors of their TF-IDF matrix."""
    n = len(b.prior)
    width = min(p.rank + p.extra, n)
    noise = np.random.default_rng(seed).standard_normal((n, width)).astype(np.float32)
    schema = "task long, passages long, sums binary"
    parts = written(texts.mapInArrow(_statistics(b, noise), schema), "svd")
    while (parts.agg(F.max("task")).first()[0] or 0) > 0:
        parts = written(parts.withColumn("task", F.floor(F.col("task") / FAN).cast("long")).groupBy("task").applyInPandas(_added, schema), "svd")
    row = parts.first()
    sums = np.frombuffer(row["sums"], "<f4").reshape(n, width + 1).astype(np.float64) if row else np.zeros((n, width + 1))
    passages = row["passages"] if row else 0
    idf = np.where((b.prior > 0) & (sums[:, 0] <= max(2, p.common_corpus * passages)), np.log((1 + passages) / (1 + sums[:, 0])) + 1, 0.0)
    # The sketch is of passages weighted by the prior: T'T W. With D for the idf over the prior it gives A'A (W / D).
    d = np.divide(idf, b.prior, out=np.zeros(n), where=b.prior > 0)
    y = d[:, None] * sums[:, 1:]
    # The benchmark's passages are rows too, and count as much as all others, or the rank would go to the rest alone.
    own = np.zeros((len(b.queries), n))
    for i, q in enumerate(b.queries):
        np.add.at(own[i], b.slot[np.searchsorted(b.terms, q.words)], 1.0)
    times = max(1.0, float((sums[:, 0] * idf**2).sum() / max(1e-9, ((own * idf) ** 2).sum())))
    y += times * idf[:, None] * (own.T @ ((own * b.prior) @ noise))
    omega = np.divide(noise, d[:, None], out=np.zeros((n, width)), where=d[:, None] > 0)
    shift = 1e-6 * np.linalg.norm(y) + 1e-9
    y += shift * omega
    core = omega.T @ y
    values, turn = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-9
    left, _, _ = np.linalg.svd(y @ (turn[:, good] / np.sqrt(values[good])), full_matrices=False)
    return Latent(idf, left[:, : p.rank].astype(np.float32))


def _lcs(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence, all places of one side in the bits of a number."""
    row, full = 0, (1 << n) - 1
    for w in words:
        if m := masks.get(w):
            x = row | m
            row = x & ~(x - ((row << 1) | 1)) & full
    return row.bit_count()


class Search:
    def __init__(self, b: Block, latent: Latent, p: Params) -> None:
        self.b, self.p, self.known, self.idf = b, p, _known(b), latent.idf
        self.loads = (latent.vectors * latent.idf[:, None].astype(np.float32)).astype(np.float32)
        self.slots = [b.slot[np.searchsorted(b.terms, q.words)] for q in b.queries]
        vectors = np.stack([self.loads[s].sum(axis=0) for s in self.slots])
        norms = np.linalg.norm(vectors, axis=1)
        self.strong = norms > 1e-6
        self.queries = vectors / np.maximum(norms, 1e-6)[:, None]
        self.weak = [i for i, s in enumerate(self.slots) if not self.strong[i] or (latent.idf[s] > 0).sum() < 3]
        self.member = np.zeros((len(b.queries), len(b.prior)), bool)
        for i, s in enumerate(self.slots):
            self.member[i, s] = True

    def __call__(self, column: pa.Array) -> list[tuple]:
        """Matches as (row, item, first word, words, common words, share, cosine, kind)."""
        p, w = self.p, words_of(column, True, True)
        at, slot = _hits(w.hash, self.b, self.known)
        if not len(at):
            return []
        block, begin = _passage_of(w, at, STRIDE)
        n = int(begin[-1])
        heavy = self.idf[slot] > 0
        out: dict[tuple[int, int], tuple] = {}
        pairs: list[tuple[int, int, float]] = []
        for lo in range(0, n, 8192):
            hi = min(n, lo + 8193)  # one more, for the passage that goes on into it
            here = heavy & (block >= lo) & (block < hi)
            half = _summed(self.loads[slot[here]], block[here] - lo, hi - lo)
            last = begin[1:] - 1  # a text's last block has nothing of its own behind it
            last = last[(last >= lo) & (last < hi) & (np.diff(begin) > 0)]
            z = half.copy()
            z[:-1] += half[1:]
            z[last - lo] = half[last - lo]
            norm = np.linalg.norm(z, axis=1)
            use = np.flatnonzero(norm > 1e-6)
            use = use[use < 8192]
            cos = (z[use] / norm[use, None]) @ self.queries.T
            cos[:, ~self.strong] = 0
            k, q = np.nonzero(cos >= p.cosine)
            pairs += zip((use[k] + lo).tolist(), q.tolist(), cos[k, q].tolist(), strict=True)
        for q in self.weak:
            inside = self.member[q][slot]
            count = np.bincount(block[inside], minlength=n + 1)
            pairs += [(i, q, 0.0) for i in np.flatnonzero(count[:n] + count[1 : n + 1] >= p.loose_share * len(self.b.queries[q].words)).tolist()]
        text_of = np.searchsorted(begin, [i for i, _, _ in pairs], side="right") - 1 if pairs else []
        for (i, q, cosine), text in zip(pairs, text_of, strict=True):
            query = self.b.queries[q]
            size, first, end = len(query.words), int(w.first[text]), int(w.first[text + 1])
            a = max(first, first + (i - int(begin[text])) * STRIDE - size // 2)
            z = min(end, first + (i - int(begin[text])) * STRIDE + WINDOW + size // 2)
            x, y = np.searchsorted(at, [a, z])
            inside = self.member[q][slot[x:y]]
            if inside.sum() < p.loose_share * size:
                continue
            key = (int(text), query.item_id)
            found = self._checked(w, query, q, at[x:y][inside], slot[x:y][inside], a, z)
            if found and (key not in out or found[2] > out[key][4]):
                out[key] = (*key, found[0] - first, found[1], found[2], found[2] / size, cosine, found[3])
        return list(out.values())

    def _checked(self, w: Words, query: Query, q: int, hits: np.ndarray, slots: np.ndarray, a: int, z: int) -> tuple[int, int, int, str] | None:
        p, size = self.p, len(query.words)
        # The stretch of about the query's length with the most weight of its words.
        reach = size + size // 4
        weight = self.idf[slots] + 0.1
        sums = np.concatenate([[0.0], np.cumsum(weight)])
        stop = np.searchsorted(hits, hits + reach)
        best = int(np.argmax(sums[stop] - sums[:-1]))
        lo, hi = max(a, int(hits[best]) - size // 8), min(z, int(hits[best]) + reach)
        words = w.hash[lo:hi].tolist()
        common = _lcs(query.masks, size, words)
        share = common / size
        if share < p.loose_share:
            return None
        kind = None
        if share >= p.copy_share:
            need = self.idf[self.slots[q]]
            there = np.isin(query.words, w.hash[lo:hi])
            if need.sum() <= 0 or (need * there).sum() >= p.copy_weight * need.sum():
                kind = "copy"
        if kind is None:
            masks: dict[int, int] = {}
            for i, x in enumerate(query.answer.tolist()):
                masks[x] = masks.get(x, 0) | 1 << i
            if _lcs(masks, len(query.answer), words) >= p.answer_share * len(query.answer):
                kind = "paraphrase"
        return (lo, hi - lo, common, kind) if kind else None


def _blocks(benchmark: DataFrame, p: Params, item_id: str, text: str) -> Iterator[Block]:
    """The benchmark in blocks of a bounded number of words, one after the other."""
    rows = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t"))
    words = rows.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    n = -(-words // p.block_words)
    for k in range(n):
        items = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()
        if queries := queries_of([(r["i"], r["t"]) for r in items], p):
            yield block_of(queries, p)


def matches(docs: DataFrame, benchmark: DataFrame, p: Params | None = None, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of ``docs`` and item that it holds."""
    p = p or Params()
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = docs.sparkSession.createDataFrame([], MATCHES)
    for b in _blocks(benchmark, p, item_id, item_text):
        held = docs.sparkSession.sparkContext.broadcast((b, fit(rows.select("text"), b, p), p))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            search = Search(*held.value)
            for batch in batches:
                found = search(batch.column(1))
                ids = batch.column(0).to_pylist()
                columns = list(zip(*[(ids[r], *rest) for r, *rest in found], strict=True)) or [[]] * 8
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split(" ")[0] for x in MATCHES.split(", ")])

        out = out.unionByName(rows.mapInArrow(run, MATCHES))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, p: Params | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold an item; columns as given."""
    p = p or Params()
    at = docs.columns.index(text)
    for b in _blocks(benchmark, p, item_id, item_text):
        held = docs.sparkSession.sparkContext.broadcast((b, fit(docs.select(F.col(f"`{text}`").alias("text")), b, p), p))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            search = Search(*held.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, *_ in search(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
