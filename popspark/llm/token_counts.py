"""Token counts of a unigram model without the tokens: count-only Viterbi.

An Aho-Corasick automaton over the vocabulary gives, for every place of a text, the pieces that end there, longest
first. The best score of a place is the best over these pieces of the score at their start plus their own; an equal
score never replaces an earlier start. That is the tie rule of the tokenizers library's unigram model, which goes from
start to start and takes over only what is greater. A character that is no piece costs the least score less 10 and
counts its UTF-8 bytes, where the vocabulary has byte pieces, or one for a run of such characters. Beside the score only the
number of pieces is carried, so nothing is traced back.

Where no piece goes on over a blank, a text falls apart at blanks (and line feeds), and counts of short parts are
remembered, up to a number of characters.
That is done only if all scores are whole numbers, whose sums are the same in any order; else a text is one part.

Defined cases: a null or empty text has no tokens; texts of any length go through whole; rows repeat as given; an empty
table gives an empty table; extra columns are not returned, so their names don't matter.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLANK = "▁"
#: Fixed value: how far below the least score an unknown character is.
UNKNOWN_PENALTY = 10.0
#: Characters of parts that a worker remembers, and of the longest one.
REMEMBERED, LONGEST = 8 << 20, 200
COUNTS = "doc_id long, n_tokens long"


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        names = {p for p, _ in pieces}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.single = {p for p in names if len(p) == 1}
        parts = all(s == int(s) for _, s in pieces) and not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in names) and self.bytes
        lines = "" if any("\n" in p for p in names) else "\n"
        self.parts = re.compile(f" *[^ {lines}]+| +" + (f"|{lines}" if lines else "")) if parts else re.compile(r"(?s).+")
        self.known: dict[str, int] = {}
        self.held = 0  # characters in it

    def viterbi(self, text: str) -> int:
        """Pieces of the best path over ``text``, blanks written as BLANK."""
        n = len(text)
        if self.single.issuperset(text):
            return self._known_characters(text, n)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, match in self.found.iter(text):
            ends[last + 1].append(match)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for at in range(1, n + 1):
            best: float | None = None
            for length, own in ends[at]:
                if best is None or score[at - length] + own > best:
                    best, count[at], unknown[at] = score[at - length] + own, count[at - length] + 1, False
            char = text[at - 1]
            if char not in self.single:
                value = score[at - 1] + self.unknown
                if best is None or value > best:
                    best, unknown[at] = value, True
                    count[at] = count[at - 1] + (len(char.encode("utf-8", "surrogatepass")) if self.bytes else not unknown[at - 1])
            score[at] = best
        return count[n]

    def _known_characters(self, text: str, n: int) -> int:
        """As viterbi(), for texts whose characters all are pieces: each end has a match."""
        score, count, at = [0.0] * (n + 1), [0] * (n + 1), -1
        for last, (length, own) in self.found.iter(text):
            start = last + 1 - length
            value = score[start] + own
            if last != at:
                at = last
                score[last + 1], count[last + 1] = value, count[start] + 1
            elif value > score[last + 1]:
                score[last + 1], count[last + 1] = value, count[start] + 1
        return count[n]

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        parts = self.parts.findall(" " + text.replace(BLANK, " "))
        try:
            return sum(map(self.known.__getitem__, parts))
        except KeyError:
            if self.held > REMEMBERED:
                self.known.clear()
                self.held = 0
            known, long = self.known, {}
            for part in set(parts):
                if part not in known:
                    if len(part) > LONGEST:
                        long[part] = self.viterbi(part.replace(" ", BLANK))
                    else:
                        known[part] = self.viterbi(part.replace(" ", BLANK))
                        self.held += len(part)
            return sum(known[part] if len(part) <= LONGEST else long[part] for part in parts)


@functools.cache
def _counter(path: str) -> Counter:
    """One for each Python worker, which serves many tasks."""
    return Counter(vocabulary(path))


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            counts = [counter(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and n_tokens of every row. ``model``: a sentencepiece file that all executors have. No shuffle."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(_counted(model), COUNTS)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
