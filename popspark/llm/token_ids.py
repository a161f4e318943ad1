"""Token ids in a binary format: blocks of ids with Elias-Fano coded document boundaries.

A folder of Parquet files holds one row for each block: its part (the place of the writing task in document order),
its number in the part, the id count before it in the part, counts of documents and ids, and a payload:

    magic "PSTB", id width (1 byte: 2 or 4), low bits l (1 byte), documents n (u32), ids u (u64),
    validity of document ids (n bits), document ids (n * i64),
    Elias-Fano of the n document ends: low parts (n * l bits), select samples (u32 for every 256th one), high bits,
    ids (u * width, little endian)

Ends take about 2 + log2(u / n) bits each. ``EliasFano.select`` goes from a sample over popcounts to one end without a
table of offsets. A task writes blocks as it goes and keeps one in memory; a task that runs again writes the same
blocks, and Spark's commit keeps one copy. Ids before a block follow from the totals of the parts before it.

A text is encoded in chunks that the pre-tokenizer keeps apart for certain: runs of blanks and line feeds with the
characters up to the next one, or with the letters up to a mark. Chunks that came twice are remembered, up to a number of
bytes; texts with other white space or special tokens go through whole.

Defined cases: a null or empty text gives the end id alone; null document ids come first; rows of one id are ordered by
their text's hash and repeat as given; a very long text is one document, over a block's size if need be; an empty table
gives no blocks; extra columns of any name don't matter, as only id and text are read.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, table

MAGIC, SAMPLE_EVERY = b"PSTB", 256
#: Ids after which a block ends.
BLOCK_IDS = 1 << 19
#: Characters and bytes of chunks that a worker remembers, and marks of chunks that it has seen once.
REMEMBERED, SEEN = 20 << 20, 1 << 23
#: White space other than blank and line feed.
OTHER_SPACE = re.compile("[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Letters (of Latin-1) and ASCII marks that the pre-tokenizer parts; an apostrophe may go with letters.
LETTERS, MARKS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", "!-&(-/:-@\\[-`{-~"
CHUNK = re.compile(f"[ \n]*+(?:[{LETTERS}]++(?=[{MARKS}])|[^ \n]+)|[ \n]+")
BLOCKS = "part int, block int, before long, docs int, ids long, payload binary"


class EliasFano:
    """A rising sequence of whole numbers from 0 to ``top``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, samples: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.samples, self.high = n, low_bits, low, samples, high

    @staticmethod
    def shape(n: int, top: int) -> tuple[int, int, int, int]:
        """Low bits, and bytes of low parts, samples and high bits."""
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        return low_bits, (n * low_bits + 7) // 8, 4 * ((n + SAMPLE_EVERY - 1) // SAMPLE_EVERY), (n + (top >> low_bits) + 8) // 8 if n else 0

    @classmethod
    def of(cls, values: np.ndarray, top: int) -> EliasFano:
        v, n = values.astype(np.uint64), len(values)
        low_bits, _, _, high_bytes = cls.shape(n, top)
        bits = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(high_bytes * 8, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, np.packbits(bits.ravel(), bitorder="little"), ones[::SAMPLE_EVERY].astype("<u4"), np.packbits(high, bitorder="little"))

    def to_bytes(self) -> bytes:
        return self.low.tobytes() + self.samples.tobytes() + self.high.tobytes()

    @classmethod
    def read(cls, data: memoryview, n: int, top: int) -> tuple[EliasFano, int]:
        low_bits, a, b, c = cls.shape(n, top)
        return cls(n, low_bits, np.frombuffer(data, np.uint8, a), np.frombuffer(data, "<u4", b // 4, a), np.frombuffer(data, np.uint8, c, a + b)), a + b + c

    def _low(self, i: int) -> int:
        at, value = i * self.low_bits, 0
        for k in range(self.low_bits):
            value |= int(self.low[(at + k) >> 3] >> ((at + k) & 7) & 1) << k
        return value

    def select(self, i: int) -> int:
        """Value ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE_EVERY]), i % SAMPLE_EVERY
        byte, word = at >> 3, int(self.high[at >> 3]) >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = (byte << 3) + (word & -word).bit_length() - 1
        return (one - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        """All values, as ``select`` gives them one by one."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        value = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits and self.n:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
            value |= bits @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return value


class Encoder:
    """Ids of whole texts as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(names.values()) + 1, np.int64)
        self.bytes_of[list(names.values())] = [len(n) for n in names]  # a byte-level name has a character for each byte
        self.known: dict[str, bytes] = {}
        self.held = 0  # characters and bytes in it
        self.seen, self.times = bytearray(SEEN), 0

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes] | None] = []
        whole: list[str] = []
        holes: list[tuple[list, int, str]] = []
        get, special = self.known.get, self.special
        for text in texts:
            if OTHER_SPACE.search(text) or any(x in text for x in special):
                whole.append(text)
                out.append(None)
                continue
            chunks = CHUNK.findall(text)
            ids = list(map(get, chunks))
            if None in ids:
                holes += [(ids, i, chunks[i]) for i, x in enumerate(ids) if x is None]
            out.append(ids)
        learned = self._learned(list({c for _, _, c in holes}))
        for ids, i, c in holes:
            ids[i] = learned[c]
        self._remember(learned)
        plain = iter(self._plain(whole))
        return [next(plain) if ids is None else b"".join(ids) for ids in out]

    def _remember(self, learned: dict[str, bytes]) -> None:
        """Keeps what comes for the second time: most chunks that are new never come again."""
        seen, known = self.seen, self.known
        for c, ids in learned.items():
            at = hash(c) & (SEEN - 1)
            if seen[at]:
                known[c] = ids
                self.held += len(c) + len(ids)
            else:
                seen[at] = 1
                self.times += 1
        if self.held > REMEMBERED:
            known.clear()
            self.held = 0
        if self.times > SEEN // 2:
            self.seen, self.times = bytearray(SEEN), 0

    def _learned(self, chunks: list[str]) -> dict[str, bytes]:
        """Chunks that begin with white space are encoded as one text, which keeps them apart, and cut by their bytes."""
        joined = [c for c in chunks if c[0] in " \n" and c[-1] not in " \n"]
        rest = [c for c in chunks if not (c[0] in " \n" and c[-1] not in " \n")]
        out = dict(zip(rest, self._plain(rest), strict=True))
        if not joined:
            return out
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(joined)], add_special_tokens=False)[0].ids, "<u4")
        ends, wanted = np.cumsum(self.bytes_of[ids]), np.cumsum([len(c.encode()) for c in joined])
        cuts = np.searchsorted(ends, wanted) + 1
        if cuts[-1] != len(ids) or (ends[cuts - 1] != wanted).any():
            return out | dict(zip(joined, self._plain(joined), strict=True))
        data, at = ids.tobytes(), 0
        for c, to in zip(joined, (4 * cuts).tolist(), strict=True):
            out[c] = data[at:to]
            at = to
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


@functools.cache
def _encoder(path: str) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    return Encoder(path)


def block(doc_ids: list[int | None], lengths: list[int], ids: bytes) -> bytes:
    """The payload of some documents; ``ids`` are 32-bit."""
    n, numbers, ends = len(doc_ids), np.frombuffer(ids, "<u4"), np.cumsum(np.array(lengths, np.int64))
    width = 2 if not len(numbers) or numbers.max() < 1 << 16 else 4
    ef = EliasFano.of(ends, len(numbers))
    valid = np.packbits(np.array([d is not None for d in doc_ids], np.uint8), bitorder="little").tobytes()
    return b"".join([struct.pack("<4sBBIQ", MAGIC, width, ef.low_bits, n, len(numbers)), valid, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), ef.to_bytes(), numbers.astype(f"<u{width}").tobytes()])


def parsed(payload: bytes) -> tuple[list[int | None], EliasFano, np.ndarray]:
    """Document ids, their ends and the ids of a block."""
    magic, width, low_bits, n, total = struct.unpack_from("<4sBBIQ", payload)
    if magic != MAGIC or width not in (2, 4):
        raise ValueError("not a block of token ids")
    at, view = struct.calcsize("<4sBBIQ"), memoryview(payload)
    valid = np.unpackbits(np.frombuffer(view, np.uint8, (n + 7) // 8, at), bitorder="little")[:n]
    at += (n + 7) // 8
    doc_ids = [d if v else None for d, v in zip(np.frombuffer(view, "<i8", n, at).tolist(), valid, strict=True)]
    at += 8 * n
    ef, used = EliasFano.read(view[at:], n, total)
    if ef.low_bits != low_bits:
        raise ValueError("a block's header and its boundaries differ")
    return doc_ids, ef, np.frombuffer(view, f"<u{width}", total, at + used)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts of about 256 KB of characters at a time."""
    ids, texts, held = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        ids.append(doc_id)
        texts.append(text.as_py() or "")
        held += len(texts[-1])
        if held >= 1 << 18:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _blocks(path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(path), struct.pack("<I", end_id)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        parts: list[bytes] = []
        held = 0

        def full() -> pa.RecordBatch:
            row = [[part], [number], [before], [len(doc_ids)], [held], [block(doc_ids, lengths, b"".join(parts))]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["part", "block", "before", "docs", "ids", "payload"])

        for batch in batches:
            for ids_of, texts in _slices(batch):
                for doc_id, ids in zip(ids_of, encoder.encode(texts), strict=True):
                    doc_ids.append(doc_id)
                    lengths.append(len(ids) // 4 + 1)
                    parts += (ids, end)
                    held += lengths[-1]
                    if held >= BLOCK_IDS:
                        yield full()
                        number, before = number + 1, before + held
                        doc_ids, lengths, parts, held = [], [], [], 0
        if doc_ids:
            yield full()

    return write


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all texts to the folder ``path`` in ascending order of document id."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # The row's place only parts rows that are equal in all else, so that many of them don't meet in one task.
    keys = ["doc_id", "__hash", "__place"]
    dealt = rows.withColumns({"__hash": F.xxhash64("text"), "__place": F.monotonically_increasing_id()}).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    dealt.select("doc_id", "text").mapInArrow(_blocks(tokenizer, end_id), BLOCKS).write.option("compression", "zstd").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, before, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            doc_ids, ef, ids = parsed(payload.as_py())
            ends = np.array([ef.select(i) for i in range(ef.n)], np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            values = [pa.array(doc_ids, pa.int64()), pa.array([part] * len(ends), pa.int32()), pa.array(starts + before, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(values, names=["doc_id", "part", "start", "n_tokens", "ids_crc32"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # One row for each writing task.
    totals = blocks.groupBy("part").agg(F.sum("ids").alias("ids"))
    bases = totals.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    found = blocks.select("part", "before", "payload").mapInArrow(_read, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_index(spark, path)
