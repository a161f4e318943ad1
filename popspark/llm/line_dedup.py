"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words. Lines with one set are one class, whose first line (by document id, line number, row)
stands for all; later ones go. A class goes, too, if an earlier class has a Jaccard similarity of 0.8 or more with it.

1. Words are ordered rare ones first (``rarity``); two such sets share a word among the first n - ceil(t n) + 1 of each
   (prefix filter). So each class is posted under these words, with its size, the word's place and 128 hashed bits.
2. The list of a word is read in order of size. Two classes of it are candidates if they pass the length filter, the
   positional filter, which bounds the overlap by the words that come after the shared one, and a bound by the bits that
   one of them has alone. Candidates are joined at once to groups, so no pairs are listed.
3. A group's sets are made again from the texts of its lines only, meet in one task, and each is verified against those
   of near size. A group too large for one task is compared in blocks (``blocks``); a list too long for memory is
   joined to one group as it is.

Defined cases: null texts and lines of fewer than ``least_words`` different words are left as they are; very long lines
and texts are taken whole; of rows that are equal in all columns one is the first, and the others lose all lines that
count; an empty table gives an empty one; extra columns pass, and names that clash with the added ones are refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rarity
from .blocks import compared
from .common import refuse, row_keys, small_batches, table, words, written
from .components import components
from .wordhash import mix, words_of

#: Rows of about 100 bytes that are looked up by a broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Members of a group that one task compares, and their elements; postings that are read at once.
MOST_MEMBERS, MOST_ELEMENTS, POSTINGS = 4096, 1 << 22, 1 << 18
#: Pairs of postings that are tested at once.
PAIRS = 1 << 20
#: Sets of more words than ``LONG`` have ``WIDE`` hashed bits, too.
LONG, WIDE = 128, 512
#: Bits of a size and of a place in a posting; what doesn't fit stands at the greatest value and passes the filters.
SIZE_BITS, PLACE_BITS = 20, 12
#: A line's name: null id, id, line number, row hash; names are in the order of lines.
NAME = np.dtype([("no_id", "u1"), ("doc_id", ">u8"), ("line", ">u4"), ("row", ">u8")])


@dataclass(frozen=True)
class Params:
    num: int = 80
    den: int = 100
    least_words: int = 3


@dataclass
class Lines:
    """The lines with words of a batch, and their sets of words: set i is ``words[first[i]:first[i + 1]]``."""

    text: np.ndarray
    number: np.ndarray
    words: np.ndarray
    first: np.ndarray


def grades(counts: np.ndarray) -> np.ndarray:
    """Eight bits for each slot that rise with its count."""
    return np.minimum(255, 8 * np.log2(counts.astype(np.float64) + 1)).astype(np.uint64)


def _lines(column: pa.Array, grade: np.ndarray | None = None) -> Lines:
    """Words in the order of ``rarity`` (in ``grades``, then by hash) if they are given, else by hash."""
    w = words_of(column)
    breaks = np.flatnonzero(w.data == 10)
    # Line feeds and texts part lines.
    line = np.searchsorted(breaks, w.start) + (np.searchsorted(w.texts, w.start, side="right") - 1)
    ids, at = np.unique(line, return_index=True)
    of = np.searchsorted(ids, line)
    # Lines stay in order, so all are sorted in one go: 24 bits of line, 8 of grade, 32 of hash.
    rare = grade[rarity.slots(w.hash)] if grade is not None else np.zeros(len(of), np.uint64)
    key = (of.astype(np.uint64) << np.uint64(40)) | (rare << np.uint64(32)) | (w.hash >> np.uint64(32))
    order = np.argsort(key, kind="stable")
    tied = (key[order[1:]] == key[order[:-1]]) & (w.hash[order[1:]] != w.hash[order[:-1]])
    if tied.any() or len(ids) >= 1 << 24:
        order = np.lexsort((w.hash, rare, of))
    of, hashes = of[order], w.hash[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    of, hashes = of[new], hashes[new]
    text = np.searchsorted(w.texts, w.start[at], side="right") - 1
    number = np.searchsorted(breaks, w.start[at]) - np.searchsorted(breaks, w.texts[text])
    return Lines(text, number, hashes, np.searchsorted(of, np.arange(len(ids) + 1)))


def _node_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bytes for each set."""
    if len(first) < 2:
        return np.zeros((0, 2), ">u8")
    m = mix(hashes)
    return np.stack([np.add.reduceat(m, first[:-1]), np.bitwise_xor.reduceat(mix(m), first[:-1])], axis=1).astype(">u8")


def _bitmaps(hashes: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """``n`` hashed bits of each set of ``size`` elements, as longs."""
    bits = np.zeros((len(size), n), np.uint8)
    bits[np.repeat(np.arange(len(bits)), size), (hashes & np.uint64(n - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.int64).reshape(-1, n // 64)


def _binary(rows: np.ndarray, width: int) -> pa.Array:
    n = rows.size * rows.itemsize // width
    ends = (np.arange(n + 1) * width).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of one width, a row of bytes each."""
    if not len(column):
        return np.zeros((0, width), np.uint8)
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + width * len(column)].reshape(-1, width)


def _names(ids: pa.Array, row: np.ndarray, number: np.ndarray) -> np.ndarray:
    out = np.zeros(len(number), NAME)
    out["no_id"] = ids.is_null().to_numpy(zero_copy_only=False)
    out["doc_id"] = ids.fill_null(0).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
    out["line"], out["row"] = number, row.view(np.uint64) ^ np.uint64(1 << 63)
    return out


def _named(name: str) -> dict[str, Column]:
    """The parts of a name: doc_id, line, row."""
    part = lambda at, n: F.conv(F.hex(F.substring(name, at, n)), 16, -10).cast("long")
    signed = lambda at: part(at, 8).bitwiseXOR(F.lit(-(2**63)))
    no_id = F.substring(name, 1, 1) == F.lit(b"\x01")
    return {"doc_id": F.when(~no_id, signed(2)), "line": part(10, 4).cast("int"), "row": signed(14)}


LINES = "node binary, name binary, size int, w0 long, w1 long, wide binary, prefix array<int>"


def _emitted(p: Params, counts) -> Callable:
    """Rows (doc_id, row hash, text) -> the lines that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grade = grades(counts.value)
        for batch in batches:
            x = _lines(batch.column(2), grade)
            size = np.diff(x.first)
            node, bits = _node_keys(x.words, x.first), _bitmaps(x.words, size, 128)
            long = size > LONG
            wide = _bitmaps(x.words[np.repeat(long, size)], size[long], WIDE)
            ends = np.concatenate([[0], np.cumsum(long[size >= p.least_words]) * (WIDE // 8)]).astype(np.int32)
            has = np.packbits(long[size >= p.least_words], bitorder="little").tobytes()
            buffers = [pa.py_buffer(has), pa.py_buffer(ends.tobytes()), pa.py_buffer(wide[(size >= p.least_words)[long]].tobytes())]
            wide_bits = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, buffers)
            keep = np.flatnonzero(size >= p.least_words)
            n, begin = size[keep], x.first[:-1][keep]
            # Where a set with one word more is not like enough, only equal sets are, and those are one class.
            prefix = np.where(p.den * n < p.num * (n + 1), 0, n - -(-p.num * n // p.den) + 1)
            ends = np.concatenate([[0], np.cumsum(prefix)])
            at = np.arange(ends[-1]) - np.repeat(ends[:-1] - begin, prefix)
            posted = (x.words[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            text = pa.array(x.text[keep])
            names = _names(batch.column(0).take(text), batch.column(1).take(text).to_numpy(), x.number[keep])
            made = [
                _binary(node[keep], 16),
                _binary(names, NAME.itemsize),
                pa.array(n.astype(np.int32)),
                pa.array(bits[keep, 0]),
                pa.array(bits[keep, 1]),
                wide_bits,
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(posted)),
            ]
            yield pa.RecordBatch.from_arrays(made, names=["node", "name", "size", "w0", "w1", "wide", "prefix"])

    return run


CLASSES = "class long, name binary, source binary, size int, w0 long, w1 long, wide binary, prefix array<int>"


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines sorted by set and name -> the first one of each set, numbered, and the others with its name as source."""
    node, first, last = None, b"", b""
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes, names = _fixed(batch.column(0), 16), _fixed(batch.column(1), NAME.itemsize)
        new = np.ones(len(nodes), bool)
        new[1:] = (nodes[1:] != nodes[:-1]).any(axis=1)
        new[0] = nodes[0].tobytes() != node
        again = np.zeros(len(nodes), bool)  # the same line of a row that is there more than once
        again[1:] = (names[1:] == names[:-1]).all(axis=1) & ~new[1:]
        again[0] = not new[0] and names[0].tobytes() == last
        begun = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        sources = np.where(begun[:, None] >= 0, names[begun], np.frombuffer(first or bytes(NAME.itemsize), np.uint8))
        kept = np.flatnonzero(~again)
        is_new = new[kept]
        numbers = number + np.cumsum(is_new) - 1
        number += int(is_new.sum())
        node, last = nodes[-1].tobytes(), names[-1].tobytes()
        first = names[begun[-1]].tobytes() if begun[-1] >= 0 else first
        rows = batch.take(pa.array(kept))
        unset = pa.array(~is_new)
        blank = lambda c: pc.if_else(unset, pa.scalar(None, c.type), c)
        made = [
            blank(pa.array(numbers, pa.int64())),
            rows.column(1),
            pc.if_else(unset, _binary(np.ascontiguousarray(sources[kept]), NAME.itemsize), pa.scalar(None, pa.binary())),
            *[blank(rows.column(i)) for i in range(2, 7)],
        ]
        yield pa.RecordBatch.from_arrays(made, names=[x.split(" ")[0] for x in CLASSES.split(", ")])


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges a-b -> for each component the least node with each other one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        label = label[label]
        if (label == before).all():
            break
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def candidates(key: np.ndarray, klass: np.ndarray, bits: np.ndarray, wide: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Stars of classes that pass the filters, from postings sorted by word and size."""
    top = (1 << SIZE_BITS) - 1
    word, size, at = key >> 32, (key >> PLACE_BITS) & top, key & ((1 << PLACE_BITS) - 1)
    group = np.cumsum(np.concatenate([[0], word[1:] != word[:-1]])).astype(np.int64) if len(key) else word
    in_order = (group << SIZE_BITS) | size
    low = np.searchsorted(in_order, (group << SIZE_BITS) | -(-p.num * size // p.den))
    n, found = np.arange(len(key)) - low, [[np.zeros(0, np.int64)] * 2]
    ends = np.cumsum(n)
    start = 0
    while start < len(key):
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + PAIRS, side="right")))
        some = n[start:stop]
        late = np.repeat(np.arange(start, stop), some)
        early = np.arange(len(late)) - np.repeat(np.cumsum(some) - some - low[start:stop], some)
        a, b = size[early], size[late]
        need = -(-p.num * (a + b) // (p.num + p.den))
        most = np.minimum(at[early], at[late]) + 1 + np.minimum(a - at[early], b - at[late]) - 1
        lone = np.bitwise_count(bits[early] ^ bits[late]).sum(axis=1, dtype=np.int64)
        open_ = (((most >= need) & (lone <= a + b - 2 * need)) | (b == top)) & (klass[early] != klass[late])
        both = np.flatnonzero(open_ & (a > LONG) & (b < top))
        lone = np.bitwise_count(wide[early[both]] ^ wide[late[both]]).sum(axis=1, dtype=np.int64)
        open_[both] = lone <= (a + b - 2 * need)[both]
        if open_.any():
            found.append(_stars(klass[early[open_]], klass[late[open_]]))
        start = stop
    return _stars(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _postings(batch: pa.RecordBatch) -> np.ndarray:
    """A row of longs for each posting: key, class, two of bits, and the wide bits, 0 where there are none."""
    out = np.zeros((batch.num_rows, 4 + WIDE // 64), np.int64)
    for i in range(4):
        out[:, i] = batch.column(i).to_numpy()
    there = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
    if there.any():
        out[there, 4:] = np.ascontiguousarray(_fixed(batch.column(4).drop_null(), WIDE // 8)).view(np.int64)
    return out


def _joined(p: Params, most: int) -> Callable:
    """Postings (key, class, w0, w1, wide) sorted by key -> stars of candidates. At most about ``most`` are held; a
    longer list is joined as a whole."""

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def tested(rows: np.ndarray) -> pa.RecordBatch:
        bits, wide = (np.ascontiguousarray(x).view(np.uint64) for x in (rows[:, 2:4], rows[:, 4:]))
        return out(*candidates(rows[:, 0], rows[:, 1], bits, wide, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, center = [], 0, None
        for batch in batches:
            rows = _postings(batch)
            if center is not None:
                same = rows[:, 0] >> 32 == center[0]
                k = len(rows) if same.all() else int(same.argmin())
                yield out(np.full(k, center[1]), rows[:k, 1])
                rows = rows[k:]
                center = center if not len(rows) else None
            parts.append(rows)
            n += len(rows)
            if n < most:
                continue
            held = np.concatenate(parts)
            last = held[:, 0] >> 32 == held[-1, 0] >> 32
            cut = int(last.argmax())
            if cut:
                yield tested(held[:cut])
            held = held[cut:].copy()
            if len(held) >= most:
                center = (held[0, 0] >> 32, held[0, 1])
                yield out(np.full(len(held) - 1, center[1]), held[1:, 1])
                held = held[:0]
            parts, n = [held], len(held)
        if n:
            yield tested(np.concatenate(parts))

    return run


SETS = "node binary, group binary, size long, value binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, [(line, name, group)]) -> the sets of these lines."""
    for batch in batches:
        x = _lines(batch.column(0))
        wanted = {}
        for i, some in enumerate(batch.column(1).to_pylist()):
            wanted |= {(i, one["line"]): (one["name"], one["group"]) for one in some}
        at = [(i, wanted[k]) for i, k in enumerate(zip(x.text.tolist(), x.number.tolist(), strict=True)) if k in wanted]
        parts = [x.words[x.first[i] : x.first[i + 1]] for i, _ in at]
        made = [
            pa.array([name for _, (name, _) in at], pa.binary()),
            pa.array([group for _, (_, group) in at], pa.binary()),
            pa.array([len(e) for e in parts], pa.int64()),
            pa.array([e.tobytes() for e in parts], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(made, names=["node", "group", "size", "value"])


FOUND = "late binary, early binary"


def matched(names: list[bytes], sets: list[np.ndarray], p: Params) -> list[tuple[bytes, bytes]]:
    """Each name with the least name before it whose set is alike; sets in order of size."""
    size, rank = np.array([len(x) for x in sets]), np.empty(len(sets), np.int64)
    order = sorted(range(len(names)), key=names.__getitem__)
    rank[order] = np.arange(len(order))
    best = rank.copy()
    elements, codes = np.unique(np.concatenate(sets), return_inverse=True)
    first, here = np.concatenate([[0], np.cumsum(size)]), np.zeros(len(elements), np.int32)
    for i in range(1, len(sets)):
        low, own = int(np.searchsorted(p.den * size[:i], p.num * size[i])), codes[first[i] : first[i + 1]]
        if low == i:
            continue
        here[own] = 1
        common = np.add.reduceat(here[codes[first[low] : first[i]]], first[low:i] - first[low])
        here[own] = 0
        alike = low + np.flatnonzero(common * (p.num + p.den) >= p.num * (size[low:i] + size[i]))
        if len(alike):
            best[i] = min(best[i], int(rank[alike].min()))
            best[alike] = np.minimum(best[alike], rank[i])
    return [(names[i], names[order[best[i]]]) for i in np.flatnonzero(best < rank).tolist()]


def _verified(p: Params) -> Callable:
    """Rows (group, size, node, value, label) sorted by group, size, node -> late and early names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, names, sets = None, [], []

        def found() -> list[tuple[bytes, bytes]]:
            return matched(names, [np.frombuffer(x, np.uint64) for x in sets], p) if len(names) > 1 else []

        def out(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], names=["late", "early"])

        for batch in batches:
            rows = []
            for g, name, value in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if g != group:
                    rows += found()
                    group, names, sets = g, [], []
                if not names or names[-1] != name:  # a hub may be in its own block, too
                    names.append(name)
                    sets.append(value)
            yield out(rows)
        yield out(found())

    return run


def _matches(classes: DataFrame, rows: DataFrame, p: Params) -> DataFrame:
    """late, early: names of classes' first lines and of earlier ones that are alike, the least of each task."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.least("size", F.lit((1 << SIZE_BITS) - 1)).cast("long")
    place = F.least("at", F.lit((1 << PLACE_BITS) - 1)).cast("long")
    key = F.shiftleft(F.col("word").cast("long"), 32).bitwiseOR(F.shiftleft(size, PLACE_BITS)).bitwiseOR(place)
    posted = classes.where("source IS NULL").select("class", "size", "w0", "w1", "wide", F.posexplode("prefix").alias("at", "word"))
    posted = posted.select(key.alias("key"), "class", "w0", "w1", "wide").repartition(n, F.shiftright("key", 32))
    groups = components(posted.sortWithinPartitions("key", "class").mapInArrow(_joined(p, POSTINGS), "a long, b long"))
    named = F.unhex(F.lpad(F.hex("root"), 16, "0")).alias("group")
    wanted = classes.where("source IS NULL").select("class", "name", "size").join(groups, F.col("class") == F.col("node"))
    wanted = written(wanted.select("name", "size", named, *[c.alias(k) for k, c in _named("name").items()]), "line-wanted")
    stats = wanted.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("elements"))
    large = written(stats.where((F.col("n") > MOST_MEMBERS) | (F.col("elements") > MOST_ELEMENTS)).select("group"), "line-large")
    lines = F.collect_list(F.struct("line", "name", "group")).alias("lines")  # no more than the text has
    by_row = written(wanted.groupBy("row", "doc_id").agg(lines), "line-rows")
    few = wanted.count() <= BROADCAST_ROWS
    same = rows["row"].eqNullSafe(by_row["row"]) & rows["doc_id"].eqNullSafe(by_row["doc_id"])
    sets = rows.join(F.broadcast(by_row) if few else by_row, same).select("text", "lines").mapInArrow(_sets, SETS)

    def found_in(blocks: DataFrame) -> DataFrame:
        dealt = blocks.select("group", "size", "node", "value", "label").repartition(n, "group")
        return dealt.sortWithinPartitions("group", "size", "node").mapInArrow(_verified(p), FOUND)

    def left_of(placed: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
        everyone = placed.withColumn("label", F.lit(None).cast("binary"))
        return everyone.join(first.select(F.col("late").alias("node")).distinct(), "node", "left_anti"), everyone

    unlabelled = F.lit(None).cast("binary")
    if large.isEmpty():
        return found_in(sets.withColumn("label", unlabelled))
    sets = written(sets, "line-sets")
    most = compared(sets.join(large, "group"), p.num / p.den, MOST_MEMBERS, MOST_ELEMENTS, found_in, left_of, least_hubs=True)
    return found_in(sets.join(large, "group", "left_anti").withColumn("label", unlabelled)).unionByName(most)


def removals(docs: DataFrame, p: Params | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row (a hash of the whole row), doc_id, line, and doc_id and line of an earlier line that is like it."""
    p, spark = p or Params(), docs.sparkSession
    own_row, _ = row_keys(docs)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), own_row.alias("row"), F.col(f"`{text}`").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with small_batches(spark):
        counts = rarity.table_of(rows.select("text"), lambda batch: iter([words_of(batch.column(0)).hash]))
        lines = rows.mapInArrow(_emitted(p, counts), LINES).repartition(n, "node").sortWithinPartitions("node", "name")
        classes = written(lines.mapInArrow(_classes, CLASSES), "line-classes")
        found = written(_matches(classes, rows, p), "line-found")
    found = found.groupBy("late").agg(F.min("early").alias("early"))
    copies = classes.where("source IS NOT NULL").select("name", "source")
    copies = copies.join(found, F.col("source") == F.col("late"), "left")
    gone = copies.select("name", F.coalesce("early", "source").alias("from")).unionByName(found.select(F.col("late").alias("name"), F.col("early").alias("from")))
    own, source = _named("name"), _named("from")
    return gone.select(own["row"].alias("row"), own["doc_id"].alias("doc_id"), own["line"].alias("line"), source["doc_id"].alias("source_doc_id"), source["line"].alias("source_line"))


def deduplicated(docs: DataFrame, p: Params | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with later near-duplicate lines cut out of ``text``, and ``removed_lines`` (numbers from 0) and
    ``source_doc_ids`` (of the earlier lines) of each row."""
    p = p or Params()
    refuse(docs, {"removed_lines", "source_doc_ids", "__row", "__id", "__cut", "__doc", "__copy", "__rows"})
    cut = removals(docs, p, doc_id, text)
    # A row's lines only: as many as its text has.
    sources = F.sort_array(F.collect_set(F.struct("line", "source_doc_id"))).alias("__cut")
    cut = written(cut.groupBy(F.col("row").alias("__row"), F.col("doc_id").alias("__id")).agg(sources), "line-cut")
    own_row, _ = row_keys(docs)
    key = [own_row.alias("__row"), F.col(f"`{doc_id}`").cast("long").alias("__id")]
    repeated = written(docs.groupBy(*key).agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1"), "line-repeated")
    keyed = docs.select(*key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    same = lambda other: F.col("k.__row").eqNullSafe(F.col(f"{other}.__row")) & F.col("k.__id").eqNullSafe(F.col(f"{other}.__id"))
    numbered = keyed.withColumn("__copy", F.lit(0).cast("long"))
    if not repeated.isEmpty():
        # Equal rows can't be told apart: they are counted, and one is taken as the first.
        many = keyed.alias("k").join(repeated.alias("r"), same("r")).groupBy("k.__row", "k.__id").agg(F.first("k.__doc").alias("__doc"), F.first("r.__rows").alias("__rows"))
        many = many.select("__row", "__id", "__doc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__rows") - 1)).alias("__copy"))
        numbered = numbered.alias("k").join(repeated.alias("r"), same("r"), "left_anti").unionByName(many)
    met = numbered.alias("k").join(cut.alias("c"), same("c"), "left").select("k.__doc", "k.__copy", "c.__cut")
    body = F.col("__doc").getField(text)
    lines = F.split(body, "\n", -1)
    counted = F.transform(lines, lambda x, i: F.struct(i.alias("line"), F.size(F.array_distinct(words(x))).alias("n")))
    every = F.transform(F.filter(counted, lambda x: x["n"] >= p.least_words), lambda x: F.struct(x["line"], F.col("__doc").getField(doc_id).cast("long").alias("source_doc_id")))
    chosen = F.when(F.col("__copy") > 0, F.coalesce(every, F.col("__cut"))).otherwise(F.col("__cut"))
    met = met.withColumn("__cut", F.coalesce(chosen, F.array().cast("array<struct<line:int,source_doc_id:bigint>>")))
    numbers = F.transform("__cut", lambda x: x["line"])
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(numbers, i)), "\n")
    shown = [F.col("__doc").getField(c).alias(c) if c != text else F.when(F.size("__cut") > 0, kept).otherwise(body).alias(c) for c in docs.columns]
    return met.select(*shown, numbers.alias("removed_lines"), F.transform("__cut", lambda x: x["source_doc_id"]).alias("source_doc_ids"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), Params(least_words=1))
    return out.select("doc_id", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines", "source_doc_ids")
