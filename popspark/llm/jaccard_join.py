"""Exact Jaccard self-join of documents on word n-grams, and its connected components.

1. Documents become sets of hashed n-grams. Equal sets are one node, so copies cost nothing further.
2. A set's n-grams are ordered rare ones first (``rarity``); two sets that link share one among the first
   n - ceil(t n) + 1 of each. Sets that share such an n-gram stand in one tile, in order of size; it is cut where the
   next size is too large to link. Tiles of the same members count once.
3. In a tile, each member is compared with those of near size before it: bit counts of hashed bitmaps bound the overlap
   from above. Members that the bound leaves together are joined; what is joined over
   all tiles is a candidate group. Linked sets always stand in one group, and each set is in one group only.
4. A group's sets are made again from the texts of its members only, and meet in one task, in order of size: sorted
   codes of their elements are intersected, unless two sets are known to be in one component already.
5. A tile of more than ``SMALL_TILE`` members is not compared but joined as it is. A group of more members, or of more
   than ``MOST_ELEMENTS`` elements, is cut into blocks by size band. Each block meets some hubs of its own and the
   neighbouring bands; then those members that are not in the group's largest component meet all blocks of near bands.

So what moves is a tile's members once, a group's sets once, and of a large group hubs and the few that are left; no
pairs are listed. Defined cases: texts without words have an empty set and link with nothing; texts with fewer words
than n are one n-gram; very long texts are whole sets; null ids are never a component's id unless all its ids are null;
repeated rows share a component; an empty table gives an empty one; extra columns of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rarity
from .blocks import compared
from .common import discard, row_keys, small_batches, table, written
from .components import components
from .wordhash import mix, shingles, words_of

#: Rows of 80 bytes that are looked up by a broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Members of a tile, a group or a block that one task compares, and their elements (of 8 bytes).
SMALL_TILE, MOST_ELEMENTS = 4096, 1 << 22
#: Members of each size band of a large group that all its blocks meet first.
HUBS = 8
#: Sets that are intersected with one set at once.
AT_ONCE = 64
STARS = "a binary, b binary"


@dataclass(frozen=True)
class Params:
    n: int = 3
    #: Two sets link when ``den`` * intersection >= ``num`` * union.
    num: int = 90
    den: int = 100
    lower: bool = True

    def prefix(self, size: int) -> int:
        return size - -(-self.num * size // self.den) + 1

    def needed(self, both):
        """The least intersection with which two sets of these sizes together link."""
        return -(-self.num * both // (self.num + self.den))


def _ngrams(column: pa.Array, p: Params) -> Iterator[np.ndarray]:
    w = words_of(column, p.lower)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        yield shingles(w.hash[a:b], p.n)


def _sets(column: pa.Array, p: Params) -> Iterator[np.ndarray]:
    return map(np.unique, _ngrams(column, p))


def _node(x: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    m = mix(x)
    both = [m.sum(dtype=np.uint64) ^ np.uint64(len(x)), np.bitwise_xor.reduce(mix(m)) if len(m) else 0]
    return np.array(both, ">u8").tobytes()


def _bitmap(x: np.ndarray) -> bytes:
    """A bitmap of one to two bits for each element, of a power of two and at least 256."""
    bits = np.zeros(1 << max(8, len(x).bit_length()), np.uint8)
    bits[(mix(x) & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


NODES = "k1 long, k2 long, doc_id long, n_shingles long, node binary, prefix array<long>, bits binary"


def _nodes(p: Params, counts) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, node, prefix, bits = [], [], [], []
            for x in _sets(batch.column(3), p):
                size.append(len(x))
                node.append(_node(x))
                prefix.append(rarity.rare_first(x, counts.value)[: p.prefix(len(x)) if len(x) else 0].view(np.int64))
                bits.append(_bitmap(x))
            made = [
                pa.array(size, pa.int64()),
                pa.array(node, pa.binary()),
                pa.array(prefix, pa.list_(pa.int64())),
                pa.array(bits, pa.binary()),
            ]
            names = ["k1", "k2", "doc_id", "n_shingles", "node", "prefix", "bits"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=names)

    return run


def _names(column: pa.Array) -> np.ndarray:
    """The 16-byte values of a binary column, a row each."""
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    data = column.buffers()[2] if len(column) else b""
    return np.frombuffer(data, np.uint8)[first : first + 16 * len(column)].reshape(-1, 16)


def _binaries(rows: np.ndarray) -> pa.Array:
    ends = (np.arange(len(rows) + 1) * 16).astype(np.int32)
    buffers = [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())]
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), buffers)


TILES = "tile binary, whole boolean, members array<binary>"


def _tiles_of(nodes: np.ndarray, size: np.ndarray, whole: bool) -> pa.RecordBatch:
    """Runs of ``size`` members each as tiles, named by their members."""
    first = np.concatenate([[0], np.cumsum(size)])
    names = np.zeros((0, 16), np.uint8)
    if len(size):
        halves = np.ascontiguousarray(nodes).view(np.uint64)
        m = mix(halves[:, 0] ^ mix(halves[:, 1]))
        keys = np.stack([np.add.reduceat(m, first[:-1]), np.bitwise_xor.reduceat(mix(m), first[:-1])], axis=1)
        names = keys.view(np.uint8).reshape(-1, 16)
    members = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), _binaries(nodes))
    made = [_binaries(names), pa.array(np.full(len(size), whole)), members]
    return pa.RecordBatch.from_arrays(made, names=["tile", "whole", "members"])


def _stars_of(center: np.ndarray, others: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """A long run in parts, each with ``center`` first."""
    for i in range(0, len(others), most):
        part = np.concatenate([center[None], others[i : i + most]])
        yield _tiles_of(part, np.array([len(part)]), False)


def _tiles(p: Params, most: int) -> Callable:
    """Runs of one token in rows (token, size, node) sorted by all, cut where the next size is too large to link. Of a
    run longer than ``most`` only the first member is kept in memory, and it goes in parts that have that member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, center = None, None
        held, held_sizes = np.zeros((0, 16), np.uint8), np.zeros(0, np.int64)
        for batch in batches:
            t, sizes, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _names(batch.column(2))
            if center is not None:
                goes_on = t == token
                k = len(t) if goes_on.all() else int(goes_on.argmin())
                yield from _stars_of(center, nodes[:k], most)
                t, sizes, nodes = t[k:], sizes[k:], nodes[k:]
                center = center if not len(t) else None
            if not len(t):
                continue
            if len(held):
                t = np.concatenate([np.full(len(held), token), t])
                sizes, nodes = np.concatenate([held_sizes, sizes]), np.concatenate([held, nodes])
            new = (t[1:] != t[:-1]) | (p.num * sizes[1:] > p.den * sizes[:-1])
            first = np.flatnonzero(np.concatenate([[True], new]))
            size = np.diff(np.append(first, len(t)))
            ended = np.arange(len(size)) < len(size) - 1
            short = ended & (size > 1) & (size <= most)
            yield _tiles_of(nodes[np.repeat(short, size)], size[short], True)
            for i in np.flatnonzero(ended & (size > most)):
                yield from _stars_of(nodes[first[i]], nodes[first[i] + 1 : first[i] + size[i]], most)
            token, held, held_sizes = t[-1], nodes[first[-1] :], sizes[first[-1] :]
            if len(held) > most:
                center = held[0].copy()
                yield from _stars_of(center, held[1:], most)
                held, held_sizes = held[:0], held_sizes[:0]
        if len(held) > 1:
            yield _tiles_of(held, np.array([len(held)]), True)

    return run


class Joined:
    """Which of some members are joined: members of one label are."""

    def __init__(self, labels: list | None, n: int) -> None:
        self.label = np.arange(n) if labels is None else np.unique(labels, return_inverse=True)[1]

    def join(self, i: int, others: np.ndarray) -> None:
        for x in np.unique(self.label[others]).tolist():
            if x != self.label[i]:
                self.label[self.label == x] = self.label[i]

    def stars(self) -> list[tuple[int, int]]:
        """The first member of each label with the others."""
        _, first, of = np.unique(self.label, return_index=True, return_inverse=True)
        return [(int(first[k]), i) for i, k in enumerate(of.tolist()) if first[k] != i]


def _folded(bits: bytes, size: int) -> int:
    """The bitmap of ``size`` bytes: places are the low bits of hashes, so halves are joined by OR."""
    while len(bits) > size:
        half = len(bits) // 2
        bits = (int.from_bytes(bits[:half], "little") | int.from_bytes(bits[half:], "little")).to_bytes(half, "little")
    return int.from_bytes(bits, "little")


def may_link(size_a: int, bits_a: bytes, size_b: int, bits_b: bytes, p: Params) -> bool:
    """An element sets one bit, so each bit that one side has alone is an element that the other side lacks."""
    a, b = (_folded(x, min(len(bits_a), len(bits_b))) for x in (bits_a, bits_b))
    return min(size_a - (a & ~b).bit_count(), size_b - (b & ~a).bit_count()) >= p.needed(size_a + size_b)


def bounded(size: list[int], bits: list[bytes], p: Params) -> Joined:
    """Members, in order of size, joined where bit counts leave it open that they link."""
    n, sizes = len(size), np.array(size)
    out = Joined(None, n)
    if n <= 8:
        for i in range(1, n):
            near = [j for j in range(i) if p.den * size[j] >= p.num * size[i] and may_link(size[i], bits[i], size[j], bits[j], p)]
            out.join(i, np.array(near, np.int64))
        return out
    length = np.array([len(x) for x in bits])
    widths = np.unique(length).tolist()
    rows = {w: np.array([np.frombuffer(_folded(x, w).to_bytes(w, "little"), np.uint64) if len(x) >= w else np.zeros(w // 8, np.uint64) for x in bits]) for w in widths}
    for i in range(1, n):
        low = int(np.searchsorted(p.den * sizes[:i], p.num * size[i]))
        for w in widths:
            j = np.arange(low, i)[length[low:i] == w]
            j = j[out.label[j] != out.label[i]]
            if len(j):
                a, b = rows[w][i], rows[w][j]
                most = np.minimum(size[i] - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), sizes[j] - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
                out.join(i, j[most >= p.needed(size[i] + sizes[j])])
    return out


def linked(sets: list[np.ndarray], p: Params, labels: list | None = None) -> Joined:
    """Sets, in order of size, joined where they link; those of one of ``labels`` are joined before."""
    size = np.array([len(x) for x in sets])
    out = Joined(labels, len(sets))
    if len(sets) == 2:
        if p.den * size[0] >= p.num * size[1] and len(np.intersect1d(*sets, assume_unique=True)) >= p.needed(int(size.sum())):
            out.join(1, np.array([0]))
        return out
    elements, codes = np.unique(np.concatenate(sets), return_inverse=True)
    first, here = np.concatenate([[0], np.cumsum(size)]), np.zeros(len(elements), np.int32)
    for i in range(1, len(sets)):
        low, own = int(np.searchsorted(p.den * size[:i], p.num * size[i])), codes[first[i] : first[i + 1]]
        here[own] = 1
        for hi in range(i, low, -AT_ONCE):
            lo = max(low, hi - AT_ONCE)
            apart = out.label[lo:hi] != out.label[i]
            if apart.any():
                common = np.add.reduceat(here[codes[first[lo] : first[hi]]], first[lo:hi] - first[lo])
                out.join(i, lo + np.flatnonzero(apart & (common >= p.needed(size[lo:hi] + size[i]))))
        here[own] = 0
    return out


def _by_group(joined: Callable[[list, list, list], Joined]) -> Callable:
    """Rows (group, size, node, value, label) sorted by group, size and node -> stars of nodes that are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size, node, value, label = None, [], [], [], []

        def stars() -> list[tuple[bytes, bytes]]:
            return [(node[i], node[j]) for i, j in joined(size, value, label).stars()] if len(node) > 1 else []

        for batch in batches:
            found = []
            for g, s, x, v, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    found += stars()
                    group, size, node, value, label = g, [], [], [], []
                if not node or node[-1] != x:  # a hub may be in its own block, too
                    size.append(s)
                    node.append(x)
                    value.append(v)
                    label.append(y)
            yield _star_batch(found)
        yield _star_batch(stars())

    return run


def _star_batch(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    sides = [pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(sides, names=["a", "b"])


def _grouped_stars(rows: DataFrame, joined: Callable[[list, list, list], Joined]) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("group", "size", "node", "value", "label").repartition(n, "group")
    return dealt.sortWithinPartitions("group", "size", "node").mapInArrow(_by_group(joined), STARS)


def _linked_stars(rows: DataFrame, p: Params) -> DataFrame:
    """Stars of linked nodes in rows (group, size, node, value: a set's bytes, label)."""

    def joined(_, values: list[bytes], labels: list) -> Joined:
        return linked([np.frombuffer(x, np.uint64) for x in values], p, labels if labels[0] is not None else None)

    return _grouped_stars(rows, joined)


def _full_sets(p: Params) -> Callable:
    """Rows (node, group, text) -> node, group, size, value: the set's sorted elements; each node once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in batches:
            for node, group, x in zip(*(c.to_pylist() for c in batch.columns[:2]), _sets(batch.column(2), p), strict=True):
                if node in done or _node(x) != node:
                    continue
                done.add(node)
                row = [[node], [group], [len(x)], [x.tobytes()]]
                kinds = (pa.binary(), pa.binary(), pa.int64(), pa.binary())
                made = [pa.array(v, t) for v, t in zip(row, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(made, names=["node", "group", "size", "value"])

    return run


def _candidate_groups(classes: DataFrame, p: Params) -> DataFrame:
    """node, root: the candidate group of each class that may link with another."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = classes.select(F.explode("prefix").alias("token"), "size", "node").repartition(n, "token")
    tiles = posted.sortWithinPartitions("token", "size", "node").mapInArrow(_tiles(p, SMALL_TILE), TILES)
    tiles = written(tiles.groupBy("tile", "whole").agg(F.first("members").alias("members")), "jaccard-tiles")
    rows = tiles.where("whole").select(F.col("tile").alias("group"), F.explode("members").alias("node"))
    rows = rows.join(classes.select("node", "size", F.col("bits").alias("value")), "node")
    rows = rows.withColumn("label", F.lit(None).cast("binary"))
    stars = _grouped_stars(rows, lambda size, bits, _: bounded(size, bits, p))
    long = tiles.where("NOT whole").select(F.col("members")[0].alias("a"), F.explode("members").alias("b"))
    roots = components(stars.unionByName(long))
    discard(tiles)
    return roots


def _large_group_stars(sets: DataFrame, p: Params) -> DataFrame:
    """Stars of linked nodes of groups that are too large for one task, from their rows (node, group, size, value)."""

    def left_of(placed: DataFrame, stars: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members outside of their group's largest component; labels are components."""
        labels = written(components(stars), "jaccard-labels")
        everyone = placed.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
        sizes = everyone.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
        most = sizes.groupBy("group").agg(F.max(F.struct("n", "label"))["label"].alias("largest"))
        return everyone.join(most, "group").where(F.col("label") != F.col("largest")).drop("largest"), everyone

    return compared(sets, p.num / p.den, SMALL_TILE, MOST_ELEMENTS, lambda rows: _linked_stars(rows, p), left_of, HUBS)


def _roots(classes: DataFrame, rows: DataFrame, p: Params) -> DataFrame:
    """node, root of the classes that link with another."""
    groups = written(_candidate_groups(classes, p), "jaccard-groups")
    wanted = groups.join(classes.select("node", "row", "size"), "node")
    wanted = written(wanted.select("node", F.col("root").alias("group"), "row.k1", "row.k2", "size"), "jaccard-wanted")
    few = wanted.count() <= BROADCAST_ROWS
    fetched = wanted.select("node", "group", "k1", "k2")
    texts = rows.select("k1", "k2", "text").join(F.broadcast(fetched) if few else fetched, ["k1", "k2"])
    sets = texts.select("node", "group", "text").mapInArrow(_full_sets(p), "node binary, group binary, size long, value binary")
    stats = wanted.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("elements"))
    large = written(stats.where((F.col("n") > SMALL_TILE) | (F.col("elements") > MOST_ELEMENTS)).select("group"), "jaccard-hot")
    if large.isEmpty():
        stars = _linked_stars(sets.withColumn("label", F.lit(None).cast("binary")), p)
        return stars.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(stars.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    sets = written(sets.dropDuplicates(["node"]), "jaccard-sets")
    small = sets.join(large, "group", "left_anti").withColumn("label", F.lit(None).cast("binary"))
    return components(_linked_stars(small, p).unionByName(_large_group_stars(sets.join(large, "group"), p)))


def grouped(docs: DataFrame, p: Params | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """k1, k2 (hashes of the whole row), doc_id, n_shingles and component_id of every row of ``docs``.

    ``component`` names the component where ids repeat; it is null for an empty set.
    """
    p, spark = p or Params(), docs.sparkSession
    k1, k2 = row_keys(docs)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    with small_batches(spark):
        counts = rarity.table_of(rows.select("text"), lambda batch: _ngrams(batch.column(0), p))
        nodes = written(rows.mapInArrow(_nodes(p, counts), NODES), "jaccard-nodes")
        classes = nodes.where("n_shingles > 0").groupBy("node").agg(
            F.first("n_shingles").alias("size"),
            F.first("prefix").alias("prefix"),
            F.first("bits").alias("bits"),
            F.min("doc_id").alias("least"),
            F.min(F.struct("k1", "k2")).alias("row"),
        )
        classes = written(classes, "jaccard-classes")
        roots = written(_roots(classes, rows, p), "jaccard-roots")
    least = roots.join(classes.select("node", "least"), "node")
    ids = least.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = least.select("node", "root").join(ids, "root")
    own = classes.select("node", "least").join(joined, "node", "left")
    own = own.select("node", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "node").alias("component"))
    some = nodes.where("n_shingles > 0").select("k1", "k2", "doc_id", "n_shingles", "node").join(own, "node").drop("node")
    none = nodes.where("n_shingles = 0").select("k1", "k2", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("component"))
    return some.select("k1", "k2", "doc_id", "n_shingles", "component_id", "component").unionByName(none)


def one_of_each(docs: DataFrame, p: Params, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the least id. Texts without words all stay."""
    bare = [F.col(f"`{c}`") for c in docs.columns]
    found = grouped(docs, p, doc_id, text)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "k1", "k2")).alias("r")
    least = found.where("n_shingles > 0").groupBy("component").agg(first).select("r.k1", "r.k2")
    stays = least.unionByName(found.where("n_shingles = 0").select("k1", "k2").distinct())
    k1, k2 = row_keys(docs)
    keyed = docs.select(k1.alias("__k1"), k2.alias("__k2"), F.struct(*bare).alias("__doc"))
    kept = keyed.join(stays.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")), ["__k1", "__k2"])
    return kept.dropDuplicates(["__k1", "__k2"]).select("__doc.*")


def op9_tiled_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grouped(docs).select("doc_id", "n_shingles", "component_id")
