"""Words of whole texts as 64-bit hashes, an Arrow batch at a time.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return (none of which is
part of a longer UTF-8 character). The hash of a word is a polynomial in an odd base over its bytes, taken from running
sums and then mixed. Different words share one with a chance of about 2**-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
#: Bytes that are worked on at once; a longer word is taken whole.
SLAB = 1 << 17
U = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
SAME, LOWER = np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators when punctuation is not part of words: all ASCII characters but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        steps = np.empty((2, max(n, SLAB + 4096)), U)
        steps[:, 0], steps[0, 1:], steps[1, 1:] = 1, BASE, pow(BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(steps[0], dtype=U), np.cumprod(steps[1], dtype=U)]
    return _POWERS[0][:n], _POWERS[1]


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    texts: np.ndarray  # where each text begins, and the end
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each text, in the words, and their number

    def string(self, a: int, b: int) -> bytes:
        """The bytes from word a to word b, b excluded."""
        return self.data[self.start[a] : self.end[b - 1]].tobytes() if b > a else b""


def words_of(column: pa.Array, lower: bool = False, bare: bool = False) -> Words:
    """The words of a column of texts; nulls have none. ``lower``: A-Z count as a-z. ``bare``: words end at ASCII
    punctuation, and capital letters of Latin-1 count as small ones too."""
    spaces = NOT_ALNUM if bare else IS_SPACE
    column = column.cast(pa.large_string()).fill_null("")
    texts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[texts[0] : texts[-1]]
    texts = texts - texts[0]
    table, starts, ends, hashes, at = LOWER if lower else SAME, [], [], [], 0
    while at < len(data):
        to = min(at + SLAB, len(data))
        while to < len(data) and not spaces[data[to]]:  # on to the end of the word or text
            space = np.flatnonzero(spaces[data[to : to + 65536]])
            stop = to + (int(space[0]) if len(space) else min(65536, len(data) - to))
            edge = texts[np.searchsorted(texts, to)]
            to, done = min(stop, int(edge)), len(space) > 0 or edge <= stop
            if done:
                break
        part = data[at:to]
        solid = ~spaces[part]
        cut = np.zeros(len(part) + 1, bool)
        lo, hi = np.searchsorted(texts, [at, to], side="left")
        cut[texts[lo:hi] - at] = True
        cut[0] = cut[-1] = True
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1] | cut[1:-1]
        stops[:-1] &= ~solid[1:] | cut[1:-1]
        s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        power, inverse = _powers(len(part))
        part = table[part]
        if bare and lower:
            part[1:] += ((part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] <= 0x9E) & (part[1:] != 0x97)).astype(np.uint8) * np.uint8(32)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum((part.astype(U) + U(1)) * power, out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93)))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    start = join(starts, np.int64)
    return Words(data, texts, start, join(ends, np.int64), join(hashes, U), np.searchsorted(start, texts))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """One number for each k words in a row; for fewer words, one for all; for none, none."""
    n = len(hashes)
    size = min(k, n)
    if not n:
        return np.zeros(0, U)
    out = np.full(n - size + 1, size, U)
    for i in range(size):
        out = out * U(BASE) + mix(hashes[i : n - size + 1 + i] + U(i + 1))
    return mix(out)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())
