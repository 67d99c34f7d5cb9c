"""Words, shingles and n-grams of many texts at once, as numpy arrays of hashes over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken together up to so many bytes (or one longer text), which bounds the arrays below.
CHUNK_BYTES = 1 << 18
#: Odd multipliers for hashes modulo 2^64; any would do.
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)

UPPER = np.arange(256, dtype=np.uint8)
UPPER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of a 64-bit hash (in place where it can)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes of some texts, the offsets of each (one more than texts), and the place of the first. Null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, at, data = texts.buffers()
    off = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if at is not None and len(texts) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(off, off[first] + CHUNK_BYTES, side="right")) - 1)
        yield data[off[first] : off[last]], off[first : last + 1] - off[first], first
        first = last


class Powers:
    """BASE to the power of 0, 1, ... and of its inverse, as far as was asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            of = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]))
            self.up, self.down = of(BASE), of(inverse)
        return self.up, self.down


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-last byte of each word (no white space in it), and how many words each text has."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(off) - 1, dtype=np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * PLACES[0])


def grams(word_hashes: np.ndarray, counts: np.ndarray, n: int, salt: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n words in a row of one text, in order, and how many each text has. salt: added at each first word."""
    many = np.maximum(counts - n + 1, 0)
    if len(word_hashes) < n:
        return np.zeros(0, dtype=np.uint64), many
    size = len(word_hashes) - n + 1
    total = np.zeros(size, dtype=np.uint64)
    for j in range(n):
        total += word_hashes[j : j + size] * PLACES[j]
    if salt is not None:
        total += salt[:size]
    ends = np.cumsum(counts)
    keep = np.zeros(len(word_hashes) + 1, dtype=np.int64)
    inside = many > 0
    np.add.at(keep, (ends - counts)[inside], 1)
    np.add.at(keep, (ends - counts + many)[inside], -1)
    return mix(total[np.cumsum(keep)[:size] > 0]), many
