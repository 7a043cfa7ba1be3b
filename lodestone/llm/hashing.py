"""Hashes of words and byte windows over whole Arrow batches, with numpy.

All arithmetic is modulo 2**64. A window's hash is a polynomial in an odd base over random byte values, taken
from running sums, so every window of a buffer costs a few machine operations whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time: bounds a task's memory. A longer document is hashed on its own.
SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Roller:
    """Hashes of byte windows under one random base and byte table."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = np.uint64(int(rng.integers(1 << 62)) * 4 + 3)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.values = rng.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, SLICE + 1)
            self.powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, self.base))))
            self.inverses = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, self.inverse))))

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums: entry i is over the first i bytes."""
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes ``start`` to ``end`` (exclusive), their lengths included."""
        return mix((sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(np.uint64))

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all windows of ``width`` bytes; as ``spans`` gives them."""
        n = max(0, len(sums) - width)
        return mix((sums[width : width + n] - sums[:n]) * self.inverses[:n] + np.uint64(width))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its values; null is empty."""
    column = column.cast(pa.large_string()) if column.null_count == 0 else column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of ``SLICE`` bytes together at most, or of one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``data``: runs of bytes that aren't ASCII white space."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


class Shingler:
    """Sorted distinct hashes of each document's word shingles, A-Z lower-cased."""

    def __init__(self, n: int, seed: int = 5):
        self.n, self.roller = n, Roller(seed)
        self.factors = np.random.default_rng(seed + 1).integers(1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """One array a document: all shingles, or the whole sequence of a document with fewer words; empty without words."""
        data, offsets = texts(column)
        for i, j in slices(offsets):
            at = offsets[i : j + 1] - offsets[i]
            part = _LOWER[data[offsets[i] : offsets[j]]]
            start, end = words(self._apart(part, at))
            first = np.searchsorted(start, self._moved(at))
            hashes = self.roller.spans(self.roller.sums(self._apart(part, at)), start, end)
            yield from self._of(hashes, first)

    def _apart(self, part: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The documents with a space after each, so that words don't join."""
        return np.insert(part, at[1:], 0x20)

    def _moved(self, at: np.ndarray) -> np.ndarray:
        return at + np.arange(len(at))

    def _of(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
        m = max(0, len(hashes) - self.n + 1)
        shingles = np.zeros(m, np.uint64)
        for k, f in enumerate(self.factors):
            shingles += hashes[k : k + m] * f
        shingles = mix(shingles)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= self.n:
                yield np.unique(shingles[a : b - self.n + 1])
            elif b > a:
                short = hashes[a:b] * self.factors[: b - a]
                yield mix(np.array([short.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
            else:
                yield np.empty(0, np.uint64)
