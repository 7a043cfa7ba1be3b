"""Minimal perfect hashing of whole numbers in buckets, built and read with numpy.

A bucket's keys are placed in levels of bits: at each level every key has one position, keys alone at theirs set its
bit, the others go on to the next level. The number of set bits before a key's own is its index, from 0 without gaps.
"""

from __future__ import annotations

import numpy as np

from .hashing import mix

#: Bits of a level for each key that reaches it.
ROOM = 2


def _position(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_position(keys, -1) % np.uint64(buckets)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Distinct ``keys`` -> bits of each level (multiples of 64) and the words of all levels."""
    sizes, words, rest = [], [], keys
    while len(rest):
        bits = max(64, -(-len(rest) * ROOM // 64) * 64)
        at = (_position(rest, len(sizes)) % np.uint64(bits)).astype(np.int64)
        alone = np.bincount(at, minlength=bits) == 1
        sizes.append(bits)
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        rest = rest[~alone[at]]
    return sizes, np.concatenate(words) if words else np.zeros(0, np.uint64)


class Index:
    """The hash of several buckets as one: bucket after bucket, indices without gaps over all of them."""

    def __init__(self, buckets: list[int], sizes: list[list[int]], words: list[np.ndarray], total: int):
        levels = max(map(len, sizes), default=0)
        self.total, self.levels = total, levels
        self.size = np.zeros((total, levels), np.uint64)  # 0: no such level
        self.start = np.zeros((total, levels), np.int64)
        at = 0
        for b, own in zip(buckets, sizes):
            for level, bits in enumerate(own):
                self.size[b, level], self.start[b, level] = bits, at
                at += bits
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; a key that wasn't built in gets any index or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, bucket = np.arange(len(keys)), bucket_of(keys, self.total)
        for level in range(self.levels):
            bits = self.size[bucket[left], level]
            left, bits = left[bits > 0], bits[bits > 0]
            if not len(left):
                break
            at = self.start[bucket[left], level] + (_position(keys[left], level) % bits).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) > 0
            low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            found = self.before[word] + np.bitwise_count(low).astype(np.int64)
            out[left[hit]] = found[hit]
            left = left[~hit]
        return out
