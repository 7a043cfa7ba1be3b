"""What ``difflib`` finds in pairs of texts, for an Arrow batch of pairs at once: pairs lie along the last axis of an array."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa

#: From this length on, ``difflib`` leaves out characters that are frequent in the second text.
LONG = 200
#: Cells of a table of positions by positions by pairs.
CELLS = 2_000_000


class Texts:
    """Characters of the texts of a column, one after the other, and where each text begins."""

    def __init__(self, column: pa.Array):
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        at = (at - at[0]).astype(np.int64)
        if data.size and data.max() >= 0x80:
            begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            data, at = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), begins[at]
        self.column, self.codes, self.starts, self.lengths = column, data, at[:-1], np.diff(at)

    def rows(self, which: np.ndarray, kind, pad: int) -> np.ndarray:
        """Characters of some texts by position and text, filled up with the ``pad``-th value from the largest of ``kind``."""
        return _cut(self.codes[None, :], None, self.starts[which], self.lengths[which], kind, pad)


def _cut(codes: np.ndarray, which: np.ndarray | None, starts: np.ndarray, lengths: np.ndarray, kind, pad: int) -> np.ndarray:
    """From each of the texts ``which`` (columns of ``codes``; one for all if none) ``lengths`` characters from ``starts``."""
    place = np.arange(lengths.max(initial=0))[:, None]
    inside, fill = place < lengths, np.iinfo(kind).max - pad
    if not place.size:
        return np.zeros((0, len(lengths)), kind)
    place = np.where(inside, place + starts, 0)
    taken = codes[0][place] if which is None else codes[place, which]
    return np.where(inside, taken, fill).astype(kind, copy=False)


def matched(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> np.ndarray:
    """Characters in matching blocks of each pair: the longest common block, the first in ``a`` and then in ``b`` of these,
    and so on to its left and right. ``a``, ``b``: characters by position and pair, ``of_a``, ``of_b``: lengths."""
    total, n = np.zeros(a.shape[1], np.int64), a.shape[1]
    if not a.size or not b.size:
        return total
    run = np.empty((len(a), len(b) + 1, n), np.uint8)  # of the common block that ends here
    run[:, 0] = 0
    best, end_a = np.zeros(n, np.uint8), np.zeros(n, np.int64)
    for i in range(len(a)):
        now, same = run[i, 1:], (b == a[i]).view(np.uint8)
        if i:
            np.add(run[i - 1, :-1], 1, out=now)
            now *= same
        else:
            now[:] = same
        top = now.max(axis=0)
        end_a[top > best] = i
        np.maximum(best, top, out=best)
    some = np.flatnonzero(best)
    size, end_a = best[some].astype(np.int64), end_a[some]
    end_b = (run[end_a, 1:, some] == best[some][:, None]).argmax(axis=1)
    total[some] = size
    kind = a.dtype
    for from_a, n_a, from_b, n_b in ((0 * size, end_a + 1 - size, 0 * size, end_b + 1 - size), (end_a + 1, of_a[some] - end_a - 1, end_b + 1, of_b[some] - end_b - 1)):
        left = np.flatnonzero((n_a > 0) & (n_b > 0))
        if left.size:
            which, n_a, n_b = some[left], n_a[left], n_b[left]
            total[which] += matched(_cut(a, which, from_a[left], n_a, kind, 0), _cut(b, which, from_b[left], n_b, kind, 1), n_a, n_b)
    return total


def is_first(a: np.ndarray, b: np.ndarray, common: np.ndarray, of_common: np.ndarray) -> np.ndarray:
    """Whether ``common`` is, among the texts of its length that are left of both ``a`` and ``b`` when characters are left
    out, the one whose characters come first in ``a``. Of each pair exactly one text is."""
    n, kind = a.shape[1], np.uint8 if max(len(a), len(b)) < 255 else np.uint16
    # By position in a and b: the most characters in common from there on if a's is kept, and where it is found in b.
    kept, found = np.empty((len(a), len(b) + 1, n), kind), np.empty((len(a), len(b) + 1, n), kind)
    kept[:, -1], found[:, -1] = 0, np.iinfo(kind).max
    most, where = np.zeros((len(b) + 1, n), kind), np.arange(len(b), dtype=kind)[:, None]
    for i in reversed(range(len(a))):
        same = (b == a[i]).astype(kind)
        np.multiply(most[1:] + kind(1), same, out=kept[i, :-1])
        np.bitwise_or(same - kind(1), where, out=found[i, :-1])
        for j in reversed(range(len(b))):
            np.maximum(kept[i, j], kept[i, j + 1], out=kept[i, j])
            np.minimum(found[i, j], found[i, j + 1], out=found[i, j])
        np.maximum(most, kept[i], out=most)
    pair, at, done, right = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(len(a)):
        cell = at * n + pair
        keep = (done < of_common) & (done + kept[i].ravel()[cell] >= of_common)
        right &= ~keep | (common[np.minimum(done, len(common) - 1), pair] == a[i])
        at = np.where(keep, found[i].ravel()[cell].astype(np.int64) + 1, at)
        done += keep
    return right & (done == of_common)


def ratios(a: pa.Array, b: pa.Array, common: pa.Array | None = None) -> pa.Array:
    """Ratcliff-Obershelp similarity of each pair of texts, to six places; with ``common`` null where it ``is_first`` not."""
    if not len(a):  # whose column may come without offsets
        return pa.array([], pa.float64())
    a, b, common = Texts(a), Texts(b), None if common is None else Texts(common)
    kind = np.result_type(*(x.codes.dtype for x in (a, b, common) if x is not None))
    of_a, of_b = a.lengths, b.lengths
    blocks, told = np.zeros(len(of_a), np.int64), np.ones(len(of_a), bool)
    long = np.maximum(of_a, of_b) >= LONG
    shape = (-(-of_a // 4)) << 32 | -(-of_b // 4)
    order = np.argsort(shape, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(shape[order])) + 1):
        if not group.size:
            continue
        step = max(1, CELLS // max(1, int(of_a[group].max() * of_b[group].max())))
        for rows in (group[i : i + step] for i in range(0, len(group), step)):
            x, y = a.rows(rows, kind, 0), b.rows(rows, kind, 1)
            if common is not None:
                told[rows] = is_first(x, y, common.rows(rows, kind, 2), common.lengths[rows])
            short = told[rows] & ~long[rows]
            if short.any():
                x, y, rows = (x, y, rows) if short.all() else (x[:, short], y[:, short], rows[short])
                blocks[rows] = matched(x, y, of_a[rows], of_b[rows])
    # The same rounding as Python's, once for each different fraction.
    whole = of_a + of_b
    fractions, back = np.unique(blocks << 32 | whole, return_inverse=True)
    out = np.array([round(2.0 * (f >> 32) / (f & 0xFFFFFFFF), 6) if f & 0xFFFFFFFF else 1.0 for f in fractions.tolist()], dtype=float)[back]
    same = SequenceMatcher(None)
    for i in np.flatnonzero(long & told).tolist():
        p, q = a.column[i].as_py(), b.column[i].as_py()
        same.set_seq1(p)
        if q != same.b:  # what it makes of the second text is kept
            same.set_seq2(q)
        out[i] = round(same.ratio(), 6)
    return pa.array(out, pa.float64(), mask=~told)
