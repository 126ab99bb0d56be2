"""Vectorised word, shingle and MinHash arithmetic for Arrow string columns.

Everything here is a small per-batch helper: Spark deals the rows out, these
functions turn one slice of an Arrow column into numpy arrays.  Words are
``[^\\x20\\x09-\\x0D]+`` (the only separators are six ASCII bytes, so the split
works on UTF-8 bytes), and ``lower`` folds A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer document is a slice of its own.
SLICE_BYTES = 2_000_000

_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) on uint64 values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _stream(seed: int, n: int) -> np.ndarray:
    start = (seed * 0x9E3779B97F4A7C15) & _MASK
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(start))


_BYTE = _stream(1, 256)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LINE_END = np.zeros(256, dtype=bool)
LINE_END[10] = True
_BASE = 0x9E6C63D0876A9A47


def _powers(n: int) -> np.ndarray:
    out = np.full(n, np.uint64(_BASE))
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of several texts laid end to end.

    ``hash`` has one uint64 for each word, ``start``/``end`` their byte ranges in
    ``data``; words of text ``i`` are ``[first[i], first[i + 1])``.
    """

    __slots__ = ("data", "start", "end", "first", "hash", "offsets")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, apart: np.ndarray | None = None):
        """``apart``: which bytes separate; for lines it is ``LINE_END``."""
        self.data, self.offsets = data, offsets
        n = len(data)
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        inside = ~(_SPACE if apart is None else apart)[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin[edges] = inside[edges]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        stop[edges[1:] - 1] = inside[edges[1:] - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        if len(self.start) == 0:
            self.hash = np.zeros(0, np.uint64)
            return
        at = np.flatnonzero(inside)
        length = self.end - self.start
        table = _powers(int(length.max()))
        cum = np.cumsum(length) - length
        place = np.arange(len(at), dtype=np.int64) - np.repeat(cum, length)
        letters = data[at]
        if lower:
            letters = _FOLD[letters]
        value = _BYTE[letters] * table[place]
        self.hash = mix(np.add.reduceat(value, cum) + length.astype(np.uint64))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of a string column.

    Nulls are empty texts.  The bytes are a view of Arrow's buffer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    n = len(column)
    if n == 0:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        to = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        to = min(n, max(to, row + 1))
        yield row, to, whole[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def give_back() -> None:
    """Return a task's freed buffers to the system; the worker stays for later tasks of other kinds."""
    pa.default_memory_pool().release_unused()


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the shingles of each text in order, with repeats.

    A text of fewer than ``size`` words gives its whole sequence as one shingle,
    a text without words none.
    """
    h, first, counts = words.hash, words.first, words.counts
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(made)])
    owner = np.repeat(np.arange(len(counts)), made)
    at = first[owner] + np.arange(begin[-1]) - begin[owner]
    out = np.zeros(len(at), np.uint64)
    width = np.minimum(counts, size)[owner]
    for j in range(size):
        live = width > j
        k = at[live] + j
        out[live] += mix(h[k] + np.uint64((0xA0761D6478BD642F * (2 * j + 1)) & _MASK))
    out += width.astype(np.uint64)
    return mix(out), begin


def distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted, without repeats."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else hashes[:0]), np.concatenate([[0], np.cumsum(sizes)])


def space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def byte_values(data: np.ndarray) -> np.ndarray:
    """A fixed random value for each byte, A-Z folded."""
    return _BYTE[_FOLD[data]]


def again(keys: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    if len(keys) == 0:
        return np.zeros(0, bool)
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def minhash(sets: np.ndarray, first: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """(texts, k) uint32 minima of k multiply-shift hashes; 2**32 - 1 for empty sets."""
    n = len(first) - 1
    out = np.full((n, k), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full) == 0:
        return out
    factor = _stream(seed, k) | np.uint64(1)
    # cut into pieces that stay in cache; a set on a border has minima in both
    step = 1 << 15
    for a in range(0, len(sets), step):
        piece = sets[a : a + step]
        lo = int(np.searchsorted(first, a, side="right")) - 1
        hi = int(np.searchsorted(first, a + len(piece), side="left"))
        own = np.arange(lo, hi)
        own = own[np.diff(first[lo : hi + 1]) > 0]
        at = np.maximum(first[own] - a, 0)
        for j in range(k):
            m = np.minimum.reduceat(((piece * factor[j]) >> np.uint64(32)).astype(np.uint32), at)
            out[own, j] = np.minimum(out[own, j], m)
    return out


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1 if len(b) else 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0
