"""Vectorised word splitting and hashing over Arrow text buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text; a null text counts as empty. Nothing here makes a Python
string per word: one pass over the bytes finds the words, and a polynomial prefix sum hashes all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_STEP = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _row(base: int, n: int) -> np.ndarray:
    row = np.full(n, base, np.uint64)
    row[0] = 1
    return np.cumprod(row, dtype=np.uint64)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    return _row(_BASE, _STEP), _row(pow(_BASE, -1, 1 << 64), _STEP)


@cache
def _high(inverse: bool, n: int) -> np.ndarray:
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    return _row(pow(base, _STEP, 1 << 64), n)


def _powers(n: int) -> np.ndarray:
    low, blocks = _tables()[0], -(-n // _STEP)
    return (_high(False, max(1, blocks))[:, None] * low[None, :]).ravel()[:n]


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets has one entry more than there are rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column, target: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``target`` bytes, one row at least."""
    raw, offsets = text_buffer(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + target, side="right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Text:
    """A run of documents: their bytes, and where words are."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.raw, self.offsets = (LOWER[raw] if lower else raw), offsets
        self.n_docs = len(offsets) - 1
        self._words = None

    @property
    def edges(self) -> np.ndarray:
        edge = np.zeros(self.raw.size + 1, bool)
        edge[self.offsets] = True
        return edge

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document) of each word, in order."""
        if self._words is None:
            n = self.raw.size
            space = SPACE[self.raw]
            edge = self.edges
            start, end = ~space, ~space
            if n:
                start[1:] &= space[:-1] | edge[1:n]
                end[:-1] &= space[1:] | edge[1:n]
            starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
            self._words = starts, ends, self.doc_of(starts)
        return self._words

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each document ``mask`` marks."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of spans of bytes; equal spans get equal hashes wherever they are."""
        if not hasattr(self, "_prefix"):
            self._prefix = np.zeros(self.raw.size + 1, np.uint64)
            np.cumsum(BYTE[self.raw] * _powers(self.raw.size), out=self._prefix[1:])
        low = _tables()[1]
        back = low[starts & (_STEP - 1)] * _high(True, self.raw.size // _STEP + 1)[starts >> 16]
        value = (self._prefix[ends] - self._prefix[starts]) * back
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def word_hashes(self) -> np.ndarray:
        if not hasattr(self, "_hashes"):
            starts, ends, _ = self.words()
            self._hashes = self.hashes(starts, ends)
        return self._hashes

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document) of the \\n-split lines, in order; an empty document has one empty line."""
        breaks = np.flatnonzero(self.raw == 10)
        doc = np.concatenate([np.arange(self.n_docs), self.doc_of(breaks)])
        start = np.concatenate([self.offsets[:-1], breaks + 1])
        order = np.lexsort((start, doc))
        start, doc = start[order], doc[order]
        end = np.empty_like(start)
        end[:-1] = start[1:] - 1
        last = np.ones(len(doc), bool)
        last[:-1] = doc[1:] != doc[:-1]
        end[last] = self.offsets[1:][doc[last]]
        return start, end, doc


def window_hashes(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of each window of ``k`` words within one document."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint64)
    for i in range(k):
        value = value * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n]
        value ^= value >> np.uint64(32)
    at = np.flatnonzero(doc[:n] == doc[k - 1 : k - 1 + n])
    return mix(value[at]), at


def sort_by_doc(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order by (doc, h)."""
    order = np.argsort(h)
    by = doc[order]
    return order[np.argsort(by.astype(np.uint16) if not len(doc) or by.max() < 65536 else by, kind="stable")]


def same_as_last(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (doc, h), and which entries in that order equal the one before them."""
    order = sort_by_doc(doc, h)
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        d, x = doc[order], h[order]
        same[1:] = (x[1:] == x[:-1]) & (d[1:] == d[:-1])
    return order, same
