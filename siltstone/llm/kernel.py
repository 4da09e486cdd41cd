"""Vectorised scanning of Arrow string batches, used inside ``mapInArrow`` tasks.

A batch is cut into slabs of whole texts (about ``SLAB`` bytes, one very long text is a slab of its
own), so the memory of a task follows the slab and not the Arrow batch.  All word, window and line
statistics come from numpy passes over a slab's UTF-8 bytes; there is no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

from .worker import light

SLAB = 1 << 18
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_M = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)


_STEP = 14
#: Bytes that are hashed by one polynomial, at most.
PIECE = 256


def _table(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2**64."""
    p = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        m = min(done, n - done)
        p[done : done + m] = p[:m] * _U(step)
        done += m
        step = step * step & _MASK
    return p


def _tables(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers by the low and the high bits of the exponent, so that no table grows with a text."""
    return _table(base, 1 << _STEP), _table(pow(base, 1 << _STEP, 1 << 64), 1 << (31 - _STEP))


_UP, _DOWN = _tables(_M), _tables(pow(_M, -1, 1 << 64))


def powers(n: int) -> np.ndarray:
    """The odd multiplier to the powers 0 to n - 1, modulo 2**64."""
    return (_UP[1][: (n >> _STEP) + 1, None] * _UP[0][None, :]).ravel()[:n]


def inverses(at: np.ndarray) -> np.ndarray:
    """The inverses of its powers ``at``."""
    return _DOWN[0][at & ((1 << _STEP) - 1)] * _DOWN[1][at >> _STEP]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Slab:
    """Whole texts side by side: ``buf`` (bytes), ``off`` (n + 1 offsets), ``first`` (row of the batch)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, first: int):
        self.buf, self.off, self.first, self.n = buf, off, first, len(off) - 1

    def text(self, i: int) -> str:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes().decode("utf-8", "replace")

    @cached_property
    def space(self) -> np.ndarray:
        return _SPACE[self.buf]

    @cached_property
    def _words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        solid = ~self.space
        edge = np.zeros(len(self.buf) + 1, bool)
        edge[self.off] = True
        before = np.zeros(len(self.buf), bool)
        before[1:] = solid[:-1]
        before[edge[:-1]] = False
        after = np.zeros(len(self.buf), bool)
        after[:-1] = solid[1:]
        after[edge[1:]] = False
        start = np.flatnonzero(solid & ~before)
        end = np.flatnonzero(solid & ~after) + 1
        return start, end, np.searchsorted(self.off, start, "right") - 1

    @property
    def word_start(self) -> np.ndarray:
        return self._words[0]

    @property
    def word_end(self) -> np.ndarray:
        return self._words[1]

    @property
    def word_doc(self) -> np.ndarray:
        """The text (0 to n - 1) of each word."""
        return self._words[2]

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.word_doc, minlength=self.n)

    @cached_property
    def _prefix(self) -> np.ndarray:
        p = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(_BYTE[self.buf] * powers(len(self.buf)), out=p[1:])
        return p

    def _piece_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        p = self._prefix
        return mix((p[end] - p[start]) * inverses(start) + (end - start).astype(np.uint64))

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans; equal spans have equal hashes wherever they stand.

        A polynomial modulo 2**64 maps some different strings of 1,024 or more bytes to one value whatever
        its base, so spans of over ``PIECE`` bytes are hashed in pieces, which are mixed before they are added.
        """
        out = self._piece_hash(start, end)
        long = np.flatnonzero(end - start > PIECE)
        if len(long):
            n = -(-(end[long] - start[long]) // PIECE)
            first = np.cumsum(n) - n
            no = np.arange(n.sum()) - np.repeat(first, n)
            a = np.repeat(start[long], n) + no * PIECE
            each = self._piece_hash(a, np.minimum(a + PIECE, np.repeat(end[long], n)))
            out[long] = mix(np.add.reduceat(mix(each ^ mix(no.astype(np.uint64) + _U(1))), first) + (end[long] - start[long]).astype(np.uint64))
        return out

    @cached_property
    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.word_start, self.word_end)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of k words inside one text, and the window's first word."""
        h, m = self.word_hash, len(self.word_hash) - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        acc = np.zeros(m, np.uint64)
        for i in range(k):
            acc = acc * _U(_M) + h[i : i + m]
        at = np.flatnonzero(self.word_doc[:m] == self.word_doc[k - 1 :])
        return mix(acc[at]), at

    def per_doc(self, keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Keys that differ between texts."""
        return mix(keys + mix(doc.astype(np.uint64) + _U(1)))

    @cached_property
    def repeated_words(self) -> np.ndarray:
        """For each word: whether it lies in a 5-word window that its text holds twice or more."""
        h, at = self.windows(5)
        cover = np.zeros(len(self.word_start) + 1, np.int64)
        if len(h):
            _, back, n = np.unique(self.per_doc(h, self.word_doc[at]), return_inverse=True, return_counts=True)
            at = at[n[back] > 1]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + 5, -1)
        return np.cumsum(cover[:-1]) > 0

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        r"""The \n-split lines with a word: start, end, text, whether it equals an earlier line of its text."""
        cut = np.flatnonzero(self.buf == 10)
        start = np.unique(np.concatenate([self.off[:-1][np.diff(self.off) > 0], cut + 1]))
        start = start[start < len(self.buf)]
        doc = np.searchsorted(self.off, start, "right") - 1
        nxt = np.searchsorted(cut, start)
        end = np.minimum(np.append(cut, len(self.buf))[nxt], self.off[doc + 1])
        first = np.searchsorted(self.word_start, start)
        has = first < np.searchsorted(self.word_start, end)
        start, end, doc = start[has], end[has], doc[has]
        again = np.ones(len(start), bool)
        again[np.unique(self.per_doc(self.span_hash(start, end), doc), return_index=True)[1]] = False
        return start, end, doc, again

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each text has."""
        c = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.off[1:]] - c[self.off[:-1]]


def slabs(column: pa.Array, size: int = SLAB, keep_worker: bool = False) -> Iterator[Slab]:
    """Cut a string column into slabs; a null is an empty text.  Unless asked to keep it, the worker's cache goes."""
    if not keep_worker:
        light()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield Slab(buf[off[i] : off[j]], off[i : j + 1] - off[i], i)
        i = j
