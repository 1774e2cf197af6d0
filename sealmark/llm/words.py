"""Words, lines and shingles of whole texts, as numpy arrays over the raw UTF-8 bytes.

A word is a run of characters other than space and U+0009 to U+000D. Those are single bytes in
UTF-8, so bytes are enough to find words, and a prefix sum of a polynomial over the bytes (modulo
2^64) gives the hash of any slice in constant time.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

U = np.uint64
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits (the splitmix64 finaliser)."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_BASE))
#: the same with A-Z as a-z
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[0x41:0x5B] = _BYTE[0x61:0x7B]


@functools.lru_cache(2)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.empty(size, U)
    out[0] = 1
    filled = 1
    while filled < size:
        more = min(filled, size - filled)
        out[filled : filled + more] = out[:more] * U(pow(base, filled, 1 << 64))
        filled += more
    return out


def powers(n: int, base: int) -> np.ndarray:
    return _powers(max(1 << 20, 1 << int(n).bit_length()), base)[:n]


class Texts:
    """The bytes of some texts, one after the other, and where each begins."""

    def __init__(self, column: pa.Array, lower: bool = False):
        """column: large_string without nulls."""
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        self.bytes = raw[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.n = n
        self._lower = lower
        self._sums = None
        self._space = _IS_SPACE[self.bytes]
        self._find_words()

    def _edges(self, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs without stop bytes, within each text."""
        size = len(self.bytes)
        if not size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        before = np.empty(size, bool)
        before[0] = True
        before[1:] = stop[:-1]
        first = self.offsets[:-1]
        before[first[first < size]] = True
        after = np.empty(size, bool)
        after[-1] = True
        after[:-1] = stop[1:]
        last = self.offsets[1:] - 1
        after[last[last >= 0]] = True
        keep = ~stop
        return np.flatnonzero(keep & before), np.flatnonzero(keep & after) + 1

    def _find_words(self) -> None:
        self.starts, self.ends = self._edges(self._space)
        self.word_at = np.searchsorted(self.starts, self.offsets)
        self.n_words = np.diff(self.word_at)
        self.doc = np.repeat(np.arange(self.n), self.n_words)

    def slice_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes from each start to each end."""
        if self._sums is None:
            size = len(self.bytes)
            self._sums = np.zeros(size + 1, U)
            np.cumsum((_BYTE_LOWER if self._lower else _BYTE)[self.bytes] * powers(size, _BASE), out=self._sums[1:])
        at = powers(len(self.bytes) + 1, _INVERSE)
        return mix((self._sums[ends] - self._sums[starts]) * at[starts] + (ends - starts).astype(U))

    @functools.cached_property
    def word_hash(self) -> np.ndarray:
        return self.slice_hash(self.starts, self.ends)

    @functools.cached_property
    def chars(self) -> np.ndarray:
        """Code points before each byte position."""
        out = np.zeros(len(self.bytes) + 1, np.int64)
        np.cumsum((self.bytes & 0xC0) != 0x80, out=out[1:])
        return out

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of the non-empty pieces between line feeds."""
        starts, ends = self._edges(self.bytes == 0x0A)
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of `width` words, and the text of each; a shorter text with words is one run."""
        h = self.word_hash
        total = np.zeros(len(h), U)
        if not len(h):
            return total, self.doc
        with np.errstate(over="ignore"):
            for k in range(width):
                total[: len(h) - k] += h[k:] * U(pow(_BASE, k + 1, 1 << 64))
        left = self.word_at[self.doc + 1] - np.arange(len(h))
        whole = left >= width
        short = np.zeros(len(h), bool)
        few = np.flatnonzero((self.n_words > 0) & (self.n_words < width))
        if len(few):  # sum only their own words
            at = self.word_at[few]
            short[at] = True
            own = np.zeros(len(few), U)
            for k in range(width - 1):
                has = self.n_words[few] > k
                own[has] += h[at[has] + k] * U(pow(_BASE, k + 1, 1 << 64))
            total[at] = own
        keep = whole | short
        return mix(total[keep]), self.doc[keep]


def distinct_by_text(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, texts, counts): each text's distinct values, texts ascending, values ascending in a text."""
    if not len(values):
        return values, doc, np.empty(0, np.int64)
    order = np.lexsort((values, doc)) if len(np.unique(doc)) > 1 else np.argsort(values, kind="stable")
    v, d = values[order], doc[order]
    first = np.empty(len(v), bool)
    first[0] = True
    np.not_equal(v[1:], v[:-1], out=first[1:])
    first[1:] |= d[1:] != d[:-1]
    at = np.flatnonzero(first)
    return v[at], d[at], np.diff(np.append(at, len(v)))
