"""Hashes of words and of runs of words for whole arrow batches at once, in numpy.

Bytes get random 64-bit values; a prefix sum of value times power gives the hash of any byte range
by one subtraction and one multiplication, independent of where the range lies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pairlens.llm.common import SPACE_BYTES, text_bytes

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _POWERS[k] = np.multiply.accumulate(factors)
    return _POWERS[0][:n], _POWERS[1][:n]


class RangeHash:
    """Hashes of ranges of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        up, self._down = powers(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self._sums[1:])

    def range(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix64(raw + np.uint64(salt * 0x2545F4914F6CDD1D & (1 << 64) - 1))


class WordHashes(RangeHash):
    """Where the words of some texts lie and how to hash byte ranges of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(_BYTE_VALUE[data])
        self.data, self.offsets = data, offsets
        solid = ~_IS_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        closes = solid.copy()
        closes[:-1] &= ~solid[1:] | edge[1:-1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(closes) + 1
        #: Index of each text's first word, and the total at the end.
        self.first_word = np.searchsorted(self.starts, offsets)
        self.words_per_doc = np.diff(self.first_word)

    def words(self, salt: int = 0) -> np.ndarray:
        return self.range(self.starts, self.ends, salt)


def words_of(texts: pa.Array | list[bytes]) -> WordHashes:
    if isinstance(texts, list):
        texts = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
    return WordHashes(*text_bytes(texts))


def windows(values: RangeHash, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of every run of ``width`` values within one text, text of every run)."""
    n = np.maximum(np.diff(first) - width + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n), doc
