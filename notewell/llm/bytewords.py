"""Vectorised scanning of UTF-8 text columns: word spans and 64-bit span hashes over a whole Arrow batch at once.

A span's hash is a polynomial over a random value for each byte, taken modulo 2**64 from prefix sums, so the hash of any span costs two
look-ups. Spans never cross from one document to the next. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK_BYTES = 2 << 20

#: The bytes that separate words (space, tab, line feed, vertical tab, form feed, carriage return).
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"

_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE_LOWER = _VALUE.copy()
_VALUE_LOWER[65:91] = _VALUE[97:123]


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def table(x: int) -> np.ndarray:
        a = np.full(n + 1, x, np.uint64)
        a[0] = 1
        return np.multiply.accumulate(a)

    return table(BASE), table(INVERSE)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the public finaliser of MurmurHash3); one to one."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def blocks(column: pa.Array | pa.ChunkedArray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows within them) for runs of rows of about ``most`` bytes; a longer row stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


class Hashes:
    """Prefix sums over one block; ``of(starts, ends)`` gives span hashes."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        size = 1 << max(16, int(len(data)).bit_length())
        self.power, self.inverse = _powers(max(size, BLOCK_BYTES))
        self.prefix = np.empty(len(data) + 1, np.uint64)
        self.prefix[0] = 0
        np.cumsum((_VALUE_LOWER if lower else _VALUE)[data] * self.power[: len(data)], out=self.prefix[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts])


def spans(data: np.ndarray, offsets: np.ndarray, is_sep: np.ndarray = _IS_SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a block, and for each row (and the end) the number of words before it."""
    solid = ~is_sep[data]
    filled = offsets[1:] > offsets[:-1]
    left = np.empty(len(solid) + 1, bool)
    left[0] = False
    left[1:] = solid
    left[offsets[:-1][filled]] = False
    starts = np.flatnonzero(solid & ~left[:-1])
    right = np.empty(len(solid) + 1, bool)
    right[:-1] = solid
    right[-1] = False
    right[offsets[1:][filled]] = False
    ends = np.flatnonzero(solid & ~right[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)
