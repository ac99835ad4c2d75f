"""Vectorised hashing of words in Arrow string columns.

A word's hash is a polynomial over its bytes modulo 2^64, each byte first replaced by a random number,
read off prefix sums; a finalizer mixes it with the word's length. No Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_FOLDED = list(range(65)) + list(range(97, 123)) + list(range(91, 256))


class Hasher:
    """Tables for one seed; powers grow with the longest slice seen."""

    def __init__(self, seed: int = 1, lower: bool = True):
        table = np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, 256, dtype=np.uint64, endpoint=False)
        self.table = table[_FOLDED] if lower else table
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.inverse = np.uint64(pow(_BASE, -1, 2**64))
        self._grow(SLICE_BYTES)

    def _grow(self, n: int) -> None:
        def powers(x):
            out = np.full(n + 1, x, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        self.up, self.down = powers(np.uint64(_BASE)), powers(self.inverse)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """start, end (bytes), document number and hash of every word. data: uint8; offsets: of each document."""
        n = len(data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(0, np.uint64)
        if n >= len(self.up):
            self._grow(2 * n)
        solid = ~self.space[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        first, last = offsets[:-1], offsets[1:] - 1
        before[first[first < n]] = False
        after[last[last >= 0]] = False
        start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        doc = np.searchsorted(offsets, start, side="right") - 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=sums[1:], dtype=np.uint64)
        h = (sums[end] - sums[start]) * self.down[start]
        return start, end, doc, mix64(h + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def constants(seed: int, n: int) -> np.ndarray:
    """n odd numbers."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=np.uint64, endpoint=False) | np.uint64(1)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about limit bytes; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, raw = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
