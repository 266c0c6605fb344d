"""Small vectorised helpers for the Arrow tasks of this subpackage.

Texts are handled as one byte buffer with row offsets, so that tokenising, hashing and counting a
whole slice of documents is a handful of numpy passes. Slices are bounded in bytes (one longer text
makes a slice of its own), which bounds a task's memory however many rows an Arrow batch has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of digits, lower-case letters and bytes from 0x80 (any part of a non-ASCII character).
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_MULTIPLIER = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20_240_601).integers(1, 2**63, 256, dtype=np.uint64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def plain(column) -> pa.Array:
    """One contiguous Arrow array of strings in which null is the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def slices(column, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, offsets, bytes) of runs of rows with about `most` bytes."""
    column = plain(column)
    rows = len(column)
    if not rows:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=rows + 1, offset=column.offset * 8)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
        first = last


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a run never goes over the end of a row."""
    before = np.empty(len(mask), dtype=bool)
    after = np.empty(len(mask), dtype=bool)
    if len(mask):
        before[0], before[1:] = False, mask[:-1]
        after[-1], after[:-1] = False, mask[1:]
        edges = offsets[1:-1]
        before[edges[edges < len(mask)]] = False
        after[edges[edges > 0] - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's multiplier and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        for k, base in enumerate((_MULTIPLIER, pow(_MULTIPLIER, -1, 2**64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Hashes of any substrings of one buffer, from one prefix sum."""

    def __init__(self, data: np.ndarray, values: np.ndarray = _VALUES):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def owners(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of `starts` lie before each row's end: the rows' own offsets among the words."""
    return np.searchsorted(starts, offsets, side="left")
