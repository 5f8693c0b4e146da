"""Hashes of many spans of a byte buffer at once, with numpy, inside tasks.

A span's hash is a polynomial over random values of its bytes, modulo 2**64, made from prefix sums;
then its bits are mixed. Equal spans have equal hashes wherever they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers of the base, or of its inverse, up to n - 1."""
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 2**64)
        steps = np.full(n + n // 4, base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spreads the bits of 64-bit values (Steele's finalizer)."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefixes(data: np.ndarray) -> np.ndarray:
    """For ``span``: element i stands for the first i bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _power("up", len(data)), out=sums[1:])
    return sums


def span(sums: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the bytes begin to end."""
    down = _power("down", len(sums))
    return mix((sums[end] - sums[begin]) * down[begin], seed)


def packed(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The texts of a column as (first row, end row, bytes, offsets), about ``most`` bytes each time.

    A null counts as empty. A longer text comes alone and whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string()
    column = column.cast(kind).fill_null(b"" if kind == pa.large_binary() else "")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


#: 1 for ASCII white space.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of other bytes than ASCII white space: (begin, end, words per row)."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    both = edge[inside[edge] & inside[edge - 1]]  # words that touch across two texts
    first[both] = True
    last[both - 1] = True
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, offsets[1:]) - np.searchsorted(begin, offsets[:-1])


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its row, words per row); ``lower`` turns A-Z to a-z first."""
    if lower:
        data = _LOWER[data]
    begin, end, counts = word_spans(data, offsets)
    return span(prefixes(data), begin, end), np.repeat(np.arange(len(counts)), counts), counts
