"""Hashing of symbol sequences (bytes or words) inside a task, with NumPy.

All functions work on one *block*: the UTF-8 bytes of several documents laid end
to end, as Arrow stores them, with the offsets where each document starts.
Hashes depend on content alone, never on the block or the process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values(seed: int) -> np.ndarray:
    """One 64-bit number for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed))


def powers(n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2**64."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        base = (BASE + 0x5851F42D4C957F2C * 2 * seed) % 2**64
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(max(n, 1 << 16), b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _POWERS[seed] = tuple(both)
    return have[0][:n], have[1][:n]


def prefix_sums(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Prefix sums of a polynomial hash over ``values``, for windows and spans of some hundred symbols."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), seed)[0], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of ``values[start:end]`` for arrays of positions."""
    return mix((sums[end] - sums[start]) * powers(len(sums), seed)[1][start])


def gram_hash(sums: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``length`` symbols from every position on (empty if too short)."""
    n = len(sums) - length
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[length:] - sums[:-length]) * powers(n, seed)[1])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of a block, and each document's first word.

    A word is a run of bytes other than the six ASCII space characters; the end
    of a document ends a word.
    """
    inside = ~SPACES[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[heads[1:] - 1] = inside[heads[1:] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of ``values[start:end]`` for spans of any length that do not overlap.

    Each symbol is mixed with its place in the span before the sum is taken.  A
    polynomial modulo 2**64 would not do here: long sequences of two symbols in an
    even and odd pattern collide in it for every odd base.
    """
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    x = values[np.repeat(starts, size) + place]
    x = mix(x ^ mix((place.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE) + np.uint64(seed)))
    some = size > 0
    out = size.astype(np.uint64)
    out[some] += np.add.reduceat(x, first[some]) if some.any() else np.zeros(0, np.uint64)
    return mix(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    return sequence_hashes(byte_values(seed)[data], starts, ends, seed)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string Arrow array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of documents of about ``limit`` bytes together (one at least)."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, stop
        start = stop
