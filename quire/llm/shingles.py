"""Words and word shingles of UTF-8 texts as 64-bit hashes, computed on whole Arrow buffers with numpy.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, which in UTF-8 is the same as runs of code points
outside those six. A word's hash is a polynomial in its bytes (random byte values, odd base, modulo 2**64), mixed;
a shingle's hash combines the hashes of its words. Two different shingles of a pair of documents with n shingles
share a hash with a probability of about n * n / 2**64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import slices

WS = np.zeros(256, bool)
WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 1 << 21
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _BLOCK + 4096)
        out = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = out
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of the rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, of: np.ndarray = ~WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, which are runs of the bytes that ``of`` marks, and for each row the index of its first word (and one more at the end)."""
    inside = of[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    if len(data):
        full = offsets[1:] > offsets[:-1]
        before[offsets[:-1][full]] = False
        after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # blocks bound the memory, also in a very long text
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        lo, hi = starts[i], ends[j - 1]
        power, inverse = _power(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * power[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix(out)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; with fewer words its only shingle is the whole sequence; without words the set is empty. A-Z count as a-z."""
    data, offsets = buffers(column)
    return [x for i, j in slices(np.diff(offsets).tolist()) for x in _sets(LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], k)]


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    n = len(h)
    long = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        long += h[i : n - k + 1 + i] * _PLACE[i] if n >= k else 0
    long = mix(long)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(long[a : b - k + 1]))
        elif b > a:
            out.append(mix(np.sum(h[a:b] * _PLACE[: b - a], keepdims=True) + _PLACE[32 + b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
