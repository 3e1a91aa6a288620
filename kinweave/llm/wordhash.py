"""Vectorised words and word hashes over the bytes of many texts at once.

Words are maximal runs of bytes other than blank and 0x09-0x0D.  A word's hash is a polynomial over
its bytes, modulo 2**64 and mixed; spans of words are hashed the same way over word hashes.  Both come
from prefix sums, so no word becomes a Python object.
"""

from __future__ import annotations

import numpy as np

from .common import blocks

BYTE_BASE, SPAN_BASES = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        m = max(1024, 1 << (n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(m, b, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x))
        _powers[base] = tuple(made)
    p, q = _powers[base]
    return p[:n], q[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray, base: int):
    """A function (start, end) -> hash of values[start:end], for arrays of starts and ends."""
    p, inverse = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[:-1], out=total[1:])
    return lambda start, end: mix((total[end] - total[start]) * inverse[start])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in data, and for each text its first word's number (one more at the end)."""
    inside = ~_BREAK[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    before[:1], after[-1:] = False, False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge], after[edge - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and the number of each text's first word (one more at the end)."""
    hashes, firsts, n = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for i, j in blocks(offsets):
        part = data[offsets[i] : offsets[j]]
        starts, ends, first = words(part, offsets[i : j + 1] - offsets[i])
        span = prefix_hash(part.astype(np.uint64) + np.uint64(1), BYTE_BASE)
        hashes.append(span(starts, ends))
        firsts.append(first[1:] + n)
        n += len(starts)
    return np.concatenate(hashes), np.concatenate(firsts)
