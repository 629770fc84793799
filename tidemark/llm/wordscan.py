"""Words, lines and word windows of a batch of texts, hashed with array operations.

Hashes are polynomials over scrambled byte (or word) values modulo 2**64, scrambled again
at the end; prefix sums make the hash of any stretch a subtraction and a product.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from tidemark.llm.perfect_hash import mix64

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD64 = (1 << 64) - 1

BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True

_powers = {b: np.ones(1, np.uint64) for b in (_BASE, _INVERSE)}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base``; kept for the next call."""
    have = _powers[base]
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
        _powers[base] = have if len(have) <= 1 << 23 else _powers[base]
    return have[:n]


class Sums:
    """Prefix sums over values, for hashes of stretches."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(_BASE, len(values)), out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of every stretch ``starts[i] .. ends[i]``; empty ones all have the same."""
        scale = powers(_INVERSE, len(self.sums))
        return mix64((self.sums[ends] - self.sums[starts]) * scale[starts])


class Words(NamedTuple):
    starts: np.ndarray  #: first byte of each word
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray  #: per text, its first word; one more at the end


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> Words:
    """The words of texts that lie end to end in ``data``; ``fold`` lower-cases A-Z."""
    inside = ~IS_SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    before = np.r_[False, inside[:-1]] & ~begins[:-1] if len(data) else inside
    after = np.r_[inside[1:], False] & ~begins[1:] if len(data) else inside
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    sums = Sums((FOLDED if fold else BYTE)[data])
    return Words(starts, ends, sums.hashes(starts, ends), np.searchsorted(starts, offsets))


def windows(found: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of ``size`` words within one text: hash, first word, and per text offsets."""
    counts = np.maximum(np.diff(found.offsets) - size + 1, 0)
    total = int(counts.sum())
    offsets = np.r_[0, np.cumsum(counts)]
    first = np.arange(total) + np.repeat(found.offsets[:-1] - offsets[:-1], counts)
    return Sums(found.hashes).hashes(first, first + size), first, offsets


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of every element of rows with these offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's values."""
    sums = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return sums[offsets[1:]] - sums[offsets[:-1]]


def in_row(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes made distinct by row, so that equal ones meet only within a row."""
    return mix64(hashes ^ mix64(rows.astype(np.uint64) + np.uint64(0x51ED270B)))
