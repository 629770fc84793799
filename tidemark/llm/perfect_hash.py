"""A minimal perfect hash of 64-bit keys: levels of bit arrays with ranks.

Each level gives every key left a position; keys alone at theirs set that bit, the others
go on to the next level. A key's number is the rank of its bit among the bits of all
levels. Keys still left after the last level are listed, sorted, and come last. A key
outside the set gets some number or none; stored fingerprints tell it apart.
"""

from __future__ import annotations

import numpy as np

_GOLDEN = 0x9E3779B97F4A7C15
_LEVELS = 32
_SPACE = 2.0


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """32 bits of a key, independent of its positions."""
    return (mix64(keys ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def _positions(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(keys + np.uint64(_GOLDEN * (level + 1) & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, sizes: np.ndarray, words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        counts = np.bitwise_count(words).astype(np.int64)
        self.rank = np.cumsum(counts) - counts
        self.placed = int(counts.sum())
        self.first_word = np.cumsum((sizes + 63) // 64) - (sizes + 63) // 64

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        """``keys`` are distinct 64-bit words."""
        left, sizes, words = keys.astype(np.uint64), [], []
        for level in range(_LEVELS):
            if not len(left):
                break
            size = max(64, int(len(left) * _SPACE))
            at = _positions(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.zeros((size + 63) // 64 * 64, np.uint8)
            bits[:size] = alone
            words.append(np.packbits(bits, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at]]
        return PerfectHash(np.array(sizes, np.int64), np.concatenate([*words, np.zeros(0, np.uint64)]), np.sort(left))

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for a key that no level holds."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                return out
            at = _positions(keys[open_], level, size)
            word, bit = self.first_word[level] + at // 64, (at % 64).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[open_[hit]] = self.rank[word[hit]] + below
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            found = self.rest[at] == keys[open_]
            out[open_[found]] = self.placed + at[found]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), len(self.words), len(self.rest)], "<i8")
        return b"".join(x.tobytes() for x in (head, self.sizes.astype("<i8"), self.words.astype("<u8"), self.rest.astype("<u8")))

    @staticmethod
    def from_bytes(data: bytes) -> PerfectHash:
        levels, words, rest = np.frombuffer(data, "<i8", 3).tolist()
        at = 24
        sizes = np.frombuffer(data, "<i8", levels, at)
        bits = np.frombuffer(data, "<u8", words, at + 8 * levels)
        return PerfectHash(sizes, bits, np.frombuffer(data, "<u8", rest, at + 8 * (levels + words)))
