"""Ids of recurring text units, remembered by a worker between batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from tidemark.llm.common import ragged


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


class UnitMemory:
    """Encodes units once and gathers the ids of rows of units.

    ``encode`` gives the flat ids and the lengths of a list of units. Once ``limit`` units
    or ``limit_ids`` ids of them are known, those seen less than three times are dropped, so
    memory stays bounded whether units are many or long.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 300_000, limit_ids: int = 8_000_000):
        self.encode, self.limit, self.limit_ids = encode, limit, limit_ids
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.store = np.zeros(1 << 20, np.int32)
        self.at, self.length, self.seen = (np.zeros(1 << 18, np.int64) for _ in range(3))
        self.used = 0

    def _trim(self) -> None:
        n = len(self.numbers)
        keep = np.flatnonzero(self.seen[:n] >= 3)
        if len(keep) > self.limit // 2 or self.length[keep].sum() > self.limit_ids // 2:
            return self._forget()
        names = list(self.numbers)
        ids, lengths = self.store[ragged(self.at[keep], self.length[keep])], self.length[keep]
        self._forget()
        for k in keep.tolist():
            self.numbers[names[k]]
        self._remember(0, ids, lengths)
        self.seen[: len(keep)] = 1

    def _remember(self, known: int, ids: np.ndarray, lengths: np.ndarray) -> None:
        n, used = known + len(lengths), self.used + len(ids)
        if used > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(max(used, len(self.store)), np.int32)])
        if n > len(self.at):
            more = np.zeros(max(n, len(self.at)), np.int64)
            self.at, self.length, self.seen = (np.concatenate([x, more]) for x in (self.at, self.length, self.seen))
        self.store[self.used : used] = ids
        self.at[known:n] = self.used + np.cumsum(lengths) - lengths
        self.length[known:n] = lengths
        self.used = used
        self.numbers.fresh.clear()

    def rows(self, keys_of_rows: list[list[str]], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of rows of units, with the id ``end`` last in each row."""
        places: dict[str, int] = {}
        index = np.array([places.setdefault(k, len(places)) for keys in keys_of_rows for k in keys], np.int64)
        return self.gather(list(places), index, np.array([len(keys) for keys in keys_of_rows], np.int64), end)

    def gather(self, names: list[str], index: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for rows of ``sizes`` units, all of which ``index`` lists as places in ``names``, the distinct units."""
        if len(self.numbers) > self.limit or self.used > self.limit_ids:
            self._trim()
        known = len(self.numbers)
        number = np.array(list(map(self.numbers.__getitem__, names)), np.int64)
        if self.numbers.fresh:
            self._remember(known, *self.encode(list(self.numbers.fresh)))
        self.seen[number] += np.bincount(index, minlength=len(names))
        lengths = np.r_[self.length[number], 1]
        starts = np.r_[0, np.cumsum(lengths)]
        values = np.r_[self.store[ragged(self.at[number], lengths[:-1])], np.int32(end)]
        ends = np.cumsum(sizes) + np.arange(len(sizes))
        order = np.full(len(index) + len(sizes), len(names), np.int32)
        inner = np.ones(len(order), bool)
        inner[ends] = False
        order[inner] = index
        ids = pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), pa.array(values, pa.int32())).take(pa.array(order))
        return ids.flatten().to_numpy(), np.r_[0, np.cumsum(lengths[order])[ends]]
