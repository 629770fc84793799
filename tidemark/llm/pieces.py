"""SentencePiece BPE, encoded by vectorised merge rounds and decoded by table look-up.

A text is cut where no piece of the model can reach across (before a space that follows
another character, and around line feeds), the distinct units are encoded together, and
ids are gathered per document. One round of :func:`merge_rounds` works on the symbols of
all unfinished units in one flat array: look up every adjacent pair, find each unit's best
score, merge the leftmost pairs of that score, compact. This continues until no unit
holds a pair of the vocabulary.

Sequential BPE merges the single best pair, leftmost first, one at a time. A round may
merge several pairs of one unit only up to the first merge that creates a pair scoring no
worse than the round's score, so the result is that of the sequential order; a long run of
one character takes logarithmically many rounds.

Defined results: null and empty texts give the end id alone and decode to the empty text;
unknown characters become their UTF-8 bytes' pieces; an empty table gives an empty table;
columns of the input are carried along, and a column named like an added one is replaced.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import map_arrow, ragged, row_slices, table, utf8_parts

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Begins a unit that no space precedes; texts that hold it are cut at spaces alone.
MARK = "\x1f"
_NO_PAIR = np.int64(1 << 40)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Units(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


class Pieces:
    """Look-up tables of a BPE model with byte fallback and an identity normaliser."""

    #: Distinct units that a worker remembers before it drops those seen less than three times.
    MEMORY = 300_000
    #: Ids of all of them together; long units, as text without spaces has, reach this bound first.
    MEMORY_IDS = 6_000_000

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.eos = sp.eos_id()
        names = [sp.id_to_piece(i) for i in range(self.size)]
        byte_of = {i: int(names[i][3:5], 16) for i in range(self.size) if sp.is_byte(i)}
        plain = [i for i in range(self.size) if not (i in byte_of or sp.is_control(i) or sp.is_unknown(i))]
        if len(byte_of) != 256 or any(sp.is_unused(i) for i in plain):
            raise ValueError("the model needs byte fallback and no unused pieces")
        self.byte_id = np.zeros(256, np.int64)
        for i, b in byte_of.items():
            self.byte_id[b] = i
        symbol = {names[i]: i for i in plain}
        for name in [names[i] for i in plain]:  # characters that only occur inside pieces
            for char in name:
                symbol.setdefault(char, self.size + len(symbol))
        if any("\n" in names[i] or SPACE in names[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece reaches across a space or a line feed")
        inner = {name[k : k + 2] for name in (names[i] for i in plain) for k in range(len(name) - 1)}
        letters = [c for c in map(chr, range(97, 123)) if not {c + ",", c + "."} & inner]
        #: Where a unit may end between a letter and a comma or full stop: no piece holds both.
        self.cut = re.compile(f"(?<=[{''.join(letters)}])(?=[,.])") if letters else None
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        pairs: dict[int, tuple[int, int]] = {}
        self.base = self.size + len(symbol) + 1
        for i in plain:
            name = names[i]
            for cut in range(1, len(name)):
                left, right = symbol.get(name[:cut]), symbol.get(name[cut:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = (order[sp.get_score(i)], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [_NO_PAIR], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()] + [0], np.int64)
        self.char_symbol = np.full(0x110000, -1, np.int64)
        for char, i in symbol.items():
            if len(char) == 1:
                self.char_symbol[ord(char)] = i
        out = []
        for i in range(self.size):
            if i in byte_of:
                out.append(bytes([byte_of[i]]))
            elif sp.is_control(i):
                out.append(b"")
            elif sp.is_unknown(i):
                out.append(" ⁇ ".encode())
            else:
                out.append(names[i].replace(SPACE, " ").encode())
        self.is_byte = np.array([i in byte_of for i in range(self.size)])
        self.piece_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.piece_len = np.array([len(x) for x in out], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.decimals = [b"%d" % i for i in range(self.size)]
        self._forget()

    def _forget(self) -> None:
        self.units = _Units()
        self.store = np.zeros(1 << 20, np.int32)
        self.at = np.zeros(1 << 18, np.int64)
        self.length = np.zeros(1 << 18, np.int64)
        self.seen = np.zeros(1 << 18, np.int64)
        self.used = 0

    def _trim(self) -> None:
        """Keep the units that were seen often enough; all of them, were most of them so, would not do."""
        n = len(self.units)
        keep = np.flatnonzero(self.seen[:n] >= 3)
        if len(keep) > self.MEMORY // 2 or self.length[keep].sum() > self.MEMORY_IDS // 2:
            return self._forget()
        names = list(self.units)
        ids, lengths = self.store[ragged(self.at[keep], self.length[keep])], self.length[keep]
        self._forget()
        for k in keep.tolist():
            self.units[names[k]]
        self._remember(0, ids, lengths)
        self.seen[: len(keep)] = 1

    def _remember(self, known: int, ids: np.ndarray, lengths: np.ndarray) -> None:
        """The units from number ``known`` on have these ids."""
        n = known + len(lengths)
        self._grow(n, self.used + len(ids))
        self.store[self.used : self.used + len(ids)] = ids
        self.at[known:n] = self.used + np.cumsum(lengths) - lengths
        self.length[known:n] = lengths
        self.used += len(ids)
        self.units.fresh.clear()

    # -- merge rounds ---------------------------------------------------------------

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; ``_NO_PAIR`` where the model has none."""
        key = np.where((left < 0) | (right < 0), -1, left * self.base + right)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        at = np.where(self.keys[at] == key, at, len(self.keys))
        return self.ranks[at], self.merged[at]

    def merge_rounds(self, symbols: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no pair remains. ``unit`` is ascending; negative symbols never merge.

        Returns the symbols left, with their units, in order.
        """
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        place = np.arange(len(symbols), dtype=np.int64)
        rank, into = self._pairs(symbols, unit)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            segment = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(unit)]))
            best = np.minimum.reduceat(rank, first)
            open_unit = best[segment] < _NO_PAIR
            if not open_unit.all():
                done.append((place[~open_unit], symbols[~open_unit], unit[~open_unit]))
                symbols, unit, place, rank, into, segment = (x[open_unit] for x in (symbols, unit, place, rank, into, segment))
                if not len(symbols):
                    break
            candidate = rank == best[segment]
            take = np.flatnonzero(candidate)
            # of a run of overlapping candidates, every second one from the left
            run = np.r_[True, np.diff(take) != 1]
            run_at = np.flatnonzero(run)
            in_run = np.arange(len(take)) - np.repeat(run_at, np.diff(np.r_[run_at, len(take)]))
            take = take[in_run % 2 == 0]
            take = self._safe(take, symbols, unit, rank, into, segment)
            symbols[take] = into[take]
            keep = np.ones(len(symbols), bool)
            keep[take + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[take] = True
            symbols, unit, place, rank, into, changed = (x[keep] for x in (symbols, unit, place, rank, into, changed))
            redo = np.flatnonzero(changed | np.r_[changed[1:], False])
            self._pairs_at(redo, symbols, unit, rank, into)
        if not done:
            return symbols, unit
        place, symbols, unit = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place, kind="stable")
        return symbols[order], unit[order]

    def _pairs(self, symbols: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, into = np.full(len(symbols), _NO_PAIR), np.zeros(len(symbols), np.int64)
        self._pairs_at(np.arange(len(symbols)), symbols, unit, rank, into)
        return rank, into

    def _pairs_at(self, at, symbols, unit, rank, into) -> None:
        """Set rank and merged symbol of the pairs that begin at ``at``."""
        rank[at] = _NO_PAIR
        at = at[at + 1 < len(symbols)]
        at = at[unit[at] == unit[at + 1]]
        rank[at], into[at] = self.look_up(symbols[at], symbols[at + 1])

    def _safe(self, take, symbols, unit, rank, into, segment) -> np.ndarray:
        """``take`` up to each unit's first merge after which a pair no worse than it appears."""
        n, new = len(symbols), into[take]
        here, mine = segment[take], rank[take]
        # the symbol to the left, merged already if it is the previous one of take
        joined = np.r_[False, (np.diff(take) == 2)]
        left_at = take - 1
        left_ok = (left_at >= 0) & (unit[left_at] == unit[take])
        left = np.where(joined, np.r_[0, new[:-1]], symbols[left_at])
        right_at = np.minimum(take + 2, n - 1)
        right_ok = (take + 2 < n) & (unit[right_at] == unit[take])
        left_rank = self.look_up(np.where(left_ok, left, -1), new)[0]
        right_rank = self.look_up(new, np.where(right_ok, symbols[right_at], -1))[0]
        stop = (left_rank <= mine) | (right_rank <= mine)
        if not stop.any():
            return take
        stops = np.cumsum(stop) - stop  # stops before each
        head = np.r_[True, here[1:] != here[:-1]]
        before = np.repeat(stops[head], np.diff(np.r_[np.flatnonzero(head), len(here)]))
        return take[stops == before]

    # -- texts ----------------------------------------------------------------------

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the units and their lengths."""
        text = "".join(units)
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(u) for u in units], np.int64)
        unit = np.repeat(np.arange(len(units)), sizes)
        symbols = self.char_symbol[chars]
        symbols = np.where(symbols < 0, -1 - chars, symbols)
        symbols, unit = self.merge_rounds(symbols, unit)
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.size))
        if not len(odd):
            return symbols, np.bincount(unit, minlength=len(units)).astype(np.int64)
        back = {v: k for k, v in enumerate(self.char_symbol.tolist()) if v >= self.size} if (symbols >= self.size).any() else {}
        spelled = [chr(back[s] if s >= 0 else -1 - s).encode("utf-8", "surrogatepass") for s in symbols[odd].tolist()]
        width = np.ones(len(symbols), np.int64)
        width[odd] = [len(x) for x in spelled]
        start = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.int64)
        out[start] = symbols
        out[ragged(start[odd], width[odd])] = self.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
        return out, np.bincount(np.repeat(unit, width), minlength=len(units)).astype(np.int64)

    def _keys(self, text: str) -> list[str]:
        """Keys of a text's units: ``x`` stands for a space and x, a marked key for what follows the mark."""
        if MARK in text:
            return self._spaced(text.replace(SPACE, " ").split(" "), None)
        if self.cut is not None:
            text = self.cut.sub(" " + MARK, text)
        keys = text.replace(SPACE, " ").replace("\n", f" {MARK}\n").split(" ")
        return keys if "" not in keys else self._spaced(keys)

    @staticmethod
    def _spaced(keys: list[str], mark: str | None = MARK) -> list[str]:
        """Join the spaces of empty keys to the next key, unless it is a marked one."""
        out, spaces = [], 0
        for key in keys:
            if key == "":
                spaces += 1
            elif key[0] == mark and spaces:
                out += [" " * (spaces - 1), key]
                spaces = 0
            else:
                out.append(" " * spaces + key)
                spaces = 0
        if spaces:
            out.append(" " * (spaces - 1))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of all texts, with the end id last in each."""
        if len(self.units) > self.MEMORY or self.used > self.MEMORY_IDS:
            self._trim()
        known, number, row = len(self.units), self.units.__getitem__, []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text and MARK not in text:
                before = len(row)
                row.extend(map(number, self._keys(text)))
                sizes[i] = len(row) - before
            elif text:  # the mark is a character of this text
                before = len(row)
                row.extend(number(MARK + SPACE + k.replace(" ", SPACE)) for k in self._keys(text))
                sizes[i] = len(row) - before
        if self.units.fresh:
            spelled = [k[1:] if k[:1] == MARK else SPACE + k.replace(" ", SPACE) for k in self.units.fresh]
            self._remember(known, *self._encode_units(spelled))
        units = np.array(row, np.int64)
        self.seen[: len(self.units)] += np.bincount(units, minlength=len(self.units))
        lengths = self.length[units]
        flat = self.store[ragged(self.at[units], lengths)]
        ends = np.r_[0, np.cumsum(lengths)]
        offsets = np.r_[0, ends[np.cumsum(sizes)] + np.arange(1, len(texts) + 1)]
        ids = np.full(len(flat) + len(texts), self.eos, np.int32)
        place = np.ones(len(ids), bool)
        place[offsets[1:] - 1] = False
        ids[place] = flat
        return ids, offsets

    def _grow(self, units: int, ids: int) -> None:
        if ids > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(max(ids, len(self.store)), np.int32)])
        if units > len(self.at):
            more = np.zeros(max(units, len(self.at)), np.int64)
            self.at, self.length, self.seen = (np.concatenate([x, more]) for x in (self.at, self.length, self.seen))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each row's ids; control ids are silent, the dummy space is dropped."""
        lengths = self.piece_len[ids]
        data = self.piece_bytes[ragged(self.piece_at[ids], lengths)].tobytes()
        ends = np.r_[0, np.cumsum(lengths)][offsets]
        out = []
        for i in range(len(offsets) - 1):
            row = data[ends[i] : ends[i + 1]]
            first = ids[offsets[i]] if offsets[i] < offsets[i + 1] else -1
            if row[:1] == b" " and first >= 0 and not self.is_byte[first]:
                row = row[1:]
            out.append(row.decode("utf-8", "replace"))
        return out


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in columns}
    return pa.RecordBatch.from_pydict(kept | columns)


def _schema(df: DataFrame, added: dict[str, str]) -> str:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in added]
    return ", ".join([*kept, *(f"`{k}` {v}" for k, v in added.items())])


def encode(df: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``df`` with ``piece_ids array<int>``, the ids of ``text`` and the end id."""
    path = path or model_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets = pieces(path).encode(_texts(batch.column(text)))
        return _with(batch, {"piece_ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))})

    return map_arrow(df, run, _schema(df, {"piece_ids": "array<int>"}))


def decode(df: DataFrame, path: str | None = None, ids: str = "piece_ids") -> DataFrame:
    """``df`` with ``decoded string``, the text of the ids; null ids give the empty text."""
    path = path or model_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [np.asarray(x or [], np.int64) for x in batch.column(ids).to_pylist()]
        offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)
        texts = pieces(path).decode(np.concatenate([*rows, np.zeros(0, np.int64)]), offsets)
        return _with(batch, {"decoded": pa.array(texts, pa.string())})

    return map_arrow(df, run, _schema(df, {"decoded": "string"}))


def round_trip(df: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Encode and decode in one pass: ``df`` with the digests of ids and decoded text.

    The ids and texts stay in the worker; only digests cross back into the JVM.
    """
    path = path or model_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = pieces(path)
        column, n = batch.column(text), batch.num_rows
        counts, id_sums, text_sums = np.zeros(n, np.int64), [], []
        for start, end in row_slices(utf8_parts(column)[1], 4 << 20):
            ids, offsets = p.encode(_texts(column.slice(start, end - start)))
            counts[start:end] = np.diff(offsets)
            spelled = [p.decimals[i] for i in ids.tolist()]
            for a, b, decoded in zip(offsets[:-1].tolist(), offsets[1:].tolist(), p.decode(ids, offsets), strict=True):
                id_sums.append(hashlib.sha256(b" ".join(spelled[a:b])).hexdigest())
                text_sums.append(hashlib.sha256(decoded.encode()).hexdigest())
        return _with(batch, {"n_tokens": pa.array(counts), "ids_sha256": pa.array(id_sums), "decoded_sha256": pa.array(text_sums)})

    return map_arrow(df, run, _schema(df, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
