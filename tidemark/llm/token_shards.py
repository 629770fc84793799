"""Token ids in binary shards with a minimal perfect hash index.

Documents are range-partitioned and sorted by id, encoded, and packed into shards. A shard
is one row of a Parquet table, so any file system that Spark reads will do:

* ``ids``: raw little-endian ids of its documents, end to end, 2 bytes each (4 where the
  vocabulary needs them);
* ``hash``: the perfect hash from keys to slots; ``offsets``, ``lengths``: per slot the
  place in ``ids``; ``fingerprints``: 32 bits of the key in each slot;
* ``keys``: the document ids, ascending, to enumerate the shard.

A manifest next to them holds each shard's key range and the number of ids before it.
A key is a document id and its number among rows that repeat the id.

Defined results: null and empty texts hold the end id alone; a null id sorts first and has
a key of its own; rows that repeat an id keep one entry each; an empty table gives an
empty shard table; other columns are not stored.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ragged, row_slices, table, tuned, utf8_parts
from tidemark.llm.perfect_hash import PerfectHash, fingerprint, mix64
from tidemark.llm.units import UnitMemory
from tidemark.session import fresh_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Bytes of ids after which a shard is closed.
SHARD_BYTES = 4 << 20
#: Bytes of text that are encoded at once.
SLICE_BYTES = 2 << 20
_NULL_KEY = np.int64(-(1 << 63))

SHARDS = "first_doc long, last_doc long, part int, seq int, n_docs long, n_ids long, width int, ids binary, hash binary, offsets binary, lengths binary, fingerprints binary, keys binary, null_docs long"
DIGESTS = "doc_id long, part int, seq int, local_start long, n_tokens long, ids_crc32 long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: What a vocabulary must say of itself for its texts to be cut.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
#: UTF-8 between U+00C0 and U+017F that is no letter, or none alone in lower case: two signs and the dotted capital I.
_NO_LETTERS = np.array([0xC397, 0xC3B7, 0xC4B0])


class WordBpe:
    """Ids of a lower-casing word BPE, whose tokens never cross white space.

    Its pre-tokenizer also parts a letter from an ASCII character that is none, an apostrophe
    before the letter excepted. A text's units are cut at both, so that a word is one unit
    whatever stands around it. New units of letters alone are one word each and are handed
    to the library many at a time, between spaces; their ids end where a word ends. Texts
    of a vocabulary that is built otherwise are not cut.
    """

    #: New words in one text for the library.
    TOGETHER = 200

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.memory = UnitMemory(self._encode, 600_000)
        with open(path, encoding="utf-8") as file:
            self.cuts = self._may_cut(json.load(file))
        self.last = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    @staticmethod
    def _may_cut(spec: dict) -> bool:
        """Whether words are found as the cuts assume, and added tokens start with ``<|`` and hold no white space."""
        parts = (spec["normalizer"], spec["pre_tokenizer"], spec["post_processor"], spec["model"].get("end_of_word_suffix"))
        added = [x for x in spec["added_tokens"] if x["lstrip"] or x["rstrip"] or x["normalized"] or not re.fullmatch(r"<\|\S+", x["content"])]
        return parts == (_NORMALIZER, _PRE_TOKENIZER, None, "</w>") and not added

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [i for i, u in enumerate(units) if u.isalpha()] if self.cuts else []
        runs = [words[k : k + self.TOGETHER] for k in range(0, len(words), self.TOGETHER)]
        order, found, lengths = [], [], []
        for run, ids in zip(runs, self._library([" ".join([units[i] for i in run]) for run in runs]), strict=True):
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(run):  # else the library sees several words in one of the units
                order += run
                found.append(ids)
                lengths.append(np.diff(ends, prepend=0))
        rest = sorted(set(range(len(units))).difference(order))
        found += (rows := self._library([units[i] for i in rest]))
        lengths = np.concatenate([*lengths, np.array([len(r) for r in rows], np.int64)])
        back = np.argsort(np.array(order + rest, np.int64))
        starts = np.cumsum(lengths) - lengths
        return np.concatenate([np.zeros(0, np.int32), *found])[ragged(starts[back], lengths[back])], lengths[back]

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Units of an Arrow column of texts, end to end, and their number in each text."""
        data, offsets = utf8_parts(texts)
        gap = (data == 32) | (data == 10) if self.cuts else np.zeros(len(data), bool)
        start = np.zeros(len(data) + 1, bool)
        start[offsets[:-1]] = True
        marked = np.zeros(0, np.int64)
        if self.cuts:
            start[1:] |= gap
            marked = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
            if len(marked):  # added tokens are matched in the text as it is: words with such a mark stay whole
                whole = np.flatnonzero(start[:-1] & ~gap)
                marked = whole[np.unique(np.searchsorted(whole, marked, side="right")) - 1]
            first = (data | 32) - np.uint8(ord("a")) < 26
            other = (data - np.uint8(ord("!")) < 94) & ~first
            lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5))
            lead = lead[~np.isin(data[lead].astype(np.int64) << 8 | data[lead + 1], _NO_LETTERS)]
            last = first.copy()
            first[lead] = last[lead + 1] = True
            cut = (last[:-1] & other[1:]) | (other[:-1] & (data[:-1] != ord("'")) & first[1:])
            edges = np.r_[np.flatnonzero(start), len(data)]
            cut[ragged(marked, edges[np.searchsorted(edges, marked, side="right")] - marked - 1)] = False
            start[1:-1] |= cut
        start = start[:-1] & ~gap
        sizes = np.diff(np.searchsorted(np.flatnonzero(start), offsets))
        kept, at = data[~gap], np.flatnonzero(start[~gap])
        if self.cuts and len(at):
            lower = np.maximum.reduceat(kept, at) < 128
            lower[np.searchsorted(np.flatnonzero(start), marked)] = False
            upper = (kept - np.uint8(ord("A")) < 26) & np.repeat(lower, np.diff(at, append=len(kept)))
            kept = kept | upper.view(np.uint8) << 5
        ends = np.r_[at, len(kept)].astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(kept))), sizes

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        units, sizes = self.units(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        coded = units.dictionary_encode()
        return self.memory.gather(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), sizes, END_ID)


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _slot_keys(docs: np.ndarray, known: np.ndarray) -> np.ndarray:
    """64-bit keys of sorted document ids: the id scrambled with its number among equals."""
    head = np.r_[True, (docs[1:] != docs[:-1]) | (known[1:] != known[:-1])] if len(docs) else np.zeros(0, bool)
    first = np.flatnonzero(head)
    nth = np.arange(len(docs)) - np.repeat(first, np.diff(np.r_[first, len(docs)]))
    salt = (2 * nth + ~known).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(mix64(docs.view(np.uint64)) + salt)


def _shard(part: int, seq: int, docs: np.ndarray, known: np.ndarray, ids: np.ndarray, sizes: np.ndarray, width: int) -> dict:
    keys = _slot_keys(docs, known)
    hashed = PerfectHash.build(keys)
    slot = hashed.look_up(keys)
    if len(np.unique(slot)) != len(keys):
        raise ValueError("two keys of a shard have the same hash")
    starts = np.cumsum(sizes) - sizes
    by_slot = [np.empty(len(keys), kind) for kind in ("<u8", "<u4", "<u4")]
    for column, values in zip(by_slot, (starts, sizes, fingerprint(keys)), strict=True):
        column[slot] = values
    return {
        "first_doc": int(docs[0]), "last_doc": int(docs[-1]), "part": part, "seq": seq, "n_docs": len(docs), "n_ids": len(ids), "width": width,
        "ids": ids.astype(f"<u{width}").tobytes(), "hash": hashed.to_bytes(), "offsets": by_slot[0].tobytes(), "lengths": by_slot[1].tobytes(),
        "fingerprints": by_slot[2].tobytes(), "keys": docs.astype("<i8").tobytes(), "null_docs": int((~known).sum()),
    }


def _joined(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``limit`` bytes or more."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def write_shards(docs: DataFrame, path: str, vocabulary: str | None = None, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode ``doc_id, text`` into shards under ``path``, in ascending order of ids."""
    vocabulary = vocabulary or vocabulary_path()
    spark = tuned(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, bpe, seq, held, filled = TaskContext.get().partitionId(), word_bpe(vocabulary), 0, [], 0

        def close() -> pa.RecordBatch:
            joined = [np.concatenate(x) for x in zip(*held, strict=True)]
            return pa.RecordBatch.from_pylist([_shard(part, seq, *joined, bpe.width)], schema=_ARROW_SHARDS)

        for batch in _joined(batches, SLICE_BYTES):
            column = batch.column("text")
            doc = batch.column("doc_id")
            known_all = np.asarray(doc.is_valid())
            ids_all = np.where(known_all, np.asarray(doc.fill_null(0)), _NULL_KEY).astype(np.int64)
            for start, end in row_slices(utf8_parts(column)[1], SLICE_BYTES):
                ids, offsets = bpe.encode(column.slice(start, end - start))
                held.append((ids_all[start:end], known_all[start:end], ids, np.diff(offsets)))
                filled += len(ids) * bpe.width
                if filled >= shard_bytes:
                    yield close()
                    held, filled, seq = [], 0, seq + 1
        if held:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(pack, SHARDS).write.option("compression", "zstd").parquet(f"{path}/shards")
    _manifest(spark.read.schema(SHARDS).parquet(f"{path}/shards")).write.parquet(f"{path}/manifest")


_ARROW_SHARDS = pa.schema(
    [(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in SHARDS.split(", "))]
)


def _manifest(shards: DataFrame) -> DataFrame:
    """Key range and ids before each shard: sums within parts, then over the parts."""
    heads = shards.select("part", "seq", "first_doc", "last_doc", "n_docs", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("ids"), F.min("first_doc").alias("low"))
    earlier = Window.orderBy("low", "part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("part_start"))
    return heads.join(before, "part").select(
        *heads.columns, (F.col("part_start") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("start_id")
    )


class Shard:
    """Keyed access to one shard row."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], f"<u{row['width']}")
        self.hash = PerfectHash.from_bytes(row["hash"])
        self.offsets, self.lengths, self.prints = (np.frombuffer(row[k], t) for k, t in (("offsets", "<u8"), ("lengths", "<u4"), ("fingerprints", "<u4")))
        self.docs = np.frombuffer(row["keys"], "<i8")
        self.known = np.arange(len(self.docs)) >= row["null_docs"]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys, -1 where the fingerprint shows that the shard lacks the key."""
        slot = self.hash.look_up(keys)
        good = slot >= 0
        good[good] = self.prints[slot[good]] == fingerprint(keys[good])
        return np.where(good, slot, -1)

    def get(self, doc_id: int, nth: int = 0) -> np.ndarray | None:
        """The ids of a document, or None; ``nth`` tells rows with the same id apart."""
        docs = np.full(nth + 1, doc_id, np.int64)
        slot = self.find(_slot_keys(docs, np.ones(nth + 1, bool))[-1:])[0]
        return None if slot < 0 else self.ids[int(self.offsets[slot]) :][: int(self.lengths[slot])]


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Every stored document by keyed access: place, number and checksum of its ids."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                slot = shard.find(_slot_keys(shard.docs, shard.known))
                if (slot < 0).any():
                    raise ValueError(f"shard {row['part']}-{row['seq']} lacks one of its keys")
                start, size = shard.offsets[slot].astype(np.int64), shard.lengths[slot].astype(np.int64)
                wide = shard.ids.astype("<u4")
                sums = [zlib.crc32(wide[a : a + b]) for a, b in zip(start.tolist(), size.tolist(), strict=True)]
                n = len(slot)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(shard.docs, mask=~shard.known), "part": pa.array([row["part"]] * n, pa.int32()), "seq": pa.array([row["seq"]] * n, pa.int32()),
                    "local_start": pa.array(start), "n_tokens": pa.array(size), "ids_crc32": pa.array(sums, pa.int64()),
                })

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    digests = spark.read.schema(SHARDS).parquet(f"{path}/shards").mapInArrow(look, DIGESTS)
    manifest = spark.read.parquet(f"{path}/manifest").select("part", "seq", "start_id")
    return digests.join(manifest, ["part", "seq"]).select(
        "doc_id", (F.col("start_id") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-shards")
    write_shards(table(spark, sf_dir, "documents"), path)
    return read_digests(spark, path)
