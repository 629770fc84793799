"""Exact repeats of long word windows, found by fixed-block anchors.

With windows of ``WINDOW`` words, every window holds a whole block of ``BLOCK`` =
(WINDOW + 1) // 2 words that starts at a multiple of ``BLOCK``. These non-overlapping
blocks are the index; every rolling stretch of ``BLOCK`` words of every document probes
it. A stretch is a hit if its words also occur elsewhere and one of the occurrences is an
indexed block. Only windows around hits can repeat; their own hashes are counted, and the
windows counted twice or more, joined where they overlap, are the maximal repeats.

Probes do not travel as rows of their own. A task packs the entries of a stretch of its
input (4-byte hash, about a byte of position, the document's key once) per hash bucket,
and a bucket is matched with array operations. Entries that already repeat within the
stretch are settled there and sent once, so no hash is hot. The number of buckets follows
the size of the texts, which bounds what one bucket holds, and so does the number of tasks
of every shuffle where the session's is too small for it. False hits of the short hashes
only nominate windows; the windows are compared by 64-bit hashes within their bucket.

Defined results: null and empty texts have no words; texts of fewer than ``WINDOW`` words
lose nothing; rows that repeat a text are documents of their own, so both lose all their
words if it has a window; rows that repeat id and text get the same result; an empty table
gives an empty table; other columns are ignored, and :func:`without_repeats` carries them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import wordscan as scan
from tidemark.llm.common import row_slices, table, tuned, utf8_parts

WINDOW = 35
BLOCK = (WINDOW + 1) // 2
#: Bytes of text whose entries are packed together, and of text that one bucket stands for.
_PACK = 16 << 20
_PER_BUCKET = 16 << 20
_LEAST_BUCKETS = 64
#: Bytes of text that one task after a shuffle stands for at most, on average.
_PER_TASK = 128 << 20
_CHUNK = 1 << 20


def _packed(keys: np.ndarray, entry_of: np.ndarray, place: np.ndarray, hashes: np.ndarray | None) -> bytes:
    """Entries, ordered by document and place: keys, counts, hashes, gaps between places."""
    first = np.r_[True, entry_of[1:] != entry_of[:-1]]
    at = np.flatnonzero(first)
    gaps = np.diff(place, prepend=0)
    gaps[at] = place[at]
    far = gaps >= 255
    head = np.array([len(at), len(place), int(far.sum()), 0 if hashes is None else hashes.itemsize], "<u4")
    parts = [head, keys[entry_of[at]], np.diff(np.r_[at, len(place)]).astype("<u4")]
    parts += [] if hashes is None else [hashes]
    return b"".join(x.tobytes() for x in (*parts, np.where(far, 255, gaps).astype(np.uint8), gaps[far].astype("<u4")))


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Keys, entries per key, places, hashes."""
    n_keys, n, n_far, width = np.frombuffer(data, "<u4", 4).tolist()
    at = 16
    keys = np.frombuffer(data, "<i8", n_keys, at)
    counts = np.frombuffer(data, "<u4", n_keys, at := at + 8 * n_keys).astype(np.int64)
    at += 4 * n_keys
    hashes = np.frombuffer(data, f"<u{width}", n, at) if width else None
    gaps = np.frombuffer(data, np.uint8, n, at := at + width * n).astype(np.int64)
    gaps[gaps == 255] = np.frombuffer(data, "<u4", n_far, at + n)
    sums = np.cumsum(gaps)
    starts = np.cumsum(counts) - counts
    return keys, counts, sums - np.repeat(sums[starts] - gaps[starts], counts), hashes


def _settle(hashes: np.ndarray, prefer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries repeat among themselves, and one entry for each hash, a preferred one if any."""
    order = np.lexsort((~prefer, hashes))
    ordered = hashes[order]
    head = np.r_[True, ordered[1:] != ordered[:-1]] if len(ordered) else np.zeros(0, bool)
    size = np.diff(np.r_[np.flatnonzero(head), len(ordered)])
    again = np.empty(len(hashes), bool)
    again[order] = np.repeat(size > 1, size)
    one = np.zeros(len(hashes), bool)
    one[order[head]] = True
    return again, one


def _bucketed(buckets: int, width: int, keys: np.ndarray, row: np.ndarray, place: np.ndarray, hashes: np.ndarray, aligned: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Bucket and bytes of what is sent of these entries, and of what is settled already."""
    again, one = _settle(hashes, aligned)
    settled = np.flatnonzero(again)
    if len(settled):
        for chunk in np.array_split(settled, max(1, len(settled) >> 20)):
            yield int(keys[row[chunk[0]]] % buckets), _packed(keys, row[chunk], place[chunk], None)
    sent = np.flatnonzero(one)
    bucket = (hashes[sent] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sent, bucket = sent[order], bucket[order]
    short = (hashes[sent] // np.uint64(buckets)).astype(f"<u{width}")
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(sent) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(bucket[a]), _packed(keys, row[sent[a:b]], place[sent[a:b]], short[a:b])


_PACKED = pa.schema([("bucket", pa.int32()), ("entries", pa.binary())])
_KEY, _PLACES = "_repeat_key", "_repeat_places"
_HITS = pa.schema([(_KEY, pa.int64()), (_PLACES, pa.binary())])


def _sender(entries: Callable, buckets: int, width: int) -> Callable:
    """A ``mapInArrow`` function that packs ``entries(batch)``: keys, rows, places, hashes, aligned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        held_bytes = n_keys = 0

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            rows: list[tuple[int, bytes]] = []
            size = 0
            for row in _bucketed(buckets, width, *columns):
                rows.append(row)
                size += len(row[1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_PACKED)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_PACKED)

        for batch in batches:
            for size, keys, row, place, hashes, aligned in entries(batch):
                held.append((keys, row + n_keys, place, hashes, aligned))
                n_keys += len(keys)
                held_bytes += size
                if held_bytes >= _PACK:
                    yield from flush()
                    held, held_bytes, n_keys = [], 0, 0
        if held:
            yield from flush()

    return run


def _matcher(anchored: bool) -> Callable:
    """Match a bucket: entries whose hash occurs twice or more (``anchored``: once as a block)."""

    def run(bucket: pa.Table) -> pa.Table:
        keys, counts, places, hashes, out = [], [], [], [], []
        for data in bucket.column("entries").to_pylist():
            k, c, p, h = _unpacked(data)
            if h is None:
                out.append((np.repeat(k, c), p))
            else:
                keys.append(k), counts.append(c), places.append(p), hashes.append(h)
        if keys:
            k, c, p, h = (np.concatenate(x) for x in (keys, counts, places, hashes))
            order = np.argsort(h, kind="stable")
            ordered = h[order]
            at = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            size = np.diff(np.r_[at, len(ordered)])
            good = size > 1
            if anchored:
                good &= np.maximum.reduceat((p[order] % BLOCK == 0).astype(np.int8), at) > 0
            hit = np.zeros(len(h), bool)
            hit[order] = np.repeat(good, size)
            out.append((np.repeat(k, c)[hit], p[hit]))
        k, p = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.lexsort((p, k))
        k, p = k[order], p[order]
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        ends = np.r_[at[1:], len(k)][: len(at)]
        data = [p[a:b].astype("<u4").tobytes() for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
        return pa.Table.from_arrays([pa.array(k[at]), pa.array(data, pa.binary())], schema=_HITS)

    return run


def _places(column: pa.Array) -> list[np.ndarray]:
    """Per row the distinct places of its list of packed places."""
    return [np.unique(np.frombuffer(b"".join(x or ()), "<u4")).astype(np.int64) for x in column.to_pylist()]


def _block_entries(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Every stretch of BLOCK words of every text that holds a window."""
    data, offsets = utf8_parts(batch.column("text"))
    all_keys = np.asarray(batch.column(_KEY))
    for a, b in row_slices(offsets, _CHUNK):
        found = scan.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        hashes, first, at = scan.windows(found, BLOCK)
        row = scan.row_of(at)
        place = first - found.offsets[row]
        enough = np.diff(found.offsets)[row] >= WINDOW
        hashes, row, place = hashes[enough], row[enough], place[enough]
        yield int(offsets[b] - offsets[a]), all_keys[a:b], row, place, hashes, place % BLOCK == 0


def _window_entries(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The windows around the hits of each text."""
    data, offsets = utf8_parts(batch.column("text"))
    all_keys, hits = np.asarray(batch.column(_KEY)), _places(batch.column(_PLACES))
    for a, b in row_slices(offsets, _CHUNK):
        found = scan.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        hashes, first, at = scan.windows(found, WINDOW)
        row = scan.row_of(at)
        place = first - found.offsets[row]
        near = np.zeros(int(at[-1]) + 1, np.int64)
        n_windows = np.diff(at)
        lengths = [len(h) for h in hits[a:b]]
        if sum(lengths):
            hit_row = np.repeat(np.arange(b - a), lengths)
            hit = np.concatenate(hits[a:b])
            low = np.maximum(hit - (WINDOW - BLOCK), 0)
            high = np.minimum(hit, n_windows[hit_row] - 1)
            ok = low <= high
            np.add.at(near, at[hit_row[ok]] + low[ok], 1)
            np.add.at(near, at[hit_row[ok]] + high[ok] + 1, -1)
        chosen = np.cumsum(near)[:-1] > 0
        yield int(offsets[b] - offsets[a]) // 4, all_keys[a:b], row[chosen], place[chosen], hashes[chosen], np.ones(int(chosen.sum()), bool)


def _spread(df: DataFrame, key: str, size: int) -> DataFrame:
    """``df`` by ``key`` in partitions for texts of ``size`` bytes, where the session's number is too small for them."""
    parts = -(-size // _PER_TASK)
    return df.repartition(parts, key) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _matched(docs: DataFrame, entries: Callable, buckets: int, width: int, anchored: bool, size: int) -> DataFrame:
    packed = _spread(docs.mapInArrow(_sender(entries, buckets, width), "bucket int, entries binary"), "bucket", size)
    hits = packed.groupBy("bucket").applyInArrow(_matcher(anchored), f"{_KEY} bigint, {_PLACES} binary")
    return _spread(hits, _KEY, size).groupBy(_KEY).agg(F.collect_list(_PLACES).alias(_PLACES))


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a key per row, and per key the places of its repeated windows."""
    tuned(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(_LEAST_BUCKETS, 1 << (size // _PER_BUCKET).bit_length())
    keyed = docs.select(F.xxhash64("doc_id", "text").alias(_KEY), *docs.columns)
    hits = _matched(keyed.select(_KEY, "text"), _block_entries, buckets, 4, True, size)
    keyed = _spread(keyed, _KEY, size)
    # with all columns, so that the last join finds its texts shuffled already
    around = keyed.join(hits.hint("shuffle_hash"), _KEY)
    found = _matched(around, _window_entries, buckets, 8, False, size)
    return keyed, found


def _covered(n: int, places: np.ndarray) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, np.minimum(places + WINDOW, n), -1)
    return np.cumsum(change)[:-1] > 0


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``: the words outside all repeats,
    joined by one space."""
    keyed, found = repeated_windows(docs)
    joined = keyed.join(found.hint("shuffle_hash"), _KEY, "left").drop(_KEY)
    added = {"n_words": "bigint", "n_removed": "bigint", "kept_text": "string"}
    kept = [c for c in docs.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, texts = [], [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column(_PLACES), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                if places.is_valid:
                    gone = _covered(len(words), np.unique(np.frombuffer(b"".join(places.as_py()), "<u4")).astype(np.int64))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            columns = {c: batch.column(c) for c in kept}
            yield pa.RecordBatch.from_pydict(columns | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(texts, pa.string())})

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), *(f"{k} {v}" for k, v in added.items())])
    return joined.select(*docs.columns, _PLACES).mapInArrow(run, schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: The same words by grouping all windows by their text, without anchors or hashes.
OP6_SQL = rf"""
WITH worded AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
starts AS (
  SELECT doc_id, p, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM worded WHERE len(w) >= {WINDOW})
), again AS (SELECT doc_id, p FROM starts WHERE words IN (SELECT words FROM starts GROUP BY words HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, p + j AS p FROM again, range({WINDOW}) AS r(j)),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM worded),
left_ AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM worded d LEFT JOIN left_ USING (doc_id)
"""
