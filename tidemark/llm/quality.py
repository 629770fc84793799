"""Quality rules: rules on one document, and lines that a host repeats across documents.

Base rules count words, symbols, repeated lines and repeated five-word windows of a whole
text. The cross-document rule hashes normalised lines (words, A-Z in lower case, joined by
one space), counts each host's documents per line, and removes a line whose count is above
``MAX_DOCS`` from every document but the host's first one with it. A document left with
fewer than ``MIN_WORDS`` words or less than ``MIN_LEFT`` of its words is depleted.

Counts are partial sums per task, so a hot line or host is no hot task. The table of lines
above the limit is written out, and the join with it goes by its real size.

Defined results: null and empty texts have no words and fail the base rules; a null source
is a host of its own; rows that repeat id and text get the same verdict and count as
documents of their own; an empty table gives an empty table; other columns are carried
along by :func:`filter_documents`, which returns exactly the columns it is given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import wordscan as scan
from tidemark.llm.common import columns_of, map_arrow, row_slices, table, unused, utf8_parts
from tidemark.session import materialize

MAX_DOCS = 20
MIN_WORDS = 10
MIN_LEFT_PERCENT = 30
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
_CHUNK = 1 << 19

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_LEAD = (np.arange(256) & 0xC0) != 0x80


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte range of every line, and per text its first line."""
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    text_lines = np.bincount(np.searchsorted(offsets, feeds, side="right") - 1, minlength=len(offsets) - 1) + 1
    line_offsets = np.r_[0, np.cumsum(text_lines)]
    ends = np.r_[starts[1:], len(data)] - 1
    ends[line_offsets[1:] - 1] = offsets[1:]
    return starts, ends, line_offsets


def _measure(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray]:
    """Base counts per text; per line with a word its hash, number and words; line offsets."""
    found = scan.words(data, offsets)
    starts, ends, line_offsets = _lines(data, offsets)
    n_words = np.diff(found.offsets)
    sums = lambda flags: scan.per_row(flags, offsets)

    first_word, next_word = np.searchsorted(found.starts, starts), np.searchsorted(found.starts, ends)
    worded = next_word > first_word
    kept_lines = np.flatnonzero(worded)
    line_row = scan.row_of(line_offsets)[kept_lines]
    per_text = np.r_[0, np.cumsum(np.bincount(line_row, minlength=len(n_words)))]

    raw = scan.in_row(scan.Sums(scan.BYTE[data]).hashes(starts[kept_lines], ends[kept_lines]), line_row)
    _, first_seen = np.unique(raw, return_index=True)
    again = np.ones(len(raw), bool)
    again[first_seen] = False

    hashes, first, window_offsets = scan.windows(found, 5)
    own = scan.in_row(hashes, scan.row_of(window_offsets))
    _, group, times = np.unique(own, return_inverse=True, return_counts=True)
    repeated = first[times[group] > 1]
    change = np.zeros(len(found.starts) + 1, np.int64)
    np.add.at(change, repeated, 1)
    np.add.at(change, repeated + 5, -1)
    covered = np.cumsum(change)[:-1] > 0

    base = {
        "n_words": n_words,
        "word_chars": sums(_LEAD[data] & ~scan.IS_SPACE[data]),
        "n_symbols": sums(_SYMBOL[data]),
        "n_dup_lines": scan.per_row(again, per_text),
        "n_repeat_words": scan.per_row(covered, found.offsets),
    }
    folded = scan.words(data, offsets, fold=True).hashes
    lines = {
        "line": scan.Sums(folded).hashes(first_word[kept_lines], next_word[kept_lines]).view(np.int64),
        "line_no": kept_lines - line_offsets[line_row],
        "line_words": (next_word - first_word)[kept_lines],
    }
    return base, lines, per_text


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_rules(docs: DataFrame) -> DataFrame:
    """``doc_id, source, text_hash``, the base counts, and ``lines``: per line with a word its
    hash, number and words."""
    keyed = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8_parts(batch.column("text"))
        parts = [_measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_slices(offsets, _CHUNK)]
        columns = {n: batch.column(n) for n in ("doc_id", "source", "text_hash")}
        columns |= {n: pa.array(np.concatenate([p[0][n] for p in parts])) for n in _BASE}
        line = {n: np.concatenate([p[1][n] for p in parts]) for n in ("line", "line_no", "line_words")}
        at = np.r_[0, np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))].astype(np.int32)
        rows = pa.StructArray.from_arrays([pa.array(line["line"]), pa.array(line["line_no"].astype(np.int32)), pa.array(line["line_words"].astype(np.int32))], ["line", "line_no", "line_words"])
        columns["lines"] = pa.ListArray.from_arrays(pa.array(at), rows)
        return pa.RecordBatch.from_pydict(columns)

    counts = ", ".join(f"{n} bigint" for n in _BASE)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(keyed, run, f"doc_id {kind}, source string, text_hash bigint, {counts}, lines array<struct<line: bigint, line_no: int, line_words: int>>")


def verdicts(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Per row of ``docs``: base counts, ``removed`` (numbers of the lines taken out), and ``kept``."""
    base = materialize(base_rules(docs), "quality-base")
    lines = base.select("doc_id", "source", "text_hash", F.inline("lines"))
    # the documents of a line: a row for each, however often the line stands in it
    per_doc = base.select("doc_id", "source", F.explode(F.array_distinct(F.col("lines.line"))).alias("line"))
    hot = per_doc.groupBy("source", "line").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc")).where(F.col("docs") > max_docs)
    hot = materialize(hot.select(F.col("source").alias("hot_source"), F.col("line").alias("hot_line"), "first_doc"), "quality-hot")
    gone = (
        lines.join(hot, (F.col("line") == F.col("hot_line")) & F.col("source").eqNullSafe(F.col("hot_source")))
        .where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        .groupBy(F.col("doc_id").alias("gone_doc"), F.col("text_hash").alias("gone_hash"))
        .agg(F.collect_set(F.struct("line_no", "line_words")).alias("gone"))
    )
    gone_words = F.aggregate("gone", F.lit(0).cast("long"), lambda s, x: s + x["line_words"])
    joined = base.drop("lines").join(gone, F.col("doc_id").eqNullSafe(F.col("gone_doc")) & F.col("text_hash").eqNullSafe(F.col("gone_hash")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    left = F.col("n_words") - F.coalesce(gone_words, F.lit(0).cast("long"))
    depleted = (left < MIN_WORDS) | (left * 100 < F.col("n_words") * MIN_LEFT_PERCENT)
    return joined.select(
        "doc_id", "text_hash", *_BASE,
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
        left.alias("n_left_words"),
        F.coalesce(F.col("gone.line_no"), F.array().cast("array<int>")).alias("removed"),
    )


def filter_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The documents kept, without their removed lines; the columns of ``docs``."""
    doc, digest, gone = unused(docs, "q_doc", "q_hash", "q_removed")
    found = verdicts(docs, **parameters).where("kept").select(F.col("doc_id").alias(doc), F.col("text_hash").alias(digest), F.col("removed").alias(gone)).distinct()
    lines = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i))
    text = F.when(F.size(gone) == 0, F.col("text")).otherwise(F.array_join(lines, "\n"))
    joined = docs.join(found.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(doc)) & F.xxhash64("text").eqNullSafe(F.col(digest)))
    return joined.withColumn("text", text).select(*columns_of(docs))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *_BASE, "base_failed", "kept", "n_left_words", F.size("removed").cast("long").alias("n_removed_lines"))


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), raw_lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d
), lines AS (
  SELECT doc_id, source, line, n, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM raw_lines
), worded AS (
  SELECT *, translate(array_to_string(lw, ' '), '{_AZ}', '{_AZ.lower()}') AS norm FROM lines WHERE len(lw) > 0
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id
), win AS (
  SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)
), again AS (
  SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1
), cover AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM again) GROUP BY doc_id
), hot AS (
  SELECT source, norm, min(doc_id) AS first_doc FROM worded GROUP BY source, norm HAVING count(DISTINCT doc_id) > {MAX_DOCS}
), gone AS (
  SELECT l.doc_id, sum(len(l.lw)) AS words, count(*) AS n
  FROM worded l JOIN hot h ON l.norm = h.norm AND l.source IS NOT DISTINCT FROM h.source AND l.doc_id <> h.first_doc GROUP BY l.doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(w) - coalesce(words, 0) AS BIGINT) AS n_left_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed_lines
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN gone USING (doc_id)
), f AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (n_left_words < {MIN_WORDS} OR n_left_words * 100 < n_words * {MIN_LEFT_PERCENT}) AS kept FROM f
"""
