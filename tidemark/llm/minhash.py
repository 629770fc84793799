"""MinHash near-duplicates with b-bit signatures.

A document's set holds its distinct five-word shingles. Documents with the same set form a
class, and one row stands for it. Per class: ``HASHES`` minima; 32 bands of four full
minima give candidates, and the low ``BITS`` bits of all minima, packed into eight words,
estimate similarity by bit counts, corrected for chance collisions. Candidates whose
estimate could belong to a link are confirmed on full sets.

No bucket is expanded into all pairs. Each bucket's members are first paired with the
member that shares most buckets with others; links found so are closed into components;
then only buckets that still span several components pair their outsiders with the
members of other components. An estimate from ``FINE_HASHES`` one-bit minima is part of
that join's condition, so the pairs it rules out are never rows. So a group of thousands
of near copies costs one comparison a member, and no pair of a common bucket that the
estimates admit goes unchecked unless the pair is connected already.

A pair of similarity 0.75 shares no band with probability 5e-6 at most, and is estimated
below ``LEAST_ESTIMATE`` (``LEAST_FINE_ESTIMATE``) with about the same.

Defined results: null, empty and wordless texts have an empty set and are linked with
nothing; with one to four words the whole sequence is the shingle; rows that repeat an id
are documents of their own, and equal sets are linked whatever their ids; an empty table
gives an empty table; other columns are carried along by :func:`keep_one`.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import wordscan as scan
from tidemark.llm.common import columns_of, map_arrow, row_slices, table, tuned, unused, utf8_parts
from tidemark.llm.components import components
from tidemark.llm.perfect_hash import mix64
from tidemark.session import materialize

SHINGLE = 5
PERCENT = 75
HASHES = 128
ROWS_PER_BAND = 4
BANDS = HASHES // ROWS_PER_BAND
BITS = 4
SIG = [f"s{i}" for i in range(HASHES * BITS // 64)]
#: 0.75 less four and a half standard deviations of the estimate.
LEAST_ESTIMATE = 0.57
_CHUNK = 1 << 19

#: One-bit minima that tell apart the members of buckets still open, and the least estimate by them.
FINE_HASHES = 4096
FINE = [f"f{i}" for i in range(FINE_HASHES // 64)]
LEAST_FINE_ESTIMATE = 0.703

_rng = np.random.default_rng(7)
_MULTIPLIERS = _rng.integers(0, 1 << 63, HASHES + FINE_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _rng.integers(0, 1 << 63, HASHES + FINE_HASHES, dtype=np.uint64)


def shingle_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of every text, repeats included, and offsets."""
    found = scan.words(data, offsets, fold=True)
    hashes, _, at = scan.windows(found, SHINGLE)
    counts = np.diff(found.offsets)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        whole = scan.Sums(found.hashes).hashes(found.offsets[short], found.offsets[short + 1])
        hashes = np.insert(hashes, at[short], mix64(whole + counts[short].astype(np.uint64)))
        extra = np.zeros(len(counts) + 1, np.int64)
        extra[short + 1] = 1
        at = at + np.cumsum(extra)
    return hashes, at


def _signatures(hashes: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Per text with a shingle: size and sums of its set, packed low bits, band keys."""
    rows = scan.row_of(at)
    _, first = np.unique(scan.in_row(hashes, rows), return_index=True)
    once = np.zeros(len(hashes), bool)
    once[first] = True
    full = np.flatnonzero(np.diff(at))
    starts = at[full]
    minima = np.empty((HASHES, len(full)), np.uint64)
    for j in range(HASHES):
        minima[j] = np.minimum.reduceat(hashes * _MULTIPLIERS[j] + _ADDENDS[j], starts) if len(full) else 0
    low = minima & np.uint64((1 << BITS) - 1)
    lanes = 64 // BITS
    packed = [np.bitwise_or.reduce([low[i * lanes + k] << np.uint64(BITS * k) for k in range(lanes)]) for i in range(len(SIG))]
    bands = np.empty((len(full), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(full), b + 1, np.uint64)
        for m in minima[b * ROWS_PER_BAND : (b + 1) * ROWS_PER_BAND]:
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + m)
        bands[:, b] = key
    sums = lambda x: np.add.reduceat(np.where(once, x, np.uint64(0)), starts) if len(full) else np.zeros(0, np.uint64)
    sizes = np.zeros(len(at) - 1, np.int64)
    np.add.at(sizes, rows, once)
    return {"full": full, "n": sizes, "c1": sums(hashes), "c2": sums(mix64(hashes)), "bands": bands} | dict(zip(SIG, packed, strict=True))


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_shingles, c`` (class of equal sets), packed bits and ``bands``; null for empty sets."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8_parts(batch.column("text"))
        out: list[pa.RecordBatch] = []
        for a, b in row_slices(offsets, _CHUNK):
            got = _signatures(*shingle_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            full, n = got["full"], b - a
            empty = np.ones(n, bool)
            empty[full] = False

            def spread(x: np.ndarray, n=n, full=full, empty=empty) -> pa.Array:
                wide = np.zeros(n, np.int64)
                wide[full] = x.view(np.int64)
                return pa.array(wide, mask=empty)

            columns = {"doc_id": batch.column("doc_id").slice(a, n), "text_hash": batch.column("text_hash").slice(a, n), "n_shingles": pa.array(got["n"])}
            columns["c"] = spread(mix64(mix64(got["c1"]) + got["c2"] + got["n"][full].astype(np.uint64)))
            columns |= {s: spread(got[s]) for s in SIG}
            ends = np.zeros(n + 1, np.int32)
            ends[1:][full] = BANDS
            columns["bands"] = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(got["bands"].reshape(-1).view(np.int64)))
            out.append(pa.RecordBatch.from_pydict(columns))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    kind = docs.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{s} bigint" for s in SIG)
    return map_arrow(keyed, run, f"doc_id {kind}, text_hash bigint, n_shingles bigint, c bigint, {longs}, bands array<bigint>")


def fine_signatures(texts: DataFrame) -> DataFrame:
    """``c`` and packed one-bit minima for the texts of some classes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8_parts(batch.column("text"))
        out = np.zeros((len(FINE), batch.num_rows), np.uint64)
        for a, b in row_slices(offsets, _CHUNK):
            hashes, at = shingle_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            full = np.flatnonzero(np.diff(at))
            for j in range(FINE_HASHES if len(full) else 0):
                least = np.minimum.reduceat(hashes * _MULTIPLIERS[HASHES + j] + _ADDENDS[HASHES + j], at[full])
                out[j // 64, a + full] |= (least >> np.uint64(20) & np.uint64(1)) << np.uint64(j % 64)
        return pa.RecordBatch.from_pydict({"c": batch.column("c")} | {f: pa.array(out[i].view(np.int64)) for i, f in enumerate(FINE)})

    return map_arrow(texts.select("c", "text"), run, "c bigint, " + ", ".join(f"{f} bigint" for f in FINE))


def fine_estimate(a: str, b: str) -> Column:
    """Similarity from one-bit minima: twice the share of equal bits, less one."""
    differing = functools.reduce(Column.__add__, (F.bit_count(F.col(f"{a}.{f}").bitwiseXOR(F.col(f"{b}.{f}"))) for f in FINE))
    return 1 - differing * (2 / FINE_HASHES)


def estimate(a: str, b: str) -> Column:
    """Similarity from the packed low bits of two sides, corrected for chance collisions."""
    lanes = sum(1 << BITS * k for k in range(64 // BITS))
    differing = None
    for s in SIG:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        folded = functools.reduce(lambda y, k, x=x: y.bitwiseOR(F.shiftrightunsigned(x, k)), range(1, BITS), x)
        count = F.bit_count(folded.bitwiseAND(F.lit(lanes).cast("long")))
        differing = count if differing is None else differing + count
    chance = 1 / (1 << BITS)
    return ((1 - differing / HASHES) - chance) / (1 - chance)


def sizes_allow(a: str, b: str) -> Column:
    """No pair whose set sizes differ by more can reach the similarity."""
    x, y = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return F.least(x, y) * 100 >= F.greatest(x, y) * PERCENT


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``u, v`` of classes whose full sets are similar enough; ``texts`` has ``c, text``."""
    tuned(pairs.sparkSession)

    def shingles(text: str) -> np.ndarray:
        data = np.frombuffer((text or "").encode(), np.uint8)
        return np.unique(shingle_rows(data, np.array([0, len(data)], np.int64))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, np.ndarray] | None = None
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (u, a, b) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("u", "a", "b")), strict=True)):
                if held is None or held[0] != u:
                    held = (u, shingles(a))
                x, y = held[1], shingles(b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= PERCENT * (len(x) + len(y) - both)
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    with_b = pairs.join(texts.select(F.col("c").alias("v"), F.col("text").alias("b")), "v")
    both = with_b.join(texts.select(F.col("c").alias("u"), F.col("text").alias("a")), "u")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, text_hash, n_shingles, component_id, kept``."""
    signed = materialize(signatures(docs), "minhash-signed")
    full = signed.where(F.col("c").isNotNull())
    labels = full.groupBy("c").agg(F.min("doc_id").alias("label"))
    reps = materialize(
        full.join(labels.select(F.col("c").alias("rc"), "label"), (F.col("c") == F.col("rc")) & F.col("doc_id").eqNullSafe(F.col("label")))
        .dropDuplicates(["c"])
        .select("c", "label", "text_hash", "n_shingles", *SIG, "bands"),
        "minhash-classes",
    )
    member = reps.select("c", F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    buckets = materialize(member.join(shared, "band"), "minhash-buckets")
    facts = reps.select("c", "n_shingles", *SIG)

    popular = buckets.groupBy("c").agg(F.sum("size").alias("score"))
    scored = buckets.join(popular, "c")
    centres = materialize(scored.groupBy("band").agg(F.max_by("c", "score").alias("centre")), "minhash-centres")
    star = buckets.join(centres, "band").where(F.col("c") != F.col("centre")).select(F.col("centre").alias("u"), F.col("c").alias("v")).distinct()
    likely = (
        star.join(facts.alias("b"), F.col("v") == F.col("b.c"))
        .join(facts.alias("a"), F.col("u") == F.col("a.c"))
        .where(sizes_allow("a", "b") & (estimate("a", "b") >= LEAST_ESTIMATE))
        .select("u", "v")
    )
    likely = materialize(likely, "minhash-likely")

    # the texts of every class that shares a bucket; no other can be part of a link
    involved = buckets.select("c").distinct().join(reps.select("c", "label", "text_hash"), "c")
    keyed = docs.select(F.col("doc_id"), F.xxhash64("text").alias("h"), "text")
    texts = keyed.join(involved.hint("shuffle_hash"), (F.col("h") == F.col("text_hash")) & F.col("doc_id").eqNullSafe(F.col("label")))
    texts = materialize(texts.select("c", "text").dropDuplicates(["c"]), "minhash-texts")

    links = materialize(confirm(likely, texts), "minhash-links")
    roots = components(links)

    # buckets that span several components: their outsiders meet the other components' members
    placed = buckets.join(roots.withColumnRenamed("u", "c"), "c", "left").select("band", "c", F.coalesce("root", "c").alias("root"))
    spread = placed.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where(F.col("r0") != F.col("r1")).select("band")
    main = centres.join(spread, "band").join(roots.withColumnRenamed("u", "centre"), "centre", "left").select("band", F.coalesce("root", "centre").alias("main"))
    open_ = materialize(placed.join(main, "band"), "minhash-open")
    fine = fine_signatures(texts.join(open_.select("c").distinct(), "c"))
    fine = materialize(fine.join(reps.select("c", "n_shingles", "bands"), "c"), "minhash-fine")
    members = open_.join(fine, "c")
    inside, outside = members.alias("a"), members.where(F.col("root") != F.col("main")).alias("b")
    # a pair comes from one bucket only, the common one of the least key
    once = F.array_min(F.array_intersect("a.bands", "b.bands")) == F.col("a.band")
    crossing = (
        outside.join(inside, (F.col("a.band") == F.col("b.band")) & (F.col("a.root") != F.col("b.root"))
                     & ((F.col("a.root") == F.col("a.main")) | (F.col("a.c") < F.col("b.c"))) & sizes_allow("a", "b")
                     & (fine_estimate("a", "b") >= LEAST_FINE_ESTIMATE) & once)
        .select(F.col("a.c").alias("u"), F.col("b.c").alias("v"))
        .join(likely, ["u", "v"], "left_anti")
    )
    more = materialize(confirm(materialize(crossing, "minhash-crossing"), texts), "minhash-links")
    if not more.isEmpty():
        roots = components(roots.select("u", F.col("root").alias("v")).union(more))
    return _label(signed, labels, roots)


def _label(signed: DataFrame, labels: DataFrame, roots: DataFrame) -> DataFrame:
    rooted = labels.join(roots.select(F.col("u").alias("c"), "root"), "c")
    least = rooted.groupBy("root").agg(F.min("label").alias("component"))
    per_class = rooted.join(least, "root").select(F.col("c").alias("lc"), "component")
    alone = labels.join(roots.select(F.col("u").alias("c")), "c", "left_anti").select(F.col("c").alias("lc"), F.col("label").alias("component"))
    named = materialize(per_class.union(alone), "minhash-components")
    return signed.join(named, F.col("c") == F.col("lc"), "left").select(
        "doc_id", "text_hash", "n_shingles",
        F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.when(F.col("c").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("component"))).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates; the columns of ``docs``.

    Of rows that repeat id and text one stays.
    """
    doc, digest, rows = unused(docs, "k_doc", "k_hash", "k_rows")
    kept = near_duplicates(docs).where("kept").groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(digest)).agg(F.count(F.lit(1)).alias(rows))
    kept = materialize(kept, "minhash-kept")
    joined = docs.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(doc)) & F.xxhash64("text").eqNullSafe(F.col(digest)))
    if kept.where(F.col(rows) > 1).isEmpty():
        return joined.select(*columns_of(docs))
    again = joined.where(F.col(rows) > 1).dropDuplicates([doc, digest])
    return joined.where(F.col(rows) == 1).union(again).select(*columns_of(docs))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


#: The same components from exact intersections of all sets that share a shingle, without signatures.
OP1_SQL = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + {SHINGLE - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS p FROM worded WHERE len(w) > 0)
), sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM shingles GROUP BY doc_id),
classes AS (SELECT min(doc_id) AS c, any_value(n) AS n, h FROM sets GROUP BY h),
members AS (SELECT s.c, s.n, s.h, t.s FROM classes s JOIN shingles t ON t.doc_id = s.c),
links AS (
  SELECT a.c AS u, b.c AS v FROM members a JOIN members b ON a.s = b.s AND a.c < b.c AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
  GROUP BY a.c, b.c HAVING 100 * count(*) >= {PERCENT} * (any_value(a.n) + any_value(b.n) - count(*))
), edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT c, c AS r FROM classes UNION SELECT e.v, reach.r FROM reach JOIN edges e ON e.u = reach.c),
roots AS (SELECT c, min(r) AS root FROM reach GROUP BY c),
placed AS (SELECT s.doc_id, s.n, root FROM sets s JOIN classes USING (h) JOIN roots USING (c))
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(root, d.doc_id) AS component_id,
  coalesce(root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN placed p USING (doc_id)
"""
