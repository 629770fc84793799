"""Line dedup with DataFrame functions only: equal lines, and lines one word apart.

Lines are normalised (lower case, white space runs to one space, trimmed) and identified
by two 64-bit hashes. Of equal lines the first occurrence stays, in order of document id
and line number. A line also goes if an earlier line is near it, whether that one stays or
not. Lines are near if at most ``EDITS`` = 1 edits, which insert, delete or replace a word,
lead from one to the other, and if that leaves ``PERCENT`` of the longer one's words: so
"at most one word differs, in lines of four words or more". A changed name, date or number
is one edit, whatever its length.

The edit join cuts a line of n words into ``EDITS + 1`` segments that cover it, its first
n // 2 words and the others. One edit leaves a segment as it is, so the shorter of two near
lines shares one with the longer, at the same end. Every line is indexed under its own
segments and probes with those of lines one word shorter; both are hashes of the words and
of their number at either end. Members of a small bucket are paired. Members of a large one agree in the
segment, and what is left of them is cut in the same way, until buckets are small or at
most one word is left: there all members are near each other, and each meets the earliest
alone. So a bucket costs its members a constant number of comparisons
and log2(n) levels, none is expanded into all pairs, and none is capped. That every level
halves the rest is what one edit buys: with more edits, the rests of a large bucket
overlap, and exact refinement is no longer linear, so ``EDITS`` is fixed.

Pairs are verified on the words that have not matched, by a banded bit-parallel edit distance over words,
within the join, so that pairs that are not near are never rows. Only lines that share a
segment with another are fetched with their text.

Defined results: null texts have no line and nothing removed; blank lines always stay; a
null id sorts first; ids that are no integers sort as text; rows that repeat an id share a
place in the order and each keep their lines; an empty table gives an empty table;
:func:`drop_lines` returns the columns it is given, and drops documents all of whose lines
with a word were removed. Columns of the input may have any name not starting ``_line_``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import table
from tidemark.session import discard, materialize

EDITS = 1
PERCENT = 75
#: Members up to which a bucket's members are paired with each other.
SMALL = 32
_SPACES = r"[\x20\x09-\x0D]+"
_FIRST = -(1 << 63)
#: Words of the longer of two near lines at least.
_LEAST = -(-100 * EDITS // (100 - PERCENT))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether two arrays of more than ``edits`` items are within ``edits`` edits.

    Bit-parallel dynamic programming along the diagonal band of ``2 * edits + 1`` cells:
    bit k of a word stands for row ``column - edits + k``. Vertical differences move one
    bit down per column; the distance is followed down the band's lower edge to the last
    row, then along that row.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1
    long = lambda x: F.lit(x).cast("long")
    no = lambda x: F.bitwise_not(x).bitwiseAND(long(mask))
    right = lambda x: F.shiftrightunsigned(x, 1)
    state = F.struct(long(((1 << edits + 1) - 1) << edits).alias("vp"), long(0).alias("vn"), F.lit(edits).alias("cost"))

    def column(s: Column, j: Column, x: Column, y: Column, m: Column) -> Column:
        item = F.get(y, j - 1)
        same = sum((F.when(F.get(x, j - 1 - edits + k) == item, long(1 << k)).otherwise(long(0)) for k in range(width)), start=long(0))

        def step(pm: Column) -> Column:
            vp, vn = s["vp"], s["vn"]
            d0 = ((pm.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(long(mask))
            return let(d0, lambda d: finish(d, vp, vn))

        def finish(d: Column, vp: Column, vn: Column) -> Column:
            return let(F.struct(vn.bitwiseOR(no(d.bitwiseOR(vp))).alias("hp"), d.bitwiseAND(vp).alias("hn")), lambda h: after(d, h))

        def after(d: Column, h: Column) -> Column:
            row = m - j + edits
            bit = lambda w: F.expr("1L").bitwiseAND(F.call_function("shiftrightunsigned", w, F.greatest(row, F.lit(0)))).cast("int")
            down = F.when(d.bitwiseAND(long(1 << width - 1)) == 0, 1).otherwise(0)
            return F.struct(
                h["hn"].bitwiseOR(no(right(d).bitwiseOR(h["hp"]))).alias("vp"),
                right(d).bitwiseAND(h["hp"]).alias("vn"),
                (s["cost"] + F.when(j <= m - edits, down).otherwise(bit(h["hp"]) - bit(h["hn"]))).alias("cost"),
            )

        return let(same, step)

    def walk(c: Column) -> Column:
        steps = F.sequence(F.lit(1), c["n"])
        return F.when(F.abs(c["m"] - c["n"]) > edits, False).otherwise(F.aggregate(steps, state, lambda s, j: column(s, j, c["x"], c["y"], c["m"]))["cost"] <= edits)

    # arrays and sizes are values of a variable: an expression would be computed at every step
    arrays = F.struct(a.alias("x"), b.alias("y"))
    return let(let(arrays, lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), F.size(c["x"]).alias("m"), F.size(c["y"]).alias("n"))), walk)


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), _SPACES, " "))


def word_count(norm: Column) -> Column:
    """Words of a normalised line."""
    return F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit(""))) + 1


def place(docs: DataFrame) -> Column:
    """A document's place in the order: its id, null first."""
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST))
    return F.coalesce(F.concat(F.lit("1"), F.col("doc_id").cast("string")), F.lit("0"))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """``place, text_hash, line_no, norm, h, g`` for every line with a word."""
    split = docs.select(place(docs).alias("place"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return (
        split.select("place", "text_hash", "line_no", normalised(F.col("line")).alias("norm"))
        .where(F.col("norm") != "")
        .withColumn("h", F.xxhash64("norm"))
        .withColumn("g", F.xxhash64(F.lit(1), "norm"))
    )


def _first(norm: Column, words: Column) -> Column:
    return F.call_function("substring_index", norm, F.lit(" "), words)


def _last(norm: Column, words: Column) -> Column:
    return F.call_function("substring_index", norm, F.lit(" "), -words)


def _key(norm: Column, lo: Column, hi: Column, word: Column | None = None, salt: int = 0) -> Column:
    """Key of the lines that begin with the same ``lo`` words, end with the same ``hi``, and have ``word`` between."""
    return F.xxhash64(F.lit(salt), lo, hi, _first(norm, lo), _last(norm, hi), word if word is not None else F.lit(None).cast("string"))


def segments(lo: Column, hi: Column, n: Column) -> list[tuple[Column, Column]]:
    """What two lines may share besides their first ``lo`` and last ``hi`` words, as words then
    matched at either end, if at least two of the ``n`` words are left.

    The words left are cut into two segments, the shorter half first; a line is indexed by
    either. It also probes with those of a line one word shorter, which differ from its own
    in one case each: the first segment if the number left is even, the last if it is odd.
    """
    left = n - lo - hi
    half = F.floor(left / 2).cast("int")
    even = left % 2 == 0
    third = F.when(even, half - 1).otherwise(half)
    some = lambda x: F.when(third > 0, x)
    return [(lo + half, hi), (lo, hi + left - half), (some(lo + F.when(even, third).otherwise(0)), some(hi + F.when(even, 0).otherwise(third)))]


def _level(rows: DataFrame) -> DataFrame:
    """Bucket entries of ``rows(h, g, at, norm, n, lo, hi)``, of which the first ``lo`` and last ``hi``
    words have matched: the same with the words matched then, ``rest`` between them, ``key, key2, kind``.

    Kinds: 1 an ordinary bucket; 2 lines of which at most one word is left at one place;
    3 and 4 a line of which one word is left, and those with one more before or after it.
    A bucket's key does not depend on the way to it, so no line is twice in one.
    """
    norm, n, lo, hi = (F.col(c) for c in ("norm", "n", "lo", "hi"))
    left = n - lo - hi
    entry = lambda kind, a, b, w=None: F.struct(F.lit(kind).alias("kind"), a.alias("lo"), b.alias("hi"), (F.lit(None).cast("string") if w is None else w).alias("word"))
    word = lambda kind, w: entry(kind, lo, hi, w)
    rest = _last(_first(norm, n - hi), left)
    halves = [entry(1, a, b) for a, b in segments(lo, hi, n)]
    entries = (
        F.when(left == 0, F.array(entry(2, lo, hi)))
        .when(left == 1, F.array(entry(2, lo, hi), word(3, rest)))
        .when(left == 2, F.array(*halves[:2], word(4, _first(rest, F.lit(1))), word(4, _last(rest, F.lit(1)))))
        .otherwise(F.array(*halves))
    )
    kept = [F.col(c) for c in ("h", "g", "at", "norm", "n")]
    split = rows.select(*kept, F.explode(F.array_distinct(entries)).alias("entry")).select(*kept, "entry.*").where(F.col("lo").isNotNull())
    left = n - lo - hi
    # a word between tells the kinds 3 and 4 from 2 and 1, and 2 has fewer words left than 1
    side = F.coalesce("word", F.when(F.col("kind") == 2, F.lit("")))
    return split.select(
        *kept, "lo", "hi", "kind",
        F.when(left > 0, _last(_first(norm, n - hi), left)).otherwise("").alias("rest"),
        _key(norm, lo, hi, side).alias("key"), _key(norm, lo, hi, side, 1).alias("key2"),
    )


@functools.cache
def _near(a: str, b: str) -> Column:
    """Whether two members of a bucket, equal but for their ``rest``, are near.

    Lengths are looked at before words, and only words not matched yet are compared, behind
    a word of no text. Built once, as a thousand calls into the JVM make it.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    possible = (F.abs(n - m) <= EDITS) & (F.greatest(n, m) >= _LEAST) & (F.col(f"{a}.key2") == F.col(f"{b}.key2"))
    words = lambda t: F.split(F.when(F.col(f"{t}.rest") == "", "").otherwise(F.concat(F.lit(" "), f"{t}.rest")), " ")
    return F.when(possible, within_edits(words(a), words(b), EDITS)).otherwise(False)


def later_lines(lines: DataFrame, small: int = SMALL) -> DataFrame:
    """``h, g`` of the lines that an earlier one of ``lines(h, g, at, norm, n)`` is near.

    The lines are distinct, and ``at`` orders them.
    """
    rows = lines.select("h", "g", "at", "norm", "n", F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    found: DataFrame | None = None
    above: DataFrame | None = None
    while True:
        entries = _level(rows)
        if above is not None:  # one bucket is reached by several ways
            entries = materialize(entries.dropDuplicates(["key", "h", "g"]), "line-entries")
            discard(above)
        sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
        held = materialize(entries.join(sizes, "key"), "line-buckets")
        later = F.col("y.at") < F.col("x.at")
        few = held.where((F.col("size") <= small) & (F.col("kind") == 1))
        pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & later & _near("x", "y"))
        alike = held.where(F.col("kind") == 2)
        earliest = alike.groupBy("key").agg(F.min_by(F.struct("at", "rest", "n", "key2"), "at").alias("y")).select("key", "y.*")
        starred = alike.alias("x").join(earliest.alias("y"), (F.col("x.key") == F.col("y.key")) & later & _near("x", "y"))
        # the one line that is a word and that word's place alone, beside those with a word more
        short, longer = held.where(F.col("kind") == 3).alias("y"), held.where(F.col("kind") == 4).alias("x")
        beside = longer.join(short, (F.col("x.key") == F.col("y.key")) & _near("x", "y"))
        sides = beside.select(F.when(later, F.struct("x.h", "x.g")).otherwise(F.struct("y.h", "y.g")).alias("o")).select("o.*")
        near = pairs.select("x.h", "x.g").union(starred.select("x.h", "x.g")).union(sides)
        level = materialize(near.distinct(), "line-near")
        found = level if found is None else found.union(level)
        if above is not None:
            discard(entries)
        above = held
        deeper = held.where((F.col("size") > small) & (F.col("kind") == 1))
        if deeper.isEmpty():
            discard(held)
            return found.distinct()
        rows = deeper.select("h", "g", "at", "norm", "n", "lo", "hi")


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """``h, g`` of the lines that an earlier one is near.

    ``distinct`` has ``h, g, place`` (of the first document), and the segments' keys.
    """
    entries = distinct.select("h", "g", "place", F.explode(F.filter(F.array("k0", "k1", "k2"), lambda k: k.isNotNull())).alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1).select("key")
    wanted = materialize(entries.join(shared, "key").select("h", "g", "place").distinct(), "line-wanted")
    holders = docs.join(wanted.select(F.col("place").alias("_line_wanted")).distinct().hint("shuffle_hash"), place(docs) == F.col("_line_wanted"), "left_semi")
    texts = (
        numbered_lines(holders)
        .join(wanted, ["h", "g", "place"])
        .groupBy("h", "g", "place").agg(F.min("line_no").alias("line_no"), F.first("norm").alias("norm"))
        .select("h", "g", F.struct("place", "line_no", "h", "g").alias("at"), "norm", word_count(F.col("norm")).alias("n"))
    )
    texts = materialize(texts, "line-texts")
    discard(wanted)
    found = later_lines(texts)
    return found


def removed_lines(docs: DataFrame) -> DataFrame:
    """Per document that loses lines: ``place, text_hash`` and ``removed``, the numbers of its lines."""
    lines = numbered_lines(docs).withColumn("n", word_count(F.col("norm")))
    n = F.col("n")
    zero = F.lit(0)
    shared = segments(zero, zero, n)
    keys = [F.when((n >= _LEAST - EDITS) & a.isNotNull(), _key(F.col("norm"), a, b)).alias(f"k{i}") for i, (a, b) in enumerate(shared)]
    # the only pass that normalises and hashes all lines
    keyed = materialize(lines.select("place", "text_hash", "line_no", "h", "g", *keys), "line-keys")
    distinct = keyed.groupBy("h", "g").agg(F.count(F.lit(1)).alias("times"), F.min("place").alias("place"), *(F.max(c).alias(c) for c in ("k0", "k1", "k2")))
    distinct = materialize(distinct, "line-distinct")
    near = near_lines(docs, distinct).withColumn("near", F.lit(True))
    repeated = distinct.where(F.col("times") > 1).select("h", "g", F.col("place").alias("first"))
    gone = materialize(repeated.join(near, ["h", "g"], "full"), "line-gone")
    discard(distinct)

    met = materialize(keyed.select("place", "text_hash", "line_no", "h", "g").join(gone, ["h", "g"]), "line-met")
    discard(keyed, gone)
    own = met.where(F.col("near").isNull() & (F.col("place") == F.col("first")))
    stays = own.groupBy("place", "text_hash", "h", "g").agg(F.min("line_no").alias("line_no"))
    later = met.where(F.col("near").isNotNull() | (F.col("place") != F.col("first"))).select("place", "text_hash", "line_no")
    again = own.join(stays, ["place", "text_hash", "h", "g", "line_no"], "left_anti").select("place", "text_hash", "line_no")
    removed = later.union(again).groupBy("place", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
    removed = materialize(removed, "line-removed")
    discard(met)
    return removed


def _with_removed(docs: DataFrame, columns: list) -> DataFrame:
    """Columns of ``docs`` beside ``_line_removed``, the numbers of the removed lines."""
    removed = removed_lines(docs).toDF("_line_place", "_line_hash", "_line_removed").hint("shuffle_hash")
    keyed = docs.select(*columns, place(docs).alias("_line_place"), F.xxhash64("text").alias("_line_hash"))
    return keyed.join(removed, ["_line_place", "_line_hash"], "left").withColumn("_line_removed", F.coalesce("_line_removed", F.array().cast("array<int>")))


def drop_lines(docs: DataFrame) -> DataFrame:
    """The documents without their removed lines; those left with no word though they had one go."""
    joined = _with_removed(docs, [F.col(f"`{c}`") for c in docs.columns])
    lines = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_line_removed", i))
    text = F.when(F.size("_line_removed") == 0, F.col("text")).otherwise(F.array_join(lines, "\n"))
    kept = joined.withColumn("text", text).where((F.size("_line_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n_lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    found = _with_removed(docs, [F.col("doc_id"), F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines")])
    return found.select("doc_id", "n_lines", F.size("_line_removed").cast("long").alias("n_removed"), F.array_join(F.col("_line_removed").cast("array<string>"), ",").alias("removed_lines"))


#: Near lines by another way: equal but for the word at one place, or equal once a word is taken out.
OP3_SQL = rf"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, n, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM raw
), worded AS (SELECT * FROM lines WHERE norm <> ''),
firsts AS (
  SELECT norm, min(struct_pack(d := doc_id, n := n)) AS o, string_split(norm, ' ') AS w FROM worded GROUP BY norm
), less AS (
  SELECT norm, o, p, array_to_string(list_concat(w[:p - 1], w[p + 1:]), ' ') AS k
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM firsts WHERE len(w) >= {_LEAST})
), replaced AS (SELECT norm FROM (SELECT norm, o, min(o) OVER (PARTITION BY p, md5(k), length(k)) AS least FROM less) WHERE o <> least),
added AS (
  SELECT CASE WHEN f.o < l.o THEN l.norm ELSE f.norm END AS norm FROM less l JOIN firsts f ON f.norm = l.k
), near AS (SELECT norm FROM replaced UNION SELECT norm FROM added),
gone AS (
  SELECT w.doc_id, w.n FROM worded w JOIN firsts f USING (norm) LEFT JOIN near ON near.norm = w.norm
  WHERE near.norm IS NOT NULL OR struct_pack(d := w.doc_id, n := w.n) <> f.o
), g AS (SELECT doc_id, count(*) AS c, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(c, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed_lines
FROM documents d LEFT JOIN g USING (doc_id)
"""
