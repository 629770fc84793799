"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source (a partial sum per task, so a hot source is no hot task), the
sources' targets follow from a water-filling step over the small table of sources, and
each document is emitted ``floor(rate)`` times plus once more with the remaining
probability, drawn from a hash of the seed and its id. Reruns therefore agree.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; rows that repeat an id draw alike; an empty table gives an empty mix; columns of any
name are carried along by :func:`mix`, while :func:`plan_mix` replaces those of ``PLANNED``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import columns_of, n_words, table, unused
from tidemark.session import materialize

WEIGHTS = (1, 2, 3)
REPEAT_CAP = 3
SEED = 20


def source_targets(docs: DataFrame, size: Column, weights=WEIGHTS, cap: int = REPEAT_CAP) -> DataFrame:
    """Per source: ``mix_source, mix_source_size, mix_target``.

    Sources in code point order (null last) get ``weights`` in turn. All sources together
    share the total size by weight; a target stops at ``cap`` times its source's size and
    the excess goes to the others by weight. With sources ordered by capacity per weight
    the level they fill to is the largest of ``(total - capacity before) / weight left``.
    """
    rank = Window.orderBy(F.col("mix_source").asc_nulls_last())
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    return (
        docs.select(F.col("source").alias("mix_source"), size.alias("mix_size"))
        .groupBy("mix_source")
        .agg(F.sum("mix_size").alias("mix_source_size"))
        .withColumn("rank", F.row_number().over(rank))
        .withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("long"))
        .withColumn("cap", F.col("mix_source_size") * cap)
        .withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_used", F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("level", (F.sum("mix_source_size").over(whole) - F.col("used")).cast("double") / (F.sum("w").over(whole) - F.col("w_used")).cast("double"))
        .withColumn("top", F.max("level").over(whole))
        .select("mix_source", "mix_source_size", F.least(F.col("cap").cast("double"), F.col("top") * F.col("w")).alias("mix_target"))
    )


def draw(seed: int, key: Column) -> Column:
    """A number in [0, 1) from a hash of the seed and the key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


#: What is planned for a document: its size, its source's size and target, how often it is taken.
PLANNED = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def _planned(docs: DataFrame, weights, cap: int, seed: int) -> tuple[DataFrame, list[str]]:
    """``docs`` with the columns of ``PLANNED`` under names that ``docs`` does not have.

    The table of sources is written out first: then the join with it is a broadcast only if
    its real size is below Spark's threshold, else a shuffled join that splits hot sources.
    """
    targets = materialize(source_targets(docs, n_words(F.col("text")), weights, cap), "mix-targets")
    source, size, held, target, rate, copies = unused(docs, "mix_source", "mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies")
    share = F.when(F.col(held) > 0, F.col(target) / F.col(held)).otherwise(F.lit(0.0))
    found = (
        docs.withColumn(size, n_words(F.col("text")))
        .join(targets.toDF(source, held, target), F.col("source").eqNullSafe(F.col(source)))
        .withColumn(rate, share)
        .withColumn(copies, (F.floor(rate) + (draw(seed, F.col("doc_id")) < F.col(rate) - F.floor(rate)).cast("long")).cast("long"))
    )
    return found, [size, held, target, copies]


def plan_mix(docs: DataFrame, weights=WEIGHTS, cap: int = REPEAT_CAP, seed: int = SEED) -> DataFrame:
    """``docs`` with ``mix_size, mix_source_size, mix_target, mix_copies``, in place of its columns of these names."""
    found, names = _planned(docs, weights, cap, seed)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in PLANNED]
    return found.select(*kept, *(F.col(n).alias(p) for n, p in zip(names, PLANNED, strict=True)))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = REPEAT_CAP, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every document as many times as it is taken, with the columns of ``docs``."""
    found, names = _planned(docs, weights, cap, seed)
    copies = F.col(names[-1])
    copy = unused(found, "mix_copy")[0]
    repeated = found.where(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), copies)))
    return repeated.select(*columns_of(docs))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return plan_mix(docs).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM d GROUP BY source
), w AS (SELECT *, (rank - 1) % 3 + 1 AS w, source_size * {REPEAT_CAP} AS cap FROM s),
l AS (
  SELECT *,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE)
      / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level
  FROM w WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT max(level) FROM l) * w) AS target FROM l
), r AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
