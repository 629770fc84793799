"""A corpus pipeline from the operators of ``tidemark.llm``.

``STAGES`` lists (name, function) pairs. A function takes (spark, docs, sf_dir) and returns
the documents it keeps, with the columns of ``documents``; the last returns token ids. Each
stage's rows are written as Parquet and are the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import lines, minhash, mixing, pieces, quality
from tidemark.llm.common import table
from tidemark.session import materialize, ship_package


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: rejected documents go; lines above a host's limit go from the others."""
    return _recounted(quality.filter_documents(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of equal and nearly equal lines the first stays; documents left without a word go."""
    return _recounted(lines.drop_lines(docs))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each group of near duplicates stays."""
    return minhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: every document as many times as the mix takes it."""
    return mixing.mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: token ids of every document, and whether they decode to its text."""
    coded = pieces.decode(pieces.encode(docs.select("doc_id", "source", "text")))
    text = F.translate(F.coalesce("text", F.lit("")), pieces.SPACE, " ")
    return coded.select("doc_id", "source", "piece_ids", F.size("piece_ids").cast("long").alias("n_tokens"), (F.col("decoded") == text).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("source_mix", source_mix),
    ("sentencepiece", sentencepiece),
]

#: SQL expresses neither MinHash candidates nor SentencePiece; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
