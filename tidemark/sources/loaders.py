"""Sources and sinks of weighted relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.zset import EPOCH, W, weighted


def integers(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Lines of integers parted by white space; further columns are left, repeated lines count once."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.trim("value") != "")
    return weighted(lines.select(*(F.get(parts, i).cast("long").alias(n) for i, n in enumerate(names))).distinct())


def edges(spark: SparkSession, path: str) -> DataFrame:
    """``src dst [label]`` per line."""
    return integers(spark, path, ["src", "dst"])


def triples(spark: SparkSession, path: str) -> DataFrame:
    """``s p o`` per line."""
    return integers(spark, path, ["s", "p", "o"])


def parquet(spark: SparkSession, path: str, weight: Column | int = 1) -> DataFrame:
    return weighted(spark.read.parquet(path), weight)


def parquet_stream(spark: SparkSession, path: str, schema: StructType, weight: Column | int = 1) -> DataFrame:
    """A folder to which files are added, as a stream of changes."""
    return weighted(spark.readStream.schema(schema).parquet(path), weight)


def in_epochs(z: DataFrame, epoch: Column) -> DataFrame:
    """Stamp rows with the epoch in which they arrive."""
    return z.withColumn(EPOCH, epoch.cast("int"))


def epoch(z: DataFrame, at: int) -> DataFrame:
    return z.where(F.col(EPOCH) == at).drop(EPOCH)


def write_changelog(change: DataFrame, path: str, at: int) -> None:
    """Write an epoch's changes; writing it again replaces it."""
    change.write.mode("overwrite").parquet(f"{path}/{EPOCH}={at}")


def read_changelog(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    log = spark.read.parquet(path)
    return log if upto is None else log.where(F.col(EPOCH) <= upto)


def changelog_state(log: DataFrame) -> DataFrame:
    """What the changes of a log add up to."""
    names = [c for c in log.columns if c not in (W, EPOCH)]
    return log.groupBy(*names).agg(F.sum(W).alias(W)).where(F.col(W) != 0)
