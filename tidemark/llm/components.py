"""Connected components of a graph held as a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node passes its least neighbour on to its larger neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``u, root`` for every node of ``links(u, v)`` (64-bit ids), ``root`` the least id of its component.

    A round costs a few shuffles of the links left; the number of rounds grows with the
    logarithm of the longest path. Each round's links are a table in the shared folder.
    """
    edges = materialize(links.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        edges = materialize(_small_star(_large_star(edges)), "links")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select("v").distinct().select(F.col("v").alias("u"), F.col("v").alias("root"))
    return edges.select("u", F.col("v").alias("root")).union(roots)
