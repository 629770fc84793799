"""Semi-naive fixpoints as driver loops over DataFrame plans.

A round joins what the last round added with what is known, drops what is known, and writes
the rest as a table, so plans stay small and lost executors cost one round. Known tuples are
the union of the rounds' tables, so a round writes in proportion to what it adds; the tables
are bucketed, so it shuffles no more than that either.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import zset as z
from tidemark.operators.zset import W
from tidemark.session import bucketed, buckets, discard, materialize, unseen

MAX_ROUNDS = 1024
MAX_PARTS = 12


class NotConverged(RuntimeError):
    pass


def saturate(seed: DataFrame, step: Callable[[DataFrame, list[DataFrame]], DataFrame], max_rounds: int = MAX_ROUNDS, known: Sequence[DataFrame] = (), *, n: int) -> tuple[list[DataFrame], int]:
    """Close pairs ``src, dst`` under ``step(added, parts)``, which derives candidates from the last
    additions and all tables of what was added so far; these tables, without the pairs of the
    tables ``known``, and the number of rounds that added something.

    Tables are in ``n`` buckets by ``src``, so a round shuffles what it adds and not what is known.
    """
    added = bucketed(unseen(seed, known, ["src"], n), ["src"], n, "fixpoint")
    parts: list[DataFrame] = []
    rounds = 0
    while not added.isEmpty():
        if rounds >= max_rounds:
            raise NotConverged(f"no fixpoint in {max_rounds} rounds")
        parts.append(added)
        rounds += 1
        added = bucketed(unseen(step(added, parts).select("src", "dst"), [*known, *parts], ["src"], n), ["src"], n, "fixpoint")
        if len(parts) > MAX_PARTS:
            parts = [bucketed(_all(parts), ["src"], n, "fixpoint")]
    return parts, rounds


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _compose(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.alias("x"), b.alias("y")
    return x.join(y, F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("src"), F.col("y.dst").alias("dst"))


def doubling(added: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Paths that consist of an added one and a known one: the rounds grow with the logarithm of
    the longest path. A round finds all paths of up to twice the length before: the first half of
    such a path is among the last additions, the rest is known.
    """
    return _all([_compose(added, p) for p in parts])


def reach(edges: DataFrame, max_rounds: int = MAX_ROUNDS, hop_by_hop: bool = False) -> tuple[DataFrame, int]:
    """All pairs ``src, dst`` joined by a path of one edge or more, and the rounds taken.

    ``hop_by_hop`` extends paths by one edge a round: as many rounds as the longest of the
    shortest paths has edges, with fewer candidates each.
    """
    pairs = materialize(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"), "edges")
    n = buckets(pairs)
    if not hop_by_hop:
        parts, rounds = saturate(pairs, doubling, max_rounds, n=n)
    else:
        fixed = bucketed(unseen(pairs, [], ["src"], n), ["src"], n, "edges")
        parts, rounds = saturate(fixed, lambda added, _: _compose(added, fixed), max_rounds, n=n)
    discard(pairs)
    return (_all(parts) if parts else edges.select("src", "dst").limit(0)), rounds


def edge_set(edges: DataFrame) -> DataFrame:
    """Weighted edges as a set: those of positive weight."""
    return z.distinct(edges).drop(W)


class Reachability:
    """Reachable pairs, kept up to date under insertions and deletions of weighted edges.

    An insertion closes the paths that hold one new edge, with known paths before and behind it:
    all new paths consist of such. Joins with what is known are made once. A deletion may
    take support from any path, cycles included, so pairs are then recomputed. Either way a
    step returns the change as a Z-set.
    """

    def __init__(self, like: DataFrame):
        self.edges = like.select("src", "dst", W).limit(0)
        self.pairs: DataFrame | None = None
        self.parts: list[DataFrame] = []
        self.rounds = self.buckets = 0

    def push(self, change: DataFrame) -> DataFrame:
        new = materialize(change.select("src", "dst", W), "edges")
        n = max(buckets(new), self.buckets)
        old_edges = self.edges if n == self.buckets else bucketed(self.edges, ["src"], n, "edges")
        weights = old_edges.withColumn("_old", F.col(W)).unionByName(new.repartition(n, "src").withColumn("_old", F.lit(0).cast("long")))
        weights = weights.groupBy("src", "dst").agg(F.sum("_old").alias("_old"), F.sum(W).alias(W))
        turn = F.when((F.col("_old") <= 0) & (F.col(W) > 0), 1).when((F.col("_old") > 0) & (F.col(W) <= 0), -1).otherwise(0)
        both = bucketed(weights.withColumn("_turn", turn), ["src"], n, "edges")
        self.edges = both.where(F.col(W) != 0).select("src", "dst", W)
        if n != self.buckets and self.parts:
            self.parts = [bucketed(_all(self.parts), ["src"], n, "pairs")]
        self.buckets, before = n, self.parts
        discard(new)
        signed = lambda parts, w: [p.select("src", "dst", F.lit(w).cast("long").alias(W)) for p in parts]
        ends = F.col("src").isNotNull() & F.col("dst").isNotNull()
        if self.pairs is None or not both.where("_turn < 0").isEmpty():
            now, self.rounds = saturate(both.where(ends & (F.col(W) > 0)).select("src", "dst"), doubling, n=n)
            self.parts, change = now, signed(now, 1) + signed(before, -1)
        else:
            fresh = both.where(ends & (F.col("_turn") > 0)).select("src", "dst")
            on = materialize(_all([fresh, *(_compose(fresh, p) for p in before)]), "fixpoint")  # a new edge, and a known path behind it
            first = _all([on, *(_compose(p, on) for p in before)])
            more, self.rounds = saturate(first, doubling, known=before, n=n)
            discard(on)
            self.parts, change = [*before, *more], signed(more, 1)
            if len(self.parts) > MAX_PARTS:
                self.parts = [bucketed(_all(self.parts), ["src"], n, "pairs")]
        empty = both.select("src", "dst").limit(0)
        self.pairs = _all(self.parts) if self.parts else empty
        return z.consolidate(_all(change)) if change else z.weighted(empty)
