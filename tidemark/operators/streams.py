"""Operators over whole streams: Z-sets stamped with ``_epoch`` (and ``_iter``).

A stream is one DataFrame with a value per epoch. These forms recompute a recorded stream
in one plan; :mod:`tidemark.plans.circuit` maintains values epoch by epoch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.zset import EPOCH, ITER, RESERVED, W


def _stamped(z: DataFrame) -> list[str]:
    return [c for c in z.columns if c not in RESERVED]


def settle(s: DataFrame, axes: tuple[str, ...] = (EPOCH,)) -> DataFrame:
    """Consolidate each cell of a stream."""
    names = [*_stamped(s), *(a for a in (EPOCH, ITER) if a in s.columns)]
    return s.groupBy(*names).agg(F.sum(W).alias(W)).where(F.col(W) != 0)


def delay(s: DataFrame, axis: str = EPOCH) -> DataFrame:
    """Every value one moment later; zero at the first."""
    return s.withColumn(axis, F.col(axis) + 1)


def integrate(s: DataFrame, last: int, axis: str = EPOCH) -> DataFrame:
    """Running sums up to moment ``last``: a row per moment while its weight is not zero.

    A row's sum holds until its next change, so each change is stretched over the moments
    up to the next one of the same payload; only that payload's changes meet.
    """
    cells = settle(s)
    by = [c for c in cells.columns if c not in (W, axis)]
    order = Window.partitionBy(*by).orderBy(axis)
    running = cells.withColumn("_sum", F.sum(W).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    until = F.coalesce(F.lead(axis).over(order) - 1, F.lit(last))
    held = running.withColumn("_until", until).where((F.col("_sum") != 0) & (F.col(axis) <= F.col("_until")))
    return held.select(*by, F.explode(F.sequence(F.col(axis).cast("long"), F.col("_until").cast("long"))).alias(axis), F.col("_sum").alias(W))


def differentiate(s: DataFrame, last: int | None = None, axis: str = EPOCH) -> DataFrame:
    """Each value less the one before; the inverse of :func:`integrate`."""
    out = s.unionByName(delay(s, axis).withColumn(W, -F.col(W)))
    return settle(out if last is None else out.where(F.col(axis) <= last))


def introduce(z: DataFrame, axis: str = ITER) -> DataFrame:
    """A value at moment 0 of a new axis, zero after it."""
    return z.withColumn(axis, F.lit(0).cast("long"))


def eliminate(s: DataFrame, axis: str = ITER) -> DataFrame:
    """The sum over all moments of an axis."""
    left = s.drop(axis)
    names = [c for c in left.columns if c != W]
    return left.groupBy(*names).agg(F.sum(W).alias(W)).where(F.col(W) != 0)


def lift(s: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A linear operator on every cell at once."""
    return operator(s)


def fold(values: DataFrame, by: list[str], value: str, op: Callable[[Column], Column] = F.max, axis: str = EPOCH) -> DataFrame:
    """A running aggregate (``F.max``, ``F.min``, ``F.sum`` ...) of a value per moment."""
    order = Window.partitionBy(*by).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    return values.withColumn(value, op(F.col(value)).over(order))
