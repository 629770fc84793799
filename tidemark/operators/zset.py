"""Z-sets: relations whose rows carry a signed weight, as DataFrames.

A Z-set is a DataFrame with a BIGINT column ``_w``; its other columns are the payload. It
is *consolidated* if every payload stands in one row of nonzero weight. Rows are the same
if their payloads are, nulls included. Linear operators leave rows unconsolidated; those
that are not linear consolidate their inputs first.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

W = "_w"
EPOCH = "_epoch"
ITER = "_iter"
RESERVED = (W, EPOCH, ITER)


def payload(z: DataFrame) -> list[str]:
    return [c for c in z.columns if c not in RESERVED]


def weighted(df: DataFrame, weight: Column | int = 1) -> DataFrame:
    """A relation as a Z-set; a bag's copies add up when it is consolidated."""
    return df.withColumn(W, (F.lit(weight) if isinstance(weight, int) else weight).cast("long"))


def from_rows(spark: SparkSession, rows: dict[tuple, int], schema: str) -> DataFrame:
    """A Z-set of literal rows with their weights."""
    kind = T._parse_datatype_string(f"{schema}, {W} long") if schema else T._parse_datatype_string(f"{W} long")
    return spark.createDataFrame([(*r, w) for r, w in rows.items()], kind)


def to_rows(z: DataFrame) -> dict[tuple, int]:
    """A small Z-set as a dict, for tests and reports."""
    names = payload(z)
    return {tuple(r[c] for c in names): r[W] for r in consolidate(z).collect()}


def empty(like: DataFrame) -> DataFrame:
    """The zero of the group, with the columns of ``like``."""
    return like.limit(0)


def consolidate(z: DataFrame) -> DataFrame:
    names = payload(z)
    return z.groupBy(*names).agg(F.sum(W).alias(W)).where(F.col(W) != 0).select(*names, W)


def plus(*parts: DataFrame) -> DataFrame:
    """Sum, not consolidated."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def add(*parts: DataFrame) -> DataFrame:
    return consolidate(plus(*parts))


def negate(z: DataFrame) -> DataFrame:
    return z.withColumn(W, -F.col(W))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, negate(b))


def same_row(a: str, b: str, names: Iterable[str]) -> Column:
    """Null-safe equality of two sides' payloads."""
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return cond


def weight_of(z: DataFrame, **row) -> int:
    """The weight of one row, 0 if it is absent."""
    cond = F.lit(True)
    for name, value in row.items():
        cond = cond & F.col(name).eqNullSafe(F.lit(value))
    return z.where(cond).agg(F.sum(W)).first()[0] or 0


def scalar(z: DataFrame, column: str, default: object = 0) -> DataFrame:
    """One row with the value of a relation of one row at most, ``default`` if it is empty; of several, the least."""
    value = F.min(F.when(F.col(W) > 0, F.col(column)))
    return z.agg(F.coalesce(value, F.lit(default)).alias(column))


def index(z: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows clustered and sorted by key, so that joins and groupings on it need no further shuffle."""
    columns = [F.col(k) for k in keys]
    placed = z.repartition(partitions, *columns) if partitions else z.repartition(*columns)
    return placed.sortWithinPartitions(*columns)


# -- linear operators -------------------------------------------------------------------


def select(z: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet the condition, whatever the sign of their weight."""
    return z.where(condition)


def project(z: DataFrame, *columns: Column | str) -> DataFrame:
    """Mapped rows; weights of rows that become equal add up."""
    return consolidate(z.select(*columns, W))


def flat_map(z: DataFrame, items: Column, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """A row per item of an array column, each with the weight of its row."""
    return z.select(*keep, F.explode(items).alias(name), W)


def words(text: Column) -> Column:
    """Lower-case words, with the word characters of Unicode."""
    return F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda x: x != "")


# -- joins: bilinear, weights multiply --------------------------------------------------


def _product(joined: DataFrame, columns: Sequence[Column | str] | None, left: DataFrame, right: DataFrame) -> DataFrame:
    weight = (F.col(f"l.{W}") * F.col(f"r.{W}")).alias(W)
    if columns is None:
        seen = payload(left)
        columns = [F.col(f"l.{c}") for c in seen] + [F.col(f"r.{c}") for c in payload(right) if c not in seen]
    return joined.select(*columns, weight)


def join(left: DataFrame, right: DataFrame, on: Sequence[str | tuple[str, str]], columns=None, null_safe: bool = False, keep: Column | None = None) -> DataFrame:
    """Equi-join on columns of the same name, or on pairs of names.

    ``columns`` are expressions over the sides ``l`` and ``r``; ``keep`` drops pairs.
    """
    pairs = [(k, k) if isinstance(k, str) else k for k in on]
    cond = None
    for a, b in pairs:
        x, y = F.col(f"l.{a}"), F.col(f"r.{b}")
        one = x.eqNullSafe(y) if null_safe else x == y
        cond = one if cond is None else cond & one
    if keep is not None:
        cond = cond & keep
    return _product(left.alias("l").join(right.alias("r"), cond), columns, left, right)


def theta_join(left: DataFrame, right: DataFrame, condition: Column, columns=None) -> DataFrame:
    """Join on any condition over ``l`` and ``r``. Give equalities in it, and Spark hashes them."""
    return _product(left.alias("l").join(right.alias("r"), condition), columns, left, right)


def cartesian(left: DataFrame, right: DataFrame, columns=None) -> DataFrame:
    return _product(left.alias("l").crossJoin(right.alias("r")), columns, left, right)


def semi(z: DataFrame, keys: DataFrame, names: Sequence[str], how: str = "left_semi") -> DataFrame:
    """Rows of ``z`` whose key is (``left_anti``: is not) among ``keys``, null-safely."""
    if not names:  # all rows share the empty key
        there = keys.limit(1).agg(F.count(F.lit(1)).alias("_n"))
        return z.join(F.broadcast(there), F.col("_n") == (1 if how == "left_semi" else 0)).drop("_n")
    return z.alias("l").join(keys.select(*names).alias("r"), same_row("l", "r", names), how)


# -- thresholds and set operations ------------------------------------------------------


def distinct(z: DataFrame) -> DataFrame:
    """Rows of positive weight, once each."""
    return consolidate(z).where(F.col(W) > 0).withColumn(W, F.lit(1).cast("long"))


def distinct_change(state: DataFrame, change: DataFrame) -> DataFrame:
    """How the distinct rows change when ``change`` is added to ``state`` (both consolidated)."""
    names = payload(change)
    old = F.coalesce(F.col(f"r.{W}"), F.lit(0))
    new = old + F.col(f"l.{W}")
    turn = F.when((old <= 0) & (new > 0), 1).when((old > 0) & (new <= 0), -1).otherwise(0).cast("long")
    joined = change.alias("l").join(state.alias("r"), same_row("l", "r", names), "left")
    return joined.select(*(F.col(f"l.{n}") for n in names), turn.alias(W)).where(F.col(W) != 0)


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of the sum; opposite weights cancel first."""
    return distinct(plus(a, b))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, weights multiplied, so a weight may be negative."""
    names = payload(a)
    return join(consolidate(a), consolidate(b), names, [F.col(f"l.{n}") for n in names], null_safe=True)


def intersect_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """SQL's INTERSECT: distinct rows of both."""
    return intersect(distinct(a), distinct(b))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of the difference: DISTINCT over EXCEPT ALL."""
    return distinct(plus(a, negate(b)))


def except_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """SQL's EXCEPT: distinct rows of ``a`` that ``b`` lacks."""
    return difference(distinct(a), distinct(b))


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """The lesser of two positive weights."""
    names = payload(a)
    x, y = (consolidate(z).where(F.col(W) > 0) for z in (a, b))
    joined = x.alias("l").join(y.alias("r"), same_row("l", "r", names))
    return joined.select(*(F.col(f"l.{n}") for n in names), F.least(F.col(f"l.{W}"), F.col(f"r.{W}")).alias(W))


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """What is left of positive weights."""
    return subtract(a, b).where(F.col(W) > 0)


def group_laws(a: DataFrame, b: DataFrame, c: DataFrame) -> dict[str, bool]:
    """Whether three Z-sets obey the laws of an abelian group."""
    zero = lambda z: consolidate(z).isEmpty()
    same = lambda x, y: zero(plus(x, negate(y)))
    return {
        "commutative": same(plus(a, b), plus(b, a)),
        "associative": same(plus(add(a, b), c), plus(a, add(b, c))),
        "identity": same(plus(a, empty(a)), a),
        "inverse": zero(plus(a, negate(a))),
    }
