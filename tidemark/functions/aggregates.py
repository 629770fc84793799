"""Weight-aware aggregates over consolidated Z-sets.

An aggregate is computed per group from ``(record, weight)`` rows. A group exists if some
record has a nonzero weight, whatever the sign of the sum.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.zset import W


@dataclass(frozen=True)
class Agg:
    """A named aggregate as a Column over the rows of a group.

    ``sums`` are the values it is computed from by weighted sums alone, if there is nothing else to it.
    """

    name: str
    column: Column
    sums: tuple[Column, ...] | None = None


def _present(value: Column) -> Column:
    return F.when(F.col(W) > 0, value)


def total(value: Column | str, name: str) -> Agg:
    """Sum of value times weight."""
    v = F.col(value) if isinstance(value, str) else value
    return Agg(name, F.sum(v * F.col(W)), (v,))


def count(name: str) -> Agg:
    """Sum of weights."""
    return Agg(name, F.sum(W), ())


def greatest(value: Column | str, name: str) -> Agg:
    """Largest value of positive weight, null if there is none."""
    return Agg(name, F.max(_present(F.col(value) if isinstance(value, str) else value)))


def least(value: Column | str, name: str) -> Agg:
    return Agg(name, F.min(_present(F.col(value) if isinstance(value, str) else value)))


def mean(value: Column | str, name: str) -> Agg:
    """Weighted mean of the non-null values; null if their weights add up to zero."""
    v = F.col(value) if isinstance(value, str) else value
    weight = F.sum(F.when(v.isNotNull(), F.col(W)))
    return Agg(name, F.when(weight != 0, F.sum(v * F.col(W)) / weight), (v,))


def count_distinct(value: Column | str, name: str) -> Agg:
    """Number of different values among records of positive weight."""
    return Agg(name, F.count_distinct(_present(F.col(value) if isinstance(value, str) else value)))


def top(value: Column | str, k: int, name: str) -> Agg:
    """The ``k`` largest values of positive weight, copies included, largest first.

    A record gives at most ``k`` copies; the list of a group is merged down by Spark's
    ``collect_list``, so use it for groups of moderate size.
    """
    v = F.col(value) if isinstance(value, str) else value
    copies = F.when((F.col(W) > 0) & v.isNotNull(), F.array_repeat(v, F.least(F.col(W), F.lit(k)).cast("int")))
    return Agg(name, F.slice(F.sort_array(F.flatten(F.collect_list(copies)), asc=False), 1, k))


def aggregate(z: DataFrame, keys: Sequence[str], aggs: Sequence[Agg]) -> DataFrame:
    """A row of weight 1 per group; no row for an empty relation, even without keys."""
    out = z.groupBy(*keys).agg(*(a.column.alias(a.name) for a in aggs), F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 0)
    return out.drop("_rows").withColumn(W, F.lit(1).cast("long"))


def aggregate_pandas(z: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], object], name: str, kind: str, hidden: Sequence[str] = ()) -> DataFrame:
    """Any aggregate of a group's rows (with their ``_w``), one group in memory at a time.

    Rows are sorted by key and cross to Python in large batches, which are cut into groups
    there. A group's whole numbers are floats only if the group itself has nulls among them.
    Columns in ``hidden`` are part of the key and not shown to ``fn``.
    """
    fields = ", ".join([*(f"`{k}` {z.schema[k].dataType.simpleString()}" for k in keys), f"`{name}` {kind}", f"{W} bigint"])
    if not keys:
        whole = lambda rows: pd.DataFrame([(fn(rows), 1)], columns=[name, W])
        return z.groupBy().applyInPandas(whole, fields)
    whole_numbers = [f.name for f in z.schema if isinstance(f.dataType, (T.IntegralType, T.BooleanType))]
    at = {c: n for n, c in enumerate(whole_numbers)}
    order = [F.col(f"`{k}`") for k in keys]
    # Pandas turns a column of whole numbers with a null into floats: nulls travel beside them
    nulls = F.array(*(F.col(f"`{c}`").isNull() for c in whole_numbers)).alias("_nulls") if whole_numbers else F.lit(None).cast("array<boolean>").alias("_nulls")
    odd = functools.reduce(Column.__or__, (F.col(f"`{c}`").isNull() for c in whole_numbers), F.lit(False))
    full = [F.coalesce(F.col(f"`{c}`"), F.lit(0).cast(z.schema[c].dataType)).alias(c) if c in at else F.col(f"`{c}`") for c in z.columns]
    first = (F.row_number().over(Window.partitionBy(*order).orderBy(*order)) == 1).alias("_first")
    rows = z.select("*", first).select(*full, "_first", F.when(odd, nulls).alias("_nulls"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def value(parts: list[tuple[pd.DataFrame, list, pd.Series | None]]) -> tuple:
            own, key, missing = parts[0]
            if len(parts) > 1:
                own = pd.concat([p[0] for p in parts])
                missing = pd.concat([pd.Series([None] * len(p[0]), dtype=object) if p[2] is None else p[2] for p in parts])
            own = own.reset_index(drop=True)
            if missing is not None and missing.notna().any():
                for c, n in at.items():
                    gone = np.array([m is not None and m[n] for m in missing])
                    if gone.any() and c in own:
                        flag = own[c].dtype == bool
                        own[c] = own[c].astype(object if flag else float).where(~gone, None if flag else np.nan)
                    if c in keys and gone[0]:
                        key[keys.index(c)] = None
            return (*key, fn(own), 1)

        def shown(found: list[tuple]) -> pd.DataFrame:
            columns = zip(*found, strict=True)
            return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip([*keys, name, W], columns, strict=True)})

        waiting: list[tuple] = []
        for batch in batches:
            starts = np.flatnonzero(batch.pop("_first").to_numpy())
            missing = batch.pop("_nulls")
            missing = missing if missing.notna().any() else None
            marks = [batch[k].array for k in keys]
            batch = batch.drop(columns=list(hidden))
            cut = lambda a, b: (batch.iloc[a:b], [m[a] for m in marks], None if missing is None else missing.iloc[a:b])  # noqa: E731, B023
            ends = [*starts, len(batch)]
            if ends[0]:
                waiting.append(cut(0, ends[0]))
            found = []
            for a, b in itertools.pairwise(ends):
                if waiting:
                    found.append(value(waiting))
                waiting = [cut(a, b)]
            if found:
                yield shown(found)
        if waiting:
            yield shown([value(waiting)])

    return rows.mapInPandas(run, fields)
