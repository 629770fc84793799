"""Python callables as column expressions, for what built-in functions cannot say.

Both run on Arrow batches; a built-in expression stays in the JVM and is the better choice
wherever there is one.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorised(fn: Callable[..., pd.Series], kind: str, *columns: Column | str) -> Column:
    """A function of whole Pandas series."""
    return F.pandas_udf(fn, kind)(*columns)


def per_row(fn: Callable[..., object], kind: str, *columns: Column | str) -> Column:
    """A function of single values."""

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([fn(*values) for values in zip(*series, strict=True)], dtype=object)

    run.__annotations__ = {"return": pd.Series}
    return F.pandas_udf(run, kind, F.PandasUDFType.SCALAR)(*columns)


def predicate(fn: Callable[..., bool], *columns: Column | str) -> Column:
    """A Python condition on single values."""
    return per_row(fn, "boolean", *columns)
