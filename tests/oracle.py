"""Comparison of a query with its SQL on DuckDB."""

import math
import os

import duckdb


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
        return "null"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 6))
    return str(v)


def _rows(frame, columns):
    return sorted(tuple(map(_plain, r)) for r in frame[columns].itertuples(index=False))


def check(spark, sf_dir, fn, sql):
    got = fn(spark, sf_dir).toPandas()
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    want = con.sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert _rows(got, columns) == _rows(want, columns)
