import pytest
from pyspark.sql import functions as F

from tidemark.operators import streams
from tidemark.operators import zset as z


def ints(spark, rows):
    return z.from_rows(spark, {(k,): w for k, w in rows.items()}, "x long")


def edges(spark, rows):
    return z.from_rows(spark, rows, "src long, dst long")


def plain(found):
    return {k[0] if len(k) == 1 else k: w for k, w in z.to_rows(found).items()}


def test_select_keeps_signs(spark):
    assert plain(z.select(ints(spark, {1: 1, -1: 1, 5: 2, -10: 1}), F.col("x") > 0)) == {1: 1, 5: 2}
    assert plain(z.select(ints(spark, {2: 3, 3: 1, 4: -2}), F.col("x") % 2 == 0)) == {2: 3, 4: -2}


def test_project_adds_colliding_weights(spark):
    found = z.project(ints(spark, {2: 1, 3: 1, 4: 2}), F.floor(F.col("x") / 2).alias("y"))
    assert plain(found) == {1: 2, 2: 2}


def test_group_laws(spark):
    a, b, c = ints(spark, {1: 2, 2: -1}), ints(spark, {2: 1, None: 4}), ints(spark, {1: -2, 7: 1})
    assert all(z.group_laws(a, b, c).values())


def test_null_rows_are_equal(spark):
    assert plain(z.add(ints(spark, {None: 2}), ints(spark, {None: 1}))) == {None: 3}
    assert z.weight_of(ints(spark, {None: 2}), x=None) == 2
    assert z.weight_of(ints(spark, {1: 2}), x=9) == 0


def test_joins_multiply_weights(spark):
    path = edges(spark, {(k, k + 1): 1 for k in range(4)})
    found = z.join(path, path, [("dst", "src")], [F.col("l.src").alias("src"), F.col("r.dst").alias("dst")])
    assert plain(found) == {(0, 2): 1, (1, 3): 1, (2, 4): 1}
    a, b = ints(spark, {1: 2, None: 1}), ints(spark, {1: -3, None: 5})
    assert plain(z.join(a, b, ["x"])) == {1: -6}
    assert plain(z.join(a, b, ["x"], [F.col("l.x").alias("x")], null_safe=True)) == {1: -6, None: 5}
    pairs = z.theta_join(ints(spark, {1: 1, 4: 2}), ints(spark, {2: 3}), F.col("l.x") < F.col("r.x"), [F.col("l.x").alias("a"), F.col("r.x").alias("b")])
    assert plain(pairs) == {(1, 2): 3}
    assert plain(z.cartesian(ints(spark, {1: 2}), ints(spark, {5: 3}), [F.col("l.x").alias("a"), F.col("r.x").alias("b")])) == {(1, 5): 6}


def test_distinct_change(spark):
    path = {(k, k + 1): 1 for k in range(4)}
    state = edges(spark, path)
    assert plain(z.distinct_change(state, edges(spark, path))) == {}
    assert plain(z.distinct_change(state, edges(spark, {(0, 1): -2}))) == {(0, 1): -1}
    assert plain(z.distinct_change(state, edges(spark, {(2, 4): 2}))) == {(2, 4): 1}


def test_set_operations(spark):
    a, b = ints(spark, {1: 2, 2: 1, 3: 1}), ints(spark, {1: 1, 3: -1})
    assert plain(z.union_all(a, b)) == {1: 3, 2: 1}
    assert plain(z.union(a, b)) == {1: 1, 2: 1}
    assert plain(z.intersect(a, b)) == {1: 2, 3: -1}
    assert plain(z.intersect_distinct(a, b)) == {1: 1}
    assert plain(z.difference(a, b)) == {1: 1, 2: 1, 3: 1}
    assert plain(z.except_distinct(a, b)) == {2: 1, 3: 1}
    assert plain(z.intersect_all(a, ints(spark, {1: 5}))) == {1: 2}
    assert plain(z.except_all(a, ints(spark, {1: 1, 2: 4}))) == {1: 1, 3: 1}


def test_words_are_unicode(spark):
    lines = spark.createDataFrame([("Kafka, kafka Straße!", 2)], "line string, _w long")
    assert plain(z.consolidate(z.flat_map(lines, z.words(F.col("line")), "word"))) == {"kafka": 4, "straße": 2}


def test_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="OVERFLOW"):
        z.consolidate(ints(spark, {1: 2**62}).union(ints(spark, {1: 2**62}))).collect()


def stream(spark, rows):
    return spark.createDataFrame([(x, e, w) for (x, e), w in rows.items()], "x long, _epoch int, _w long")


def cells(found):
    return {(r.x, r._epoch): r._w for r in found.collect()}


def test_stream_operators(spark):
    s = stream(spark, {(1, 0): 1, (1, 2): 2, (2, 1): 1, (2, 2): -1})
    assert cells(streams.delay(s)) == {(1, 1): 1, (1, 3): 2, (2, 2): 1, (2, 3): -1}
    total = streams.integrate(s, 3)
    assert cells(total) == {(1, 0): 1, (1, 1): 1, (1, 2): 3, (1, 3): 3, (2, 1): 1}
    assert cells(streams.differentiate(total, 3)) == cells(s)
    assert {r.x: r._w for r in streams.eliminate(s, "_epoch").collect()} == {1: 3}
    assert cells(streams.eliminate(streams.introduce(s))) == cells(s)


def test_index_and_python_functions(spark):
    import pandas as pd

    from tidemark.functions import udf

    a = z.index(ints(spark, {1: 2, 2: 1, 3: -1}), ["x"], 3)
    plan = a.groupBy("x").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plain(z.select(a, udf.predicate(lambda x: x % 2 == 1, "x"))) == {1: 2, 3: -1}

    def double(x: pd.Series) -> pd.Series:
        return x * 2

    assert plain(z.project(a, udf.vectorised(double, "long", "x").alias("y"))) == {2: 2, 4: 1, 6: -1}
