"""How many rows queries move between tasks."""

from pyspark.sql import functions as F
from test_recursion import session

from tidemark.functions import aggregates as agg
from tidemark.operators import zset as z
from tidemark.plans.circuit import Circuit
from tidemark.recursion.fixpoint import reach


def shuffled(spark, run, broadcast=-1):
    """Rows that were shuffled while ``run`` ran, by default as if no table were small enough for a broadcast."""
    sc = spark.sparkContext

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        empty = sc._jvm.java.util.ArrayList()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), empty)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    key = "spark.sql.autoBroadcastJoinThreshold"
    limit, before = spark.conf.get(key), total()
    spark.conf.set(key, broadcast)
    try:
        run()
    finally:
        spark.conf.set(key, limit)
    return total() - before


def test_cycles_are_not_sought_among_open_paths(spark):
    """Of 30^5 open paths through complete layers none comes back; one cycle stands beside them."""
    layers = spark.range(4).alias("l").crossJoin(spark.range(30).alias("a")).crossJoin(spark.range(30).alias("b"))
    edges = layers.select((F.col("l.id") * 30 + F.col("a.id")).alias("c0"), (F.col("l.id") * 30 + 30 + F.col("b.id")).alias("c1"))
    ring = spark.createDataFrame([(1000, 1001), (1001, 1002), (1002, 1003), (1003, 1000)], "c0 long, c1 long")
    rule = (("cycle", ("?W", "?X", "?Y", "?Z")), ("e", ("?W", "?X")), ("e", ("?X", "?Y")), ("e", ("?Y", "?Z")), ("e", ("?Z", "?W")))
    d = session(spark, [rule], {"e": edges.union(ring)}, typed=True)
    assert shuffled(spark, d.saturate) < 300_000
    assert {tuple(r) for r in d.model["cycle"].collect()} == {tuple(1000 + (k + s) % 4 for k in range(4)) for s in range(4)}


def test_pandas_groups_are_cut_from_batches(spark):
    """Groups across batches and with nulls are what applyInPandas gives, without a Python call's stream for each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, 3)
    try:
        big = 2**53 + 1
        rows = z.from_rows(spark, {(None, 1, big): 1, (1, 1, big): 1, (1, 2, None): 1, (1, None, 7): 2, (2, 5, big): 1, **{(3, k, k): 1 for k in range(10)}}, "k long, a long, b long")
        describe = lambda rows: f"{len(rows)} {list(rows.columns)} {rows['b'].dtype} {rows['b'].sum()} {rows['k'].isna().sum()} {sorted(rows.index)}"
        found = agg.aggregate_pandas(rows, ["k"], describe, "seen", "string")
        want = rows.groupBy("k").applyInPandas(lambda key, g: __import__("pandas").DataFrame([(*key, describe(g), 1)], columns=["k", "seen", "_w"]), "k long, seen string, _w long")
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
        assert sorted(found.collect(), key=str) == sorted(want.collect(), key=str)
    finally:
        spark.conf.set(key, 10_000)


def test_sums_do_not_move_rows(spark):
    """Exact sums shuffle groups, not rows; a group whose weights cancel exists while its records differ."""
    circuit = Circuit(spark)
    source = circuit.source("t", "id long, k long, v long")
    source.group_by(["k"], agg.total("v", "total"), agg.count("n")).view("out")
    rows = spark.range(20_000).select("id", (F.col("id") % 5).alias("k"), (F.col("id") % 7).alias("v"))
    circuit.push("t", rows)
    moved = shuffled(spark, lambda: circuit.push("t", z.weighted(rows.where("k = 1 AND id > 6"), -1)), 2**20)
    assert moved < 6_000  # the 3,998 rows of the change are consolidated for the source's sum; its groups' rows before stay
    circuit.push("t", z.from_rows(spark, {(1, 1, 1): -1, (6, 1, 6): -1, (90_000, 8, 3): 1, (90_001, 8, 3): -1}, "id long, k long, v long"))
    found = z.to_rows(circuit.snapshot("out"))
    assert found == {**{(k, sum(i % 7 for i in range(k, 20_000, 5)), 4000): 1 for k in (0, 2, 3, 4)}, (8, 0, 0): 1}


def test_rounds_do_not_move_what_is_known(spark):
    """A chain of 24 edges beside 20,000 single ones: rounds shuffle what they add."""
    edges = spark.range(20_000).select((F.col("id") * 2 + 1000).alias("src"), (F.col("id") * 2 + 1001).alias("dst"))
    edges = edges.union(spark.range(24).select("id", F.col("id") + 1))
    for hops in (False, True):
        out = []
        moved = shuffled(spark, lambda hops=hops, out=out: out.append(reach(edges, hop_by_hop=hops)[0].count()))
        assert out == [20_300] and moved < 150_000


def test_facts_get_buckets_by_their_number(spark, monkeypatch):
    """Tasks do not grow with the facts: their tables have as many buckets as rows need, more as more come."""
    monkeypatch.setattr("tidemark.session.TASK_ROWS", 100)
    rows = spark.range(1500).select(F.col("id").alias("c0"), (F.col("id") + 5000).alias("c1"))
    d = session(spark, [(("n", ("?X",)), ("e", ("?X", "?Y")))], {"e": rows.where("c0 < 500")}, typed=True)
    d.saturate()
    assert len(d.facts["e"].inputFiles()) == len(d.model["n"].inputFiles()) == 5
    d.push_facts({"e": rows.where("c0 >= 500")})
    d.saturate()
    assert len(d.facts["e"].inputFiles()) >= 10 and len(d.model["n"].inputFiles()) >= 10
    assert d.model["n"].count() == 1500
