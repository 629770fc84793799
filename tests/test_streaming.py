from pyspark.sql import functions as F

from tidemark.functions import aggregates as agg
from tidemark.operators import zset as z
from tidemark.plans.circuit import Circuit
from tidemark.streaming import runner

KV = "k string, v long"


def files(spark, at, batches):
    for rows in batches:
        z.from_rows(spark, rows, KV).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(z.from_rows(spark, {}, KV).schema).option("maxFilesPerTrigger", 1).parquet(at)


def test_circuit_on_a_stream(spark, tmp_path):
    c = Circuit(spark)
    c.source("s", KV).group_by(["k"], agg.greatest("v", "m")).view("out")
    stream = files(spark, f"file://{tmp_path}/in", [{("a", 10): 1}, {("a", 20): 1}, {("a", 20): -1, ("b", 1): 1}])
    seen = []
    runner.run(c, "s", stream, f"file://{tmp_path}/cp", lambda c, e: seen.append((e, z.to_rows(c.delta("out", e))))).awaitTermination()
    assert [x for _, x in seen] == [{("a", 10): 1}, {("a", 10): -1, ("a", 20): 1}, {("a", 20): -1, ("a", 10): 1, ("b", 1): 1}]
    assert z.to_rows(c.snapshot("out")) == {("a", 10): 1, ("b", 1): 1}


def test_stateful_group_by(spark, tmp_path):
    stream = files(spark, f"file://{tmp_path}/in", [{("a", 10): 1}, {("a", 20): 1}, {("a", 20): -1}])
    q = runner.stateful_group_by(stream, "k", "v", "max").writeStream.format("memory").queryName("maxima").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.key, r.value, r._w) for r in spark.table("maxima").collect()]
    assert sorted(got) == sorted([("a", 10, 1), ("a", 10, -1), ("a", 20, 1), ("a", 20, -1), ("a", 10, 1)])


def test_windows_and_sessions(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:01:00", 1), ("a", "2024-01-01 00:03:00", 2), ("a", "2024-01-01 00:30:00", 1)], "k string, t string, _w long").withColumn("t", F.to_timestamp("t"))
    assert sorted(r._w for r in runner.windowed(rows, "t", "10 minutes", keys=["k"]).collect()) == [1, 3]
    assert sorted(r._w for r in runner.sessions(rows, "t", "5 minutes", "0 seconds", ["k"]).collect()) == [1, 3]
