"""Circuits and stateful operators under Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.operators.zset import W
from tidemark.plans.circuit import Circuit


def run(circuit: Circuit, source: str, stream: DataFrame, checkpoint: str, sink: Callable[[Circuit, int], None] | None = None, once: bool = True) -> StreamingQuery:
    """Feed a stream of changes to a circuit, a micro-batch per epoch.

    ``sink(circuit, epoch)`` sees each epoch after it is committed. A batch that Spark
    replays after a failure is skipped if its epoch is committed already.
    """
    node = circuit.sources[source]

    def batch(change: DataFrame, at: int) -> None:
        if at > circuit.done.get(node.id, -1):
            held = change.persist()
            try:
                circuit.push(source, held)
            finally:
                held.unpersist()
        if sink is not None:
            sink(circuit, at)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class _Records(StatefulProcessor):
    """Per group the net weight of every value; emits how the group's aggregate changes."""

    def __init__(self, kind: str, aggregate: str):
        self.kind, self.aggregate = kind, aggregate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.weights = handle.getMapState("weights", f"v {self.kind}", "w long")

    def _result(self) -> object | None:
        """The aggregate of the records held; None for a group without records."""
        if not self.weights.exists():
            return None
        best, total, some = None, 0, False
        for (v,), (w,) in self.weights.iterator():
            some = True
            if self.aggregate == "count":
                total += w
            elif self.aggregate == "sum":
                total += v * w
            elif w > 0 and (best is None or (v > best if self.aggregate == "max" else v < best)):
                best = v
        return (total if self.aggregate in ("sum", "count") else best) if some else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self._result()
        for frame in rows:
            for v, w in zip(frame["value"].tolist(), frame["weight"].tolist(), strict=True):
                held = self.weights.getValue((v,))[0] if self.weights.containsKey((v,)) else 0
                if held + w:
                    self.weights.updateValue((v,), (held + w,))
                elif held:
                    self.weights.removeKey((v,))
        after = self._result()
        if before != after:
            out = [(key[0], before, -1)] if before is not None else []
            out += [(key[0], after, 1)] if after is not None else []
            yield pd.DataFrame(out, columns=["key", "value", W])

    def close(self) -> None:
        pass


def stateful_group_by(stream: DataFrame, key: str, value: str, aggregate: str = "max") -> DataFrame:
    """Changes ``key, value, _w`` of a per-key aggregate (max, min, sum, count) of a stream of
    weighted rows, with retractions; state lives in RocksDB."""
    if aggregate not in ("max", "min", "sum", "count"):
        raise ValueError(f"no such aggregate: {aggregate}")
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, value)}
    out = "bigint" if aggregate == "count" else kinds[value]
    return (
        stream.select(F.col(key).alias("key"), F.col(value).alias("value"), F.col(W).alias("weight"))
        .groupBy("key")
        .transformWithStateInPandas(_Records(kinds[value], aggregate), outputStructType=f"key {kinds[key]}, value {out}, {W} bigint", outputMode="Update", timeMode="None")
    )


def windowed(stream: DataFrame, time: str, length: str, slide: str | None = None, late: str = "0 seconds", keys: list[str] | None = None) -> DataFrame:
    """Weights per tumbling (or sliding) event-time window and keys; rows later than ``late`` are left out."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    grouped = stream.withWatermark(time, late).groupBy(window, *(keys or []))
    return grouped.agg(F.sum(W).alias(W)).select(F.col("window.start").alias("start"), *(keys or []), W)


def sessions(stream: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Weights per session of a key: rows less than ``gap`` apart."""
    grouped = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys)
    return grouped.agg(F.sum(W).alias(W)).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, W)
