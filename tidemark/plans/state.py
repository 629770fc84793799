"""Stores for the running sums that incremental operators keep.

A relation's state is a list of segments, each the consolidated changes of a run of epochs.
An epoch appends one segment; whenever ``merge_after`` segments of about the same number of
epochs stand at the end of what is settled, they become one. So a change is rewritten as
often as the logarithm of the number of epochs, and a sum is read from as many segments.

A manifest names the segments and how far every relation has come. It is written after all
relations of a circuit have their epoch, under a number of its own and by a rename: an epoch
is there as a whole or not at all, and pushing it again after a crash is harmless. Files
that a manifest no longer names are deleted one commit later.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.operators.zset import add, consolidate, plus
from tidemark.session import forget, fresh_path


class Store(Protocol):
    progress: dict[str, int]

    def append(self, node: str, epoch: int, change: DataFrame) -> None: ...
    def change(self, node: str, epoch: int) -> DataFrame | None: ...
    def total(self, node: str, epoch: int) -> DataFrame | None: ...
    def epochs(self, node: str) -> list[int]: ...
    def evict(self, node: str, epoch: int) -> int: ...
    def tidy(self, node: str, epoch: int) -> int: ...
    def commit(self, progress: dict[str, int]) -> None: ...
    def size(self) -> int: ...


@dataclass
class _Segment:
    first: int
    last: int
    path: str
    schema: StructType

    @property
    def span(self) -> int:
        return self.last - self.first + 1


def _known(node: str, segments: list, epoch: int) -> None:
    """Refuse an epoch that lies within a merged segment."""
    if any(s.first <= epoch < s.last for s in segments):
        raise LookupError(f"the sum of {node} at epoch {epoch} is not kept: later changes are merged with it")


@dataclass
class ParquetStore:
    """Segments as Parquet under one folder, which all executors must share."""

    spark: SparkSession
    path: str | None = None
    merge_after: int = 8
    segments: dict[str, list[_Segment]] = field(default_factory=dict)
    progress: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.path = self.path or fresh_path(self.spark, "state")
        self._manifest = -1
        self._dead: tuple[list[str], list[str]] = ([], [])
        self._recover()

    # -- files ----------------------------------------------------------------------

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _name(self, number: int) -> str:
        return f"{self.path}/manifests/{number:012d}.json"

    def commit(self, progress: dict[str, int]) -> None:
        """Make the segments and the epochs reached the state that a restart finds."""
        fs, path = self._fs()
        held = {n: [{"first": s.first, "last": s.last, "path": s.path, "schema": s.schema.json()} for s in ss] for n, ss in self.segments.items()}
        draft, target = path(f"{self.path}/manifests/_{uuid.uuid4().hex}"), path(self._name(self._manifest + 1))
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"progress": progress, "segments": held}).encode()))
        out.close()
        if not fs.rename(draft, target):
            raise OSError(f"cannot commit {target}")
        self._manifest += 1
        self.progress = dict(progress)
        for gone in self._dead[0]:
            forget(self.spark, gone)
        self._dead = (self._dead[1], [])
        if self._manifest > 1:
            forget(self.spark, self._name(self._manifest - 2))

    def _recover(self) -> None:
        fs, path = self._fs()
        folder = path(f"{self.path}/manifests")
        if not fs.exists(folder):
            return
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
        if not numbers:
            return
        self._manifest = max(numbers)
        found = json.loads(self.spark.read.text(self._name(self._manifest), wholetext=True).first()[0])
        self.progress = found["progress"]
        self.segments = {n: [_Segment(x["first"], x["last"], x["path"], StructType.fromJson(json.loads(x["schema"]))) for x in ss] for n, ss in found["segments"].items()}

    def _read(self, segment: _Segment) -> DataFrame:
        return self.spark.read.schema(segment.schema).parquet(segment.path)

    def _write(self, node: str, first: int, last: int, z: DataFrame) -> _Segment:
        at = f"{self.path}/{node}/{first}-{last}-{uuid.uuid4().hex}"
        z.write.parquet(at)
        return _Segment(first, last, at, z.schema)

    # -- Store ----------------------------------------------------------------------

    def append(self, node: str, epoch: int, change: DataFrame) -> None:
        held = self.segments.setdefault(node, [])
        if held and epoch <= held[-1].last:
            raise ValueError(f"epoch {epoch} of {node} is committed and cannot change")
        held.append(self._write(node, epoch, epoch, change))

    def _merge(self, node: str, start: int, end: int) -> int:
        held = self.segments[node]
        old = held[start:end]
        if len(old) < 2:
            return 0
        merged = self._write(node, old[0].first, old[-1].last, consolidate(plus(*map(self._read, old))))
        self.segments[node] = [*held[:start], merged, *held[end:]]
        self._dead[1].extend(s.path for s in old)
        return len(old) - 1

    def evict(self, node: str, epoch: int) -> int:
        """Merge all segments up to an epoch into one; the number of segments saved."""
        return self._merge(node, 0, sum(s.last <= epoch for s in self.segments.get(node, [])))

    def tidy(self, node: str, epoch: int) -> int:
        """Merge the last ``merge_after`` segments up to an epoch while they are of one magnitude."""
        saved = 0
        while True:
            end = sum(s.last <= epoch for s in self.segments.get(node, []))
            tail = self.segments.get(node, [])[max(0, end - self.merge_after) : end]
            if self.merge_after < 2 or len(tail) < self.merge_after or max(s.span for s in tail) >= self.merge_after * min(s.span for s in tail):
                return saved
            saved += self._merge(node, end - self.merge_after, end)

    def change(self, node: str, epoch: int) -> DataFrame | None:
        return next((self._read(s) for s in self.segments.get(node, []) if s.first == s.last == epoch), None)

    def total(self, node: str, epoch: int) -> DataFrame | None:
        """The changes up to an epoch, not consolidated."""
        held = self.segments.get(node, [])
        _known(node, held, epoch)
        parts = [self._read(s) for s in held if s.last <= epoch]
        return plus(*parts) if parts else None

    def epochs(self, node: str) -> list[int]:
        return [s.last for s in self.segments.get(node, [])]

    def size(self) -> int:
        return sum(map(len, self.segments.values()))


@dataclass
class _Plan:
    first: int
    last: int
    rows: DataFrame


class PlanStore:
    """Keeps plans instead of files: for a few epochs within one query, and not beyond it."""

    def __init__(self, *_):
        self.plans: dict[str, list[_Plan]] = {}
        self.progress: dict[str, int] = {}

    def append(self, node: str, epoch: int, change: DataFrame) -> None:
        held = self.plans.setdefault(node, [])
        if held and epoch <= held[-1].last:
            raise ValueError(f"epoch {epoch} of {node} is committed and cannot change")
        held.append(_Plan(epoch, epoch, change))

    def change(self, node: str, epoch: int) -> DataFrame | None:
        return next((p.rows for p in self.plans.get(node, []) if p.first == p.last == epoch), None)

    def total(self, node: str, epoch: int) -> DataFrame | None:
        held = self.plans.get(node, [])
        _known(node, held, epoch)
        parts = [p.rows for p in held if p.last <= epoch]
        return plus(*parts) if parts else None

    def epochs(self, node: str) -> list[int]:
        return [p.last for p in self.plans.get(node, [])]

    def evict(self, node: str, epoch: int) -> int:
        held = self.plans.get(node, [])
        old = [p for p in held if p.last <= epoch]
        if len(old) < 2:
            return 0
        merged = _Plan(old[0].first, old[-1].last, add(*(p.rows for p in old)))
        self.plans[node] = [merged, *held[len(old) :]]
        return len(old) - 1

    def tidy(self, node: str, epoch: int) -> int:
        return 0

    def commit(self, progress: dict[str, int]) -> None:
        self.progress = dict(progress)

    def size(self) -> int:
        return sum(map(len, self.plans.values()))
