"""Circuits of relational operators, maintained epoch by epoch.

A circuit is a graph of nodes over Z-sets. Pushing a change to a source starts an epoch of
that source; a node computes its change of an epoch once all its inputs have theirs, from
the inputs' changes and their sums so far. The sum of a node's changes always equals the
batch query on the sums of the sources:

* linear nodes map the change alone and keep nothing;
* joins emit ``A_new >< dB + dA >< B_old``;
* distinct compares the touched rows' weights before and after;
* group-by recomputes the touched groups before and after; exact sums add up without consolidating rows.

Only sums that a node needs are kept, as appended segments. Joins read them as they are;
distinct and group-by first cut them to the touched keys, by semi-joins that Spark
broadcasts while the change is small, and consolidate what is left: the rest of the state
is not shuffled. An empty push is a heartbeat: views over several sources are read at the
epoch that all of them have reached. Changes that a slower reader is yet to see are kept
apart from the sums.

A push commits all relations at once. A circuit that is built again on the same store goes
on from the last commit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType, StructType

from tidemark import progress
from tidemark.functions.aggregates import Agg, aggregate, aggregate_pandas
from tidemark.operators import zset as z
from tidemark.operators.zset import W
from tidemark.plans.state import ParquetStore, Store
from tidemark.session import materialize


@dataclass(eq=False)
class Node:
    """A relation of a circuit; its methods add the operators that read it."""

    circuit: Circuit
    id: int
    kind: str
    inputs: tuple[Node, ...]
    rule: Callable
    label: str = ""
    sources: frozenset[int] = frozenset()
    distinct: bool = False
    detail: dict = field(default_factory=dict)

    # -- linear ---------------------------------------------------------------------

    def where(self, condition: Column) -> Node:
        return self.circuit._add("where", (self,), _linear(lambda d: d.where(condition)), distinct=self.distinct, op=lambda d: d.where(condition))

    def select(self, *columns: Column | str) -> Node:
        op = lambda d: d.select(*columns, W)
        return self.circuit._add("select", (self,), _linear(op), op=op)

    def flat_map(self, items: Column, name: str, keep: Sequence[str] = ()) -> Node:
        op = lambda d: z.flat_map(d, items, name, keep)
        return self.circuit._add("flat_map", (self,), _linear(op), op=op)

    def negate(self) -> Node:
        return self.circuit._add("negate", (self,), _linear(z.negate), op=z.negate)

    def apply(self, fn: Callable[[DataFrame], DataFrame], linear: bool = False) -> Node:
        """Any function of a Z-set. Unless it is linear it runs on the whole sum, old and new."""
        return self.circuit._add("apply", (self,), _linear(fn) if linear else _whole(fn), op=fn)

    def plus(self, *others: Node) -> Node:
        return self.circuit._add("plus", (self, *others), _linear(z.plus), op=z.plus)

    def minus(self, other: Node) -> Node:
        return self.plus(other.negate())

    def combine(self, fn: Callable[..., DataFrame], *others: Node) -> Node:
        """Any function of several Z-sets, run on their whole sums, old and new."""
        return self.circuit._add("combine", (self, *others), _whole(fn), op=fn)

    def operator(self, rule: Callable[[Epoch], DataFrame], *others: Node, op: Callable[..., DataFrame] | None = None) -> Node:
        """An operator of one's own: ``rule`` gives its change of an epoch from the inputs' changes
        and their sums before and after (:class:`Epoch`). ``op`` is its batch form, if it has one.
        """

        def run(at: Epoch) -> DataFrame:
            return rule(at)

        run.reads_sums = True
        return self.circuit._add("operator", (self, *others), run, **({} if op is None else {"op": op}))

    # -- bilinear -------------------------------------------------------------------

    def join(self, other: Node, on: Sequence[str | tuple[str, str]], columns=None, null_safe: bool = False, keep: Column | None = None) -> Node:
        op = lambda a, b: z.join(a, b, on, columns, null_safe, keep)
        return self.circuit._add("join", (self, other), _bilinear(op), op=op)

    def theta_join(self, other: Node, condition: Column, columns=None) -> Node:
        op = lambda a, b: z.theta_join(a, b, condition, columns)
        return self.circuit._add("theta_join", (self, other), _bilinear(op), op=op)

    def cartesian(self, other: Node, columns=None) -> Node:
        op = lambda a, b: z.cartesian(a, b, columns)
        return self.circuit._add("cartesian", (self, other), _bilinear(op), op=op)

    def intersect(self, other: Node) -> Node:
        """Weights of common rows multiplied."""
        names = self.detail.get("names")

        def op(a: DataFrame, b: DataFrame) -> DataFrame:
            found = names or z.payload(a)
            return z.join(a, b, found, [F.col(f"l.{n}") for n in found], null_safe=True)

        return self.circuit._add("intersect", (self, other), _bilinear(op), op=op)

    # -- not linear -----------------------------------------------------------------

    def unique(self) -> Node:
        """Distinct rows of positive weight. A node that is distinct already (filters keep that) is its own."""
        if self.distinct:
            return self
        return self.circuit._add("unique", (self,), _distinct, distinct=True, op=z.distinct)

    def union(self, other: Node) -> Node:
        """Distinct rows of the sum; inner distincts of either side stay, as weights may be negative."""
        return self.plus(other).unique()

    def difference(self, other: Node) -> Node:
        return self.minus(other).unique()

    def group_by(self, keys: Sequence[str], *aggs: Agg) -> Node:
        fn = lambda d, by: aggregate(d, by, aggs)
        return self.circuit._add("group_by", (self,), _grouped(keys, fn, aggs), op=lambda d: fn(z.consolidate(d), keys))

    def group_by_pandas(self, keys: Sequence[str], fn: Callable, name: str, kind: str) -> Node:
        run = lambda d, by: aggregate_pandas(d, by, fn, name, kind, [k for k in by if k == _SIDE])
        return self.circuit._add("group_by", (self,), _grouped(keys, run), op=lambda d: run(z.consolidate(d), keys))

    # -- time -----------------------------------------------------------------------

    def delay(self) -> Node:
        """The change of the epoch before."""

        def rule(at: Epoch) -> DataFrame:
            return at.change(0, at.epoch - 1)

        return self.circuit._add("delay", (self,), rule, back=1)

    def integrate(self) -> Node:
        """The running sum as the value of each epoch."""
        return self.circuit._add("integrate", (self,), lambda at: z.consolidate(at.new(0)), keeps=True)

    def differentiate(self) -> Node:
        """The value of each epoch less that of the epoch before."""
        return self.circuit._add("differentiate", (self,), lambda at: z.add(at.change(0), z.negate(at.change(0, at.epoch - 1))), back=1)

    def view(self, name: str) -> Node:
        """Name the relation; its sum is kept and can be read at any kept epoch."""
        self.label = name
        self.circuit.views[name] = self
        return self


@dataclass
class Epoch:
    """What a rule may read: inputs' changes, and their sums before and after the epoch.

    The sums are not consolidated: a payload may stand in several rows, and their weights add up.
    """

    circuit: Circuit
    node: Node
    epoch: int

    def change(self, i: int, epoch: int | None = None) -> DataFrame:
        return self.circuit._change(self.node.inputs[i], self.epoch if epoch is None else epoch)

    def changes(self) -> list[DataFrame]:
        return [self.change(i) for i in range(len(self.node.inputs))]

    def old(self, i: int) -> DataFrame:
        return self.circuit._total(self.node.inputs[i], self.epoch - 1)

    def new(self, i: int) -> DataFrame:
        return self.circuit._total(self.node.inputs[i], self.epoch)


class _NoEpoch(Epoch):
    """An epoch before anything came: only the plan's types count."""

    def change(self, i: int, epoch: int | None = None) -> DataFrame:
        return self.circuit._empty(self.node.inputs[i])

    old = new = change


def _linear(op: Callable[..., DataFrame]) -> Callable:
    return lambda at: op(*at.changes())


def _whole(op: Callable[..., DataFrame]) -> Callable:
    def rule(at: Epoch) -> DataFrame:
        n = range(len(at.node.inputs))
        total = lambda sums: op(*(z.consolidate(sums(i)) for i in n))
        return z.subtract(total(at.new), total(at.old))

    rule.reads_sums = True
    return rule


def _bilinear(op: Callable[..., DataFrame]) -> Callable:
    def rule(at: Epoch) -> DataFrame:
        return z.plus(op(at.new(0), at.change(1)), op(at.change(0), at.old(1)))

    rule.reads_sums = True
    return rule


def _distinct(at: Epoch) -> DataFrame:
    change = z.consolidate(at.change(0))
    return z.distinct_change(z.consolidate(z.semi(at.old(0), change, z.payload(change))), change)


_distinct.reads_sums = True


_SIDE = "_side"


def _grouped(keys: Sequence[str], fn: Callable[[DataFrame, Sequence[str]], DataFrame], aggs: Sequence[Agg] | None = None) -> Callable:
    """The touched groups before (side 0) and after (side 1), both from one pass over their rows."""

    def rule(at: Epoch) -> DataFrame:
        change, dry = at.change(0), isinstance(at, _NoEpoch)
        if keys:
            touched = change.select(*keys).distinct()
            touched = touched if dry else materialize(touched, "touched")  # its size is known then
        else:
            touched = change.select(F.lit(1).alias("_k")).limit(1)
        old = z.semi(at.old(0), touched, keys)
        by = [*keys, _SIDE]
        if aggs is not None and _exact(change, aggs):
            found = _by_sums(old, change, by, aggs, dry)
        else:
            names = z.payload(change)
            rows = old.withColumn("_old", F.col(W)).unionByName(change.withColumn("_old", F.lit(0).cast("long")))
            both = rows.groupBy(*names).agg(F.sum("_old").alias("_old"), F.sum(W).alias(W))
            sides = F.filter(F.array(F.struct(F.lit(0).alias(_SIDE), F.col("_old").alias(W)), F.struct(F.lit(1).alias(_SIDE), F.col(W).alias(W))), lambda x: x[W] != 0)
            found = fn(both.select(*names, F.inline(sides)), by)
        return z.consolidate(found.withColumn(W, F.when(F.col(_SIDE) == 1, F.col(W)).otherwise(-F.col(W))).drop(_SIDE))

    rule.reads_sums = True
    return rule


def _exact(rows: DataFrame, aggs: Sequence[Agg]) -> bool:
    """Whether the aggregates are sums of whole or decimal numbers, the same in any order and consolidated or not."""
    if any(a.sums is None for a in aggs):
        return False
    kinds = rows.select(*(v.alias(f"c{i}") for i, v in enumerate(v for a in aggs for v in a.sums))).schema
    return all(isinstance(f.dataType, (IntegralType, DecimalType)) for f in kinds)


def _by_sums(old: DataFrame, change: DataFrame, by: Sequence[str], aggs: Sequence[Agg], dry: bool) -> DataFrame:
    """Aggregates that weighted sums give: rows are added up where they stand, and only groups are shuffled.

    A group whose weights add up to something exists; where they add up to zero its rows are
    consolidated, as they may all have gone or be of both signs.
    """
    sides = lambda *n: F.explode(F.array(*map(F.lit, n))).alias(_SIDE)
    rows = old.select("*", sides(0, 1)).unionByName(change.select("*", sides(1)))
    found = rows.groupBy(*by).agg(*(a.column.alias(a.name) for a in aggs), F.sum(W).alias("_n"))
    if not dry:
        found = materialize(found, "groups")
        doubtful = found.where(F.col("_n") == 0)
        if not doubtful.isEmpty():
            left = z.semi(rows, doubtful, by).groupBy(*z.payload(rows)).agg(F.sum(W).alias(W)).where(F.col(W) != 0)
            found = found.where(F.col("_n") != 0).unionByName(z.semi(doubtful, left.select(*by).distinct(), by))
    return found.drop("_n").withColumn(W, F.lit(1).cast("long"))


class Circuit:
    """A graph of nodes and the state of its run."""

    def __init__(self, spark: SparkSession, store: Store | None = None):
        self.spark = spark
        self.store: Store = store if store is not None else ParquetStore(spark)
        self.nodes: list[Node] = []
        self.views: dict[str, Node] = {}
        self.sources: dict[str, Node] = {}
        self.schemas: dict[int, StructType] = {}
        self.done: dict[int, int] = {}
        self._changes: dict[tuple[int, int], DataFrame] = {}
        self._keeps: set[int] = set()
        self._places: list[progress.Place] = []

    # -- building -------------------------------------------------------------------

    def _add(self, kind: str, inputs: tuple[Node, ...], rule: Callable, distinct: bool = False, keeps: bool = False, back: int = 0, **detail) -> Node:
        if any(i.circuit is not self or i.id >= len(self.nodes) for i in inputs):
            raise ValueError("inputs must be nodes of this circuit")
        node = Node(self, len(self.nodes), kind, inputs, rule, distinct=distinct, detail=detail)
        node.sources = frozenset().union(*(i.sources for i in inputs)) if inputs else frozenset((node.id,))
        self.nodes.append(node)
        self._places.append(progress.Place(tuple(i.id for i in inputs), back))
        if (at := self.store.progress.get(self._key(node), -1)) >= 0:
            self.done[node.id] = at
        # sums that are read, and changes that a slower reader sees after a restart
        if keeps or back or getattr(rule, "reads_sums", False) or any(i.sources != node.sources for i in inputs):
            self._keeps |= {i.id for i in inputs}
        return node

    def source(self, name: str, schema: str | StructType) -> Node:
        """A named input; ``schema`` is that of its payload."""
        if name in self.sources:
            raise ValueError(f"there is a source {name} already")
        node = self._add("source", (), lambda at: self._changes[node.id, at.epoch])
        kind = self.spark.createDataFrame([], schema).schema
        self.schemas[node.id] = StructType([*kind.fields]).add(W, "long", False)
        node.label = name
        self.sources[name] = node
        return node

    def consumers(self, node: Node) -> list[Node]:
        return [n for n in self.nodes if node in n.inputs]

    def roots(self) -> list[Node]:
        return [n for n in self.nodes if not self.consumers(n)]

    # -- running --------------------------------------------------------------------

    def _key(self, node: Node) -> str:
        return f"{node.id}-{node.kind}"

    def _empty(self, node: Node) -> DataFrame:
        if node.id not in self.schemas:
            self.schemas[node.id] = node.rule(_NoEpoch(self, node, 0)).schema
        return self.spark.createDataFrame([], self.schemas[node.id])

    def _change(self, node: Node, epoch: int) -> DataFrame:
        if epoch < 0:
            return self._empty(node)
        found = self._changes.get((node.id, epoch))
        if found is None:
            found = self.store.change(self._key(node), epoch)
        if found is None:
            raise LookupError(f"the change of {node.kind} {node.id} at epoch {epoch} is not kept")
        return found

    def _total(self, node: Node, epoch: int) -> DataFrame:
        """The sum up to an epoch, not consolidated."""
        found = self.store.total(self._key(node), epoch) if epoch >= 0 else None
        return found if found is not None else self._empty(node)

    def push(self, name: str, change: DataFrame | None = None, epoch: int | None = None) -> int:
        """Append a change (none: a heartbeat) to a source and run what it allows; its epoch.

        A change without ``_w`` counts every row once. Committed epochs cannot be pushed again.
        """
        node = self.sources[name]
        at = self.done.get(node.id, -1) + 1
        if epoch is not None and epoch != at:
            raise ValueError(f"the next epoch of {name} is {at}, not {epoch}")
        if change is None:
            change = self._empty(node)
        if W not in change.columns:
            change = z.weighted(change)
        kind = self.schemas[node.id]
        change = change.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kind.fields))
        self._changes[node.id, at] = change
        self._settle(node, at)
        self.run()
        self.store.commit({self._key(n): self.done[n.id] for n in self.nodes if n.id in self.done})
        return at

    def _settle(self, node: Node, epoch: int) -> None:
        """Note that a node has its change of an epoch; keep it if sums of it are read."""
        self.done[node.id] = epoch
        if node.id in self._keeps or node.label in self.views:
            change = z.consolidate(self._changes[node.id, epoch])
            self.store.append(self._key(node), epoch, change)
            self._changes[node.id, epoch] = self.store.change(self._key(node), epoch)

    def run(self) -> None:
        """Compute every change whose inputs are there."""
        for node in self.nodes:
            if not node.inputs:
                continue
            while (at := self.done.get(node.id, -1) + 1) <= min(self.done.get(i.id, -1) for i in node.inputs):
                change = node.rule(Epoch(self, node, at))
                self.schemas.setdefault(node.id, change.schema)
                self._changes[node.id, at] = change
                self._settle(node, at)
        for node, settled in zip(self.nodes, self._settled(), strict=True):
            self.store.tidy(self._key(node), settled)
        self._forget()

    def _forget(self) -> None:
        """Drop plans of changes that no node reads any more; a delay reads one epoch back."""
        for node_id, epoch in list(self._changes):
            readers = [self.done.get(n.id, -1) for n in self.consumers(self.nodes[node_id])]
            if readers and min(readers) > epoch + 1:
                del self._changes[node_id, epoch]

    # -- reading --------------------------------------------------------------------

    def epoch(self, name: str) -> int:
        """The last epoch that a view has, -1 before its first."""
        return self.done.get(self.views[name].id, -1)

    def _at(self, name: str, epoch: int | None) -> int:
        if epoch is not None and epoch > self.epoch(name):
            raise LookupError(f"{name} has not reached epoch {epoch}")
        return self.epoch(name) if epoch is None else epoch

    def delta(self, name: str, epoch: int | None = None) -> DataFrame:
        """A view's change of one epoch, by default its last."""
        return self._change(self.views[name], self._at(name, epoch))

    def snapshot(self, name: str, epoch: int | None = None) -> DataFrame:
        """A view's sum up to an epoch, by default the last that all its sources have reached."""
        return z.consolidate(self._total(self.views[name], self._at(name, epoch)))

    latest = snapshot

    def batch(self, name: str, inputs: dict[str, DataFrame]) -> DataFrame:
        """The view as a batch query on whole sources: what its changes must add up to."""
        values: dict[int, DataFrame] = {}
        for node in self.nodes:
            if node.kind == "source":
                values[node.id] = inputs[node.label]
            elif "op" in node.detail:
                values[node.id] = node.detail["op"](*(values[i.id] for i in node.inputs))
            else:
                raise ValueError(f"{node.kind} has no batch form")
            if node is self.views[name]:
                return z.consolidate(values[node.id])
        raise KeyError(name)

    # -- progress -------------------------------------------------------------------

    def frontiers(self) -> dict[int, int]:
        """The epoch that every relation can reach by what its sources have."""
        return dict(enumerate(progress.reached(self._places, {n.id: self.done.get(n.id, -1) for n in self.sources.values()})))

    def _settled(self, cursors: dict[str, int] | None = None) -> list[int]:
        done = [self.done.get(n.id, -1) for n in self.nodes]
        at = {name: self.epoch(name) for name in self.views} if cursors is None else cursors
        return progress.settled(self._places, done, {self.views[v].id: e for v, e in at.items()})

    def compact(self, cursors: dict[str, int] | None = None) -> int:
        """Merge state that no reader at or after the cursors (by default: the views' last
        epochs) can tell apart; the number of segments saved."""
        saved = sum(self.store.evict(self._key(n), e) for n, e in zip(self.nodes, self._settled(cursors), strict=True))
        self.store.commit(self.store.progress)
        return saved
