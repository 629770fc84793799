import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import aggregates as agg
from tidemark.operators import zset as z
from tidemark.plans.circuit import Circuit
from tidemark.plans.state import ParquetStore, PlanStore

TX = "id long, src long, dst long, amount long"
KV = "k string, v long"


def kv(spark, rows):
    return z.from_rows(spark, rows, KV)


def test_banking(spark):
    c = Circuit(spark)
    tx = c.source("tx", TX)
    credits = tx.group_by(["dst"], agg.total("amount", "credits"))
    debits = tx.group_by(["src"], agg.total("amount", "debits"))
    balance = credits.join(debits, [("dst", "src")], [F.col("dst").alias("account"), (F.col("credits") - F.col("debits")).alias("balance")]).view("balance")
    balance.group_by([], agg.total("balance", "total")).view("total")
    totals = []
    for row in [(0, 1, 2, 50), (1, 2, 3, 30), (2, 3, 1, 20)]:
        c.push("tx", z.from_rows(spark, {row: 1}, TX))
        totals += [k[0] for k in z.to_rows(c.snapshot("total"))] or [0]
    assert totals == [0, 20, 0]
    assert z.to_rows(c.snapshot("balance")) == {(1, -30): 1, (2, 20): 1, (3, 10): 1}
    saved = c.compact()
    assert saved > 0 and z.to_rows(c.snapshot("balance")) == {(1, -30): 1, (2, 20): 1, (3, 10): 1}


def one_view(spark, build, *schemas, store=None):
    c = Circuit(spark, store if store is not None else PlanStore())
    build(*(c.source(f"s{i}", s) for i, s in enumerate(schemas))).view("out")
    return c


def test_group_by_changes(spark):
    c = one_view(spark, lambda s: s.group_by(["k"], agg.total("v", "t")), KV)
    expect = [({("a", 10): 1, ("a", 5): 1, ("b", 7): 1}, {("a", 15): 1, ("b", 7): 1}), ({("a", 3): 1}, {("a", 15): -1, ("a", 18): 1}), ({("a", 10): -1}, {("a", 18): -1, ("a", 8): 1}), ({("b", 7): -1}, {("b", 7): -1})]
    for change, want in expect:
        c.push("s0", kv(spark, change))
        assert z.to_rows(c.delta("out")) == want


def test_max_falls_back(spark):
    c = one_view(spark, lambda s: s.group_by(["k"], agg.greatest("v", "m")), KV)
    for change, want in [({("a", 10): 1, ("a", 5): 1}, {("a", 10): 1}), ({("a", 20): 1}, {("a", 10): -1, ("a", 20): 1}), ({("a", 20): -1}, {("a", 20): -1, ("a", 10): 1})]:
        c.push("s0", kv(spark, change))
        assert z.to_rows(c.delta("out")) == want


def test_group_exists_by_records(spark):
    c = one_view(spark, lambda s: s.group_by(["k"], agg.count("n"), agg.greatest("v", "m")), KV)
    c.push("s0", kv(spark, {("a", 1): 1, ("a", 2): -1, ("b", 3): -2}))
    assert z.to_rows(c.snapshot("out")) == {("a", 0, 1): 1, ("b", -2, None): 1}
    c.push("s0", kv(spark, {("a", 1): -1, ("a", 2): 1}))
    assert z.to_rows(c.snapshot("out")) == {("b", -2, None): 1}


def test_join_over_epochs(spark):
    e = "src long, dst long"
    c = one_view(spark, lambda a, b: a.join(b, [("dst", "src")], [F.col("l.src").alias("src"), F.col("r.dst").alias("dst")]), e, e)
    c.push("s0", z.from_rows(spark, {(0, 1): 1}, e))
    c.push("s1", z.from_rows(spark, {(1, 2): 1}, e))
    assert z.to_rows(c.delta("out")) == {(0, 2): 1}
    c.push("s0", z.from_rows(spark, {(2, 1): 1}, e))
    c.push("s1")
    assert z.to_rows(c.delta("out")) == {(2, 2): 1}


def test_distinct_over_epochs(spark):
    c = one_view(spark, lambda s: s.unique(), KV)
    for change, want in [({("a", 1): 3}, {("a", 1): 1}), ({("a", 1): 1}, {}), ({("a", 1): -4}, {("a", 1): -1})]:
        c.push("s0", kv(spark, change))
        assert z.to_rows(c.delta("out")) == want


def test_heartbeats_and_epochs(spark):
    c = one_view(spark, lambda a, b: a.plus(b), KV, KV)
    assert c.epoch("out") == -1 and z.to_rows(c.snapshot("out")) == {}
    c.push("s0", kv(spark, {("a", 1): 1}))
    c.push("s0", kv(spark, {("a", 2): 1}))
    assert c.epoch("out") == -1
    c.push("s1")
    assert c.epoch("out") == 0 and z.to_rows(c.latest("out")) == {("a", 1): 1}
    c.push("s1", kv(spark, {("b", 1): 1}))
    assert z.to_rows(c.latest("out")) == {("a", 1): 1, ("a", 2): 1, ("b", 1): 1}
    assert z.to_rows(c.snapshot("out", 0)) == {("a", 1): 1}
    with pytest.raises(ValueError):
        c.push("s0", kv(spark, {}), epoch=0)
    with pytest.raises(ValueError):
        c.source("s0", KV)


def test_delay_integrate_differentiate(spark):
    c = Circuit(spark, PlanStore())
    s = c.source("s", KV)
    s.delay().view("delay")
    s.integrate().view("sum")
    s.integrate().differentiate().view("back")
    for change in ({("a", 1): 1}, {("b", 1): 2}):
        c.push("s", kv(spark, change))
    assert z.to_rows(c.delta("delay")) == {("a", 1): 1}
    assert z.to_rows(c.delta("sum")) == {("a", 1): 1, ("b", 1): 2}
    assert z.to_rows(c.delta("back")) == {("b", 1): 2}


BUILDS = {
    "where": lambda a, b: a.where(F.col("v") > 1),
    "select": lambda a, b: a.select("k"),
    "flat_map": lambda a, b: a.flat_map(F.array("v", F.col("v") + 1), "x", ["k"]),
    "plus": lambda a, b: a.plus(b),
    "minus": lambda a, b: a.minus(b),
    "union": lambda a, b: a.union(b),
    "difference": lambda a, b: a.difference(b),
    "intersect": lambda a, b: a.intersect(b),
    "join": lambda a, b: a.join(b, ["k"], [F.col("l.k").alias("k"), F.col("l.v").alias("v"), F.col("r.v").alias("w")]),
    "theta": lambda a, b: a.theta_join(b, F.col("l.v") < F.col("r.v"), [F.col("l.v").alias("v"), F.col("r.v").alias("w")]),
    "unique": lambda a, b: a.unique(),
    "sum": lambda a, b: a.group_by(["k"], agg.total("v", "t"), agg.count("n")),
    "extremes": lambda a, b: a.group_by(["k"], agg.greatest("v", "m"), agg.least("v", "l"), agg.mean("v", "avg"), agg.count_distinct("v", "d")),
    "global": lambda a, b: a.group_by([], agg.total("v", "t")),
    "chain": lambda a, b: a.select("k").unique().join(b, ["k"]).group_by(["k"], agg.total("v", "t")),
    "whole": lambda a, b: a.combine(lambda x, y: z.intersect_all(x, y), b),
}


@pytest.mark.parametrize("name", BUILDS)
def test_changes_add_up_to_the_batch_query(spark, name):
    rng = random.Random(f"seed-{name}")
    c = one_view(spark, BUILDS[name], KV, KV)
    totals = [None, None]
    for _ in range(3):
        for i in range(2):
            rows = {(rng.choice(["a", "b", None]), rng.randint(0, 3)): rng.choice([-2, -1, 1, 2]) for _ in range(rng.randint(0, 4))}
            change = kv(spark, rows)
            totals[i] = change if totals[i] is None else z.plus(totals[i], change)
            c.push(f"s{i}", change)
    want = z.to_rows(c.batch("out", {"s0": totals[0], "s1": totals[1]}))
    assert z.to_rows(c.snapshot("out")) == want
    assert z.to_rows(z.plus(*(c.delta("out", e) for e in range(3)))) == want


def test_inner_distinct_is_dropped(spark):
    c = Circuit(spark, PlanStore())
    s = c.source("s", KV).unique()
    assert s.unique() is s and s.where(F.col("v") > 0).unique().kind == "where"
    assert c.roots()[0].kind == "where" and c.consumers(s)[0].kind == "where"


def test_state_survives_and_merges(spark, tmp_path):
    store = ParquetStore(spark, f"file://{tmp_path}/state", merge_after=2)
    for e in range(3):
        store.append("n", e, kv(spark, {("a", e): 1}))
    store.commit({"n": 2})
    store.append("n", 3, kv(spark, {("lost", 3): 1}))  # no commit follows
    again = ParquetStore(spark, f"file://{tmp_path}/state")
    assert z.to_rows(again.total("n", 2)) == {("a", 0): 1, ("a", 1): 1, ("a", 2): 1}
    assert z.to_rows(again.total("n", 0)) == {("a", 0): 1}
    assert again.evict("n", 1) == 1 and again.size() == 2
    assert z.to_rows(again.total("n", 2)) == {("a", 0): 1, ("a", 1): 1, ("a", 2): 1}
    with pytest.raises(LookupError):
        again.total("n", 0)
    with pytest.raises(ValueError):
        again.append("n", 2, kv(spark, {}))


def test_segments_merge_by_magnitude(spark, tmp_path):
    store = ParquetStore(spark, f"file://{tmp_path}/state", merge_after=2)
    for e in range(7):
        store.append("n", e, kv(spark, {("a", e): 1}))
        store.tidy("n", e)
    assert store.epochs("n") == [3, 5, 6] and z.to_rows(store.total("n", 6)) == {("a", e): 1 for e in range(7)}


def lagging(spark, path):
    c = Circuit(spark, ParquetStore(spark, path, merge_after=2))
    a, b = c.source("a", KV), c.source("b", KV)
    a.join(b, ["k"], [F.col("l.v").alias("v"), F.col("r.v").alias("w")]).view("out")
    a.plus(b).view("all")
    a.view("a")
    return c


def test_sources_far_apart_and_a_restart(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    c = lagging(spark, path)
    for e in range(20):
        c.push("a", kv(spark, {("k", e): 1}))
    with pytest.raises(LookupError):
        c.snapshot("a", 3) if len(c.store.epochs("0-source")) < 20 else c.snapshot("a", 99)
    c = lagging(spark, path)  # as after a crash
    assert c.done == {0: 19} and c.epoch("out") == -1
    for e in range(20):
        if e == 10:
            c = lagging(spark, path)
        c.push("b", kv(spark, {("k", 100): 1} if e == 7 else {}))
    assert c.epoch("out") == 19
    assert z.to_rows(c.snapshot("out")) == {(e, 100): 1 for e in range(20)}
    assert z.to_rows(c.snapshot("all")) == {("k", e): 1 for e in (*range(20), 100)}
    with pytest.raises(ValueError):
        c.push("a", kv(spark, {}), epoch=19)


def test_any_aggregate(spark):
    c = one_view(spark, lambda s: s.group_by_pandas(["k"], lambda r: ",".join(map(str, sorted(r["v"]))), "all", "string"), KV)
    c.push("s0", kv(spark, {("a", 2): 1, ("a", 1): 3}))
    c.push("s0", kv(spark, {("a", 2): -1, ("b", 9): 1}))
    assert z.to_rows(c.snapshot("out")) == {("a", "1"): 1, ("b", "9"): 1}


def test_top(spark):
    c = one_view(spark, lambda s: s.group_by(["k"], agg.top("v", 2, "t")), KV)
    c.push("s0", kv(spark, {("a", 1): 1, ("a", 5): 2, ("a", 9): -1}))
    assert [r.t for r in c.snapshot("out").collect()] == [[5, 5]]


def test_an_operator_of_ones_own(spark):
    """Rows of the first input whose key the second lacks, from changes and sums."""

    def without(a, b):
        return z.semi(z.consolidate(a), z.consolidate(b).where(F.col("_w") > 0), ["k"], "left_anti")

    rule = lambda at: z.subtract(without(at.new(0), at.new(1)), without(at.old(0), at.old(1)))
    c = one_view(spark, lambda a, b: a.operator(rule, b, op=without), KV, KV)
    for a, b, want in [({("x", 1): 1, ("y", 2): 2}, {("y", 9): 1}, {("x", 1): 1}), ({}, {("y", 9): -1, ("x", 0): 1}, {("x", 1): -1, ("y", 2): 2})]:
        c.push("s0", kv(spark, a))
        c.push("s1", kv(spark, b))
        assert z.to_rows(c.delta("out")) == want
