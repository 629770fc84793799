"""Every query of the relational engine, and its SQL.

Inputs arrive as changes: a table's rows in three epochs (key modulo 3), then the rows
whose key is divisible by 10 again with weight -1. What remains is the table without these
rows, which the SQL queries directly. Weights are returned as ``w``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import aggregates as agg
from tidemark.operators import streams
from tidemark.operators import zset as z
from tidemark.operators.zset import EPOCH, ITER, W
from tidemark.plans.circuit import Circuit, Node
from tidemark.plans.state import ParquetStore
from tidemark.recursion.datalog import Datalog, stratify
from tidemark.recursion.datalog import Rule as DatalogRule
from tidemark.recursion.fixpoint import Reachability, reach
from tidemark.recursion.rdfs import Knowledge, Vocabulary, closure
from tidemark.session import fresh_path, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
Edges = Callable[[SparkSession, str], DataFrame]
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(ship_package(spark), sf_dir)
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _changes(rows: DataFrame, key: str) -> DataFrame:
    """The rows as a stream of changes over four epochs."""
    arrive = z.weighted(rows).withColumn(EPOCH, (F.col(key) % 3).cast("int"))
    leave = z.weighted(rows.where(F.col(key) % 10 == 0), -1).withColumn(EPOCH, F.lit(3))
    return arrive.unionByName(leave)


def _shown(found: DataFrame) -> DataFrame:
    return found.withColumnRenamed(W, "w")


def _fed(circuit: Circuit, feeds: dict[str, DataFrame], epochs: int = 4) -> Circuit:
    for e in range(epochs):
        for name, changes in feeds.items():
            circuit.push(name, changes.where(F.col(EPOCH) == e).drop(EPOCH))
    return circuit


def _maintained(spark: SparkSession, feeds: dict[str, DataFrame], build: Callable[..., Node]) -> Circuit:
    """A circuit over the feeds with one view, run over all epochs."""
    circuit = Circuit(spark)
    nodes = [circuit.source(n, c.drop(EPOCH, W).schema) for n, c in feeds.items()]
    build(*nodes).view("out")
    return _fed(circuit, feeds)


def _result(spark: SparkSession, feeds: dict[str, DataFrame], build: Callable[..., Node]) -> DataFrame:
    return _shown(_maintained(spark, feeds, build).snapshot("out"))


# -- linear operators -------------------------------------------------------------------


@query("z_select", "SELECT l_orderkey, l_linenumber, l_quantity, count(*) AS w FROM lineitem WHERE l_quantity > 45 AND l_orderkey % 10 <> 0 GROUP BY 1, 2, 3")
def z_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return _shown(streams.eliminate(z.select(_changes(rows, "l_orderkey"), F.col("l_quantity") > 45), EPOCH))


@query("z_project_collide", "SELECT l_returnflag, l_linestatus, count(*) AS w FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY 1, 2")
def z_project_collide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    return _shown(z.project(_changes(rows, "l_orderkey"), "l_returnflag", "l_linestatus"))


@query("z_flatmap_words", "SELECT word, count(*) AS w FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM documents WHERE doc_id % 10 <> 0) WHERE word <> '' GROUP BY word")
def z_flatmap_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text")
    items = F.filter(F.split(F.translate("text", "\n", " "), " "), lambda x: x != "")
    return _shown(z.consolidate(z.flat_map(_changes(rows, "doc_id"), items, "word")))


# -- set operations ---------------------------------------------------------------------


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    b = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    return tuple(z.consolidate(_changes(x, "k").select("n", W)) for x in (a, b))


_NATIONS_SQL = """WITH a AS (SELECT c_nationkey AS n FROM customer WHERE c_custkey % 10 <> 0),
b AS (SELECT s_nationkey AS n FROM supplier WHERE s_suppkey % 10 <> 0)
"""
_SETS = {
    "z_union_all": (z.union_all, "SELECT n, count(*) AS w FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY n"),
    "z_union": (z.union, "SELECT n, CAST(1 AS BIGINT) AS w FROM (SELECT * FROM a UNION SELECT * FROM b)"),
    "z_intersect": (z.intersect, "SELECT n, CAST(x.c * y.c AS BIGINT) AS w FROM (SELECT n, count(*) AS c FROM a GROUP BY n) x JOIN (SELECT n, count(*) AS c FROM b GROUP BY n) y USING (n)"),
    "z_intersect_distinct": (z.intersect_distinct, "SELECT n, CAST(1 AS BIGINT) AS w FROM (SELECT * FROM a INTERSECT SELECT * FROM b)"),
    "z_intersect_all": (z.intersect_all, "SELECT n, count(*) AS w FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b) GROUP BY n"),
    "z_except": (z.difference, "SELECT DISTINCT n, CAST(1 AS BIGINT) AS w FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)"),
    "z_except_distinct": (z.except_distinct, "SELECT n, CAST(1 AS BIGINT) AS w FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"),
    "z_except_all": (z.except_all, "SELECT n, count(*) AS w FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY n"),
}
for _name, (_op, _sql) in _SETS.items():
    query(_name, _NATIONS_SQL + _sql)(lambda spark, sf_dir, op=_op: _shown(op(*_nations(spark, sf_dir))))


# -- joins ------------------------------------------------------------------------------


@query("z_join_equi", "SELECT o_orderpriority, l_returnflag, count(*) AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 10 <> 0 GROUP BY 1, 2")
def z_join_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    feeds = {"orders": _changes(orders, "o_orderkey"), "items": _changes(items, "l_orderkey")}
    return _result(spark, feeds, lambda o, i: o.join(i, [("o_orderkey", "l_orderkey")], ["o_orderpriority", "l_returnflag"]))


_PLACES = ("nation", "region")


def _places(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    n = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = _table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return {"n": _changes(n, "n_nationkey"), "r": _changes(r, "r_regionkey")}


@query("z_join_theta", "SELECT n_name, r_name, CAST(1 AS BIGINT) AS w FROM nation JOIN region ON n_regionkey < r_regionkey WHERE n_nationkey % 10 <> 0 AND r_regionkey % 10 <> 0")
def z_join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(spark, _places(spark, sf_dir), lambda n, r: n.theta_join(r, F.col("l.n_regionkey") < F.col("r.r_regionkey"), ["n_name", "r_name"]))


@query("z_cartesian", "SELECT n_name, r_name, CAST(1 AS BIGINT) AS w FROM nation CROSS JOIN region WHERE n_nationkey % 10 <> 0 AND r_regionkey % 10 <> 0")
def z_cartesian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(spark, _places(spark, sf_dir), lambda n, r: n.cartesian(r, ["n_name", "r_name"]))


@query("z_join_keep", "SELECT n_name, r_name, CAST(1 AS BIGINT) AS w FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 10 <> 0 AND r_regionkey % 10 <> 0 AND n_nationkey % 2 = 1")
def z_join_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = lambda n, r: n.join(r, [("n_regionkey", "r_regionkey")], ["n_name", "r_name"], keep=F.col("l.n_nationkey") % 2 == 1)
    return _result(spark, _places(spark, sf_dir), build)


@query("z_semi_anti", """SELECT n_name, 'with' AS side, CAST(1 AS BIGINT) AS w FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT n_name, 'without', 1 FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def z_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = z.weighted(_table(spark, sf_dir, "nation").select("n_name", "n_nationkey"))
    keys = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    sides = [z.semi(nations, keys, ["n_nationkey"], how).select("n_name", F.lit(side).alias("side"), W) for how, side in (("left_semi", "with"), ("left_anti", "without"))]
    return _shown(z.plus(*sides))


# -- distinct, aggregates ---------------------------------------------------------------


@query("z_distinct_incremental", "SELECT DISTINCT user_id, event_type, CAST(1 AS BIGINT) AS w FROM events WHERE event_id % 10 <> 0")
def z_distinct_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return _result(spark, {"events": _changes(rows, "event_id")}, lambda e: e.select("user_id", "event_type").unique())


def _orders(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    cents = F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")
    return {"orders": _changes(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", cents), "o_orderkey")}


_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_AGGS: dict[str, tuple[Callable[[], list[agg.Agg]], str]] = {
    "z_groupby_sum": (lambda: [agg.total("cents", "total"), agg.count("n")], f"CAST(sum({_CENTS}) AS BIGINT) AS total, count(*) AS n"),
    "z_groupby_max": (lambda: [agg.greatest("cents", "top")], f"max({_CENTS}) AS top"),
    "z_groupby_min": (lambda: [agg.least("cents", "low")], f"min({_CENTS}) AS low"),
    "z_groupby_avg": (lambda: [agg.mean("cents", "mean")], f"CAST(sum({_CENTS}) AS DOUBLE) / count(*) AS mean"),
    "z_groupby_count_distinct": (lambda: [agg.count_distinct(F.col("cents") % 100, "parts")], f"count(DISTINCT {_CENTS} % 100) AS parts"),
    "z_groupby_top": (lambda: [agg.Agg("top3", F.array_join(agg.top("cents", 3, "t").column.cast("array<string>"), ","))], f"array_to_string(list_sort(list({_CENTS}), 'DESC')[1:3], ',') AS top3"),
}
for _name, (_aggs, _sql) in _AGGS.items():
    query(_name, f"SELECT o_custkey, {_sql}, CAST(1 AS BIGINT) AS w FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY o_custkey")(
        lambda spark, sf_dir, aggs=_aggs: _result(spark, _orders(spark, sf_dir), lambda o: o.group_by(["o_custkey"], *aggs()))
    )


@query("z_groupby_pandas", f"SELECT o_custkey, max({_CENTS}) - min({_CENTS}) AS spread, CAST(1 AS BIGINT) AS w FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY o_custkey")
def z_groupby_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = lambda rows: int(rows["cents"].max() - rows["cents"].min())
    return _result(spark, _orders(spark, sf_dir), lambda o: o.group_by_pandas(["o_custkey"], spread, "spread", "bigint"))


@query("z_global_total", f"SELECT CAST(sum({_CENTS}) AS BIGINT) AS total, count(*) AS n, CAST(1 AS BIGINT) AS w FROM orders WHERE o_orderkey % 10 <> 0")
def z_global_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(spark, _orders(spark, sf_dir), lambda o: o.group_by([], agg.total("cents", "total"), agg.count("n")))


@query("z_groupby_changelog", f"""WITH old AS (SELECT o_custkey, CAST(sum({_CENTS}) AS BIGINT) AS total FROM orders GROUP BY 1),
new AS (SELECT o_custkey, CAST(sum({_CENTS}) AS BIGINT) AS total FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1)
SELECT *, CAST(1 AS BIGINT) AS w FROM (SELECT * FROM new EXCEPT ALL SELECT * FROM old) UNION ALL SELECT *, -1 FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM new)""")
def z_groupby_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_maintained(spark, _orders(spark, sf_dir), lambda o: o.group_by(["o_custkey"], agg.total("cents", "total"))).delta("out", 3))


@query("z_banking", """WITH tx AS (SELECT l_suppkey % 50 AS src, l_partkey % 50 AS dst, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem WHERE l_orderkey % 10 <> 0),
c AS (SELECT dst AS account, CAST(sum(cents) AS BIGINT) AS credits FROM tx GROUP BY 1), d AS (SELECT src AS account, CAST(sum(cents) AS BIGINT) AS debits FROM tx GROUP BY 1)
SELECT account, CAST(credits - debits AS BIGINT) AS balance, CAST((SELECT sum(credits - debits) FROM c JOIN d USING (account)) AS BIGINT) AS total, CAST(1 AS BIGINT) AS w FROM c JOIN d USING (account)""")
def z_banking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits and debits per account, balances where an account has both, and their total."""
    items = _table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")
    tx = items.select("l_orderkey", (F.col("l_suppkey") % 50).alias("src"), (F.col("l_partkey") % 50).alias("dst"), cents)

    def build(t: Node) -> Node:
        credits = t.group_by(["dst"], agg.total("cents", "credits"))
        debits = t.group_by(["src"], agg.total("cents", "debits"))
        balance = credits.join(debits, [("dst", "src")], [F.col("dst").alias("account"), (F.col("credits") - F.col("debits")).alias("balance")])
        return balance.cartesian(balance.group_by([], agg.total("balance", "total")))

    return _result(spark, {"tx": _changes(tx, "l_orderkey")}, build)


@query("z_apply", "SELECT o_custkey % 7 AS k, CAST((o_custkey % 7) * (o_custkey % 7) AS BIGINT) AS sq, count(*) AS w FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1, 2")
def z_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey") % 7
    return _result(spark, _orders(spark, sf_dir), lambda o: o.apply(lambda d: d.select(k.alias("k"), (k * k).alias("sq"), W), linear=True))


@query("z_combine", """SELECT n_nationkey AS k, CAST(1 AS BIGINT) AS w FROM nation WHERE n_nationkey % 10 <> 0 AND n_nationkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey % 10 <> 0)""")
def z_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    def without(a: DataFrame, b: DataFrame) -> DataFrame:
        return z.semi(a, b.where(F.col(W) > 0), ["k"], "left_anti")

    return _result(spark, _places(spark, sf_dir), lambda n, r: n.select(F.col("n_nationkey").alias("k")).combine(without, r.select(F.col("r_regionkey").alias("k"))))


@query("z_heartbeat", "SELECT n_name, CAST(1 AS BIGINT) AS w FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT r_name, 1 FROM region WHERE r_regionkey % 3 = 0")
def z_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources at different epochs: the view stands at the slower one's."""
    feeds, circuit = _places(spark, sf_dir), Circuit(spark)
    n, r = (circuit.source(k, v.drop(EPOCH, W).schema) for k, v in feeds.items())
    n.select(F.col("n_name").alias("n_name")).plus(r.select(F.col("r_name").alias("n_name"))).view("out")
    for e in range(3):
        circuit.push("n", feeds["n"].where(F.col(EPOCH) == e).drop(EPOCH))
    circuit.push("r", feeds["r"].where(F.col(EPOCH) == 0).drop(EPOCH))
    return _shown(circuit.latest("out"))


@query("z_lagging_sources", "SELECT n_name, r_name, CAST(1 AS BIGINT) AS w FROM nation JOIN region ON n_regionkey = r_regionkey")
def z_lagging_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source twelve epochs ahead of the one it is joined with, and a restart between them."""
    feeds, store = _places(spark, sf_dir), ParquetStore(spark, merge_after=4)

    def built() -> Circuit:
        circuit = Circuit(spark, store)
        n, r = (circuit.source(k, v.drop(EPOCH, W).schema) for k, v in feeds.items())
        n.join(r, [("n_regionkey", "r_regionkey")], ["n_name", "r_name"]).view("out")
        return circuit

    rows = {k: v.where(F.col(EPOCH) < 3).drop(EPOCH) for k, v in feeds.items()}
    circuit = built()
    for e in range(12):
        circuit.push("n", rows["n"].where(F.col("n_nationkey") % 12 == e))
    store = ParquetStore(spark, store.path, merge_after=4)
    circuit = built()
    for e in range(12):
        circuit.push("r", rows["r"].where(F.col("r_regionkey") % 12 == e))
    return _shown(circuit.snapshot("out"))


# -- streams in one plan ----------------------------------------------------------------

_DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT)"


def _daily(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long")
    s = streams.settle(z.weighted(_table(spark, sf_dir, "events").select("event_type", day.alias(EPOCH))))
    return s, s.agg(F.max(EPOCH)).first()[0]


def _epochs(s: DataFrame) -> DataFrame:
    return _shown(s).withColumnRenamed(EPOCH, "epoch").select("event_type", F.col("epoch").cast("long").alias("epoch"), "w")


_DAILY = f"WITH d AS (SELECT event_type, {_DAY} AS epoch, count(*) AS w FROM events GROUP BY 1, 2), days AS (SELECT unnest(range((SELECT min(epoch) FROM d), (SELECT max(epoch) FROM d) + 1)) AS epoch)\n"


@query("z_integrate", _DAILY + "SELECT event_type, days.epoch, CAST(sum(w) AS BIGINT) AS w FROM d JOIN days ON d.epoch <= days.epoch GROUP BY 1, 2")
def z_integrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, last = _daily(spark, sf_dir)
    return _epochs(streams.integrate(s, last))


@query("z_differentiate", _DAILY + "SELECT event_type, epoch, CAST(sum(w) AS BIGINT) AS w FROM (SELECT * FROM d UNION ALL SELECT event_type, epoch + 1, -w FROM d) GROUP BY 1, 2 HAVING sum(w) <> 0")
def z_differentiate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _epochs(streams.differentiate(_daily(spark, sf_dir)[0]))


@query("z_delay", _DAILY + "SELECT event_type, epoch + 1 AS epoch, w FROM d")
def z_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _epochs(streams.delay(_daily(spark, sf_dir)[0]))


@query("z_introduce_eliminate", _DAILY + "SELECT event_type, epoch, w FROM d")
def z_introduce_eliminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _epochs(streams.eliminate(streams.introduce(_daily(spark, sf_dir)[0])))


@query("z_differentiate_integrate", _DAILY + "SELECT event_type, epoch, w FROM d")
def z_differentiate_integrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, last = _daily(spark, sf_dir)
    return _epochs(streams.differentiate(streams.integrate(s, last), last))


@query("z_fold_max", _DAILY + "SELECT event_type, epoch, CAST(max(w) OVER (PARTITION BY event_type ORDER BY epoch) AS BIGINT) AS w FROM d")
def z_fold_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _epochs(streams.fold(_daily(spark, sf_dir)[0], ["event_type"], W, F.max))


_HOURLY = f"WITH h AS (SELECT event_type, {_DAY} AS epoch, CAST(extract('hour' FROM ts) AS BIGINT) AS step, count(*) AS w FROM events GROUP BY 1, 2, 3)\n"


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of streams: days, and the hours of each as the inner axis."""
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long").alias(EPOCH)
    events = _table(spark, sf_dir, "events").select("event_type", day, F.hour("ts").cast("long").alias(ITER))
    return streams.settle(z.weighted(events))


def _cells(s: DataFrame) -> DataFrame:
    return s.select("event_type", F.col(EPOCH).alias("epoch"), F.col(ITER).cast("long").alias("step"), F.col(W).alias("w"))


@query("z_inner_delay", _HOURLY + "SELECT event_type, epoch, step + 1 AS step, w FROM h")
def z_inner_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(streams.delay(_hourly(spark, sf_dir), ITER))


@query("z_inner_integrate", _HOURLY + "SELECT event_type, epoch, t.step, CAST(sum(w) AS BIGINT) AS w FROM h JOIN (SELECT unnest(range(24)) AS step) t ON h.step <= t.step GROUP BY 1, 2, 3")
def z_inner_integrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(streams.integrate(_hourly(spark, sf_dir), 23, ITER))


@query("z_inner_differentiate", _HOURLY + "SELECT event_type, epoch, step, CAST(sum(w) AS BIGINT) AS w FROM (SELECT * FROM h UNION ALL SELECT event_type, epoch, step + 1, -w FROM h) GROUP BY 1, 2, 3 HAVING sum(w) <> 0")
def z_inner_differentiate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(streams.differentiate(_hourly(spark, sf_dir), axis=ITER))


@query("z_inner_introduce", _HOURLY + "SELECT event_type, epoch, CAST(0 AS BIGINT) AS step, CAST(sum(w) AS BIGINT) AS w FROM h GROUP BY 1, 2")
def z_inner_introduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inner axis summed up, and introduced again: a value at its first moment alone."""
    return _cells(streams.introduce(streams.eliminate(_hourly(spark, sf_dir), ITER), ITER))


@query("z_scalar", f"SELECT coalesce(max(CAST(round(o_totalprice * 100) AS BIGINT)), 0) AS top, (SELECT coalesce(max(o_orderkey), -1) FROM orders WHERE o_orderkey < 0) AS none FROM orders WHERE o_orderkey % 10 <> 0")
def z_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    circuit = Circuit(spark)
    source = circuit.source("orders", orders["orders"].drop(EPOCH, W).schema)
    source.group_by([], agg.greatest("cents", "top")).view("top")
    source.where(F.col("o_orderkey") < 0).group_by([], agg.greatest("o_orderkey", "none")).view("none")
    _fed(circuit, orders)
    return z.scalar(circuit.latest("top"), "top").crossJoin(z.scalar(circuit.latest("none"), "none", -1))


# -- graphs -----------------------------------------------------------------------------

#: An edge per line item.
_EDGES = "SELECT DISTINCT l_orderkey*7 + l_linenumber AS src, l_partkey*13 + l_suppkey AS dst FROM lineitem"
_SUPPLY = "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem"
_PLACES_EDGES = "SELECT n_nationkey AS src, n_regionkey AS dst FROM nation"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of all items; equal ones add up to a weight, or to one pair, where they are read."""
    items = _table(spark, sf_dir, "lineitem")
    return items.select((F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("src"), (F.col("l_partkey") * 13 + F.col("l_suppkey")).alias("dst"))


def _supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers as nodes of one graph, which is dense in short cycles."""
    return _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


def _place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))


def _tc(where: str = "", edges: str = _EDGES) -> str:
    return f"WITH RECURSIVE e AS ({edges}), f AS (SELECT * FROM e {where}), r(src, dst) AS (SELECT src, dst FROM f UNION SELECT r.src, f.dst FROM r JOIN f ON r.dst = f.src)"


@query("g_reach", f"{_tc()} SELECT src, dst FROM r")
def g_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach(_edges(spark, sf_dir))[0]


@query("g_reach_hops", f"{_tc()} SELECT src, dst FROM r")
def g_reach_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach(_edges(spark, sf_dir), hop_by_hop=True)[0]


def _stepwise(spark: SparkSession, sf_dir: str, deletes: bool) -> DataFrame:
    e = z.weighted(_edges(spark, sf_dir))
    state = Reachability(e)
    out = [state.push(e.where("src % 5 <> 0")), state.push(e.where("src % 5 = 0"))]
    if deletes:
        out.append(state.push(z.negate(e.where("dst % 5 = 0"))))
    return _shown(z.add(*out))


@query("g_reach_incremental", f"{_tc()} SELECT src, dst, CAST(1 AS BIGINT) AS w FROM r")
def g_reach_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stepwise(spark, sf_dir, False)


@query("g_reach_delete", f"{_tc('WHERE dst % 5 <> 0')} SELECT src, dst, CAST(1 AS BIGINT) AS w FROM r")
def g_reach_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stepwise(spark, sf_dir, True)


# -- Datalog ----------------------------------------------------------------------------

TC = [(("tc", ("?X", "?Y")), ("e", ("?X", "?Y"))), (("tc", ("?X", "?Z")), ("tc", ("?X", "?Y")), ("e", ("?Y", "?Z")))]
NODES = [(("node", ("?X",)), ("e", ("?X", "?Y"))), (("node", ("?Y",)), ("e", ("?X", "?Y")))]


def _session(spark: SparkSession, sf_dir: str, rules: list[tuple], edges: Edges = _edges) -> Datalog:
    program = Datalog(spark, typed=True)
    program.push_rules(rules)
    program.push_facts({"e": edges(spark, sf_dir).select(F.col("src").alias("c0"), F.col("dst").alias("c1"))})
    return program


def _facts(program: Datalog, predicate: str, *names: str) -> DataFrame:
    """A predicate's facts under other names; a predicate without facts has no type but that of the edges."""
    found = program.saturate().get(predicate)
    return found.toDF(*names) if found is not None else program.spark.createDataFrame([], ", ".join(f"{n} long" for n in names))


@query("d_tc", f"{_tc()} SELECT src, dst FROM r")
def d_tc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(_session(spark, sf_dir, TC), "tc", "src", "dst")


@query("d_union_heads", f"WITH e AS ({_EDGES}) SELECT src AS x FROM e UNION SELECT dst FROM e")
def d_union_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(_session(spark, sf_dir, NODES), "node", "x")


@query("d_const_filter", f"WITH e AS ({_EDGES}) SELECT DISTINCT src AS x FROM e WHERE dst = 92 UNION SELECT 7")
def d_const_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = _session(spark, sf_dir, [(("to", ("?X",)), ("e", ("?X", 92)))])
    program.push_facts({"to": spark.createDataFrame([(7,)], "c0 long")})
    return _facts(program, "to", "x")


@query("d_unify", f"WITH e AS ({_SUPPLY}) SELECT a.src AS x, a.dst AS y FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src UNION SELECT src, dst FROM e WHERE src = dst")
def d_unify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(_session(spark, sf_dir, [(("m", ("?X", "?Y")), ("e", ("?X", "?Y")), ("e", ("?Y", "?X"))), (("m", ("?X", "?X")), ("e", ("?X", "?X")))], _supply), "m", "x", "y")


@query("d_negation", f"WITH e AS ({_EDGES}) SELECT DISTINCT dst AS x FROM e WHERE dst NOT IN (SELECT src FROM e)")
def d_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(_session(spark, sf_dir, [*NODES, (("sink", ("?X",)), ("!e", ("?X", "?Y")), ("node", ("?X",)))]), "sink", "x")


@query("d_two_strata", f"""WITH e AS ({_EDGES}), s AS (SELECT DISTINCT dst AS x FROM e WHERE dst NOT IN (SELECT src FROM e)),
b AS (SELECT DISTINCT src AS x FROM e WHERE dst IN (SELECT x FROM s)) SELECT DISTINCT src AS x FROM e WHERE src NOT IN (SELECT x FROM b)""")
def d_two_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [*NODES, (("sink", ("?X",)), ("node", ("?X",)), ("!e", ("?X", "?Y"))), (("before", ("?X",)), ("e", ("?X", "?Y")), ("sink", ("?Y",))), (("far", ("?X",)), ("e", ("?X", "?Y")), ("!before", ("?X",)))]
    return _facts(_session(spark, sf_dir, rules), "far", "x")


@query("d_transitive_complement", f"{_tc(edges=_PLACES_EDGES)}, n AS (SELECT src AS x FROM f UNION SELECT dst FROM f) SELECT a.x, b.x AS y FROM n a CROSS JOIN n b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.src = a.x AND r.dst = b.x)")
def d_transitive_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [*TC, *NODES, (("not_tc", ("?X", "?Y")), ("node", ("?X",)), ("node", ("?Y",)), ("!tc", ("?X", "?Y")))]
    return _facts(_session(spark, sf_dir, rules, _place_edges), "not_tc", "x", "y")


@query("d_four_cycle", f"""WITH e AS ({_SUPPLY}) SELECT DISTINCT a.src AS w, b.src AS x, c.src AS y, d.src AS z FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src JOIN e d ON c.dst = d.src AND d.dst = a.src
WHERE NOT EXISTS (SELECT 1 FROM e g WHERE g.src = c.src AND g.dst = a.src)""")
def d_four_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = (("cycle", ("?W", "?X", "?Y", "?Z")), ("e", ("?W", "?X")), ("e", ("?X", "?Y")), ("!e", ("?Y", "?W")), ("e", ("?Y", "?Z")), ("e", ("?Z", "?W")))
    return _facts(_session(spark, sf_dir, [rule], _supply), "cycle", "w", "x", "y", "z")


@query("d_rule_retract", f"WITH e AS ({_EDGES}) SELECT src AS x, dst AS y FROM e")
def d_rule_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = _session(spark, sf_dir, TC)
    program.saturate()
    program.push_rules({TC[1]: -1})
    return _facts(program, "tc", "x", "y")


@query("d_fact_retract", f"{_tc('WHERE dst % 5 <> 0')} SELECT src AS x, dst AS y FROM r")
def d_fact_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = _session(spark, sf_dir, TC)
    program.saturate()
    gone = _edges(spark, sf_dir).where("dst % 5 = 0").select(F.col("src").alias("c0"), F.col("dst").alias("c1"))
    program.push_facts({"e": z.weighted(gone, -1)})
    return _facts(program, "tc", "x", "y")


def _changed(spark: SparkSession, sf_dir: str, sign: int) -> DataFrame:
    """The change of all paths as a part of the edges comes or goes."""
    cells = [F.col("src").alias("c0"), F.col("dst").alias("c1")]
    edges = _edges(spark, sf_dir)
    part = edges.where("dst % 5 = 0").select(*cells)
    program = _session(spark, sf_dir, TC, (lambda *_: edges.where("dst % 5 <> 0")) if sign > 0 else _edges)
    program.saturate()
    program.push_facts({"e": z.weighted(part, sign)})
    program.saturate()
    found = program.delta.get("tc")
    return _shown((spark.createDataFrame([], "c0 long, c1 long, _w long") if found is None else found).withColumnsRenamed({"c0": "x", "c1": "y"}))


_TC_CHANGE = f"WITH RECURSIVE e AS ({_EDGES}), f AS (SELECT * FROM e WHERE dst % 5 <> 0), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src), " \
    "q(src, dst) AS (SELECT src, dst FROM f UNION SELECT q.src, f.dst FROM q JOIN f ON q.dst = f.src) SELECT src AS x, dst AS y, CAST({} AS BIGINT) AS w FROM (SELECT * FROM r EXCEPT SELECT * FROM q)"


@query("d_fact_insert_delta", _TC_CHANGE.format(1))
def d_fact_insert_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir, 1)


@query("d_fact_delete_delta", _TC_CHANGE.format(-1))
def d_fact_delete_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir, -1)


@query("d_late_blocker", f"WITH e AS ({_EDGES}) SELECT src AS x FROM e UNION SELECT dst FROM e EXCEPT SELECT src FROM e WHERE src % 2 = 0")
def d_late_blocker(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = _session(spark, sf_dir, [*NODES, (("open", ("?X",)), ("node", ("?X",)), ("!blocked", ("?X",)))])
    program.saturate()
    blocked = _edges(spark, sf_dir).where("src % 2 = 0").select(F.col("src").alias("c0")).distinct()
    program.push_facts({"blocked": blocked})
    return _facts(program, "open", "x")


@query("d_levels", "SELECT * FROM (VALUES ('e', 0), ('node', 0), ('tc', 0), ('not_tc', 1), ('lonely', 2)) t(predicate, level)")
def d_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [*TC, *NODES, (("not_tc", ("?X", "?Y")), ("node", ("?X",)), ("node", ("?Y",)), ("!tc", ("?X", "?Y"))), (("lonely", ("?X",)), ("node", ("?X",)), ("!not_tc", ("?X", "?X")))]
    levels = stratify(map(DatalogRule.parse, rules))
    return spark.createDataFrame(sorted(levels.items()), "predicate string, level int")


# -- RDFS -------------------------------------------------------------------------------


_RDFS = """WITH RECURSIVE given(s, p, o) AS (
  SELECT 'n' || n_nationkey, 'sub', 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'sub', 'world' FROM region
  UNION ALL SELECT 'buys', 'subp', 'deals' UNION ALL SELECT 'deals', 'subp', 'knows' UNION ALL SELECT 'deals', 'domain', 'client' UNION ALL SELECT 'buys', 'range', 'ware'
  UNION ALL SELECT 'client', 'sub', 'agent' UNION ALL SELECT 'c' || c_custkey, 'type', 'n' || c_nationkey FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'buys', 'o' || o_orderkey FROM orders {}
), sub(s, o) AS (SELECT s, o FROM given WHERE p = 'sub' UNION SELECT a.s, b.o FROM sub a JOIN given b ON b.p = 'sub' AND a.o = b.s),
subp(s, o) AS (SELECT s, o FROM given WHERE p = 'subp' UNION SELECT a.s, b.o FROM subp a JOIN given b ON b.p = 'subp' AND a.o = b.s),
facts AS (SELECT s, p, o FROM given WHERE p IN ('buys', 'deals', 'knows') UNION SELECT g.s, subp.o, g.o FROM given g JOIN subp ON g.p = subp.s),
typed AS (SELECT s, o FROM given WHERE p = 'type' UNION SELECT f.s, d.o FROM facts f JOIN given d ON d.p = 'domain' AND d.s = f.p UNION SELECT f.o, d.o FROM facts f JOIN given d ON d.p = 'range' AND d.s = f.p)
SELECT s, p, o FROM given UNION SELECT s, 'sub', o FROM sub UNION SELECT s, 'subp', o FROM subp UNION SELECT * FROM facts
UNION SELECT s, 'type', o FROM typed UNION SELECT t.s, 'type', sub.o FROM typed t JOIN sub ON t.o = sub.s"""
_TERMS = Vocabulary("sub", "subp", "domain", "range", "type")


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Schema triples, and those of customers and of orders."""

    def rows(df: DataFrame, s: Column, p: str, o: Column) -> DataFrame:
        return df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))

    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    fixed = [("buys", "subp", "deals"), ("deals", "subp", "knows"), ("deals", "domain", "client"), ("buys", "range", "ware"), ("client", "sub", "agent")]
    tbox = rows(nation, name("n", "n_nationkey"), "sub", name("r", "n_regionkey")).union(rows(region, name("r", "r_regionkey"), "sub", F.lit("world"))).union(spark.createDataFrame(fixed, "s string, p string, o string"))
    clients, deals = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    return tbox, rows(clients, name("c", "c_custkey"), "type", name("n", "c_nationkey")), rows(deals, name("c", "o_custkey"), "buys", name("o", "o_orderkey"))


@query("rdfs_closure", _RDFS.format(""))
def rdfs_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    tbox, clients, deals = _boxes(spark, sf_dir)
    return closure(tbox, clients.union(deals), _TERMS)[0]


@query("rdfs_incremental", _RDFS.format("WHERE o_orderkey % 5 <> 0"))
def rdfs_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, then orders, come as changes; a part of the orders goes again."""
    tbox, clients, deals = _boxes(spark, sf_dir)
    state = Knowledge(spark, _TERMS)
    state.push(tbox, clients)
    state.push(abox=deals)
    state.push(abox=z.weighted(deals.where("CAST(substr(o, 2) AS BIGINT) % 5 = 0"), -1))
    return state.closure()


# -- Structured Streaming ---------------------------------------------------------------


def _as_files(spark: SparkSession, changes: DataFrame, epochs: int = 4) -> str:
    """The changes as a folder to which a file is added per epoch, in order."""
    at = fresh_path(spark, "stream")
    for e in range(epochs):
        changes.where(F.col(EPOCH) == e).drop(EPOCH).coalesce(1).write.mode("append").parquet(at)
    return at


@query("s_stream_groupby", "SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total, CAST(1 AS BIGINT) AS w FROM events WHERE event_id % 10 <> 0 GROUP BY 1")
def s_stream_groupby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A circuit fed by Structured Streaming, a micro-batch per file."""
    from tidemark.streaming.runner import run

    changes = _changes(_table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), "event_id")
    at, circuit = _as_files(spark, changes), Circuit(spark)
    source = circuit.source("events", changes.drop(EPOCH, W).schema)
    source.group_by(["event_type"], agg.count("n"), agg.total("user_id", "total")).view("out")
    stream = spark.readStream.schema(changes.drop(EPOCH).schema).option("maxFilesPerTrigger", 1).parquet(at)
    run(circuit, "events", stream, fresh_path(spark, "checkpoint")).awaitTermination()
    return _shown(circuit.snapshot("out"))


@query("s_window_counts", "SELECT event_type, date_trunc('hour', ts) AS start, CAST(count(*) AS BIGINT) AS w FROM events GROUP BY 1, 2")
def s_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time tumbling windows as a batch query; the same function takes a stream."""
    from tidemark.streaming.runner import windowed

    events = z.weighted(_table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type"))
    found = windowed(events, "ts", "1 hour", keys=["event_type"])
    return _shown(found).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "w")
