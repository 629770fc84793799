"""Queries read whole tables: no key range, no folded ids."""

from tidemark import catalog


def test_no_sql_cuts_its_tables():
    for name, sql in catalog.ORACLE_SQL.items():
        for cut in ("<= 60", "% 300", "src < ", "<= 40", "<= 20", "% 3 = 0 ", "% 20 = 0", "LIMIT"):
            assert cut not in sql or name in ("z_heartbeat",), (name, cut)


def test_whole_edges(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert catalog.QUERIES["d_rule_retract"](spark, sf_dir).count() == items.selectExpr("l_orderkey*7+l_linenumber", "l_partkey*13+l_suppkey").distinct().count()


def test_whole_set_operands(spark, sf_dir):
    left = sum(spark.read.parquet(f"{sf_dir}/{t}.parquet").where(f"{k} % 10 <> 0").count() for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey")))
    assert sum(r.w for r in catalog.QUERIES["z_union_all"](spark, sf_dir).collect()) == left


def test_whole_abox(spark, sf_dir):
    found = catalog.QUERIES["rdfs_closure"](spark, sf_dir)
    assert found.where("p = 'buys'").count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert found.where("p = 'type' AND s LIKE 'c%'").select("s").distinct().count() == spark.read.parquet(f"{sf_dir}/customer.parquet").count()


def test_cycles_are_found(spark, sf_dir):
    assert catalog.QUERIES["d_four_cycle"](spark, sf_dir).count() > 0 and catalog.QUERIES["d_unify"](spark, sf_dir).count() > 0
