"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_LOCAL_FALLBACK: dict[str, str] = {}
_TABLES: dict[int, tuple[weakref.ref, str]] = {}


def local_session(cores: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "6g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship_package(spark)


def ship_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package.

    Python workers get the path of this checkout. On a cluster whose nodes do not have
    the checkout at the same path, submit the package with ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset (tests, one machine) a temporary folder stands in; with a cluster
    master that would be a machine-local folder, so it is refused.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = sc.applicationId
    if key not in _LOCAL_FALLBACK:
        import atexit

        _LOCAL_FALLBACK[key] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _LOCAL_FALLBACK[key], True)
    return f"file://{_LOCAL_FALLBACK[key]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nobody else writes to, in the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as a table in the shared folder and reread it.

    Unlike ``localCheckpoint`` the result survives the loss of executors, and the reader
    knows the table's true size, so joins with it are planned on a checked size.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _TABLES[id(table)] = (weakref.ref(table), path)
    return table


#: Rows of a table that one task holds, so that a task's memory does not grow with the table.
TASK_ROWS = 2**20


def buckets(*tables: DataFrame) -> int:
    """How many buckets tables from :func:`materialize` need: the session's partitions, more where rows are many."""
    spark = tables[0].sparkSession
    rows = sum(t.count() for t in tables)  # read from the files' footers
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def bucketed(df: DataFrame, keys: Sequence[str], n: int, name: str) -> DataFrame:
    """Like :func:`materialize`, with the rows dealt by key over ``n`` buckets: joins and
    groupings by the keys read such a table, and unions of such tables, without a shuffle.

    The catalog, which alone can say so, holds the table while it is written.
    """
    spark = df.sparkSession
    path, table_name = fresh_path(spark, name), f"tidemark_{uuid.uuid4().hex}"
    columns = [F.col(f"`{k}`") for k in keys]
    writer = df.repartition(n, *columns).write.bucketBy(n, *keys).format("parquet")
    writer.option("path", path).option("compression", "zstd").saveAsTable(table_name)
    table = spark.table(table_name)
    spark.sql(f"DROP TABLE `{table_name}`")  # an external table: its files stay
    _TABLES[id(table)] = (weakref.ref(table), path)
    return table


def unseen(found: DataFrame, known: Sequence[DataFrame], keys: Sequence[str], n: int) -> DataFrame:
    """Distinct rows of ``found`` that no known table has; only ``found`` is shuffled if those are bucketed by the keys."""
    names = found.columns
    dealt = found.repartition(n, *(F.col(f"`{k}`") for k in keys))
    if not known:
        return dealt.distinct()
    marked = dealt.withColumn("_seen", F.lit(0))
    for k in known:
        marked = marked.unionByName(k.select(*(F.col(f"`{c}`") for c in names)).withColumn("_seen", F.lit(1)))
    return marked.groupBy(*(F.col(f"`{c}`") for c in names)).agg(F.max("_seen").alias("_seen")).where(F.col("_seen") == 0).drop("_seen")


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` made, once all that was planned on them is written."""
    for table in tables:
        held, path = _TABLES.pop(id(table), (None, None))
        if held is not None and held() is table:
            forget(table.sparkSession, path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table made by :func:`materialize`, through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
