"""The frames that the queries share, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from ..sources.files import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
GAP = "event_id % 7 = 3 OR event_id % 50 BETWEEN 10 AND 19"
G = f"""g AS (SELECT event_type AS series, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS i,
  event_id, ts, user_id, value AS truth, CASE WHEN {GAP} THEN NULL ELSE value END AS x FROM events)"""
#: Several variables of one frame, with gaps of their own.
L = """l AS (SELECT CAST(l_orderkey * 100 + l_linenumber AS BIGINT) AS r, l_returnflag AS flag, l_shipdate AS ts,
  CASE WHEN (l_orderkey + l_linenumber) % 9 = 2 THEN NULL ELSE l_quantity END AS a,
  CASE WHEN (l_orderkey * 3 + l_linenumber) % 11 = 5 THEN NULL ELSE l_extendedprice / 1000 END AS b,
  CASE WHEN l_partkey % 13 = 4 THEN NULL ELSE l_discount * 100 END AS c FROM lineitem)"""


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as gappy series: series, i, event_id, ts, user_id, truth, x."""
    files = tuple(sorted((f.getPath().toString(), f.getModificationTime(), f.getLen()) for f in _statuses(spark, f"{sf_dir}/events.parquet")))
    known = spark.__dict__.setdefault("_lacuna_sensors", {})
    if files not in known or not _exists(spark, known[files]):
        rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), "event_id", "ts", "user_id", F.col("value").alias("truth"), F.when(~F.expr(GAP), F.col("value")).alias("x"))
        known[files] = scratch(spark, "sensors")
        numbered(rows, ["series"], ["ts", "event_id"]).select("series", "i", "event_id", "ts", "user_id", "truth", "x").write.parquet(known[files])
    return spark.read.parquet(known[files])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _statuses(spark: SparkSession, path: str):
    """What the file system says of a table's files: the numbered frame is made once a session for each state of them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f for s in [fs.getFileStatus(p)] for f in (fs.listStatus(p) if s.isDirectory() else [s])]


def variables(spark: SparkSession, sf_dir: str, number: bool = True) -> DataFrame:
    """lineitem as a frame of three gappy variables a, b, c. r is the row's key, order and line."""
    t = table(spark, sf_dir, "lineitem")
    cols = [
        F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("ts"),
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 9 != 2, F.col("l_quantity")).alias("a"),
        F.when((F.col("l_orderkey") * 3 + F.col("l_linenumber")) % 11 != 5, F.col("l_extendedprice") / 1000).alias("b"),
        F.when(F.col("l_partkey") % 13 != 4, F.col("l_discount") * 100).alias("c")]
    if number:
        cols = [(F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("long").alias("r"), *cols]
    return t.select(*cols)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with every double rounded, so that two engines' last bits don't count."""
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def r6(*names: str, digits: int = 6) -> str:
    """round(name, 6) AS name, for SQL."""
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)
