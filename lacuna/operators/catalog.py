"""Catalogue tables as append-only Parquet: the newest row of a key counts; audit rows, caches, provenance."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import kept


class Table:
    """A keyed table at a path. Writes append a version; reads keep the newest row of each key. Deletes are rows too."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str]):
        self.spark, self.path, self.key = spark, path, list(key)

    def exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _append(self, rows: DataFrame, action: str) -> None:
        rows.withColumns({"at__": F.current_timestamp(), "version__": F.lit(self.version() + 1), "action__": F.lit(action)}).write.mode("append").parquet(self.path)

    def version(self) -> int:
        return (self.spark.read.parquet(self.path).agg(F.max("version__")).first()[0] or 0) if self.exists() else 0

    def upsert(self, rows: DataFrame) -> None:
        self._append(rows, "upsert")

    def delete(self, keys: DataFrame) -> None:
        self._append(keys, "delete")

    def history(self) -> DataFrame:
        """The audit log: every action on every key."""
        return self.spark.read.option("mergeSchema", True).parquet(self.path)

    def read(self) -> DataFrame:
        w = Window.partitionBy(*self.key).orderBy(F.desc("version__"))
        return self.history().withColumn("r__", F.row_number().over(w)).filter("r__ = 1 and action__ <> 'delete'").drop("r__", "version__", "action__", "at__")

    def compact(self, keep: int, to: str) -> None:
        """The newest `keep` versions of each key, written to a new path."""
        w = Window.partitionBy(*self.key).orderBy(F.desc("version__"))
        self.history().withColumn("r__", F.row_number().over(w)).filter(F.col("r__") <= keep).drop("r__").write.parquet(to)


def fresh(entries: DataFrame, now, max_age_days: int = 30) -> DataFrame:
    return entries.filter(F.col("last_accessed") >= now - F.expr(f"interval '{max_age_days}' day"))


def evicted(entries: DataFrame, need: int) -> DataFrame:
    """The least recently used entries whose sizes free `need` bytes. Entries are dealt to ranges of their order and stored, since ranges are sampled; what a range
    frees is a small table, and sums run within a range only."""
    n, columns = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), entries.columns
    cut = kept(entries.repartitionByRange(n, "last_accessed", "key").withColumn("range__", F.spark_partition_id()), "entries")
    sums = kept(cut.groupBy("range__").agg(F.sum("size").alias("s__")), "sums")
    earlier = F.sum("s__").over(Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(F.col("range__").alias("r__"), F.coalesce(earlier, F.lit(0)).alias("start__"))  # a row for each range
    before = F.sum("size").over(Window.partitionBy("range__").orderBy("last_accessed", "key").rowsBetween(Window.unboundedPreceding, -1))
    placed = cut.withColumn("freed__", F.coalesce(before, F.lit(0))).join(F.broadcast(starts), F.col("range__") == F.col("r__"))
    return placed.filter(F.col("freed__") + F.col("start__") < need).select(*columns)


def content_hash(df: DataFrame) -> DataFrame:
    """One row: a hash of the rows that doesn't depend on their order, and their number. Sums of 64-bit hashes are decimal: they can't overflow."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("total"), F.bit_xor(h).alias("mixed")).select("n", F.sha2(F.concat_ws("|", "n", "total", "mixed"), 256).alias("hash"))


def intact(spark: SparkSession, root: str, known: DataFrame, name: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path, ok): whether each file under root still has the content of its stored hash (known: path, hash); null where there is no such file. Files are
    hashed by the executors and joined by path, relative to root unless `name` derives it from the full path."""
    full = F.col("path")
    path = name(full) if name else F.regexp_replace(full, "^.*" + re.escape(root.rstrip("/").rsplit("/", 1)[-1]) + "/", "")
    now = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(path.alias("path"), F.sha2("content", 256).alias("now"))
    return known.join(now, "path", "left").select("path", (F.col("now") == F.col("hash")).alias("ok"))


def active_jobs(jobs: DataFrame, datasets: DataFrame, projects: DataFrame) -> DataFrame:
    """jobs (dataset, status, priority, created) with their datasets (dataset, project) and projects (project), pending first by priority."""
    return jobs.filter(F.col("status").isin("pending", "running")).join(datasets, "dataset").join(projects, "project").orderBy(F.desc("priority"), "created", "job")


def recommendations(stats: DataFrame) -> DataFrame:
    """(name, method, suitability) from missing share, seasonality and spatial correlation; best first."""
    rules = F.array(
        F.struct(F.lit("adaptive").alias("method"), F.lit(0.95).alias("suitability")),
        F.when(F.col("seasonality") > 0.3, F.struct(F.lit("seasonal").alias("method"), F.lit(0.85).alias("suitability"))),
        F.when(F.col("moran") > 0.3, F.struct(F.lit("kriging").alias("method"), F.lit(0.80).alias("suitability"))),
        F.when(F.col("missing") > 0.3, F.struct(F.lit("low_rank").alias("method"), F.lit(0.75).alias("suitability"))))
    return stats.select("name", F.inline(F.filter(rules, lambda x: x.isNotNull()))).orderBy("name", F.desc("suitability"))
