"""Sharding by fixed virtual slots.

Every record hashes into one of a few thousand slots; rows and bytes are summed per slot; a small
versioned table says which shard holds which slot. Rebalancing edits that table: slots stay where
they are unless their shard is over its share. Everything is DataFrame expressions; the only rows that
meet in one place are the slots (a fixed number, whatever the data).

A slot comes from key, text and the copy's number: rows that are equal in key and text are numbered within the task that reads them, so that a record that is
a third of all rows is spread over slots like any other rows. Sizes and slots (no texts) are stored once, and all steps read these.

Defined results: null text counts as no bytes; null keys hash like any value; copies of a row are interchangeable (which of them
has which number is left open, the numbers given out aren't); an empty table gives an empty result and an all-zero map; column names of the
input don't clash because only key and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

N_SLOTS = 4096
ROW_OVERHEAD = 16


def sized(df: DataFrame, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS, overhead: int = ROW_OVERHEAD) -> DataFrame:
    """Columns doc_id, size, text_crc32, vslot. The text takes part in the hash, so that a repeated key doesn't fill one slot, and so does a copy's number among
    equal rows of its task, so that a repeated row doesn't either."""
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(raw) + overhead).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(key), F.col(text)).alias("record"),
        F.spark_partition_id().alias("task"),
    )
    copy = F.row_number().over(Window.partitionBy("task", "record").orderBy("size"))
    return rows.withColumn("copy", copy).select("doc_id", "size", "text_crc32", F.pmod(F.xxhash64("record", "copy"), F.lit(n_slots)).cast("int").alias("vslot"))


def slot_loads(rows: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Rows and bytes of every slot, empty ones too: n_slots rows."""
    got = rows.groupBy("vslot").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"))
    every = rows.sparkSession.range(n_slots, numPartitions=1).select(F.col("id").cast("int").alias("vslot"))
    return every.join(got, "vslot", "left").fillna(0, ["n_rows", "n_bytes"])


def first_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 0: slots dealt in turn."""
    return spark.range(n_slots, numPartitions=1).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % n_shards).cast("int").alias("shard"))


def rebalanced(loads: DataFrame, current: DataFrame, n_shards: int) -> DataFrame:
    """The next version of the map. Slots, largest first, stay while their shard is within its share; the rest
    move, largest first, each to the shard that is least loaded then. One row holds all slots (a fixed number)."""
    put = "transform(a.load, (x, i) -> x + IF(i = {shard}, s.n_bytes, 0L))"
    slots = (
        loads.join(current.select("version", "vslot", "shard"), "vslot")
        .agg(F.max("version").alias("version"), F.sum("n_bytes").alias("total"), F.sort_array(F.collect_list(F.struct((-F.col("n_bytes")).alias("o"), "vslot", "n_bytes", "shard"))).alias("slots"))
    )
    stay = f"""aggregate(slots,
        named_struct('load', array_repeat(0L, {n_shards}), 'kept', cast(array() as array<struct<vslot:int,shard:int>>), 'moved', cast(array() as array<struct<vslot:int,n_bytes:bigint>>)),
        (a, s) -> IF(s.shard < {n_shards} AND (a.load[s.shard] + s.n_bytes) * {n_shards} <= total,
            named_struct('load', {put.format(shard='s.shard')}, 'kept', array_append(a.kept, named_struct('vslot', s.vslot, 'shard', s.shard)), 'moved', a.moved),
            named_struct('load', a.load, 'kept', a.kept, 'moved', array_append(a.moved, named_struct('vslot', s.vslot, 'n_bytes', s.n_bytes)))))"""
    least = "cast(array_position(a.load, array_min(a.load)) - 1 as int)"
    move = f"""aggregate(stay.moved, named_struct('load', stay.load, 'kept', stay.kept),
        (a, s) -> named_struct('load', {put.format(shard=least)}, 'kept', array_append(a.kept, named_struct('vslot', s.vslot, 'shard', {least}))))"""
    return slots.select("version", F.expr(stay).alias("stay")).select((F.col("version") + 1).alias("version"), F.inline(F.expr(f"({move}).kept")))


def store_version(path: str, version: DataFrame) -> None:
    """Appends a version of the map to the table at path."""
    version.select("version", "vslot", "shard").coalesce(1).write.mode("append").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def latest(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.schema("version int, vslot int, shard int").parquet(path)
    return table.join(F.broadcast(table.agg(F.max("version").alias("version"))), "version")


def placed(rows: DataFrame, loads: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each row's shard and its place there (slot: gapless from 0). Places are counted within virtual slots and
    moved by the rows of the slots before, so that no shard is ever sorted in one task."""
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = loads.join(slot_map, "vslot").select("vslot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    # offsets has one row per virtual slot: its size is fixed by the number of slots
    return rows.withColumn("nth", F.row_number().over(inside)).join(F.broadcast(offsets), "vslot").withColumn("slot", F.col("first") + F.col("nth") - 1)


def shard_documents(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, path: str | None = None) -> DataFrame:
    """Documents with their shard under the latest map; the map's versions are kept at path."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, "slot-map")
    rows = stored(sized(docs, n_slots=n_slots), "sizes")
    loads = slot_loads(rows, n_slots)
    at = f"{path}/loads"
    loads.coalesce(1).write.mode("overwrite").parquet(at)
    loads = spark.read.schema("vslot int, n_rows bigint, n_bytes bigint").parquet(at)
    if not _exists(spark, f"{path}/map"):
        store_version(f"{path}/map", first_map(spark, n_shards, n_slots))
    store_version(f"{path}/map", rebalanced(loads, latest(spark, f"{path}/map"), n_shards))
    return placed(rows, loads, latest(spark, f"{path}/map"))


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39, sizes near equal."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "vslot")
