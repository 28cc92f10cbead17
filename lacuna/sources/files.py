"""Reading and writing tables. Missing tokens, NaN and unparseable numbers become NULL once, here."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Format by file extension; anything else is read as CSV.
FORMATS = {
    "csv": "csv", "tsv": "csv", "txt": "csv", "parquet": "parquet", "json": "json", "jsonl": "jsonl", "orc": "orc",
    "xlsx": "excel", "xls": "excel", "nc": "netcdf", "netcdf": "netcdf", "h5": "hdf5", "hdf5": "hdf5", "arrow": "arrow", "feather": "arrow"}
NA_TOKENS = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "-")
SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the cluster's shared folder, spark.checkpoint.dir; only where that is unset (one machine), under a local one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_lacuna_scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.sparkContext._lacuna_scratch = tempfile.mkdtemp(prefix="lacuna-")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class NotSupported(Exception):
    """A format whose reader isn't installed."""


def format_of(path: str) -> str:
    parts = [x for x in PurePosixPath(path).name.lower().split(".")[1:] if x not in ("gz", "bz2", "zst", "snappy")]
    return FORMATS.get(parts[-1] if parts else "", "csv")


def as_number(c: str, na: Sequence[str] = NA_TOKENS) -> Column:
    """The column as double: missing tokens, text and NaN are NULL; booleans are 1 and 0."""
    t = F.trim(F.col(c).cast("string"))
    x = F.when(F.lower(t) == "true", 1.0).when(F.lower(t) == "false", 0.0).otherwise(t.try_cast("double"))
    return F.when(~t.isin(*na) & ~F.isnan(x), x)


def as_time(c: str) -> Column:
    """Timestamps in the usual forms, or seconds since 1970; what can't be read is NULL."""
    t = F.col(c).cast("string")
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in forms), F.timestamp_seconds(F.when(t.rlike(r"^\d{9,10}(\.\d+)?$"), t.try_cast("double"))))


def cf_time(c: str, units: str) -> Column:
    """`<unit> since <base>` numbers as timestamps."""
    unit, _, base = units.partition(" since ")
    if unit not in SECONDS or not base:
        raise ValueError(f"unknown time units: {units}")
    return F.timestamp_seconds(F.unix_timestamp(F.lit(base).cast("timestamp")) + F.col(c) * SECONDS[unit])


def read(spark: SparkSession, path: str, *, date_column: str | None = None, columns: Sequence[str] | None = None, delimiter: str | None = None, header: bool = True, na: Sequence[str] = NA_TOKENS, numbers: bool = True) -> DataFrame:
    """A table by its extension. Columns keep the order of the request; with `numbers` all but the date column become doubles; without a date
    column rows get none (file order isn't kept by Spark: number rows by a column of your own)."""
    kind = format_of(path)
    if kind == "csv":
        sep = delimiter or ("\t" if path.lower().endswith((".tsv", ".tsv.gz")) else ",")
        df = spark.read.option("header", header).option("sep", sep).csv(path)
    elif kind == "parquet":
        df = spark.read.parquet(path)
    elif kind == "orc":
        df = spark.read.orc(path)
    elif kind == "jsonl":
        df = spark.read.json(path)
    elif kind == "json":
        df = rows_of_json(spark.read.option("multiLine", True).json(path))
    elif kind == "excel":
        df = excel(spark, path)
    elif kind == "netcdf":
        from .netcdf import read_netcdf

        df = read_netcdf(spark, path, time=date_column)
    elif kind == "arrow":
        import pyarrow.feather as feather

        df = spark.createDataFrame(feather.read_table(path))
    else:
        raise NotSupported(f"{kind} needs a reader that isn't installed")
    names = list(columns) if columns else df.columns
    if columns and date_column and date_column not in names:
        names = [date_column, *names]
    if unknown := [c for c in names if c not in df.columns]:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    kinds = dict(df.dtypes)
    return df.select(*((F.col(c).cast("timestamp") if kinds[c].startswith("timestamp") else as_time(c)).alias(c) if c == date_column else as_number(c, na).alias(c) if numbers else F.col(c) for c in names))


def rows_of_json(df: DataFrame) -> DataFrame:
    """Rows of an array of objects, of {data: [...]}, or of {column: [...]}."""
    kinds = dict(df.dtypes)
    if list(kinds) == ["data"] and kinds["data"].startswith("array<struct"):
        return df.select(F.inline("data"))
    if kinds and all(t.startswith("array<") for t in kinds.values()):
        return df.select(F.inline(F.arrays_zip(*kinds)))
    return df


def excel(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    import pandas as pd

    try:
        return spark.createDataFrame(pd.read_excel(path, sheet_name=0, skiprows=skip))
    except ImportError as e:
        raise NotSupported("excel needs openpyxl") from e


def read_many(spark: SparkSession, paths: Sequence[str], **options) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(frames by path, errors by path): a source that fails doesn't stop the others."""
    good, bad = {}, {}
    for p in paths:
        try:
            good[p] = read(spark, p, **options)
        except Exception as e:  # noqa: BLE001  the error is the result
            bad[p] = str(e).splitlines()[0]
    return good, bad


def partition_profile(df: DataFrame) -> DataFrame:
    """Rows and missing cells by input split."""
    miss = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    return df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"), F.sum(miss).alias("missing"))


def synthetic(spark: SparkSession, hours: int, stations: int = 20, seed: int = 42, noise: float = 3.0) -> DataFrame:
    """(station, i, ts, value): daily and weekly waves, a decaying station effect, a trend, noise; never negative."""
    d = spark.range(hours).select(F.col("id").alias("i")).crossJoin(F.broadcast(spark.range(stations).select(F.col("id").alias("station"))))
    t = F.col("i")
    v = (50 + 15 * F.sin(2 * F.pi() * t / 24) + 8 * F.sin(2 * F.pi() * t / 168)) * F.exp(-F.col("station") / 20) + 5 * t / hours + noise * F.randn(seed)
    return d.select(F.col("station").cast("string").alias("station"), "i", F.timestamp_seconds(1672531200 + t * 3600).alias("ts"), F.greatest(v, F.lit(0.0)).alias("value"))


def register(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def to_ipc(df: DataFrame) -> bytes:
    """A (small) frame as an Arrow stream."""
    import pyarrow as pa

    t = df.toArrow()
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    return out.getvalue().to_pybytes()


def from_ipc(spark: SparkSession, raw: bytes) -> DataFrame:
    import pyarrow as pa

    return spark.createDataFrame(pa.ipc.open_stream(raw).read_all())


def write(df: DataFrame, path: str, kind: str | None = None, *, mode: str = "error", precision: int | None = 6, date_format: str = "yyyy-MM-dd'T'HH:mm:ssXXX", na: str = "", delimiter: str = ",", compression: str | None = None) -> None:
    """A frame by format or extension; unknown ones are CSV."""
    kind = kind or format_of(path)
    if precision is not None and kind in ("csv", "json"):
        df = df.select(*(F.round(c, precision).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
    w = df.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    if kind == "csv":
        w.option("header", True).option("sep", delimiter).option("nullValue", na).option("timestampFormat", date_format).csv(path)
    elif kind in ("json", "jsonl"):
        w.option("timestampFormat", date_format).option("ignoreNullFields", False).json(path)
    elif kind == "parquet":
        w.parquet(path)
    elif kind == "orc":
        w.orc(path)
    elif kind == "netcdf":
        from .netcdf import write_netcdf

        write_netcdf(df, path, mode="overwrite" if mode == "overwrite" else "append")
    else:
        raise NotSupported(f"{kind} can't be written here")


def metadata(df: DataFrame, ts: str | None = None) -> DataFrame:
    """One row: a JSON description (shape, variables, time range, missing cells)."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint")]
    miss = sum((F.count_if(F.col(c).isNull()) for c in numeric), F.lit(0))
    span = [F.min(ts).cast("string").alias("first"), F.max(ts).cast("string").alias("last")] if ts else []
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), miss.alias("missing"), *span)
    return one.select(F.to_json(F.struct("n_rows", F.lit(len(numeric)).alias("n_variables"), F.array(*map(F.lit, numeric)).alias("variables"), "missing", *[x for x in ("first", "last") if ts])).alias("metadata"))


def split_json(df: DataFrame, order: str, columns: Sequence[str], most: int = 100_000) -> str:
    """The split form {columns, index, data} of a frame of at most `most` rows."""
    rows = df.select(order, *columns).orderBy(order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return json.dumps({"columns": list(columns), "index": [r[order] for r in rows], "data": [[r[c] for c in columns] for r in rows]}, default=str)


def latest(df: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    return df.withColumn("r__", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version)))).filter("r__ = 1").drop("r__")
