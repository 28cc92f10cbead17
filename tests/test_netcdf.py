"""NetCDF classic: written and read back, and files made byte by byte."""

import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.sources import netcdf as N


def test_round_trip_by_record_ranges(spark, tmp_path):
    path = str(tmp_path / "a")
    df = spark.range(1000, numPartitions=3).select(
        F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 60).alias("time"), (F.col("id") / 3).alias("v"), F.when(F.col("id") % 7 != 0, F.col("id").cast("int")).alias("n"),
        F.col("id").cast("float").alias("f"), (F.col("id") % 100).cast("smallint").alias("s"), (F.col("id") % 50).cast("tinyint").alias("b"))
    N.write_netcdf(df, path)
    got = N.read_netcdf(spark, path, rows=64)
    assert dict(got.dtypes) == {"time": "timestamp", "v": "double", "n": "int", "f": "float", "s": "smallint", "b": "tinyint"}
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(map(tuple, df.collect()), key=lambda r: r[0])
    assert got.rdd.getNumPartitions() == sum(-(-n // 64) for n in (333, 333, 334))
    assert N.read_netcdf(spark, path, ["s", "v"]).columns == ["s", "v"]
    N.write_netcdf(df.limit(5), path, mode="overwrite")
    assert N.read_netcdf(spark, path).count() == 5
    with pytest.raises(Exception, match="no type for"):
        N.write_netcdf(spark.range(3), str(tmp_path / "b"))


def padded(raw):
    return struct.pack(">I", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def test_a_file_with_a_fixed_time_and_other_variables(spark, tmp_path):
    """CDF-1, time of length 4, a variable over two dimensions, text, and a fill value of its own."""
    w = lambda *n: struct.pack(">" + "I" * len(n), *n)
    units = b"hours since 2020-01-01 00:00:00"

    def head(a, b, c):
        return (b"CDF\x01" + w(0) + w(10, 2) + padded(b"time") + w(4) + padded(b"x") + w(2) + w(0, 0) + w(11, 3)
                + padded(b"time") + w(1, 0) + w(12, 1) + padded(b"units") + w(2) + padded(units) + w(4, 16) + w(a)
                + padded(b"grid") + w(2, 0, 1) + w(0, 0) + w(6, 64) + w(b)
                + padded(b"v") + w(1, 0) + w(12, 1) + padded(b"_FillValue") + w(5, 1) + struct.pack(">f", -1.0) + w(5, 16) + w(c))

    n = len(head(0, 0, 0))
    raw = head(n, n + 16, n + 80) + np.arange(4, dtype=">i4").tobytes() + np.zeros(8, ">f8").tobytes() + np.array([1.5, -1.0, np.nan, 2.5], ">f4").tobytes()
    (tmp_path / "f.nc").write_bytes(raw)
    got = sorted(map(tuple, N.read_netcdf(spark, str(tmp_path / "f.nc"), rows=3).collect()))
    assert got == [(datetime(2020, 1, 1, h), v) for h, v in enumerate((1.5, None, None, 2.5))]


def test_what_is_not_netcdf(spark, tmp_path):
    (tmp_path / "x.nc").write_bytes(b"HDF5 or so")
    with pytest.raises(ValueError, match="not a NetCDF"):
        N.header_of(str(tmp_path / "x.nc"))
    (tmp_path / "y.nc").write_bytes(b"CDF\x01\0\0")
    with pytest.raises(ValueError, match="cut off"):
        N.header_of(str(tmp_path / "y.nc"))
