"""What the operators on vectors share: whole-number components and exact sums in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whole numbers below this are exact as doubles, and so are sums of products that stay below it.
EXACT = 2.0**53


def whole_numbers(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v array<bigint>): floor(256 * x) of each component, as double. Rows whose vector is null or holds a null or
    non-finite component are left out."""
    v = F.col(vector)
    plain = v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return df.filter(plain).select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.transform(v, lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v"))


def matrix(column, width: int) -> np.ndarray:
    """An Arrow list column as whole numbers of `width` columns; shorter vectors end in zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(flat) == width * len(column):
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    lengths = np.diff(ends, prepend=0)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two whole-number matrices, exact: as doubles while no sum can pass 2**53, as 64-bit numbers beyond."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    within_64_bits(top)
    return a @ b.T


def within_64_bits(top: float) -> None:
    if top >= 2.0**62:
        raise ValueError("vector components are too large for exact sums in 64 bits")


def arrow_schema(ddl: str):
    """A schema in words as Arrow's; made on the driver and sent to tasks."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 32) -> Iterator[None]:
    """Jobs started within send Python workers so many rows at a time: for rows that are whole blocks. The session's setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
