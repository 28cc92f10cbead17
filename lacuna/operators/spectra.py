"""Fourier sums of long series: partial sums of batches, added up by Spark, so that no series meets in one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import base
from .series import AT, BY, observed_before

FREQUENCIES = 256


def fourier_sums(rows: DataFrame, columns: Sequence[str], frequencies: int = FREQUENCIES) -> DataFrame:
    """(series, f, <column>_re, <column>_im) for f from 0 to frequencies - 1: sums of the column times cos and -sin of 2 pi f k / n. rows: series, k (from 0), n (rows of the
    series) and the columns, whose nulls count as 0. A task holds a batch's cosines; frequencies above n / 2 repeat lower ones and are left out."""
    import pandas as pd

    names = [f"{c}_{p}" for c in columns for p in ("re", "im")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (series, n), part in batch.groupby(["series", "n"], sort=False):
                f = np.arange(min(frequencies, int(n) // 2 + 1))
                angle = 2 * np.pi * ((part["k"].to_numpy(np.int64)[:, None] * f) % int(n)) / int(n)
                cos, sin = np.cos(angle), np.sin(angle)
                out = {"series": series, "n": n, "f": f}
                for c in columns:
                    x = part[c].fillna(0.0).to_numpy(float)
                    out |= {f"{c}_re": x @ cos, f"{c}_im": -(x @ sin)}
                yield pd.DataFrame(out)

    parts = rows.select("series", F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"), *(F.col(c).cast("double").alias(c) for c in columns))
    sums = parts.mapInPandas(run, f"series string, n long, f int, {', '.join(f'{c} double' for c in names)}")
    return sums.groupBy("series", "n", "f").agg(*(F.sum(c).alias(c) for c in names))


def spectral_error(df: DataFrame, truth: str, filled: str, frequencies: int = 64) -> DataFrame:
    """(series, spectral_rmse): root mean square difference of the amplitudes of the first frequencies before and after a fill. Rows are numbered from 1."""
    n = df.groupBy(BY).agg(F.count(F.lit(1)).alias("n"))
    # one row a series
    rows = df.join(n, BY).select(F.col(BY).cast("string").alias("series"), (F.col(AT) - 1).alias("k"), "n", F.col(truth).alias("a"), F.col(filled).alias("b"))
    amplitude = {c: F.sqrt(F.pow(f"{c}_re", F.lit(2)) + F.pow(f"{c}_im", F.lit(2))) for c in "ab"}
    return fourier_sums(rows, ["a", "b"], frequencies).groupBy("series").agg(F.sqrt(F.avg(F.pow(amplitude["a"] - amplitude["b"], F.lit(2)))).alias("spectral_rmse"))


def fourier(df: DataFrame, x: str, terms: int = 10, frequencies: int = FREQUENCIES) -> DataFrame:
    """(series, i, filled): gaps from the strongest of the first frequencies of the observed values in order, evaluated at each row. A series without observed values stays null."""
    rows = base(df, x).withColumn("series", F.col("series").cast("string"))
    seen = observed_before(rows, "x", "k").filter("x is not null").withColumn("k", F.col("k") - 1)
    stats = rows.groupBy("series").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.min("i").alias("first")).filter("n > 0")
    sums = fourier_sums(seen.join(stats, "series").select("series", "k", "n", (F.col("x") - F.col("mean")).alias("y")), ["y"], frequencies)
    power = F.round(F.pow("y_re", F.lit(2)) + F.pow("y_im", F.lit(2)), 6)
    best = sums.withColumn("rank", F.row_number().over(Window.partitionBy("series").orderBy(F.desc(power), "f"))).filter(F.col("rank") <= terms)
    waves = best.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("rank", "f", "y_re", "y_im"))).alias("w"))  # at most `terms`
    known = rows.join(stats.join(waves, "series"), "series", "left")
    t = F.col("i") - F.col("first")

    def wave(w):
        angle = 2 * F.pi() * F.pmod(w["f"] * t, F.col("n")) / F.col("n")
        once = (w["f"] == 0) | (2 * w["f"] == F.col("n"))
        return F.when(once, 1.0).otherwise(2.0) / F.col("n") * (F.cos(angle) * w["y_re"] - F.sin(angle) * w["y_im"])

    value = F.col("mean") + F.aggregate("w", F.lit(0.0), lambda a, w: a + wave(w))
    return known.select("series", "i", F.coalesce("x", value).alias("filled"))
