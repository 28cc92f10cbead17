"""Where and why values are missing: mechanisms, structure, simulated missingness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import AT, BY, gaps


def pattern_uniformity(df: DataFrame, pattern: Column) -> DataFrame:
    """Simplified randomness test: chi-square of pattern counts against equal counts."""
    counts = df.groupBy(pattern.alias("pattern")).count()
    total = counts.agg(F.avg("count").alias("e"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(total)).agg((F.sum(F.pow(F.col("count") - F.col("e"), 2) / F.col("e"))).alias("chi2"), (F.first("k") - 1).alias("df"))


def indicator_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of each column's missing flag with each other column."""
    pairs = [(a, b) for a in columns for b in columns if a != b]
    one = df.agg(*(F.corr(F.when(F.col(b).isNotNull(), F.col(a).isNull().cast("double")), b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("target"), F.lit(b).alias("other"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))))


def mechanism(strongest: Column) -> Column:
    return F.when(strongest < 0.1, "MCAR").when(strongest < 0.5, "MAR").otherwise("MNAR")


def pooled_t(df: DataFrame, flag: str, value: str) -> Column:
    """Pooled two-sample t of value between rows where flag is missing and where it isn't, as an aggregate."""
    a, b = F.when(F.col(flag).isNull(), F.col(value)), F.when(F.col(flag).isNotNull(), F.col(value))
    n, m = F.count(a), F.count(b)
    pooled = ((n - 1) * F.var_samp(a) + (m - 1) * F.var_samp(b)) / (n + m - 2)
    return (F.avg(a) - F.avg(b)) / F.sqrt(pooled * (1 / n + 1 / m))


def structure(df: DataFrame, x: str, burst: int = 5) -> DataFrame:
    """Gap statistics and a class per series."""
    g = gaps(df, x).groupBy(BY).agg(
        F.count(F.lit(1)).alias("n_gaps"), F.avg("length").alias("mean_gap"), F.max("length").alias("max_gap"), F.sum("length").alias("missing"),
        F.avg((F.col("length") > burst).cast("double")).alias("burst_ratio"), F.stddev_pop("length").alias("sd_gap"))
    n = df.groupBy(BY).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col(x).isNotNull(), F.col(AT))).alias("last_seen"))
    kind = F.when(F.col("n_gaps").isNull(), "none").when((F.col("n_gaps") == 1) & (F.col("last_seen") + F.col("missing") == F.col("n")), "monotonic").when(F.col("burst_ratio") > 0.5, "burst")
    kind = kind.when((F.col("sd_gap") < 0.5 * F.col("mean_gap")) & (F.col("mean_gap") > 1), "periodic").when(F.col("max_gap") <= 2, "random").otherwise("mixed")
    return n.join(g, BY, "left").withColumn("kind", kind).drop("last_seen", "sd_gap")


def mcar(id_: Column, rate: float, seed: int = 0) -> Column:
    """Deterministic mask that SQL engines share: a multiplicative hash of the id."""
    return F.pmod((id_ + seed) * 2654435761, F.lit(1000)) < int(rate * 1000)


def mnar(x: Column, cut: Column, id_: Column, rate: float) -> Column:
    """Values above the cut are missing three times as often (at most 80 %)."""
    return F.when(x > cut, mcar(id_, min(0.8, 3 * rate))).otherwise(mcar(id_, rate))


def blocks(i: Column, every: int, size: int) -> Column:
    return F.pmod(i, F.lit(every)) < size


def decaying(distance: Column, scale: float, id_: Column, rate: float) -> Column:
    """Missing with a chance that falls with distance."""
    return F.pmod(id_ * 2654435761, F.lit(1000)) < rate * 1000 * F.exp(-distance / scale)
