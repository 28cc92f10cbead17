"""How good an imputation is: errors, preservation, intervals, folds, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import errors


def point_metrics(y: str, p: str) -> dict[str, Column]:
    e, n = errors(F.col(y), F.col(p)), F.count(F.lit(1))
    sst = F.var_pop(y) * n
    return {
        "n": n, "mae": F.avg(e["ae"]), "rmse": F.sqrt(F.avg(e["se"])), "mape": F.avg(e["ape"]), "smape": F.avg(e["sape"]), "bias": F.avg(e["bias"]), "median_bias": F.median(e["bias"]),
        "pearson": F.corr(y, p), "r2": 1 - F.sum(e["se"]) / F.when(sst > 0, sst), "explained": 1 - F.var_pop(e["bias"]) / F.when(F.var_pop(y) > 0, F.var_pop(y)), "var_ratio": F.var_pop(p) / F.when(F.var_pop(y) > 0, F.var_pop(y))}


def average_ranks(df: DataFrame, group: str, c: str, out: str) -> DataFrame:
    """Average ranks by counting values first."""
    counts = df.groupBy(group, c).count()
    w = Window.partitionBy(group).orderBy(c)
    ranks = counts.withColumn(out, F.sum("count").over(w) - (F.col("count") - 1) / 2).select(group, c, out)
    return df.join(ranks, [group, c])


def spearman(df: DataFrame, group: str, y: str, p: str) -> DataFrame:
    d = average_ranks(average_ranks(df.select(group, y, p), group, y, "ry"), group, p, "rp")
    return d.groupBy(group).agg(F.corr("ry", "rp").alias("spearman"))


def ks(df: DataFrame, group: str, y: str, p: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance between y and p."""
    both = df.select(group, F.col(y).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(df.select(group, F.col(p).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = both.filter("v is not null").groupBy(group, "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w, every = Window.partitionBy(group).orderBy("v"), Window.partitionBy(group)
    d = F.abs(F.sum("a").over(w) / F.sum("a").over(every) - F.sum("b").over(w) / F.sum("b").over(every))
    return counts.withColumn("d", d).groupBy(group).agg(F.max("d").alias("ks"))


def mase(df: DataFrame, group: str, order: str, y: str, p: str, missing: str) -> DataFrame:
    """Mean absolute error at missing rows over the mean absolute step of the truth."""
    step = F.abs(F.col(y) - F.lag(y).over(Window.partitionBy(group).orderBy(order)))
    d = df.withColumn("step", step)
    return d.groupBy(group).agg((F.avg(F.when(F.col(missing).isNull(), F.abs(F.col(y) - F.col(p)))) / F.avg("step")).alias("mase"))


def interval_metrics(y: str, lo: str, hi: str, alpha: float = 0.05) -> dict[str, Column]:
    v, a, b = F.col(y), F.col(lo), F.col(hi)
    miss = F.when(v < a, a - v).when(v > b, v - b).otherwise(0.0)
    return {"coverage": F.avg(v.between(a, b).cast("int")), "sharpness": F.avg(b - a), "interval_score": F.avg(b - a + 2 / alpha * miss)}


def preservation(df: DataFrame, group: str, x: str, filled: str) -> DataFrame:
    """Relative change of mean, deviation, skewness and kurtosis (population), and the share filled."""
    a, b = F.col(x), F.col(filled)
    rel = lambda f: F.abs(f(b) - f(a)) / (F.abs(f(a)) + 1e-10)
    return df.groupBy(group).agg(
        rel(F.avg).alias("mean_change"), rel(F.stddev_pop).alias("sd_change"), rel(F.skewness).alias("skew_change"), rel(F.kurtosis).alias("kurt_change"),
        (F.count_if(a.isNull() & b.isNotNull()) / F.when(F.count_if(a.isNull()) > 0, F.count_if(a.isNull()))).alias("filled_share"),
        F.count_if(a.isNull() & ((b < F.lit(0)) | b.isNull())).alias("implausible"))


def folds(df: DataFrame, group: str, order: str, k: int = 5) -> DataFrame:
    """Expanding time folds: row in block f (1..k) is tested with all blocks before as training. Fold 0 only trains."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    return df.withColumn("fold", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) * (k + 1) / n).cast("long"))


def bootstrap(df: DataFrame, group: str, error: str, replicates: int = 200, seed: int = 7) -> DataFrame:
    """Percentile interval of the mean error: Poisson(1) weights per row and replicate, so that replicates need no resampling.
    Rows are aggregated map-side by (group, replicate)."""
    import math

    steps, total = [], 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        steps.append(total)
    u = F.pmod(F.xxhash64("row", "b", F.lit(seed)), F.lit(1_000_000)) / 1e6
    weight = sum((u >= s).cast("int") for s in steps)
    rows = df.filter(F.col(error).isNotNull()).select(group, F.col(error).alias("e"), F.xxhash64(*df.columns).alias("row"))
    rows = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight)
    means = rows.groupBy(group, "b").agg((F.sum(F.col("w") * F.col("e")) / F.sum("w")).alias("m"))
    return means.groupBy(group).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"), F.avg("m").alias("mean"))
