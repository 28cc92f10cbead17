"""Hypothesis tests and conformal intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from .ranks import medians
from .series import AT, BY, autocorrelation, ordered
from .stats import ranked


def jarque_bera(df: DataFrame, group: str, x: str) -> DataFrame:
    n = F.count(x)
    jb = n / 6 * (F.pow(F.skewness(x), 2) + F.pow(F.kurtosis(x), 2) / 4)
    return df.groupBy(group).agg(n.alias("n"), jb.alias("jb"), F.exp(-jb / 2).alias("p"))


def ljung_box(df: DataFrame, x: str, lags: int = 10) -> DataFrame:
    n = df.groupBy(BY).agg(F.count(x).alias("n"))
    a = autocorrelation(df, x, lags).join(n, BY)
    return a.groupBy(BY).agg((F.first("n") * (F.first("n") + 2) * F.sum(F.pow("acf", F.lit(2)) / (F.col("n") - F.col("lag")))).alias("q"))


def runs_z(df: DataFrame, x: str) -> DataFrame:
    """Runs test about the median: (series, runs, z)."""
    o = df.filter(F.col(x).isNotNull())
    d = o.join(medians(o, [BY], x, "md"), BY).withColumn("b", F.col(x) >= F.col("md")).withColumn("pb", F.lag("b").over(ordered()))
    a = d.groupBy(BY).agg((F.count_if(F.col("b") != F.col("pb")) + 1).alias("runs"), F.count_if("b").alias("n1"), F.count_if(~F.col("b")).alias("n2"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    mean = 2 * n1 * n2 / (n1 + n2) + 1
    var = 2 * n1 * n2 * (2 * n1 * n2 - n1 - n2) / ((n1 + n2) * (n1 + n2) * (n1 + n2 - 1))
    return a.select(BY, "runs", ((F.col("runs") - mean) / F.sqrt(var)).alias("z"))


def kpss(df: DataFrame, x: str, lags: int = 5) -> DataFrame:
    """Level stationarity: sum of squared partial sums over n^2 times the long-run variance (Bartlett weights)."""
    by = Window.partitionBy(BY)
    e = df.filter(F.col(x).isNotNull()).select(BY, AT, (F.col(x) - F.avg(x).over(by)).alias("e"))
    w = ordered()
    e = e.withColumn("s", F.sum("e").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumns({f"l{k}": F.lag("e", k).over(w) for k in range(1, lags + 1)})
    n = F.count(F.lit(1))
    lrv = F.sum(F.col("e") * F.col("e")) / n + 2 * sum((1 - k / (lags + 1)) * F.sum(F.col("e") * F.col(f"l{k}")) / n for k in range(1, lags + 1))
    return e.groupBy(BY).agg((F.sum(F.col("s") * F.col("s")) / (n * n) / lrv).alias("kpss"))


def adf(df: DataFrame, x: str, lags: int = 1) -> DataFrame:
    """Augmented Dickey-Fuller t with constant: normal equations from sums, solved per series in numpy (k + 2 unknowns)."""
    import numpy as np
    import pandas as pd

    w = ordered()
    d = df.filter(F.col(x).isNotNull()).select(BY, AT, F.col(x).alias("y"), F.lag(x).over(w).alias("z0")).withColumn("dy", F.col("y") - F.col("z0"))
    d = d.withColumns({f"z{k}": F.lag("dy", k).over(w) for k in range(1, lags + 1)}).withColumn("one", F.lit(1.0)).dropna()
    names = ["z0", "one", *(f"z{k}" for k in range(1, lags + 1)), "dy"]
    sums = d.groupBy(BY).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        m = np.array([[r[f"{a}_{b}"] if f"{a}_{b}" in r else r[f"{b}_{a}"] for b in names] for a in names], float)
        xx, xy, yy = m[:-1, :-1], m[:-1, -1], m[-1, -1]
        beta = np.linalg.solve(xx, xy)
        s2 = (yy - beta @ xy) / (r["n"] - len(beta))
        return pd.DataFrame({"series": [r[BY]], "adf": [beta[0] / math.sqrt(s2 * np.linalg.inv(xx)[0, 0])]})

    return sums.groupBy(BY).applyInPandas(solve, "series string, adf double")


def goldfeld_quandt(df: DataFrame, group: str, order: str, x: str) -> DataFrame:
    """Variance of the last third over that of the first."""
    t = df.filter(F.col(x).isNotNull()).withColumn("third", F.ntile(3).over(Window.partitionBy(group).orderBy(order)))
    return t.groupBy(group).agg((F.var_samp(F.when(F.col("third") == 3, F.col(x))) / F.var_samp(F.when(F.col("third") == 1, F.col(x)))).alias("gq"))


def breusch_pagan(df: DataFrame, group: str, z: str, residual: str) -> DataFrame:
    """n R2 of squared residuals on z."""
    return df.groupBy(group).agg((F.count(residual) * F.regr_r2(F.pow(F.col(residual), F.lit(2)), F.col(z))).alias("lm"))


def rubin(df: DataFrame, group: str, estimate: str, variance: str) -> DataFrame:
    """Rubin's rules: pooled estimate, within, between, total variance, fraction of missing information, degrees of freedom."""
    a = df.groupBy(group).agg(F.count(F.lit(1)).alias("m"), F.avg(estimate).alias("pooled"), F.avg(variance).alias("within"), F.var_samp(estimate).alias("between"))
    t = F.col("within") + (1 + 1 / F.col("m")) * F.col("between")
    lam = (1 + 1 / F.col("m")) * F.col("between") / t
    return a.withColumns({"total": t, "fmi": lam, "dof": (F.col("m") - 1) / F.when(lam > 0, lam * lam)})


def diebold_mariano(df: DataFrame, group: str, order: str, e1: str, e2: str, h: int = 1) -> DataFrame:
    """Squared-loss test with the small-sample correction; lag covariances up to h - 1."""
    d = df.select(group, order, (F.pow(F.col(e1), F.lit(2)) - F.pow(F.col(e2), F.lit(2))).alias("d")).filter("d is not null")
    d = d.join(d.groupBy(group).agg(F.avg("d").alias("m"), F.count(F.lit(1)).alias("n")), group)
    w = Window.partitionBy(group).orderBy(order)
    d = d.withColumns({f"l{k}": F.lag("d", k).over(w) for k in range(1, h)})
    c = F.col("d") - F.col("m")
    lrv = (F.sum(c * c) + 2 * sum((F.sum(c * (F.col(f"l{k}") - F.col("m"))) for k in range(1, h)), F.lit(0.0))) / F.first("n")
    n = F.first("n")
    return d.groupBy(group).agg((F.first("m") / F.sqrt(lrv / n) * F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)).alias("dm"), n.alias("n"))


def friedman(df: DataFrame, sample: str, method: str, score: str, higher_is_better: bool = False) -> DataFrame:
    """One row: chi-square, Kendall's W, number of samples and methods. Critical difference by nemenyi()."""
    r = ranked(df, [sample], score, higher_is_better).groupBy(method).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"))
    k, n = F.count(F.lit(1)), F.first("n")
    chi = 12 / (n * k * (k + 1)) * F.sum(F.col("r") * F.col("r")) - 3 * n * (k + 1)
    return r.agg(chi.alias("chi2"), (chi / (n * (k - 1))).alias("w"), n.alias("samples"), k.alias("methods"))


#: Studentised range quantiles over the square root of two at 0.05, for 2 to 10 methods.
NEMENYI_Q = (1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164)


def nemenyi(methods: int, samples: int) -> float:
    return NEMENYI_Q[min(methods, 10) - 2] * math.sqrt(methods * (methods + 1) / (6 * samples))


def paired_t(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return df.groupBy(group).agg((F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).alias("t"), F.count(d).alias("n"), (F.avg(d) / F.stddev_samp(d)).alias("cohen_d"))


def wilcoxon(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Signed-rank sums of the non-zero differences (average ranks). Differences are taken to nine digits, so that last bits neither split ties nor stand for
    a difference."""
    d = df.select(group, F.round(F.col(a) - F.col(b), 9).alias("d")).filter("d <> 0").withColumn("m", F.abs("d"))
    r = ranked(d, [group], "m", False)
    return r.groupBy(group).agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("minus"), F.count(F.lit(1)).alias("n"))


def anova(df: DataFrame, group: str, x: str) -> DataFrame:
    """One row: F, eta squared, degrees of freedom."""
    g = df.groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count(x)).alias("ssw"))
    t = df.agg(F.avg(x).alias("gm"))
    a = g.crossJoin(F.broadcast(t)).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), F.lit(2))).alias("ssb"), F.sum("ssw").alias("ssw"), (F.count(F.lit(1)) - 1).alias("df1"), (F.sum("n") - F.count(F.lit(1))).alias("df2"))
    return a.select((F.col("ssb") / F.col("df1") / (F.col("ssw") / F.col("df2"))).alias("f"), (F.col("ssb") / (F.col("ssb") + F.col("ssw"))).alias("eta2"), "df1", "df2")


def corrected(df: DataFrame, p: str, order: list[str]) -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg for a family of p-values (one family: a small table)."""
    one = Window.partitionBy(F.lit(0))
    up, m = one.orderBy(p, *order), F.count(F.lit(1)).over(one)
    k, down = F.row_number().over(up), one.orderBy(F.desc("k_"))
    d = df.withColumns({"m_": m, "k_": k}).withColumns({"h_": (F.col("m_") - F.col("k_") + 1) * F.col(p), "b_": F.col("m_") / F.col("k_") * F.col(p)})
    return d.withColumns({
        "bonferroni": F.least(F.lit(1.0), F.col("m_") * F.col(p)), "holm": F.least(F.lit(1.0), F.max("h_").over(up.rowsBetween(Window.unboundedPreceding, 0))),
        "bh": F.least(F.lit(1.0), F.min("b_").over(down.rowsBetween(Window.unboundedPreceding, 0)))}).drop("m_", "k_", "h_", "b_")


def little_mcar(df: DataFrame, columns: list[str]) -> tuple[float, int, float]:
    """(chi-square, degrees of freedom, p). Means by pattern and moments are aggregated; the small algebra runs on the driver."""
    import numpy as np

    pattern = F.concat(*(F.col(c).isNull().cast("int").cast("string") for c in columns))
    groups = df.groupBy(pattern.alias("p")).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in columns)).collect()
    one = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.covar_pop(a, b).alias(f"{a}_{b}") for a in columns for b in columns)).first()
    mean, cov = np.array([one[f"m_{c}"] for c in columns]), np.array([[one[f"{a}_{b}"] for b in columns] for a in columns])
    d2, df_ = 0.0, -len(columns)
    for g in groups:
        seen = [i for i, c in enumerate(columns) if g["p"][i] == "0"]
        if seen:
            diff = np.array([g[columns[i]] for i in seen]) - mean[seen]
            d2 += g["n"] * diff @ np.linalg.solve(cov[np.ix_(seen, seen)], diff)
            df_ += len(seen)
    return float(d2), df_, special.chi2_sf(d2, df_) if df_ > 0 else 1.0


def mardia(df: DataFrame, columns: list[str]) -> DataFrame:
    """Multivariate kurtosis with its z (all complete rows): Mahalanobis distances with the inverse covariance as literals."""
    import numpy as np

    d = df.dropna(subset=columns)
    one = d.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.covar_pop(a, b).alias(f"{a}_{b}") for a in columns for b in columns)).first()
    inv = np.linalg.inv(np.array([[one[f"{a}_{b}"] for b in columns] for a in columns]))
    centred = [F.col(c) - one[f"m_{c}"] for c in columns]
    dist = sum(centred[i] * centred[j] * float(inv[i, j]) for i in range(len(columns)) for j in range(len(columns)))
    k = len(columns)
    kurt = F.avg(dist * dist)
    return d.agg(F.count(F.lit(1)).alias("n"), kurt.alias("kurtosis"), ((kurt - k * (k + 2)) / F.sqrt(8 * k * (k + 2) / F.count(F.lit(1)))).alias("z"))


def conformal_quantile(df: DataFrame, group: str, score: str, alpha: float) -> DataFrame:
    """Score number ceil((n + 1)(1 - alpha)) of each group, at most the largest. Scores are counted first."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(group, F.col(score).alias("s")).count()
    w = Window.partitionBy(group).orderBy("s")
    c = counts.withColumns({"upto": F.sum("count").over(w), "n": F.sum("count").over(Window.partitionBy(group))})
    k = F.least(F.ceil((F.col("n") + 1) * (1 - alpha)), F.col("n"))
    return c.filter(F.col("upto") >= k).groupBy(group).agg(F.min("s").alias("q"))


def adaptive_alpha(df: DataFrame, covered: str, target: float = 0.1, gamma: float = 0.01) -> DataFrame:
    """Online level per series, in order: alpha + gamma (target - miss), kept within 0.001 and 0.999."""
    a = df.groupBy(BY).agg(F.sort_array(F.collect_list(F.struct(AT, covered))).alias("a"))
    zero = F.lit(target)
    step = lambda s, v: F.least(F.lit(0.999), F.greatest(F.lit(0.001), s + gamma * (target - (~v[covered]).cast("double"))))
    return a.select(BY, F.aggregate("a", zero, step).alias("alpha"))


def z_p2(z: Column) -> Column:
    return 2 * (1 - special.normal_cdf(F.abs(z)))
