"""Linear quantile regression by sums, and conformal intervals about it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import kept
from .tests import conformal_quantile

ITERATIONS, SHRINK, LEAST = 20, 0.5, 1e-4


def quantile_fit(df: DataFrame, y: str, features: Sequence[str], taus: Sequence[float], iterations: int = ITERATIONS) -> dict[float, np.ndarray]:
    """Coefficients (the intercept, then one a feature) of each quantile: least pinball loss by majorisation, that is least squares with weights 1 / (e + |residual|), where e
    shrinks from the deviation of y. Each step is one aggregation of (features + 1)^2 sums a quantile; all quantiles share it. Rows with a null don't count; without
    rows all coefficients are 0, and a feature without variance has a 0.

    The steps run on standardised features, which are stored once."""
    seen = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [y, *features])).select(F.col(y).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features, 1)))
    one = seen.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.stddev_pop("y").alias("s"), *(f(f"x{i}").alias(f"{k}{i}") for i in range(1, len(features) + 1) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not one["n"]:
        return {t: np.zeros(len(features) + 1) for t in taus}
    scale = [one[f"s{i}"] or 0.0 for i in range(1, len(features) + 1)]
    rows = kept(seen.select("y", F.lit(1.0).alias("x0"), *((F.when(F.lit(s > 0), (F.col(f"x{i}") - one[f"m{i}"]) / (s or 1.0)).otherwise(0.0)).alias(f"x{i}") for i, s in enumerate(scale, 1))), "quantile-rows")
    d = len(features) + 1
    spread, beta = max(one["s"] or 0.0, 1e-12), {t: np.array([one["m"], *[0.0] * (d - 1)]) for t in taus}
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    for step in range(iterations):
        e = spread * max(SHRINK**step, LEAST)
        sums = []
        for k, t in enumerate(taus):
            r = F.col("y") - sum((F.col(f"x{i}") * float(b) for i, b in enumerate(beta[t])), F.lit(0.0))
            w = 1 / (F.abs(r) + e)
            sums += [F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{k}_{i}_{j}") for i, j in upper]
            sums += [F.sum(w * F.col(f"x{i}") * F.col("y")).alias(f"b{k}_{i}") for i in range(d)]
        got = rows.agg(*sums, *(F.sum(f"x{i}").alias(f"c_{i}") for i in range(d))).first()
        for k, t in enumerate(taus):
            a = np.zeros((d, d))
            for i, j in upper:
                a[i, j] = a[j, i] = got[f"a{k}_{i}_{j}"]
            b = np.array([got[f"b{k}_{i}"] + (2 * t - 1) * got[f"c_{i}"] for i in range(d)])
            beta[t] = np.linalg.lstsq(a, b, rcond=None)[0]
    out = {}
    for t, b in beta.items():
        slopes = np.array([v / s if s else 0.0 for v, s in zip(b[1:], scale, strict=True)])
        out[t] = np.concatenate([[b[0] - sum(v * (one[f"m{i}"] or 0.0) for i, v in enumerate(slopes, 1))], slopes])
    return out


def predicted(features: Sequence[str], beta: np.ndarray) -> Column:
    return sum((F.col(c) * float(b) for c, b in zip(features, beta[1:], strict=True)), F.lit(float(beta[0])))


def conformal_quantiles(df: DataFrame, group: str, y: str, features: Sequence[str], fit: Column, held: Column, alpha: float = 0.1, iterations: int = ITERATIONS) -> DataFrame:
    """df with lo, hi and margin: conformalised quantile regression. Rows where `fit` holds give the quantiles alpha / 2 and 1 - alpha / 2 as lines in the features; rows
    where `held` holds give each group's margin, which the band is widened by (or narrowed). A group without held rows has no interval."""
    taus = (alpha / 2, 1 - alpha / 2)
    beta = quantile_fit(df.filter(fit), y, features, taus, iterations)
    lo, hi = (predicted(features, beta[t]) for t in taus)
    band = df.withColumns({"lo": lo, "hi": hi})
    scores = band.filter(held & F.col(y).isNotNull()).select(group, F.greatest(F.col("lo") - F.col(y), F.col(y) - F.col("hi")).alias("score__"))
    margin = conformal_quantile(scores, group, "score__", alpha).withColumnRenamed("q", "margin")
    # one row a group
    return band.join(margin, group, "left").withColumns({"lo": F.col("lo") - F.col("margin"), "hi": F.col("hi") + F.col("margin")})
