"""Quantile lines against an exhaustive search, and the coverage of conformal intervals."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.operators import quantile as Q


def loss(y, p, tau):
    r = y - p
    return float(np.where(r >= 0, tau * r, (tau - 1) * r).sum())


def test_fit_equals_the_best_line_through_two_points(spark):
    """The least pinball loss is reached by a line through two points (a vertex of the linear programme)."""
    g = np.random.default_rng(3)
    x = g.uniform(0, 10, 60)
    y = 2 + 0.7 * x + g.exponential(1 + 0.3 * x)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": 1.0}))
    fit = Q.quantile_fit(df, "y", ["x", "z"], [0.1, 0.5, 0.9], iterations=40)
    for tau, b in fit.items():
        best = min(loss(y, y[i] + (y[j] - y[i]) / (x[j] - x[i]) * (x - x[i]), tau) for i in range(60) for j in range(i) if x[i] != x[j])
        assert loss(y, b[0] + b[1] * x, tau) <= best * 1.005 and b[2] == 0.0


def test_without_rows(spark):
    none = spark.createDataFrame([], "x double, y double")
    assert Q.quantile_fit(none, "y", ["x"], [0.5])[0.5].tolist() == [0.0, 0.0]


def test_coverage_is_near_the_wanted_share_where_the_spread_grows(spark):
    g = np.random.default_rng(5)
    n = 6000
    x = g.uniform(0, 10, n)
    df = spark.createDataFrame(pd.DataFrame({"k": range(n), "group": np.where(np.arange(n) % 2, "a", "b"), "x": x, "y": 1 + x + g.normal(size=n) * (0.2 + x)}))
    out = Q.conformal_quantiles(df, "group", "y", ["x"], F.col("k") % 3 == 0, F.col("k") % 3 == 1, 0.1).filter("k % 3 = 2")
    got = out.groupBy("group").agg(F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("int")).alias("c")).collect()
    assert len(got) == 2 and all(r.c == pytest.approx(0.9, abs=0.02) for r in got)
    widths = out.groupBy((F.col("x") > 5).alias("wide")).agg(F.avg(F.col("hi") - F.col("lo")).alias("w")).orderBy("wide").collect()
    assert widths[1].w > 1.8 * widths[0].w
