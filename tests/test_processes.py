"""Gaussian processes against the dense ones; spanning forests and leaf order against plain versions."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lacuna.operators import linkage
from lacuna.operators import processes as P


def data(n, seed=0):
    g = np.random.default_rng(seed)
    pdf = pd.DataFrame({"k": range(n), "a": g.uniform(-3, 3, n), "c": g.uniform(-3, 3, n)})
    pdf["y"] = 5 + np.sin(2 * pdf["a"]) + 0.1 * g.normal(size=n)
    return pdf


def test_all_rows_as_inducing_rows_give_the_dense_process(spark):
    pdf = data(300)
    df = spark.createDataFrame(pdf).repartition(4)
    lengths, noise = np.array([0.7, 5.0]), 0.05
    model = P.fitted(df, "k", ["a", "c"], "y", 300, lengths, noise)
    new = pd.DataFrame({"k": [1000, 1001, 1002], "a": [0.3, -2.0, None], "c": [1.0, 2.5, 0.0]})
    out = P.predicted(spark.createDataFrame(new), model, ["a", "c"]).orderBy("k").toPandas()
    x, y = pdf[["a", "c"]].to_numpy(), pdf["y"].to_numpy()
    z, t = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()
    q = (new[["a", "c"]].to_numpy(float)[:2] - x.mean(0)) / x.std(0)
    k, kq = P.kernel(z, z, lengths) + noise * np.eye(300), P.kernel(q, z, lengths)
    mean = y.mean() + y.std() * kq @ np.linalg.solve(k, t)
    sd = y.std() * np.sqrt(1 - np.einsum("ij,ij->i", kq, np.linalg.solve(k, kq.T).T))
    assert np.abs(out["gp"].to_numpy()[:2] - mean).max() < 1e-3 and np.abs(out["gp_sd"].to_numpy()[:2] - sd).max() < 1e-3
    assert np.isnan(out["gp"].iloc[2])


def test_lengths_tell_the_feature_that_matters_and_few_inducing_rows_suffice(spark):
    pdf = data(3000, 1)
    df = spark.createDataFrame(pdf)
    model = P.fitted(df, "k", ["a", "c"], "y", 80)
    assert model.lengths[0] < model.lengths[1] and len(model.inducing) == 80
    out = P.predicted(df, model, ["a", "c"]).toPandas()
    assert np.sqrt(((out["gp"] - 5 - np.sin(2 * out["a"])) ** 2).mean()) < 0.1
    draws = P.sampled(df.filter("k < 50"), model, "k", ["a", "c"], 200).groupBy("k").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).orderBy("k").toPandas()
    own = out[out["k"] < 50].sort_values("k")
    assert np.abs(draws["m"].to_numpy() - own["gp"].to_numpy()).max() < 0.1
    assert P.fitted(df.limit(0), "k", ["a"], "y") is None


def test_intervals_follow_the_noise(spark):
    g = np.random.default_rng(3)
    pdf = data(2000, 2)
    pdf["y"] = pdf["c"] + g.normal(size=2000) * np.where(pdf["a"] > 0, 1.0, 0.1)
    out = P.heteroscedastic(spark.createDataFrame(pdf), "k", ["a", "c"], "y", 60).toPandas()
    wide, narrow = out[out["a"] > 1], out[out["a"] < -1]
    assert (wide["hi"] - wide["lo"]).mean() > 3 * (narrow["hi"] - narrow["lo"]).mean()
    assert abs(((out["y"] > out["lo"]) & (out["y"] < out["hi"])).mean() - 0.95) < 0.04


def plain_order(edges):
    clusters = [[v] for v in sorted({v for a, b, _ in edges for v in (a, b)})]
    kept = []
    for a, b, d in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        x, y = (next(c for c in clusters if v in c) for v in (a, b))
        if x is not y:
            kept.append((a, b, d))
            clusters = [c for c in clusters if c is not x and c is not y] + [x + y if min(x) < min(y) else y + x]
    return sorted(kept), [v for c in sorted(clusters, key=min) for v in c]


def test_forest_and_order_equal_a_plain_version(spark):
    g = np.random.default_rng(4)
    n = 25
    edges = [(f"v{i:02d}", f"v{j:02d}", float(g.integers(1, 12))) for i in range(n) for j in range(i + 1, n) if (i < 15) == (j < 15) and g.random() < 0.4]
    df = spark.createDataFrame(edges, "a string, b string, d double")
    forest, order = plain_order(edges)
    assert sorted((r.a, r.b, r.d) for r in linkage.spanning_forest(df).collect()) == forest
    assert [r.v for r in linkage.leaf_order(df).orderBy("place").collect()] == order
    assert linkage.spanning_forest(df.limit(0)).count() == 0
