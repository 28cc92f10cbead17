"""Chained forests: bags of cells against MLlib on bagged rows, any partitions, odd rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from lacuna.operators import kernels as K


@pytest.fixture(scope="module")
def gappy(spark):
    g = np.random.default_rng(4)
    pdf = pd.DataFrame({"r": range(900), "a": g.integers(0, 10, 900).astype(float), "b": g.normal(size=900), "c": g.integers(0, 4, 900).astype(float)})
    pdf["b"] += 3 * pdf["a"] - 2 * pdf["c"]
    for c, k in (("a", 9), ("b", 7), ("c", 8)):
        pdf[f"{c}_true"] = pdf[c]
        pdf.loc[g.permutation(900)[: 900 // k], c] = np.nan
    return pdf


@pytest.mark.parametrize("seed", [11, 12])
def test_cells_grow_the_tree_of_their_bagged_rows(spark, gappy, seed):
    """One tree, which sees all features, so that nothing is drawn but the bag."""
    df = spark.createDataFrame(gappy).select("r", F.col("a_true").alias("a"), F.col("c_true").alias("c"), F.when(~F.isnan("b"), F.col("b")).alias("b"))
    df = df.withColumn("a", F.col("a") + F.col("r") % 7 / 10)
    binned, bins = K.in_bins(df, K.cuts(df, ["a", "c"]))
    got = K.grown(K.bagged(binned, ["r", "b"], "b", bins, 1, seed), bins, 1, seed).toPandas().set_index(bins)["guess__"].sort_index()
    rows = VectorAssembler(inputCols=bins, outputCol="x").transform(binned)
    bag = rows.filter("b is not null").withColumn("n", K.poisson(F.xxhash64(F.xxhash64(F.lit(seed), "r", "b"), F.lit(0)))).filter("n > 0")
    of = RandomForestRegressor(featuresCol="x", labelCol="b", weightCol="n", predictionCol="p", numTrees=1, bootstrap=False, featureSubsetStrategy="all", maxDepth=6, seed=seed)
    want = of.fit(bag).transform(rows.filter("b is null").select(*bins, "x").distinct()).toPandas().set_index(bins)["p"].sort_index()
    assert len(want) > 50 and got.index.equals(want.index) and np.allclose(got, want, atol=1e-9)


def test_bags_are_poisson(spark):
    n = 40000
    got = {r.k: r["count"] / n for r in spark.range(n).select(K.poisson(F.xxhash64("id")).alias("k")).groupBy("k").count().collect()}
    assert all(abs(got.get(float(k), 0.0) - math.exp(-1) / math.factorial(k)) < 0.01 for k in range(8))


def test_cuts_keep_rare_values_and_take_quantiles_of_many(spark):
    df = spark.range(1000).select(F.when(F.col("id") == 0, 9.0).otherwise(F.col("id") % 3).cast("double").alias("few"), F.col("id").cast("double").alias("many"), F.lit(2.0).alias("one"))
    at = K.cuts(df, ["few", "many", "one"])
    assert at["few"] == [0.5, 1.5, 5.5] and len(at["many"]) == 31 and np.allclose(at["many"], np.arange(1, 32) * 1000 / 32, atol=2) and at["one"] == [2.0]


def test_bags_are_the_same_on_any_partitions(spark, gappy):
    df = spark.createDataFrame(gappy).select("r", "b", F.col("a_true").alias("a")).withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    at = K.cuts(df, ["a"])
    one, six = (K.bagged(*(lambda d, bins: (d, ["r", "b"], "b", bins))(*K.in_bins(df.repartition(n, "r"), at)), 3, 1).toPandas().sort_values(["a_bin__", "tree"]) for n in (1, 6))
    assert len(one) == 10 * 4 and np.allclose(one, six, equal_nan=True)


def test_fills_follow_planted_structure(spark, gappy):
    got = K.forest(spark.createDataFrame(gappy), "r", ["a", "b", "c"], trees=4).toPandas().sort_values("r")
    for c in "abc":
        seen, truth = gappy[c].notna().to_numpy(), gappy[f"{c}_true"].to_numpy()
        assert (got[c].to_numpy()[seen] == truth[seen]).all()
        assert np.sqrt(((got[c].to_numpy() - truth)[~seen] ** 2).mean()) < 0.9 * truth[~seen].std()


def test_trees_are_fitted_on_cells_not_rows(spark, gappy, monkeypatch):
    sizes, fit = [], RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, data: sizes.append(data.count()) or fit(self, data))
    df = spark.createDataFrame(gappy[["r", "a", "c"]].assign(e=gappy["r"] % 5 + 0.0)).select("r", "e", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in "ac"))
    assert K.forest(df, "r", ["a", "c", "e"], rounds=1, trees=2).count() == 900
    assert sizes and max(sizes) < 200


def test_odd_rows(spark):
    ddl = "r long, a double, b double, c double"
    rows = [(1, 1.0, None, None), (2, float("nan"), 4.0, None), (None, 3.0, 6.0, None), (4, 2.0, 5.0, None)]
    got = {r.r: r for r in K.forest(spark.createDataFrame(rows, ddl), "r", ["a", "b", "c"], trees=2).collect()}
    assert len(got) == 4 and all(r.c is None for r in got.values())
    assert 4 <= got[1].b <= 6 and (got[1].a, got[2].b, got[None].a, got[None].b) == (1.0, 4.0, 3.0, 6.0) and not math.isnan(got[2].a)
    assert K.forest(spark.createDataFrame([], ddl), "r", ["a", "b"]).count() == 0
    alone = K.forest(spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0)], "r long, a double"), "r", ["a"]).collect()
    assert sorted(x.a for x in alone) == [2.0, 3.0, 4.0]
