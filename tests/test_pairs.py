"""Pairs of points by places: against all pairs on few rows, and on many points of few places, where making the pairs would take minutes."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.operators import geostat, spatial


@pytest.fixture(scope="module")
def stations(spark):
    g = np.random.default_rng(3)
    n = 240
    pdf = pd.DataFrame({"k": g.permutation(n), "x": g.integers(0, 9, n) * 1.0, "y": g.integers(0, 9, n) * 1.0, "v": np.round(g.normal(20, 5, n), 1)})
    pdf.loc[:59, ["x", "y", "v"]] = pdf.loc[60:119, ["x", "y", "v"]].to_numpy()
    return pdf, spark.createDataFrame(pdf)


@pytest.fixture
def small(monkeypatch):
    """Several rows of keys a place, several tiles, and more passes."""
    for name, n in (("MEMBERS", 2), ("TILE", 37), ("CELLS", 8), ("FEW", 20)):
        monkeypatch.setattr(spatial, name, n)


def both(pdf):
    pdf = pdf.sort_values("k")
    i, j = np.triu_indices(len(pdf), 1)
    k, x, y, v = (pdf[c].to_numpy() for c in "kxyv")
    return pd.DataFrame({"i": k[i], "j": k[j], "d": np.sqrt((x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2), "vi": v[i], "vj": v[j]}).assign(m=lambda p: (p.vi - p.vj).abs())


def test_station_pairs(small, stations):
    pdf, df = stations
    p = both(pdf)
    near = p[(p.d > 0) & (p.d < 3)]
    got = spatial.within(df, "k", 3.0).toPandas().sort_values(["i", "j"])
    want = near.sort_values(["i", "j"])
    assert np.array_equal(got[["i", "j"]], want[["i", "j"]]) and np.allclose(got["d"], want["d"])
    km = spatial.distances(df, "k", "y", "x").toPandas().sort_values(["i", "j"])
    assert np.array_equal(km[["i", "j"]], p.sort_values(["i", "j"])[["i", "j"]])
    at = pdf.set_index("k")
    a, b = at.loc[km["i"]], at.loc[km["j"]]
    h = np.sin(np.radians(b.y.to_numpy() - a.y.to_numpy()) / 2) ** 2 + np.cos(np.radians(a.y.to_numpy())) * np.cos(np.radians(b.y.to_numpy())) * np.sin(np.radians(b.x.to_numpy() - a.x.to_numpy()) / 2) ** 2
    assert np.allclose(km["km"], 2 * 6371 * np.arcsin(np.sqrt(h)))


def test_pairs_of_stations_without_a_place(spark):
    d = spark.createDataFrame([(1, None, 0.0), (2, None, 0.0), (3, 1.0, 1.0), (None, 1.0, 1.0)], "k long, lat double, lon double")
    # as in SQL, where least() passes over the unknown
    half = pytest.approx(np.pi * 6371.0)
    assert sorted(tuple(r) for r in spatial.distances(d, "k").collect()) == [(1, 2, half), (1, 3, half), (2, 3, half)]


def test_pairs_are_dealt_to_all_tasks(spark, stations):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = stations[1].coalesce(1)
    for out in (spatial.distances(one, "k", "y", "x"), spatial.within(one, "k", 3.0)):
        assert sum(r > 0 for r in out.groupBy(F.spark_partition_id()).count().toPandas()["count"]) == n


def test_pairs_are_not_held_by_blocks(spark, stations):
    """Generated code holds all rows that one of its input rows makes: the two sides of a block are opened by different stages of it, in the same tasks."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for out in (spatial.distances(stations[1], "k", "y", "x"), spatial.within(stations[1], "k", 3.0)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            last = re.findall(r"\*\((\d+)\) Generate explode\((?:k|l)__", plan)
            assert len(last) == 2 and len(set(last)) == 2
            assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


@pytest.mark.parametrize("name", ["matheron", "cressie", "genton"])
def test_semivariogram_equals_all_pairs(small, stations, name):
    pdf, df = stations
    p = both(pdf).assign(bin=lambda p: np.minimum(np.floor(p.d / p.d.max() * 6), 5))
    gamma = {"matheron": lambda m: (m**2).mean() / 2, "cressie": lambda m: np.sqrt(m).mean() ** 4 / (0.457 + 0.494 / len(m)) / 2, "genton": lambda m: (2.2191 * m.quantile(0.25)) ** 2 / 2}[name]
    want = p.groupby("bin").agg(n=("d", "size"), distance=("d", "mean"), gamma=("m", gamma))
    got = spatial.semivariogram(df, "k", 6, estimator=name).toPandas().set_index("bin").sort_index()
    assert np.array_equal(got["n"], want["n"]) and np.allclose(got["distance"], want["distance"]) and np.allclose(got["gamma"], want["gamma"], rtol=1e-9)


@pytest.mark.parametrize("name", ["matheron", "cressie", "genton"])
def test_semivariogram_of_odd_rows(spark, name):
    """A pair without a value counts, but not for gamma; one without a place falls into the last bin; no rows, no bins."""
    d = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 0.0, 3.0, 5.0), (3, 0.0, 1.0, None), (4, None, 1.0, 2.0), (None, 9.0, 9.0, 9.0)], "k long, x double, y double, v double")
    got = {r.bin: r for r in spatial.semivariogram(d, "k", 3, estimator=name).collect()}
    assert {b: r.n for b, r in got.items()} == {1: 1, 2: 5}
    assert got[1].gamma is None and got[2].gamma == pytest.approx({"matheron": (16 + 1 + 9) / 3 / 2, "cressie": ((2 + 1 + 3**0.5) / 3) ** 4 / (0.457 + 0.494 / 5) / 2, "genton": (2.2191 * 2) ** 2 / 2}[name])
    assert spatial.semivariogram(d.filter("k < 2"), "k", 3, estimator=name).count() == 0


def test_near_variogram_and_moran_equal_all_pairs(stations):
    pdf, df = stations
    p = both(pdf)
    near = p[p.d < 4].assign(bin=lambda p: np.where(p.d == 0, 0, 1 + np.floor(p.d / 4 * 5)))
    want = near.groupby("bin").agg(n=("d", "size"), distance=("d", "mean"), gamma=("m", lambda m: (m**2).mean() / 2))
    got = geostat.near_variogram(df, "k", 4.0, 5).toPandas().set_index("bin").sort_index()
    assert np.array_equal(got["n"], want["n"]) and np.allclose(got["distance"], want["distance"]) and np.allclose(got["gamma"], want["gamma"])
    e = near[near.d > 0]
    w, mean, s2, n = 1 / e.d, pdf.v.mean(), pdf.v.var(ddof=0), len(pdf)
    r = spatial.moran(df, "k", 4.0).first()
    assert r.edges == len(e)
    assert r.moran == pytest.approx((w * (e.vi - mean) * (e.vj - mean)).sum() / w.sum() / s2) and r.geary == pytest.approx((n - 1) * (w * e.m**2).sum() / (2 * w.sum() * n * s2))


def test_many_points_of_few_places(spark):
    """100,000 points of two places: 5e9 pairs, which nothing makes."""
    n = 100_000
    d = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 2).cast("double").alias("x"), F.lit(0.0).alias("y"), (F.col("id") % 4).cast("double").alias("v"))
    half = n // 2
    got = {r.bin: r for r in geostat.near_variogram(d, "k", 6.0).collect()}
    assert {b: r.n for b, r in got.items()} == {0: half * (half - 1), 3: half * half}
    assert got[0].gamma == pytest.approx(4 * (half / 2) ** 2 * 2 / (half * (half - 1)) / 2) and got[3].gamma == pytest.approx((1 + 1 + 9 + 1) / 4 / 2)
    assert spatial.moran(d, "k", 4.0).first().edges == half * half
    for name in ("matheron", "cressie", "genton"):
        assert {r.n for r in spatial.semivariogram(d, "k", 2, estimator=name).collect()} == {half * (half - 1), half * half}


def test_nearest_donors_of_crowded_places(spark):
    """60,000 donors at three places and as many queries: a query meets the first donors of a place, not all of them."""
    n = 60_000
    d = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 3 % 2).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"))
    near = spatial.nearest_on_grid(d.withColumnRenamed("k", "q"), d.withColumnRenamed("k", "donor"), 3, strict=True)
    assert near.count() == 3 * n
    rows = {q: [r.donor for r in near.filter(F.col("q") == q).orderBy("rank").collect()] for q in (0, 4, 59_999)}
    assert rows == {0: [3, 6, 9], 4: [1, 7, 10], 59_999: [2, 5, 8]}
