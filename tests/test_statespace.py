"""The scan over chunks against plain loops."""

import numpy as np
import pandas as pd
import pytest

from lacuna.operators import statespace as S


def plain(y, model, m0):
    """Filter and smoother row by row."""
    d, n = model.size, len(y)
    m, p = np.array([m0] + [0.0] * (d - 1)), model.p0.copy()
    ms, ps = [], []
    for v in y:
        m, p = model.f @ m, model.f @ p @ model.f.T + model.q
        if not np.isnan(v):
            k = p @ model.h / (model.h @ p @ model.h + model.r)
            m, p = m + k * (v - model.h @ m), p - np.outer(k, model.h @ p)
        ms.append(m)
        ps.append(p)
    sm, sp = [ms[-1]], [ps[-1]]
    for t in range(n - 2, -1, -1):
        ahead = model.f @ ps[t] @ model.f.T + model.q
        e = ps[t] @ model.f.T @ np.linalg.inv(ahead)
        sm.append(ms[t] + e @ (sm[-1] - model.f @ ms[t]))
        sp.append(ps[t] + e @ (sp[-1] - ahead) @ e.T)
    sm, sp = sm[::-1], sp[::-1]
    return np.array([[model.h @ a, model.h @ b @ model.h, model.h @ c, model.h @ e @ model.h] for a, b, c, e in zip(ms, ps, sm, sp, strict=True)])


MODELS = {"level": S.local_level(0.5, 2.0, 3.0), "season": S.structural(0.2, 0.001, 0.05, 12, 2, 1.0, 20.0)}


@pytest.fixture(scope="module")
def gappy(spark):
    g = np.random.default_rng(4)
    parts = []
    for name, n in (("long", 500), ("short", 3), ("one", 1), ("even", 128)):
        y = np.cumsum(g.normal(size=n)) + 3 * np.sin(np.arange(n) / 2) + g.normal(size=n)
        y[g.random(n) < 0.3] = np.nan
        y[:2] = np.nan if n > 100 else y[:2]
        y[200:300] = np.nan
        parts.append(pd.DataFrame({"series": name, "i": range(1, n + 1), "x": y}))
    parts[2]["x"] = 5.0
    pdf = pd.concat([*parts, pd.DataFrame({"series": "none", "i": [1, 2], "x": np.nan})])
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("name", ["level", "season"])
def test_scan_equals_a_loop(gappy, monkeypatch, name):
    """Chunks of 40 rows, scanned by fours, so that there are groups of groups."""
    monkeypatch.setattr(S, "CHUNK", 40)
    monkeypatch.setattr(S, "FAN", 4)
    monkeypatch.setattr(S, "AT_ONCE", 3)
    pdf, df = gappy
    model = MODELS[name]
    got = S.smoothed(df.withColumnRenamed("x", "v"), "v", model).toPandas().sort_values(["series", "i"])
    assert len(got) == len(pdf)
    for series, own in pdf.groupby("series"):
        mine = got[got["series"] == series]
        assert list(mine["i"]) == list(own["i"])
        if series == "none":
            assert mine.iloc[:, 2:].isna().all().all()
            continue
        want = plain(own["x"].to_numpy(), model, own["x"].dropna().iloc[0])
        assert np.allclose(mine.iloc[:, 2:].to_numpy(float), want, atol=1e-6, rtol=1e-6)


def test_filter_alone_is_the_same_and_no_series_is_one_task(gappy, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 50)
    _, df = gappy
    one = S.smoothed(df, "x", MODELS["level"], smooth=False)
    exchanges = [line for line in one._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(series" in line]
    assert exchanges and all("chunk" in line or ", i#" in line for line in exchanges)
    both = S.smoothed(df, "x", MODELS["level"])
    a, b = (d.toPandas().sort_values(["series", "i"])["filtered"].to_numpy() for d in (one, both))
    assert np.allclose(a, b, equal_nan=True)
    assert S.smoothed(df.limit(0), "x", MODELS["level"]).count() == 0


def test_season_and_trend_fill_a_gap(spark):
    i = np.arange(1, 401)
    truth = 0.05 * i + 3 * np.sin(2 * np.pi * i / 24)
    x = np.where((i > 180) & (i < 230), np.nan, truth)
    df = spark.createDataFrame(pd.DataFrame({"series": "a", "i": i, "x": x}))
    model = S.structural(1e-4, 1e-6, 1e-6, 24, 1, 0.01)
    out = S.interval(S.smoothed(df, "x", model), model).toPandas().sort_values("i")
    assert np.abs(out["smoothed"].to_numpy() - truth).max() < 0.2
    assert ((out["lo"] < truth) & (truth < out["hi"])).mean() > 0.95
