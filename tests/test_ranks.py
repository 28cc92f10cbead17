"""Row numbers and percentiles of large groups against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import ranks


@pytest.fixture(scope="module")
def frame(spark):
    g = np.random.default_rng(5)
    rows = [("hot" if k % 3 else f"s{k % 7}", int(g.integers(0, 50)), k, float(np.round(g.normal(), 2)) if k % 11 else None) for k in range(5000)]
    rows += [(None, 1, 5000, 1.0), (None, 0, 5001, 2.0), ("one", 3, 5002, None)]
    return spark.createDataFrame(rows, "series string, ts int, id int, x double")


def test_numbers_equal_row_numbers(frame):
    got = {(r.id): r.i for r in ranks.numbered(frame, ["series"], ["ts", "id"]).collect()}
    rows = frame.toPandas().sort_values(["series", "ts", "id"])
    rows["i"] = rows.groupby("series", dropna=False).cumcount() + 1
    assert got == dict(zip(rows["id"], rows["i"], strict=True))


def test_no_task_holds_a_series(frame):
    plan = ranks.numbered(frame, ["series"], ["ts", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("parquet")[-1] and "hashpartitioning(series" not in plan
    assert ranks.numbered(frame.limit(0), ["series"], ["ts"]).count() == 0


@pytest.mark.parametrize("accuracy", [100_000, 200])
def test_percentiles_are_exact(frame, monkeypatch, accuracy):
    """With few rows every value is counted; with a coarse sketch only those between the brackets."""
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    p = [0.0, 0.025, 0.25, 0.5, 0.9, 1.0]
    got = {r.series: r.q for r in ranks.percentiles(frame, ["series"], "x", p).collect()}
    want = frame.filter("x is not null").groupBy("series").agg(F.percentile("x", F.array(*map(F.lit, p))).alias("q")).collect()
    assert len(got) == len(want) and all(np.allclose(got[r.series], r.q, atol=1e-12) for r in want)
    whole = ranks.percentiles(frame, [], "x", [0.5]).collect()
    assert whole[0].q[0] == pytest.approx(frame.agg(F.median("x")).first()[0])
    assert ranks.percentiles(frame.limit(0), ["series"], "x", [0.5]).count() == 0
