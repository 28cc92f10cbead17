"""The registry of fill methods, the imputer classes, and pipelines built from JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import kernels as K
from ..operators import series as S
from ..operators import spectra, statespace
from ..operators import stats as T
from ..operators.ranks import medians, numbered

#: fill(df with series, i and the column, column, output column, parameters) -> df with the output column
Fill = Callable[..., DataFrame]


@dataclass(frozen=True)
class Method:
    name: str
    fill: Fill
    kind: str
    doc: str
    defaults: dict = field(default_factory=dict)


METHODS: dict[str, Method] = {}


def register_method(name: str, fill: Fill, kind: str = "plug-in", doc: str = "", **defaults) -> None:
    METHODS[name] = Method(name, fill, kind, doc, defaults)


@contextmanager
def plugged_in(name: str, fill: Fill, kind: str = "plug-in", doc: str = "", **defaults) -> Iterator[None]:
    """A method that is registered within, and gone (or what it was before) after."""
    before = METHODS.get(name)
    register_method(name, fill, kind, doc, **defaults)
    try:
        yield
    finally:
        if before is None:
            del METHODS[name]
        else:
            METHODS[name] = before


def _whole(f):
    return lambda df, x, out, **p: f(df, x, out, **p)


def _window(f):
    return lambda df, x, out, **p: df.withColumn(out, f(F.col(x), **p))


def _joined(f):
    """A fill that returns (series, i, filled)."""

    def run(df: DataFrame, x: str, out: str, **p) -> DataFrame:
        return df.join(f(df, x, **p).withColumnRenamed("filled", out), [S.BY, S.AT], "left")

    return run


def _constant(aggregate):
    """One value per series, joined as a small aggregate."""

    def run(df: DataFrame, x: str, out: str) -> DataFrame:
        return df.join(df.groupBy(S.BY).agg(aggregate(x).alias("c__")), S.BY).withColumn(out, F.coalesce(x, "c__")).drop("c__")

    return run


def _median(df: DataFrame, x: str, out: str) -> DataFrame:
    return df.join(medians(df, [S.BY], x, "c__"), S.BY, "left").withColumn(out, F.coalesce(x, "c__")).drop("c__")


def _mode(df: DataFrame, x: str, out: str) -> DataFrame:
    counts = df.filter(F.col(x).isNotNull()).groupBy(S.BY, x).count()
    best = counts.groupBy(S.BY).agg(F.min(F.struct((-F.col("count")).alias("n"), x)).alias("b")).select(S.BY, F.col(f"b.{x}").alias("c__"))
    return df.join(best, S.BY, "left").withColumn(out, F.coalesce(x, "c__")).drop("c__")


def _sampled(df: DataFrame, x: str, out: str, seed: int = 42) -> DataFrame:
    """A seeded random observed value of the series: observed rows are numbered, each gap picks a number."""
    seen = numbered(df.filter(F.col(x).isNotNull()).select(S.BY, S.AT, F.col(x).alias("c__")), [S.BY], [S.AT], "k__").drop(S.AT)
    n = seen.groupBy(S.BY).agg(F.count(F.lit(1)).alias("n__"))
    gaps = df.join(n, S.BY, "left").withColumn("k__", F.when(F.col(x).isNull(), F.pmod(F.xxhash64(S.BY, S.AT, F.lit(seed)), F.col("n__")).cast("int") + 1))
    return gaps.join(seen, [S.BY, "k__"], "left").withColumn(out, F.coalesce(x, "c__")).drop("k__", "c__", "n__")


def _kalman(df: DataFrame, x: str, **p) -> DataFrame:
    f = statespace.smoothed(df, x, statespace.local_level(**p), smooth=False).select(S.BY, S.AT, "filtered")
    return df.select(S.BY, S.AT, x).join(f, [S.BY, S.AT]).select(S.BY, S.AT, F.coalesce(x, "filtered").alias("filled"))


def adaptive(df: DataFrame, x: str, out: str) -> DataFrame:
    """Context-weighted mean of members: linear near small gaps, local mean in noise, seasonal slots in long gaps. Weights below 0.1 drop out;
    where none is left, the mean of the series."""
    d = S.local_context(S.linear(df, x, "lin__"), x)
    col = F.col(x)
    d = S.local_mean(d, x, "loc__").withColumns({"sea__": S.seasonal_slot(col), "avg__": F.avg(x).over(Window.partitionBy(S.BY))})
    gap = F.coalesce(F.col("gap_size"), F.lit(0))
    weights = {"lin__": F.when(gap <= 3, 0.7).when(gap <= 12, 0.4).otherwise(0.1), "loc__": 0.2 + 0.2 * F.least(F.lit(1.0), F.coalesce("missing_ratio", F.lit(0.0))), "sea__": F.when(gap > 12, 0.6).when(gap > 3, 0.3).otherwise(0.05)}
    kept = {k: F.when((w > 0.1) & F.col(k).isNotNull(), w).otherwise(0.0) for k, w in weights.items()}
    total = sum(kept.values(), F.lit(0.0))
    mean = sum((w * F.coalesce(F.col(k), F.lit(0.0)) for k, w in kept.items()), F.lit(0.0)) / F.when(total > 0, total)
    return d.withColumn(out, F.coalesce(col, mean, "avg__")).drop("lin__", "loc__", "sea__", "avg__", "missing_ratio", "variance", "trend", "gap_size", "edge")


for _name, _fill, _kind, _doc, _defaults in (
    ("mean", _constant(F.avg), "simple", "mean of the series", {}),
    ("median", _median, "simple", "median of the series", {}),
    ("mode", _mode, "simple", "most frequent value, smallest on ties", {}),
    ("random_sample", _sampled, "simple", "seeded draw of an observed value", {}),
    ("forward_fill", _whole(S.forward_filled), "simple", "last value", {"limit": None}),
    ("backward_fill", _whole(S.backward_filled), "simple", "next value", {"limit": None}),
    ("both_fill", _whole(S.both_fills), "simple", "last value, then next", {}),
    ("linear", _whole(S.linear), "interpolation", "straight lines by row", {}),
    ("pchip", _whole(S.pchip), "interpolation", "monotone cubic", {}),
    ("akima", _whole(S.akima), "interpolation", "Akima cubic", {}),
    ("spline", _joined(K.spline), "interpolation", "not-a-knot spline", {}),
    ("polynomial", _joined(K.polynomial), "interpolation", "local polynomial", {}),
    ("convolution", lambda df, x, out, sigma=5 / 3, radius=5: S.convolved(df, x, out, sigma, radius), "interpolation", "linear, then Gaussian smoothing", {}),
    ("moving_average", _whole(S.moving_average), "window", "centred mean", {"window": 24}),
    ("local_mean", _whole(S.local_mean), "window", "mean nearby", {}),
    ("local_linear", _whole(S.local_linear), "window", "regression nearby", {}),
    ("periodic", _window(S.periodic), "seasonal", "same place one and two periods away", {"period": 24}),
    ("seasonal_slot", _window(S.seasonal_slot), "seasonal", "mean of the slot", {"period": 24}),
    ("seasonal", _whole(S.seasonal), "seasonal", "trend and season, then linear", {"period": 24}),
    ("kalman", _joined(_kalman), "state space", "random-walk filter", {}),
    ("gaussian_process", _joined(K.gaussian_process), "kernel", "RBF and noise", {}),
    ("fourier", _joined(spectra.fourier), "kernel", "strongest frequencies", {}),
    ("kernel_ridge", _joined(K.kernel_ridge), "kernel", "Laplacian kernel ridge", {}),
    ("adaptive", adaptive, "ensemble", "context-weighted members", {}),
):
    register_method(_name, _fill, _kind, _doc, **_defaults)


def impute(df: DataFrame, x: str, method: str, out: str | None = None, **parameters) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}; known: {', '.join(sorted(METHODS))}")
    m = METHODS[method]
    return m.fill(df, x, out or f"{x}_filled", **{**m.defaults, **parameters})


class Imputer:
    """fit / transform over one method; fit checks the parameters, transform is stateless."""

    def __init__(self, method: str, column: str, **parameters):
        self.method, self.column, self.parameters = method, column, parameters

    def fit(self, df: DataFrame) -> Imputer:
        missing = {S.BY, S.AT, self.column} - set(df.columns)
        if missing:
            raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
        if self.method not in METHODS:
            raise ValueError(f"unknown method: {self.method}")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return impute(df, self.column, self.method, **self.parameters)


def step(df: DataFrame, op: dict) -> DataFrame:
    """One operation of a pipeline: impute, filter, transform, validate, select, multiply."""
    kind, p = op["op"], {k: v for k, v in op.items() if k != "op"}
    if kind == "impute":
        return impute(df, p.pop("column"), p.pop("method", "mean"), p.pop("out", None), **p)
    if kind == "filter":
        if "condition" in p:
            df = df.filter(F.expr(p["condition"]))
        return T.outliers_dropped(df, p["outliers"], p.get("z", 3.0)) if "outliers" in p else df
    if kind == "transform":
        for c, how in p["columns"].items():
            if how == "normalize":
                df = T.min_max(df, [c])
            elif how == "standardize":
                df = T.standardised(df, [c])
            elif how == "log":
                df = df.withColumn(c, T.log1p_clipped(c))
            elif how == "diff":
                df = df.withColumn(c, F.col(c) - F.lag(c).over(S.ordered()))
            else:
                raise ValueError(f"unknown transform: {how}")
        return df
    if kind == "validate":
        flags = [F.col(c).isNull() for c in p["columns"]]
        out = flags[0]
        for f in flags[1:]:
            out = out | f
        return df.withColumn("has_missing", out)
    if kind == "select":
        if unknown := [c for c in p["columns"] if c not in df.columns]:
            raise ValueError(f"unknown columns: {', '.join(unknown)}")
        return df.select(*p["columns"])
    if kind == "multiply":
        return df.withColumn(p["out"], F.col(p["column"]) * F.lit(p["by"]))
    raise ValueError(f"operation not allowed: {kind}")


def run_pipeline(df: DataFrame, spec: str | list[dict]) -> DataFrame:
    """Applies a list of operations (JSON text or parsed); one plan, nothing in between is materialised."""
    for op in json.loads(spec) if isinstance(spec, str) else spec:
        df = step(df, op)
    return df


def methods_table(spark) -> DataFrame:
    return spark.createDataFrame([(m.name, m.kind, m.doc, json.dumps(m.defaults, sort_keys=True)) for m in sorted(METHODS.values(), key=lambda m: m.name)], "name string, kind string, doc string, parameters string")
