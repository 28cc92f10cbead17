"""Operators on ordered series: fills, interpolation, gaps, autocorrelation, local statistics.

Frames are long: `series` (partition key), `i` (row number within the series), a value column. All windows are partitioned by
series and share one sort. Missing is NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BY, AT = "series", "i"
#: Rows of a series that are sorted together.
CHUNK = 1 << 16


def ordered(by: str = BY, at: str = AT) -> WindowSpec:
    return Window.partitionBy(by).orderBy(at)


def rows(lo: int | None, hi: int | None, by: str = BY, at: str = AT) -> WindowSpec:
    return ordered(by, at).rowsBetween(Window.unboundedPreceding if lo is None else lo, Window.unboundedFollowing if hi is None else hi)


NEAR = ("pv", "pi", "nv", "ni")


def last_seen(limit: int | None = None) -> Column:
    """Of what `neighbours` gives: the last value, at most `limit` rows before."""
    return F.col("pv") if limit is None else F.when(F.col(AT) - F.col("pi") <= limit, F.col("pv"))


def next_seen(limit: int | None = None) -> Column:
    """Of what `neighbours` gives: the next value, at most `limit` rows after."""
    return F.col("nv") if limit is None else F.when(F.col("ni") - F.col(AT) <= limit, F.col("nv"))


def forward_filled(df: DataFrame, x: str, out: str, limit: int | None = None) -> DataFrame:
    return neighbours(df, x).withColumn(out, last_seen(limit)).drop(*NEAR)


def backward_filled(df: DataFrame, x: str, out: str, limit: int | None = None) -> DataFrame:
    return neighbours(df, x).withColumn(out, next_seen(limit)).drop(*NEAR)


def both_fills(df: DataFrame, x: str, out: str, limit: int | None = None) -> DataFrame:
    """Forward, then backward over what is left; the second pass sees the first."""
    if limit is None:
        return neighbours(df, x).withColumn(out, F.coalesce("pv", "nv")).drop("pv", "pi", "nv", "ni")

    def add(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn(out, F.last(x, ignorenulls=True).over(w.rowsBetween(-limit, 0)))
        return d.withColumn(out, F.first(out, ignorenulls=True).over(w.rowsBetween(0, limit)))

    return locally(df, 2 * limit, add)


def neighbours(df: DataFrame, x: str, chunk: int = CHUNK) -> DataFrame:
    """pv, pi, nv, ni: the nearest observed value and row before (or at) and after (or at) each row.

    A series is cut into chunks of rows, which are sorted by themselves; each chunk's first and last observed values (a small table, one row per
    chunk) are carried over the chunks of a series and joined back. So a series of any length is spread over tasks."""
    place = F.floor(F.col(AT) / chunk).cast("long")
    seen = F.when(F.col(x).isNotNull(), F.struct(F.col(x).alias("v"), F.col(AT).alias("at")))
    cut = df.withColumns({"chunk__": place, "seen__": seen})
    ends = cut.groupBy(BY, "chunk__").agg(F.max_by("seen__", F.when(F.col(x).isNotNull(), F.col(AT))).alias("last"), F.min_by("seen__", F.when(F.col(x).isNotNull(), F.col(AT))).alias("first"))
    w = Window.partitionBy(BY).orderBy("chunk__")
    back = Window.partitionBy(BY).orderBy(F.desc("chunk__"))
    before = F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("first", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(F.col(BY).alias("series__"), F.col("chunk__").alias("c__"), before.alias("before__"), after.alias("after__"))
    inside = Window.partitionBy(BY, "chunk__")
    up, down = (inside.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc(AT), F.desc(AT)))
    near = cut.withColumns({"p__": F.last("seen__", ignorenulls=True).over(up), "n__": F.last("seen__", ignorenulls=True).over(down)})
    near = near.join(carried, F.col(BY).eqNullSafe(F.col("series__")) & (F.col("chunk__") == F.col("c__")), "left")
    p, n = F.coalesce("p__", "before__"), F.coalesce("n__", "after__")
    return near.withColumns({"pv": p["v"], "pi": p["at"], "nv": n["v"], "ni": n["at"]}).drop("chunk__", "seen__", "series__", "c__", "before__", "after__", "p__", "n__")


def observed_before(df: DataFrame, x: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """How many observed rows a series has up to each row, itself included: counted within chunks of rows, to which the chunks before are added
    (one row per chunk)."""
    cut = df.withColumn("chunk__", F.floor(F.col(AT) / chunk).cast("long"))
    w = Window.partitionBy(BY).orderBy("chunk__").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(BY, "chunk__").agg(F.count(x).alias("n__"))
    carried = sums.select(F.col(BY).alias("series__"), F.col("chunk__").alias("c__"), F.coalesce(F.sum("n__").over(w), F.lit(0)).alias("n__"))
    inside = F.count(x).over(Window.partitionBy(BY, "chunk__").orderBy(AT).rowsBetween(Window.unboundedPreceding, 0))
    near = cut.withColumn("in__", inside).join(carried, F.col(BY).eqNullSafe(F.col("series__")) & (F.col("chunk__") == F.col("c__")))
    return near.withColumn(out, F.col("in__") + F.col("n__")).drop("chunk__", "series__", "c__", "in__", "n__")


def linear(df: DataFrame, x: str, out: str, limit: int | None = None, direction: str = "both") -> DataFrame:
    """Linear interpolation by row position; beyond the ends the nearest value. limit: rows filled from each observed side."""
    i = F.col(AT)
    inside = F.col("pv") + (F.col("nv") - F.col("pv")) * (i - F.col("pi")) / (F.col("ni") - F.col("pi"))
    value = F.when(F.col(x).isNotNull(), F.col(x)).when(F.col("pv").isNotNull() & F.col("nv").isNotNull(), inside)
    value = value.otherwise({"both": F.coalesce("pv", "nv"), "forward": F.col("pv"), "backward": F.col("nv")}[direction])
    if limit is not None:
        ahead, back = i - F.col("pi") <= limit, F.col("ni") - i <= limit
        near = {"both": F.coalesce(ahead, F.lit(False)) | F.coalesce(back, F.lit(False)), "forward": ahead, "backward": back}[direction]
        value = F.when(F.col(x).isNotNull() | near, value)
    elif direction == "forward":
        value = F.when(F.col(x).isNotNull() | F.col("pv").isNotNull(), value)
    elif direction == "backward":
        value = F.when(F.col(x).isNotNull() | F.col("nv").isNotNull(), value)
    return neighbours(df, x).withColumn(out, value).drop("pv", "pi", "nv", "ni")


def locally(df: DataFrame, reach: int, add: Callable[[DataFrame, WindowSpec], DataFrame]) -> DataFrame:
    """What `add` makes of the frame and a window in row order that it may open up to `reach` rows either way. A series is cut into chunks, each with copies of
    the rows within reach of it, so that a series of any length is spread over tasks."""
    at = F.col(AT)
    copies = F.explode_outer(F.sequence(F.floor((at - reach) / CHUNK), F.floor((at + reach) / CHUNK)))
    out = add(df.withColumn("chunk__", copies), Window.partitionBy(BY, "chunk__").orderBy(AT))
    return out.filter(F.col("chunk__").eqNullSafe(F.floor(at / CHUNK))).drop("chunk__")


def moving_average(df: DataFrame, x: str, out: str, window: int = 24, min_periods: int = 1) -> DataFrame:
    """Centred mean over rows -(w // 2) .. (w - 1) // 2; what is left takes the expanding mean of the filled series."""

    def add(d: DataFrame, inside: WindowSpec) -> DataFrame:
        w = inside.rowsBetween(-(window // 2), (window - 1) // 2)
        return d.withColumn(out, F.coalesce(F.col(x), F.when(F.count(x).over(w) >= min_periods, F.avg(x).over(w))))

    return locally(df, window // 2, add).withColumn(out, F.coalesce(F.col(out), F.avg(out).over(rows(None, 0))))


def local_mean(df: DataFrame, x: str, out: str, radius: int = 12) -> DataFrame:
    """Mean of observed rows within the radius, or within twice the radius where there are none."""
    return locally(df, 2 * radius, lambda d, w: d.withColumn(out, F.coalesce(x, *(F.avg(x).over(w.rowsBetween(-r, r)) for r in (radius, 2 * radius)))))


def local_linear(df: DataFrame, x: str, out: str, radius: int = 10) -> DataFrame:
    """Least-squares line through the observed rows within the radius, at the gap; needs two of them."""
    y, i = F.col(x), F.col(AT).cast("double")

    def add(d: DataFrame, inside: WindowSpec) -> DataFrame:
        w = inside.rowsBetween(-radius, radius)
        fit = F.regr_intercept(y, i).over(w) + F.regr_slope(y, i).over(w) * i
        return d.withColumn(out, F.coalesce(y, F.when(F.count(y).over(w) >= 2, fit)))

    return locally(df, radius, add)


def periodic(x: Column, period: int = 24) -> Column:
    """Mean of the observed values one and two periods away."""
    near = F.array(*(f(x, k * period).over(ordered()) for k in (1, 2) for f in (F.lag, F.lead)))
    seen = F.filter(near, lambda v: v.isNotNull())
    return F.coalesce(x, F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda a, v: a + v) / F.size(seen)))


def seasonal_slot(x: Column, period: int = 24) -> Column:
    """Mean of the same slot (row modulo period) of the series."""
    return F.coalesce(x, F.avg(x).over(Window.partitionBy(BY, F.pmod(F.col(AT), F.lit(period)))))


def convolved(df: DataFrame, x: str, out: str, sigma_rows: float, radius: int) -> DataFrame:
    """Linear interpolation, then smoothing by Gaussian weights with reflected edges; observed values stay."""
    import math

    weights = [math.exp(-0.5 * (k / sigma_rows) ** 2) for k in range(-radius, radius + 1)]
    total = sum(weights)
    base = linear(df, x, "lin")
    near = rows(-radius, radius)
    last = F.max(AT).over(Window.partitionBy(BY))
    # reflected neighbours of row i at distance k: i + k, turned round at the ends
    window = F.map_from_entries(F.collect_list(F.struct(AT, "lin")).over(near))
    base = base.withColumn("near", window).withColumn("last", last)

    def at(k: int) -> Column:
        j = F.col(AT) + k
        j = F.when(j < 1, 1 - j).otherwise(j)
        return F.element_at("near", F.when(j > F.col("last"), 2 * F.col("last") + 1 - j).otherwise(j))

    smooth = sum(at(k) * (w / total) for k, w in zip(range(-radius, radius + 1), weights, strict=True))
    return base.withColumn(out, F.coalesce(F.col(x), smooth)).drop("near", "last", "lin")


def knots(df: DataFrame, x: str) -> DataFrame:
    """Observed rows (series, k, at, y) numbered by k, with the slopes to the next two and from the last two knots."""
    seen = df.filter(F.col(x).isNotNull()).select(BY, F.col(AT).alias("at"), F.col(x).alias("y"))
    w = Window.partitionBy(BY).orderBy("at")
    m = F.try_divide(F.lead("y").over(w) - F.col("y"), F.lead("at").over(w) - F.col("at"))
    return seen.withColumn("k", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(BY))).withColumn("m0", m).withColumns(
        {"m1": F.lead("m0", 1).over(w), "p1": F.lag("m0", 1).over(w), "p2": F.lag("m0", 2).over(w), "h0": F.lead("at").over(w) - F.col("at"), "h1": F.col("at") - F.lag("at").over(w)})


def hermite(df: DataFrame, x: str, out: str, slopes: DataFrame) -> DataFrame:
    """Cubic through knots with the slopes d (series, at, y, d); nothing beyond the ends."""
    w = Window.partitionBy(BY).orderBy("at")
    spans = slopes.select(BY, F.col("at").alias(AT), F.col("y").alias("y0"), F.col("d").alias("d0"), F.lead("at").over(w).alias("at1"), F.lead("y").over(w).alias("y1"), F.lead("d").over(w).alias("d1"), F.col("at").alias("at0"))
    names = ("y0", "d0", "at1", "y1", "d1", "at0")
    rest = df.join(spans, [BY, AT], "left").withColumn("span", F.when(F.col("at0").isNotNull(), F.struct(*names)))
    rest = forward_filled(rest.drop(*names), "span", "carried").select("*", *(F.col("carried")[c].alias(c) for c in names)).drop("span", "carried")
    h, t = F.col("at1") - F.col("at0"), F.try_divide(F.col(AT) - F.col("at0"), F.col("at1") - F.col("at0"))
    value = (2 * t**3 - 3 * t**2 + 1) * F.col("y0") + (t**3 - 2 * t**2 + t) * h * F.col("d0") + (-2 * t**3 + 3 * t**2) * F.col("y1") + (t**3 - t**2) * h * F.col("d1")
    return rest.withColumn(out, F.coalesce(F.col(x), value)).drop("y0", "d0", "at1", "y1", "d1", "at0")


def pchip(df: DataFrame, x: str, out: str) -> DataFrame:
    """Monotone cubic: harmonic-mean slopes inside, one-sided three-point slopes at the ends."""
    k = knots(df, x)
    w1, w2 = 2 * F.col("h0") + F.col("h1"), F.col("h0") + 2 * F.col("h1")
    inner = F.when(F.col("p1") * F.col("m0") <= 0, 0.0).otherwise(F.try_divide(w1 + w2, F.try_divide(w1, F.col("p1")) + F.try_divide(w2, F.col("m0"))))

    def edge(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
        d = F.try_divide((2 * h0 + h1) * m0 - h0 * m1, h0 + h1)
        return F.when(m1.isNull(), m0).when(F.signum(d) != F.signum(m0), 0.0).when((F.signum(m0) != F.signum(m1)) & (F.abs(d) > 3 * F.abs(m0)), 3 * m0).otherwise(d)

    w = Window.partitionBy(BY).orderBy("at")
    first = edge(F.col("h0"), F.lead("h0").over(w), F.col("m0"), F.col("m1"))
    last = edge(F.col("h1"), F.lag("h1").over(w), F.col("p1"), F.col("p2"))
    d = F.when(F.col("n") == 1, 0.0).when(F.col("k") == 1, first).when(F.col("k") == F.col("n"), last).otherwise(inner)
    return hermite(df, x, out, k.withColumn("d", d))


def akima(df: DataFrame, x: str, out: str) -> DataFrame:
    """Akima's slopes from two neighbours on each side, extended linearly beyond the ends; under five knots: linear."""
    k = knots(df, x)
    w = Window.partitionBy(BY).orderBy("at")
    # slopes m(-2) .. m(n+1): extend m by m[-1] = 2 m0 - m1 and so on
    ahead = k.withColumns({"b0": F.col("m0"), "b1": F.col("m1"), "a1": F.col("p1"), "a2": F.col("p2")})
    ahead = ahead.withColumns({
        "first0": F.first("m0").over(w), "first1": F.nth_value("m0", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "last0": F.max(F.when(F.col("k") == F.col("n") - 1, F.col("m0"))).over(Window.partitionBy(BY)), "last1": F.max(F.when(F.col("k") == F.col("n") - 2, F.col("m0"))).over(Window.partitionBy(BY))})
    low1, low2 = 2 * F.col("first0") - F.col("first1"), 3 * F.col("first0") - 2 * F.col("first1")
    top1, top2 = 2 * F.col("last0") - F.col("last1"), 3 * F.col("last0") - 2 * F.col("last1")
    kk, n = F.col("k"), F.col("n")
    a1 = F.when(kk == 1, low1).otherwise(F.col("a1"))
    a2 = F.when(kk == 1, low2).when(kk == 2, low1).otherwise(F.col("a2"))
    b0 = F.when(kk == n, top1).otherwise(F.col("b0"))
    b1 = F.when(kk == n, top2).when(kk == n - 1, top1).otherwise(F.col("b1"))
    u, v = F.abs(b1 - b0), F.abs(a1 - a2)
    slopes = ahead.withColumn("d", F.when(u + v == 0, (a1 + b0) / 2).otherwise(F.try_divide(u * a1 + v * b0, u + v)))
    few = df.groupBy(BY).agg(F.count(x).alias("n_seen"))
    both = hermite(df, x, "cubic", slopes)
    both = linear(both, x, "straight").join(few, BY)
    inside = F.col("cubic").isNotNull()
    return both.withColumn(out, F.when(F.col("n_seen") >= 5, F.col("cubic")).when(inside, F.col("straight")).otherwise(F.col(x))).drop("cubic", "straight", "n_seen")


def autocorrelation(df: DataFrame, x: str, max_lag: int = 24) -> DataFrame:
    """(series, lag, acf) of the observed values in order."""
    seen = df.filter(F.col(x).isNotNull()).select(BY, AT, F.col(x).alias("x"))
    lagged = seen.select(BY, "x", F.array(*(F.lag("x", k).over(ordered()) for k in range(1, max_lag + 1))).alias("p"))
    return lagged.select(BY, "x", F.posexplode("p").alias("k", "y")).groupBy(BY, (F.col("k") + 1).alias("lag")).agg(F.corr("x", "y").alias("acf"))


def gaps(df: DataFrame, x: str) -> DataFrame:
    """(series, start, length) of every run of missing rows."""
    miss = df.filter(F.col(x).isNull()).select(BY, AT, (F.col(AT) - F.row_number().over(ordered())).alias("run"))
    return miss.groupBy(BY, "run").agg(F.min(AT).alias("start"), F.count(F.lit(1)).alias("length")).drop("run")


def uncertainty(df: DataFrame, x: str, filled: str, out: str, window: int = 24) -> DataFrame:
    """1.96 x centred sample deviation of the filled values x (1 + share missing), at missing rows."""

    def add(d: DataFrame, inside: WindowSpec) -> DataFrame:
        w = inside.rowsBetween(-(window // 2), (window - 1) // 2)
        value = 1.96 * F.stddev_samp(filled).over(w) * (1 + F.avg(F.col(x).isNull().cast("double")).over(w))
        return d.withColumn(out, F.when(F.col(x).isNull(), value))

    return locally(df, window // 2, add)


def local_context(df: DataFrame, x: str, radius: int = 24) -> DataFrame:
    """Share missing, sample variance, trend per deviation, gap size and distance to the nearer end, over rows -radius .. radius - 1."""
    w, i = rows(-radius, radius - 1), F.when(F.col(x).isNotNull(), F.col(AT).cast("double"))
    run = df.join(gaps(df, x).withColumnRenamed("start", AT), [BY, AT], "left")
    y = F.col(x)
    n, sx, sy = F.count(y).over(w), F.sum(i).over(w), F.sum(y).over(w)
    d = n * F.sum(i * i).over(w) - sx * sx
    slope = F.when((n >= 2) & (d != 0), (n * F.sum(i * y).over(w) - sx * sy) / d)
    return run.withColumns({
        "missing_ratio": F.avg(y.isNull().cast("double")).over(w), "variance": F.var_samp(y).over(w),
        "trend": slope / F.when(F.stddev_samp(y).over(w) > 0, F.stddev_samp(y).over(w)),
        "gap_size": F.when(y.isNull(), F.last("length", ignorenulls=True).over(rows(None, 0))),
        "edge": F.least(F.col(AT) - 1, F.count(F.lit(1)).over(Window.partitionBy(BY)) - F.col(AT))}).drop("length")


def lag_features(df: DataFrame, x: str, lags: int = 10) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(BY))
    angle = 2 * F.pi() * (F.col(AT) - 1) / n
    return df.withColumns({f"lag_{k}": F.lag(x, k).over(ordered()) for k in range(1, lags + 1)} | {"sin_i": F.sin(angle), "cos_i": F.cos(angle)})


def sequences(df: DataFrame, x: str, length: int = 24) -> DataFrame:
    """Training windows: the `length` rows before each row, and the row's value; only whole windows without gaps."""
    past = F.collect_list(x).over(rows(-length, -1))
    return df.withColumn("past", past).filter((F.size("past") == length) & F.col(x).isNotNull()).select(BY, AT, "past", F.col(x).alias("target"))


def decomposed(df: DataFrame, x: str, period: int = 24) -> DataFrame:
    """Classical additive split: centred trend (2 x m for even m), slot means of the rest centred on zero, residual."""
    half = period // 2
    if period % 2:
        trend = F.avg(x).over(rows(-half, half))
    else:
        trend = (F.sum(x).over(rows(-half, half - 1)) + F.sum(x).over(rows(-half + 1, half))) / (2 * period)
    whole = F.count(x).over(rows(-half, half)) == 2 * half + 1
    out = df.withColumn("trend", F.when(whole, trend)).withColumn("slot", F.pmod(F.col(AT) - 1, F.lit(period)))
    out = out.withColumn("raw", F.avg(F.col(x) - F.col("trend")).over(Window.partitionBy(BY, "slot")))
    means = out.select(BY, "slot", "raw").distinct().groupBy(BY).agg(F.avg("raw").alias("centre"))
    return out.join(means, BY).withColumn("seasonal", F.col("raw") - F.col("centre")).withColumn("residual", F.col(x) - F.col("trend") - F.col("seasonal")).drop("raw", "centre")


def seasonal(df: DataFrame, x: str, out: str, period: int = 24) -> DataFrame:
    """Mean fill, split, then seasonal + trend at the gaps; linear where the trend isn't defined."""
    filled = df.withColumn("mean_filled", F.coalesce(F.col(x), F.avg(x).over(Window.partitionBy(BY))))
    parts = decomposed(filled, "mean_filled", period)
    return linear(parts.withColumn(out, F.coalesce(F.col(x), F.col("seasonal") + F.col("trend"))), out, out).drop("mean_filled", "trend", "slot", "seasonal", "residual")


def recursive_local_mean(df: DataFrame, x: str, radius: int = 12) -> DataFrame:
    """(series, i, filled) where earlier fills feed later ones: one pandas call per series."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        v = pdf["x"].to_numpy(float).copy()
        import numpy as np

        for k in np.flatnonzero(np.isnan(v)):
            for r in (radius, 2 * radius):
                near = v[max(0, k - r) : k + r + 1]
                near = near[~np.isnan(near)]
                if len(near):
                    v[k] = near.mean()
                    break
        return pd.DataFrame({"series": pdf["series"], "i": pdf["i"], "filled": v})

    return df.select(F.col(BY).alias("series"), F.col(AT).alias("i"), F.col(x).alias("x")).groupBy("series").applyInPandas(run, "series string, i long, filled double")


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide to long: keys, variable, value."""
    return df.unpivot(list(keys), list(columns), "variable", "value")


def wide_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).pivot("variable", list(columns)).agg(F.first("value"))


def stable_ts(df: DataFrame) -> DataFrame:
    """Minutes to the row before (null for the first)."""
    return df.withColumn("step_s", F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lag(F.unix_timestamp(F.col("ts").cast("timestamp"))).over(ordered()))
