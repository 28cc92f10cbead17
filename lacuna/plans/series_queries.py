"""Queries of the ordered-series operators (fills, interpolation, gaps, autocorrelation), each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as S
from ..operators import statespace
from ..operators.ranks import medians
from .tables import G, r6, register, rounded, sensors

W = "PARTITION BY series ORDER BY i"
PREV = f"""n AS (SELECT *, last_value(x IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi,
  first_value(x IGNORE NULLS) OVER q AS nv, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER q AS ni FROM g
  WINDOW p AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
LIN = "coalesce(x, CASE WHEN pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) * (i - pi) / (ni - pi) END, pv, nv)"


@register("slice_linear_fill", f"""WITH {G}, {PREV}, f AS (SELECT *, {LIN} AS lin FROM n)
SELECT series, count(*) AS n, count(*) FILTER (WHERE x IS NULL) AS filled, round(avg(x), 6) AS mean_before, round(avg(lin), 6) AS mean_after,
  round(sqrt(avg((lin - truth) * (lin - truth)) FILTER (WHERE x IS NULL)), 6) AS rmse FROM f GROUP BY series""")
def slice_linear_fill(spark, sf_dir):
    """Read, inject gaps, interpolate, judge against the truth: per series."""
    f = S.linear(sensors(spark, sf_dir), "x", "lin")
    miss = F.col("x").isNull()
    error = F.when(miss, F.pow(F.col("lin") - F.col("truth"), 2))
    return rounded(f.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.count_if(miss).alias("filled"), F.avg("x").alias("mean_before"), F.avg("lin").alias("mean_after"), F.sqrt(F.avg(error)).alias("rmse")))


@register("win_01_03_fills", f"""WITH {G}, f AS (SELECT *, last_value(x IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ffill,
  last_value(x IGNORE NULLS) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS ffill_2,
  first_value(x IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bfill,
  first_value(x IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS bfill_2 FROM g)
SELECT series, i, {r6('ffill', 'ffill_2', 'bfill', 'bfill_2')}, round(first_value(ffill IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS both,
  round(first_value(ffill_2 IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 6) AS both_2 FROM f""")
def win_01_03_fills(spark, sf_dir):
    d = S.neighbours(sensors(spark, sf_dir), "x")
    d = d.withColumns({"ffill": S.last_seen(), "ffill_2": S.last_seen(2), "bfill": S.next_seen(), "bfill_2": S.next_seen(2), "both": F.coalesce("pv", "nv")}).drop(*S.NEAR)
    d = S.both_fills(d, "x", "both_2", 2)
    return rounded(d.select("series", "i", "ffill", "ffill_2", "bfill", "bfill_2", "both", "both_2"))


@register("win_04_06_linear", f"""WITH {G}, {PREV}
SELECT series, i, round({LIN}, 6) AS lin, round(CASE WHEN x IS NOT NULL OR i - pi <= 2 OR ni - i <= 2 THEN {LIN} END, 6) AS lin_2,
  round(CASE WHEN x IS NOT NULL OR i - pi <= 2 THEN {LIN} END, 6) AS ahead_2 FROM n""")
def win_04_06_linear(spark, sf_dir):
    d = S.linear(S.linear(S.linear(sensors(spark, sf_dir), "x", "lin"), "x", "lin_2", 2), "x", "ahead_2", 2, "forward")
    return rounded(d.select("series", "i", "lin", "lin_2", "ahead_2"))


@register("win_07_moving_average", f"""WITH {G}, f AS (SELECT *, coalesce(x, avg(x) OVER ({W} ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)) AS m,
  coalesce(x, CASE WHEN count(x) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) >= 3 THEN avg(x) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END) AS s FROM g)
SELECT series, i, round(coalesce(m, avg(m) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS ma_24,
  round(coalesce(s, avg(s) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS ma_5 FROM f""")
def win_07_moving_average(spark, sf_dir):
    d = S.moving_average(S.moving_average(sensors(spark, sf_dir), "x", "ma_24"), "x", "ma_5", 5, 3)
    return rounded(d.select("series", "i", "ma_24", "ma_5"))


@register("win_08_local_mean", f"""WITH {G}
SELECT series, i, round(coalesce(x, avg(x) OVER ({W} ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), avg(x) OVER ({W} ROWS BETWEEN 24 PRECEDING AND 24 FOLLOWING)), 6) AS local FROM g""")
def win_08_local_mean(spark, sf_dir):
    return rounded(S.local_mean(sensors(spark, sf_dir), "x", "local").select("series", "i", "local"))


@register("win_08_local_mean_recursive", f"""WITH RECURSIVE {G}, a AS (SELECT series, list(x ORDER BY i) AS v, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY series),
f AS (SELECT series, 0::BIGINT AS k, n, v FROM a UNION ALL
  SELECT series, k + 1, n, CASE WHEN v[k + 1] IS NULL THEN list_concat(list_concat(v[1:k], [list_avg(v[greatest(1, k - 11):least(n, k + 13)])]), v[k + 2:n]) ELSE v END FROM f WHERE k < n)
SELECT series, unnest(range(1, n + 1)) AS i, round(unnest(v), 6) AS filled FROM f WHERE k = n""")
def win_08_local_mean_recursive(spark, sf_dir):
    return rounded(S.recursive_local_mean(sensors(spark, sf_dir), "x"))


@register("win_09_local_linear", f"""WITH {G}
SELECT series, i, round(coalesce(x, CASE WHEN count(x) OVER v >= 2 THEN regr_intercept(x, i) OVER v + regr_slope(x, i) OVER v * i END), 7) AS fit FROM g
WINDOW v AS ({W} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)""")
def win_09_local_linear(spark, sf_dir):
    return rounded(S.local_linear(sensors(spark, sf_dir), "x", "fit").select("series", "i", "fit"), 7)


@register("win_10_20_periodic_seasonal", f"""WITH {G}, p AS (SELECT *, list_filter([lag(x, 24) OVER w, lead(x, 24) OVER w, lag(x, 48) OVER w, lead(x, 48) OVER w], lambda v: v IS NOT NULL) AS near FROM g WINDOW w AS ({W}))
SELECT series, i, round(coalesce(x, list_avg(near)), 6) AS periodic, round(coalesce(x, avg(x) OVER (PARTITION BY series, i % 24)), 6) AS slot FROM p""")
def win_10_20_periodic_seasonal(spark, sf_dir):
    x = F.col("x")
    return rounded(sensors(spark, sf_dir).select("series", "i", S.periodic(x).alias("periodic"), S.seasonal_slot(x).alias("slot")))


ACF = f"""o AS (SELECT series, x, row_number() OVER ({W}) AS k FROM g WHERE x IS NOT NULL),
acf AS (SELECT a.series, lag, corr(a.x, b.x) AS acf FROM o a CROSS JOIN range(1, 25) t(lag) JOIN o b ON b.series = a.series AND b.k = a.k - lag GROUP BY a.series, lag)"""


@register("win_11_autocorrelation", f"WITH {G}, {ACF} SELECT series, CAST(lag AS BIGINT) AS lag, round(acf, 6) AS acf FROM acf")
def win_11_autocorrelation(spark, sf_dir):
    return rounded(S.autocorrelation(sensors(spark, sf_dir), "x").withColumn("lag", F.col("lag").cast("long")))


@register("win_12_uncertainty", f"""WITH {G}, {PREV}, f AS (SELECT *, {LIN} AS lin FROM n)
SELECT series, i, round(CASE WHEN x IS NULL THEN 1.96 * stddev_samp(lin) OVER v * (1 + avg(CASE WHEN x IS NULL THEN 1.0::DOUBLE ELSE 0 END) OVER v) END, 6) AS u FROM f
WINDOW v AS ({W} ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)""")
def win_12_uncertainty(spark, sf_dir):
    return rounded(S.uncertainty(S.linear(sensors(spark, sf_dir), "x", "lin"), "x", "lin", "u").select("series", "i", "u"))


GAPS = f"""m AS (SELECT series, i, i - row_number() OVER ({W}) AS run FROM g WHERE x IS NULL), gaps AS (SELECT series, min(i) AS start, count(*) AS length FROM m GROUP BY series, run)"""


@register("win_13_gaps", f"WITH {G}, {GAPS} SELECT series, CAST(start AS BIGINT) AS start, length FROM gaps")
def win_13_gaps(spark, sf_dir):
    return S.gaps(sensors(spark, sf_dir), "x").select("series", "start", "length")


@register("win_14_longest_gap", f"WITH {G}, {GAPS} SELECT series, max(length) AS longest, count(*) AS n_gaps FROM gaps GROUP BY series")
def win_14_longest_gap(spark, sf_dir):
    return S.gaps(sensors(spark, sf_dir), "x").groupBy("series").agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("n_gaps"))


@register("win_15_local_context", f"""WITH {G}, {GAPS}, j AS (SELECT g.*, length FROM g LEFT JOIN gaps ON gaps.series = g.series AND gaps.start = g.i)
SELECT series, i, round(avg(CASE WHEN x IS NULL THEN 1.0::DOUBLE ELSE 0 END) OVER v, 6) AS missing_ratio, round(var_samp(x) OVER v, 2) AS variance,
  round(CASE WHEN stddev_samp(x) OVER v > 0 THEN regr_slope(x, i) OVER v / stddev_samp(x) OVER v END, 4) AS trend,
  CASE WHEN x IS NULL THEN last_value(length IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS gap_size,
  least(i - 1, count(*) OVER (PARTITION BY series) - i) AS edge FROM j WINDOW v AS ({W} ROWS BETWEEN 24 PRECEDING AND 23 FOLLOWING)""")
def win_15_local_context(spark, sf_dir):
    return rounded(rounded(S.local_context(sensors(spark, sf_dir), "x").select("series", "i", F.round("missing_ratio", 6).alias("missing_ratio"), F.round("variance", 2).alias("variance"), F.round("trend", 4).alias("trend"), "gap_size", "edge")))


@register("win_17_23_runs_durbin", f"""WITH {G}, o AS (SELECT series, x, i FROM g WHERE x IS NOT NULL), md AS (SELECT series, median(x) AS md FROM o GROUP BY series),
b AS (SELECT o.series, i, x, x >= md AS b, x - lag(x) OVER (PARTITION BY o.series ORDER BY i) AS d FROM o JOIN md USING (series)),
c AS (SELECT *, lag(b) OVER ({W}) AS pb, lag(d) OVER ({W}) AS pd FROM b)
SELECT series, CAST(sum(CASE WHEN b <> pb THEN 1 ELSE 0 END) + 1 AS BIGINT) AS runs, round(sum((d - pd) * (d - pd)) / sum(d * d), 6) AS durbin_watson FROM c GROUP BY series""")
def win_17_23_runs_durbin(spark, sf_dir):
    o = sensors(spark, sf_dir).filter("x is not null")
    w = S.ordered()
    d = o.join(medians(o, ["series"], "x", "md"), "series").withColumns({"b": F.col("x") >= F.col("md"), "d": F.col("x") - F.lag("x").over(w)})
    d = d.withColumns({"pb": F.lag("b").over(w), "pd": F.lag("d").over(w)})
    return rounded(d.groupBy("series").agg((F.count_if(F.col("b") != F.col("pb")) + 1).alias("runs"), (F.sum(F.pow(F.col("d") - F.col("pd"), 2)) / F.sum(F.col("d") * F.col("d"))).alias("durbin_watson")))


@register("win_21_noise", f"""WITH {G}, o AS (SELECT series, x, x - lag(x) OVER ({W}) AS d FROM g WHERE x IS NOT NULL), m AS (SELECT series, median(d) AS md, stddev_samp(x) AS sd FROM o GROUP BY series)
SELECT o.series, round(median(abs(d - md)) * 1.4826 / any_value(sd), 6) AS noise FROM o JOIN m USING (series) GROUP BY o.series""")
def win_21_noise(spark, sf_dir):
    o = sensors(spark, sf_dir).filter("x is not null").withColumn("d", F.col("x") - F.lag("x").over(S.ordered()))
    far = o.join(medians(o, ["series"], "d", "md"), "series").withColumn("far", F.abs(F.col("d") - F.col("md")))
    sd = o.groupBy("series").agg(F.stddev_samp("x").alias("sd"))
    return rounded(medians(far, ["series"], "far", "mad").join(sd, "series").select("series", (F.col("mad") * 1.4826 / F.col("sd")).alias("noise")))


@register("win_22_stationarity", f"""WITH {G}, o AS (SELECT series, x, row_number() OVER ({W}) - 1 AS k, count(*) OVER (PARTITION BY series) AS n FROM g WHERE x IS NOT NULL),
e AS (SELECT o.*, t.s FROM o CROSS JOIN range(0, 7) t(s) WHERE k >= s * (n // 8) AND k < s * (n // 8) + n // 4), m AS (SELECT series, s, avg(x) AS m, stddev_pop(x) AS sd FROM e GROUP BY series, s)
SELECT series, count(*) AS windows, round(1 / (1 + stddev_pop(m) / (abs(avg(m)) + 1e-10) + stddev_pop(sd) / (avg(sd) + 1e-10)), 6) AS score FROM m GROUP BY series""")
def win_22_stationarity(spark, sf_dir):
    """Quarter-length windows that overlap by half; how little their means and deviations vary."""
    from pyspark.sql import Window

    o = sensors(spark, sf_dir).filter("x is not null").select("series", "x", (F.row_number().over(S.ordered()) - 1).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("series")).alias("n"))
    e = o.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(6)))).filter("k >= s * (n div 8) and k < s * (n div 8) + n div 4")
    m = e.groupBy("series", "s").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    return rounded(m.groupBy("series").agg(F.count(F.lit(1)).alias("windows"), (1 / (1 + F.stddev_pop("m") / (F.abs(F.avg("m")) + 1e-10) + F.stddev_pop("sd") / (F.avg("sd") + 1e-10))).alias("score")))


@register("win_26_sequences", f"""WITH {G}, s AS (SELECT series, i, x, count(x) OVER v AS n, sum(x) OVER v AS total, first_value(x) OVER v AS oldest FROM g WINDOW v AS ({W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT series, i, round(total, 6) AS total, round(oldest, 6) AS oldest, round(x, 6) AS target FROM s WHERE n = 6 AND x IS NOT NULL""")
def win_26_sequences(spark, sf_dir):
    s = S.sequences(sensors(spark, sf_dir), "x", 6)
    return rounded(s.select("series", "i", F.aggregate("past", F.lit(0.0), lambda a, v: a + v).alias("total"), F.get("past", F.lit(0)).alias("oldest"), "target"))


@register("win_27_decomposition", f"""WITH {G}, {PREV}, f AS (SELECT series, i, {LIN} AS y FROM n),
t AS (SELECT *, CASE WHEN count(y) OVER ({W} ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) = 25 THEN (sum(y) OVER ({W} ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) + sum(y) OVER ({W} ROWS BETWEEN 11 PRECEDING AND 12 FOLLOWING)) / 48 END AS trend FROM f),
r AS (SELECT series, (i - 1) % 24 AS slot, avg(y - trend) AS raw FROM t GROUP BY 1, 2), c AS (SELECT series, avg(raw) AS centre FROM r GROUP BY 1)
SELECT t.series, i, round(trend, 6) AS trend, round(raw - centre, 6) AS seasonal, round(y - trend - (raw - centre), 6) AS residual FROM t JOIN r ON r.series = t.series AND r.slot = (t.i - 1) % 24 JOIN c ON c.series = t.series""")
def win_27_decomposition(spark, sf_dir):
    return rounded(S.decomposed(S.linear(sensors(spark, sf_dir), "x", "y"), "y").select("series", "i", "trend", "seasonal", "residual"))


@register("win_28_pattern_bundle", f"""WITH {G}, {ACF}, p AS (SELECT series, lag, acf, lag(acf) OVER (PARTITION BY series ORDER BY lag) AS l, lead(acf) OVER (PARTITION BY series ORDER BY lag) AS r FROM acf),
pk AS (SELECT series, min(lag) AS peak FROM p WHERE acf > 0.03 AND acf > l AND acf > r GROUP BY series), s AS (SELECT series, regr_slope(x, i) AS slope FROM g GROUP BY series)
SELECT s.series, round(slope, 6) AS slope, CAST(peak AS BIGINT) AS period FROM s LEFT JOIN pk USING (series)""")
def win_28_pattern_bundle(spark, sf_dir):
    """Trend and first autocorrelation peak (SCL-20)."""
    from pyspark.sql import Window

    d = sensors(spark, sf_dir)
    w = Window.partitionBy("series").orderBy("lag")
    a = S.autocorrelation(d, "x").withColumns({"l": F.lag("acf").over(w), "r": F.lead("acf").over(w)})
    peaks = a.filter("acf > 0.03 and acf > l and acf > r").groupBy("series").agg(F.min("lag").cast("long").alias("period"))
    slope = d.groupBy("series").agg(F.regr_slope("x", "i").alias("slope"))
    return rounded(slope.join(peaks, "series", "left"))


@register("imp_07_08_cubic")
def imp_07_08_cubic(spark, sf_dir):
    """PCHIP and Akima through the observed rows (tests hold them against a numpy version)."""
    d = sensors(spark, sf_dir)
    return rounded(S.akima(S.pchip(d, "x", "pchip"), "x", "akima").select("series", "i", "pchip", "akima"))


@register("imp_11_convolution")
def imp_11_convolution(spark, sf_dir):
    return rounded(S.convolved(sensors(spark, sf_dir), "x", "smooth", 5 / 3, 5).select("series", "i", "smooth"))


@register("imp_12_kalman", f"""WITH RECURSIVE {G}, z AS (SELECT series, arg_min(x, i) FILTER (WHERE x IS NOT NULL) AS m0 FROM g GROUP BY series),
k AS (SELECT series, 0::BIGINT AS i, m0 AS m, 1.0::DOUBLE AS p FROM z UNION ALL
  SELECT k.series, g.i, CASE WHEN g.x IS NULL THEN m ELSE m + (p + 1e-5) / (p + 1e-5 + 1e-2) * (g.x - m) END,
    CASE WHEN g.x IS NULL THEN p + 1e-5 ELSE (1 - (p + 1e-5) / (p + 1e-5 + 1e-2)) * (p + 1e-5) END FROM k JOIN g ON g.series = k.series AND g.i = k.i + 1)
SELECT series, i, round(m, 6) AS filtered FROM k WHERE i > 0""")
def imp_12_kalman(spark, sf_dir):
    return rounded(statespace.smoothed(sensors(spark, sf_dir), "x", statespace.local_level(), smooth=False).select("series", "i", "filtered"))


@register("imp_12_kalman_smoother", f"""WITH RECURSIVE {G}, z AS (SELECT series, arg_min(x, i) FILTER (WHERE x IS NOT NULL) AS m0, max(i) AS n FROM g GROUP BY series),
k AS (SELECT series, 0::BIGINT AS i, m0 AS m, 1.0::DOUBLE AS p FROM z UNION ALL
  SELECT k.series, g.i, CASE WHEN g.x IS NULL THEN m ELSE m + (p + 0.5) / (p + 0.5 + 4) * (g.x - m) END,
    CASE WHEN g.x IS NULL THEN p + 0.5 ELSE (1 - (p + 0.5) / (p + 0.5 + 4)) * (p + 0.5) END FROM k JOIN g ON g.series = k.series AND g.i = k.i + 1),
b AS (SELECT k.series, k.i, m AS s, p AS v FROM k JOIN z ON z.series = k.series AND k.i = n UNION ALL
  SELECT k.series, k.i, k.m + k.p / (k.p + 0.5) * (b.s - k.m), k.p + pow(k.p / (k.p + 0.5), 2) * (b.v - k.p - 0.5) FROM b JOIN k ON k.series = b.series AND k.i = b.i - 1 WHERE k.i > 0)
SELECT series, i, round(s, 6) AS smoothed, round(v, 6) AS smoothed_var, round(s - 1.96 * sqrt(v + 4), 6) AS lo, round(s + 1.96 * sqrt(v + 4), 6) AS hi FROM b""")
def imp_12_kalman_smoother(spark, sf_dir):
    """Local level with all rows in view, with the interval of a value: forward and backward scans."""
    model = statespace.local_level(0.5, 4.0)
    return rounded(statespace.interval(statespace.smoothed(sensors(spark, sf_dir), "x", model), model).select("series", "i", "smoothed", "smoothed_var", "lo", "hi"))


@register("imp_37_structural")
def imp_37_structural(spark, sf_dir):
    """Level, trend and a daily season of two harmonics; the gaps take the smoothed value (tests hold it against a plain loop)."""
    d = sensors(spark, sf_dir).select("series", "i", "x")
    model = statespace.structural(0.5, 1e-4, 0.01, 24, 2, 4.0)
    out = statespace.interval(statespace.smoothed(d, "x", model), model).join(d, ["series", "i"])
    return rounded(out.select("series", "i", F.coalesce("x", "smoothed").alias("filled"), "smoothed", "lo", "hi"), 5)


@register("imp_22_seasonal", f"""WITH {G}, mf AS (SELECT *, coalesce(x, avg(x) OVER (PARTITION BY series)) AS y FROM g),
t AS (SELECT *, CASE WHEN count(y) OVER ({W} ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) = 25 THEN (sum(y) OVER ({W} ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) + sum(y) OVER ({W} ROWS BETWEEN 11 PRECEDING AND 12 FOLLOWING)) / 48 END AS trend FROM mf),
r AS (SELECT series, (i - 1) % 24 AS slot, avg(y - trend) AS raw FROM t GROUP BY 1, 2), c AS (SELECT series, avg(raw) AS centre FROM r GROUP BY 1),
h AS (SELECT t.series, t.i, coalesce(x, raw - centre + trend) AS x FROM t JOIN r ON r.series = t.series AND r.slot = (t.i - 1) % 24 JOIN c ON c.series = t.series),
{PREV.replace('FROM g', 'FROM h')} SELECT series, i, round({LIN}, 6) AS filled FROM n""")
def imp_22_seasonal(spark, sf_dir):
    return rounded(S.seasonal(sensors(spark, sf_dir), "x", "filled").select("series", "i", "filled"))


@register("prj_14_lag_features", f"""WITH {G} SELECT series, i, round(lag(x, 1) OVER w, 6) AS lag_1, round(lag(x, 10) OVER w, 6) AS lag_10,
  round(sin(2 * pi() * (i - 1) / count(*) OVER (PARTITION BY series)), 6) AS sin_i, round(cos(2 * pi() * (i - 1) / count(*) OVER (PARTITION BY series)), 6) AS cos_i FROM g WINDOW w AS ({W})""")
def prj_14_lag_features(spark, sf_dir):
    return rounded(S.lag_features(sensors(spark, sf_dir), "x").select("series", "i", "lag_1", "lag_10", "sin_i", "cos_i"))


@register("scl_19_seasonality", f"""WITH {G}, o AS (SELECT series, x - avg(x) OVER (PARTITION BY series) AS x, row_number() OVER ({W}) - 1 AS k, count(*) OVER (PARTITION BY series) AS n FROM g WHERE x IS NOT NULL),
f AS (SELECT series, any_value(n) * sum(x * x) AS total, pow(sum(x * cos(2 * pi() * k * round(n / 24.0) / n)), 2) + pow(sum(x * sin(2 * pi() * k * round(n / 24.0) / n)), 2) AS daily FROM o GROUP BY series)
SELECT series, round(2 * daily / total, 6) AS strength FROM f""")
def scl_19_seasonality(spark, sf_dir):
    """Share of the power at the daily frequency, by two sums instead of a transform (Parseval gives the total)."""
    from pyspark.sql import Window

    by = Window.partitionBy("series")
    o = sensors(spark, sf_dir).filter("x is not null").select("series", (F.col("x") - F.avg("x").over(by)).alias("x"), (F.row_number().over(S.ordered()) - 1).alias("k"), F.count(F.lit(1)).over(by).alias("n"))
    angle = 2 * F.pi() * F.col("k") * F.round(F.col("n") / 24.0) / F.col("n")
    f = o.groupBy("series").agg((F.first("n") * F.sum(F.col("x") * F.col("x"))).alias("total"), (F.pow(F.sum(F.col("x") * F.cos(angle)), 2) + F.pow(F.sum(F.col("x") * F.sin(angle)), 2)).alias("daily"))
    return rounded(f.select("series", (2 * F.col("daily") / F.col("total")).alias("strength")))
