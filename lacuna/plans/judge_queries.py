"""Queries of metrics, tests, intervals, ensembles and spatial operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..functions import special
from ..operators import ensemble as E
from ..operators import metrics as Q
from ..operators import series as S
from ..operators import spatial as P
from ..operators import stats as T
from ..operators import tests as H
from ..operators.ranks import percentiles
from .series_queries import LIN, PREV, W, ACF
from .tables import G, L, r6, register, rounded, sensors, table, variables

FILLED = f"WITH {G}, {PREV}, f AS (SELECT *, {LIN} AS lin, coalesce(x, avg(x) OVER (PARTITION BY series)) AS mean_fill, coalesce(pv, nv) AS ff FROM n)"


def filled(spark, sf_dir):
    d = S.linear(sensors(spark, sf_dir), "x", "lin")
    d = S.both_fills(d, "x", "ff")
    return d.withColumn("mean_fill", F.coalesce("x", F.avg("x").over(Window.partitionBy("series"))))


@register("met_01_06_points", FILLED + """SELECT series, count(*) AS n, round(avg(abs(lin - truth)), 6) AS mae, round(sqrt(avg(pow(lin - truth, 2))), 6) AS rmse, round(avg(100 * abs(lin - truth) / (abs(truth) + 1e-8)), 4) AS mape,
  round(avg(200 * abs(lin - truth) / (abs(truth) + abs(lin) + 1e-8)), 6) AS smape, round(avg(lin - truth), 6) AS bias, round(median(lin - truth), 6) AS median_bias, round(corr(truth, lin), 6) AS pearson,
  round(1 - sum(pow(lin - truth, 2)) / (var_pop(truth) * count(*)), 6) AS r2, round(1 - var_pop(lin - truth) / var_pop(truth), 6) AS explained, round(var_pop(lin) / var_pop(truth), 6) AS var_ratio FROM f WHERE x IS NULL GROUP BY series""")
def met_01_06_points(spark, sf_dir):
    m = filled(spark, sf_dir).filter("x is null").groupBy("series").agg(*(v.alias(k) for k, v in Q.point_metrics("truth", "lin").items()))
    return rounded(m.withColumn("mape", F.round("mape", 4)))


@register("met_01_spearman_ks", FILLED + """, m AS (SELECT series, truth, lin FROM f WHERE x IS NULL),
r AS (SELECT series, rank() OVER (PARTITION BY series ORDER BY truth) + (count(*) OVER (PARTITION BY series, truth) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY series ORDER BY lin) + (count(*) OVER (PARTITION BY series, lin) - 1) / 2.0 AS rp FROM m),
s AS (SELECT series, corr(ry, rp) AS spearman FROM r GROUP BY series), u AS (SELECT series, truth AS v, 1 AS a, 0 AS b FROM m UNION ALL SELECT series, lin, 0, 1 FROM m), c AS (SELECT series, v, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1, 2),
k AS (SELECT series, abs(sum(a) OVER (PARTITION BY series ORDER BY v) / sum(a) OVER (PARTITION BY series) - sum(b) OVER (PARTITION BY series ORDER BY v) / sum(b) OVER (PARTITION BY series)) AS d FROM c)
SELECT s.series, round(spearman, 6) AS spearman, round(ks, 6) AS ks FROM s JOIN (SELECT series, max(d) AS ks FROM k GROUP BY series) USING (series)""")
def met_01_spearman_ks(spark, sf_dir):
    m = filled(spark, sf_dir).filter("x is null").select("series", "truth", "lin")
    return rounded(Q.spearman(m, "series", "truth", "lin").join(Q.ks(m, "series", "truth", "lin"), "series"))


@register("met_02_mase", FILLED + f""", s AS (SELECT *, abs(truth - lag(truth) OVER ({W})) AS step FROM f) SELECT series, round(avg(abs(truth - lin)) FILTER (WHERE x IS NULL) / avg(step), 6) AS mase FROM s GROUP BY series""")
def met_02_mase(spark, sf_dir):
    return rounded(Q.mase(filled(spark, sf_dir), "series", "i", "truth", "lin", "x"))


@register("met_03_intervals", FILLED + """SELECT series, round(avg((truth BETWEEN lin - 40 AND lin + 40)::INT), 6) AS coverage, round(avg(80.0::DOUBLE), 6) AS sharpness,
  round(avg(80 + 40 * CASE WHEN truth < lin - 40 THEN lin - 40 - truth WHEN truth > lin + 40 THEN truth - lin - 40 ELSE 0 END), 6) AS interval_score FROM f WHERE x IS NULL GROUP BY series""")
def met_03_intervals(spark, sf_dir):
    m = filled(spark, sf_dir).filter("x is null").withColumns({"lo": F.col("lin") - 40, "hi": F.col("lin") + 40})
    return rounded(m.groupBy("series").agg(*(v.alias(k) for k, v in Q.interval_metrics("truth", "lo", "hi").items())))


@register("met_04_acf_error", FILLED + """, o AS (SELECT series, truth AS a, lin AS b, i FROM f), c AS (SELECT p.series, lag, corr(p.a, q.a) AS ra, corr(p.b, q.b) AS rb FROM o p CROSS JOIN range(1, 25) t(lag) JOIN o q ON q.series = p.series AND q.i = p.i - lag GROUP BY 1, 2)
SELECT series, round(avg(abs(ra - rb)), 6) AS acf_mae FROM c GROUP BY series""")
def met_04_acf_error(spark, sf_dir):
    d = filled(spark, sf_dir).select("series", "i", "truth", "lin")
    a, b = S.autocorrelation(d, "truth"), S.autocorrelation(d, "lin").withColumnRenamed("acf", "acf_b")
    return rounded(a.join(b, ["series", "lag"]).groupBy("series").agg(F.avg(F.abs(F.col("acf") - F.col("acf_b"))).alias("acf_mae")))


@register("met_07_10_preservation", FILLED + """, m AS (SELECT series, avg(x) AS m0, avg(lin) AS m1, stddev_pop(x) AS s0, stddev_pop(lin) AS s1, count(*) FILTER (WHERE x IS NULL AND lin IS NOT NULL) / count(*) FILTER (WHERE x IS NULL) AS filled_share,
  count(*) FILTER (WHERE x IS NULL AND (lin < 0 OR lin IS NULL)) AS implausible FROM f GROUP BY series)
SELECT series, round(abs(m1 - m0) / (abs(m0) + 1e-10), 6) AS mean_change, round(abs(s1 - s0) / (abs(s0) + 1e-10), 6) AS sd_change, round(filled_share, 6) AS filled_share, implausible FROM m""")
def met_07_10_preservation(spark, sf_dir):
    return rounded(Q.preservation(filled(spark, sf_dir), "series", "x", "lin").drop("skew_change", "kurt_change"))


@register("met_12_bootstrap")
def met_12_bootstrap(spark, sf_dir):
    d = filled(spark, sf_dir).select("series", "i", F.when(F.col("x").isNull(), F.abs(F.col("lin") - F.col("truth"))).alias("e"))
    return rounded(Q.bootstrap(d, "series", "e"))


@register("met_15_folds", f"""WITH {G}, k AS (SELECT *, CAST(floor((i - 1) * 6 / count(*) OVER (PARTITION BY series)) AS BIGINT) AS fold FROM g), m AS (SELECT series, fold, avg(x) AS m, count(x) AS n FROM k GROUP BY 1, 2),
t AS (SELECT a.series, a.fold, sum(b.m * b.n) / sum(b.n) AS mean FROM m a JOIN m b ON b.series = a.series AND b.fold < a.fold GROUP BY 1, 2)
SELECT k.series, k.fold, count(*) AS n, round(sqrt(avg(pow(truth - mean, 2))), 6) AS rmse FROM k JOIN t USING (series, fold) WHERE x IS NULL GROUP BY 1, 2""")
def met_15_folds(spark, sf_dir):
    """Expanding time folds: the mean of all earlier folds judged on the gaps of each."""
    k = Q.folds(sensors(spark, sf_dir), "series", "i", 5)
    m = k.groupBy("series", "fold").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    w = Window.partitionBy("series").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    t = m.select("series", "fold", (F.sum("s").over(w) / F.sum("n").over(w)).alias("mean")).filter("mean is not null")
    return rounded(k.filter("x is null").join(t, ["series", "fold"]).groupBy("series", "fold").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.pow(F.col("truth") - F.col("mean"), F.lit(2)))).alias("rmse")))


LONG3 = FILLED + ", u AS (SELECT series, i, truth, x, 'linear' AS method, lin AS value FROM f UNION ALL SELECT series, i, truth, x, 'mean', mean_fill FROM f UNION ALL SELECT series, i, truth, x, 'ffill', ff FROM f)"


def methods(spark, sf_dir):
    d = filled(spark, sf_dir).select("series", "i", "truth", "x", F.col("lin").alias("linear"), F.col("mean_fill").alias("mean"), F.col("ff").alias("ffill"))
    return d, d.unpivot(["series", "i", "truth", "x"], ["linear", "mean", "ffill"], "method", "value")


@register("met_17_method_comparison", LONG3 + """, m AS (SELECT series, method, sqrt(avg(pow(value - truth, 2))) AS rmse FROM u WHERE x IS NULL GROUP BY 1, 2)
SELECT series, method, round(rmse, 6) AS rmse, rank() OVER (PARTITION BY series ORDER BY rmse) + (count(*) OVER (PARTITION BY series, rmse) - 1) / 2.0::DOUBLE AS rank, round(0.6 * (1 - rmse / 100) + 0.3 + 0.1, 6) AS score FROM m""")
def met_17_method_comparison(spark, sf_dir):
    _, u = methods(spark, sf_dir)
    m = u.filter("x is null").groupBy("series", "method").agg(F.sqrt(F.avg(F.pow(F.col("value") - F.col("truth"), F.lit(2)))).alias("rmse"))
    return rounded(T.ranked(m, ["series"], "rmse", False).withColumn("score", 0.6 * (1 - F.col("rmse") / 100) + 0.4))


@register("win_18_tst_18_friedman", LONG3 + """, e AS (SELECT series || i AS sample, method, abs(value - truth) AS err FROM u WHERE x IS NULL), r AS (SELECT method, rank() OVER (PARTITION BY sample ORDER BY err) + (count(*) OVER (PARTITION BY sample, err) - 1) / 2.0 AS r FROM e),
s AS (SELECT method, sum(r) AS r, count(*) AS n FROM r GROUP BY method), k AS (SELECT 12.0 / (any_value(n) * count(*) * (count(*) + 1)) * sum(r * r) - 3 * any_value(n) * (count(*) + 1) AS chi, any_value(n) AS samples, count(*) AS methods FROM s)
SELECT round(chi, 4) AS chi2, round(chi / (samples * (methods - 1)), 6) AS w, samples, methods FROM k""")
def win_18_tst_18_friedman(spark, sf_dir):
    _, u = methods(spark, sf_dir)
    e = u.filter("x is null").select(F.concat("series", "i").alias("sample"), "method", F.abs(F.col("value") - F.col("truth")).alias("err"))
    return rounded(H.friedman(e, "sample", "method", "err").withColumn("chi2", F.round("chi2", 4)))


@register("tst_08_jarque_bera", f"""WITH {G}, c AS (SELECT series, x - avg(x) OVER (PARTITION BY series) AS d FROM g WHERE x IS NOT NULL), m AS (SELECT series, count(*) AS n, avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM c GROUP BY series),
j AS (SELECT series, n, n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) AS jb FROM m) SELECT series, n, round(jb, 4) AS jb, round(exp(-jb / 2), 6) AS p FROM j""")
def tst_08_jarque_bera(spark, sf_dir):
    return rounded(H.jarque_bera(sensors(spark, sf_dir), "series", "x").withColumn("jb", F.round("jb", 4)))


@register("tst_09_15_ljung_box", f"WITH {G}, {ACF}, n AS (SELECT series, count(x) AS n FROM g GROUP BY series) SELECT series, round(any_value(n) * (any_value(n) + 2) * sum(acf * acf / (n - lag)), 4) AS q FROM acf JOIN n USING (series) WHERE lag <= 10 GROUP BY series")
def tst_09_15_ljung_box(spark, sf_dir):
    return rounded(H.ljung_box(sensors(spark, sf_dir), "x", 10), 4)


@register("tst_09_runs", f"""WITH {G}, o AS (SELECT series, x, i, median(x) OVER (PARTITION BY series) AS md FROM g WHERE x IS NOT NULL), b AS (SELECT series, x >= md AS b, lag(x >= md) OVER ({W}) AS pb FROM o),
a AS (SELECT series, count(*) FILTER (WHERE b <> pb) + 1 AS runs, (count(*) FILTER (WHERE b))::DOUBLE AS n1, (count(*) FILTER (WHERE NOT b))::DOUBLE AS n2 FROM b GROUP BY series)
SELECT series, runs, round((runs - (2 * n1 * n2 / (n1 + n2) + 1)) / sqrt(2 * n1 * n2 * (2 * n1 * n2 - n1 - n2) / (pow(n1 + n2, 2) * (n1 + n2 - 1))), 6) AS z FROM a""")
def tst_09_runs(spark, sf_dir):
    return rounded(H.runs_z(sensors(spark, sf_dir), "x"))


@register("tst_10_kpss", f"""WITH {G}, e AS (SELECT series, i, x - avg(x) OVER (PARTITION BY series) AS e FROM g WHERE x IS NOT NULL), s AS (SELECT series, e, sum(e) OVER ({W}) AS s, lag(e, 1) OVER ({W}) AS l1, lag(e, 2) OVER ({W}) AS l2, lag(e, 3) OVER ({W}) AS l3 FROM e)
SELECT series, round(sum(s * s) / pow(count(*), 2) / (sum(e * e) / count(*) + 2 * (0.75 * sum(e * l1) + 0.5 * sum(e * l2) + 0.25 * sum(e * l3)) / count(*)), 6) AS kpss FROM s GROUP BY series""")
def tst_10_kpss(spark, sf_dir):
    return rounded(H.kpss(sensors(spark, sf_dir), "x", 3))


@register("tst_10_adf")
def tst_10_adf(spark, sf_dir):
    return rounded(H.adf(sensors(spark, sf_dir), "x"), 4)


@register("tst_11_variance", f"""WITH {G}, t AS (SELECT *, ntile(3) OVER ({W}) AS k FROM g WHERE x IS NOT NULL), m AS (SELECT series, avg(x) AS m FROM t GROUP BY series)
SELECT t.series, round(var_samp(x) FILTER (WHERE k = 3) / var_samp(x) FILTER (WHERE k = 1), 6) AS gq, round(count(x) * regr_r2(pow(x - m, 2), i), 4) AS lm FROM t JOIN m USING (series) GROUP BY t.series""")
def tst_11_variance(spark, sf_dir):
    d = sensors(spark, sf_dir).filter("x is not null")
    d = d.join(d.groupBy("series").agg(F.avg("x").alias("m")), "series").withColumn("e", F.col("x") - F.col("m"))
    return H.goldfeld_quandt(d, "series", "i", "x").join(H.breusch_pagan(d, "series", "i", "e"), "series").select("series", F.round("gq", 6).alias("gq"), F.round("lm", 4).alias("lm"))


@register("tst_12_rubin", """WITH e AS (SELECT l_returnflag AS parameter, l_linenumber AS m, avg(l_quantity) AS q, var_samp(l_quantity) / count(*) AS v FROM lineitem GROUP BY 1, 2),
a AS (SELECT parameter, count(*) AS m, avg(q) AS pooled, avg(v) AS within, var_samp(q) AS between FROM e GROUP BY 1), t AS (SELECT *, within + (1 + 1.0 / m) * between AS total FROM a)
SELECT parameter, m, round(pooled, 6) AS pooled, round(within, 6) AS within, round(between, 6) AS between, round(total, 6) AS total, round((1 + 1.0 / m) * between / total, 6) AS fmi, round((m - 1) / pow((1 + 1.0 / m) * between / total, 2), 4) AS dof FROM t""")
def tst_12_rubin(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("parameter"), "l_linenumber").agg(F.avg("l_quantity").alias("q"), (F.var_samp("l_quantity") / F.count(F.lit(1))).alias("v"))
    return rounded(H.rubin(e, "parameter", "q", "v").withColumn("dof", F.round("dof", 4)))


@register("tst_14_diebold_mariano", FILLED + f""", d AS (SELECT series, i, pow(lin - truth, 2) - pow(mean_fill - truth, 2) AS d FROM f WHERE x IS NULL), m AS (SELECT series, avg(d) AS m, count(*) AS n FROM d GROUP BY series),
l AS (SELECT series, i, d, lag(d) OVER ({W}) AS l1 FROM d), v AS (SELECT series, (sum(pow(d - m, 2)) + 2 * sum((d - m) * (l1 - m))) / any_value(n) AS v, any_value(m) AS m, any_value(n) AS n FROM l JOIN m USING (series) GROUP BY series)
SELECT series, round(m / sqrt(v / n) * sqrt((n + 1 - 4 + 2.0 / n) / n), 6) AS dm, n FROM v""")
def tst_14_diebold_mariano(spark, sf_dir):
    d = filled(spark, sf_dir).filter("x is null").select("series", "i", (F.col("lin") - F.col("truth")).alias("e1"), (F.col("mean_fill") - F.col("truth")).alias("e2"))
    return rounded(H.diebold_mariano(d, "series", "i", "e1", "e2", 2))


@register("tst_19_21_paired", FILLED + """, d AS (SELECT series, abs(lin - truth) - abs(mean_fill - truth) AS d FROM f WHERE x IS NULL), e AS (SELECT series, round(d, 9) AS d FROM d), r AS (SELECT series, d, rank() OVER (PARTITION BY series ORDER BY abs(d)) + (count(*) OVER (PARTITION BY series, abs(d)) - 1) / 2.0 AS r FROM e WHERE d <> 0),
w AS (SELECT series, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS minus FROM r GROUP BY series)
SELECT series, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, count(*) AS n, round(avg(d) / stddev_samp(d), 6) AS cohen_d, CAST(any_value(plus) AS DOUBLE) AS plus, CAST(any_value(minus) AS DOUBLE) AS minus,
  CASE WHEN abs(avg(d) / stddev_samp(d)) < 0.2 THEN 'negligible' WHEN abs(avg(d) / stddev_samp(d)) < 0.5 THEN 'small' WHEN abs(avg(d) / stddev_samp(d)) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM d JOIN w USING (series) GROUP BY series""")
def tst_19_21_paired(spark, sf_dir):
    d = filled(spark, sf_dir).filter("x is null").select("series", F.abs(F.col("lin") - F.col("truth")).alias("a"), F.abs(F.col("mean_fill") - F.col("truth")).alias("b"))
    t = H.paired_t(d, "series", "a", "b").join(H.wilcoxon(d, "series", "a", "b").drop("n"), "series")
    return rounded(t.withColumn("effect", X.effect_size("d", F.col("cohen_d"))))


@register("tst_19_anova", f"""WITH {G}, s AS (SELECT series, count(x) AS n, avg(x) AS m, var_pop(x) * count(x) AS w FROM g GROUP BY series), t AS (SELECT avg(x) AS gm FROM g), a AS (SELECT sum(n * pow(m - gm, 2)) AS b, sum(w) AS w, count(*) - 1 AS df1, CAST(sum(n) AS BIGINT) - count(*) AS df2 FROM s, t)
SELECT round(b / df1 / (w / df2), 6) AS f, round(b / (b + w), 6) AS eta2, df1, df2 FROM a""")
def tst_19_anova(spark, sf_dir):
    return rounded(H.anova(sensors(spark, sf_dir), "series", "x"))


@register("tst_20_corrections", """WITH p AS (SELECT o_orderpriority AS name, avg(o_totalprice) / 200000.0 - 0.5 AS p FROM orders GROUP BY 1), q AS (SELECT name, abs(p) / 2 AS p FROM p), k AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, name) AS k FROM q)
SELECT name, round(p, 6) AS p, round(least(1, m * p), 6) AS bonferroni, round(least(1, max((m - k + 1) * p) OVER (ORDER BY p, name)), 6) AS holm, round(least(1, min(m * p / k) OVER (ORDER BY p, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh FROM k""")
def tst_20_corrections(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg((F.abs(F.avg("o_totalprice") / 200000.0 - 0.5) / 2).alias("p"))
    return rounded(H.corrected(p, "p", ["name"]))


@register("tst_23_trend", f"""WITH {G} SELECT series, round(regr_slope(x, i), 8) AS slope, round(regr_intercept(x, i), 4) AS intercept, round(regr_r2(x, i), 6) AS r2, CASE WHEN abs(regr_slope(x, i)) * count(x) > stddev_pop(x) THEN 'linear' ELSE 'none' END AS kind FROM g GROUP BY series""")
def tst_23_trend(spark, sf_dir):
    s = F.regr_slope("x", "i")
    return sensors(spark, sf_dir).groupBy("series").agg(F.round(s, 8).alias("slope"), F.round(F.regr_intercept("x", "i"), 4).alias("intercept"), F.round(F.regr_r2("x", "i"), 6).alias("r2"), F.when(F.abs(s) * F.count("x") > F.stddev_pop("x"), "linear").otherwise("none").alias("kind"))


@register("tst_27_outlier_ratio", f"""WITH {G}, q AS (SELECT series, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM g GROUP BY series) SELECT g.series, round(avg((x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))::INT), 6) AS ratio FROM g JOIN q USING (series) WHERE x IS NOT NULL GROUP BY g.series""")
def tst_27_outlier_ratio(spark, sf_dir):
    d = sensors(spark, sf_dir).filter("x is not null")
    q = percentiles(d, ["series"], "x", [0.25, 0.75]).select("series", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    far = 1.5 * (F.col("q3") - F.col("q1"))
    return rounded(d.join(q, "series").groupBy("series").agg(F.avg(((F.col("x") < F.col("q1") - far) | (F.col("x") > F.col("q3") + far)).cast("int")).alias("ratio")))


@register("tst_01_16_multivariate")
def tst_01_16_multivariate(spark, sf_dir):
    """Little's test and Mardia's kurtosis of three variables."""
    d = variables(spark, sf_dir, False)
    chi2, dof, p = H.little_mcar(d, ["a", "b", "c"])
    return H.mardia(d, ["a", "b", "c"]).select("n", F.round("kurtosis", 4).alias("kurtosis"), F.round("z", 4).alias("z"), F.lit(round(chi2, 4)).alias("chi2"), F.lit(dof).alias("dof"), F.lit(round(p, 6)).alias("p"))


@register("cnf_01_02_split", FILLED + """, s AS (SELECT series, abs(lin - truth) AS s, event_id % 2 AS half, truth, lin FROM f WHERE x IS NULL), k AS (SELECT series, s, row_number() OVER (PARTITION BY series ORDER BY s) AS k, count(*) OVER (PARTITION BY series) AS n FROM s WHERE half = 0),
q AS (SELECT series, s AS q FROM k WHERE k = least(n, ceil((n + 1) * 0.9))) SELECT s.series, round(any_value(q), 6) AS q, round(avg((s.s <= q)::INT), 6) AS coverage, round(2 * any_value(q), 6) AS width FROM s JOIN q USING (series) WHERE half = 1 GROUP BY s.series""")
def cnf_01_02_split(spark, sf_dir):
    """Split conformal intervals around linear fills: even ids calibrate, odd ids are judged."""
    s = filled(spark, sf_dir).filter("x is null").select("series", F.abs(F.col("lin") - F.col("truth")).alias("s"), (F.col("event_id") % 2).alias("half"))
    q = H.conformal_quantile(s.filter("half = 0"), "series", "s", 0.1)
    return rounded(s.filter("half = 1").join(q, "series").groupBy("series").agg(F.first("q").alias("q"), F.avg((F.col("s") <= F.col("q")).cast("int")).alias("coverage"), (2 * F.first("q")).alias("width")))


@register("cnf_05_adaptive", FILLED + f""", c AS (SELECT series, row_number() OVER ({W}) AS k, abs(lin - truth) < 60 AS hit FROM f WHERE x IS NULL), l AS (SELECT series, list(hit ORDER BY k) AS h FROM c GROUP BY series)
SELECT series, round(list_reduce(list_prepend(0.1::DOUBLE, list_transform(h, lambda v: CASE WHEN v THEN 0.0::DOUBLE ELSE 1.0 END)), lambda a, v: least(0.999, greatest(0.001, a + 0.01 * (0.1 - v)))), 6) AS alpha FROM l""")
def cnf_05_adaptive(spark, sf_dir):
    c = filled(spark, sf_dir).filter("x is null").select("series", "i", (F.abs(F.col("lin") - F.col("truth")) < 60).alias("hit"))
    return rounded(H.adaptive_alpha(c, "hit"))


@register("imp_25_26_ensemble", LONG3 + """, k AS (SELECT *, row_number() OVER (PARTITION BY series, i ORDER BY value, method) AS r, count(*) OVER (PARTITION BY series, i) AS m FROM u WHERE x IS NULL)
SELECT series, i, round(sum(value * CASE method WHEN 'linear' THEN 0.5 WHEN 'mean' THEN 0.3 ELSE 0.2 END) / sum(CASE method WHEN 'linear' THEN 0.5 WHEN 'mean' THEN 0.3 ELSE 0.2 END), 6) AS weighted, round(median(value), 6) AS median,
  round(avg(value) FILTER (WHERE r > 1 AND r <= m - 1), 6) AS trimmed, round(stddev_pop(value), 6) AS spread, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi, round(1 - stddev_pop(value) / (abs(avg(value)) + 1e-10), 6) AS agreement FROM k GROUP BY 1, 2""")
def imp_25_26_ensemble(spark, sf_dir):
    _, u = methods(spark, sf_dir)
    return rounded(E.combined(u.filter("x is null"), {"linear": 0.5, "mean": 0.3, "ffill": 0.2}, 0.34))


@register("imp_28_33_weights", FILLED + """, v AS (SELECT count(*) AS n, var_pop(truth - lin) AS a, var_pop(truth - mean_fill) AS b, var_pop(truth - ff) AS c FROM f WHERE x IS NULL), b AS (SELECT 'linear' AS method, n * ln(a) + 10 * ln(n) AS bic FROM v UNION ALL SELECT 'mean', n * ln(b) + 10 * ln(n) FROM v UNION ALL SELECT 'ffill', n * ln(c) + 10 * ln(n) FROM v)
SELECT method, round(bic, 4) AS bic, round(exp(-(bic - min(bic) OVER ()) / 2) / sum(exp(-(bic - m) / 2)) OVER (), 6) AS weight FROM b, (SELECT min(bic) AS m FROM b)""")
def imp_28_33_weights(spark, sf_dir):
    d, _ = methods(spark, sf_dir)
    return E.bic_weights(d.filter("x is null"), "truth", ["linear", "mean", "ffill"]).select("method", F.round("bic", 4).alias("bic"), F.round("weight", 6).alias("weight"))


@register("imp_29_exponential", LONG3 + """, p AS (SELECT series, i, method, coalesce(sum(abs(value - truth)) OVER (PARTITION BY series, method ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM u WHERE x IS NULL)
SELECT series, i, method, round(exp(-0.01 * (past - min(past) OVER k)) / sum(exp(-0.01 * (past - m))) OVER k, 6) AS weight FROM (SELECT *, min(past) OVER (PARTITION BY series, i) AS m FROM p) WINDOW k AS (PARTITION BY series, i)""")
def imp_29_exponential(spark, sf_dir):
    _, u = methods(spark, sf_dir)
    return rounded(E.exponential_weights(u.filter("x is null").withColumn("loss", F.abs(F.col("value") - F.col("truth")))))


@register("imp_33_decomposition", FILLED + """, e AS (SELECT truth, lin AS a, mean_fill AS b, ff AS c, (lin + mean_fill + ff) / 3 AS m FROM f WHERE x IS NULL)
SELECT round(pow(avg(m - truth), 2), 6) AS bias2, round((var_pop(a) + var_pop(b) + var_pop(c)) / 3, 4) AS variance, round((covar_pop(a, b) + covar_pop(a, c) + covar_pop(b, c)) / 3, 4) AS covariance,
  round(avg((pow(a - m, 2) + pow(b - m, 2) + pow(c - m, 2)) / 3), 4) AS diversity, round(avg(pow(m - truth, 2)), 4) AS mse FROM e""")
def imp_33_decomposition(spark, sf_dir):
    d, _ = methods(spark, sf_dir)
    o = E.decomposition(d.filter("x is null"), "truth", ["linear", "mean", "ffill"])
    return o.select(F.round("bias2", 6).alias("bias2"), *(F.round(c, 4).alias(c) for c in ("variance", "covariance", "diversity", "mse")))


@register("imp_27_super_learner")
def imp_27_super_learner(spark, sf_dir):
    d, _ = methods(spark, sf_dir)
    w = E.super_learner(d.filter("x is null"), "truth", ["linear", "mean", "ffill"])
    return rounded(spark.createDataFrame(sorted(w.items()), "method string, weight double"), 4)


@register("imp_15_low_rank")
def imp_15_low_rank(spark, sf_dir):
    return rounded(E.low_rank(variables(spark, sf_dir), "r", ["a", "b", "c"]), 4)


@register("imp_38_gaussian")
def imp_38_gaussian(spark, sf_dir):
    return rounded(E.gaussian_conditional(variables(spark, sf_dir), "r", ["a", "b", "c"]), 4)


ST = "s AS (SELECT s_suppkey AS k, (s_suppkey * 7 % 17)::DOUBLE AS x, (s_suppkey * 5 % 23)::DOUBLE AS y, s_acctbal AS v, (s_suppkey * 7 % 80)::DOUBLE - 40 AS lat, (s_suppkey * 11 % 160)::DOUBLE - 80 AS lon FROM supplier)"


def stations(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("k"), (k * 7 % 17).cast("double").alias("x"), (k * 5 % 23).cast("double").alias("y"), F.col("s_acctbal").alias("v"), ((k * 7 % 80).cast("double") - 40).alias("lat"), ((k * 11 % 160).cast("double") - 80).alias("lon"))


@register("joi_05_06_distances", f"""WITH {ST} SELECT a.k AS i, b.k AS j, round(2 * 6371.0 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0))), 6) AS km FROM s a JOIN s b ON a.k < b.k""")
def joi_05_06_distances(spark, sf_dir):
    return P.distances(stations(spark, sf_dir), "k", digits=6)


@register("joi_07_knn_graph", f"""WITH {ST}, d AS (SELECT a.k AS q, b.k AS donor, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM s a JOIN s b ON a.k <> b.k) SELECT q, donor, round(1 / (d + 1e-6), 4) AS weight FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, donor) <= 3""")
def joi_07_knn_graph(spark, sf_dir):
    s = stations(spark, sf_dir)
    n = P.nearest_on_grid(s.withColumnRenamed("k", "q"), s.withColumnRenamed("k", "donor"), 3, strict=True)
    return n.select("q", "donor", F.round(1 / (F.col("d") + 1e-6), 4).alias("weight"))


@register("joi_08_within", f"WITH {ST} SELECT a.k AS i, b.k AS j, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS d FROM s a JOIN s b ON a.k < b.k WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 3 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) > 0")
def joi_08_within(spark, sf_dir):
    return P.within(stations(spark, sf_dir), "k", 3.0, digits=6)


@register("joi_09_delaunay")
def joi_09_delaunay(spark, sf_dir):
    return P.delaunay(stations(spark, sf_dir), "k")


@register("joi_11_12_donors", """WITH p AS (SELECT p_partkey AS k, p_size::DOUBLE AS a, p_retailprice / 100 AS b FROM part), q AS (SELECT * FROM p WHERE k % 20 = 0), d AS (SELECT k AS donor, a AS da, b AS db FROM p),
j AS (SELECT k AS q, donor, sqrt(pow(a - da, 2) + pow(b - db, 2)) AS d FROM q, d) SELECT q, donor, round(d, 6) AS d, row_number() OVER (PARTITION BY q ORDER BY d, donor) AS rank FROM j QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, donor) <= 3""")
def joi_11_12_donors(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 100).alias("b"))
    return rounded(P.nearest_on_grid(p.filter("k % 20 = 0").withColumnRenamed("k", "q"), p.withColumnRenamed("k", "donor"), 3, "a", "b"))


for _name, _gamma in (("matheron", "avg(m * m) / 2"), ("cressie", "pow(avg(sqrt(m)), 4) / (0.457 + 0.494 / count(*)) / 2"), ("genton", "pow(2.2191 * quantile_cont(m, 0.25), 2) / 2")):
    def _query(spark, sf_dir, name=_name):
        v = P.semivariogram(stations(spark, sf_dir), "k", 12, estimator=name)
        return v.select("bin", "n", F.round("distance", 6).alias("distance"), F.round("gamma", 2).alias("gamma"))

    register(f"krg_01_{_name}", f"""WITH {ST}, p AS (SELECT sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, abs(a.v - b.v) AS m FROM s a JOIN s b ON a.k < b.k), t AS (SELECT max(d) AS top FROM p)
SELECT CAST(least(floor(d / top * 12), 11) AS BIGINT) AS bin, count(*) AS n, round(avg(d), 6) AS distance, round({_gamma}, 2) AS gamma FROM p, t GROUP BY 1""")(_query)


@register("agg_04_moran", f"""WITH {ST}, o AS (SELECT avg(v) AS m, var_pop(v) AS s2, count(*) AS n FROM s), e AS (SELECT a.v AS vi, b.v AS vj, 1 / sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS w FROM s a JOIN s b ON a.k < b.k WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 16 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) > 0)
SELECT round(sum(w * (vi - m) * (vj - m)) / sum(w) / any_value(s2), 6) AS moran, round((any_value(n) - 1) * sum(w * pow(vi - vj, 2)) / (2 * sum(w) * any_value(n) * any_value(s2)), 6) AS geary, count(*) AS edges FROM e, o""")
def agg_04_moran(spark, sf_dir):
    return rounded(P.moran(stations(spark, sf_dir), "k", 4.0))


def variogram_model(s):
    """An exponential model fitted to the stations' twelve bins."""
    v = [(r["distance"], r["gamma"], r["n"] ** 0.5) for r in P.semivariogram(s, "k", 12).orderBy("bin").collect()]
    return "exponential", *P.fitted_variogram(v, "exponential")


@register("krg_02_03_kriging")
def krg_02_03_kriging(spark, sf_dir):
    """Variogram fit, and ordinary kriging of every place from the sixteen nearest others."""
    s = stations(spark, sf_dir)
    at = P.places(s, "k")
    return rounded(P.kriged_near(at, at.withColumnRenamed("k", "target"), variogram_model(s), strict=True), 3)


@register("krg_05_cross_validation")
def krg_05_cross_validation(spark, sf_dir):
    s = stations(spark, sf_dir)
    return rounded(P.cross_validated(P.places(s, "k"), variogram_model(s)), 4)


@register("krg_03_nearest_place", f"""WITH {ST}, p AS (SELECT min(k) AS k, x, y, avg(v) AS v, count(*) AS n FROM s GROUP BY x, y), j AS (SELECT a.k AS target, b.v, 2 * (1 + 9 * (1 - exp(-3 * sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 5))) - 1 + 1.0 / b.n AS variance,
row_number() OVER (PARTITION BY a.k ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.k) AS r FROM p a JOIN p b ON a.k <> b.k) SELECT target, round(v, 3) AS estimate, round(variance, 3) AS variance FROM j WHERE r = 1""")
def krg_03_nearest_place(spark, sf_dir):
    """Ordinary kriging from one neighbour, whose solution is known: its value, and twice the semivariance less what its mean saves of the nugget."""
    at = P.places(stations(spark, sf_dir), "k")
    return rounded(P.kriged_near(at, at.withColumnRenamed("k", "target"), ("exponential", 1.0, 10.0, 5.0), 1, strict=True), 3)


@register("krg_09_trans_gaussian", f"""WITH {ST}, l AS (SELECT min(v) AS least FROM s), p AS (SELECT min(k) AS k, x, y, avg(ln(v - least + 1)) AS v, count(*) AS n FROM s, l GROUP BY x, y), j AS (SELECT a.k AS target, b.v, 2 * (0.01 + 0.09 * (1 - exp(-3 * sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 5))) - 0.01 + 0.01 / b.n AS variance,
row_number() OVER (PARTITION BY a.k ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.k) AS r FROM p a JOIN p b ON a.k <> b.k) SELECT target, round(exp(v + variance / 2) + least - 1, 3) AS estimate FROM j, l WHERE r = 1""")
def krg_09_trans_gaussian(spark, sf_dir):
    """From one neighbour, whose solution SQL knows (tests use more)."""
    return rounded(P.trans_gaussian(stations(spark, sf_dir), "k", ("exponential", 0.01, 0.1, 5.0), 1), 3)


_SPHERE = "CASE WHEN h > 0 THEN 1 + 9 * CASE WHEN h <= 5 THEN 1.5 * h / 5 - 0.5 * pow(h / 5, 3) ELSE 1 END ELSE 0 END"


@register("krg_13_block_variogram", f"""WITH {ST}, p AS (SELECT min(k) AS k, x, y FROM s GROUP BY x, y), c AS (SELECT a + 1.0 AS cx, b + 1.0 AS cy FROM (VALUES (0), (2), (4), (6)) u(a), (VALUES (0), (2), (4), (6)) v(b)),
h AS (SELECT k, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS h FROM p, c), w AS (SELECT avg({_SPHERE}) AS within FROM (SELECT sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) AS h FROM c a, c b)) SELECT k, round(avg({_SPHERE}), 6) AS gamma, round(any_value(within), 6) AS within FROM h, w GROUP BY k""")
def krg_13_block_variogram(spark, sf_dir):
    return rounded(P.block_variogram(P.places(stations(spark, sf_dir), "k"), (0.0, 0.0), 8.0, ("spherical", 1.0, 10.0, 5.0)))


@register("scl_11_17_scalars", """SELECT c_custkey, CASE WHEN abs(c_acctbal / 10000) < 0.2 THEN 'negligible' WHEN abs(c_acctbal / 10000) < 0.5 THEN 'small' WHEN abs(c_acctbal / 10000) < 0.8 THEN 'medium' ELSE 'large' END AS effect,
  CASE WHEN c_custkey * 1000 < 1024 THEN (c_custkey * 1000) || ' B' WHEN c_custkey * 1000 < 1048576 THEN printf('%.2f', round(c_custkey * 1000 / 1024.0, 2)) || ' KB' ELSE printf('%.2f', round(c_custkey * 1000 / 1048576.0, 2)) || ' MB' END AS bytes,
  substr(regexp_replace(c_name, '[^A-Za-z0-9_-]', '_', 'g'), 1, 100) AS safe, sha256(coalesce(c_custkey::VARCHAR, '') || '|' || coalesce(c_name, '')) AS hash,
  round(CASE WHEN abs(c_acctbal) / 1000 > 0 THEN 1 + 9 * CASE WHEN abs(c_acctbal) / 1000 <= 5 THEN 1.5 * abs(c_acctbal) / 5000 - 0.5 * pow(abs(c_acctbal) / 5000, 3) ELSE 1 END ELSE 0 END, 6) AS gamma FROM customer""")
def scl_11_17_scalars(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return rounded(c.select("c_custkey", X.effect_size("d", F.col("c_acctbal") / 10000).alias("effect"), X.human_bytes(F.col("c_custkey") * 1000).alias("bytes"), X.safe_name(F.col("c_name")).alias("safe"), X.content_hash("c_custkey", "c_name").alias("hash"), X.variogram("spherical", F.abs("c_acctbal") / 1000, 1.0, 10.0, 5.0).alias("gamma")))


@register("scl_15_kernels", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_sum(list_transform(list_zip(a.v, b.v), lambda t: pow(t[1] - t[2], 2))) AS d, list_sum(list_transform(list_zip(a.v, b.v), lambda t: t[1] * t[2])) AS ab FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT i, j, round(exp(-0.5 * d), 6) AS rbf, round(pow(0.1 * ab + 1, 3), 6) AS poly, round((1 + sqrt(3) * sqrt(d)) * exp(-sqrt(3) * sqrt(d)), 6) AS matern FROM p""")
def scl_15_kernels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    p = e.select(F.col("vec_id").alias("i"), F.col("v").alias("v_i")).join(e.select((F.col("vec_id") - 1).alias("i"), F.col("vec_id").alias("j"), F.col("v").alias("v_j")), "i")
    return rounded(p.select("i", "j", X.kernel("rbf", F.col("v_i"), F.col("v_j"), 0.5).alias("rbf"), X.kernel("polynomial", F.col("v_i"), F.col("v_j"), 0.1).alias("poly"), X.kernel("matern:1.5", F.col("v_i"), F.col("v_j")).alias("matern")))


_ = (L, r6, special)
