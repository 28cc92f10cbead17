"""Queries of statistics, projections, missing-data structure and validation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import missing as M
from ..operators import stats as T
from ..operators import validate as V
from ..operators.ranks import percentiles
from .tables import G, L, r6, register, rounded, sensors, table, variables

ABC = ["a", "b", "c"]
LONG = f"WITH {L}, v AS (UNPIVOT (SELECT a, b, c FROM l) ON a, b, c INTO NAME variable VALUE value), n AS (SELECT count(*) AS rows FROM l)"


@register("agg_01_09_basic", LONG + """SELECT variable, count(*) AS n, any_value(rows) - count(*) AS missing, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd_pop, round(stddev_samp(value), 6) AS sd,
  round(var_samp(value), 4) AS var, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3,
  round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round((any_value(rows) - count(*)) / any_value(rows), 6) AS missing_ratio,
  round(skewness(value), 4) AS skew_adj, round(kurtosis(value), 4) AS kurt_adj, round(kurtosis_pop(value), 4) AS kurt FROM v, n GROUP BY variable""")
def agg_01_09_basic(spark, sf_dir):
    o = T.basic(variables(spark, sf_dir, False), ABC)
    return rounded(o.select("variable", "n", "missing", "mean", "sd_pop", "sd", F.round("var", 4).alias("var"), "min", "max", "q1", "median", "q3", "iqr", "missing_ratio", F.round("skew_adj", 4).alias("skew_adj"), F.round("kurt_adj", 4).alias("kurt_adj"), F.round("kurt", 4).alias("kurt")))


@register("agg_01_index_quartiles", LONG + """, k AS (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY variable) AS n FROM v)
SELECT variable, max(value) FILTER (WHERE k = floor(n * 0.25)) AS q1, max(value) FILTER (WHERE k = floor(n * 0.5)) AS q2, max(value) FILTER (WHERE k = floor(n * 0.75)) AS q3 FROM k GROUP BY variable""")
def agg_01_index_quartiles(spark, sf_dir):
    return T.index_quartiles(variables(spark, sf_dir, False), ABC)


@register("agg_02_36_missing", f"""WITH {L}, t AS (SELECT *, (a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT AS m FROM l)
SELECT count(*) AS n_rows, CAST(sum(m) AS BIGINT) AS missing, count(*) FILTER (WHERE m = 0) AS complete_rows, count(*) FILTER (WHERE m > 0) AS rows_with_missing, CAST(max(m) AS BIGINT) AS most_in_row,
  count(*) FILTER (WHERE a IS NULL) AS missing_a, count(*) FILTER (WHERE b IS NULL) AS missing_b, count(*) FILTER (WHERE c IS NULL) AS missing_c, round(100 * sum(m) / (count(*) * 3), 6) AS missing_pct FROM t""")
def agg_02_36_missing(spark, sf_dir):
    return rounded(T.missing_summary(variables(spark, sf_dir, False), ABC))


@register("agg_03_temporal", "SELECT event_type AS series, CAST(floor(min(epoch(ts))) AS BIGINT) AS first_s, CAST(floor(max(epoch(ts))) AS BIGINT) AS last_s, count(*) AS n FROM events GROUP BY event_type")
def agg_03_temporal(spark, sf_dir):
    s = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series")).agg(F.min(s).alias("first_s"), F.max(s).alias("last_s"), F.count(F.lit(1)).alias("n"))


@register("agg_06_35_correlations", f"WITH {L} " + " UNION ALL ".join(f"SELECT '{p}' AS v1, '{q}' AS v2, round(corr({p}, {q}), 6) AS r, count(*) FILTER (WHERE {p} IS NOT NULL AND {q} IS NOT NULL) AS n FROM l" for p, q in (("a", "b"), ("a", "c"), ("b", "c"))))
def agg_06_35_correlations(spark, sf_dir):
    return rounded(T.correlations(variables(spark, sf_dir, False), ABC))


@register("agg_13_mode", LONG + ", k AS (SELECT variable, value, count(*) AS n FROM v GROUP BY 1, 2) SELECT variable, value AS mode, n FROM k QUALIFY row_number() OVER (PARTITION BY variable ORDER BY n DESC, value) = 1")
def agg_13_mode(spark, sf_dir):
    return T.modes(variables(spark, sf_dir, False), ABC)


@register("agg_14_15_performance", """SELECT l_returnflag AS method, count(*) AS n, round(avg(l_tax), 6) AS avg_rmse, min(l_tax) AS best, max(l_tax) AS worst, round(avg(l_quantity), 6) AS avg_ms FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1""")
def agg_14_15_performance(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").groupBy(F.col("l_returnflag").alias("method"))
    return rounded(t.agg(F.count(F.lit(1)).alias("n"), F.avg("l_tax").alias("avg_rmse"), F.min("l_tax").alias("best"), F.max("l_tax").alias("worst"), F.avg("l_quantity").alias("avg_ms")))


RANKS = """m AS (SELECT l_returnflag AS method, l_linestatus AS pattern, avg(l_tax) AS mean, stddev_pop(l_tax) AS sd, median(l_tax) AS median, count(*) AS n FROM lineitem GROUP BY ROLLUP(1, 2))"""


@register("agg_17_rankings", f"""WITH m AS (SELECT l_returnflag AS method, l_linestatus AS pattern, avg(l_tax) AS mean, stddev_pop(l_tax) AS sd, median(l_tax) AS median, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag)))
SELECT method, coalesce(pattern, 'all') AS pattern, round(mean, 6) AS mean, round(sd, 6) AS sd, round(median, 6) AS median, n, rank() OVER (PARTITION BY pattern ORDER BY mean) + (count(*) OVER (PARTITION BY pattern, mean) - 1) / 2.0::DOUBLE AS rank FROM m""")
def agg_17_rankings(spark, sf_dir):
    """Overall and per-pattern rankings in one pass (grouping sets)."""
    t = table(spark, sf_dir, "lineitem").groupingSets([[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_returnflag")]], F.col("l_returnflag"), F.col("l_linestatus"))
    m = t.agg(F.avg("l_tax").alias("mean"), F.stddev_pop("l_tax").alias("sd"), F.median("l_tax").alias("median"), F.count(F.lit(1)).alias("n"))
    m = m.select(F.col("l_returnflag").alias("method"), F.coalesce("l_linestatus", F.lit("all")).alias("pattern"), "mean", "sd", "median", "n")
    return rounded(T.ranked(m, ["pattern"], "mean", False))


@register("agg_18_resources", """SELECT o_orderstatus AS method, round(avg(o_totalprice) FILTER (WHERE o_orderstatus <> 'P'), 4) AS mean_time, round(stddev_samp(o_totalprice), 4) AS sd_time, min(o_totalprice) AS min_time, max(o_totalprice) AS max_time,
  round(count(*) FILTER (WHERE o_totalprice > 300000) / count(*), 6) AS failure_rate FROM orders GROUP BY 1""")
def agg_18_resources(spark, sf_dir):
    p = F.col("o_totalprice")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("method")).agg(F.avg(F.when(F.col("o_orderstatus") != "P", p)).alias("mean_time"), F.stddev_samp(p).alias("sd_time"), F.min(p).alias("min_time"), F.max(p).alias("max_time"), (F.count_if(p > 300000) / F.count(F.lit(1))).alias("failure_rate"))
    return o.select("method", F.round("mean_time", 4).alias("mean_time"), F.round("sd_time", 4).alias("sd_time"), "min_time", "max_time", F.round("failure_rate", 6).alias("failure_rate"))


@register("agg_24_profiler", """SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS peak, count(*) FILTER (WHERE value > 100) AS slow,
  count(*) FILTER (WHERE growth > 100) AS leaks FROM (SELECT *, last_value(value) OVER w - value AS growth FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) GROUP BY 1""")
def agg_24_profiler(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(0, 4)
    e = table(spark, sf_dir, "events").withColumn("growth", F.last("value").over(w) - F.col("value"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("peak"), F.count_if(F.col("value") > 100).alias("slow"), F.count_if(F.col("growth") > 100).alias("leaks"))


@register("agg_25_coverage", f"""WITH {L}, p AS (SELECT a, b, b BETWEEN a - 10 AND a + 40 AS hit FROM l WHERE a IS NOT NULL AND b IS NOT NULL), e AS (SELECT quantile_cont(a, [0.25, 0.5, 0.75]) AS q FROM p),
k AS (SELECT (a > q[1])::INT + (a > q[2])::INT + (a > q[3])::INT AS bin, hit FROM p, e), c AS (SELECT bin, count(*) AS n, avg(hit::INT) AS p FROM k GROUP BY bin)
SELECT CAST(bin AS BIGINT) AS bin, n, round(p, 6) AS coverage, round((p + 1.9207 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS lo,
  round((p + 1.9207 / n + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS hi FROM c""")
def agg_25_coverage(spark, sf_dir):
    """Interval coverage by quantile bin with Wilson intervals."""
    p = variables(spark, sf_dir, False).filter("a is not null and b is not null").select("a", F.expr("b between a - 10 and a + 40").alias("hit"))
    t = p.crossJoin(F.broadcast(percentiles(p, [], "a", [0.25, 0.5, 0.75])))
    k = t.withColumn("bin", sum((F.col("a") > F.col("q")[i]).cast("long") for i in range(3)))
    c = k.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("int")).alias("p"))
    n, q = F.col("n"), F.col("p")
    half = 1.96 * F.sqrt(q * (1 - q) / n + 0.9604 / (n * n))
    return rounded(c.select("bin", "n", q.alias("coverage"), ((q + 1.9207 / n - half) / (1 + 3.8416 / n)).alias("lo"), ((q + 1.9207 / n + half) / (1 + 3.8416 / n)).alias("hi")))


@register("agg_28_missing_by_time", f"WITH {G} SELECT series, CAST((i - 1) // 100 AS BIGINT) AS bucket, round(100 * avg((x IS NULL)::INT), 6) AS missing_pct FROM g GROUP BY 1, 2")
def agg_28_missing_by_time(spark, sf_dir):
    return rounded(sensors(spark, sf_dir).groupBy("series", F.expr("(i - 1) div 100").alias("bucket")).agg((100 * F.avg(F.col("x").isNull().cast("int"))).alias("missing_pct")))


@register("agg_32_patterns", f"WITH {L} SELECT (a IS NULL)::INT::VARCHAR || (b IS NULL)::INT::VARCHAR || (c IS NULL)::INT::VARCHAR AS pattern, count(*) AS n FROM l GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def agg_32_patterns(spark, sf_dir):
    return T.patterns(variables(spark, sf_dir, False), ABC)


@register("agg_33_unique", f"WITH {L} SELECT count(DISTINCT a) AS a, count(DISTINCT b) AS b, count(DISTINCT c) AS c FROM l")
def agg_33_unique(spark, sf_dir):
    return variables(spark, sf_dir, False).agg(*(F.count_distinct(c).alias(c) for c in ABC))


@register("prj_01_preview", f"WITH {G} SELECT series, i, event_id, x, (SELECT count(*) FROM g) AS total_rows FROM g ORDER BY series, i LIMIT 1000")
def prj_01_preview(spark, sf_dir):
    d = sensors(spark, sf_dir)
    return T.with_totals(d, total_rows=F.count(F.lit(1))).orderBy("series", "i").limit(1000).select("series", "i", "event_id", "x", "total_rows")


@register("prj_02_04_select_derive_filter", "SELECT event_id, value, value * 1.5 AS scaled FROM events WHERE value > 20 AND event_type <> 'click'")
def prj_02_04_select_derive_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.expr("value > 20 and event_type <> 'click'")).select("event_id", "value", (F.col("value") * 1.5).alias("scaled"))


@register("prj_05_outliers", """WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d FROM lineitem), f AS (SELECT * FROM lineitem, s WHERE abs(l_extendedprice - m) < 1.5 * d),
t AS (SELECT avg(l_quantity) AS m2, stddev_samp(l_quantity) AS d2 FROM f) SELECT count(*) AS n, round(avg(l_quantity), 6) AS mean FROM f, t WHERE abs(l_quantity - m2) < 1.5 * d2""")
def prj_05_outliers(spark, sf_dir):
    d = T.outliers_dropped(table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity"), ["l_extendedprice", "l_quantity"], 1.5)
    return rounded(d.agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean")))


@register("prj_06_12_scaling", """WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - lo) / (hi - lo), 6) AS unit, round((l_extendedprice - m) / d, 6) AS z, round(ln(1 + greatest(l_tax - 0.02, 0)), 6) AS logged FROM lineitem, s""")
def prj_06_12_scaling(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("unit"), F.col("l_extendedprice").alias("z"), (F.col("l_tax") - 0.02).alias("t"))
    return rounded(T.standardised(T.min_max(t, ["unit"]), ["z"]).select("l_orderkey", "l_linenumber", "unit", "z", T.log1p_clipped("t").alias("logged")))


@register("prj_08_09_diff_flag", f"WITH {G} SELECT series, i, round(x - lag(x, 2) OVER (PARTITION BY series ORDER BY i), 6) AS diff_2, x IS NULL AS has_missing FROM g")
def prj_08_09_diff_flag(spark, sf_dir):
    from ..operators.series import ordered

    return rounded(sensors(spark, sf_dir).select("series", "i", (F.col("x") - F.lag("x", 2).over(ordered())).alias("diff_2"), F.col("x").isNull().alias("has_missing")))


@register("prj_10_11_bounds", """SELECT event_id, CASE WHEN value IS NOT NULL THEN least(greatest(value, 10), 80) END AS clipped, value < 10 OR value > 80 AS at_bound FROM events""")
def prj_10_11_bounds(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.clipped("value", 10.0, 80.0).alias("clipped"), ((F.col("value") < 10) | (F.col("value") > 80)).alias("at_bound"))


@register("prj_13_calendar", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(month(ts) AS INTEGER) AS month FROM events")
def prj_13_calendar(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.hour("ts").alias("hour"), F.weekday("ts").alias("day_of_week"), F.month("ts").alias("month"))


@register("tst_02_pattern_uniformity", f"""WITH {L}, p AS (SELECT (a IS NULL)::INT::VARCHAR || (b IS NULL)::INT::VARCHAR || (c IS NULL)::INT::VARCHAR AS pattern, count(*) AS n FROM l GROUP BY 1), e AS (SELECT avg(n) AS e, count(*) AS k FROM p)
SELECT round(sum((n - e) * (n - e) / e), 4) AS chi2, any_value(k) - 1 AS df FROM p, e""")
def tst_02_pattern_uniformity(spark, sf_dir):
    return rounded(M.pattern_uniformity(variables(spark, sf_dir, False), T.missing_flags(ABC)), 4)


@register("tst_03_05_mechanism", f"WITH {L}, r AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS target, '{b}' AS other, corr(CASE WHEN {b} IS NOT NULL THEN ({a} IS NULL)::INT::DOUBLE END, {b}) AS r FROM l" for a in "abc" for b in "abc" if a != b)
    + ") SELECT target, other, round(r, 6) AS r, CASE WHEN abs(r) < 0.1 THEN 'MCAR' WHEN abs(r) < 0.5 THEN 'MAR' ELSE 'MNAR' END AS mechanism FROM r")
def tst_03_05_mechanism(spark, sf_dir):
    c = M.indicator_correlations(variables(spark, sf_dir, False), ABC)
    return rounded(c.withColumn("mechanism", M.mechanism(F.abs("r"))))


@register("tst_05_pooled_t", f"""WITH {L}, s AS (SELECT count(b) FILTER (WHERE a IS NULL) AS n, count(b) FILTER (WHERE a IS NOT NULL) AS m, avg(b) FILTER (WHERE a IS NULL) AS p, avg(b) FILTER (WHERE a IS NOT NULL) AS q,
  var_samp(b) FILTER (WHERE a IS NULL) AS v, var_samp(b) FILTER (WHERE a IS NOT NULL) AS w FROM l) SELECT round((p - q) / sqrt(((n - 1) * v + (m - 1) * w) / (n + m - 2) * (1.0 / n + 1.0 / m)), 6) AS t FROM s""")
def tst_05_pooled_t(spark, sf_dir):
    d = variables(spark, sf_dir, False)
    return rounded(d.agg(M.pooled_t(d, "a", "b").alias("t")))


@register("tst_25_26_structure", f"""WITH {G}, m AS (SELECT series, i, i - row_number() OVER (PARTITION BY series ORDER BY i) AS run FROM g WHERE x IS NULL), q AS (SELECT series, count(*) AS length FROM m GROUP BY series, run),
a AS (SELECT series, count(*) AS n_gaps, avg(length) AS mean_gap, max(length) AS max_gap, CAST(sum(length) AS BIGINT) AS missing, avg((length > 5)::INT) AS burst_ratio, stddev_pop(length) AS sd FROM q GROUP BY series),
n AS (SELECT series, count(*) AS n, max(i) FILTER (WHERE x IS NOT NULL) AS seen FROM g GROUP BY series)
SELECT n.series, n, n_gaps, round(mean_gap, 6) AS mean_gap, max_gap, missing, round(burst_ratio, 6) AS burst_ratio, CASE WHEN n_gaps IS NULL THEN 'none' WHEN n_gaps = 1 AND seen + missing = n THEN 'monotonic'
  WHEN burst_ratio > 0.5 THEN 'burst' WHEN sd < 0.5 * mean_gap AND mean_gap > 1 THEN 'periodic' WHEN max_gap <= 2 THEN 'random' ELSE 'mixed' END AS kind FROM n LEFT JOIN a USING (series)""")
def tst_25_26_structure(spark, sf_dir):
    return rounded(M.structure(sensors(spark, sf_dir), "x"))


@register("tst_29_missing_calendar", f"WITH {G} SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, count(*) FILTER (WHERE x IS NULL) AS missing FROM g GROUP BY 1")
def tst_29_missing_calendar(spark, sf_dir):
    return sensors(spark, sf_dir).groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").isNull()).alias("missing"))


@register("sim_01_07_masks", f"""WITH {G}, q AS (SELECT series, quantile_cont(truth, 0.8) AS q FROM g GROUP BY series)
SELECT g.series, i, (event_id * 2654435761) % 1000 < 200 AS mcar, CASE WHEN truth > q THEN (event_id * 2654435761) % 1000 < 600 ELSE (event_id * 2654435761) % 1000 < 200 END AS mnar,
  i % 100 < 24 AS block, g.series = 'click' AS outage, i % 5 = 0 AS systematic, (event_id * 2654435761) % 1000 < 80 OR i % 60 < 5 OR i % 24 = 0 AS mixed FROM g JOIN q USING (series)""")
def sim_01_07_masks(spark, sf_dir):
    d = sensors(spark, sf_dir)
    q = percentiles(d, ["series"], "truth", [0.8]).select("series", F.col("q")[0].alias("q"))
    i, e = F.col("i"), F.col("event_id")
    return d.join(q, "series").select("series", "i", M.mcar(e, 0.2).alias("mcar"), M.mnar(F.col("truth"), F.col("q"), e, 0.2).alias("mnar"), M.blocks(i, 100, 24).alias("block"), (F.col("series") == "click").alias("outage"), (i % 5 == 0).alias("systematic"), (M.mcar(e, 0.08) | M.blocks(i, 60, 5) | (i % 24 == 0)).alias("mixed"))


@register("val_01_06_checks", f"""WITH {G}, t AS (SELECT *, ts - lag(ts) OVER (PARTITION BY series ORDER BY i) AS step FROM g)
SELECT series, count(*) FILTER (WHERE x IS NOT NULL AND (x < 1 OR x > 90)) AS out_of_bounds, count(*) FILTER (WHERE x < 0) AS negative, count(*) FILTER (WHERE step <= INTERVAL 0 SECOND) AS not_increasing,
  count(*) FILTER (WHERE step > INTERVAL 1 DAY) AS long_gaps, round(count(x) / count(*), 6) AS completeness, CASE WHEN 100.0 * count(*) FILTER (WHERE x IS NULL) / count(*) > 90 THEN 'error' WHEN 100.0 * count(*) FILTER (WHERE x IS NULL) / count(*) > 20 THEN 'warning' ELSE 'ok' END AS missing_level FROM t GROUP BY series""")
def val_01_06_checks(spark, sf_dir):
    return rounded(V.series_checks(sensors(spark, sf_dir), "x", 1.0, 90.0))


@register("val_07_outliers", f"""WITH {L}, q AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS k, count(*) OVER () AS n FROM l WHERE b IS NOT NULL), e AS (SELECT max(b) FILTER (WHERE k = floor(n * 0.25)) AS q1, max(b) FILTER (WHERE k = floor(n * 0.75)) AS q3 FROM q)
SELECT count(*) FILTER (WHERE b < q1 - 0.5 * (q3 - q1) OR b > q3 + 0.5 * (q3 - q1)) AS outliers, any_value(q1) AS q1, any_value(q3) AS q3 FROM l, e""")
def val_07_outliers(spark, sf_dir):
    return V.index_outliers(variables(spark, sf_dir, False), "b", 0.5)


@register("val_12_frequency", f"""WITH {G}, d AS (SELECT series, date_diff('second', lag(ts) OVER w, ts) AS s, i FROM g WINDOW w AS (PARTITION BY series ORDER BY i)), k AS (SELECT series, s, row_number() OVER (PARTITION BY series ORDER BY s) AS r, count(*) OVER (PARTITION BY series) AS n FROM d WHERE s IS NOT NULL AND i <= 11)
SELECT series, CAST(s AS BIGINT) AS seconds, CASE WHEN s < 90 THEN '1min' WHEN s < 450 THEN '5min' WHEN s < 1350 THEN '15min' WHEN s < 2700 THEN '30min' WHEN s < 5400 THEN '1h' WHEN s < 129600 THEN '1d' ELSE 'irregular' END AS frequency FROM k WHERE r = n // 2 + 1""")
def val_12_frequency(spark, sf_dir):
    return V.frequency(sensors(spark, sf_dir))


@register("val_14_pollutants", f"""WITH {G}, r(series, lo, hi, warn, crit) AS (VALUES ('click', 0, 90, 40, 70), ('purchase', 0, 80, 30, 60), ('signup', 0, 100, 50, 80)),
j AS (SELECT g.series, CASE WHEN r.series IS NULL THEN 'unknown' WHEN x IS NULL THEN 'missing' WHEN x < lo OR x > hi THEN 'error' WHEN x > crit THEN 'critical' WHEN x > warn THEN 'warning' ELSE 'ok' END AS level FROM g LEFT JOIN r USING (series))
SELECT series, level, count(*) AS n FROM j GROUP BY 1, 2""")
def val_14_pollutants(spark, sf_dir):
    rules = spark.createDataFrame([("click", 0, 90, 40, 70), ("purchase", 0, 80, 30, 60), ("signup", 0, 100, 50, 80)], "series string, lo int, hi int, warn int, crit int")
    return V.by_rules(sensors(spark, sf_dir), "x", rules).groupBy("series", "level").agg(F.count(F.lit(1)).alias("n"))


@register("val_15_duplicate_times", "SELECT l_shipdate::DATE::VARCHAR AS day, count(*) AS n FROM lineitem GROUP BY l_shipdate HAVING count(*) > 1")
def val_15_duplicate_times(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_shipdate").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd").alias("day"), "n")


@register("val_16_18_scalars", """SELECT c_custkey, c_acctbal BETWEEN -90 AND 90 AS latitude_ok, regexp_matches(c_name, '^[A-Za-z0-9_-]+$') AND length(c_name) <= 50 AS id_ok, c_acctbal IS NOT NULL AND c_acctbal BETWEEN 0 AND 5000 AS range_ok FROM customer""")
def val_16_18_scalars(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.col("c_acctbal").between(-90, 90).alias("latitude_ok"), V.station_id_ok("c_name").alias("id_ok"), V.in_range("c_acctbal", 0, 5000).alias("range_ok"))
