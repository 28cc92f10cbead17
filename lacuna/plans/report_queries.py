"""Queries of reports, files, catalogue tables, streams and plug-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as N
from ..operators import catalog as C
from ..operators import missing as M
from ..operators import neighbours
from ..operators import quantile as Z
from ..operators import reports as P
from ..operators import series as S
from ..operators import spatial
from ..operators import tests as H
from ..sources import files
from ..streaming import streams
from . import registry as R
from .judge_queries import FILLED, filled, methods
from .series_queries import LIN, PREV, W
from .tables import G, L, register, rounded, sensors, table, variables

ABC = ["a", "b", "c"]


def over_variables(sql: str, columns=ABC) -> str:
    return " UNION ALL ".join(sql.format(c=c) for c in columns)


# reports over columns and results


@register("agg_05_histogram", f"WITH {L}, s AS (" + over_variables("SELECT '{c}' AS variable, {c} AS v, min({c}) OVER () AS lo, max({c}) OVER () AS hi FROM l") + ") SELECT variable, CAST(least(floor((v - lo) / (hi - lo) * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM s WHERE v IS NOT NULL GROUP BY 1, 2")
def agg_05_histogram(spark, sf_dir):
    return P.histogram(variables(spark, sf_dir, False), ABC)


@register("agg_10_12_moments", f"WITH {L} " + over_variables("SELECT '{c}' AS variable, count({c}) AS n, round(sum({c}), 2) AS total, round(sum({c} * {c}), 1) AS squares, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 5) AS sd FROM l"))
def agg_10_12_moments(spark, sf_dir):
    return P.moments(variables(spark, sf_dir, False), ABC).select("variable", "n", F.round("total", 2).alias("total"), F.round("squares", 1).alias("squares"), F.round("mean", 6).alias("mean"), F.round("sd", 5).alias("sd"))


@register("agg_16_20_folds", FILLED + ", e AS (SELECT series, event_id % 5 AS fold, avg(abs(lin - truth)) AS mae, sqrt(avg(pow(lin - truth, 2))) AS rmse FROM f WHERE x IS NULL GROUP BY 1, 2) SELECT series, count(*) AS folds, round(avg(mae), 6) AS mae_mean, round(stddev_pop(mae), 6) AS mae_sd, round(avg(rmse), 6) AS rmse_mean, round(stddev_pop(rmse), 6) AS rmse_sd FROM e GROUP BY series")
def agg_16_20_folds(spark, sf_dir):
    d = filled(spark, sf_dir).filter("x is null").withColumn("fold", F.col("event_id") % 5)
    e = F.col("lin") - F.col("truth")
    return rounded(P.fold_summary(d, ["series"], "fold", {"mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e))}))


_PAIRS = " UNION ALL ".join(f"SELECT '{p}' AS v1, '{q}' AS v2, corr({p}, {q}) AS r FROM l" for p, q in (("a", "b"), ("a", "c"), ("b", "c")))


@register("agg_22_correlation_summary", f"WITH {L}, r AS ({_PAIRS}) SELECT count(*) AS pairs, round(avg(r), 6) AS mean, round(min(r), 6) AS least, round(max(r), 6) AS most, count(*) FILTER (WHERE abs(r) >= 0.3) AS strong FROM r")
def agg_22_correlation_summary(spark, sf_dir):
    return rounded(P.correlation_summary(variables(spark, sf_dir, False), ABC))


@register("joi_10_tst_24_correlation_graph", f"WITH {L}, r AS ({_PAIRS}) SELECT v1, v2, round(r, 6) AS r FROM r WHERE abs(r) > 0.001")
def joi_10_tst_24_correlation_graph(spark, sf_dir):
    return rounded(P.strong_pairs(variables(spark, sf_dir, False), ABC, 0.001))


@register("agg_23_storage", "SELECT count(*) AS entries, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes, round(sum(o_custkey % 7)::DOUBLE / (sum(o_custkey % 7) + sum(o_custkey % 3)), 6) AS hit_rate FROM orders")
def agg_23_storage(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return rounded(P.storage(o.select(F.floor("o_totalprice").alias("size"), (F.col("o_custkey") % 7).alias("hits"), (F.col("o_custkey") % 3).alias("misses"))))


@register("agg_27_band", "WITH w AS (SELECT l_returnflag AS flag, l_extendedprice * (l_discount + l_tax) AS w FROM lineitem) SELECT flag, round(avg(w), 4) AS mean, round(stddev_pop(w), 4) AS sd, round(min(w), 4) AS least, round(max(w), 4) AS most, round(quantile_cont(w, 0.25), 4) AS p25, round(quantile_cont(w, 0.5), 4) AS p50, round(quantile_cont(w, 0.75), 4) AS p75, round(quantile_cont(w, 0.95), 4) AS p95 FROM w GROUP BY flag")
def agg_27_band(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") * (F.col("l_discount") + F.col("l_tax"))).alias("w"))
    return rounded(P.band(d, "flag", "w"), 4)


@register("agg_29_jobs_by_status", "SELECT o_orderstatus AS status, count(*) AS jobs, CAST(sum(CAST(floor(o_totalprice / 100) AS BIGINT)) AS BIGINT) AS seconds, strftime(max(o_orderdate), '%Y-%m-%d') AS newest FROM orders GROUP BY 1")
def agg_29_jobs_by_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.floor(F.col("o_totalprice") / 100).alias("seconds"), F.col("o_orderdate").alias("created"))
    return P.jobs_by_status(o).withColumn("newest", F.date_format("newest", "yyyy-MM-dd"))


_FLAGS = "(a IS NULL)::INT || '' || (b IS NULL)::INT || (c IS NULL)::INT"


@register("agg_31_characteristics", f"WITH {L} SELECT count(*) AS samples, 3 AS features, round((count(*) * 3 - count(a) - count(b) - count(c))::DOUBLE / (count(*) * 3), 6) AS missing_share, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL) AS complete, count(DISTINCT {_FLAGS}) AS patterns FROM l")
def agg_31_characteristics(spark, sf_dir):
    return rounded(P.characteristics(variables(spark, sf_dir, False), ABC))


@register("set_05_patterns", f"WITH {L} SELECT {_FLAGS} AS pattern, count(*) AS n FROM l GROUP BY 1")
def set_05_patterns(spark, sf_dir):
    return P.all_patterns(variables(spark, sf_dir, False), ABC)


@register("tst_06_pattern_kind", f"WITH {L}, p AS (SELECT count(DISTINCT {_FLAGS}) AS patterns FROM l) SELECT patterns, CASE WHEN patterns <= 10 THEN 'monotone' ELSE 'arbitrary' END AS kind FROM p")
def tst_06_pattern_kind(spark, sf_dir):
    return P.pattern_kind(variables(spark, sf_dir, False), ABC)


@register("agg_38_series_plot", f"WITH {G} SELECT series, count(x) AS n, count(*) - count(x) AS missing, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, round(min(x), 6) AS least, round(max(x), 6) AS most FROM g GROUP BY series")
def agg_38_series_plot(spark, sf_dir):
    return rounded(P.series_plot(sensors(spark, sf_dir), "x"))


@register("agg_43_recent_errors", FILLED + f" SELECT series, i, round(avg(abs(lin - truth)) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS recent FROM f")
def agg_43_recent_errors(spark, sf_dir):
    d = filled(spark, sf_dir).withColumn("e", F.abs(F.col("lin") - F.col("truth")))
    return rounded(P.recent_errors(d, "e").select("series", "i", "recent"))


@register("imp_18_19_online_scores", FILLED + f", k AS (SELECT series, i, 'linear' AS method, abs(lin - truth) AS loss FROM f UNION ALL SELECT series, i, 'ffill', abs(ff - truth) FROM f), o AS (SELECT *, count(loss) OVER w AS n, avg(loss) OVER w AS m FROM k WINDOW w AS (PARTITION BY series, method ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) SELECT series, i, method, round(CASE WHEN n >= 5 THEN 1 / (1 + m) ELSE 0.5 END, 6) AS score FROM o")
def imp_18_19_online_scores(spark, sf_dir):
    d = filled(spark, sf_dir).select("series", "i", F.abs(F.col("lin") - F.col("truth")).alias("linear"), F.abs(F.col("ff") - F.col("truth")).alias("ffill"))
    return rounded(P.online_scores(d.unpivot(["series", "i"], ["linear", "ffill"], "method", "loss")))


# orders


def _results(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created"))


@register("srt_03_trend", "WITH r AS (SELECT o_orderkey AS id, o_orderdate AS d FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders)) SELECT id, strftime(d, '%Y-%m-%d') AS created FROM r WHERE d >= (SELECT max(d) FROM r) - INTERVAL 90 DAY")
def srt_03_trend(spark, sf_dir):
    r = _results(spark, sf_dir)
    first = r.agg(F.min("method")).first()[0]
    return P.trend(r, first, 90).select("id", F.date_format("created", "yyyy-MM-dd").alias("created"))


@register("srt_04_results", "SELECT o_orderkey AS id, o_orderpriority AS method, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def srt_04_results(spark, sf_dir):
    return P.matching(_results(spark, sf_dir), {"status": ["F", "P"], "method": []}, 25).select("id", "method", "status")


@register("srt_05_newest", "SELECT o_custkey AS project, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def srt_05_newest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("id"), "o_orderdate")
    return P.newest_first(o, "project", "o_orderdate", "id").select("project", "id", "place")


# masks, sets and joins


@register("set_02_mask_union", f"WITH {G} SELECT event_id, coalesce(x IS NULL, false) AS gap, event_id % 11 = 0 AS outage, (x IS NULL OR event_id % 11 = 0) AS masked FROM g")
def set_02_mask_union(spark, sf_dir):
    return P.masked_or(sensors(spark, sf_dir), {"gap": F.col("x").isNull(), "outage": F.col("event_id") % 11 == 0}).select("event_id", "gap", "outage", "masked")


@register("set_04_required_columns", "SELECT * FROM (VALUES ('r_altitude'), ('r_station')) t(name)")
def set_04_required_columns(spark, sf_dir):
    wanted = spark.createDataFrame([("r_name",), ("r_regionkey",), ("r_altitude",), ("r_station",)], "name string")
    return P.columns_lacking(table(spark, sf_dir, "region"), wanted)


@register("joi_03_aligned", FILLED + " SELECT series, count(*) AS n, round(avg(truth), 6) AS truth, round(avg(lin), 6) AS lin FROM f WHERE x IS NULL GROUP BY series")
def joi_03_aligned(spark, sf_dir):
    """Truth and fills from two frames, joined on their index under the mask."""
    d = filled(spark, sf_dir)
    both = d.filter("x is null").select("series", "i", "truth").join(d.select("series", "i", "lin"), ["series", "i"])
    return rounded(both.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.avg("truth").alias("truth"), F.avg("lin").alias("lin")))


@register("joi_04_members", FILLED + " SELECT series, i, round((lin + ff + mean_fill) / 3, 6) AS mean FROM f")
def joi_04_members(spark, sf_dir):
    """The members' outputs side by side, and their mean."""
    _, u = methods(spark, sf_dir)
    return rounded(u.groupBy("series", "i").pivot("method", ["linear", "ffill", "mean"]).agg(F.first("value")).select("series", "i", ((F.col("linear") + F.col("ffill") + F.col("mean")) / 3).alias("mean")))


# scalar expressions


@register("scl_01_errors", "SELECT l_orderkey, l_linenumber, round(abs(l_tax - l_discount), 6) AS ae, round(pow(l_tax - l_discount, 2), 6) AS se, round(100 * abs(l_tax - l_discount) / (abs(l_discount) + 1e-8), 1) AS ape, round(200 * abs(l_tax - l_discount) / (abs(l_discount) + abs(l_tax) + 1e-8), 4) AS sape, round(l_tax - l_discount, 6) AS bias FROM lineitem")
def scl_01_errors(spark, sf_dir):
    e = N.errors(F.col("l_discount"), F.col("l_tax"))
    digits = {"ape": 1, "sape": 4}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(v, digits.get(k, 6)).alias(k) for k, v in e.items()))


@register("scl_02_missing_tests", f"WITH {G} SELECT event_id, x IS NULL AS missing, round(coalesce(x, -1.0), 6) AS value FROM g")
def scl_02_missing_tests(spark, sf_dir):
    return rounded(sensors(spark, sf_dir).select("event_id", (F.col("x").isNull() | F.isnan("x")).alias("missing"), F.coalesce("x", F.lit(-1.0)).alias("value")))


@register("scl_08_latex", r"SELECT p_partkey, replace(replace(replace(p_name || '_50%', '%', '\%'), '#', '\#'), '_', '\_') AS tex FROM part")
def scl_08_latex(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.latex(F.concat("p_name", F.lit("_50%"))).alias("tex"))


@register("scl_14_slopes", "SELECT p_partkey, round(CASE WHEN p_size > 0 AND p_size < 30 THEN 9 * (1.5 / 30 - 1.5 * pow(p_size, 2) / 27000) ELSE 0 END, 6) AS slope FROM part")
def scl_14_slopes(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select("p_partkey", N.variogram_slope("spherical", F.col("p_size").cast("double"), 1.0, 10.0, 30.0).alias("slope")))


@register("prj_18_transforms", "SELECT l_orderkey, l_linenumber, round((sqrt(l_quantity) - 1) / 0.5, 6) AS root, round(ln(l_quantity), 6) AS log, round(l_quantity, 4) AS back FROM lineitem")
def prj_18_transforms(spark, sf_dir):
    x = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(P.boxcox(x, 0.5), 6).alias("root"), F.round(P.boxcox(x, 0), 6).alias("log"), F.round(P.boxcox_back(P.boxcox(x, 0.5), 0.5), 4).alias("back"))


# fills


@register("imp_04_14_donor_fill", """WITH p AS (SELECT p_partkey AS k, p_size::DOUBLE AS a, p_retailprice / 100 AS b, CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE p_retailprice END AS v FROM part),
j AS (SELECT q.k, d.v, row_number() OVER (PARTITION BY q.k ORDER BY sqrt(pow(q.a - d.a, 2) + pow(q.b - d.b, 2)), d.k) AS r FROM p q, p d WHERE q.v IS NULL AND d.v IS NOT NULL) SELECT k, round(avg(v) FILTER (WHERE r = 1), 6) AS hot_deck, round(avg(v), 6) AS knn FROM j WHERE r <= 3 GROUP BY k""")
def imp_04_14_donor_fill(spark, sf_dir):
    """Gaps from the nearest donor (hot deck) and from the mean of the three nearest."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 100).alias("b"), F.when(F.col("p_partkey") % 20 != 0, F.col("p_retailprice")).alias("v"))
    donors = p.filter("v is not null").withColumnRenamed("k", "donor")
    near = spatial.nearest_on_grid(p.filter("v is null").withColumnRenamed("k", "q"), donors, 3, "a", "b").join(donors.select("donor", "v"), "donor")
    return rounded(near.groupBy(F.col("q").alias("k")).agg(F.avg(F.when(F.col("rank") == 1, F.col("v"))).alias("hot_deck"), F.avg("v").alias("knn")))


@register("imp_23_text_fill", f"WITH {G}, t AS (SELECT series, i, CASE WHEN x IS NOT NULL THEN 'v' || (event_id % 5) END AS t FROM g) SELECT series, i, coalesce(last_value(t IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(t IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS t FROM t")
def imp_23_text_fill(spark, sf_dir):
    d = sensors(spark, sf_dir).select("series", "i", F.when(F.col("x").isNotNull(), F.concat(F.lit("v"), (F.col("event_id") % 5).cast("string"))).alias("t"))
    return S.both_fills(d, "t", "out").select("series", "i", F.col("out").alias("t"))


@register("imp_50_52_udf_01_02_imputer", f"WITH {G}, m AS (SELECT series, max(x) AS m FROM g GROUP BY series) SELECT series, i, round(coalesce(x, m), 6) AS filled FROM g JOIN m USING (series)")
def imp_50_52_udf_01_02_imputer(spark, sf_dir):
    """A plug-in method, registered and run through the imputer's fit and transform."""
    largest = R.plugged_in("largest", lambda df, x, out: df.join(F.broadcast(df.groupBy("series").agg(F.max(x).alias("m__"))), "series").withColumn(out, F.coalesce(x, "m__")).drop("m__"), doc="largest value of the series")
    d = sensors(spark, sf_dir).select("series", "i", "x")
    with largest:
        return rounded(R.Imputer("largest", "x", out="filled").fit(d).transform(d).drop("x"))


@register("udf_03_chunks", "SELECT event_type AS series, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def udf_03_chunks(spark, sf_dir):
    """A processor of pandas frames, and a combiner of what it gives."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), "value")
    out = P.by_chunk(e, lambda p: p.groupby("series", as_index=False).agg(n=("value", "size"), total=("value", "sum")), "series string, n long, total double", lambda d: d.groupBy("series").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    return rounded(out, 4)


# judging


@register("met_05_correlation_error", FILLED + ", w AS (SELECT i, " + ", ".join(f"max({c}) FILTER (WHERE series = '{s}') AS {s}_{k}" for s in ("click", "purchase") for c, k in (("truth", "t"), ("lin", "f"))) + " FROM f GROUP BY i) SELECT round(abs(corr(click_f, purchase_f) - corr(click_t, purchase_t)), 6) AS mae, round(abs(corr(click_f, purchase_f) - corr(click_t, purchase_t)), 6) AS rmse FROM w")
def met_05_correlation_error(spark, sf_dir):
    d = filled(spark, sf_dir).filter("series in ('click', 'purchase')")
    w = d.groupBy("i").pivot("series", ["click", "purchase"]).agg(F.max("truth").alias("t"), F.max("lin").alias("f"))
    return rounded(P.correlation_error(w, [("click", "purchase")], "t", "f"))


@register("met_11_reconstruction", FILLED + " SELECT series, round(sqrt(avg(pow(lin - truth, 2))), 6) AS error, round(corr(truth, lin), 6) AS r FROM f GROUP BY series")
def met_11_reconstruction(spark, sf_dir):
    return rounded(filled(spark, sf_dir).groupBy("series").agg(F.sqrt(F.avg(N.errors(F.col("truth"), F.col("lin"))["se"])).alias("error"), F.corr("truth", "lin").alias("r")))


@register("met_16_sensitivity", f"WITH {G}, v AS (" + " UNION ALL ".join(f"SELECT {r} AS radius, series, x, truth, avg(x) OVER ({W} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS y FROM g" for r in (5, 12, 24)) + ") SELECT radius, round(sqrt(avg(pow(y - truth, 2))), 6) AS rmse, count(y) AS n FROM v WHERE x IS NULL GROUP BY radius")
def met_16_sensitivity(spark, sf_dir):
    """The error of local means over a range of radii."""
    d = sensors(spark, sf_dir)
    d = d.withColumns({f"r{r}": F.avg("x").over(S.rows(-r, r)) for r in (5, 12, 24)}).filter("x is null").select("truth", F.expr("stack(3, 5, r5, 12, r12, 24, r24) as (radius, y)"))
    return rounded(d.groupBy("radius").agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("truth"), F.lit(2)))).alias("rmse"), F.count("y").alias("n")))


@register("cnf_03_06_quantile_band", FILLED + """, b AS (SELECT series, event_id % 2 = 0 AS held, truth, lin - 20 AS lo, lin + 20 AS hi FROM f WHERE x IS NULL), k AS (SELECT series, greatest(lo - truth, truth - hi) AS s, row_number() OVER (PARTITION BY series ORDER BY greatest(lo - truth, truth - hi)) AS k, count(*) OVER (PARTITION BY series) AS n FROM b WHERE held),
m AS (SELECT series, s AS margin FROM k WHERE k = least(n, ceil((n + 1) * 0.9))) SELECT series, round(any_value(margin), 6) AS margin, round(avg((truth BETWEEN lo - margin AND hi + margin)::INT), 6) AS coverage, round(avg(hi - lo + 2 * margin), 6) AS width FROM b JOIN m USING (series) WHERE NOT held GROUP BY series""")
def cnf_03_06_quantile_band(spark, sf_dir):
    d = filled(spark, sf_dir).filter("x is null").withColumns({"lo": F.col("lin") - 20, "hi": F.col("lin") + 20})
    return rounded(P.quantile_band(d, "series", "truth", "lo", "hi", F.col("event_id") % 2 == 0, 0.1))


@register("cnf_03_quantile_regression", FILLED.replace("WITH", "WITH RECURSIVE", 1) + """, t AS (SELECT series, event_id % 3 AS part, truth AS y, lin FROM f WHERE x IS NULL), u AS (SELECT avg(lin) AS m, stddev_pop(lin) AS s, avg(y) AS my, stddev_pop(y) AS sy FROM t WHERE part = 0),
d AS (SELECT (lin - m) / s AS x, y, sy FROM t, u WHERE part = 0), b AS (SELECT tau, 0 AS k, my AS b0, 0.0::DOUBLE AS b1 FROM u, (VALUES (0.05::DOUBLE), (0.95::DOUBLE)) v(tau) UNION ALL
  SELECT tau, k + 1, (sxx * sy - sx * sxy) / (sw * sxx - sx * sx), (sw * sxy - sx * sy) / (sw * sxx - sx * sx) FROM (SELECT tau, k, sum(w) AS sw, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * y + 2 * tau - 1) AS sy, sum(w * x * y + (2 * tau - 1) * x) AS sxy
    FROM (SELECT tau, k, x, y, 1 / (abs(y - b0 - b1 * x) + greatest(pow(0.5, k), 1e-4) * sy) AS w FROM b, d WHERE k < 20) GROUP BY tau, k)),
l AS (SELECT t.*, lo.b0 + lo.b1 * (lin - m) / s AS lo, hi.b0 + hi.b1 * (lin - m) / s AS hi FROM t, u, b lo, b hi WHERE lo.k = 20 AND hi.k = 20 AND lo.tau < 0.5 AND hi.tau > 0.5),
k AS (SELECT series, greatest(lo - y, y - hi) AS s, row_number() OVER (PARTITION BY series ORDER BY greatest(lo - y, y - hi)) AS k, count(*) OVER (PARTITION BY series) AS n FROM l WHERE part = 1), q AS (SELECT series, s AS margin FROM k WHERE k = least(n, ceil((n + 1) * 0.9)))
SELECT series, round(any_value(margin), 4) AS margin, round(avg((y BETWEEN lo - margin AND hi + margin)::INT), 6) AS coverage, round(avg(hi - lo + 2 * margin), 4) AS width FROM l JOIN q USING (series) WHERE part = 2 GROUP BY series""")
def cnf_03_quantile_regression(spark, sf_dir):
    """Conformalised quantile regression of the truth on the linear fill: lines fitted on a third of the gaps, widened on a third, judged on the rest."""
    part = F.col("event_id") % 3
    d = Z.conformal_quantiles(filled(spark, sf_dir).filter("x is null"), "series", "truth", ["lin"], part == 0, part == 1, 0.1).filter(part == 2)
    hit = F.col("truth").between(F.col("lo"), F.col("hi")).cast("int")
    return d.groupBy("series").agg(F.round(F.first("margin"), 4).alias("margin"), F.round(F.avg(hit), 6).alias("coverage"), F.round(F.avg(F.col("hi") - F.col("lo")), 4).alias("width"))


@register("cnf_04_cv_plus", f"""WITH {G}, s AS (SELECT series, event_id % 5 AS fold, sum(x) AS s, count(x) AS n FROM g WHERE x IS NOT NULL GROUP BY 1, 2), m AS (SELECT series, fold, (sum(s) OVER (PARTITION BY series) - s) / (sum(n) OVER (PARTITION BY series) - n) AS mu FROM s),
e AS (SELECT g.series, mu + abs(x - mu) AS up, abs(x - mu) - mu AS down FROM g JOIN m ON m.series = g.series AND m.fold = g.event_id % 5 WHERE x IS NOT NULL), k AS (SELECT series, list_sort(list(up)) AS u, list_sort(list(down)) AS d, CAST(least(count(*), ceil((count(*) + 1) * 0.9)) AS BIGINT) AS k FROM e GROUP BY 1),
q AS (SELECT series, -d[k] AS lo, u[k] AS hi FROM k) SELECT series, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi, round(avg((truth BETWEEN lo - 1e-9 AND hi + 1e-9)::INT), 6) AS coverage FROM g JOIN q USING (series) WHERE x IS NULL GROUP BY series""")
def cnf_04_cv_plus(spark, sf_dir):
    """Intervals from the observed rows, judged on the gaps' true values."""
    d = sensors(spark, sf_dir).withColumn("fold", F.col("event_id") % 5)
    q = P.cv_plus(d, "series", "x", "fold", 0.1)
    hit = F.col("truth").between(F.col("lo") - 1e-9, F.col("hi") + 1e-9).cast("int")
    return rounded(d.filter("x is null").join(q, "series").groupBy("series").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.avg(hit).alias("coverage")))


def _normal(*keys: str) -> str:
    h = "md5(concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + "))"
    u, v = (f"((('0x' || substr({h}, {p}, 12))::BIGINT + 0.5) / pow(2, 48))" for p in (1, 13))
    return f"sqrt(-2 * ln({u})) * cos(2 * pi() * {v})"


@register("imp_39_met_13_multiple", f"""WITH {G}, p AS (SELECT series, count(x)::DOUBLE AS n, avg(x) AS m, var_samp(x) AS v FROM g GROUP BY 1), w AS (SELECT series, draw, n, m, sqrt((n - 1) * v / ((n - 1) * pow(1 - 2 / (9 * (n - 1)) + {_normal("'variance'", 'series', 'draw')} * sqrt(2 / (9 * (n - 1))), 3))) AS s FROM p, range(1, 6) k(draw)),
o AS (SELECT series, draw, s, m + s / sqrt(n) * {_normal("'mean'", 'series', 'draw')} AS mu FROM w), d AS (SELECT series, draw, coalesce(x, mu + s * {_normal("'row'", 'event_id', 'draw')}) AS v FROM g JOIN o USING (series)),
e AS (SELECT series, draw, avg(v) AS q, var_samp(v) / count(*) AS u FROM d GROUP BY 1, 2) SELECT series, round(avg(q), 6) AS pooled, round(avg(u) + 1.2 * var_samp(q), 6) AS total, round(1.2 * var_samp(q) / (avg(u) + 1.2 * var_samp(q)), 6) AS fmi FROM e GROUP BY series""")
def imp_39_met_13_multiple(spark, sf_dir):
    """Five imputations, each with a mean and a variance of its own, each series' mean in each of them, pooled by Rubin's rules."""
    v = P.draws(sensors(spark, sf_dir), "series", "x", "event_id", 5)
    each = v.groupBy("series", "draw").agg(F.avg("value").alias("q"), (F.var_samp("value") / F.count("value")).alias("u"))
    return rounded(H.rubin(each, "series", "q", "u").select("series", "pooled", "total", "fmi"))


@register("tst_13_rubin", "WITH a AS (SELECT l_returnflag AS g, count(*) AS m, avg(l_tax) AS pooled, avg(l_discount) AS within, var_samp(l_tax) AS b FROM lineitem GROUP BY 1) SELECT g, round(pooled, 6) AS pooled, round(within + (1 + 1.0 / m) * b, 6) AS total, round(pooled / sqrt(within + (1 + 1.0 / m) * b), 6) AS t FROM a")
def tst_13_rubin(spark, sf_dir):
    d = H.rubin(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "g"), "g", "l_tax", "l_discount")
    return rounded(d.select("g", "pooled", "total", (F.col("pooled") / F.sqrt("total")).alias("t")))


_HASHED = "((event_id * 2654435761) % 1000 + 1000) % 1000"


@register("sim_02_05_masks", f"SELECT event_id, CASE WHEN value > 50 THEN {_HASHED} < 300 ELSE {_HASHED} < 100 END AS mar, {_HASHED} < 0.3 * 1000 * exp(-(user_id % 10) / 4.0) AS decaying FROM events")
def sim_02_05_masks(spark, sf_dir):
    """Missing more often where another variable is large, and less often with distance."""
    e = table(spark, sf_dir, "events")
    mar = F.when(F.col("value") > 50, M.mcar(F.col("event_id"), 0.3)).otherwise(M.mcar(F.col("event_id"), 0.1))
    return e.select("event_id", mar.alias("mar"), M.decaying(F.col("user_id") % 10, 4.0, F.col("event_id"), 0.3).alias("decaying"))


# validation


@register("val_04_categorical", "SELECT 'p_size' AS variable, count(DISTINCT p_size) AS distinct, true AS whole, count(DISTINCT p_size) < 10 AND count(*) > 100 AS categorical FROM part UNION ALL SELECT 'p_retailprice', count(DISTINCT p_retailprice), bool_and(p_retailprice = floor(p_retailprice)), bool_and(p_retailprice = floor(p_retailprice)) AND count(DISTINCT p_retailprice) < 10 AND count(*) > 100 FROM part")
def val_04_categorical(spark, sf_dir):
    return P.categorical_guess(table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"])


@register("val_08_11_verdict", f"WITH {L}, s AS (" + over_variables("SELECT 1 - count({c})::DOUBLE / count(*) AS share FROM l") + ") SELECT CASE max(CASE WHEN share >= 1 THEN 3 WHEN share > 0.9 THEN 2 WHEN share > 0.1 THEN 1 ELSE 0 END) WHEN 0 THEN 'ok' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' ELSE 'critical' END AS level, count(*) FILTER (WHERE share > 0.1) AS issues, max(share) < 1 AS valid FROM s")
def val_08_11_verdict(spark, sf_dir):
    return P.verdict(variables(spark, sf_dir, False), ABC, warning=0.1)


@register("val_09_summary", f"WITH {L} " + over_variables("SELECT '{c}' AS variable, count(*) AS n, count(*) - count({c}) AS missing, round(min({c}), 6) AS least, round(max({c}), 6) AS most, 'double' AS kind FROM l"))
def val_09_summary(spark, sf_dir):
    return rounded(P.summary(variables(spark, sf_dir, False), ABC))


@register("val_20_negatives", "SELECT 'c_acctbal' AS variable, count(*) FILTER (WHERE c_acctbal < 0) AS negative FROM customer")
def val_20_negatives(spark, sf_dir):
    return P.negatives(table(spark, sf_dir, "customer"), ["c_acctbal"])


@register("val_22_parameters", "SELECT * FROM (VALUES ('order', 3.0::DOUBLE, true), ('smoothing', -1.0, false), ('window', 24.0, true), ('other', 9.0, true)) t(name, value, ok)")
def val_22_parameters(spark, sf_dir):
    given = spark.createDataFrame([("order", 3.0), ("smoothing", -1.0), ("window", 24.0), ("other", 9.0)], "name string, value double")
    return P.checked_parameters(given, {"order": (1, 5), "smoothing": (0, 1e9), "window": (1, 1000)})


# files: written by the sinks, read back by the sources


EVENTS = "SELECT event_id::DOUBLE AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(CASE WHEN event_id % 7 = 3 THEN NULL ELSE value END, 4) AS value FROM events"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 7 != 3, F.col("value")).alias("value"))


def _shown(df):
    return df.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.round("value", 4).alias("value"))


def _through(name: str, extension: str, written: dict, read: dict) -> None:
    def query(spark, sf_dir):
        path = files.scratch(spark, name) + extension
        files.write(_events(spark, sf_dir), path, **written)
        return _shown(files.read(spark, path, date_column="ts", columns=["event_id", "ts", "value"], **read))

    register(name, EVENTS)(query)


_through("src_02_08_snk_01_csv", ".csv", {}, {})
_through("snk_02_csv_options", ".csv", {"delimiter": ";", "na": "N/A", "date_format": "yyyy-MM-dd HH:mm:ss"}, {"delimiter": ";"})
_through("snk_09_compressed_csv", ".csv.gz", {"kind": "csv", "compression": "gzip"}, {})
_through("src_06_snk_06_parquet", ".parquet", {}, {})
_through("src_07_snk_07_json_lines", ".jsonl", {}, {})
_through("src_13_snk_12_orc", ".orc", {}, {})


@register("src_07_json_columns", "SELECT event_id::DOUBLE AS event_id, round(value, 4) AS value FROM events")
def src_07_json_columns(spark, sf_dir):
    """A document of columns per series, {event_id: [...], value: [...]}, read as rows. A file holds one document: the reader takes the first and no other."""
    e = table(spark, sf_dir, "events").select("event_id", F.round("value", 4).alias("value"), (F.col("event_id") % 50).alias("file"))
    path = files.scratch(spark, "columns") + ".json"
    docs = e.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("r"))
    docs.select(F.to_json(F.struct(F.col("r.event_id").alias("event_id"), F.col("r.value").alias("value"))).alias("value")).repartition(50).write.option("maxRecordsPerFile", 1).text(path)
    return files.read(spark, path)


@register("src_09_cf_time", "SELECT event_id, strftime(TIMESTAMP '2020-01-01 00:00:00' + to_minutes(event_id), '%Y-%m-%d %H:%M') AS ts FROM events")
def src_09_cf_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format(files.cf_time("event_id", "minutes since 2020-01-01 00:00:00"), "yyyy-MM-dd HH:mm").alias("ts"))


@register("src_10_many", "SELECT 'even' AS source, count(*) AS n FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'odd', count(*) FROM events WHERE event_id % 2 = 1")
def src_10_many(spark, sf_dir):
    """Several files, one of which isn't there."""
    root, e = files.scratch(spark, "many"), _events(spark, sf_dir)
    for k, name in enumerate(("even", "odd")):
        files.write(e.filter(F.col("event_id") % 2 == k), f"{root}/{name}.parquet")
    good, _ = files.read_many(spark, [f"{root}/{n}.parquet" for n in ("even", "odd", "none")], date_column="ts")
    parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(p.rsplit("/", 1)[1].split(".")[0]).alias("source"), "n") for p, d in good.items()]
    return parts[0].unionByName(parts[1])


@register("src_15_synthetic", "SELECT CAST(s AS VARCHAR) AS station, CAST(t AS BIGINT) AS i, round(greatest((50 + 15 * sin(2 * pi() * t / 24) + 8 * sin(2 * pi() * t / 168)) * exp(-s / 20.0) + 5.0 * t / 500, 0), 6) AS value FROM range(500) a(t), range(20) b(s)")
def src_15_synthetic(spark, sf_dir):
    return rounded(files.synthetic(spark, 500, noise=0.0).drop("ts"))


@register("src_16_registered", "SELECT event_type AS series, count(*) AS n FROM events GROUP BY 1")
def src_16_registered(spark, sf_dir):
    files.register(table(spark, sf_dir, "events"), "lacuna_events")
    return spark.sql("SELECT event_type AS series, count(*) AS n FROM lacuna_events GROUP BY event_type")


@register("snk_13_filled_export", f"WITH {G}, {PREV} SELECT series, i, round({LIN}, 6) AS filled FROM n")
def snk_13_filled_export(spark, sf_dir):
    path = files.scratch(spark, "filled") + ".parquet"
    files.write(R.impute(sensors(spark, sf_dir).select("series", "i", "x"), "x", "linear", "filled"), path)
    return rounded(spark.read.parquet(path).select("series", "i", "filled"))


# catalogue tables


@register("cat_01_upsert", "SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS value FROM customer WHERE c_custkey % 5 <> 0")
def cat_01_upsert(spark, sf_dir):
    """Insert, update a third, delete a fifth: the newest row of each key counts."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    t = C.Table(spark, files.scratch(spark, "table"), ["key"])
    t.upsert(c)
    t.upsert(c.filter("key % 3 = 0").withColumn("value", F.lit("new")))
    t.delete(c.filter("key % 5 = 0"))
    return t.read().select("key", "value")


@register("cat_03_audit", "SELECT 1 AS version, 'upsert' AS action, count(*) AS n FROM customer UNION ALL SELECT 2, 'upsert', count(*) FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 3, 'delete', count(*) FROM customer WHERE c_custkey % 5 = 0")
def cat_03_audit(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    t = C.Table(spark, files.scratch(spark, "table"), ["key"])
    t.upsert(c)
    t.upsert(c.filter("key % 3 = 0"))
    t.delete(c.filter("key % 5 = 0"))
    return t.history().groupBy(F.col("version__").alias("version"), F.col("action__").alias("action")).agg(F.count(F.lit(1)).alias("n"))


@register("cat_04_integrity", "SELECT r_name || '.txt' AS path, r_regionkey <> 2 AS ok FROM region")
def cat_04_integrity(spark, sf_dir):
    """One text file per region, one of which no longer has its stored hash."""
    root = files.scratch(spark, "intact")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    r.select(F.col("r_name").alias("value"), F.col("r_name").alias("name")).repartition("name").write.partitionBy("name").text(root)
    known = r.select(F.concat("r_name", F.lit(".txt")).alias("path"), F.sha2(F.concat("r_name", F.when(F.col("r_regionkey") == 2, "!").otherwise(""), F.lit("\n")), 256).alias("hash"))
    return C.intact(spark, root, known, name=lambda p: F.concat(F.regexp_replace(F.regexp_extract(p, "name=([^/]*)/", 1), "%20", " "), F.lit(".txt")))


# streams, run to the end over files


BATCHES = 4


def _stream(spark, sf_dir, name):
    path = files.scratch(spark, name)
    # files of consecutive rows, in the order of their time stamps; each is a micro-batch
    rows = sensors(spark, sf_dir).select("series", "i", "x")
    top = rows.agg(F.max("i")).first()[0] or 1
    for k in range(BATCHES):
        rows.filter((F.col("i") > k * top // BATCHES) & (F.col("i") <= (k + 1) * top // BATCHES)).repartition(1).write.mode("append").parquet(f"{path}/in")
    return path, spark.readStream.schema("series string, i long, x double").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


@register("str_01_05_two_pass_mean", f"WITH {G} SELECT series, i, round(coalesce(x, (SELECT avg(x) FROM g)), 6) AS x FROM g")
def str_01_05_two_pass_mean(spark, sf_dir):
    path, _ = _stream(spark, sf_dir, "two-pass")
    streams.two_pass_mean(spark, f"{path}/in", ["x"], f"{path}/out", f"{path}/ck")
    return rounded(spark.read.parquet(f"{path}/out"))


@register("str_03_win_16_carried_fill", f"WITH {G} SELECT series, i, round(last_value(x IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS filled FROM g")
def str_03_win_16_carried_fill(spark, sf_dir):
    path, stream = _stream(spark, sf_dir, "carried")
    streams.run_to_files(streams.carried_fill(stream), f"{path}/out", f"{path}/ck")
    return rounded(spark.read.parquet(f"{path}/out"))


KNN = """one AS (SELECT r, a, b, c FROM l WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY r ORDER BY a, b, c) = 1), ref AS (SELECT md5(CAST(r AS VARCHAR)) AS pos, a, b, c FROM one ORDER BY 1, r LIMIT 128),
st AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(c) AS sc FROM ref), gap AS (SELECT row_number() OVER () AS u, r, a, b, c FROM l WHERE a IS NULL OR b IS NULL OR c IS NULL),
dist AS (SELECT g.*, ref.pos, ref.a AS ra, ref.b AS rb, ref.c AS rc, round(sqrt((coalesce(pow((g.a - ref.a) / sa, 2), 0) + coalesce(pow((g.b - ref.b) / sb, 2), 0) + coalesce(pow((g.c - ref.c) / sc, 2), 0)) * 3 / nullif((g.a IS NOT NULL)::INT + (g.b IS NOT NULL)::INT + (g.c IS NOT NULL)::INT, 0)), 9) AS d FROM gap g, ref, st),
top AS (SELECT *, min(d) OVER (PARTITION BY u) AS low FROM dist WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY u ORDER BY d, pos) <= 5), wt AS (SELECT *, CASE WHEN low = 0 THEN (d = 0)::INT ELSE 1 / d END AS w FROM top),
est AS (SELECT u, sum(w * ra) / sum(w) AS ea, sum(w * rb) / sum(w) AS eb, sum(w * rc) / sum(w) AS ec FROM wt GROUP BY u)
SELECT gap.r, round(coalesce(a, ea, ma), 6) AS a, round(coalesce(b, eb, mb), 6) AS b, round(coalesce(c, ec, mc), 6) AS c FROM gap LEFT JOIN est USING (u), st"""


@register("imp_14_knn", f"WITH {L}, {KNN}")
def imp_14_knn(spark, sf_dir):
    """Gaps of three variables from the five nearest of 128 whole rows, over the variables that a row has."""
    d = variables(spark, sf_dir).select("r", *ABC)
    out = neighbours.knn_filled(d.filter("a is null or b is null or c is null"), neighbours.reference(d, "r", ABC, 128), ABC)
    return rounded(out.select("r", *(F.col(f"{c}_filled").alias(c) for c in ABC)))


@register("str_02_knn", f"WITH {L}, {KNN}")
def str_02_knn(spark, sf_dir):
    """The same from a stream of four micro-batches that keeps the reference as it goes."""
    path = files.scratch(spark, "knn")
    variables(spark, sf_dir).select("r", *(F.col(c).cast("double").alias(c) for c in ABC)).repartition(BATCHES, "r").write.parquet(f"{path}/in")
    stream = spark.readStream.schema("r long, a double, b double, c double").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    streams.knn_reference(stream, path, "r", ABC, 128)
    return rounded(streams.knn_fills(spark, path, "r", "long", ABC).select("r", *(F.col(f"{c}_filled").alias(c) for c in ABC)))


@register("str_08_chunk_run", "SELECT event_type AS series, event_id, round(value * 2, 6) AS doubled FROM events WHERE value > 20")
def str_08_chunk_run(spark, sf_dir):
    path = files.scratch(spark, "chunks")
    table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), "event_id", "value").write.parquet(f"{path}/in")
    s = spark.readStream.schema("series string, event_id long, value double").parquet(f"{path}/in")
    spec = [{"op": "filter", "condition": "value > 20"}, {"op": "multiply", "column": "value", "by": 2.0, "out": "doubled"}, {"op": "select", "columns": ["series", "event_id", "doubled"]}]
    streams.run_to_files(R.run_pipeline(s, spec), f"{path}/out", f"{path}/ck")
    return rounded(spark.read.parquet(f"{path}/out"))


@register("str_09_sessions", """WITH e AS (SELECT event_type AS series, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM events), s AS (SELECT series, ts, sum((p IS NULL OR ts >= p + INTERVAL 30 MINUTE)::INT) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT series, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY series, k""")
def str_09_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("ts"))
    return streams.sessions(e, watermark=False).select("series", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@register("win_29_trend_fill", f"WITH {G}, c AS (SELECT series, regr_slope(x, i) AS b, regr_intercept(x, i) AS a FROM g GROUP BY series) SELECT series, i, round(coalesce(x, a + b * i), 5) AS filled FROM g JOIN c USING (series)")
def win_29_trend_fill(spark, sf_dir):
    d = sensors(spark, sf_dir).select("series", "i", "x")
    line = d.groupBy("series").agg(F.regr_slope("x", F.col("i").cast("double")).alias("b"), F.regr_intercept("x", F.col("i").cast("double")).alias("a"))
    # one row per series
    return d.join(F.broadcast(line), "series").select("series", "i", F.round(F.coalesce("x", F.col("a") + F.col("b") * F.col("i")), 5).alias("filled"))


@register("win_19_vote_entropy", f"""WITH {G}, d AS (SELECT series, i, least(floor(truth / 10), 9) AS a, least(floor(coalesce(x, 50) / 10), 9) AS b, least(floor(coalesce(x, 25) / 10), 9) AS c FROM g), v AS (SELECT series, i, unnest([a, b, c]) AS k FROM d), n AS (SELECT series, i, k, count(*) / 3.0 AS p FROM v GROUP BY 1, 2, 3) SELECT series, i, round(sum(-p * ln(p)), 6) + 0.0 AS entropy FROM n GROUP BY 1, 2""")
def win_19_vote_entropy(spark, sf_dir):
    """Disagreement of three members, as the entropy of the decile that each votes for."""
    vote = lambda c: F.least(F.floor(c / 10), F.lit(9))
    d = sensors(spark, sf_dir).select("series", "i", F.explode(F.array(vote(F.col("truth")), vote(F.coalesce("x", F.lit(50.0))), vote(F.coalesce("x", F.lit(25.0))))).alias("k"))
    p = d.groupBy("series", "i", "k").agg((F.count(F.lit(1)) / 3.0).alias("p"))
    return p.groupBy("series", "i").agg((F.round(F.sum(-F.col("p") * F.log("p")), 6) + 0.0).alias("entropy"))

