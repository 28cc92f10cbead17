"""Queries of catalogue relations, rankings, sets, methods, pipelines, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import kernels as K
from ..operators import stats as T
from . import registry as R
from .series_queries import LIN, PREV
from .tables import G, L, register, rounded, sensors, table, variables


@register("joi_01_active_jobs", """SELECT o_orderkey AS job, c_custkey AS dataset, n_nationkey AS project, o_orderstatus AS status, o_orderpriority AS priority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus IN ('P', 'O')""")
def joi_01_active_jobs(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("dataset"), F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created"), F.col("o_orderstatus").alias("letter"))
    datasets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dataset"), F.col("c_nationkey").alias("project"))
    return C.active_jobs(jobs, datasets, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project"))).select("job", "dataset", "project", F.col("letter").alias("status"), "priority")


@register("joi_02_references", """SELECT c_custkey, EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_nationkey < 20) AS has_project, (SELECT count(*) FROM customer d WHERE d.c_nationkey = customer.c_nationkey) AS same FROM customer""")
def joi_02_references(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    known = table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(True).alias("known"))
    same = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("same"))
    return c.join(known, "c_nationkey", "left").join(same, "c_nationkey").select("c_custkey", F.col("known").isNotNull().alias("has_project"), "same")


@register("joi_13_pivot", """SELECT l_returnflag AS method, round(avg(l_tax) FILTER (WHERE l_linestatus = 'F'), 6) AS f, round(avg(l_tax) FILTER (WHERE l_linestatus = 'O'), 6) AS o FROM lineitem GROUP BY 1""")
def joi_13_pivot(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("method")).pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_tax"))
    return rounded(p.withColumnsRenamed({"F": "f", "O": "o"}))


@register("srt_01_05_jobs", """SELECT * FROM (SELECT 'next' AS what, o_orderkey AS job FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey LIMIT 1) UNION ALL SELECT * FROM (SELECT 'history', o_orderkey FROM orders WHERE o_custkey < 20 ORDER BY o_orderdate DESC, o_orderkey LIMIT 10)""")
def srt_01_05_jobs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    first = o.filter("o_orderstatus = 'O'").orderBy(F.desc("o_orderpriority"), "o_orderdate", "o_orderkey").limit(1).select(F.lit("next").alias("what"), F.col("o_orderkey").alias("job"))
    return first.unionByName(o.filter("o_custkey < 20").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select(F.lit("history").alias("what"), F.col("o_orderkey").alias("job")))


@register("srt_06_top_correlations", f"WITH {L}, r AS (" + " UNION ALL ".join(f"SELECT '{p}' AS v1, '{q}' AS v2, corr({p}, {q}) AS r FROM l" for p, q in (("a", "b"), ("a", "c"), ("b", "c"))) + ") SELECT v1, v2, round(r, 6) AS r FROM r ORDER BY abs(r) DESC LIMIT 10")
def srt_06_top_correlations(spark, sf_dir):
    return rounded(T.correlations(variables(spark, sf_dir, False), ["a", "b", "c"]).orderBy(F.desc(F.abs("r")), "v1", "v2").limit(10).drop("n"))


@register("srt_09_eviction", """SELECT key FROM (SELECT o_orderkey AS key, coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM orders) WHERE freed < 3000000""")
def srt_09_eviction(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.floor("o_totalprice").alias("size"), F.col("o_orderdate").alias("last_accessed"))
    return C.evicted(e, 3_000_000).select("key")


@register("srt_10_best", """SELECT 'tax' AS metric, arg_min(flag, m) AS best FROM (SELECT l_returnflag AS flag, avg(l_tax) AS m FROM lineitem GROUP BY 1) UNION ALL SELECT 'price', arg_max(flag, m) FROM (SELECT l_returnflag AS flag, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1)""")
def srt_10_best(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg("l_tax").alias("tax"), F.avg("l_extendedprice").alias("price"))
    one = m.agg(F.min_by("l_returnflag", "tax").alias("tax"), F.max_by("l_returnflag", "price").alias("price"))
    return one.unpivot([], ["tax", "price"], "metric", "best")


@register("set_01_06_sets", """WITH a AS (SELECT DISTINCT o_custkey % 50 AS k FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_custkey % 50 AS k FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 50 < 30)
SELECT 'difference' AS op, count(*) AS n FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'common', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'all', count(*) FROM (SELECT k FROM a UNION ALL SELECT k FROM b)
UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT least(l_partkey % 9, l_suppkey % 9) AS p, greatest(l_partkey % 9, l_suppkey % 9) AS q FROM lineitem WHERE l_partkey % 9 <> l_suppkey % 9)""")
def set_01_06_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = (F.col("o_custkey") % 50).alias("k")
    a, b = o.filter("o_orderkey % 2 = 0").select(k).distinct(), o.filter("o_orderstatus = 'F' and o_custkey % 50 < 30").select(k).distinct()
    li = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 9).alias("p"), (F.col("l_suppkey") % 9).alias("q")).filter("p <> q")
    edges = li.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
    return n(a.exceptAll(b), "difference").unionByName(n(a.intersect(b), "common")).unionByName(n(a.unionByName(b), "all")).unionByName(n(edges, "edges"))


@register("scl_03_06_json_time", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%d %H') AS hour, sha256(event_id::VARCHAR || '|' || event_type) AS hash, CAST(floor(epoch(ts)) AS BIGINT) % 86400 AS second FROM events""")
def scl_03_06_json_time(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.date_format(ts, "yyyy-MM-dd HH").alias("hour"), F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256).alias("hash"), (F.unix_timestamp(F.date_trunc("second", ts)) % 86400).alias("second"))


@register("cat_11_content_hash")
def cat_11_content_hash(spark, sf_dir):
    return C.content_hash(table(spark, sf_dir, "events"))


@register("imp_57_recommendations", """WITH s AS (SELECT event_type AS name, avg(value) / 100 AS missing, (count(*) % 10) / 10.0 AS seasonality, (count(*) % 7) / 7.0 AS moran FROM events GROUP BY 1)
SELECT name, 'adaptive' AS method, 0.95::DOUBLE AS suitability FROM s UNION ALL SELECT name, 'seasonal', 0.85 FROM s WHERE seasonality > 0.3 UNION ALL SELECT name, 'kriging', 0.8 FROM s WHERE moran > 0.3 UNION ALL SELECT name, 'low_rank', 0.75 FROM s WHERE missing > 0.3""")
def imp_57_recommendations(spark, sf_dir):
    n = F.count(F.lit(1))
    return C.recommendations(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg((F.avg("value") / 100).alias("missing"), ((n % 10) / 10.0).alias("seasonality"), ((n % 7) / 7.0).alias("moran")))


@register("imp_01_02_13_constants", f"""WITH {G}, c AS (SELECT series, avg(x) AS m, median(x) AS d FROM g GROUP BY series), k AS (SELECT series, x, count(*) AS n FROM g WHERE x IS NOT NULL GROUP BY 1, 2), o AS (SELECT series, x AS mode FROM k QUALIFY row_number() OVER (PARTITION BY series ORDER BY n DESC, x) = 1)
SELECT g.series, i, round(coalesce(x, m), 6) AS mean, round(coalesce(x, d), 6) AS median, round(coalesce(x, mode), 6) AS mode FROM g JOIN c USING (series) JOIN o USING (series)""")
def imp_01_02_13_constants(spark, sf_dir):
    d = sensors(spark, sf_dir).select("series", "i", "x")
    for m in ("mean", "median", "mode"):
        d = R.impute(d, "x", m, m)
    return rounded(d.drop("x"))


@register("imp_03_random_sample")
def imp_03_random_sample(spark, sf_dir):
    return rounded(R.impute(sensors(spark, sf_dir).select("series", "i", "x"), "x", "random_sample", "filled"))


@register("imp_17_adaptive")
def imp_17_adaptive(spark, sf_dir):
    return rounded(R.impute(sensors(spark, sf_dir).select("series", "i", "x"), "x", "adaptive", "filled").drop("x"))


@register("imp_44_per_block", f"""WITH {G}, b AS (SELECT series, (i - 1) // 100 AS b, avg(x) AS m FROM g GROUP BY 1, 2) SELECT g.series, i, round(coalesce(x, m), 6) AS filled FROM g JOIN b ON b.series = g.series AND b.b = (g.i - 1) // 100""")
def imp_44_per_block(spark, sf_dir):
    d = sensors(spark, sf_dir).withColumn("b", F.expr("(i - 1) div 100"))
    m = d.groupBy("series", "b").agg(F.avg("x").alias("m"))
    return rounded(d.join(m, ["series", "b"]).select("series", "i", F.coalesce("x", "m").alias("filled")))


for _name, _fill in (("imp_05_spline", K.spline), ("imp_09_gaussian_process", K.gaussian_process), ("imp_40_kernel_ridge", K.kernel_ridge)):
    def _query(spark, sf_dir, fill=_fill):
        return rounded(fill(sensors(spark, sf_dir), "x"), 4)

    register(_name)(_query)


@register("imp_05_linear_spline", f"WITH {G}, {PREV} SELECT series, i, round(coalesce(x, CASE WHEN pv IS NOT NULL AND nv IS NOT NULL THEN {LIN} END), 6) AS filled FROM n")
def imp_05_linear_spline(spark, sf_dir):
    """Order 1, which is linear between the ends: the blocks' seams against SQL."""
    return rounded(K.spline(sensors(spark, sf_dir), "x", order=1))


_MOMENTS = ", ".join([*(f"sum(pow((b.i - a.i) / 12.0, {p})) AS s{p}" for p in range(5)), *(f"sum(b.x * pow((b.i - a.i) / 12.0, {p})) AS t{p}" for p in range(3))])


@register("imp_06_polynomial", f"""WITH {G}, m AS (SELECT a.series, a.i, {_MOMENTS} FROM g a JOIN g b ON a.series = b.series AND b.i BETWEEN a.i - 12 AND a.i + 12 WHERE a.x IS NULL AND b.x IS NOT NULL GROUP BY 1, 2),
p AS (SELECT series, i, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)) AS y FROM m WHERE s0 > 2)
SELECT series, i, round(coalesce(x, y), 4) AS filled FROM g LEFT JOIN p USING (series, i)""")
def imp_06_polynomial(spark, sf_dir):
    return rounded(K.polynomial(sensors(spark, sf_dir), "x"), 4)


@register("imp_13_forest")
def imp_13_forest(spark, sf_dir):
    return rounded(K.forest(variables(spark, sf_dir), "r", ["a", "b", "c"]), 4)


@register("str_06_pipeline", f"""WITH {G}, {PREV}, f AS (SELECT series, i, {LIN} AS y FROM n), k AS (SELECT * FROM f WHERE y > 20), m AS (SELECT min(y) AS lo, max(y) AS hi FROM k) SELECT series, i, round((y - lo) / (hi - lo), 6) AS y, y IS NULL AS has_missing FROM k, m""")
def str_06_pipeline(spark, sf_dir):
    spec = '[{"op": "impute", "column": "x", "method": "linear", "out": "y"}, {"op": "filter", "condition": "y > 20"}, {"op": "transform", "columns": {"y": "normalize"}}, {"op": "validate", "columns": ["y"]}, {"op": "select", "columns": ["series", "i", "y", "has_missing"]}]'
    return rounded(R.run_pipeline(sensors(spark, sf_dir), spec))


@register("str_09_windows", """SELECT event_type AS series, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def str_09_windows(spark, sf_dir):
    """The batch form of the streaming window (tests run both)."""
    from ..streaming.streams import windowed

    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return rounded(windowed(e, watermark=False).select("series", F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "n", "mean"))


@register("udf_10_methods")
def udf_10_methods(spark, sf_dir):
    return R.methods_table(spark)


@register("src_11_profile")
def src_11_profile(spark, sf_dir):
    from ..sources.files import partition_profile

    return partition_profile(variables(spark, sf_dir, False))


@register("snk_08_metadata")
def snk_08_metadata(spark, sf_dir):
    from ..sources.files import metadata

    return metadata(table(spark, sf_dir, "lineitem"), "l_shipdate")
