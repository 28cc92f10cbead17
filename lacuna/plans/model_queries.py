"""Queries of spectra, complexity bounds and provenance, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bounds, linkage, processes, provenance, spectra
from ..operators import stats as T
from ..sources import files, netcdf
from .judge_queries import FILLED, filled
from .tables import G, register, rounded, sensors, table, variables

FREQUENCIES = 64


@register("imp_10_fourier", f"""WITH {G}, st AS (SELECT series, count(x) AS n, avg(x) AS mean FROM g GROUP BY series), o AS (SELECT series, x, row_number() OVER (PARTITION BY series ORDER BY i) - 1 AS k FROM g WHERE x IS NOT NULL),
s AS (SELECT o.series, f, any_value(n) AS n, sum((x - mean) * cos(2 * pi() * ((f * k) % n) / n)) AS re, -sum((x - mean) * sin(2 * pi() * ((f * k) % n) / n)) AS im FROM o JOIN st USING (series), range(0, {FREQUENCIES}) t(f) WHERE f <= n // 2 GROUP BY o.series, f),
b AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(re * re + im * im, 6) DESC, f) AS r FROM s QUALIFY r <= 10),
w AS (SELECT g.series, g.i, sum((CASE WHEN f = 0 OR 2 * f = n THEN 1 ELSE 2 END) / n * (cos(2 * pi() * ((f * (i - 1)) % n) / n) * re - sin(2 * pi() * ((f * (i - 1)) % n) / n) * im)) AS wave FROM g JOIN b ON b.series = g.series GROUP BY g.series, g.i)
SELECT series, i, round(coalesce(x, mean + wave), 4) AS filled FROM g JOIN st USING (series) JOIN w USING (series, i)""")
def imp_10_fourier(spark, sf_dir):
    """Gaps from the ten strongest of the first 64 frequencies."""
    return rounded(spectra.fourier(sensors(spark, sf_dir), "x", 10, FREQUENCIES), 4)


@register("met_04_spectral_error", FILLED + f""", cn AS (SELECT series, count(*) AS n FROM f GROUP BY series), s AS (SELECT f.series, k, sum(truth * cos(2 * pi() * ((k * (i - 1)) % n) / n)) AS ar, sum(truth * sin(2 * pi() * ((k * (i - 1)) % n) / n)) AS ai,
  sum(lin * cos(2 * pi() * ((k * (i - 1)) % n) / n)) AS br, sum(lin * sin(2 * pi() * ((k * (i - 1)) % n) / n)) AS bi FROM f JOIN cn USING (series), range(0, {FREQUENCIES}) t(k) WHERE k <= n // 2 GROUP BY f.series, k)
SELECT series, round(sqrt(avg(pow(sqrt(ar * ar + ai * ai) - sqrt(br * br + bi * bi), 2))), 5) AS spectral_rmse FROM s GROUP BY series""")
def met_04_spectral_error(spark, sf_dir):
    """How far a linear fill changes the amplitudes of the first 64 frequencies."""
    return rounded(spectra.spectral_error(filled(spark, sf_dir), "truth", "lin", FREQUENCIES), 5)


_SIGN = "CASE WHEN substr(md5(concat_ws('|', CAST(event_id AS VARCHAR), '0')), CAST(digit + 1 AS INTEGER), 1) >= '8' THEN 1.0::DOUBLE ELSE -1.0 END"


@register("imp_34_generalisation", FILLED + f""", m AS (SELECT event_id, truth, lin, mean_fill, ff FROM f WHERE x IS NULL AND lin IS NOT NULL AND mean_fill IS NOT NULL AND ff IS NOT NULL), r AS (SELECT count(*) AS n, avg(pow(lin / 3 + mean_fill / 3 + ff / 3 - truth, 2)) AS risk FROM m),
d AS (SELECT digit, greatest(abs(sum({_SIGN} * lin)), abs(sum({_SIGN} * mean_fill)), abs(sum({_SIGN} * ff))) AS top FROM m, range(0, 32) t(digit) GROUP BY digit), c AS (SELECT avg(top) AS top FROM d)
SELECT n, round(risk, 5) AS risk, round(top / n, 6) AS complexity, round(sqrt(ln(40) / (2 * n)), 6) AS confidence, round(risk + 2 * top / n + 3 * sqrt(ln(40) / (2 * n)), 4) AS bound, 6 AS dimension FROM r, c""")
def imp_34_generalisation(spark, sf_dir):
    """The bound on the squared error of the mean of three fills."""
    one = bounds.generalisation(filled(spark, sf_dir).filter("x is null"), "event_id", ["lin", "mean_fill", "ff"], "truth")
    return one.select("n", F.round("risk", 5).alias("risk"), F.round("complexity", 6).alias("complexity"), F.round("confidence", 6).alias("confidence"), F.round("bound", 4).alias("bound"), "dimension")


CONTENT = ["l_orderkey", "l_linenumber", "l_partkey", "quantity", "l_returnflag"]
_TEXT = " || ',' || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("l_orderkey", "l_linenumber", "l_partkey", "CAST(round(l_quantity * 100) AS BIGINT)", "l_returnflag"))


_ORDER = "l_orderkey, l_linenumber, l_partkey, CAST(round(l_quantity * 100) AS BIGINT), l_returnflag"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_quantity") * 100).cast("long").alias("quantity"), "l_returnflag")


@register("cat_07_tree", f"""WITH RECURSIVE h AS (SELECT row_number() OVER (ORDER BY {_ORDER}) AS i, sha256({_TEXT}) AS h FROM lineitem),
t AS (SELECT 0 AS level, (i - 1) // 256 AS node, sha256(string_agg(h, '' ORDER BY i)) AS hash FROM h GROUP BY (i - 1) // 256 UNION ALL
  SELECT level, node, hash FROM (SELECT any_value(level) + 1 AS level, node // 16 AS node, sha256(string_agg(hash, '' ORDER BY node)) AS hash FROM t WHERE (SELECT count(*) FROM t) > 1 GROUP BY node // 16))
SELECT CAST(level AS INTEGER) AS level, CAST(node AS BIGINT) AS node, hash FROM t""")
def cat_07_tree(spark, sf_dir):
    """The hash tree of the order lines."""
    return provenance.hash_tree(lines(spark, sf_dir), CONTENT, CONTENT)


@register("cat_07_changed", f"""WITH h AS (SELECT row_number() OVER (ORDER BY {_ORDER}) AS i, l_orderkey, l_linenumber FROM lineitem) SELECT DISTINCT CAST((i - 1) // 256 AS BIGINT) AS node FROM h WHERE l_orderkey % 997 = 5 AND l_linenumber = 1""")
def cat_07_changed(spark, sf_dir):
    """The leaves with a changed cell, found from the roots of two trees."""
    d = lines(spark, sf_dir)
    # the changed column isn't part of the order
    other = d.withColumn("l_returnflag", F.when((F.col("l_orderkey") % 997 == 5) & (F.col("l_linenumber") == 1), F.lit("?")).otherwise(F.col("l_returnflag")))
    old, new = (provenance.hash_tree(x, CONTENT[:4], CONTENT) for x in (d, other))
    return provenance.changed_leaves(old, new)


_STEP = " || ',' || ".join(f"length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR)" for c in ("o_orderstatus", "o_orderpriority", "CAST(round(o_totalprice * 100) AS BIGINT)"))
STEPS = f"""w AS (SELECT o_custkey AS workflow, o_orderkey AS step, sha256({_STEP}) AS h, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)"""


def steps(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("workflow"), F.col("o_orderkey").alias("step"), F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("parameters"), F.round(F.col("o_totalprice") * 100).cast("long").alias("output"))


@register("cat_07_chain", f"""WITH RECURSIVE {STEPS}, c AS (SELECT workflow, step, k, sha256('' || h) AS hash FROM w WHERE k = 1 UNION ALL SELECT w.workflow, w.step, w.k, sha256(c.hash || w.h) FROM c JOIN w ON w.workflow = c.workflow AND w.k = c.k + 1)
SELECT workflow, step, hash FROM c""")
def cat_07_chain(spark, sf_dir):
    """A customer's orders as a workflow: each step's hash covers all before it."""
    return provenance.chained(steps(spark, sf_dir))


@register("cat_07_verified", """WITH o AS (SELECT o_custkey AS workflow, o_orderkey AS step, o_orderkey % 97 = 3 AS changed FROM orders) SELECT workflow, step, true AS method_match, NOT changed AS output_match, NOT bool_or(changed) OVER (PARTITION BY workflow ORDER BY step) AS reproducible FROM o""")
def cat_07_verified(spark, sf_dir):
    """A rerun in which some steps gave other outputs: these, and every later hash of their workflows, differ."""
    s = steps(spark, sf_dir)
    return provenance.verified(s, s.withColumn("output", F.when(F.col("step") % 97 == 3, F.col("output") + 1).otherwise(F.col("output"))))


@register("src_04_snk_04_netcdf", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN event_id % 7 <> 3 THEN value END AS value FROM events")
def src_04_snk_04_netcdf(spark, sf_dir):
    """Events written as NetCDF classic files and read back by ranges of records."""
    path = files.scratch(spark, "netcdf")
    e = table(spark, sf_dir, "events").select(F.date_trunc("second", F.col("ts").cast("timestamp")).alias("time"), F.col("event_id").cast("int").alias("event_id"), F.when(F.col("event_id") % 7 != 3, F.col("value")).alias("value"))
    netcdf.write_netcdf(e, path)
    back = netcdf.read_netcdf(spark, path, rows=4096)
    return back.select(F.col("event_id").cast("long").alias("event_id"), F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("ts"), "value")


SEVEN = ["l_discount", "l_extendedprice", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey", "l_tax"]
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(1 - abs(corr({a}, {b})), 9) AS d FROM lineitem" for i, a in enumerate(SEVEN) for b in SEVEN[i + 1 :])
_JOINED = "list_filter(clusters, lambda c: list_contains(c, a) OR list_contains(c, b))"


@register("srt_12_linkage", f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (ORDER BY d, a, b) AS k FROM ({_PAIRS})), m AS (SELECT 0::BIGINT AS k, {[[c] for c in SEVEN]} AS clusters UNION ALL
  SELECT e.k, CASE WHEN len({_JOINED}) = 1 THEN clusters ELSE list_concat(list_filter(clusters, lambda c: NOT (list_contains(c, a) OR list_contains(c, b))),
    [CASE WHEN list_min({_JOINED}[1]) < list_min({_JOINED}[2]) THEN list_concat({_JOINED}[1], {_JOINED}[2]) ELSE list_concat({_JOINED}[2], {_JOINED}[1]) END]) END FROM m JOIN e ON e.k = m.k + 1)
SELECT CAST(generate_subscripts(o, 1) - 1 AS INTEGER) AS place, unnest(o) AS v FROM (SELECT clusters[1] AS o FROM m ORDER BY k DESC LIMIT 1)""")
def srt_12_linkage(spark, sf_dir):
    """Seven variables in the order that single linkage of 1 - |correlation| gives."""
    r = T.correlations(table(spark, sf_dir, "lineitem"), SEVEN)
    return linkage.leaf_order(r.select(F.col("v1").alias("a"), F.col("v2").alias("b"), F.round(1 - F.abs("r"), 9).alias("d")))


def _gaps(spark, sf_dir):
    return variables(spark, sf_dir).select("r", "a", "c", "b")


@register("imp_36_process")
def imp_36_process(spark, sf_dir):
    """Gaps of b from a process of a and c with a length for each (tests: equals the dense process)."""
    d = _gaps(spark, sf_dir)
    model = processes.fitted(d, "r", ["a", "c"], "b", 100)
    return rounded(processes.predicted(d.filter("b is null"), model, ["a", "c"]).select("r", "gp", "gp_sd"), 3)


@register("imp_54_heteroscedastic")
def imp_54_heteroscedastic(spark, sf_dir):
    """Intervals whose width follows the data: how many observed rows they hold, and how wide they are, by size of a."""
    d = processes.heteroscedastic(_gaps(spark, sf_dir), "r", ["a", "c"], "b", 60).filter("a is not null and b is not null and c is not null")
    hit = F.col("b").between(F.col("lo"), F.col("hi")).cast("int")
    return rounded(d.groupBy(F.floor(F.col("a") / 10).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("width")), 3)


@register("imp_55_draws")
def imp_55_draws(spark, sf_dir):
    """Five draws of the process at the gaps of b."""
    d = _gaps(spark, sf_dir)
    model = processes.fitted(d, "r", ["a", "c"], "b", 60)
    return rounded(processes.sampled(d.filter("b is null"), model, "r", ["a", "c"], 5), 3)
