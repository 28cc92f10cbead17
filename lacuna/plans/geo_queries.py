"""Queries of kriging in space and time, by scales and over blocks, with their SQL: systems of three neighbours are solved by hand there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from ..operators import geostat
from ..operators import spatial as P
from .judge_queries import ST, stations
from .tables import register, rounded, table

K = 3
#: events as values at places (a grid by user) and times (hours).
SPACE_TIME = """e AS (SELECT event_id AS k, (user_id % 12)::DOUBLE AS x, (user_id // 12)::DOUBLE AS y, epoch_us(ts) / 3.6e9 AS t, value AS v FROM events)"""
PLACES = "p AS (SELECT min(k) AS k, x, y, avg(v) AS v, count(*)::DOUBLE AS n FROM s GROUP BY x, y)"


def space_time_points(spark, sf_dir):
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), (u % 12).cast("double").alias("x"), F.floor(u / 12).cast("double").alias("y"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("t"), F.col("value").alias("v"))


def solved_in_sql(near: str, axes: Sequence[str], gamma, nugget: float) -> str:
    """CTEs: near (target, o_<axis>, r, <axis>, v, n of the three nearest) in one row, with semivariances g12, g13, g23 (between), b1, b2, b3 (to the target), g11, g22,
    g33 (a mean of n values has an n-th of the nugget), and the 2 x 2 system that is left when the weights' sum is put in: a11, a12, a21, a22, det."""
    cols = ", ".join(f"max({c}) FILTER (r = {k}) AS {c}{k}" for c in (*axes, "v", "n") for k in (1, 2, 3)).replace("FILTER (", "FILTER (WHERE ")
    own = ", ".join(f"any_value(o_{a}) AS o_{a}" for a in axes)
    between = ", ".join(f"{gamma(*[f'{a}{i} - {a}{j}' for a in axes])} AS g{i}{j}" for i, j in ((1, 2), (1, 3), (2, 3)))
    to = ", ".join(f"{gamma(*[f'{a}{i} - o_{a}' for a in axes])} AS b{i}, {nugget} * (1 - 1 / n{i}) AS g{i}{i}" for i in (1, 2, 3))
    return f"""w AS (SELECT target, {own}, {cols} FROM {near} GROUP BY target), y AS (SELECT *, {between}, {to} FROM w),
z AS (SELECT *, g11 - 2 * g13 + g33 AS a11, g12 - g23 - g13 + g33 AS a12, g12 - g13 - g23 + g33 AS a21, g22 - 2 * g23 + g33 AS a22 FROM y)"""


def weights_in_sql(name: str, c1: str, c2: str, one: int) -> str:
    """Weights u1, u2, u3 (sum `one`) for the right sides c1, c2 of the first two equations less the third."""
    d = "(a11 * a22 - a12 * a21)"
    w1, w2 = f"(({c1}) * a22 - a12 * ({c2})) / {d}", f"(a11 * ({c2}) - a21 * ({c1})) / {d}"
    return f"{w1} AS {name}1, {w2} AS {name}2, {one} - ({w1}) - ({w2}) AS {name}3"


def _exponential(part: float, reach: float, nugget: float):
    def gamma(*d: str) -> str:
        h = "sqrt(" + " + ".join(f"pow({x}, 2)" for x in d) + ")"
        return f"CASE WHEN {h} > 0 THEN {nugget} + {part} * (1 - exp(-3 * {h} / {reach})) ELSE 0 END"

    return gamma


def _near(strict: bool = True, targets: str = "p") -> str:
    """The three nearest places of each target."""
    d = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))"
    return f"""near AS (SELECT a.k AS target, a.x AS o_x, a.y AS o_y, b.x, b.y, b.v, b.n, row_number() OVER (PARTITION BY a.k ORDER BY {d}, b.k) AS r FROM {targets} a JOIN p b ON {'a.k <> b.k' if strict else 'true'} QUALIFY r <= 3)"""


MODEL = ("exponential", 1.0, 10.0, 5.0)
ORDINARY = "SELECT *, " + weights_in_sql("u", "b1 - b3 - g13 + g33", "b2 - b3 - g23 + g33", 1) + " FROM z"
#: w . b + mu of ordinary kriging; mu from the third equation.
VARIANCE = "u1 * b1 + u2 * b2 + u3 * b3 + b3 - (u1 * g13 + u2 * g23 + u3 * g33)"


@register("krg_03_three_places", f"""WITH {ST}, {PLACES}, {_near()}, {solved_in_sql('near', 'xy', _exponential(9.0, 5.0, 1.0), 1.0)}, o AS ({ORDINARY})
SELECT target, round(u1 * v1 + u2 * v2 + u3 * v3, 3) AS estimate, round(greatest(0, {VARIANCE}), 3) AS variance FROM o""")
def krg_03_three_places(spark, sf_dir):
    """Ordinary kriging of every place from the three nearest others."""
    at = P.places(stations(spark, sf_dir), "k")
    return rounded(P.kriged_near(at, at.withColumnRenamed("k", "target"), MODEL, K, strict=True), 3)


@register("krg_03_simple", f"""WITH {ST}, {PLACES}, {_near()}, {solved_in_sql('near', 'xy', _exponential(9.0, 5.0, 1.0), 1.0)},
c AS (SELECT *, 10 - g11 AS k11, 10 - g22 AS k22, 10 - g33 AS k33, 10 - g12 AS k12, 10 - g13 AS k13, 10 - g23 AS k23, 10 - b1 AS c1, 10 - b2 AS c2, 10 - b3 AS c3 FROM z),
d AS (SELECT *, k11 * (k22 * k33 - k23 * k23) - k12 * (k12 * k33 - k23 * k13) + k13 * (k12 * k23 - k22 * k13) AS det FROM c),
o AS (SELECT *, (c1 * (k22 * k33 - k23 * k23) - k12 * (c2 * k33 - k23 * c3) + k13 * (c2 * k23 - k22 * c3)) / det AS u1, (k11 * (c2 * k33 - k23 * c3) - c1 * (k12 * k33 - k23 * k13) + k13 * (k12 * c3 - c2 * k13)) / det AS u2,
  (k11 * (k22 * c3 - c2 * k23) - k12 * (k12 * c3 - c2 * k13) + c1 * (k12 * k23 - k22 * k13)) / det AS u3 FROM d)
SELECT target, round(4500 + u1 * (v1 - 4500) + u2 * (v2 - 4500) + u3 * (v3 - 4500), 3) AS estimate, round(greatest(0, 10 - u1 * c1 - u2 * c2 - u3 * c3), 3) AS variance FROM o""")
def krg_03_simple(spark, sf_dir):
    """Simple kriging about a known mean."""
    at = P.places(stations(spark, sf_dir), "k")
    return rounded(P.kriged_near(at, at.withColumnRenamed("k", "target"), MODEL, K, strict=True, kind="simple", mean=4500.0), 3)


@register("krg_03_universal")
def krg_03_universal(spark, sf_dir):
    """Universal kriging with a linear drift from the sixteen nearest places (tests hold it against a plain version)."""
    at = P.places(stations(spark, sf_dir), "k")
    return rounded(P.kriged_near(at, at.withColumnRenamed("k", "target"), MODEL, 16, strict=True, kind="universal"), 3)


@register("krg_06_surface", f"""WITH {SPACE_TIME}, j AS (SELECT sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, abs(a.t - b.t) AS u, pow(a.v - b.v, 2) AS m FROM e a JOIN e b ON a.k < b.k AND b.t > a.t - 6 AND b.t < a.t + 6 WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 16)
SELECT CAST(CASE WHEN d = 0 THEN 0 ELSE 1 + floor(d / 4 * 4) END AS BIGINT) AS space, CAST(CASE WHEN u = 0 THEN 0 ELSE 1 + floor(u / 6 * 4) END AS BIGINT) AS time, count(*) AS n, round(avg(d), 4) AS distance, round(avg(u), 4) AS lag, round(avg(m) / 2, 4) AS gamma FROM j GROUP BY ALL""")
def krg_06_surface(spark, sf_dir):
    """Semivariance by distance and time lag, of pairs nearer than 4 and 6 hours."""
    return rounded(geostat.space_time_variogram(space_time_points(spark, sf_dir), "k", 4.0, 6.0, 4, 4), 4)


SPACE_TIME_MODEL = geostat.SpaceTime("exponential", 1.0, 4.0, 2.0, 3.0, 6.0, 12.0)


def _product_sum(dx: str, dy: str, dt: str) -> str:
    h, u = f"sqrt(pow({dx}, 2) + pow({dy}, 2))", f"abs({dt})"
    s, t = f"(1 - exp(-3 * {h} / 6.0))", f"(1 - exp(-3 * {u} / 12.0))"
    return f"CASE WHEN {h} > 0 OR {u} > 0 THEN 1.0 + 4.0 * ({s} + {t} - {s} * {t}) + 2.0 * {s} + 3.0 * {t} ELSE 0 END"


_D3 = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.t * 0.5 - b.t * 0.5, 2))"


@register("krg_06_space_time", f"""WITH {SPACE_TIME}, q AS (SELECT CAST(x * 1000 + y AS BIGINT) AS k, x, y, (SELECT min(t) + 360 FROM e) AS t FROM e GROUP BY x, y),
near AS (SELECT a.k AS target, a.x AS o_x, a.y AS o_y, a.t AS o_t, b.x, b.y, b.t, b.v, 1.0 AS n, row_number() OVER (PARTITION BY a.k ORDER BY {_D3}, b.k) AS r FROM q a, e b QUALIFY r <= 3),
{solved_in_sql('near', 'xyt', _product_sum, 1.0)}, o AS ({ORDINARY}) SELECT target, round(u1 * v1 + u2 * v2 + u3 * v3, 3) AS estimate, round(greatest(0, {VARIANCE}), 3) AS variance FROM o""")
def krg_06_space_time(spark, sf_dir):
    """The field at all places 360 hours after the first event, each from its three nearest events in space and time."""
    e = space_time_points(spark, sf_dir)
    moment = e.agg((F.min("t") + 360).alias("t"))
    q = e.groupBy("x", "y").agg(F.lit(0).alias("z")).crossJoin(F.broadcast(moment)).select((F.col("x") * 1000 + F.col("y")).cast("long").alias("target"), "x", "y", "t")  # one row
    return rounded(geostat.kriged_space_time(e.withColumn("n", F.lit(1)), q, SPACE_TIME_MODEL, K), 3)


@register("krg_06_fitted")
def krg_06_fitted(spark, sf_dir):
    """The product-sum model fitted to the surface, and the field at all places from sixteen events (tests: planted structure)."""
    e = space_time_points(spark, sf_dir)
    surface = geostat.space_time_variogram(e, "k", 4.0, 6.0, 4, 4)
    model = geostat.fitted_product_sum([(r["distance"], r["lag"], r["gamma"], r["n"]) for r in surface.orderBy("space", "time").collect()])
    moment = e.agg((F.min("t") + 360).alias("t"))
    q = e.groupBy("x", "y").agg(F.lit(0).alias("z")).crossJoin(F.broadcast(moment)).select((F.col("x") * 1000 + F.col("y")).cast("long").alias("target"), "x", "y", "t")  # one row
    return rounded(geostat.kriged_space_time(e.withColumn("n", F.lit(1)), q, model, 16), 3)


NESTED = geostat.Nested(1.0, ((4.0, 3.0), (5.0, 12.0)))


def _nested(*d: str) -> str:
    h = "sqrt(" + " + ".join(f"pow({x}, 2)" for x in d) + ")"
    return f"CASE WHEN {h} > 0 THEN 1.0 + 4.0 * (1 - exp(-3 * {h} / 3.0)) + 5.0 * (1 - exp(-3 * {h} / 12.0)) ELSE 0 END"


def _part(sill: float, reach: float, i: int) -> str:
    return f"{sill} * exp(-3 * sqrt(pow(x{i} - o_x, 2) + pow(y{i} - o_y, 2)) / {reach})"


def _component(name: str, sill: float, reach: float) -> str:
    return weights_in_sql(name, f"{_part(sill, reach, 3)} - {_part(sill, reach, 1)}", f"{_part(sill, reach, 3)} - {_part(sill, reach, 2)}", 0)


@register("krg_08_factorial", f"""WITH {ST}, {PLACES}, {_near()}, {solved_in_sql('near', 'xy', _nested, 1.0)},
o AS (SELECT *, {weights_in_sql('u', 'b1 - b3 - g13 + g33', 'b2 - b3 - g23 + g33', 1)}, {weights_in_sql('m', 'g33 - g13', 'g33 - g23', 1)}, {_component('f', 4.0, 3.0)}, {_component('h', 5.0, 12.0)} FROM z)
SELECT target, round(u1 * v1 + u2 * v2 + u3 * v3, 3) AS estimate, round(m1 * v1 + m2 * v2 + m3 * v3, 3) AS mean, round(f1 * v1 + f2 * v2 + f3 * v3, 3) AS fine, round(h1 * v1 + h2 * v2 + h3 * v3, 3) AS coarse FROM o""")
def krg_08_factorial(spark, sf_dir):
    """Every place's estimate from three others, taken apart into mean, small and large scale, which add up to it."""
    at = P.places(stations(spark, sf_dir), "k")
    out = geostat.factorial_kriged(at, at.withColumnRenamed("k", "target"), NESTED, K, strict=True)
    return rounded(out.select("target", "estimate", "mean", F.col("parts")[0].alias("fine"), F.col("parts")[1].alias("coarse")), 3)


@register("krg_08_fitted")
def krg_08_fitted(spark, sf_dir):
    """Nested structures fitted to pairs within 8, and components of every place from sixteen neighbours (tests: they add up, planted scales)."""
    s = stations(spark, sf_dir)
    bins = [(r["distance"], r["gamma"], r["n"]) for r in geostat.near_variogram(s, "k", 8.0).filter("bin > 0").orderBy("bin").collect()]
    at = P.places(s, "k")
    out = geostat.factorial_kriged(at, at.withColumnRenamed("k", "target"), geostat.fitted_nested(bins, (1.0, 3.0, 9.0)), 16, strict=True)
    return rounded(out.select("target", "estimate", "mean", "noise", *(F.col("parts")[i].alias(f"scale_{i}") for i in range(3))), 3)


@register("krg_01_near", f"""WITH {ST}, p AS (SELECT sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, pow(a.v - b.v, 2) AS m FROM s a JOIN s b ON a.k < b.k WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 36)
SELECT CAST(CASE WHEN d = 0 THEN 0 ELSE 1 + floor(d / 6 * 12) END AS BIGINT) AS bin, count(*) AS n, round(avg(d), 6) AS distance, round(avg(m) / 2, 2) AS gamma FROM p GROUP BY 1""")
def krg_01_near(spark, sf_dir):
    """The semivariogram of pairs within a largest lag, which meet on grid cells."""
    v = geostat.near_variogram(stations(spark, sf_dir), "k", 6.0)
    return v.select("bin", "n", F.round("distance", 6).alias("distance"), F.round("gamma", 2).alias("gamma"))


def _block_gamma(i: int) -> str:
    h = "sqrt(pow(x{0} - o_x - cx, 2) + pow(y{0} - o_y - cy, 2))".format(i)
    return f"(SELECT avg(CASE WHEN {h} > 0 THEN 1.0 + 9.0 * (1 - exp(-3 * {h} / 5.0)) ELSE 0 END) FROM c)"


@register("krg_07_blocks", f"""WITH {ST}, {PLACES}, c AS (SELECT cx, cy FROM (VALUES (-0.75), (-0.25), (0.25), (0.75)) u(cx), (VALUES (-0.75), (-0.25), (0.25), (0.75)) v(cy)), {_near(False)}, {solved_in_sql('near', 'xy', _exponential(9.0, 5.0, 1.0), 1.0)},
m AS (SELECT avg(CASE WHEN h > 0 THEN 1.0 + 9.0 * (1 - exp(-3 * h / 5.0)) ELSE 0 END) AS within FROM (SELECT sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) AS h FROM c a, c b)),
zb AS (SELECT * REPLACE ({_block_gamma(1)} AS b1, {_block_gamma(2)} AS b2, {_block_gamma(3)} AS b3) FROM z), o AS ({ORDINARY.replace('FROM z', 'FROM zb')})
SELECT target, round(u1 * v1 + u2 * v2 + u3 * v3, 3) AS estimate, round(greatest(0, {VARIANCE} - within), 3) AS variance FROM o, m""")
def krg_07_blocks(spark, sf_dir):
    """The mean over a square of side 2 about every place, from its three nearest places."""
    at = P.places(stations(spark, sf_dir), "k")
    return rounded(geostat.block_kriged(at, at.withColumnRenamed("k", "target"), 2.0, MODEL, K), 3)
