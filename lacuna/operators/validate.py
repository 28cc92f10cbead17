"""Validation: issues, bounds, timestamps, rules, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import AT, BY, ordered
from .stats import index_quartiles

#: Physical ranges and alert levels (variable, lowest, highest, warning, critical).
POLLUTANTS = (
    ("PM2.5", 0.0, 500.0, 150.0, 250.0), ("PM10", 0.0, 600.0, 250.0, 350.0), ("O3", 0.0, 400.0, 180.0, 240.0),
    ("NO2", 0.0, 400.0, 200.0, 300.0), ("SO2", 0.0, 500.0, 250.0, 350.0), ("CO", 0.0, 50.0, 15.0, 30.0),
)


def series_checks(df: DataFrame, x: str, lo: float, hi: float, gap_days: int = 1) -> DataFrame:
    """Per series: cells out of bounds, negatives, times that don't increase, long gaps, completeness and its level."""
    step = F.col("ts") - F.lag("ts").over(ordered())
    v, miss = F.col(x), F.avg(F.col(x).isNull().cast("int")) * 100
    return df.withColumn("step", step).groupBy(BY).agg(
        F.count_if(v.isNotNull() & ((v < lo) | (v > hi))).alias("out_of_bounds"), F.count_if(v < 0).alias("negative"), F.count_if(F.col("step") <= F.expr("interval '0' second")).alias("not_increasing"),
        F.count_if(F.col("step") > F.expr(f"interval '{gap_days}' day")).alias("long_gaps"), (F.count(x) / F.count(F.lit(1))).alias("completeness"),
        F.when(miss > 90, "error").when(miss > 20, "warning").otherwise("ok").alias("missing_level"))


def issues(df: DataFrame, key: str, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """One row per cell out of its bounds: key, variable, value, lowest, highest."""
    cells = df.unpivot([key], list(bounds), "variable", "value")
    lo = F.create_map(*(y for k, (a, _) in bounds.items() for y in (F.lit(k), F.lit(float(a)))))
    hi = F.create_map(*(y for k, (_, b) in bounds.items() for y in (F.lit(k), F.lit(float(b)))))
    return cells.withColumns({"lowest": lo[F.col("variable")], "highest": hi[F.col("variable")]}).filter("value < lowest or value > highest")


def index_outliers(df: DataFrame, x: str, factor: float = 3.0) -> DataFrame:
    q = index_quartiles(df, [x]).select("q1", "q3")
    far = factor * (F.col("q3") - F.col("q1"))
    out = (F.col(x) < F.col("q1") - far) | (F.col(x) > F.col("q3") + far)
    return df.crossJoin(F.broadcast(q)).agg(F.count_if(out).alias("outliers"), F.first("q1").alias("q1"), F.first("q3").alias("q3"))


def frequency(df: DataFrame, first: int = 11) -> DataFrame:
    """Label from the (upper) median of the first ten steps of each series."""
    s = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    steps = df.filter(F.col(AT) <= first).withColumn("s", s - F.lag(s).over(ordered())).filter("s is not null")
    w = Window.partitionBy(BY)
    k = steps.select(BY, F.col("s").alias("seconds"), F.row_number().over(w.orderBy("s")).alias("r"), F.count(F.lit(1)).over(w).alias("n")).filter("r = n div 2 + 1")
    label = F.lit("irregular")
    for limit, name in ((129600, "1d"), (5400, "1h"), (2700, "30min"), (1350, "15min"), (450, "5min"), (90, "1min")):
        label = F.when(F.col("seconds") < limit, name).otherwise(label)
    return k.select(BY, "seconds", label.alias("frequency"))


def by_rules(df: DataFrame, x: str, rules: DataFrame) -> DataFrame:
    """Each row's level under the rule table (a few rows, broadcast); series without a rule are unknown."""
    r = rules.withColumn("known", F.lit(True))
    v = F.col(x)
    level = F.when(F.col("known").isNull(), "unknown").when(v.isNull(), "missing").when((v < F.col("lo")) | (v > F.col("hi")), "error").when(v > F.col("crit"), "critical").when(v > F.col("warn"), "warning").otherwise("ok")
    return df.join(F.broadcast(r), BY, "left").withColumn("level", level)


def station_id_ok(c: str) -> Column:
    return F.col(c).rlike(r"^[A-Za-z0-9_-]+$") & (F.length(c) <= 50)


def coordinates_ok(lat: str, lon: str) -> Column:
    return F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180)


def in_range(c: str, lo: float, hi: float) -> Column:
    x = F.col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & x.between(lo, hi)


def schema_problems(df: DataFrame, required: list[str]) -> list[str]:
    """Missing required columns, blanks and special signs in names, no numeric column."""
    import re

    out = [f"missing column: {c}" for c in required if c not in df.columns]
    out += [f"blank in name: {c}" for c in df.columns if " " in c]
    out += [f"special sign in name: {c}" for c in df.columns if re.search(r"[^A-Za-z0-9_ ]", c)]
    if not any(t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal") for _, t in df.dtypes):
        out.append("no numeric column")
    return out


def size_problem(n: int, least: int = 10, most: int = 10_000_000) -> str | None:
    return "TOO_FEW_ROWS" if n < least else "TOO_MANY_ROWS" if n > most else None
