"""Aggregates over wide frames of variables: statistics by column, missing patterns, correlations, scaling, filters."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import percentiles
from .series import long_form


def by_variable(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, value): one aggregation then serves all columns."""
    return long_form(df, [], columns)


def basic(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, missing, mean, both deviations, extremes, linear quartiles, skewness, excess kurtosis: one pass, and one for the quartiles."""
    long = by_variable(df, columns)
    out = long.groupBy("variable").agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd_pop"), F.stddev_samp("value").alias("sd"),
        F.var_samp("value").alias("var"), F.min("value").alias("min"), F.max("value").alias("max"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt"))
    out = out.join(percentiles(long, ["variable"], "value", [0.25, 0.5, 0.75]), "variable", "left").withColumns({"q1": F.col("q")[0], "median": F.col("q")[1], "q3": F.col("q")[2]}).drop("q")
    n = F.col("n")
    return out.withColumns({
        "iqr": F.col("q3") - F.col("q1"), "missing_ratio": F.col("missing") / (n + F.col("missing")),
        "skew_adj": F.when(n > 2, F.col("skew") * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)),
        "kurt_adj": F.when(n > 3, F.try_divide((n - 1) * ((n + 1) * F.col("kurt") + 6), (n - 2) * (n - 3)))})


def index_quartiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles as the sorted element number floor(n q), from 0. Values are counted first, so that one variable isn't sorted in one task
    row by row but value by value."""
    counts = by_variable(df, columns).filter("value is not null").groupBy("variable", "value").count()
    w = Window.partitionBy("variable").orderBy("value")
    placed = counts.withColumns({"upto": F.sum("count").over(w), "n": F.sum("count").over(Window.partitionBy("variable"))})

    def at(q: float) -> Column:
        k = F.floor(F.col("n") * q)
        return F.max(F.when((F.col("upto") > k) & (F.col("upto") - F.col("count") <= k), F.col("value")))

    return placed.groupBy("variable").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value; ties go to the smallest."""
    counts = by_variable(df, columns).filter("value is not null").groupBy("variable", "value").count()
    return counts.groupBy("variable").agg(F.min(F.struct((-F.col("count")).alias("c"), "value")).alias("b")).select("variable", F.col("b.value").alias("mode"), (-F.col("b.c")).alias("n"))


def missing_flags(columns: Sequence[str]) -> Column:
    return F.concat(*(F.col(c).isNull().cast("int").cast("string") for c in columns))


def missing_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    flags = [F.col(c).isNull().cast("int") for c in columns]
    total = sum(flags[1:], flags[0])
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(total).alias("missing"), F.count_if(total == 0).alias("complete_rows"), F.count_if(total > 0).alias("rows_with_missing"), F.max(total).cast("long").alias("most_in_row"),
        *(F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns)).withColumn("missing_pct", 100 * F.col("missing") / (F.col("n_rows") * len(columns)))


def patterns(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    return df.groupBy(missing_flags(columns).alias("pattern")).count().withColumnRenamed("count", "n").orderBy(F.desc("n"), "pattern").limit(top)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(v1, v2, r, n) of each pair over the rows where both are present: one aggregation for all pairs."""
    pairs = list(combinations(columns, 2))
    both = [F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs]
    one = df.agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)), *(F.count_if(x).alias(f"n{i}") for i, x in enumerate(both)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("v1"), F.lit(b).alias("v2"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)))))


def with_totals(df: DataFrame, **aggregates: Column) -> DataFrame:
    """df with whole-table aggregates as columns: one row, broadcast; never a window over everything."""
    return df.crossJoin(F.broadcast(df.agg(*(v.alias(k) for k, v in aggregates.items()))))


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    t = with_totals(df, **{f"lo_{c}": F.min(c) for c in columns}, **{f"hi_{c}": F.max(c) for c in columns})
    return t.withColumns({c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(F.col(c)) for c in columns}).drop(*(f"{p}_{c}" for c in columns for p in ("lo", "hi")))


def standardised(df: DataFrame, columns: Sequence[str], inverse: DataFrame | None = None) -> DataFrame:
    t = with_totals(df, **{f"m_{c}": F.avg(c) for c in columns}, **{f"s_{c}": F.stddev_pop(c) for c in columns})
    return t.withColumns({c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0) for c in columns}).drop(*(f"{p}_{c}" for c in columns for p in ("m", "s")))


def outliers_dropped(df: DataFrame, columns: Sequence[str], z: float = 3.0) -> DataFrame:
    """Column after column: rows within z sample deviations stay; statistics are taken again after each column."""
    for c in columns:
        t = with_totals(df, m_=F.avg(c), s_=F.stddev_samp(c))
        df = t.filter(F.abs(F.col(c) - F.col("m_")) < z * F.col("s_")).drop("m_", "s_")
    return df


def log1p_clipped(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.log1p(F.greatest(F.col(c), F.lit(0.0))))


def clipped(c: str, lo: float | None, hi: float | None) -> Column:
    x = F.col(c)
    out = x if lo is None else F.greatest(x, F.lit(lo))
    return F.when(x.isNotNull(), out if hi is None else F.least(out, F.lit(hi)))


def ranked(df: DataFrame, group: Sequence[str], score: str, higher_is_better: bool, out: str = "rank") -> DataFrame:
    """Average ranks (ties share the mean of their places)."""
    order = F.desc(score) if higher_is_better else F.asc(score)
    return df.withColumn(out, F.rank().over(Window.partitionBy(*group).orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*group, score)) - 1) / 2)
