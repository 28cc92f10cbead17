"""Row numbers and exact order statistics of large groups: nothing sorts or holds a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import kept

#: Ranks of the sketch err by one in so many rows; groups of at most so many rows are counted value by value.
ACCURACY = 100_000


def same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equal in all columns, nulls too."""
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "i") -> DataFrame:
    """df with each row's number, from 1, in its group, as row_number over the group gives it (nulls first; ties in any order).

    Rows are dealt to ranges of (by, order), so that a large group is spread over tasks, and sorted there; the frame is stored, since ranges are
    sampled and a second evaluation could cut elsewhere. How many rows a group has in each range is a small table: a row for each range and group that meet."""
    columns, n = df.columns, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
    cut = kept(cut.withColumns({"range__": F.spark_partition_id(), "at__": F.monotonically_increasing_id()}), "ranges")
    sums = cut.groupBy(*by, "range__").agg(F.count(F.lit(1)).alias("n__"), F.min("at__").alias("first__"))
    before = F.coalesce(F.sum("n__").over(Window.partitionBy(*by).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # stored, so that Spark knows how small it is when it picks the join
    shifts = kept(sums.select(*(F.col(b).alias(f"{b}__") for b in by), F.col("range__").alias("r__"), (before - F.col("first__") + 1).alias("shift__")), "shifts")
    placed = cut.join(shifts, same([*by, "range__"], [*(f"{b}__" for b in by), "r__"]))
    return placed.select(*columns, (F.col("at__") + F.col("shift__")).cast("long").alias(out))


def percentiles(df: DataFrame, by: Sequence[str], value: str, fractions: Sequence[float], out: str = "q") -> DataFrame:
    """(by, out): the exact percentiles of the values of each group, between ranks linearly; nulls don't count.

    A mergeable sketch gives for each wanted rank two values that surely enclose it (a rank of the sketch errs by a row in ACCURACY). A second pass counts rows below
    and, value by value, rows within: at most some 6 rows in 100,000 of a large group, or all of a group of at most ACCURACY rows."""
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v__"))
    margin = 3 / ACCURACY
    ends = [x for p in fractions for x in (max(p - margin, 0.0), min(p + margin, 1.0))]
    sketch = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n__"), F.percentile_approx("v__", F.array(*map(F.lit, ends)), ACCURACY).alias("s__"), F.min("v__").alias("lo__"), F.max("v__").alias("hi__"))
    few = F.col("n__") <= ACCURACY

    def bracket(k: int, p: float) -> Column:
        lo = F.col("lo__") if p <= margin else F.when(few, F.col("lo__")).otherwise(F.col("s__")[2 * k])
        hi = F.col("hi__") if p >= 1 - margin else F.when(few, F.col("hi__")).otherwise(F.col("s__")[2 * k + 1])
        return F.struct(F.lit(k).alias("k"), lo.alias("lo"), hi.alias("hi"), ((F.col("n__") - 1) * F.lit(float(p))).alias("at"))

    brackets = kept(sketch.select(*(F.col(b).alias(f"{b}__") for b in by), F.array(*(bracket(k, p) for k, p in enumerate(fractions))).alias("b__")), "brackets")
    on = same(by, [f"{b}__" for b in by]) if by else F.lit(True)
    # only rows up to a bracket's upper end matter; those below it are counted together, as a null
    each = rows.join(brackets, on).select(*by, "v__", F.explode(F.filter("b__", lambda b: F.col("v__") <= b["hi"])).alias("b"))
    counts = each.groupBy(*by, F.col("b.k").alias("k"), F.col("b.at").alias("at"), F.when(F.col("v__") >= F.col("b.lo"), F.col("v__")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by, "k").orderBy(F.asc_nulls_first("v")))
    placed = counts.withColumn("upto", upto)

    def nth(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col("v")))

    found = placed.groupBy(*by, "k", "at").agg(nth(F.floor("at")).alias("a"), nth(F.ceil("at")).alias("b"))
    value_at = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
    lists = found.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("k", value_at.alias("v")))).alias("l"))
    return lists.select(*by, F.transform("l", lambda x: x["v"]).alias(out))


def medians(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """(by, out): the median of each group."""
    return percentiles(df, by, value, [0.5]).select(*by, F.col("q")[0].alias(out))
