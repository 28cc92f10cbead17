"""Reports over results, jobs, caches, folds and columns: small tables out of large ones, each by one or two aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import percentiles
from .series import AT, BY, ordered
from .stats import by_variable, correlations, missing_flags, with_totals


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """(variable, bin, n): equal-width bins from the least to the largest value, which closes the last; a constant variable is in bin 0."""
    v = by_variable(df, columns).filter("value is not null")
    span = v.groupBy("variable").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    place = F.floor(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")) * bins)
    # one row per variable
    return v.join(F.broadcast(span), "variable").groupBy("variable", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sum, count and sum of squares by variable, and the mean and population deviation that follow: what chunks can add up."""
    n, s, q = F.count("value"), F.sum("value"), F.sum(F.col("value") * F.col("value"))
    return by_variable(df, columns).groupBy("variable").agg(n.alias("n"), s.alias("total"), q.alias("squares"), (s / n).alias("mean"), F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).alias("sd"))


def fold_summary(df: DataFrame, by: Sequence[str], fold: str, metrics: dict[str, Column]) -> DataFrame:
    """Mean and population deviation over folds of metrics that are aggregated within each fold."""
    each = df.groupBy(*by, fold).agg(*(m.alias(k) for k, m in metrics.items()))
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), *(f(k).alias(f"{k}_{name}") for k in metrics for name, f in (("mean", F.avg), ("sd", F.stddev_pop))))


def correlation_summary(df: DataFrame, columns: Sequence[str], strong: float = 0.3) -> DataFrame:
    """One row over all pairs of columns: how many, mean, extremes, how many at least `strong`."""
    r = correlations(df, columns)
    return r.agg(F.count("r").alias("pairs"), F.avg("r").alias("mean"), F.min("r").alias("least"), F.max("r").alias("most"), F.count_if(F.abs("r") >= strong).alias("strong"))


def strong_pairs(df: DataFrame, columns: Sequence[str], least: float) -> DataFrame:
    """Edges (v1, v2, r) of the correlation graph."""
    return correlations(df, columns).filter(F.abs("r") > least).select("v1", "v2", "r")


def storage(entries: DataFrame) -> DataFrame:
    """One row over cache entries (size, hits, misses): number, bytes, hit rate."""
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes"), (F.sum("hits") / (F.sum("hits") + F.sum("misses"))).alias("hit_rate"))


def band(df: DataFrame, by: str, width: str) -> DataFrame:
    """Mean, deviation, extremes and percentiles of a width."""
    out = df.groupBy(by).agg(F.avg(width).alias("mean"), F.stddev_pop(width).alias("sd"), F.min(width).alias("least"), F.max(width).alias("most")).join(percentiles(df, [by], width, [0.25, 0.5, 0.75, 0.95]), by)
    return out.select(by, "mean", "sd", "least", "most", *(F.col("q")[i].alias(k) for i, k in enumerate(("p25", "p50", "p75", "p95"))))


def jobs_by_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"), F.sum("seconds").alias("seconds"), F.max("created").alias("newest"))


def characteristics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: samples, features, missing share, complete rows, distinct missing patterns."""
    cells = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
    whole = F.count_if(~F.coalesce(*(F.when(F.col(c).isNull(), True) for c in columns), F.lit(False)))
    return df.agg(F.count(F.lit(1)).alias("samples"), F.lit(len(columns)).alias("features"), (cells / (F.count(F.lit(1)) * len(columns))).alias("missing_share"), whole.alias("complete"), F.countDistinct(missing_flags(columns)).alias("patterns"))


def all_patterns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(missing_flags(columns).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def pattern_kind(df: DataFrame, columns: Sequence[str], few: int = 10) -> DataFrame:
    """One row: few different patterns count as monotone, more as arbitrary."""
    return df.agg(F.countDistinct(missing_flags(columns)).alias("patterns")).select("patterns", F.when(F.col("patterns") <= few, "monotone").otherwise("arbitrary").alias("kind"))


def series_plot(df: DataFrame, x: str) -> DataFrame:
    return df.groupBy(BY).agg(F.count(x).alias("n"), F.count_if(F.col(x).isNull()).alias("missing"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("least"), F.max(x).alias("most"))


def recent_errors(df: DataFrame, error: str, rows: int = 10) -> DataFrame:
    """Each row with the mean error of the rows before it, at most `rows`: the history that online weights look at."""
    return df.withColumn("recent", F.avg(error).over(ordered().rowsBetween(-rows, -1)))


def online_scores(long: DataFrame, rows: int = 5) -> DataFrame:
    """(series, i, method, score): 1 / (1 + mean loss of the last rows), once there are `rows` of them; 0.5 before."""
    w = Window.partitionBy(BY, "method").orderBy(AT).rowsBetween(-rows, -1)
    return long.withColumn("score", F.when(F.count("loss").over(w) >= rows, 1 / (1 + F.avg("loss").over(w))).otherwise(0.5)).select(BY, AT, "method", "score")


def trend(results: DataFrame, method: str, days: int) -> DataFrame:
    """Results of a method within so many days of its newest one, oldest first."""
    d = with_totals(results.filter(F.col("method") == method), newest=F.max("created"))
    return d.filter(F.col("created") >= F.col("newest") - F.make_dt_interval(F.lit(days))).drop("newest").orderBy("created", "id")


def matching(results: DataFrame, wanted: dict[str, Sequence], most: int) -> DataFrame:
    """The newest results whose columns are in the given lists; an empty list admits all."""
    for c, values in wanted.items():
        results = results.filter(F.col(c).isin(*values)) if values else results
    return results.orderBy(F.desc("created"), "id").limit(most)


def newest_first(df: DataFrame, by: str | None, at: str, key: str, out: str = "place") -> DataFrame:
    """Places by time, newest first, within each group."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), key)).cast("long"))


def columns_lacking(df: DataFrame, required: DataFrame) -> DataFrame:
    """Required columns (name) that the frame doesn't have."""
    have = df.sparkSession.createDataFrame([(c,) for c in df.columns], "name string")
    return required.join(F.broadcast(have), "name", "left_anti")


def masked_or(df: DataFrame, masks: dict[str, Column], out: str = "masked") -> DataFrame:
    """The union of masks: each by itself, and whether any holds."""
    return df.withColumns(masks).withColumn(out, F.array_contains(F.array(*map(F.col, masks)), True))


def categorical_guess(df: DataFrame, columns: Sequence[str], first: int = 100, most: int = 10) -> DataFrame:
    """Per column: distinct values, whether all are whole, and whether it looks like a category (fewer than `most` whole values)."""
    v = by_variable(df, columns).filter("value is not null").groupBy("variable").agg(F.countDistinct("value").alias("distinct"), F.min((F.col("value") == F.floor("value")).cast("int")).alias("whole"), F.count(F.lit(1)).alias("n"))
    return v.select("variable", "distinct", (F.col("whole") == 1).alias("whole"), ((F.col("whole") == 1) & (F.col("distinct") < most) & (F.col("n") > first)).alias("categorical"))


def verdict(df: DataFrame, columns: Sequence[str], error: float = 0.9, warning: float = 0.5) -> DataFrame:
    """One row: the worst level over all columns (all missing is critical), and valid unless it is critical."""
    share = by_variable(df, columns).groupBy("variable").agg(F.avg(F.col("value").isNull().cast("int")).alias("share"))
    level = F.when(F.col("share") >= 1, 3).when(F.col("share") > error, 2).when(F.col("share") > warning, 1).otherwise(0)
    worst = share.agg(F.max(level).alias("worst"), F.count_if(level > 0).alias("issues"))
    return worst.select(F.element_at(F.array(*map(F.lit, ("ok", "warning", "error", "critical"))), F.col("worst") + 1).alias("level"), "issues", (F.col("worst") < 3).alias("valid"))


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: type, rows, missing, range."""
    kinds = dict(df.dtypes)
    kind = F.create_map(*(x for c in columns for x in (F.lit(c), F.lit(kinds[c]))))
    out = by_variable(df, columns).groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.min("value").alias("least"), F.max("value").alias("most"))
    return out.withColumn("kind", kind[F.col("variable")])


def negatives(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return by_variable(df, columns).groupBy("variable").agg(F.count_if(F.col("value") < 0).alias("negative"))


def checked_parameters(df: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """(name, value, ok): parameters against their ranges; one without a rule is fine."""
    lo, hi = (F.create_map(*(x for k, v in rules.items() for x in (F.lit(k), F.lit(float(v[j]))))) for j in (0, 1))
    name = F.col("name")
    return df.select("name", "value", F.coalesce(F.col("value").between(lo[name], hi[name]), F.lit(True)).alias("ok"))


def boxcox(x: Column, lam: float) -> Column:
    return F.when(x > 0, F.log(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / lam)


def boxcox_back(y: Column, lam: float) -> Column:
    return F.exp(y) if lam == 0 else F.pow(lam * y + 1, F.lit(1 / lam))


def quantile_band(df: DataFrame, by: str, y: str, lo: str, hi: str, held: Column, alpha: float) -> DataFrame:
    """Conformalised quantile intervals: scores max(lo - y, y - hi) of the held rows give a margin per group, by which the intervals of the others
    are widened. (group, margin, coverage, width)"""
    from .tests import conformal_quantile

    s = df.withColumns({"score__": F.greatest(F.col(lo) - F.col(y), F.col(y) - F.col(hi)), "held__": held})
    margin = conformal_quantile(s.filter("held__"), by, "score__", alpha).withColumnRenamed("q", "margin")
    rest = s.filter("not held__").join(F.broadcast(margin), by)  # one row per group
    low, high = F.col(lo) - F.col("margin"), F.col(hi) + F.col("margin")
    return rest.groupBy(by).agg(F.first("margin").alias("margin"), F.avg(F.col(y).between(low, high).cast("int")).alias("coverage"), F.avg(high - low).alias("width"))


def cv_plus(df: DataFrame, by: str, y: str, fold: str, alpha: float) -> DataFrame:
    """(group, lo, hi): the CV+ interval of a group's mean. The mean of the other folds predicts a fold's rows; the interval reaches from the low quantile
    of prediction less residual to the high quantile of prediction plus residual. Rows without y don't count; a group with one fold has no interval."""
    from .tests import conformal_quantile

    seen = df.filter(F.col(y).isNotNull())
    w = Window.partitionBy(by)
    sums = seen.groupBy(by, fold).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    mean = F.try_divide(F.sum("s").over(w) - F.col("s"), F.sum("n").over(w) - F.col("n"))
    d = seen.join(sums.select(by, fold, mean.alias("mean__")), [by, fold])
    e = F.abs(F.col(y) - F.col("mean__"))
    d = d.select(by, (F.col("mean__") + e).alias("up"), (e - F.col("mean__")).alias("down"))
    hi, lo = (conformal_quantile(d, by, c, alpha) for c in ("up", "down"))
    return lo.select(by, (-F.col("q")).alias("lo")).join(hi.select(by, F.col("q").alias("hi")), by)


def normal_of(*keys: Column) -> Column:
    """A standard normal number that depends on the keys alone (two 48-bit parts of their hash, as uniforms), so that a task that runs again gives the same, and
    numbers of different keys are independent."""
    h = F.md5(F.concat_ws("|", *(k.cast("string") for k in keys)))
    u, v = ((F.conv(F.substring(h, p, 12), 16, 10).cast("double") + 0.5) / 2.0**48 for p in (1, 13))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def draws(df: DataFrame, by: str, x: str, id_: str, m: int) -> DataFrame:
    """The rows m times (draw 1 to m), with `value`: x, or where it is missing a draw from the predictive distribution of its group under a normal model. Each group
    and draw has its own variance (its posterior is a scaled inverse chi-square, by the cube-root approximation) and mean (normal about the observed mean);
    a row then adds its own noise. Groups with fewer than two observed rows have no draws where x is missing."""
    n, nu = F.col("n__"), F.col("n__") - 1
    stats = df.groupBy(by).agg(F.count(x).alias("n__"), F.avg(x).alias("m__"), F.var_samp(x).alias("v__")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(m))))
    chi = nu * F.pow(1 - 2 / (9 * nu) + normal_of(F.lit("variance"), F.col(by), F.col("draw")) * F.sqrt(2 / (9 * nu)), F.lit(3))
    own = stats.filter("n__ > 1").withColumn("s__", F.sqrt(nu * F.col("v__") / chi)).withColumn("mu__", F.col("m__") + F.col("s__") / F.sqrt(n) * normal_of(F.lit("mean"), F.col(by), F.col("draw")))
    # m rows a group
    rows = df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(m)))).join(own.select(by, "draw", "mu__", "s__"), [by, "draw"], "left")
    value = F.coalesce(F.col(x), F.col("mu__") + F.col("s__") * normal_of(F.lit("row"), F.col(id_), F.col("draw")))
    return rows.withColumn("value", value).drop("mu__", "s__")


def correlation_error(df: DataFrame, pairs: Sequence[tuple[str, str]], truth: str, filled: str) -> DataFrame:
    """One row: mean absolute and root mean square difference of the correlations between variables before and after a fill. Columns are
    named variable_truth and variable_filled."""
    one = df.agg(*(F.corr(f"{a}_{s}", f"{b}_{s}").alias(f"{a}{b}{s}") for a, b in pairs for s in (truth, filled)))
    d = [F.col(f"{a}{b}{filled}") - F.col(f"{a}{b}{truth}") for a, b in pairs]
    return one.select((sum((F.abs(x) for x in d), F.lit(0.0)) / len(d)).alias("mae"), F.sqrt(sum((x * x for x in d), F.lit(0.0)) / len(d)).alias("rmse"))


def by_chunk(df: DataFrame, processor, schema: str, combiner) -> DataFrame:
    """A user's processor(pandas frame) -> pandas frame over batches of rows, and a combiner(DataFrame) -> DataFrame of what they give."""
    return combiner(df.mapInPandas(lambda parts: map(processor, parts), schema))
