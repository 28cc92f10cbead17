"""Fills that need dense algebra: splines, polynomials, Gaussian process, kernel ridge go block by block, each block with a halo of its neighbours'
rows, so that a group's size is bounded whatever a series' length. Fourier and online weights see a whole series as one pandas group."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import kept
from .series import AT, BY, observed_before

FILLED = "series string, i long, filled double"


def in_blocks(rows: DataFrame, place: str, size: int, halo: int, solve: Callable) -> DataFrame:
    """(series, i, filled): rows (series, i, x, a place, more columns of the series) in blocks of `size` places; a block also sees the observed rows up to
    `halo` places beyond it. solve(rows, values, observed mask, wanted mask, frame) -> values of the wanted rows, which are the block's gaps."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        i, v, own = pdf["i"].to_numpy(float), pdf["x"].to_numpy(float), (pdf["home"] == pdf["block"]).to_numpy()
        seen = ~np.isnan(v)
        want, out = own & ~seen, v.copy()
        if want.any() and seen.any():
            out[want] = solve(i, v, seen, want, pdf)
        return pd.DataFrame({"series": pdf["series"], "i": pdf["i"], "filled": out})[own]

    at = F.col(place)
    reach = F.when(F.col("x").isNull(), F.array("home")).otherwise(F.sequence(F.floor((at - halo) / size), F.floor((at + halo) / size)))
    return spread(rows.withColumn("home", F.floor(at / size)).withColumn("block", F.explode(reach))).groupBy("series", "block").applyInPandas(run, FILLED)


def spread(blocks: DataFrame) -> DataFrame:
    """The blocks over as many tasks as the session shuffles into: few bytes, much algebra, so partitions shouldn't be merged by their bytes."""
    return blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "series", "block")


def base(df: DataFrame, x: str) -> DataFrame:
    v = F.col(x).cast("double")
    return df.select(F.col(BY).alias("series"), F.col(AT).alias("i"), F.when(~F.isnan(v), v).alias("x"))


def with_moments(rows: DataFrame) -> DataFrame:
    """The rows with mean and population deviation (1 where it is 0) of their series."""
    m = rows.groupBy(F.col("series").alias("s__")).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    m = m.withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))
    return rows.join(m, F.col("series").eqNullSafe(F.col("s__"))).drop("s__")


def basis(knots, order: int, at):
    """B-splines of the order over the knots (one column each) at the places `at`, by the recurrence over orders."""
    import numpy as np

    span = np.clip(np.searchsorted(knots, at, side="right") - 1, order, len(knots) - order - 2)
    b = np.zeros((len(at), len(knots) - 1))
    b[np.arange(len(at)), span] = 1.0
    for d in range(1, order + 1):
        width = knots[d:] - knots[:-d]
        share = np.divide(1.0, width, out=np.zeros_like(width), where=width > 0)
        up = (at[:, None] - knots[: -d - 1]) * share[:-1]
        down = (knots[d + 1 :] - at[:, None]) * share[1:]
        b = up * b[:, :-1] + down * b[:, 1:]
    return b


def interpolating(k, y, at, order: int = 3):
    """The interpolating spline of the order through (k, y) at the places `at`, NaN beyond the ends. Inner knots are data places for odd orders and midpoints for
    even ones, so that the ends are not-a-knot; with no more points than the order it is linear."""
    import numpy as np

    if len(k) <= order:
        return np.interp(at, k, y, left=np.nan, right=np.nan)
    half = (order + 1) // 2
    inner = k[half:-half] if order % 2 else ((k[1:] + k[:-1]) / 2)[order // 2 : -(order // 2)]
    knots = np.concatenate([np.full(order + 1, k[0]), inner, np.full(order + 1, k[-1])])
    out = basis(knots, order, at) @ np.linalg.solve(basis(knots, order, k), y)
    return np.where((at < k[0]) | (at > k[-1]), np.nan, out)


def spline(df: DataFrame, x: str, order: int = 3, size: int = 128, halo: int = 48) -> DataFrame:
    """Interpolating splines of order 1 to 5. Blocks are of `size` observed rows and see `halo` more on either side: a value's weight falls by more
    than half from row to row even at order 5, so the result is that of the whole series to rounding. Rows before the first or after the last observed stay null."""
    if not 1 <= order <= 5:
        raise ValueError("order must be from 1 to 5")

    def solve(i, v, seen, want, _):
        return interpolating(i[seen], v[seen], i[want], order)

    rows = observed_before(base(df, x), "x", "k").withColumn("k", F.greatest(F.col("k") - 1, F.lit(0)))
    return in_blocks(rows, "k", size, halo, solve)


def polynomial(df: DataFrame, x: str, order: int = 2, radius: int = 12, size: int = 4096) -> DataFrame:
    """Least-squares polynomial through the observed rows within the radius of each gap; null where there are no more of them than the order."""

    def solve(i, v, seen, want, _):
        import numpy as np

        first = int(i[0]) - radius
        grid = np.full(int(i[-1]) - first + radius + 1, np.nan)
        grid[i.astype(int) - first] = v
        near = np.lib.stride_tricks.sliding_window_view(grid, 2 * radius + 1)[i[want].astype(int) - first - radius]
        ok = ~np.isnan(near)
        powers = (np.arange(-radius, radius + 1) / radius)[:, None] ** np.arange(order + 1)
        enough, out = ok.sum(axis=1) > order, np.full(len(near), np.nan)
        left = np.einsum("gw,wp,wq->gpq", ok[enough].astype(float), powers, powers)
        right = np.where(ok, near, 0.0)[enough] @ powers
        out[enough] = np.linalg.solve(left, right[:, :, None])[:, 0, 0]
        return out

    return in_blocks(base(df, x), "i", size, radius, solve)


def gaussian_process(df: DataFrame, x: str, lengths: Sequence[float] = (2.0, 5.0, 12.0, 24.0), noise: float = 0.1, block: int = 200) -> DataFrame:
    """RBF and white noise on row numbers, values scaled by their series. A series' length is the one with the largest marginal likelihood, summed over blocks; then
    each block's gaps are the conditional means given the observed rows of the block and of four lengths on either side. Where none is that near, this is the
    series' mean."""
    import numpy as np
    import pandas as pd

    def covariance(i, ell):
        return np.exp(-0.5 * ((i[:, None] - i) / ell) ** 2) + noise * np.eye(len(i))

    def likelihood(pdf: pd.DataFrame) -> pd.DataFrame:
        i, z = pdf["i"].to_numpy(float), ((pdf["x"] - pdf["mean"]) / pdf["sd"]).to_numpy(float)
        found = []
        for ell in lengths:
            c = np.linalg.cholesky(covariance(i, ell))
            w = np.linalg.solve(c, z)
            found.append(-0.5 * (w @ w) - np.log(np.diag(c)).sum())
        return pd.DataFrame({"series": pdf["series"].iloc[0], "length": lengths, "like": found})

    def solve(i, v, seen, want, pdf):
        mean, sd, ell = (pdf[c].iloc[0] for c in ("mean", "sd", "length"))
        w = np.linalg.solve(covariance(i[seen], ell), (v[seen] - mean) / sd)
        return mean + sd * np.exp(-0.5 * ((i[want][:, None] - i[seen]) / ell) ** 2) @ w

    rows = with_moments(base(df, x))
    each = spread(rows.filter("x is not null").withColumn("block", F.floor(F.col("i") / block))).groupBy("series", "block").applyInPandas(likelihood, "series string, length double, like double")
    each = each.groupBy("series", "length").agg(F.sum("like").alias("like"))
    best = each.groupBy(F.col("series").alias("s__")).agg(F.max_by("length", F.struct("like", "length")).alias("length"))
    rows = rows.join(best, F.col("series").eqNullSafe(F.col("s__")), "left").drop("s__")
    out = in_blocks(rows, "i", block, int(4 * max(lengths)), solve)
    return or_mean(out, rows)


def or_mean(filled: DataFrame, rows: DataFrame) -> DataFrame:
    """What a process says far from all data: the mean of its series."""
    m = rows.groupBy(F.col("series").alias("s__")).agg(F.avg("x").alias("mean"))
    return filled.join(m, F.col("series").eqNullSafe(F.col("s__"))).select("series", "i", F.coalesce("filled", "mean").alias("filled"))


def kernel_ridge(df: DataFrame, x: str, length: float = 12.0, ridge: float = 0.1, size: int = 200) -> DataFrame:
    """Ridge regression with a Laplacian kernel on row numbers around the series' mean, by blocks that see ten lengths on either side; the mean where
    nothing observed is that near."""
    import numpy as np

    def solve(i, v, seen, want, pdf):
        mean, a = pdf["mean"].iloc[0], i[seen]
        w = np.linalg.solve(np.exp(-np.abs(a[:, None] - a) / length) + ridge * np.eye(len(a)), v[seen] - mean)
        return mean + np.exp(-np.abs(i[want][:, None] - a) / length) @ w

    rows = with_moments(base(df, x))
    return or_mean(in_blocks(rows, "i", size, int(10 * length), solve), rows)


def online_weights(wide: DataFrame, truth: str, methods: list[str], rate: float = 1e-4) -> DataFrame:
    """(series, i, estimate): online gradient descent on the simplex; the estimate uses only rows before."""
    import pandas as pd

    from .ensemble import on_simplex

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("i")
        z, y = pdf[methods].to_numpy(float), pdf[truth].to_numpy(float)
        w, out = np.full(len(methods), 1 / len(methods)), []
        for row, target in zip(z, y, strict=True):
            out.append(row @ w)
            w = on_simplex(w - rate * 2 * (row @ w - target) * row)
        return pd.DataFrame({"series": pdf["series"], "i": pdf["i"], "estimate": out})

    return wide.select(BY, AT, truth, *methods).groupBy(BY).applyInPandas(run, "series string, i long, estimate double")


def forest(df: DataFrame, key: str, columns: list[str], rounds: int = 2, trees: int = 10, seed: int = 42) -> DataFrame:
    """Chained random forests (MLlib): means first, then each column from the others, round by round. Trees see their features in bins, so they are grown from
    the cells of these bins: all rows are bagged into cells in one pass for all trees and levels. Columns without any value stay null."""
    rows = kept(df.select(key, *(F.when(~F.isnan(v), v).alias(c) for c in columns for v in [F.col(c).cast("double")])), "forest")
    means = rows.agg(*(F.avg(c).alias(c) for c in columns)).first()
    known = [c for c in columns if means[c] is not None]
    names = [key, *columns, *(f"{c}__f" for c in columns)]
    d = rows.select("*", *(F.coalesce(F.col(c), F.lit(means[c]).cast("double")).alias(f"{c}__f") for c in columns))
    if len(known) > 1:
        at, left = cuts(d, [f"{c}__f" for c in known[1:]]), [c for _ in range(rounds) for c in known]
        while left:
            c = left.pop(0)
            binned, bins = in_bins(d, {o: at[o] for o in (f"{o}__f" for o in known if o != c)})
            cells = kept(bagged(binned, [key, *columns], c, bins, trees, seed), "cells")
            guesses = kept(grown(cells, bins, trees, seed), "guesses")
            d = binned.join(guesses, bins, "left").withColumn(f"{c}__f", F.coalesce(F.col(c), F.col("guess__"))).select(*names)
            if left and len(left) % len(known) == 0:
                # each round is stored, so that plans don't grow with the rounds
                d = kept(d, "forest")
            if left:
                at |= cuts(d, [f"{c}__f"])
    return d.select(key, *(F.col(f"{c}__f").alias(c) for c in columns))


def cuts(d: DataFrame, columns: list[str], bins: int = 32) -> dict[str, list[float]]:
    """Where each column is cut into at most so many bins: between all its values where these are as few, else at its quantiles."""
    ranks = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    one = d.agg(*(F.percentile_approx(c, ranks).alias(c) for c in columns), *(F.approx_count_distinct(c).alias(f"{c}__n") for c in columns)).first()
    few = [c for c in columns if one[f"{c}__n"] <= 2 * bins]
    values = d.agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in few)).first().asDict() if few else {}
    between = {c: [(a + b) / 2 for a, b in zip(v, v[1:])] for c, v in values.items() if 1 < len(v) <= bins}
    return {c: sorted(set(between.get(c, one[c])) - {-math.inf, math.inf}) or [0.0] for c in columns}


def in_bins(d: DataFrame, at: dict[str, list[float]]) -> tuple[DataFrame, list[str]]:
    """d with the number of each column's bin, and the names of these."""
    from pyspark.ml.feature import Bucketizer

    bins = [f"{c}_bin__" for c in at]
    binned = Bucketizer(splitsArray=[[-math.inf, *a, math.inf] for a in at.values()], inputCols=list(at), outputCols=bins).transform(d)
    return binned.withColumns({b: F.col(b).cast("int") for b in bins}), bins


def bagged(d: DataFrame, row: list[str], y: str, bins: list[str], trees: int, seed: int) -> DataFrame:
    """(bins, tree, w, y): per cell of the bins and tree the weight and the mean y of the tree's bag. A row with y is in a bag as often as a Poisson number of mean 1
    says, which a hash of its columns `row` gives: the same on any partitions. Rows without y only leave their cell, as tree -1, since they need its guess."""
    d = d.select(*bins, F.col(y).alias("y__"), F.xxhash64(F.lit(seed), *row).alias("row__"))
    of = F.when(F.col("y__").isNotNull(), F.array(*map(F.lit, range(trees)))).otherwise(F.array(F.lit(-1)))
    d = d.select(*bins, "y__", "row__", F.explode(of).alias("tree")).withColumn("n", F.when(F.col("tree") < 0, 1.0).otherwise(poisson(F.xxhash64("row__", "tree"))))
    cells = d.filter("n > 0").groupBy(*bins, "tree").agg(F.sum("n").alias("w"), F.sum(F.col("n") * F.col("y__")).alias("y"))
    return cells.withColumn("y", F.col("y") / F.col("w"))


def poisson(bits: Column) -> Column:
    """A Poisson number of mean 1 from 64 random bits (12 at most: one in 10**10 is larger)."""
    below = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(12)]
    out = F.lit(12.0)
    for k in reversed(range(12)):
        out = F.when(bits < int(below[k] * 2.0**64) - 2**63, float(k)).otherwise(out)
    return out


def grown(cells: DataFrame, bins: list[str], trees: int, seed: int) -> DataFrame:
    """(bins, guess__): the mean of the trees (a tree that drew no row has no say) in cells that have rows to fill. Variance within a cell lies on the same side of any
    split, so weights and means of the cells grow the trees of their rows."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    cells = VectorAssembler(inputCols=bins, outputCol="features__").transform(cells)

    def tree(t: int):
        of = RandomForestRegressor(featuresCol="features__", labelCol="y", weightCol="w", predictionCol=f"guess{t}", numTrees=1, bootstrap=False,
                                   featureSubsetStrategy="onethird" if trees > 1 else "all", maxDepth=6, seed=seed + t)
        return of.fit(cells.filter(F.col("tree") == t))

    drawn = sorted(r.tree for r in cells.filter("tree >= 0").select("tree").distinct().collect())
    with ThreadPool(8) as pool:
        models = pool.map(inheritable_thread_target(cells.sparkSession)(tree), drawn)
    out = cells.filter("tree < 0")
    for m in models:
        out = m.transform(out)
    guess = sum((F.col(f"guess{t}") for t in drawn), F.lit(0.0)) / len(drawn) if drawn else F.lit(None).cast("double")
    return out.select(*bins, guess.alias("guess__"))
