"""Fills from nearest rows over several variables: distances know about missing values, donors are a bounded sample that merges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a reference, at most; tasks get it with their code. Rows that a task compares with it at a time.
REFERENCE, BATCH = 512, 2048


def reference(rows: DataFrame, key: str, columns: Sequence[str], size: int = REFERENCE) -> DataFrame:
    """(pos, key, columns): the rows without a gap whose keys have the smallest hashes, at most `size`. A sketch that merges: the reference of two parts is the reference of their
    references, whatever the order, so that a stream may keep it as state. Rows without a key don't count; of rows of one key the smallest counts.

    The first rows by hash hold the reference unless keys repeat so much that there are fewer keys among them: only then all keys are grouped."""
    from ..sources.files import kept

    whole = rows.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [key, *columns])).select(key, *(F.col(c).cast("double").alias(c) for c in columns))
    ranked = whole.withColumn("pos", F.md5(F.col(key).cast("string")))
    first = kept(ranked.orderBy("pos", key, *columns).limit(2 * size), "reference")
    seen = first.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("keys")).first()
    some = first if seen["keys"] >= size or seen["n"] < 2 * size else ranked
    once = some.groupBy("pos", key).agg(F.min(F.struct(*columns)).alias("r__")).select("pos", key, "r__.*")
    return once.orderBy("pos", key).limit(size).select("pos", key, *columns)


def knn_filled(rows: DataFrame, donors: DataFrame, columns: Sequence[str], k: int = 5, standardise: bool = True) -> DataFrame:
    """rows with <column>_filled: a gap takes the mean of the column over its k nearest donors, weighted by 1 / distance (donors at no distance, if there are any, count
    alone). The distance is Euclidean over the variables that the row has, scaled up by all / shared; with `standardise`, in deviations of the donors. A row without any
    value takes the donors' mean; without donors gaps stay. donors: as `reference` gives them (at most REFERENCE rows, which go to the tasks); nothing is shuffled."""
    import numpy as np
    import pandas as pd

    ref = donors.orderBy("pos").select("pos", *columns).limit(REFERENCE).collect()
    d = np.array([[r[c] for c in columns] for r in ref], float).reshape(len(ref), len(columns))
    mean = d.mean(0) if len(d) else np.full(len(columns), np.nan)
    by = np.where(d.std(0) > 0, d.std(0), 1.0) if standardise and len(d) else np.ones(len(columns))

    def fill(x: np.ndarray) -> np.ndarray:
        has = ~np.isnan(x)
        shared, out = has.sum(1), np.where(has, x, mean)
        rows = np.flatnonzero((shared > 0) & (shared < len(columns))) if len(d) else np.empty(0, int)
        total = np.zeros((len(rows), len(d)))
        for j in range(len(columns)):
            total += np.where(has[rows, j, None], ((x[rows, j, None] - d[:, j]) / by[j]) ** 2, 0.0)
        far = np.round(np.sqrt(total * len(columns) / shared[rows, None]), 9)
        # a stable sort: ties go to the donor that comes first
        near = np.argsort(far, axis=1, kind="stable")[:, :k]
        far = np.take_along_axis(far, near, 1)
        exact = far[:, :1] == 0
        w = np.where(exact, far == 0, 1 / np.where(far > 0, far, 1.0))
        guess = (w[:, :, None] * d[near]).sum(1) / w.sum(1)[:, None]
        out[rows] = np.where(has[rows], x[rows], guess)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [fill(np.stack([pdf[c].to_numpy(float) for c in columns], 1)[at : at + BATCH]) for at in range(0, len(pdf), BATCH)]
            filled = np.concatenate(out) if out else np.empty((0, len(columns)))
            yield pdf.assign(**{f"{c}_filled": filled[:, j] for j, c in enumerate(columns)})

    got = rows.mapInPandas(run, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), *(f"`{c}_filled` double" for c in columns)]))
    return got.withColumns({f"{c}_filled": F.when(~F.isnan(f"{c}_filled"), F.col(f"{c}_filled")) for c in columns})
