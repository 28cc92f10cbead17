"""Gaussian processes of several features on large tables, by inducing rows.

A bounded sample of rows (the smallest key hashes) carries the process: all rows enter by two sums, Kmn Knm and Kmn y, which tasks add up block by block, so that nothing grows
with the table but the number of blocks. With as many inducing rows as there are rows the result is the dense process. Lengths, one a feature, and the noise are those
of the highest likelihood of the sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .reports import normal_of

INDUCING, BLOCK = 300, 4096
LENGTHS, NOISES = (0.3, 1.0, 3.0, 10.0, 30.0), (0.01, 0.1, 0.3, 1.0)


@dataclass(frozen=True)
class Process:
    """On standardised features and values: k(a, b) = exp(-sum((a - b)^2 / 2 l^2)), noise variance `noise`."""

    centre: np.ndarray
    scale: np.ndarray
    mean: float
    sd: float
    lengths: np.ndarray
    noise: float
    inducing: np.ndarray
    weights: np.ndarray  # of the mean: k(x, inducing) @ weights
    root: np.ndarray  # k @ (K^-1 - noise S^-1) @ k = |k @ root|^2: what the data take off the variance
    spread: np.ndarray  # weights + spread @ z are draws of the process' weights

    def features(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) / self.scale

    def kernel(self, x: np.ndarray) -> np.ndarray:
        return kernel(self.features(x), self.inducing, self.lengths)

    def predicted(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means and variances (of the process, without noise) in the values' own units."""
        k = self.kernel(x)
        return self.mean + self.sd * (k @ self.weights), self.sd**2 * np.maximum(1 - ((k @ self.root) ** 2).sum(1), 0)


def kernel(a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    a, b = a / lengths, b / lengths
    return np.exp(-0.5 * np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0))


def log_likelihood(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, noise: float) -> float:
    c = np.linalg.cholesky(kernel(x, x, lengths) + (noise + 1e-9) * np.eye(len(x)))
    z = np.linalg.solve(c, y)
    return float(-0.5 * z @ z - np.log(np.diag(c)).sum())


def likeliest(x: np.ndarray, y: np.ndarray, lengths: Sequence[float] = LENGTHS, noises: Sequence[float] = NOISES, rounds: int = 2) -> tuple[np.ndarray, float]:
    """Lengths and noise of a bounded sample, one after the other, over the given values."""
    best, noise = np.ones(x.shape[1]), 0.1
    for _ in range(rounds):
        for j in range(x.shape[1]):
            best[j] = max(lengths, key=lambda v: log_likelihood(x, y, np.r_[best[:j], v, best[j + 1 :]], noise))
        noise = max(noises, key=lambda v: log_likelihood(x, y, best, v))
    return best, noise


def _arrays(pdf, features: Sequence[str]) -> np.ndarray:
    return np.stack([pdf[c].to_numpy(float) for c in features], 1)


def on_a_task(spark: SparkSession, f: Callable, *arguments):
    """f(arguments) on an executor: dense algebra of a bounded size, which shouldn't take the driver's cores (a worker's BLAS has one thread)."""
    import pickle

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            yield pd.DataFrame({"raw": [pickle.dumps(f(*arguments))]})

    return pickle.loads(spark.range(1, numPartitions=1).mapInPandas(run, "raw binary").first()["raw"])


def _algebra(z: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, root and spread of a Process from its sums."""
    m = len(z)
    k = kernel(z, z, lengths) + 1e-9 * np.eye(m)
    s = noise * k + a + 1e-9 * np.eye(m)
    si, ki = np.linalg.inv(s), np.linalg.inv(k)
    values, vectors = np.linalg.eigh((ki - noise * si + (ki - noise * si).T) / 2)
    drawn, axes = np.linalg.eigh((si + si.T) / 2 * noise)
    return si @ b, vectors * np.sqrt(np.maximum(values, 0)), axes * np.sqrt(np.maximum(drawn, 0))


def _common(process: Process, draws: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Drawn weights, and the inverse of the inducing rows' kernel."""
    w = process.weights[:, None] + process.spread @ np.random.default_rng(seed).normal(size=(len(process.weights), draws))
    return w, np.linalg.inv(kernel(process.inducing, process.inducing, process.lengths) + 1e-9 * np.eye(len(w)))


def fitted(df: DataFrame, key: str, features: Sequence[str], y: str, inducing: int = INDUCING, lengths: np.ndarray | None = None, noise: float | None = None) -> Process | None:
    """The process of y over the features, from all rows that have them (None without any). At most `inducing` rows and inducing^2 sums come to the driver."""
    import pandas as pd

    seen = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [y, *features])).select(key, *(F.col(c).cast("double").alias(c) for c in [*features, y]))
    one = seen.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{k}{i}") for i, c in enumerate([*features, y]) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not one["n"]:
        return None
    d = len(features)
    centre, scale = np.array([one[f"m{i}"] for i in range(d)]), np.array([one[f"s{i}"] or 1.0 for i in range(d)])
    mean, sd = one[f"m{d}"], one[f"s{d}"] or 1.0
    sample = seen.orderBy(F.md5(F.col(key).cast("string")), key).limit(inducing).select(*features, y).collect()
    rows = np.array(sample, float).reshape(len(sample), d + 1)
    z, t = (rows[:, :d] - centre) / scale, (rows[:, d] - mean) / sd
    if lengths is None or noise is None:
        lengths, noise = on_a_task(df.sparkSession, likeliest, z, t)
    lengths, m = np.asarray(lengths, float), len(z)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros((m, m)), np.zeros(m)
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                k = kernel((_arrays(part, features) - centre) / scale, z, lengths)
                a += k.T @ k
                b += k.T @ ((part[y].to_numpy(float) - mean) / sd)
        yield pd.DataFrame({"i": range(m), "a": list(a), "b": b})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "a": [np.sum(np.stack(pdf["a"].to_list()), 0)], "b": [pdf["b"].sum()]})

    # a row for each inducing row from each task; those of one inducing row meet
    parts = seen.mapInPandas(sums, "i int, a array<double>, b double").groupBy("i").applyInPandas(added, "i int, a array<double>, b double").collect()
    parts.sort(key=lambda r: r["i"])
    a, b = np.array([r["a"] for r in parts]), np.array([r["b"] for r in parts])
    return Process(centre, scale, mean, sd, lengths, float(noise), z, *on_a_task(df.sparkSession, _algebra, z, a, b, lengths, float(noise)))


def predicted(df: DataFrame, process: Process, features: Sequence[str], out: str = "gp") -> DataFrame:
    """df with <out> and <out>_sd, the process' mean and deviation; null where a feature is. Row by row: nothing is shuffled."""
    import pandas as pd

    ddl = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"`{out}` double", f"`{out}_sd` double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _arrays(pdf, features)
            ok, mean, var = ~np.isnan(x).any(1), np.full(len(x), np.nan), np.full(len(x), np.nan)
            for at in range(0, len(x), BLOCK):
                own = np.flatnonzero(ok[at : at + BLOCK]) + at
                if len(own):
                    mean[own], var[own] = process.predicted(x[own])
            pdf[out], pdf[f"{out}_sd"] = mean, np.sqrt(var)
            yield pdf

    got = df.mapInPandas(run, ddl)
    return got.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in (out, f"{out}_sd")})


def sampled(df: DataFrame, process: Process, key: str, features: Sequence[str], draws: int, seed: int = 0) -> DataFrame:
    """(key, draw, value): draws from the process at each row. The weights of a draw are common to all rows, so that near rows move together; what the inducing rows
    don't tell is added row by row from a hash of key and draw."""
    import pandas as pd

    w, inverse = on_a_task(df.sparkSession, _common, process, draws, seed)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                k = process.kernel(_arrays(part, features))
                rest = process.sd * np.sqrt(np.maximum(1 - ((k @ inverse) * k).sum(1), 0))
                f = process.mean + process.sd * (k @ w)
                yield pd.DataFrame({key: np.repeat(part[key].to_numpy(), draws), "draw": np.tile(np.arange(1, draws + 1), len(part)), "f": f.ravel(), "rest": np.repeat(rest, draws)})

    rows = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in features)).select(key, *(F.col(c).cast("double").alias(c) for c in features))
    return rows.mapInPandas(run, f"`{key}` {kind}, draw int, f double, rest double").select(key, "draw", (F.col("f") + F.col("rest") * normal_of(F.col(key), F.col("draw"))).alias("value"))


def heteroscedastic(df: DataFrame, key: str, features: Sequence[str], y: str, inducing: int = INDUCING, z: float = 1.96) -> DataFrame | None:
    """df with gp, gp_sd, lo and hi: a second process, of the logarithm of squared residuals, gives each row its own noise. (1.27 is what the logarithm of a squared
    normal number lacks on average.) None without rows to learn from."""
    first = fitted(df, key, features, y, inducing)
    if first is None:
        return None
    base = predicted(df, first, features)
    logs = base.withColumn("log__", F.log(F.pow(F.col(y) - F.col("gp"), F.lit(2)) + 1e-12))
    second = fitted(logs, key, features, "log__", inducing)
    both = predicted(base, second, features, "noise__")
    half = z * F.sqrt(F.pow("gp_sd", F.lit(2)) + F.exp(F.col("noise__") + 1.2704))
    return both.withColumns({"lo": F.col("gp") - half, "hi": F.col("gp") + half}).drop("noise__", "noise___sd")
