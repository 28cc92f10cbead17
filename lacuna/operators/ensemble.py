"""Combining several fills: weights, aggregation, uncertainty, decomposition, low rank, Gaussian conditional means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import AT, BY


def combined(long: DataFrame, weights: dict[str, float] | None = None, trim: float = 0.1) -> DataFrame:
    """(series, i): weighted mean, median, trimmed mean, deviation, percentile interval over methods (method, value)."""
    w = F.create_map(*(y for k, v in (weights or {}).items() for y in (F.lit(k), F.lit(float(v)))))[F.col("method")] if weights else F.lit(1.0)
    k = Window.partitionBy(BY, AT)
    d = long.filter("value is not null").withColumns({"w": w, "r": F.row_number().over(k.orderBy("value", "method")), "m": F.count(F.lit(1)).over(k)})
    cut = F.floor(F.col("m") * trim)
    kept = (F.col("r") > cut) & (F.col("r") <= F.col("m") - cut)
    return d.groupBy(BY, AT).agg(
        (F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("weighted"), F.median("value").alias("median"), F.avg(F.when(kept, F.col("value"))).alias("trimmed"), F.stddev_pop("value").alias("spread"),
        F.percentile("value", F.lit(0.025)).alias("lo"), F.percentile("value", F.lit(0.975)).alias("hi"), (1 - F.stddev_pop("value") / (F.abs(F.avg("value")) + 1e-10)).alias("agreement"))


def bic_weights(wide: DataFrame, truth: str, methods: Sequence[str], parameters: int = 10) -> DataFrame:
    """(method, weight): softmax of -BIC / 2 from the residual variance."""
    n = F.count(F.lit(1))
    one = wide.agg(*((n * F.log(F.var_pop(F.col(truth) - F.col(m))) + parameters * F.log(n)).alias(m) for m in methods))
    t = one.unpivot([], list(methods), "method", "bic")
    low = t.agg(F.min("bic").alias("low"))
    t = t.crossJoin(F.broadcast(low)).withColumn("e", F.exp(-(F.col("bic") - F.col("low")) / 2))
    return t.withColumn("weight", F.col("e") / F.sum("e").over(Window.partitionBy(F.lit(0)))).select("method", "bic", "weight")


def exponential_weights(long: DataFrame, eta: float = 0.01) -> DataFrame:
    """(series, i, method, weight): weights from the losses of all rows before; the product of updates is an exponential of a running sum."""
    past = F.coalesce(F.sum("loss").over(Window.partitionBy(BY, "method").orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    d = long.withColumn("past", past)
    k = Window.partitionBy(BY, AT)
    d = d.withColumn("e", F.exp(-eta * (F.col("past") - F.min("past").over(k))))
    return d.withColumn("weight", F.col("e") / F.sum("e").over(k)).select(BY, AT, "method", "weight")


def decomposition(wide: DataFrame, truth: str, methods: Sequence[str]) -> DataFrame:
    """One row: squared bias, mean variance and mean covariance of the methods' errors, diversity (mean variance around the ensemble)."""
    from itertools import combinations

    mean = sum(F.col(m) for m in methods) / len(methods)
    k = len(methods)
    pairs = list(combinations(methods, 2))
    return wide.agg(
        F.pow(F.avg(mean - F.col(truth)), F.lit(2)).alias("bias2"), (sum((F.var_pop(m) for m in methods), F.lit(0.0)) / k).alias("variance"),
        (sum((F.covar_pop(a, b) for a, b in pairs), F.lit(0.0)) / len(pairs)).alias("covariance"), F.avg(sum(F.pow(F.col(m) - mean, F.lit(2)) for m in methods) / k).alias("diversity"),
        F.avg(F.pow(mean - F.col(truth), F.lit(2))).alias("mse"))


def contributions(wide: DataFrame, truth: str, methods: Sequence[str]) -> DataFrame:
    """(method, gain): how much the ensemble's error grows without the method."""
    mse = lambda ms: F.avg(F.pow(sum(F.col(m) for m in ms) / len(ms) - F.col(truth), F.lit(2)))
    one = wide.agg(mse(methods).alias("all_"), *(mse([m for m in methods if m != x]).alias(x) for x in methods))
    return one.unpivot(["all_"], list(methods), "method", "without").select("method", (F.col("without") - F.col("all_")).alias("gain"))


def super_learner(wide: DataFrame, truth: str, methods: Sequence[str], ridge: float = 1e-3) -> dict[str, float]:
    """Simplex weights that minimise squared error: Gram sums by one aggregation, projected gradient on the driver (a few numbers)."""
    import numpy as np

    k = len(methods)
    one = wide.agg(*(F.avg(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(methods) for j, b in enumerate(methods)), *(F.avg(F.col(a) * F.col(truth)).alias(f"c{i}") for i, a in enumerate(methods))).first()
    g = np.array([[one[f"g{i}_{j}"] for j in range(k)] for i in range(k)]) + ridge * np.eye(k)
    c = np.array([one[f"c{i}"] for i in range(k)])
    w, step = np.full(k, 1 / k), 1 / np.linalg.eigvalsh(g)[-1]
    for _ in range(2000):
        w = on_simplex(w - step * (g @ w - c))
    return dict(zip(methods, w.tolist(), strict=True))


def on_simplex(v):
    import numpy as np

    u = np.sort(v)[::-1]
    css = np.cumsum(u) - 1
    rho = np.nonzero(u - css / np.arange(1, len(v) + 1) > 0)[0][-1]
    return np.maximum(v - css[rho] / (rho + 1), 0)


def low_rank(df: DataFrame, key: str, columns: Sequence[str], rank: int = 2, shrink: float = 0.1, steps: int = 10, tol: float = 1e-4) -> DataFrame:
    """Iterated low-rank fill: each step aggregates the Gram matrix of the filled frame (columns are few), takes its
    eigenvectors on the driver and projects rows by expressions. All steps read the input anew with one projection matrix
    each, so that lineage doesn't grow: a row's fixed point is iterated inside its own expression."""
    import numpy as np

    base = df.select(key, *columns)
    mean = base.agg(*(F.avg(c).alias(c) for c in columns)).first()
    mu = np.array([mean[c] for c in columns], float)
    q = np.zeros((len(columns), len(columns)))
    for _ in range(steps):
        f = projected(base, columns, mu, q)
        one = f.agg(*(F.sum((F.col(a) - float(mu[i])) * (F.col(b) - float(mu[j]))).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i)).first()
        g = np.array([[one[f"{min(i, j)}_{max(i, j)}"] for j in range(len(columns))] for i in range(len(columns))], float)
        values, vectors = np.linalg.eigh(g)
        s = np.sqrt(np.maximum(values[::-1][:rank], 0))
        v = vectors[:, ::-1][:, :rank]
        new = (v * (s / (s * (1 + shrink) + 1e-12))) @ v.T
        if np.abs(new - q).max() < tol:
            q = new
            break
        q = new
    return projected(base, columns, mu, q)


def projected(df: DataFrame, columns: Sequence[str], mu, q, rounds: int = 10) -> DataFrame:
    """Missing cells from the centred row times q, `rounds` times: first with missing cells at their means, then with the answer before."""
    for _ in range(rounds):
        centred = [F.coalesce(F.col(f"{c}__f") if f"{c}__f" in df.columns else F.col(c), F.lit(float(mu[i]))) - float(mu[i]) for i, c in enumerate(columns)]
        df = df.withColumns({f"{c}__f": F.coalesce(F.col(c), float(mu[j]) + sum(centred[i] * float(q[i, j]) for i in range(len(columns)))) for j, c in enumerate(columns)})
    return df.select(*(c for c in df.columns if c not in columns and not c.endswith("__f")), *(F.col(f"{c}__f").alias(c) for c in columns))


def gaussian_conditional(df: DataFrame, key: str, columns: Sequence[str], steps: int = 5) -> DataFrame:
    """EM for a multivariate normal, then conditional means: the sums per missing pattern are aggregated, the small algebra runs on the driver and the
    regression of each pattern comes back as expressions. At most 2 ** len(columns) patterns."""
    import numpy as np

    pattern = F.concat(*(F.col(c).isNull().cast("int").cast("string") for c in columns))
    base = df.select(key, *columns, pattern.alias("p__"))
    k = len(columns)
    one = base.agg(*(F.avg(c).alias(c) for c in columns), *(F.var_pop(c).alias(f"v_{c}") for c in columns)).first()
    mu, cov = np.array([one[c] for c in columns], float), np.diag([one[f"v_{c}"] for c in columns]).astype(float)
    sums = base.groupBy("p__").agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(columns)), *(F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)).alias(f"q{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i)).collect()
    for _ in range(steps):
        n, first, second = 0, np.zeros(k), np.zeros((k, k))
        for r in sums:
            o, m = [i for i in range(k) if r["p__"][i] == "0"], [i for i in range(k) if r["p__"][i] == "1"]
            b, c = regression(mu, cov, o, m)
            so = np.array([r[f"s{i}"] for i in o])
            qo = np.array([[r[f"q{min(i, j)}_{max(i, j)}"] for j in o] for i in o]).reshape(len(o), len(o))
            a = mu[m] - b @ mu[o]
            n += r["n"]
            first[o] += so
            first[m] += r["n"] * a + b @ so
            second[np.ix_(o, o)] += qo
            cross = np.outer(a, so) + b @ qo
            second[np.ix_(m, o)] += cross
            second[np.ix_(o, m)] += cross.T
            second[np.ix_(m, m)] += r["n"] * (np.outer(a, a) + c) + np.outer(a, b @ so) + np.outer(b @ so, a) + b @ qo @ b.T
        mu = first / n
        cov = second / n - np.outer(mu, mu)
    out = {}
    for j, c in enumerate(columns):
        e = F.col(c)
        for r in sums:
            if r["p__"][j] == "1":
                o, m = [i for i in range(k) if r["p__"][i] == "0"], [i for i in range(k) if r["p__"][i] == "1"]
                b, _ = regression(mu, cov, o, m)
                row = b[m.index(j)]
                e = F.when(F.col("p__") == r["p__"], float(mu[j]) + sum(((F.col(columns[i]) - float(mu[i])) * float(row[t]) for t, i in enumerate(o)), F.lit(0.0))).otherwise(e)
        out[c] = e
    return base.select(key, *(e.alias(c) for c, e in out.items()))


def regression(mu, cov, o: list[int], m: list[int]):
    import numpy as np

    if not o:
        return np.zeros((len(m), 0)), cov[np.ix_(m, m)]
    b = np.linalg.lstsq(cov[np.ix_(o, o)], cov[np.ix_(o, m)], rcond=None)[0].T if m else np.zeros((0, len(o)))
    return b, cov[np.ix_(m, m)] - b @ cov[np.ix_(o, m)]
