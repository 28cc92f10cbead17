"""How far an ensemble's error on new rows may be from its error on these: Rademacher complexity and the bound that it gives."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A hash has so many hexadecimal digits; each gives a sign.
DIGITS = 32


def sign(hashed: Column, digit: int) -> Column:
    """1 or -1 from a digit of a row's hash: the same for a row whenever it is asked for, as good as independent between rows and digits."""
    return F.when(F.substring(hashed, digit + 1, 1) >= "8", 1.0).otherwise(-1.0)


def rademacher(df: DataFrame, key: str, members: Sequence[str], blocks: int = 1) -> DataFrame:
    """One row (n, complexity): the mean over 32 x blocks draws of signs of the largest |mean of sign times prediction| among the members. Rows without a
    prediction of some member don't count. One pass: each draw and member is a sum."""
    seen = df.filter(" AND ".join(f"`{m}` IS NOT NULL" for m in members))
    hashes = [f"h{b}__" for b in range(blocks)]
    rows = seen.select(*(F.col(m).cast("double").alias(m) for m in members), *(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(b)))).alias(h) for b, h in enumerate(hashes)))
    sums = [F.sum(sign(F.col(h), d) * F.col(m)).alias(f"s{b}_{d}_{k}") for b, h in enumerate(hashes) for d in range(DIGITS) for k, m in enumerate(members)]
    one = rows.agg(F.count(F.lit(1)).alias("n"), *sums)
    largest = [F.greatest(*(F.abs(F.col(f"s{b}_{d}_{k}")) for k in range(len(members)))) if len(members) > 1 else F.abs(F.col(f"s{b}_{d}_0")) for b in range(blocks) for d in range(DIGITS)]
    return one.select("n", (sum(largest[1:], largest[0]) / len(largest) / F.when(F.col("n") > 0, F.col("n"))).alias("complexity"))


def generalisation(df: DataFrame, key: str, members: Sequence[str], y: str, weights: Sequence[float] | None = None, delta: float = 0.05, features: int = 1) -> DataFrame:
    """One row: n, risk (mean squared error of the weighted mean), complexity, confidence, bound = risk + 2 complexity + 3 confidence, and the dimension of linear
    combinations of the members."""
    w = list(weights or [1 / len(members)] * len(members))
    seen = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [y, *members]))
    mean = sum((F.col(m) * v for m, v in zip(members, w, strict=True)), F.lit(0.0))
    risk = seen.agg(F.avg(F.pow(mean - F.col(y), F.lit(2))).alias("risk"))
    both = rademacher(seen, key, members).crossJoin(risk)  # one row each
    confidence = F.sqrt(F.lit(math.log(2 / delta)) / (2 * F.when(F.col("n") > 0, F.col("n"))))
    return both.select("n", "risk", "complexity", confidence.alias("confidence"), (F.col("risk") + 2 * F.col("complexity") + 3 * confidence).alias("bound"), F.lit((features + 1) * len(members)).alias("dimension"))
