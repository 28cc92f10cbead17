"""Distribution functions without SciPy, as plain Python (for a few numbers on the driver) and as Columns where a closed form exists."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return total * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for q in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + q * d or 1e-300)
            c = 1 + q / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_p(df / 2, x / 2)


def t_sf2(t: float, df: float) -> float:
    """Two-sided."""
    return beta_i(df / 2, 0.5, df / (df + t * t))


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def normal_sf2(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 26.2.17: error below 7.5e-8."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, 1 - tail).otherwise(tail)
