"""Scalar expressions: errors, labels, formats, distances, variograms, kernels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def errors(y: Column, p: Column) -> dict[str, Column]:
    """Absolute, squared, percentage and symmetric percentage error, bias."""
    d = p - y
    return {"ae": F.abs(d), "se": d * d, "ape": 100 * F.abs(d) / (F.abs(y) + 1e-8), "sape": 200 * F.abs(d) / (F.abs(y) + F.abs(p) + 1e-8), "bias": d}


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def variogram(kind: str, h: Column, nugget: float, sill: float, reach: float) -> Column:
    part = sill - nugget
    if kind == "spherical":
        shape = F.when(h <= reach, 1.5 * h / reach - 0.5 * F.pow(h / reach, 3)).otherwise(1.0)
    elif kind == "exponential":
        shape = 1 - F.exp(-3 * h / reach)
    elif kind == "gaussian":
        shape = 1 - F.exp(-3 * F.pow(h / reach, 2))
    elif kind.startswith("matern"):
        shape = 1 - matern(h / reach, float(kind.partition(":")[2] or 1.5))
    else:
        raise ValueError(f"unknown variogram: {kind}")
    return F.when(h > 0, nugget + part * shape).otherwise(0.0)


def variogram_slope(kind: str, h: Column, nugget: float, sill: float, reach: float, step: float = 1e-6) -> Column:
    if kind == "spherical":
        return F.when((h > 0) & (h < reach), (sill - nugget) * (1.5 / reach - 1.5 * F.pow(h, 2) / reach**3)).otherwise(0.0)
    return (variogram(kind, h + step, nugget, sill, reach) - variogram(kind, h, nugget, sill, reach)) / step


def matern(r: Column, nu: float) -> Column:
    """Closed forms for nu 0.5, 1.5 and 2.5."""
    s = math.sqrt(2 * nu) * r
    forms = {0.5: F.exp(-s), 1.5: (1 + s) * F.exp(-s), 2.5: (1 + s + s * s / 3) * F.exp(-s)}
    if nu not in forms:
        raise ValueError("nu must be 0.5, 1.5 or 2.5")
    return forms[nu]


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow((x - y).cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def kernel(kind: str, a: Column, b: Column, gamma: float = 1.0, degree: int = 3, offset: float = 1.0, length: float = 1.0) -> Column:
    if kind == "rbf":
        return F.exp(-gamma * squared_distance(a, b))
    if kind == "laplacian":
        return F.exp(-gamma * F.aggregate(F.zip_with(a, b, lambda x, y: F.abs((x - y).cast("double"))), F.lit(0.0), lambda s, x: s + x))
    if kind == "polynomial":
        return F.pow(gamma * dot(a, b) + offset, F.lit(degree))
    if kind.startswith("matern"):
        return matern(F.sqrt(squared_distance(a, b)) / length, float(kind.partition(":")[2] or 1.5))
    raise ValueError(f"unknown kernel: {kind}")


def label(x: Column, *steps: tuple[float, str], last: str) -> Column:
    out = F.lit(last)
    for limit, name in reversed(steps):
        out = F.when(F.abs(x) < limit, name).otherwise(out)
    return out


def effect_size(kind: str, x: Column) -> Column:
    """negligible, small, medium or large."""
    cuts = {"d": (0.2, 0.5, 0.8), "r": (0.1, 0.3, 0.5), "eta2": (0.01, 0.06, 0.14), "w": (0.1, 0.3, 0.5)}[kind]
    return label(x, (cuts[0], "negligible"), (cuts[1], "small"), (cuts[2], "medium"), last="large")


def human_bytes(n: Column) -> Column:
    out = F.concat(F.format_string("%.2f", n / 1024.0**4), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(n < 1024 ** (power + 1), F.concat(F.format_string("%.2f", n / 1024.0**power), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def human_seconds(s: Column) -> Column:
    s = s.cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(
        F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor(s % 3600 / 60).cast("string"), F.lit("m")))


def safe_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"[^A-Za-z0-9_-]", "_"), 1, 100)


#: Signs that the typesetting language reserves, in order of replacement.
LATEX = (("\\", "\\textbackslash "), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("{", "\\{"), ("}", "\\}"))


def latex(c: Column) -> Column:
    for old, new in LATEX:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def content_hash(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def complexity(method: Column, rows: Column) -> Column:
    """Seconds that a method may take, by a factor and the number of rows."""
    factor = F.when(method.isin("mean", "median", "forward_fill", "backward_fill"), 1.0).when(method == "linear", 1.5).when(method == "spline", 3.0).when(method == "knn", 10.0).when(method == "random_forest", 50.0).otherwise(20.0)
    return rows / 1e6 * factor * F.greatest(F.lit(1.0), F.log10(rows + 1) / 3)
