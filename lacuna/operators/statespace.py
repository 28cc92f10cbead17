"""Gaussian state-space models of long series: filter and smoother by an associative scan over chunks of rows.

A series is cut into chunks. What a chunk does to the state before it is one element (a map of the mean, a covariance, and what its observations say about that
state); what it does backward to the smoothed state after it is another. Elements combine associatively, so that the states between chunks come from a
small table, one row a chunk, scanned in groups of at most FAN (groups of groups for longer series). Each chunk is then filtered, and smoothed, from its
own states. Chunks of one series run on many tasks, and a task runs AT_ONCE of them in step, as stacked matrices.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import kept
from .series import AT, BY

CHUNK, FAN, AT_ONCE = 1 << 12, 1 << 10, 16


@dataclass(frozen=True)
class Model:
    """state' = f state + noise of covariance q; value = h state + noise of variance r. The state before the first row has mean (the first observed
    value, 0, ...) and covariance p0."""

    f: np.ndarray
    q: np.ndarray
    h: np.ndarray
    r: float
    p0: np.ndarray

    @property
    def size(self) -> int:
        return len(self.h)


def local_level(q: float = 1e-5, r: float = 1e-2, p0: float = 1.0) -> Model:
    return Model(np.eye(1), np.array([[q]]), np.ones(1), r, np.array([[p0]]))


def structural(level: float, slope: float | None = None, season: float = 0.0, period: float = 24, harmonics: int = 0, r: float = 1.0, p0: float = 100.0) -> Model:
    """Local level, a local trend if slope is a variance, and a Fourier season of so many harmonics, each a rotating pair."""
    parts, noise, h = ([np.array([[1.0]])], [level], [1.0]) if slope is None else ([np.array([[1.0, 1.0], [0.0, 1.0]])], [level, slope], [1.0, 0.0])
    for k in range(1, harmonics + 1):
        a = 2 * math.pi * k / period
        parts.append(np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]]))
        noise += [season, season]
        h += [1.0, 0.0]
    n, at = len(h), 0
    f = np.zeros((n, n))
    for p in parts:
        f[at : at + len(p), at : at + len(p)] = p
        at += len(p)
    return Model(f, np.diag(noise), np.array(h), r, p0 * np.eye(n))


# elements, as flat arrays: (A, b, C, eta, J) forward, (E, g, L) backward; states: (mean, covariance)


def _split(e: np.ndarray, *shapes: tuple[int, ...]) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes:
        n = int(np.prod(s))
        out.append(e[at : at + n].reshape(s))
        at += n
    return out


def _flat(*arrays: np.ndarray) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays])


def forward_state(s: np.ndarray, e: np.ndarray, d: int) -> np.ndarray:
    """The state after a chunk, from the state before it."""
    m, p = _split(s, (d,), (d, d))
    a, b, c, eta, j = _split(e, (d, d), (d,), (d, d), (d,), (d, d))
    known = np.linalg.solve(np.eye(d) + p @ j, np.column_stack([m + p @ eta, p]))
    cov = a @ known[:, 1:] @ a.T + c
    return _flat(a @ known[:, 0] + b, (cov + cov.T) / 2)


def forward_both(x: np.ndarray, y: np.ndarray, d: int) -> np.ndarray:
    """The element of x and then y."""
    shapes = (d, d), (d,), (d, d), (d,), (d, d)
    (a1, b1, c1, n1, j1), (a2, b2, c2, n2, j2) = _split(x, *shapes), _split(y, *shapes)
    u = np.linalg.solve(np.eye(d) + c1 @ j2, np.column_stack([a1, b1 + c1 @ n2, c1]))
    v = np.linalg.solve(np.eye(d) + j2 @ c1, np.column_stack([n2 - j2 @ b1, j2]))
    return _flat(a2 @ u[:, :d], a2 @ u[:, d] + b2, a2 @ u[:, d + 1 :] @ a2.T + c2, a1.T @ v[:, 0] + n1, a1.T @ v[:, 1:] @ a1 + j1)


def backward_state(s: np.ndarray, e: np.ndarray, d: int) -> np.ndarray:
    """The smoothed state at a chunk's first row, from that at the next chunk's."""
    m, p = _split(s, (d,), (d, d))
    a, g, c = _split(e, (d, d), (d,), (d, d))
    return _flat(a @ m + g, a @ p @ a.T + c)


def backward_both(x: np.ndarray, y: np.ndarray, d: int) -> np.ndarray:
    """The element of y (later rows) and then x."""
    (a1, g1, c1), (a2, g2, c2) = (_split(e, (d, d), (d,), (d, d)) for e in (y, x))
    return _flat(a1 @ a2, a1 @ g2 + g1, a1 @ c2 @ a1.T + c1)


def scanned(elements: DataFrame, start: DataFrame, one: Callable, both: Callable, d: int) -> DataFrame:
    """(series, at, s): the state before each element, in order of `at`, from the state `s` of each series in `start`. elements: series, at, e. A task folds at
    most FAN elements; the groups' own elements are scanned in turn."""
    import pandas as pd

    first, last = elements.agg(F.min("at"), F.max("at")).first()
    if first is None:
        return elements.select("series", "at", F.col("e").alias("s"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        s, out = np.array(pdf["s"].iloc[0]), []
        for e in pdf["e"]:
            out.append(s)
            s = one(s, np.array(e), d)
        return pd.DataFrame({"series": pdf["series"], "at": pdf["at"], "s": out})

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        e = np.array(pdf["e"].iloc[0])
        for x in pdf["e"].iloc[1:]:
            e = both(e, np.array(x), d)
        return pd.DataFrame({"series": pdf["series"].iloc[:1], "at": pdf["grp"].iloc[:1], "e": [e]})

    if last - first < FAN:
        return elements.join(start, "series").groupBy("series").applyInPandas(fold, "series string, at long, s array<double>")
    grouped = elements.withColumn("grp", F.floor((F.col("at") - first) / FAN).cast("long"))
    above = kept(grouped.groupBy("series", "grp").applyInPandas(summed, "series string, at long, e array<double>"), "scan")
    before = scanned(above, start, one, both, d).withColumnRenamed("at", "grp")
    return grouped.join(before, ["series", "grp"]).groupBy("series", "grp").applyInPandas(fold, "series string, at long, s array<double>")


# chunks in step


def stacked(parts: Sequence) -> np.ndarray:
    """Values of chunks side by side, short ones with nan at the end."""
    y = np.full((len(parts), max(map(len, parts))), np.nan)
    for k, p in enumerate(parts):
        y[k, : len(p)] = p["x"].to_numpy(float)
    return y


def elements_of(y: np.ndarray, n: np.ndarray, model: Model) -> np.ndarray:
    """The forward elements of chunks: a filter that starts from an unknown state x (mean a x + b), and what the values say about x."""
    d, k = model.size, len(y)
    a, b, c = np.tile(np.eye(d), (k, 1, 1)), np.zeros((k, d)), np.zeros((k, d, d))
    eta, j = np.zeros((k, d)), np.zeros((k, d, d))
    for t in range(y.shape[1]):
        go = t < n
        a1, b1, c1 = model.f @ a, b @ model.f.T, model.f @ c @ model.f.T + model.q
        seen = go & ~np.isnan(y[:, t])
        if seen.any():
            s = c1 @ model.h @ model.h + model.r
            ha, gain = np.einsum("i,kij->kj", model.h, a1), c1 @ model.h / s[:, None]
            off = np.where(seen, y[:, t] - b1 @ model.h, 0.0)
            w = seen / s
            eta += ha * (off * w)[:, None]
            j += ha[:, :, None] * ha[:, None, :] * w[:, None, None]
            gain = gain * seen[:, None]
            a1, b1, c1 = a1 - gain[:, :, None] * ha[:, None, :], b1 + gain * off[:, None], c1 - gain[:, :, None] * np.einsum("i,kij->kj", model.h, c1)[:, None, :]
        a, b, c = np.where(go[:, None, None], a1, a), np.where(go[:, None], b1, b), np.where(go[:, None, None], c1, c)
    return np.concatenate([x.reshape(k, -1) for x in (a, b, c, eta, j)], 1)


def filtered_of(y: np.ndarray, m: np.ndarray, p: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances after each row, from each chunk's state before."""
    ms, ps = np.empty((*y.shape, model.size)), np.empty((*y.shape, model.size, model.size))
    for t in range(y.shape[1]):
        m, p = m @ model.f.T, model.f @ p @ model.f.T + model.q
        seen = ~np.isnan(y[:, t])
        if seen.any():
            gain = p @ model.h / (p @ model.h @ model.h + model.r)[:, None] * seen[:, None]
            m = m + gain * np.where(seen, y[:, t] - m @ model.h, 0.0)[:, None]
            p = p - gain[:, :, None] * np.einsum("i,kij->kj", model.h, p)[:, None, :]
            p = (p + p.swapaxes(1, 2)) / 2
        ms[:, t], ps[:, t] = m, p
    return ms, ps


def back_step(m: np.ndarray, p: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(E, g, L) of rows with filtered m, p."""
    ahead = model.f @ p @ model.f.T + model.q
    ahead = ahead + 1e-12 * np.trace(ahead, axis1=-2, axis2=-1)[..., None, None] * np.eye(model.size)
    e = np.linalg.solve(ahead, model.f @ p).swapaxes(-1, -2)
    return e, m - np.einsum("...ij,...j->...i", e, m @ model.f.T), p - e @ model.f @ p


def in_chunks(rows: DataFrame, schema: str, solve: Callable) -> DataFrame:
    """solve(list of chunks as pandas frames) -> frame, at most AT_ONCE chunks at a time. rows: series, chunk, i and more, whole chunks together and in order."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, open_ = [], []

        def key(part):
            return part["series"].iloc[0], part["chunk"].iloc[0]

        for batch in batches:
            change = (batch["chunk"] != batch["chunk"].shift()) | (batch["series"] != batch["series"].shift())
            for _, part in batch.groupby(change.cumsum(), sort=False):
                if open_ and key(open_[0]) != key(part):
                    whole.append(pd.concat(open_))
                    open_ = []
                open_.append(part)
                if len(whole) >= AT_ONCE:
                    yield solve(whole)
                    whole = []
        if open_:
            whole.append(pd.concat(open_))
        if whole:
            yield solve(whole)

    return rows.mapInPandas(run, schema)


def smoothed(df: DataFrame, x: str, model: Model, smooth: bool = True) -> DataFrame:
    """(series, i, filtered, filtered_var, smoothed, smoothed_var): the model's value at each row given the rows up to it, and given all rows (null without
    `smooth`). Rows are numbered from 1 in each series; a series without observed rows has nulls. Rows before the first observed one have the start's mean."""
    import pandas as pd

    d, v = model.size, F.col(x).cast("double")
    seen = df.select(F.col(BY).cast("string").alias("series"), F.col(AT).cast("long").alias("i"), F.when(~F.isnan(v), v).alias("x"))
    cut = seen.withColumn("chunk", F.floor((F.col("i") - 1) / CHUNK).cast("long"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = kept(cut.repartition(tasks, "series", "chunk").sortWithinPartitions("series", "chunk", "i"), "chunks")

    def dealt(states: DataFrame | None) -> DataFrame:
        """The rows, each chunk's first one with its states."""
        r = rows
        if states is not None:
            # stored, so that Spark knows how small it is; one row a chunk
            r = r.join(states, ["series", "i"], "left")
        return r.repartition(tasks, "series", "chunk").sortWithinPartitions("series", "chunk", "i")

    def forward(parts):
        e = elements_of(stacked(parts), np.array([len(p) for p in parts]), model)
        return pd.DataFrame({"series": [p["series"].iloc[0] for p in parts], "at": [p["chunk"].iloc[0] for p in parts], "i": [p["i"].iloc[0] for p in parts], "e": list(e)})

    firsts = rows.filter("x is not null").groupBy("series").agg(F.min_by("x", "i").alias("m0"))
    start = firsts.select("series", F.concat(F.array("m0", *[F.lit(0.0)] * (d - 1)), F.array(*map(F.lit, model.p0.ravel().tolist()))).alias("s"))
    elements = kept(in_chunks(dealt(None), "series string, at long, i long, e array<double>", forward), "elements")
    before = scanned(elements.select("series", "at", "e"), start, forward_state, forward_both, d)
    places = elements.select("series", "at", "i")
    states = kept(places.join(before, ["series", "at"]).select("series", "i", F.col("s").alias("before")), "states")

    def filtered(parts):
        s = np.array([p["before"].iloc[0] for p in parts], float)
        y = stacked(parts)
        return y, *filtered_of(y, s[:, :d], s[:, d:].reshape(-1, d, d), model)

    def known(parts):
        return [p for p in parts if p["before"].iloc[0] is not None], [p for p in parts if p["before"].iloc[0] is None]

    def framed(parts, columns):
        out = pd.concat([p[["series", "i"]] for p in parts])
        for name, stack in columns.items():
            out[name] = np.concatenate([s[: len(p)] for s, p in zip(stack, parts, strict=True)]) if stack is not None else np.nan
        return out

    def value(ms, ps):
        return ms @ model.h, np.einsum("i,ktij,j->kt", model.h, ps, model.h)

    def forward_only(parts):
        has, none = known(parts)
        out = [framed(none, dict.fromkeys(names))] if none else []
        if has:
            _, ms, ps = filtered(has)
            m, p = value(ms, ps)
            out.append(framed(has, {"filtered": m, "filtered_var": p, "smoothed": None, "smoothed_var": None}))
        return pd.concat(out)

    def backward(parts):
        has, _ = known(parts)
        if not has:
            return pd.DataFrame({"series": pd.Series(dtype=object), "at": pd.Series(dtype="int64"), "i": pd.Series(dtype="int64"), "e": pd.Series(dtype=object)})
        _, ms, ps = filtered(has)
        out = []
        for k, part in enumerate(has):
            es, gs, ls = back_step(ms[k, : len(part)], ps[k, : len(part)], model)
            e, g, c = np.eye(d), np.zeros(d), np.zeros((d, d))
            if part["end"].iloc[-1]:
                es[-1], gs[-1], ls[-1] = 0, ms[k, len(part) - 1], ps[k, len(part) - 1]
            for t in range(len(part) - 1, -1, -1):
                e, g, c = es[t] @ e, es[t] @ g + gs[t], es[t] @ c @ es[t].T + ls[t]
            out.append(_flat(e, g, c))
        return pd.DataFrame({"series": [p["series"].iloc[0] for p in has], "at": [-p["chunk"].iloc[0] for p in has], "i": [p["i"].iloc[0] for p in has], "e": out})

    def both_ways(parts):
        has, none = known(parts)
        out = [framed(none, dict.fromkeys(names))] if none else []
        if has:
            y, ms, ps = filtered(has)
            n = np.array([len(p) for p in has])
            after = np.array([p["after"].iloc[0] for p in has], float)
            sm, sp = ms.copy(), ps.copy()
            m, p = after[:, :d], after[:, d:].reshape(-1, d, d)
            ended = np.array([p["end"].iloc[-1] for p in has], bool)
            es, gs, ls = back_step(ms, ps, model)
            for t in range(y.shape[1] - 1, -1, -1):
                last = (t == n - 1) & ended
                new_m, new_p = np.einsum("kij,kj->ki", es[:, t], m) + gs[:, t], es[:, t] @ p @ es[:, t].swapaxes(1, 2) + ls[:, t]
                new_m, new_p = np.where(last[:, None], ms[:, t], new_m), np.where(last[:, None, None], ps[:, t], new_p)
                go = t < n
                m, p = np.where(go[:, None], new_m, m), np.where(go[:, None, None], new_p, p)
                sm[:, t], sp[:, t] = m, p
            (fm, fp), (am, ap) = value(ms, ps), value(sm, sp)
            out.append(framed(has, {"filtered": fm, "filtered_var": fp, "smoothed": am, "smoothed_var": ap}))
        return pd.concat(out)

    names = ("filtered", "filtered_var", "smoothed", "smoothed_var")
    ddl = "series string, i long, filtered double, filtered_var double, smoothed double, smoothed_var double"
    if not smooth:
        return _clean(in_chunks(dealt(states), ddl, forward_only))
    ends = rows.groupBy("series").agg(F.max("i").alias("last"))
    marked = states.join(ends, "series").select("series", "i", "before", "last")

    def with_end(r: DataFrame) -> DataFrame:
        """end: whether a chunk holds its series' last row."""
        return r.withColumn("end", F.coalesce(F.floor((F.col("last") - 1) / CHUNK) == F.col("chunk"), F.lit(False)))

    # only a chunk's first row knows its series' end; the flag is asked for at the chunk's last row, so it is spread by the solver's frames
    def flagged(solve):
        def run(parts):
            return solve([p.assign(end=bool(p["end"].iloc[0])) for p in parts])

        return run

    back = kept(in_chunks(with_end(dealt(marked)), "series string, at long, i long, e array<double>", flagged(backward)), "back")
    nothing = back.select("series").distinct().select("series", F.array(*[F.lit(0.0)] * (d + d * d)).alias("s"))
    after = scanned(back.select("series", "at", "e"), nothing, backward_state, backward_both, d)
    after = back.select("series", "at", "i").join(after, ["series", "at"]).select("series", "i", F.col("s").alias("after"))
    both = kept(marked.join(after, ["series", "i"]), "both")
    return _clean(in_chunks(with_end(dealt(both)), ddl, flagged(both_ways)))


def _clean(df: DataFrame) -> DataFrame:
    """Pandas' nan as null."""
    return df.select("series", "i", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in df.columns[2:]))


def interval(df: DataFrame, model: Model, z: float = 1.96) -> DataFrame:
    """Bounds of a new value at each row of what smoothed() gives: the smoothed value +- z deviations, the observation's noise included."""
    half = z * F.sqrt(F.col("smoothed_var") + F.lit(model.r))
    return df.withColumns({"lo": F.col("smoothed") - half, "hi": F.col("smoothed") + half})
