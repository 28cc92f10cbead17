"""Stations in space: pairs, graphs, nearest donors, semivariograms, kriging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import haversine, variogram


#: Keys of a place that one row holds; values of one side of a block of pairs; classes a pass counts in a bracket; values that the last pass may meet.
MEMBERS, TILE, CELLS, FEW = 512, 1024, 2048, 200_000


def pairs(stations: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """All pairs of a station table, i < j. A dimension table: its size is the number of stations."""
    a = stations.select(F.col(key).alias("i"), *(F.col(c).alias(f"{c}_i") for c in columns))
    b = stations.select(F.col(key).alias("j"), *(F.col(c).alias(f"{c}_j") for c in columns))
    return a.join(b, F.col("i") < F.col("j"))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """df over all shuffle partitions, however small it is: its rows stand for many pairs."""
    return df.repartition(_tasks(df), *by)


def _members(points: DataFrame, key: str, axes: Sequence[str]) -> DataFrame:
    """(place, axes, part, keys): the keys at each place in order, some MEMBERS a row; a place is named by its least key. Keys differ; points without a key don't count."""
    known = points.filter(F.col(key).isNotNull()).select(F.col(key).alias("k__"), *axes)
    at = known.groupBy(*axes).agg(F.min("k__").alias("place"), F.count(F.lit(1)).alias("n__")).withColumnsRenamed({c: f"{c}__" for c in axes})
    dealt = known.join(at, [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in axes])
    part = F.pmod(F.xxhash64("k__"), F.ceil(F.col("n__") / MEMBERS)).alias("part")
    return dealt.groupBy("place", *axes, part).agg(F.sort_array(F.collect_list("k__")).alias("keys"))


def _opened(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, columns): all pairs i < j of the keys of two members rows; of a row with itself each pair once.

    Generated code holds a copy of every row that one input row makes before it hands on the first. `rows` are over as many tasks as `_spread` makes, so that coalescing moves
    nothing, but it ends the generated code of one side: held are the rows of one key (some MEMBERS) and of one side, not the product of both."""
    each = rows.select(F.col("keys_i").alias("k__"), F.col("keys_j").alias("l__"), (F.struct("place_i", "part_i") == F.struct("place_j", "part_j")).alias("own__"), *columns)
    each = each.select(F.explode("k__").alias("k__"), "l__", "own__", *columns).coalesce(_tasks(rows))
    each = each.select("k__", F.explode("l__").alias("l__"), "own__", *columns)
    return each.filter("not own__ or k__ < l__").select(F.least("k__", "l__").alias("i"), F.greatest("k__", "l__").alias("j"), *columns)


def _sided(rows: DataFrame, side: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"{c}_{side}") for c in rows.columns))


def distances(stations: DataFrame, key: str, lat: str = "lat", lon: str = "lon", digits: int | None = None) -> DataFrame:
    """(i, j, km) of all pairs i < j, rounded to `digits` if given: a distance is worked out once for two places, and rows of places are dealt to tasks before they are
    opened into pairs of stations."""
    m = _members(stations.select(key, F.col(lat).alias("lat"), F.col(lon).alias("lon")), key, ["lat", "lon"])
    a, b = _sided(_spread(m, "place", "part"), "i"), _sided(m, "j")
    both = a.join(b, (F.col("place_i") < F.col("place_j")) | (F.col("place_i") == F.col("place_j")) & (F.col("part_i") <= F.col("part_j")))
    km = haversine(F.col("lat_i"), F.col("lon_i"), F.col("lat_j"), F.col("lon_j"))
    both = _spread(both.withColumn("km", km if digits is None else F.round(km, digits)), "place_i", "place_j", "part_i", "part_j")
    return _opened(both, ["km"])


def _near_places(places: DataFrame, reach: float) -> DataFrame:
    """Pairs of rows (place, x, y, ...) at different places that are less than the reach apart on each axis, and of each place with itself, as columns <name>_i and <name>_j:
    an equi-join on grid cells of that size and their neighbours, so that only near places meet."""
    cell = places.filter("x is not null and y is not null").withColumns({"gx": F.floor(F.col("x") / reach), "gy": F.floor(F.col("y") / reach)})
    step = F.array(*map(F.lit, (-1, 0, 1)))
    a = cell.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).withColumns({"gx": F.col("gx") + F.col("dx"), "gy": F.col("gy") + F.col("dy")}).drop("dx", "dy")
    rest = places.columns
    a = a.select(*(F.col(c).alias(f"{c}_i") for c in rest), "gx", "gy")
    b = cell.select(*(F.col(c).alias(f"{c}_j") for c in rest), "gx", "gy")
    return a.join(b, ["gx", "gy"]).filter("place_i <= place_j").drop("gx", "gy")


def _apart() -> Column:
    return F.sqrt(F.pow(F.col("x_i") - F.col("x_j"), F.lit(2)) + F.pow(F.col("y_i") - F.col("y_j"), F.lit(2)))


def within(stations: DataFrame, key: str, threshold: float, x: str = "x", y: str = "y", digits: int | None = None) -> DataFrame:
    """(i, j, d) of pairs i < j at different places closer than the threshold, rounded to `digits` if given. Places meet on grid cells; rows of near places are dealt to
    tasks before they are opened into pairs."""
    m = _members(stations.select(key, F.col(x).alias("x"), F.col(y).alias("y")), key, ["x", "y"])
    near = _near_places(m, threshold).withColumn("d", _apart()).filter((F.col("d") > 0) & (F.col("d") < threshold))
    near = near if digits is None else near.withColumn("d", F.round("d", digits))
    return _opened(_spread(near, "place_i", "place_j", "part_i", "part_j"), ["d"])


def moments(points: DataFrame, key: str, x: str = "x", y: str = "y", v: str = "v") -> DataFrame:
    """(place, x, y, n, c, m, s): for each place its least key, its number of points and of values, and the values' mean and variance."""
    known = points.filter(F.col(key).isNotNull())
    return known.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.min(key).alias("place"), F.count(F.lit(1)).alias("n"), F.count(v).alias("c"), F.coalesce(F.avg(v), F.lit(0.0)).alias("m"), F.coalesce(F.var_pop(v), F.lit(0.0)).alias("s")).select("place", "x", "y", "n", "c", "m", "s")


def _counted(both: DataFrame) -> DataFrame:
    """Pairs of places with moments, with the number of pairs of points (n), of values (c), and the sum of squared differences of the values (q)."""
    own = F.col("place_i") == F.col("place_j")
    square = F.col("s_i") + F.col("s_j") + F.pow(F.col("m_i") - F.col("m_j"), F.lit(2))

    def count(name: str) -> Column:
        a, b = F.col(f"{name}_i"), F.col(f"{name}_j")
        return F.when(own, F.floor(a * (a - 1) / 2)).otherwise(a * b)

    q = F.when(own, F.col("c_i").cast("double") * F.col("c_i") * F.col("s_i")).otherwise(F.col("c_i").cast("double") * F.col("c_j") * square)
    return both.withColumns({"n": count("n"), "c": count("c"), "q": q}).filter("n > 0")


def near_moments(points: DataFrame, key: str, reach: float, x: str = "x", y: str = "y", v: str = "v") -> DataFrame:
    """(d, n, c, q) of pairs of places (and places with themselves) less than the reach apart on each axis; see `_counted`. Points without a place don't count."""
    return _counted(_near_places(moments(points, key, x, y, v), reach)).select(_apart().alias("d"), "n", "c", "q")


def nearest_on_grid(queries: DataFrame, donors: DataFrame, k: int, x: str = "x", y: str = "y", strict: bool = False, more: Sequence[str] = ()) -> DataFrame:
    """(q, donor, d, rank): the k nearest donors in the plane (or on more axes), ties by donor. Points meet by an equi-join on grid cells and their neighbours; the
    answer holds where the k-th distance is no more than a cell. Other queries go on with cells twice as wide, until a cell spans all donors. With
    `strict` a donor of the query's own id doesn't count. Queries or donors that lack a coordinate have no neighbours.

    Of the donors at one place only the first k (one more if strict) can be among the nearest. The first cells are made small enough that a donor shares its own with few others, however
    unevenly they lie, and queries are dealt to tasks before they meet donors."""
    from ..sources.files import kept

    axes = [x, y, *more]
    at, to, cells = ([f"{p}{i}__" for i in range(len(axes))] for p in "abg")
    whole = " and ".join(f"{c} is not null" for c in to)
    donors = donors.select("donor", *(F.col(a).alias(c) for a, c in zip(axes, to, strict=True))).filter(whole)
    first = F.row_number().over(Window.partitionBy(*to).orderBy("donor"))
    donors = kept(donors.withColumn("rank__", first).filter(F.col("rank__") <= k + int(strict)), "donors")
    left = queries.select("q", *(F.col(a).alias(c) for a, c in zip(axes, at, strict=True))).filter(" and ".join(f"{c} is not null" for c in at))
    box = donors.agg(F.count_if(F.col("rank__") == 1).alias("n"), *(f(c).alias(f"{n}{c}") for c in to for n, f in (("lo", F.min), ("hi", F.max)))).first()
    ends = [(box[f"lo{c}"] or 0.0, box[f"hi{c}"] or 0.0) for c in to]
    far = left.agg(F.max(F.greatest(*(F.abs(F.col(c) - e) for c, pair in zip(at, ends, strict=True) for e in pair))).alias("far")).first()["far"] or 0.0
    span, volume = max(far, 1e-9), 1.0
    for lo, hi in ends:
        volume *= hi - lo
    cell = max(volume * (k + 1) / max(1, box["n"]), 1e-6 ** len(axes)) ** (1 / len(axes))
    donors = donors.drop("rank__")

    def crowd() -> float:
        """Donors in the cell of a donor, on average."""
        return donors.groupBy(*(F.floor(F.col(c) / cell) for c in to)).count().agg(F.sum(F.col("count") * F.col("count").cast("double")) / F.sum("count")).first()[0] or 0.0

    while cell > 1e-6 * span and crowd() > 4 * (k + 1) * (k + 1):
        cell /= 2
    left, out = _spread(left, "q"), None
    while True:
        last = cell >= span
        a = left
        for c, g in zip(at, cells, strict=True):
            a = a.withColumn("step__", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn(g, F.floor(F.col(c) / cell) + F.col("step__"))
        b = donors.withColumns({g: F.floor(F.col(c) / cell) for c, g in zip(to, cells, strict=True)})
        square = sum((F.pow(F.col(p) - F.col(o), F.lit(2)) for p, o in zip(at[1:], to[1:], strict=True)), F.pow(F.col(at[0]) - F.col(to[0]), F.lit(2)))
        d = a.join(b, cells).select("q", "donor", F.sqrt(square).alias("d"))
        d = d.filter("q <> donor") if strict else d
        w = Window.partitionBy("q")
        d = d.withColumn("rank", F.row_number().over(w.orderBy("d", "donor"))).filter(F.col("rank") <= k)
        d = d.withColumn("sure", (F.count(F.lit(1)).over(w) == k) & (F.max("d").over(w) < cell))
        found = kept((d if last else d.filter("sure")).select("q", "donor", "d", "rank"), "nearest")
        out = found if out is None else out.unionByName(found)
        if last:
            return out
        left = kept(left.join(found.select("q").distinct(), "q", "left_anti"), "queries")
        if left.isEmpty():
            return out
        cell *= 2


def semivariogram(points: DataFrame, key: str, bins: int, x: str = "x", y: str = "y", v: str = "v", estimator: str = "matheron") -> DataFrame:
    """(bin, n, distance, gamma) over equal-width bins up to the largest distance (its own bin closes the last).

    Numbers, distances and squared differences come from pairs of places with moments. The mean of square roots and the quartile need every pair of values: these
    meet in blocks of TILE x TILE, of which a task holds one at a time, and leave sums or counts."""
    from ..sources.files import kept

    at = kept(moments(points, key, x, y, v), "places")
    far = _sided(_spread(at, "place"), "i").join(_sided(at, "j"), F.col("place_i") <= F.col("place_j"))
    far = _counted(far).select(_apart().alias("d"), "n", "c", "q")
    top = far.agg(F.max("d").alias("top")).first()["top"]
    binned = far.withColumn("bin", F.least(F.floor(F.try_divide(F.col("d"), F.lit(top).cast("double")) * bins), F.lit(bins - 1)).cast("long"))
    out = binned.groupBy("bin").agg(F.sum("n").alias("n"), (F.sum(F.col("d") * F.col("n")) / F.sum(F.when(F.col("d").isNotNull(), F.col("n")))).alias("distance"), F.sum("c").alias("c"), F.sum("q").alias("q"))
    if estimator == "matheron":
        return out.select("bin", "n", "distance", (F.when(F.col("c") > 0, F.col("q") / F.col("c")) / 2).alias("gamma"))
    tiles = _tiles(points.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(v).cast("double").alias("v")))
    if estimator == "cressie":
        roots = _blocks(tiles, top, bins, _roots).groupBy("bin").agg((F.sum("w") / F.sum("c")).alias("r"))
        return out.join(roots, "bin", "left").select("bin", "n", "distance", (F.pow("r", F.lit(4)) / (0.457 + 0.494 / F.col("n")) / 2).alias("gamma"))
    if estimator != "genton":
        raise KeyError(estimator)
    q = _quantiles(tiles, top, bins, 0.25)
    quartile = points.sparkSession.createDataFrame([(int(b), float(x)) for b, x in q.items()], "bin long, r double")
    return out.join(F.broadcast(quartile), "bin", "left").select("bin", "n", "distance", (F.pow(2.2191 * F.col("r"), F.lit(2)) / 2).alias("gamma"))


def _tiles(points: DataFrame) -> DataFrame:
    """(tile, x, y, v, c): distinct (x, y, v) with their number, in arrays of at most TILE, by place. Points without a key or a value make no pair with a difference."""
    from ..sources.files import kept
    from .ranks import numbered

    once = points.filter("k is not null and v is not null").groupBy("x", "y", "v").agg(F.count(F.lit(1)).alias("c"))
    rows = numbered(once, [], ["x", "y", "v"]).withColumn("tile", F.floor((F.col("i") - 1) / TILE))
    lists = rows.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("x", "y", "v", "c"))).alias("r"))  # at most TILE
    return kept(lists.select("tile", *(F.col("r")[c].cast("array<double>").alias(c) for c in ("x", "y", "v", "c"))), "tiles")


def _blocks(tiles: DataFrame, top: float | None, bins: int, work) -> DataFrame:
    """work(bins of places, rows and columns where a place begins, differences, numbers of pairs) -> rows (bin, k, w, c), summed over the blocks of a task: all pairs
    of values, each once."""
    import numpy as np
    import pandas as pd

    def run(parts):
        total = None
        for pdf in parts:
            for r in pdf.to_dict("records"):
                a, b = ({c: np.asarray(r[f"{c}_{s}"], float) for c in "xyvc"} for s in "ij")
                fa, fb = (np.flatnonzero(np.r_[True, (t["x"][1:] != t["x"][:-1]) | (t["y"][1:] != t["y"][:-1])]) for t in (a, b))
                d = np.sqrt((a["x"][fa, None] - b["x"][fb]) ** 2 + (a["y"][fa, None] - b["y"][fb]) ** 2)
                with np.errstate(divide="ignore", invalid="ignore"):
                    at = d / (np.nan if top is None else top) * bins
                # a distance that isn't known falls into the last bin, as least() puts it
                at = np.where(np.isnan(at), bins - 1, np.minimum(at, bins - 1)).astype(np.int64)
                m, c = np.abs(a["v"][:, None] - b["v"]), a["c"][:, None] * b["c"]
                if r["tile_i"] == r["tile_j"]:
                    # each pair once, and equal points with each other
                    c = np.triu(c, 1) + np.diag(a["c"] * (a["c"] - 1) / 2)
                got = work(at, fa, fb, m, c)
                total = got if total is None else total.add(got, fill_value=0)
        if total is not None:
            yield pd.DataFrame({"bin": total.index.get_level_values(0), "k": total.index.get_level_values(1), "w": total["w"].to_numpy(), "c": total["c"].to_numpy()})

    both = _sided(_spread(tiles, "tile"), "i").join(_sided(tiles, "j"), F.col("tile_i") <= F.col("tile_j"))
    return _spread(both, "tile_i", "tile_j").mapInPandas(run, "bin long, k double, w double, c double")


def _by_place(values, fa, fb):
    import numpy as np

    return np.add.reduceat(np.add.reduceat(values, fb, 1), fa, 0).ravel()


def _roots(at, fa, fb, m, c):
    """Sums of square roots, and numbers of pairs."""
    import numpy as np
    import pandas as pd

    n = np.bincount(at.ravel(), _by_place(c, fa, fb))
    w = np.bincount(at.ravel(), _by_place(np.sqrt(m) * c, fa, fb))
    bins = np.flatnonzero(n)
    return pd.DataFrame({"w": w[bins], "c": n[bins]}, index=pd.MultiIndex.from_arrays([bins, np.zeros(len(bins))], names=["bin", "k"]))


def _quantiles(tiles: DataFrame, top: float | None, bins: int, share: float) -> dict[int, float]:
    """The exact quantile of the differences of each bin, between ranks linearly. Each pass counts differences below a bracket of each bin and in CELLS parts of it;
    the part that holds the rank, and those beside it, are the next bracket, until few differences are within, which the last pass counts value by value."""
    import numpy as np
    import pandas as pd

    ends = tiles.select(F.array_min("v").alias("lo"), F.array_max("v").alias("hi")).agg(F.min("lo"), F.max("hi")).first()
    if ends[0] is None:
        return {}
    far = (ends[1] - ends[0]) * (1 + 1e-9) + 1e-9
    lo, hi, totals, last = np.zeros(bins), np.full(bins, far), {}, False

    def counter(low: np.ndarray, high: np.ndarray, one_by_one: bool):
        def work(at, fa, fb, m, c):
            def spread(x):
                return np.repeat(np.repeat(x, np.diff(np.r_[fb, m.shape[1]]), 1), np.diff(np.r_[fa, m.shape[0]]), 0)

            below = m < spread(low[at])
            under = np.bincount(at.ravel(), _by_place(np.where(below, c, 0.0), fa, fb), bins)
            inside = np.flatnonzero(~below & (m <= spread(high[at])) & (c > 0))
            at_in, m_in, c_in = spread(at).ravel()[inside], m.ravel()[inside], c.ravel()[inside]
            if one_by_one:
                got = pd.DataFrame({"bin": at_in, "k": m_in, "c": c_in}).groupby(["bin", "k"])[["c"]].sum().reset_index()
            else:
                k = np.clip(np.floor((m_in - low[at_in]) / (high - low)[at_in] * CELLS), 0, CELLS - 1).astype(np.int64)
                n = np.bincount(at_in * CELLS + k, c_in, bins * CELLS)
                some = np.flatnonzero(n)
                got = pd.DataFrame({"bin": some // CELLS, "k": (some % CELLS).astype(float), "c": n[some]})
            # what lies below a bracket is counted as part -1
            less = pd.DataFrame({"bin": np.arange(bins), "k": -1.0, "c": under})
            return pd.concat([got, less[less["c"] > 0]]).set_index(["bin", "k"]).assign(w=0.0)

        return work

    for turn in range(64):
        counts = _blocks(tiles, top, bins, counter(lo.copy(), hi.copy(), last)).groupBy("bin", "k").agg(F.sum("c").alias("c")).toPandas()  # a few thousand a bin
        out, within_brackets = {}, 0.0
        for b, rows in counts.sort_values(["bin", "k"]).groupby("bin"):
            under, rows = rows.loc[rows["k"] < 0, "c"].sum(), rows[rows["k"] >= 0]
            k, upto = rows["k"].to_numpy(), under + rows["c"].cumsum().to_numpy()
            rank = (totals.setdefault(b, upto[-1]) - 1) * share
            first, second = (k[np.searchsorted(upto, r, "right")] for r in (np.floor(rank), np.ceil(rank)))
            out[b] = first + (second - first) * (rank - np.floor(rank))
            if not last:
                part = (hi[b] - lo[b]) / CELLS
                within_brackets += rows.loc[(rows["k"] >= first - 1) & (rows["k"] <= second + 1), "c"].sum()
                lo[b], hi[b] = max(lo[b], lo[b] + (first - 1) * part), min(hi[b], lo[b] + (second + 2) * part)
        if last:
            return out
        last = within_brackets <= FEW or turn == 62 or float((hi - lo)[list(totals)].max(initial=0.0)) < 1e-12 * far


def fitted_variogram(bins: list[tuple[float, float, float]], kind: str = "spherical") -> tuple[float, float, float]:
    """(nugget, sill, range) by weighted least squares: a grid over ranges, nugget and sill solved for each. A few bins on the driver."""
    import numpy as np

    h, g, w = (np.array(x, float) for x in zip(*bins, strict=True))
    best = (float("inf"), 0.0, 1.0, 1.0)
    for reach in np.linspace(h.max() / 20, 2 * h.max(), 80):
        s = shape(kind, h, reach)
        a = np.stack([1 - s, s], axis=1) * np.sqrt(w)[:, None]
        sol, *_ = np.linalg.lstsq(a, g * np.sqrt(w), rcond=None)
        nugget, sill = max(0.0, sol[0]), max(1e-12, sol[1])
        err = float((w * (nugget * (1 - s) + sill * s - g) ** 2).sum())
        if err < best[0]:
            best = (err, nugget, sill, float(reach))
    return best[1:]


def shape(kind: str, h, reach: float):
    import numpy as np

    r = h / reach
    return {"spherical": np.where(r <= 1, 1.5 * r - 0.5 * r**3, 1.0), "exponential": 1 - np.exp(-3 * r), "gaussian": 1 - np.exp(-3 * r**2)}[kind]


def places(points: DataFrame, key: str, x: str = "x", y: str = "y", v: str = "v") -> DataFrame:
    """(k, x, y, v, n): one row per place, with its least key, mean value and number of values. Points without a place or a value don't count."""
    known = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(v).isNotNull())
    return known.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.min(key).alias("k"), F.avg(v).alias("v"), F.count(F.lit(1)).alias("n")).select("k", "x", "y", "v", "n")


def neighbourhood_system(x, y, v, n, at, model: tuple[str, float, float, float], kind: str = "ordinary", mean: float = 0.0) -> tuple[float, float]:
    """(estimate, variance) at a place from its neighbours: ordinary, simple (a known mean) or universal (a linear drift) kriging. A neighbour that is the mean of n
    values has an n-th of the nugget."""
    import numpy as np

    name, nugget, sill, reach = model

    def gamma(h):
        return np.where(h > 0, nugget + (sill - nugget) * shape(name, h, reach), 0.0)

    m = len(x)
    k, to = gamma(np.hypot(x[:, None] - x, y[:, None] - y)) + np.diag(nugget * (1 - 1 / n)), gamma(np.hypot(x - at[0], y - at[1]))
    if kind == "simple":
        w = np.linalg.lstsq(sill - k, sill - to, rcond=None)[0]
        return float(mean + w @ (v - mean)), float(max(0.0, sill - w @ (sill - to)))
    # the drift is taken about the place itself, in units of the range
    f = np.stack([np.ones(m), (x - at[0]) / reach, (y - at[1]) / reach], 1) if kind == "universal" else np.ones((m, 1))
    a = np.block([[k, f], [f.T, np.zeros((f.shape[1], f.shape[1]))]])
    b = np.concatenate([to, [1.0], np.zeros(f.shape[1] - 1)])
    w = np.linalg.lstsq(a, b, rcond=None)[0]
    return float(w[:m] @ v), float(max(0.0, w @ b))


def kriged_near(at: DataFrame, targets: DataFrame, model: tuple[str, float, float, float], k: int = 16, strict: bool = False, kind: str = "ordinary", mean: float = 0.0) -> DataFrame:
    """(target, estimate, variance): ordinary (or simple, or universal) kriging of every target (target, x, y) from its k nearest places (see `places`), the moving neighbourhood:
    each target is a system of k + 1 equations, whatever the number of places. With `strict` a place of the target's own id doesn't count
    (leave one out). Targets without coordinates, and all targets if there is no place, have no row."""
    import numpy as np
    import pandas as pd

    near = nearest_on_grid(targets.withColumnRenamed("target", "q"), at.withColumnRenamed("k", "donor"), k, strict=strict)
    near = near.join(at.withColumnRenamed("k", "donor"), "donor").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "x", "y", "v", "n"))).alias("r"))  # at most k
    rows = near.join(targets.select(F.col("target").alias("q"), F.col("x").alias("tx"), F.col("y").alias("ty")), "q")
    rows = rows.select(F.col("q").alias("target"), "tx", "ty", *(F.col("r")[c].cast("array<double>").alias(c) for c in ("x", "y", "v", "n")))

    def solve(parts):
        for pdf in parts:
            out = [neighbourhood_system(*(np.asarray(r[c], float) for c in ("x", "y", "v", "n")), (r["tx"], r["ty"]), model, kind, mean) for r in pdf.to_dict("records")]
            yield pd.DataFrame({"target": pdf["target"], "estimate": [e for e, _ in out], "variance": [e for _, e in out]})

    return rows.mapInPandas(solve, f"target {dict(targets.dtypes)['target']}, estimate double, variance double")


def trans_gaussian(points: DataFrame, key: str, model: tuple[str, float, float, float], k: int = 16, x: str = "x", y: str = "y", v: str = "v") -> DataFrame:
    """(target, estimate): every place kriged from the others on ln(v - least + 1), and back with the lognormal's mean."""
    least = points.agg(F.min(v).alias("least__"))
    shifted = points.crossJoin(F.broadcast(least)).withColumn(v, F.log(F.col(v) - F.col("least__") + 1)).drop("least__")  # one row
    at = places(shifted, key, x, y, v)
    e = kriged_near(at, at.withColumnRenamed("k", "target"), model, k, strict=True).crossJoin(F.broadcast(least))
    return e.select("target", (F.exp(F.col("estimate") + F.col("variance") / 2) + F.col("least__") - 1).alias("estimate"))


def block_variogram(at: DataFrame, corner: tuple[float, float], side: float, model: tuple[str, float, float, float], cells: int = 4) -> DataFrame:
    """(k, gamma, within): the mean semivariance between each place and a square block, and within the block, over the centres of cells x cells parts."""
    name, nugget, sill, reach = model
    steps = [(c + 0.5) * side / cells for c in range(cells)]
    centres = [(corner[0] + a, corner[1] + b) for a in steps for b in steps]

    def mean(px, py):
        h = [F.sqrt(F.pow(px - F.lit(cx), F.lit(2)) + F.pow(py - F.lit(cy), F.lit(2))) for cx, cy in centres]
        return F.aggregate(F.array(*h), F.lit(0.0), lambda s, d: s + variogram(name, d, nugget, sill, reach)) / len(centres)

    inside = sum((mean(F.lit(cx), F.lit(cy)) for cx, cy in centres), F.lit(0.0)) / len(centres)
    return at.select("k", mean(F.col("x"), F.col("y")).alias("gamma"), inside.alias("within"))


def cross_validated(at: DataFrame, model: tuple[str, float, float, float], k: int = 16) -> DataFrame:
    """One row: rmse, mae, r2 and the share within 1.96 kriging deviations, every place kriged from the others."""
    e = kriged_near(at, at.withColumnRenamed("k", "target"), model, k, strict=True).join(at.select(F.col("k").alias("target"), "v"), "target")
    d = F.col("estimate") - F.col("v")
    inside = (F.abs(d) <= 1.96 * F.sqrt("variance")).cast("int")
    return e.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), (1 - F.avg(d * d) / F.var_pop("v")).alias("r2"), F.avg(inside).alias("coverage"))


def moran(points: DataFrame, key: str, threshold: float, x: str = "x", y: str = "y", v: str = "v") -> DataFrame:
    """One row: Moran's I and Geary's C with weights 1 / d within the threshold, from pairs of places with moments."""
    one = points.agg(F.avg(v).alias("mean__"), F.var_pop(v).alias("s2__"), F.count(v).alias("n__"))
    e = _counted(_near_places(moments(points, key, x, y, v), threshold)).withColumn("d", _apart()).filter((F.col("d") > 0) & (F.col("d") < threshold))
    e = e.crossJoin(F.broadcast(one)).withColumn("w", 1 / F.col("d"))  # one row
    n, s2 = F.first("n__"), F.first("s2__")
    both = F.when(F.col("c") > 0, F.col("w") * F.col("c") * (F.col("m_i") - F.col("mean__")) * (F.col("m_j") - F.col("mean__")))
    weight = F.sum(F.col("w") * F.col("n"))
    return e.agg((F.sum(both) / weight / s2).alias("moran"), ((n - 1) * F.sum(F.when(F.col("c") > 0, F.col("w") * F.col("q"))) / (2 * weight * n * s2)).alias("geary"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))


def delaunay(stations: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """Edges (i, j) of the Delaunay triangulation (Bowyer-Watson, in one group: a station table)."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.drop_duplicates(["x", "y"]).sort_values("k")
        pts = p[["x", "y"]].to_numpy(float)
        n = len(pts)
        if n < 3:
            return pd.DataFrame({"i": p["k"].iloc[:-1].to_numpy(), "j": p["k"].iloc[1:].to_numpy()}).astype("int64")
        c, r = pts.mean(axis=0), 1e3 * (np.ptp(pts, axis=0).max() or 1)
        v = np.vstack([pts, c + [[-r, -r], [r, -r], [0, 2 * r]]])

        def circle(t):
            a, b, d = v[list(t)]
            m = 2 * np.array([b - a, d - a])
            o = np.linalg.solve(m, [b @ b - a @ a, d @ d - a @ a])
            return o, ((a - o) ** 2).sum()

        tri = {(n, n + 1, n + 2): circle((n, n + 1, n + 2))}
        for q in range(n):
            bad = [t for t, (o, r2) in tri.items() if ((v[q] - o) ** 2).sum() < r2]
            edges: dict = {}
            for t in bad:
                for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                    e = tuple(sorted(e))
                    edges[e] = edges.get(e, 0) + 1
                del tri[t]
            for e, times in edges.items():
                if times == 1:
                    t = (*e, q)
                    try:
                        tri[t] = circle(t)
                    except np.linalg.LinAlgError:
                        continue
        found = sorted({tuple(sorted(e)) for t in tri for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])) if max(e) < n})
        k = p["k"].to_numpy()
        return pd.DataFrame([(min(k[a], k[b]), max(k[a], k[b])) for a, b in found], columns=["i", "j"])

    one = stations.select(F.lit(0).alias("g"), F.col(key).cast("long").alias("k"), F.col(x).alias("x"), F.col(y).alias("y"))
    return one.groupBy("g").applyInPandas(run, "i long, j long")


def inverse_distance(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(k, estimate): neighbours' values weighted by 1 / (d + 1e-6)."""
    both = edges.select("i", "j", "d").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    w = 1 / (F.col("d") + 1e-6)
    n = both.join(values.select(F.col("k").alias("j"), "v"), "j").filter("v is not null")
    return n.groupBy(F.col("i").alias("k")).agg((F.sum(w * F.col("v")) / F.sum(w)).alias("estimate"))


__all__ = ["block_variogram", "cross_validated", "delaunay", "distances", "fitted_variogram", "inverse_distance", "kriged_near", "moran", "nearest_on_grid", "pairs", "places", "semivariogram", "trans_gaussian", "variogram", "within"]
