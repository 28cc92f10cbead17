"""Hard-negative mining by a Voronoi-partition distributed kNN join.

Anchors' best positives (same label) and then, for each positive, the best negatives in a window of scores are nearest neighbours by inner product. With one more
component, sqrt(M^2 - |x|^2) for rows (M: the largest norm) and 0 for anchors, a larger inner product is a smaller distance, so that the triangle inequality
holds: d(q, x)^2 = |q|^2 + M^2 - 2 q.x.

Rows go to the nearest of some pivots (rows themselves), and each task gathers its rows of a cell in blocks of at most BLOCK, with their distances to the pivot. Anchors
go to groups of at most GROUP of one cell. An anchor's k-th best score among PROBES rows is a bound on its k-th best of all (a window of scores gives one too),
hence on the distance theta of all that it needs. A group then needs of a cell only rows whose distance to the pivot lies within theta of an anchor's (for scores
below a ceiling also: not too near by), and nothing of cells whose border is farther than theta. Only blocks with such rows meet the group; the
rows' products are exact, and a task keeps for each anchor what may still be among its first k. Where vectors point everywhere, bounds exclude little and
all blocks meet all groups: anchors are a stated query set, compared block by block, never as one group.

Defined results: rows with a null id, a null label, a null vector or a null or non-finite component take no part; shorter vectors end in zeros; labels are whole
numbers; ties go to the smaller id; rows repeated with one id are rows of their own (an anchor counts once for each different row), and no row with the anchor's id
is its positive or negative; an anchor without positives or without rows in the window has no result; an empty table gives an empty result; components so
large that an inner product could pass 64 bits raise; extra columns aren't read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import arrow_schema, matrix, products, small_batches, whole_numbers

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
PROBES, PIVOTS, BLOCK, GROUP, WAITING, SALTS = 1024, 256, 1024, 128, 1 << 15, 8
#: Groups whose bounds a task remembers; forgetting one only costs rows that the last ranking drops.
REMEMBERED = 1 << 12


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in two bytes each where all fit, else in eight."""
    return x.astype("<i2" if len(x) and np.abs(x).max(initial=0) < 1 << 15 else "<i8").tobytes()


def unpacked(raw: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if len(raw) == 2 * n * width and n * width else "<i8").reshape(n, width).astype(np.int64)


class Space:
    """Pivots and probes (rows of the table, a bounded number) and the largest squared norm."""

    def __init__(self, probes: np.ndarray, ids: np.ndarray, labels: np.ndarray, n_pivots: int, top: float):
        self.probes, self.ids, self.labels, self.top, self.width = probes, ids, labels, top, probes.shape[1]
        self.pivots = probes[:n_pivots]
        self.raised = self.added(self.pivots)
        inner = products(self.pivots, self.pivots) + np.outer(self.raised, self.raised)
        self.between = np.sqrt(np.maximum(2 * top - 2 * inner, 0))

    def added(self, x: np.ndarray) -> np.ndarray:
        """The further component of rows."""
        return np.sqrt(np.maximum(self.top - (x.astype(np.float64) ** 2).sum(1), 0))

    def of_rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's cell and its distance to the cell's pivot."""
        inner = products(x, self.pivots) + np.outer(self.added(x), self.raised)
        cell = inner.argmax(1)
        return cell, np.sqrt(np.maximum(2 * self.top - 2 * inner[np.arange(len(x)), cell], 0))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        """Distances of anchors to all pivots."""
        return np.sqrt(np.maximum((q.astype(np.float64) ** 2).sum(1)[:, None] + self.top - 2 * products(q, self.pivots), 0))

    def windows(self, q: np.ndarray, least: np.ndarray, most: np.ndarray) -> list[tuple[int, float, float]]:
        """(cell, lo, hi): which distances to their pivot rows may have that score between least and most with an anchor of this group (one row of q for each
        pair of bounds)."""
        norm, d = (q.astype(np.float64) ** 2).sum(1) + self.top, self.of_anchors(q)
        slack = 1e-6 * (1 + np.sqrt(self.top))
        theta = np.sqrt(np.maximum(norm - 2 * least, 0))[:, None] + slack
        alpha = np.where(np.isinf(most), 0, np.sqrt(np.maximum(norm - 2 * np.where(np.isinf(most), 0, most), 0)))[:, None] - slack
        own = d.argmin(1)
        gap = self.between[own]
        border = np.where(gap > 0, (d**2 - d[np.arange(len(q)), own][:, None] ** 2) / np.where(gap > 0, 2 * gap, 1), 0)
        needed = (border <= theta) & (theta >= alpha)
        lo = np.where(needed, np.maximum(d - theta, alpha - d), np.inf).min(0, initial=np.inf)
        hi = np.where(needed, d + theta, -np.inf).max(0, initial=-np.inf)
        return [(j, float(lo[j]), float(hi[j])) for j in np.flatnonzero(needed.any(0)).tolist()]


def first_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by smaller id."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def spanned(rows: DataFrame) -> Space | None:
    """Counts, norms and probes of rows (vec_id, label, v)."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, width, top = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(square)).first()
    if not n:
        return None
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(PROBES).collect()
    probes = np.array([list(r.v) + [0] * (width - len(r.v)) for r in got], np.int64).reshape(len(got), width)
    pivots = min(max(round(n**0.5 / 8), 1), PIVOTS, len(got))
    return Space(probes, np.array([r.vec_id for r in got]), np.array([r.label for r in got]), pivots, top * (1 + 1e-9) + 1e-9)


def blocks_of(rows: DataFrame, space: Space) -> DataFrame:
    """Rows in blocks of one cell, gathered within each task."""
    ddl = "block bigint, cell int, near double, far double, ids array<bigint>, labels array<bigint>, x binary, d array<double>"
    schema = arrow_schema(ddl)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        cells, total, number = {}, 0, TaskContext.get().partitionId() << 32

        def out(c):
            ids, labels, x, d = (np.concatenate(a) for a in zip(*cells.pop(c), strict=True))
            return pa.RecordBatch.from_pylist([{"block": number, "cell": c, "near": d.min(), "far": d.max(), "ids": ids, "labels": labels, "x": packed(x), "d": d}], schema=schema)

        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = matrix(part["v"], space.width)
                cell, d = space.of_rows(x)
                ids, labels = (part[c].to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
                for c in np.unique(cell).tolist():
                    m = cell == c
                    cells.setdefault(c, []).append((ids[m], labels[m], x[m], d[m]))
                    if sum(len(p[0]) for p in cells[c]) >= BLOCK:
                        total -= sum(len(p[0]) for p in cells[c][:-1])
                        yield out(c)
                        number += 1
                    else:
                        total += int(m.sum())
                while total > WAITING:
                    c = max(cells, key=lambda c: sum(len(p[0]) for p in cells[c]))
                    total -= sum(len(p[0]) for p in cells[c])
                    yield out(c)
                    number += 1
        for c in list(cells):
            yield out(c)
            number += 1

    return rows.mapInArrow(run, ddl)


def groups_of(anchors: DataFrame, space: Space, positives: int) -> DataFrame:
    """Anchors in groups of one cell, with the windows for their first `positives` rows of the same label."""
    kept = "vec_id bigint, label bigint, v array<bigint>, cell int"
    schema, ddl = arrow_schema(kept), "grp bigint, ids array<bigint>, labels array<bigint>, x binary, windows array<struct<cell:int,lo:double,hi:double>>"
    schema2 = arrow_schema(ddl)

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                cell = space.of_anchors(matrix(part["v"], space.width)).argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32())], schema=schema)

    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        number, now, waiting = TaskContext.get().partitionId() << 32, None, []

        def out():
            ids, labels, q = (np.concatenate(a) for a in zip(*waiting, strict=True))
            inner = products(q, space.probes).astype(np.float64)
            inner[(labels[:, None] != space.labels) | (ids[:, None] == space.ids)] = -np.inf
            least = np.partition(inner, -positives, axis=1)[:, -positives] if inner.shape[1] >= positives else np.full(len(q), -np.inf)
            windows = [{"cell": c, "lo": lo, "hi": hi} for c, lo, hi in space.windows(q, least, np.full(len(q), np.inf))]
            return pa.RecordBatch.from_pylist([{"grp": number, "ids": ids, "labels": labels, "x": packed(q), "windows": windows}], schema=schema2)

        for b in batches:
            cells, salts = b["cell"].to_numpy(), b["salt"].to_numpy()
            ids, labels, x = b["vec_id"].to_numpy(), b["label"].to_numpy(), matrix(b["v"], space.width)
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(salts) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)], strict=True):
                at = lo
                while at < hi:
                    key, have = (int(cells[at]), int(salts[at])), sum(len(w[0]) for w in waiting)
                    if waiting and (key != now or have >= GROUP):
                        yield out()
                        number, waiting, have = number + 1, [], 0
                    now, stop = key, min(hi, at + GROUP - have)
                    waiting.append((ids[at:stop], labels[at:stop], x[at:stop]))
                    at = stop
        if waiting:
            yield out()

    placed = stored(anchors.mapInArrow(place, kept), "anchors")
    # one row for each pivot, a bounded number
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("salts"))
    salted = placed.join(F.broadcast(sizes), "cell").withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), F.col("salts")).cast("int"))
    return salted.drop("salts").repartition("cell", "salt").sortWithinPartitions("cell", "salt").mapInArrow(gather, ddl)


def met(groups: DataFrame, blocks: DataFrame, columns: list[str]) -> DataFrame:
    """Each group with each block that its windows need: the group's columns and the block's."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    windows = groups.select("grp", F.inline("windows")).select("grp", "cell", "lo", "hi", salt.alias("salt"))
    places = blocks.select("block", "cell", "near", "far", F.pmod(F.col("block"), F.lit(SALTS)).cast("int").alias("salt"))
    pairs = windows.join(places, ["cell", "salt"]).filter("near <= hi AND far >= lo").select("grp", "block", "lo", "hi")
    data = blocks.select("block", F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"), F.col("x").alias("b_x"), "d")
    return pairs.join(groups.select("grp", *columns), "grp").join(data, "block").drop("block")


def _wanted(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and products with the group's anchors of those rows of a block that the group's window takes in."""
    d = np.asarray(row["d"])
    m = (d >= row["lo"]) & (d <= row["hi"])
    ids, labels = np.asarray(row["b_ids"], np.int64)[m], np.asarray(row["b_labels"], np.int64)[m]
    return ids, labels, products(unpacked(row["x"], len(row["ids"]), width), unpacked(row["b_x"], len(m), width)[m])


class Bounds:
    """The k-th best scores so far of a group's anchors: nothing below can be among the first k."""

    def __init__(self):
        self.of: OrderedDict[int, dict] = OrderedDict()

    def group(self, name: int) -> dict:
        found = self.of.pop(name, {})
        self.of[name] = found
        if len(self.of) > REMEMBERED:
            self.of.popitem(last=False)
        return found


def candidates(pairs: DataFrame, width: int, k: int, windowed: bool) -> DataFrame:
    """(grp, nth, pos, id, score) of what may be among the first k: of the same label (pos 0), or of other labels in each positive's window of scores."""
    ddl = "grp bigint, nth int, pos int, id bigint, score bigint"
    schema = arrow_schema(ddl)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        best = Bounds()
        for b in batches:
            out = []
            for at in range(b.num_rows):
                row = b.slice(at, 1).to_pylist()[0]
                ids, labels, scores = _wanted(row, width)
                seen = best.group(row["grp"])
                asked = [(p["nth"], p["pos"], p["least"], p["most"]) for p in row["asked"]] if windowed else [(n, 0, None, None) for n in range(len(row["ids"]))]
                for n, pos, least, most in asked:
                    s = scores[n]
                    m = (ids != row["ids"][n]) & ((labels != row["labels"][n]) if windowed else (labels == row["labels"][n]))
                    if windowed:
                        m &= (s >= least) & (s <= most)
                    old = seen.get((n, pos))
                    if old is not None and len(old) == k:
                        m &= s >= old[-1]
                    where = np.flatnonzero(m)
                    if not len(where):
                        continue
                    where = where[first_of(s[where], ids[where], k)]
                    seen[n, pos] = np.sort(np.concatenate([s[where], old]) if old is not None else s[where])[::-1][:k]
                    out.append((np.full(len(where), n), np.full(len(where), pos), ids[where], s[where], np.full(len(where), row["grp"])))
            if out:
                n, pos, i, s, g = (np.concatenate(a) for a in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(n, pa.int32()), pa.array(pos, pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], schema=schema)

    return pairs.mapInArrow(run, ddl)


def ranked(rows: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("grp", "nth", "pos").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def asked_of(groups: DataFrame, found: DataFrame, space: Space, negatives: int, low: int, high: int) -> DataFrame:
    """Groups with what their anchors ask for each positive (bounds of whole scores), and windows for that."""
    # at most GROUP x positives in a list
    lists = found.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("nth", F.col("rank").alias("pos"), "score"))).alias("p"))
    ddl = "grp bigint, ids array<bigint>, labels array<bigint>, x binary, windows array<struct<cell:int,lo:double,hi:double>>, asked array<struct<nth:int,pos:int,least:bigint,most:bigint>>"
    schema = arrow_schema(ddl)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for at in range(b.num_rows):
                row = b.slice(at, 1).to_pylist()[0]
                q, ids, labels = unpacked(row["x"], len(row["ids"]), space.width), np.array(row["ids"]), np.array(row["labels"])
                inner = products(q, space.probes)
                asked, least, most, who = [], [], [], []
                for p in row["p"]:
                    n, score = p["nth"], p["score"]
                    lo, hi = -(-low * score // 100), high * score // 100
                    if lo > hi:
                        continue
                    asked.append({"nth": n, "pos": p["pos"], "least": lo, "most": hi})
                    s = inner[n][(space.labels != labels[n]) & (space.ids != ids[n])]
                    s = s[(s >= lo) & (s <= hi)]
                    least.append(max(lo, np.partition(s, len(s) - negatives)[len(s) - negatives]) if len(s) >= negatives else lo)
                    most.append(hi)
                    who.append(n)
                windows = [{"cell": c, "lo": lo, "hi": hi} for c, lo, hi in space.windows(q[who], np.array(least, float), np.array(most, float))] if who else []
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("grp", "ids", "labels", "x")} | {"windows": windows, "asked": asked}], schema=schema)

    return groups.select("grp", "ids", "labels", "x").join(lists, "grp").mapInArrow(run, ddl)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """For each anchor and each of its first positives, the first negatives whose score is between low and high percent of the positive's. rows and anchors: vec_id,
    label, v (whole numbers); anchors are rows too."""
    spark = rows.sparkSession
    empty = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    space = spanned(rows)
    if space is None:
        return spark.createDataFrame([], empty)
    blocks = stored(blocks_of(rows, space), "cells")
    groups = stored(groups_of(anchors.dropDuplicates(), space, positives), "groups")
    with small_batches(spark):
        near = candidates(met(groups, blocks, ["ids", "labels", "x"]), space.width, positives, False)
        found = stored(ranked(near, positives), "positives")
        wanted = stored(asked_of(groups, found, space, negatives, low, high), "asked")
        far = stored(candidates(met(wanted, blocks, ["ids", "labels", "x", "asked"]), space.width, negatives, True), "negatives")
    names = groups.select("grp", F.posexplode("ids").alias("nth", "anchor_id"))
    of = found.select("grp", "nth", F.col("rank").alias("pos"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, ["grp", "nth"])
    out = ranked(far, negatives).join(of, ["grp", "nth", "pos"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_voronoi_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the embeddings whose id is divisible by 100."""
    rows = whole_numbers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).filter("label is not null and vec_id is not null")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("bigint")
    rows = rows.select("vec_id", label.alias("label"), "v")
    return hard_negatives(rows, rows.filter("vec_id % 100 = 0"))


#: SQL for op11_voronoi_negatives: all rows against all anchors.
OP11_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
  p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
  n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
