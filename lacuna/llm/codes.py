"""Vector code compression: product quantisation by Lloyd's rounds with heaps (heap Lloyd).

Vectors are cut into equal parts; each part position has a codebook of its own. Rows are gathered, task by task and without a shuffle, into blocks of at
most BLOCK. A block keeps, for each part position and entry, a heap of its parts that have this entry, keyed by lower minus upper bound: the distance to the
second nearest entry less that to the nearest. Each round moves the entries; a part's slack shrinks by what its own entry has moved and by the most that
another one has, and these sums (the cumulative drift) are kept once for each entry. So a round pops only parts whose key the drift has passed, measures
them against all entries anew and pushes them into the heap of their entry; all other parts keep their entry without being looked at. Blocks with
their heaps are written to the shared folder after each round.

The entries' new values come from sums: the first round adds up all parts, later rounds only what popped parts take from one entry to another. Spark adds
these up over blocks; entries x (width + parts) sums, a fixed number, come back.

Bounds are doubles and err by rounding; keys are made smaller by more than that, which costs a few needless pops. Distances that decide anything are whole numbers.

Defined results: rows whose vector is null or has a null or non-finite component are dropped; shorter vectors end in zeros, and the width is rounded up to a
multiple of the parts; rows with a null id are coded but are no first entries; of repeated ids the smaller vector comes first; with fewer rows than
entries the codebook is smaller; an empty table gives an empty result; ties go to the lower index; components so large that a squared distance could pass 64 bits raise; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_join, stored
from .vectors import EXACT, arrow_schema, matrix, whole_numbers, within_64_bits

PARTS, ENTRIES, ROUNDS, BLOCK = 16, 64, 2, 2048


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of parts (n, d) to entries (k, d)."""
    top = max(float(np.abs(x).max(initial=0)), float(np.abs(book).max(initial=0)))
    if 4 * top * top * max(x.shape[1], 1) < EXACT:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    within_64_bits(4 * top * top * max(x.shape[1], 1))
    return sum((x[:, j, None] - book[None, :, j]) ** 2 for j in range(x.shape[1]))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each part's nearest entry, and a key that is surely no larger than (distance to the next one) - (distance to it)."""
    d = squares(x, book)
    at = d.argmin(1)
    if d.shape[1] == 1:
        return at, np.full(len(x), np.inf)
    two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
    return at, two[:, 1] - two[:, 0] - 1e-12 * (two[:, 0] + two[:, 1]) - 1e-9


def moved_sums(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, k: int) -> np.ndarray:
    """(k, d + 1): what each entry gains in components and count when parts go from their old entries to the new ones."""
    out, rows = np.zeros((k, x.shape[1] + 1), np.int64), np.column_stack([x, np.ones(len(x), np.int64)])
    np.add.at(out, new, rows)
    if old is not None:
        np.subtract.at(out, old, rows)
    return out


class Book:
    """The entries (parts, k, d) of all part positions with their cumulative drift (parts, k)."""

    def __init__(self, entries: np.ndarray, drift: np.ndarray | None = None):
        self.entries, self.drift = entries, np.zeros(entries.shape[:2]) if drift is None else drift

    def moved(self, totals: np.ndarray) -> Book:
        """The next entries from sums and counts (parts, k, d + 1): componentwise floor of the mean; unused ones stay."""
        n = totals[..., -1:]
        new = np.where(n > 0, totals[..., :-1] // np.maximum(n, 1), self.entries)
        far = np.sqrt(((new - self.entries).astype(np.float64) ** 2).sum(-1))
        most = np.sort(far, axis=1)
        # the most that another entry has moved
        others = np.where((far == most[:, -1:]) & (np.arange(far.shape[1]) == far.argmax(1)[:, None]), most[:, -2:-1] if far.shape[1] > 1 else 0.0, most[:, -1:])
        return Book(new, (self.drift + far + others) * (1 + 1e-12))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def popped(heaps: list[list[tuple[float, int]]], drift: np.ndarray) -> tuple[list[int], list[int]]:
    """Takes from the heaps of one part position the parts whose key the drift of their entry has passed: their rows and old entries."""
    rows, old = [], []
    for e, heap in enumerate(heaps):
        while heap and heap[0][0] <= drift[e]:
            rows.append(heapq.heappop(heap)[1])
            old.append(e)
    return rows, old


def pack(heaps: list[list[list[tuple[float, int]]]]) -> tuple[bytes, bytes, bytes]:
    """Keys, rows and sizes of all heaps, in heap order."""
    flat = [x for part in heaps for heap in part for x in heap]
    return np.array([k for k, _ in flat], "<f8").tobytes(), np.array([r for _, r in flat], "<u4").tobytes(), np.array([len(heap) for part in heaps for heap in part], "<u4").tobytes()


def unpack(keys: bytes, rows: bytes, sizes: bytes, parts: int) -> list[list[list[tuple[float, int]]]]:
    n = np.frombuffer(sizes, "<u4").reshape(parts, -1).tolist()
    flat = iter(zip(np.frombuffer(keys, "<f8").tolist(), np.frombuffer(rows, "<u4").tolist(), strict=True))
    return [[[next(flat) for _ in range(m)] for m in part] for part in n]


def _first(x: np.ndarray, book: Book) -> tuple[np.ndarray, list, np.ndarray]:
    """Entries of all parts of a block (n, parts, d), their heaps and the sums, all measured."""
    assign, heaps, moved = np.empty(x.shape[:2], np.int32), [], []
    for p in range(x.shape[1]):
        at, key = nearest(x[:, p], book.entries[p])
        assign[:, p], own = at, [[] for _ in range(book.entries.shape[1])]
        for e, item in zip(at.tolist(), zip((key + book.drift[p][at]).tolist(), range(len(x)), strict=True), strict=True):
            own[e].append(item)
        for heap in own:
            heapq.heapify(heap)
        heaps.append(own)
        moved.append(moved_sums(x[:, p], None, at, book.entries.shape[1]))
    return assign, heaps, np.stack(moved)


def _next(x: np.ndarray, assign: np.ndarray, heaps: list, book: Book) -> tuple[np.ndarray, int]:
    """Pops and measures what the drift has passed; assign and heaps change in place. The sums that move, and the number of pops."""
    moved, pops = [], 0
    for p in range(x.shape[1]):
        rows, old = popped(heaps[p], book.drift[p])
        pops += len(rows)
        at, key = nearest(x[rows, p], book.entries[p]) if rows else (np.empty(0, np.int64), np.empty(0))
        for e, k, r in zip(at.tolist(), (key + book.drift[p][at]).tolist(), rows, strict=True):
            heapq.heappush(heaps[p][e], (k, r))
        assign[rows, p] = at
        moved.append(moved_sums(x[rows, p], np.array(old, np.int64), at, book.entries.shape[1]))
    return np.stack(moved), pops


def blocks_of(rows: DataFrame, width: int, book: Book, parts: int, label_type: str) -> DataFrame:
    """The first assignment: rows of each task in blocks of at most BLOCK, with their heaps."""
    ddl = f"ids array<bigint>, labels array<{label_type}>, x binary, assign binary, keys binary, at binary, sizes binary, moved array<bigint>, pops bigint"
    schema = arrow_schema(ddl)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def block(table):
            x = matrix(table["v"].combine_chunks(), width)
            assign, heaps, moved = _first(x.reshape(len(x), parts, -1), book)
            keys, at, sizes = pack(heaps)
            one = {"ids": [table["vec_id"].to_pylist()], "labels": [table["label"].to_pylist()], "x": [x.astype("<i8").tobytes()], "assign": [assign.astype("<i4").tobytes()], "keys": [keys], "at": [at], "sizes": [sizes], "moved": [moved.ravel().tolist()], "pops": [x.shape[0] * parts]}
            return pa.RecordBatch.from_pydict(one, schema=schema)

        waiting, n = [], 0
        for b in batches:
            for start in range(0, b.num_rows, BLOCK):
                waiting.append(part := b.slice(start, BLOCK))
                n += part.num_rows
                if n >= BLOCK:
                    table = pa.Table.from_batches(waiting)
                    yield block(table.slice(0, BLOCK))
                    waiting = table.slice(BLOCK).to_batches()
                    n -= BLOCK
        if n:
            yield block(pa.Table.from_batches(waiting))

    return rows.mapInArrow(run, ddl)


def _state(row: dict, parts: int) -> tuple[np.ndarray, np.ndarray, list]:
    n = len(row["ids"])
    return np.frombuffer(row["x"], "<i8").reshape(n, parts, -1), np.frombuffer(row["assign"], "<i4").reshape(n, parts).copy(), unpack(row["keys"], row["at"], row["sizes"], parts)


def next_round(blocks: DataFrame, book: Book, parts: int) -> DataFrame:
    """The blocks after a round in which only parts that the drift has passed were measured."""
    ddl = ", ".join(f"`{c}` {t}" for c, t in blocks.dtypes)
    schema = arrow_schema(ddl)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                x, assign, heaps = _state(row, parts)
                moved, pops = _next(x, assign, heaps, book)
                keys, at, sizes = pack(heaps)
                row |= {"assign": assign.astype("<i4").tobytes(), "keys": keys, "at": at, "sizes": sizes, "moved": moved.ravel().tolist(), "pops": pops}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return blocks.mapInArrow(run, ddl)


def coded(blocks: DataFrame, book: Book, parts: int) -> DataFrame:
    """(vec_id, label, code array<int>, error): the last assignment, row by row."""
    ddl = f"vec_id bigint, label {dict(blocks.dtypes)['labels'][6:-1]}, code array<int>, error bigint"
    schema = arrow_schema(ddl)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                x, assign, heaps = _state(row, parts)
                _next(x, assign, heaps, book)
                error = ((x - book.entries[np.arange(parts), assign]) ** 2).sum((1, 2))
                yield pa.RecordBatch.from_pydict({"vec_id": row["ids"], "label": row["labels"], "code": assign.tolist(), "error": error.tolist()}, schema=schema)

    return blocks.mapInArrow(run, ddl)


def compressed(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Book | None]:
    """Codes of all rows (vec_id, label, v as in whole_numbers) after so many rounds, and the codebooks (None of an empty table)."""
    spark, label = rows.sparkSession, rows.schema["label"].dataType.simpleString()
    widest = rows.agg(F.max(F.size("v"))).first()[0]
    first = rows.filter("vec_id is not null").orderBy("vec_id", "v").limit(entries).select("v").collect() if widest else []
    if not first:
        return spark.createDataFrame([], f"vec_id bigint, label {label}, code array<int>, error bigint"), None
    width = -(-widest // parts) * parts
    start = np.array([r.v + [0] * (width - len(r.v)) for r in first], np.int64)
    book = Book(np.ascontiguousarray(start.reshape(len(first), parts, -1).swapaxes(0, 1)))
    totals = np.zeros((*book.entries.shape[:2], book.entries.shape[2] + 1), np.int64)
    for k in range(rounds):
        blocks = blocks_of(rows, width, book, parts, label) if k == 0 else next_round(blocks, book, parts)
        blocks = stored(blocks, f"codes-{k}")
        # a fixed number of sums: entries x (width + parts)
        sums = blocks.select(F.posexplode("moved").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
        change = np.zeros(totals.size, np.int64)
        change[[r["at"] for r in sums]] = [r["x"] for r in sums]
        totals = totals + change.reshape(totals.shape)
        book = book.moved(totals)
    if not rounds:
        blocks = stored(blocks_of(rows, width, book, parts, label), "codes-0")
    return coded(blocks, book, parts), book


def op13_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as 16 two-digit codes after two rounds, with errors and the sum of errors of each label."""
    codes, book = compressed(whole_numbers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    code = F.concat_ws("", F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")))
    rows = stored(codes.select("vec_id", code.alias("code"), "error", F.coalesce(F.col("label").cast("string"), F.lit("null")).alias("of")), "codes")
    sums = stored(rows.groupBy("of").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = spread_join(rows, sums.drop("n"), ["of"], sums, total)
    return out.select("vec_id", "code", "error", "label_error", F.lit(book.digest() if book else "").alias("codebooks_sha256"))


#: SQL for op13_heap_lloyd: plain rounds over all pairs of parts and entries.
OP13_SQL = """
WITH r AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, len(embedding) // 16 AS d FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  x AS (SELECT vec_id, p, v[p * d + 1:p * d + d] AS part FROM r, generate_series(0, 15) g(p)),
  s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM r ORDER BY vec_id LIMIT 64),
  c0 AS (SELECT p, e, part AS c FROM x JOIN s USING (vec_id)),
  a0 AS (SELECT vec_id, x.p, any_value(part) AS part, min_by(e, list_sum(list_transform(list_zip(part, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) AS e FROM x JOIN c0 ON x.p = c0.p GROUP BY vec_id, x.p),
  m0 AS (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY k) AS c FROM (SELECT p, e, k, sum(part[k]) AS s, count(*) AS n FROM a0, generate_series(1, 64) g(k) WHERE k <= len(part) GROUP BY p, e, k) GROUP BY p, e),
  c1 AS (SELECT p, e, coalesce(m0.c, c0.c) AS c FROM c0 LEFT JOIN m0 USING (p, e)),
  a1 AS (SELECT vec_id, x.p, any_value(part) AS part, min_by(e, list_sum(list_transform(list_zip(part, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) AS e FROM x JOIN c1 ON x.p = c1.p GROUP BY vec_id, x.p),
  m1 AS (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY k) AS c FROM (SELECT p, e, k, sum(part[k]) AS s, count(*) AS n FROM a1, generate_series(1, 64) g(k) WHERE k <= len(part) GROUP BY p, e, k) GROUP BY p, e),
  c2 AS (SELECT p, e, coalesce(m1.c, c1.c) AS c FROM c1 LEFT JOIN m1 USING (p, e)),
  a2 AS (SELECT vec_id, x.p, min(list_sum(list_transform(list_zip(part, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) AS b FROM x JOIN c2 ON x.p = c2.p GROUP BY vec_id, x.p),
  out AS (SELECT vec_id, string_agg(format('{:02x}', CAST(b % 64 AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(b // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
SELECT out.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c2) AS codebooks_sha256 FROM out JOIN r USING (vec_id)"""
