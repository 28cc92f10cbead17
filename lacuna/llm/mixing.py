"""Mixing sources to target weights: Pfair scheduling.

Weights are whole numbers W per source, L in all: in every period of L block slots a source gets W. Its k-th block (from 0) has release
time floor(k L / W) and deadline ceil((k + 1) L / W); in each slot, earliest deadline first among the released blocks. Such a schedule meets
all windows, so that at every moment each source is less than one block away from its weight.

The schedule repeats from period to period, so only one period is worked out (a fold over L slots in one row per run of equal periods); each record then
finds its slot by an equi-join with that table. A source that has fewer than W blocks left in a period gets a period with the blocks it has,
the sum L being smaller then; after that the others go on by their weights. No record is dropped or repeated. There are at most
2 x sources + 1 different periods, and all their slots together are no more than the blocks. A fold takes time in proportion to L times its sources.
Every source has a weight, a release and a deadline of its own, however many there are. L is `period`, or more where the smallest weight would be below 1.

Records are numbered within a source by buckets (a hash of the id) whose sizes are counted first; there are so many that the largest source
has about BUCKET_ROWS rows in each: a source with a third of all rows is never sorted in one task.

Defined results: a null source is the source '' ; only if max_sources is given, sources beyond it (fewest rows, ties by name) share one entry, '*', with
their summed weight; weights of 0 or less and missing weights count as the smallest step, 1; repeated rows keep places of their own; an empty table gives an
empty result; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

PERIOD, BUCKET_ROWS, TEMPERATURE, CHUNK = 1000, 20_000, 0.5, 256


def numbered(docs: DataFrame, max_sources: int | None = None, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, h, named, bucket, nth in the bucket, and the columns to keep; offsets of the buckets of each name; sources: named, source, n).
    The rows keep a hash of the text as the last tie-break."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("named"), F.xxhash64("text").alias("h"), *keep)
    largest = rows.groupBy("named").count().agg(F.max("count")).first()[0] or 0
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(1 + largest // BUCKET_ROWS)).cast("int"))
    counts = stored(rows.groupBy("named", "bucket").count(), "mix-counts")
    if max_sources is None:
        counts = counts.withColumn("source", F.col("named"))
    else:
        largest = counts.groupBy("named").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "named").limit(max_sources).select("named", F.col("named").alias("source"))
        counts = counts.join(F.broadcast(largest), "named", "left").withColumn("source", F.coalesce("source", F.lit("*")))
    # rows of each bucket that stand before: sources x buckets rows at most
    before = Window.partitionBy("source").orderBy("bucket", "named").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("named", "bucket", "source", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("named", "bucket").orderBy("doc_id", "h")
    return rows.withColumn("nth", F.row_number().over(inside) - 1), offsets, counts.groupBy("named", "source").agg(F.sum("count").alias("n"))


def weighted(sources: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, period: int = PERIOD) -> DataFrame:
    """(source, n, w) with whole weights, of a sum of `period` (or as much as gives the smallest weight 1) but for rounding. Without weights, shares
    go by n ** temperature; names that share an entry add up."""
    given = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v))))) if weights else None
    raw = F.greatest(F.coalesce(F.element_at(given, F.col("named")), F.lit(0.0)), F.lit(0.0)) if weights else F.pow(F.col("n"), F.lit(temperature))
    sources = sources.withColumn("raw", raw).groupBy("source").agg(F.sum("n").alias("n"), F.sum("raw").alias("raw"))
    total = sources.agg(F.sum("raw").alias("total"), F.min(F.when(F.col("raw") > 0, F.col("raw"))).alias("least"))
    slots = F.greatest(F.lit(float(period)), F.ceil(F.round(F.col("total") / F.col("least"), 6)).cast("double"))
    return sources.crossJoin(F.broadcast(total)).select("source", "n", F.greatest(F.lit(1), F.round(F.coalesce(F.col("raw") / F.col("total") * slots, F.lit(0.0)))).cast("long").alias("w"))


def periods(sources: DataFrame, block: int = 1) -> DataFrame:
    """Runs of equal periods: first period and the one after the last, the position (in blocks) of the first, and the weight of each source in them.
    One row per run with the sources that still have blocks."""
    blocks = sources.select("source", "w", F.ceil(F.col("n") / block).cast("long").alias("b")).withColumn("full", F.expr("b div w")).withColumn("left", F.col("b") % F.col("w"))
    edges = blocks.select(F.explode(F.array(F.lit(0).cast("long"), "full", F.col("full") + 1)).alias("p0")).distinct()
    ends = edges.withColumn("p1", F.lead("p0").over(Window.partitionBy(F.lit(0)).orderBy("p0")))
    weight = F.when(F.col("p0") < F.col("full"), F.col("w")).otherwise(F.col("left"))
    cells = ends.join(blocks, F.col("p0") <= F.col("full")).withColumn("weight", weight).filter("weight > 0")
    runs = cells.groupBy("p0", "p1").agg(F.sum("weight").alias("length"), F.sort_array(F.collect_list(F.struct("source", F.col("weight").alias("w")))).alias("who"))
    runs = stored(runs, "mix-lengths")
    before = Window.partitionBy(F.lit(0)).orderBy("p0").rowsBetween(Window.unboundedPreceding, -1)
    base = runs.select("p0", F.coalesce(F.sum((F.col("p1") - F.col("p0")) * F.col("length")).over(before), F.lit(0)).alias("base"))
    return runs.join(base, "p0")


def schedule(runs: DataFrame) -> DataFrame:
    """Slots of one period of each run: p0, source, w, k (block within the period), at, release, deadline. The slots
    found are gathered CHUNK at a time."""
    pick = """array_min(transform(who, (x, i) -> IF(s.done[i] < x.w AND (s.done[i] * length) div x.w <= t,
                named_struct('deadline', ((s.done[i] + 1) * length) div x.w + IF(((s.done[i] + 1) * length) % x.w = 0, 0, 1), 'i', i), NULL)))"""
    some = f"""aggregate(sequence(c * {CHUNK}, least(length, (c + 1) * {CHUNK}) - 1), named_struct('done', a.done, 'out', cast(array() as array<struct<i:int,k:bigint,at:bigint>>)),
        (s, t) -> element_at(transform(array({pick}), p -> named_struct(
            'done', transform(s.done, (d, i) -> d + IF(i = p.i, 1L, 0L)),
            'out', array_append(s.out, named_struct('i', p.i, 'k', s.done[p.i], 'at', t)))), 1))"""
    fold = f"""aggregate(sequence(0L, (length - 1) div {CHUNK}), named_struct('done', transform(who, x -> 0L), 'out', cast(array() as array<array<struct<i:int,k:bigint,at:bigint>>>)),
        (a, c) -> element_at(transform(array({some}), r -> named_struct('done', r.done, 'out', array_append(a.out, r.out))), 1))"""
    slots = runs.select("p0", "length", "who", F.explode(F.expr(f"flatten(({fold}).out)")).alias("x"))
    me = F.get("who", F.col("x.i"))
    return slots.select(
        "p0", me["source"].alias("source"), me["w"].alias("w"), F.col("x.k").alias("k"), F.col("x.at").alias("at"),
        F.expr("(x.k * length) div who[x.i].w").alias("release"), F.ceil((F.col("x.k") + 1) * F.col("length") / me["w"]).cast("long").alias("deadline"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, period: int = PERIOD, block: int = 1, max_sources: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, h, source, weight (in `length` slots), block_no, release, deadline and position (of blocks, over the whole mix) of every record, and the columns
    to keep."""
    records, offsets, sources = numbered(docs, max_sources, keep)
    sources = stored(weighted(sources, weights, temperature, period), "mix-sources")
    runs = stored(periods(sources, block), "mix-runs")
    slots = stored(schedule(runs), "mix-slots")
    # keys of no more than a bucket, a period or a period's block: none is hot
    offsets = offsets.join(sources.select("source", F.col("w").alias("step")), "source")
    rows = records.join(offsets, ["named", "bucket"]).withColumn("block_no", F.expr(f"(first + nth) div {block}"))
    rows = rows.withColumn("period", F.expr("block_no div step")).withColumn("k", F.col("block_no") % F.col("step")).drop("step")
    rows = rows.join(runs.select("p0", "base", "length", F.explode(F.sequence("p0", F.col("p1") - 1)).alias("period")), "period")
    out = rows.join(slots, ["source", "p0", "k"])
    start = F.col("base") + (F.col("period") - F.col("p0")) * F.col("length")
    return out.select("doc_id", "h", F.col("named").alias("source"), F.col("source").alias("mixed_as"), F.col("w").alias("weight"), "length", "block_no", (start + F.col("release")).alias("release"), (start + F.col("deadline")).alias("deadline"), (start + F.col("at")).alias("position"), *keep)


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a mix whose sources' shares go by the square root of their sizes."""
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("h")
