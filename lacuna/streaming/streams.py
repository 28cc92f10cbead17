"""Structured Streaming: windows with watermarks, stateful fills, file-to-file runs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(df: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", watermark: bool = True) -> DataFrame:
    """(start, end, series, n, mean) by event-time window; rows later than the watermark are left out of open state."""
    d = df.withWatermark("ts", late) if watermark else df
    return d.groupBy(F.window("ts", width, slide or width).alias("w"), "series").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "series", "n", "mean")


def sessions(df: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", watermark: bool = True) -> DataFrame:
    d = df.withWatermark("ts", late) if watermark else df
    return d.groupBy(F.session_window("ts", gap).alias("w"), "series").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "series", "n")


def carried_fill(df: DataFrame) -> DataFrame:
    """(series, i, filled): forward fill whose last value per series is state, so that a gap at a batch's start continues the batch before."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fill(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (None,)
        pdf = pd.concat(list(parts)).sort_values("i")
        out = pdf["x"].ffill()
        if last is not None:
            out = out.fillna(last)
        if len(out) and not pd.isna(out.iloc[-1]):
            state.update((float(out.iloc[-1]),))
        yield pd.DataFrame({"series": key[0], "i": pdf["i"].to_numpy(), "filled": out.to_numpy()})

    return df.select("series", "i", "x").groupBy("series").applyInPandasWithState(fill, "series string, i long, filled double", "last double", "append", GroupStateTimeout.NoTimeout)


def adaptive_state(df: DataFrame, target: float = 0.1, gamma: float = 0.01) -> DataFrame:
    """(series, i, alpha): the adaptive conformal level after each row; state is the level."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (a,) = state.get if state.exists else (target,)
        pdf = pd.concat(list(parts)).sort_values("i")
        out = []
        for hit in pdf["hit"]:
            a = min(0.999, max(0.001, a + gamma * (target - (not hit))))
            out.append(a)
        state.update((float(a),))
        yield pd.DataFrame({"series": key[0], "i": pdf["i"].to_numpy(), "alpha": out})

    return df.select("series", "i", "hit").groupBy("series").applyInPandasWithState(update, "series string, i long, alpha double", "a double", "append", GroupStateTimeout.NoTimeout)


def run_to_files(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> dict:
    """Runs what is available into files and stops; exactly once by checkpoint. Returns the last progress."""
    q = stream.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return dict(q.lastProgress or {})


def two_pass_mean(spark: SparkSession, path: str, columns: list[str], out: str, checkpoint: str, kind: str = "parquet") -> dict:
    """Mean fill of files: a batch pass for the statistics, a streaming pass that applies them."""
    batch = spark.read.format(kind).load(path)
    means = batch.agg(*(F.avg(c).alias(c) for c in columns)).first()
    stream = spark.readStream.schema(batch.schema).format(kind).load(path)
    return run_to_files(stream.withColumns({c: F.coalesce(F.col(c), F.lit(means[c])) for c in columns}), out, checkpoint, kind)


def knn_reference(stream: DataFrame, path: str, key: str, columns: list[str], size: int) -> dict:
    """Runs what is available, micro-batch by micro-batch: the reference so far (a bottom-k sample by hash, which merges) is written anew with each batch, and rows with gaps
    wait under the path. Each batch has folders of its own, written over if it runs again, and builds on the last reference before it, so that a restart from the
    checkpoint gives the same. Returns the last progress."""
    from ..operators.neighbours import reference

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(key, *columns)
        old = _references(spark, path, epoch, f"`{key}` {dict(batch.dtypes)[key]}", columns)
        whole = rows if old is None else rows.unionByName(old.select(key, *columns))
        reference(whole, key, columns, size).coalesce(1).write.mode("overwrite").parquet(f"{path}/reference/{epoch:09d}")
        rows.filter(" OR ".join(f"`{c}` IS NULL" for c in columns)).write.mode("overwrite").parquet(f"{path}/waiting/{epoch:09d}")

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return dict(q.lastProgress or {})


def _references(spark: SparkSession, path: str, before: int, key: str, columns: list[str]) -> DataFrame | None:
    """The last reference written before a batch."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/reference")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []
    names = [n for n in names if n.isdigit() and int(n) < before]
    schema = ", ".join(["pos string", key, *(f"`{c}` double" for c in columns)])
    return spark.read.schema(schema).parquet(f"{path}/reference/{names[-1]}") if names else None


def knn_fills(spark: SparkSession, path: str, key: str, kind: str, columns: list[str], k: int = 5) -> DataFrame:
    """The waiting rows of knn_reference, filled from the last reference; before any batch there are none."""
    from ..operators.neighbours import knn_filled

    last = _references(spark, path, 1 << 62, f"`{key}` {kind}", columns)
    schema = ", ".join([f"`{key}` {kind}", *(f"`{c}` double" for c in columns)])
    if last is None:
        return spark.createDataFrame([], ", ".join([schema, *(f"`{c}_filled` double" for c in columns)]))
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/waiting")
    return knn_filled(rows, last, columns, k)
