"""What the operators share: the shared folder, checkpoints, small expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 500
#: White space that separates words in every contract of this package.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    spark.checkpoint.dir is read from the session; only where it is unset (tests on one machine)
    a local folder is made and set.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(sc, "_lacuna_dir", None) or tempfile.mkdtemp(prefix="lacuna-")
        sc._lacuna_dir = base
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key is hot when it holds more than one in HOT_SHARE of all rows; so there are fewer than HOT_SHARE hot keys, whatever the data.
HOT_SHARE = 200


def spread_join(rows: DataFrame, facts: DataFrame, on: list[str], weights: DataFrame, total: int) -> DataFrame:
    """rows joined with facts (one row per key) where one key may hold a third of all rows. weights has the keys with n, how many of the `total`
    rows have each. The facts of hot keys, fewer than HOT_SHARE, are broadcast, so that their rows stay where they are; all other rows
    meet their facts by a shuffle."""
    hot = weights.filter(F.col("n") * HOT_SHARE > total).select(*on)
    if hot.isEmpty():
        return rows.join(facts, on)
    rest = rows.join(F.broadcast(hot), on, "left_anti").join(facts, on)
    return rest.unionByName(rows.join(F.broadcast(facts.join(F.broadcast(hot), on, "left_semi")), on).select(*rest.columns))


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, also when body is a lambda run per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def id_bucket(col: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % k


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ship(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver has it."""
    from pathlib import Path

    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


def map_arrow(df: DataFrame, make, schema: str) -> DataFrame:
    """df through make(columns by name) -> columns by name, batch by batch. Columns are Arrow arrays going in (null ids
    stay null integers) and lists or Arrow arrays coming out. make may be a generator function over batches, marked by
    an attribute `whole`, to carry state from batch to batch."""
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)
    # whole texts may be long: few rows at a time keep a Python worker's memory bounded
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(target)

        def packed(columns):
            return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in ((columns[f.name], f) for f in to)], schema=to)

        named = ({n: b.column(i) for i, n in enumerate(b.schema.names)} for b in batches)
        for columns in make(named) if getattr(make, "whole", False) else map(make, named):
            yield packed(columns)

    return df.mapInArrow(run, schema)


def kept_ddl(df: DataFrame, keep) -> str:
    """The columns to keep, as the rest of a schema."""
    return "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
