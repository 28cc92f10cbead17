"""Provenance: a hash tree over the rows of a table in their order, and workflows as chains of hashes.

Leaves are runs of LEAF rows; a node hashes its at most FAN children in order. Two trees are compared from the root down, so that a changed cell is found by
reading the nodes on its way, not the rows. All hashes are SHA-256 in hexadecimal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import kept
from .ranks import numbered

LEAF, FAN = 256, 16


def row_text(columns: Sequence[str]) -> Column:
    """The columns as text, one after the other; a null differs from any text, and no two rows run together."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.concat_ws(",", *(part(c) for c in columns))


def hash_tree(df: DataFrame, order: Sequence[str], columns: Sequence[str], leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(level, node, hash): leaves at level 0, the root above all. Rows are numbered in order by ranges, so that a large table is spread over tasks; a
    group is a leaf's rows or a node's children. An empty table has no nodes. Rows that are equal in `order` should be equal in all columns."""
    rows = numbered(df.select(*dict.fromkeys([*order, *columns])), [], order, "i__").select(F.floor((F.col("i__") - 1) / leaf).cast("long").alias("node"), F.col("i__").alias("at"), F.sha2(row_text(columns), 256).alias("h"))

    def above(children: DataFrame) -> DataFrame:
        own = children.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("at", "h"))).alias("c"))
        return own.select("node", F.sha2(F.concat_ws("", F.transform("c", lambda x: x["h"])), 256).alias("hash"))

    level, nodes = 0, kept(above(rows), "leaves")
    out, n = nodes.withColumn("level", F.lit(0)), nodes.count()
    while n > 1:
        nodes = kept(above(nodes.select(F.floor(F.col("node") / fan).cast("long").alias("node"), F.col("node").alias("at"), F.col("hash").alias("h"))), "nodes")
        level, n = level + 1, -(-n // fan)
        out = out.unionByName(nodes.withColumn("level", F.lit(level)))
    return out.select("level", "node", "hash")


def root(tree: DataFrame) -> DataFrame:
    """One row (hash); none of an empty table."""
    return tree.join(tree.agg(F.max("level").alias("level")), "level").select("hash")


def changed_leaves(old: DataFrame, new: DataFrame, fan: int = FAN) -> DataFrame:
    """(node): leaves that differ or exist in one tree only, found from the top: of each level only children of nodes that differ are compared. Trees of different heights
    differ from the lower one's top on."""
    tops = [t.agg(F.max("level").alias("l")).first()["l"] for t in (old, new)]
    if None in tops:
        return old.unionByName(new).filter("level = 0").select("node")
    suspects = None
    for level in range(min(tops), -1, -1):
        a, b = (t.filter(F.col("level") == level).select("node", F.col("hash").alias(h)) for t, h in ((old, "a"), (new, "b")))
        if suspects is not None:
            a, b = (t.withColumn("up", F.floor(F.col("node") / fan).cast("long")).join(suspects.withColumnRenamed("node", "up"), "up", "left_semi") for t in (a, b))
        suspects = kept(a.select("node", "a").join(b.select("node", "b"), "node", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("node"), "suspects")
    return suspects


def chained(steps: DataFrame, workflow: str = "workflow", at: str = "step", content: Sequence[str] = ("name", "parameters", "output")) -> DataFrame:
    """(workflow, step, hash): each step's hash covers its content and the hash before it, so that the last one vouches for all. A workflow's steps are folded in one row."""
    own = steps.select(workflow, at, F.sha2(row_text(content), 256).alias("h"))
    rows = own.groupBy(workflow).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), "h"))).alias("s"))
    start = F.struct(F.lit("").alias("h"), F.array().cast(f"array<struct<{at}:{dict(steps.dtypes)[at]},hash:string>>").alias("out"))

    def step(a, x):
        h = F.sha2(F.concat(a["h"], x["h"]), 256)
        return F.struct(h.alias("h"), F.array_append(a["out"], F.struct(x["at"].alias(at), h.alias("hash"))).alias("out"))

    return rows.select(workflow, F.inline(F.aggregate("s", start, step)["out"]))


def verified(original: DataFrame, rerun: DataFrame, workflow: str = "workflow", at: str = "step", method: Sequence[str] = ("name", "parameters"), output: str = "output") -> DataFrame:
    """(workflow, step, method_match, output_match, reproducible): step by step, and whether the rerun's chain is the original's up to there. Steps of one side only match
    in nothing."""
    a, b = (s.select(workflow, at, F.sha2(row_text(method), 256).alias(f"m{k}"), F.col(output).alias(f"o{k}")).join(chained(s, workflow, at, (*method, output)).withColumnRenamed("hash", f"h{k}"), [workflow, at]) for k, s in enumerate((original, rerun)))
    same = lambda c: F.coalesce(F.col(f"{c}0") == F.col(f"{c}1"), F.lit(False))
    return a.join(b, [workflow, at], "full").select(workflow, at, same("m").alias("method_match"), same("o").alias("output_match"), same("h").alias("reproducible"))
