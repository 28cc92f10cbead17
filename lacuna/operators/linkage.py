"""Minimum spanning forests and the order of leaves that single linkage gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import kept


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, d): the edges of the minimum spanning forest, ties by (a, b). edges: a < b, d. In rounds: each component takes its lightest edge out, components that are
    linked so become one (every component points at its edge's other end, of two that point at each other the smaller is the root, and pointers are halved until they
    reach roots). A round at least halves the components that have edges, so there are few."""
    edges = kept(edges.select("a", "b", "d"), "edges")
    parts = kept(edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().select("v", F.col("v").alias("c")), "parts")
    out = edges.limit(0)
    while True:
        both = edges.join(parts.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(parts.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b").filter("ca <> cb")
        edge = F.struct("d", "a", "b")
        ways = both.select(F.col("ca").alias("c"), F.col("cb").alias("to"), edge.alias("e")).unionByName(both.select(F.col("cb").alias("c"), F.col("ca").alias("to"), edge.alias("e")))
        taken = kept(ways.groupBy("c").agg(F.min(F.struct("e", "to")).alias("m")).select("c", F.col("m.to").alias("to"), F.col("m.e.a").alias("a"), F.col("m.e.b").alias("b"), F.col("m.e.d").alias("d")), "taken")
        if taken.isEmpty():
            return out
        out = kept(out.unionByName(taken.select("a", "b", "d").distinct()), "forest")
        back = taken.select(F.col("c").alias("to"), F.col("to").alias("again"))
        point = taken.select("c", "to").join(back, "to", "left").select("c", F.when((F.col("again") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("r"))
        while True:
            point = kept(point, "pointers")
            ahead = point.select(F.col("c").alias("r"), F.col("r").alias("next"))
            further = point.join(ahead, "r", "left").select("c", "r", F.coalesce("next", "r").alias("next"))
            if further.filter("next <> r").isEmpty():
                break
            point = further.select("c", F.col("next").alias("r"))
        parts = kept(parts.join(point, "c", "left").select("v", F.coalesce("r", "c").alias("c")), "parts")
        edges = kept(both.select("a", "b", "d"), "edges")


def leaf_order(edges: DataFrame) -> DataFrame:
    """(place, v): the variables as single linkage joins them, lightest edge first; of two clusters that join, the one with the smaller variable comes first. The forest's
    edges, one fewer than variables, are folded in one row; trees without a common edge follow each other by their smallest variable."""
    forest = spanning_forest(edges)
    kind = dict(edges.dtypes)["a"]
    names = F.array_sort(F.array_distinct(F.concat(F.collect_list("a"), F.collect_list("b"))))
    one = forest.agg(F.sort_array(F.collect_list(F.struct("d", "a", "b"))).alias("e"), names.alias("names"))
    start = F.transform("names", lambda v: F.array(v)).cast(f"array<array<{kind}>>")

    def step(clusters, e):
        own = F.filter(clusters, lambda c: F.array_contains(c, e["a"]) | F.array_contains(c, e["b"]))
        rest = F.filter(clusters, lambda c: ~(F.array_contains(c, e["a"]) | F.array_contains(c, e["b"])))
        return F.concat(rest, F.array(F.flatten(F.transform(F.array_sort(F.transform(own, lambda c: F.struct(F.array_min(c).alias("m"), c.alias("c")))), lambda x: x["c"]))))

    done = F.aggregate("e", start, step)
    ordered = F.flatten(F.transform(F.array_sort(F.transform(done, lambda c: F.struct(F.array_min(c).alias("m"), c.alias("c")))), lambda x: x["c"]))
    return one.select(F.posexplode(ordered).alias("place", "v"))
