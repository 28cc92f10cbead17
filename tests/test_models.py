"""Spectra, complexity bounds and provenance against plain versions."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.operators import bounds, provenance, spectra


def test_sums_of_batches_equal_a_transform(spark):
    g = np.random.default_rng(1)
    pdf = pd.concat([pd.DataFrame({"series": s, "i": range(1, n + 1), "a": g.normal(size=n), "b": g.normal(size=n)}) for s, n in (("p", 97), ("q", 64))])
    df = spark.createDataFrame(pdf).repartition(5)
    rows = df.join(df.groupBy("series").agg(F.count("*").alias("n")), "series").withColumn("k", F.col("i") - 1)
    got = spectra.fourier_sums(rows, ["a"], 200).toPandas()
    for s, own in pdf.groupby("series"):
        f = np.fft.rfft(own.sort_values("i")["a"].to_numpy())
        mine = got[got["series"] == s].sort_values("f")
        assert np.allclose(mine["a_re"] + 1j * mine["a_im"], f)
    err = {r.series: r.spectral_rmse for r in spectra.spectral_error(df, "a", "b", 200).collect()}
    for s, own in pdf.groupby("series"):
        a, b = (np.abs(np.fft.rfft(own[c].to_numpy())) for c in "ab")
        assert err[s] == pytest.approx(np.sqrt(((a - b) ** 2).mean()))


def test_complexity_equals_a_loop_with_the_same_signs(spark):
    g = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": range(300), "a": g.normal(size=300), "b": g.normal(size=300) + 1, "y": g.normal(size=300)})
    df = spark.createDataFrame(pdf)
    one = bounds.rademacher(df, "k", ["a", "b"], 2).first()
    tops = []
    for block in range(2):
        hashes = [hashlib.md5(f"{k}|{block}".encode()).hexdigest() for k in pdf["k"]]
        for d in range(32):
            s = np.array([1.0 if h[d] >= "8" else -1.0 for h in hashes])
            tops.append(max(abs(s @ pdf["a"]), abs(s @ pdf["b"])) / 300)
    assert one["n"] == 300 and one["complexity"] == pytest.approx(np.mean(tops))
    b = bounds.generalisation(df, "k", ["a", "b"], "y", [0.25, 0.75], 0.1).first()
    assert b["risk"] == pytest.approx(((0.25 * pdf["a"] + 0.75 * pdf["b"] - pdf["y"]) ** 2).mean())
    assert b["bound"] == pytest.approx(b["risk"] + 2 * b["complexity"] + 3 * math.sqrt(math.log(20) / 600))
    assert bounds.generalisation(df.limit(0), "k", ["a"], "y").first()["n"] == 0


def test_a_changed_cell_is_found_by_its_leaf(spark):
    rows = [(k, f"v{k}" if k % 5 else None, k * 2) for k in range(1000)]
    df = spark.createDataFrame(rows, "k long, a string, b long")
    tree = provenance.hash_tree(df.repartition(7), ["k"], ["k", "a", "b"], 16, 4)
    assert tree.filter("level = 0").count() == 63 and provenance.root(tree).count() == 1
    again = provenance.hash_tree(df.orderBy(F.desc("k")), ["k"], ["k", "a", "b"], 16, 4)
    assert provenance.root(tree).first() == provenance.root(again).first()
    assert provenance.changed_leaves(tree, again, 4).count() == 0
    other = df.withColumn("a", F.when(F.col("k") == 500, F.lit("")).otherwise(F.col("a")))  # null to empty
    changed = provenance.changed_leaves(tree, provenance.hash_tree(other, ["k"], ["k", "a", "b"], 16, 4), 4)
    assert [r.node for r in changed.collect()] == [500 // 16]
    longer = provenance.hash_tree(df.unionByName(spark.createDataFrame([(1000, "x", 1)], "k long, a string, b long")), ["k"], ["k", "a", "b"], 16, 4)
    assert [r.node for r in provenance.changed_leaves(tree, longer, 4).collect()] == [62]
    none = provenance.hash_tree(df.limit(0), ["k"], ["k", "a", "b"])
    assert none.count() == 0 and provenance.changed_leaves(none, tree).count() == 63


def test_chains_and_reruns(spark):
    schema = "workflow string, step int, name string, parameters string, output string"
    rows = [("w", k, "fill", "{}", f"o{k}") for k in range(4)] + [("v", 0, "read", None, None)]
    first = spark.createDataFrame(rows, schema)
    again = spark.createDataFrame([(w, s, n, p, "other" if (w, s) == ("w", 2) else o) for w, s, n, p, o in rows][:4], schema)
    got = {(r.workflow, r.step): r for r in provenance.verified(first, again).collect()}
    assert [got["w", k].reproducible for k in range(4)] == [True, True, False, False]
    assert [got["w", k].output_match for k in range(4)] == [True, True, False, True]
    assert not got["v", 0].reproducible and not got["v", 0].method_match
