from pyspark.sql import functions as F

from lacuna.streaming import streams


def source(spark, path, batches, schema):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_carried_fill_across_batches(spark, tmp_path):
    schema = "series string, i long, x double"
    s = source(spark, tmp_path / "in", [[("a", 1, 5.0), ("a", 2, None)]], schema)
    streams.run_to_files(streams.carried_fill(s), str(tmp_path / "out"), str(tmp_path / "ck"))
    spark.createDataFrame([("a", 3, None), ("a", 4, 7.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streams.run_to_files(streams.carried_fill(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r["i"]: r["filled"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: 5.0, 2: 5.0, 3: 5.0, 4: 7.0}


def test_windows_batch_equals_stream(spark, tmp_path):
    rows = [("a", f"2024-01-01 0{h}:{m:02d}:00", float(h + m)) for h in range(5) for m in (0, 20, 40)]
    d = spark.createDataFrame(rows, "series string, t string, value double").select("series", F.to_timestamp("t").alias("ts"), "value")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    streams.run_to_files(streams.windowed(s), str(tmp_path / "out"), str(tmp_path / "ck"))
    stream = {(r["start"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r["start"], r["n"]) for r in streams.windowed(d, watermark=False).collect()}
    assert stream and stream <= batch


def test_two_pass_mean(spark, tmp_path):
    spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double").coalesce(1).write.parquet(str(tmp_path / "in"))
    streams.two_pass_mean(spark, str(tmp_path / "in"), ["x"], str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r["x"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1.0, 2.0, 3.0]


def test_knn_reference_over_micro_batches_equals_one_batch(spark, tmp_path):
    """Three batches, the last after a restart; then the fills of all rows that waited."""
    import numpy as np

    from lacuna.operators import neighbours

    g = np.random.default_rng(2)
    rows = [(k, *(None if g.random() < 0.2 else float(g.integers(0, 9)) for _ in range(3))) for k in range(600)] + [(None, 1.0, 1.0, 1.0)]
    schema, cols = "k long, a double, b double, c double", ["a", "b", "c"]
    source(spark, tmp_path / "in", [rows[:200], rows[200:400]], schema)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.knn_reference(stream(), str(tmp_path), "k", cols, 50)
    source(spark, tmp_path / "in", [rows[400:]], schema)
    streams.knn_reference(stream(), str(tmp_path), "k", cols, 50)
    df = spark.createDataFrame(rows, schema)
    want = neighbours.reference(df, "k", cols, 50)
    got = spark.read.parquet(str(tmp_path / "reference" / "000000002"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 50
    gaps = df.filter("a is null or b is null or c is null")
    fills = neighbours.knn_filled(gaps, want, cols)
    order = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert order(streams.knn_fills(spark, str(tmp_path), "k", "long", cols)) == order(fills)


def test_knn_fill_equals_a_plain_version(spark):
    import numpy as np

    from lacuna.operators import neighbours

    ref = [(k, float(k % 5), float(k * k % 7)) for k in range(20)]
    rows = [(100, 2.0, None), (101, None, 3.0), (102, None, None), (103, 1.5, None)]
    donors = neighbours.reference(spark.createDataFrame(ref, "k long, a double, b double"), "k", ["a", "b"])
    out = {r.k: r for r in neighbours.knn_filled(spark.createDataFrame(rows, "k long, a double, b double"), donors, ["a", "b"], 3, standardise=False).collect()}
    d = np.array([r[1:] for r in sorted((tuple(r) for r in donors.collect()))], float)[:, 1:]
    exact = d[d[:, 0] == 2.0][:3, 1]
    assert out[100].b_filled == exact.mean() and out[102].a_filled == d[:, 0].mean()
    at = np.argsort(np.round(np.sqrt(2 * (d[:, 0] - 1.5) ** 2), 9), kind="stable")[:3]
    assert abs(out[103].b_filled - d[at, 1].mean()) < 1e-9
