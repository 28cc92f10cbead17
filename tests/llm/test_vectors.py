"""The operators on vectors and on SentencePiece ids against brute force, the library and odd inputs."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacuna.llm import codes, negatives, pieces, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    """Columns whose names the operators use themselves come along."""
    return spark.createDataFrame(rows, SCHEMA).withColumns({"v": F.lit("x"), "d": F.lit(1), "cell": F.lit(2), "block": F.lit(3), "code": F.lit(4)})


def clustered(n, dims, centres, seed=7):
    g = np.random.default_rng(seed)
    c = g.normal(size=(centres, dims))
    c *= 4 / np.linalg.norm(c, axis=1, keepdims=True)
    of = g.integers(0, centres, n)
    return (c[of] + 0.05 * g.normal(size=(n, dims))).astype(np.float32), (of % 4).astype(int)


# 11 hard negatives


def plain_negatives(rows, k=5, m=10, low=30, high=90):
    """All rows against all anchors."""
    rows = [(i, lab, v) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, _, v in rows), default=0)
    whole = [(i, lab, np.array([int(np.floor(256 * float(np.float32(x)))) for x in v] + [0] * (width - len(v)), dtype=np.int64)) for i, lab, v in rows]
    out, done = [], set()
    for a, lab, q in whole:
        if a % 100 or (a, lab, q.tobytes()) in done:
            continue
        done.add((a, lab, q.tobytes()))
        scored = sorted((-int(q @ x), i, other) for i, other, x in whole if i != a)
        for p, pos, _ in [s for s in scored if s[2] == lab][:k]:
            near = [s for s in scored if s[2] != lab and 30 * -p <= 100 * -s[0] <= 90 * -p][:m]
            out += [(a, pos, r, i, -p, -s) for r, (s, i, _) in enumerate(near, 1)]
    return sorted(out)


def mined(df):
    rows = vectors.whole_numbers(df).filter("label is not null and vec_id is not null").withColumn("label", F.col("label").cast("bigint"))
    return sorted(tuple(r) for r in negatives.hard_negatives(rows, rows.filter("vec_id % 100 = 0")).collect())


def test_negatives_in_clusters_equal_brute_force_and_cells_are_left_out(spark, monkeypatch):
    x, labels = clustered(6000, 8, 4)
    rows = [(i, x[i].tolist(), int(labels[i])) for i in range(len(x))]
    monkeypatch.setattr(negatives, "BLOCK", 64)
    met, seen = negatives.met, []
    monkeypatch.setattr(negatives, "met", lambda g, b, c: seen.append((met(g, b, c).count(), g.count() * b.count())) or met(g, b, c))
    df = frame(spark, rows)
    assert mined(df) == plain_negatives(rows)
    assert seen[0][0] < seen[0][1] / 2


def test_negatives_with_ties_copies_and_a_hot_vector(spark):
    g = np.random.default_rng(3)
    x = g.integers(-2, 3, (900, 4)).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, x[i].tolist(), int(i % 3)) for i in range(900)]
    assert mined(frame(spark, rows)) == plain_negatives(rows)


def test_negatives_of_odd_rows(spark):
    rows = [(None, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [1.0, float("nan")], 0), (4, [float("inf"), 0.0], 0), (5, [0.5], 0), (6, [], 0), (7, [1.0, 1.0, 1.0], 0), (8, [0.9, 1.5], 1), (9, [0.5, 0.5], None),
            (100, [1e5, 1e6], 0), (101, [1e5, 1e6], 0), (102, [4e4, 4e5], 1), (200, [-1.0, 0.0], 5), (10, [0.5, 0.6], 2), (10, [0.5, 0.6], 2)]
    assert mined(frame(spark, rows)) == plain_negatives(rows)
    assert mined(frame(spark, [])) == []


# 13 vector codes


def plain_codes(x, parts=16, entries=64, rounds=2):
    """Every part against every entry, each round."""
    x = x.reshape(len(x), parts, -1)
    book = x[:entries].swapaxes(0, 1).copy()

    def assigned():
        d = ((x[:, :, None, :] - book[None]) ** 2).sum(-1)
        return d.argmin(2), d.min(2)

    for _ in range(rounds):
        a, _ = assigned()
        for p in range(parts):
            for e in range(book.shape[1]):
                own = x[a[:, p] == e, p]
                if len(own):
                    book[p, e] = own.sum(0) // len(own)
    a, d = assigned()
    return a, d.sum(1), book


@pytest.mark.parametrize("rounds", [0, 1, 2, 5])
def test_codes_equal_plain_rounds_with_fewer_parts_measured(spark, monkeypatch, rounds):
    x, labels = clustered(700, 32, 64)
    monkeypatch.setattr(codes, "BLOCK", 128)
    pops, once = [], codes.next_round
    monkeypatch.setattr(codes, "next_round", lambda *a: pops.append(once(*a)) or pops[-1])
    df = vectors.whole_numbers(frame(spark, [(i, x[i].tolist(), int(labels[i])) for i in range(len(x))]))
    got, book = codes.compressed(df, rounds=rounds)
    got = got.orderBy("vec_id").toPandas()
    a, error, want = plain_codes(np.floor(256 * x.astype(float)).astype(np.int64), rounds=rounds)
    assert np.array_equal(np.stack(got["code"]), a) and got["error"].tolist() == error.tolist() and np.array_equal(book.entries, want)
    if pops:
        # the last round measures a part of the parts only
        assert 0 < pops[-1].agg(F.sum("pops")).first()[0] < (0.95 if rounds < 5 else 0.75) * 700 * 16


def test_codes_of_odd_rows(spark):
    rows = [(None, [1.0] * 16, 1), (3, [0.5] * 16, None), (3, [0.25] * 16, None), (1, None, 1), (2, [1.0, None], 1), (4, [float("nan")] * 16, 1), (5, [float("-inf")] * 16, 1), (6, [], 2), (7, [1.0] * 17, 2), (8, [1e6] * 16, 2), (8, [1e6] * 16, 2), (9, [-0.001] * 16, None)]
    df = vectors.whole_numbers(frame(spark, rows))
    kept = sorted(((i is None, i, v + [0] * (32 - len(v))) for i, v in ((i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))), key=lambda r: (r[0], r[1] or 0, r[2]))
    x = np.array([v for _, _, v in kept], np.int64)
    got, book = codes.compressed(df)
    # the row without an id isn't among the first entries
    named = sum(not r[0] for r in kept)
    a, error, want = plain_codes(x, entries=named)
    assert book.entries.shape == (16, named, 2) and np.array_equal(book.entries, want)
    assert sorted(got.toPandas()["error"].tolist()) == sorted(error.tolist())
    none, book = codes.compressed(vectors.whole_numbers(frame(spark, [])))
    assert none.count() == 0 and book is None


def test_exact_sums_beyond_doubles():
    a = np.array([[2**30 + 1, 3], [-(2**30), 2**29 + 5]], np.int64)
    assert vectors.products(a, a).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in a] for r in a]
    assert codes.squares(a, a).tolist() == [[sum((int(x) - int(y)) ** 2 for x, y in zip(r, s, strict=True)) for s in a] for r in a]


# 12 SentencePiece ids


@pytest.fixture(scope="module")
def model():
    with open(pieces.default_model(), "rb") as f:
        return f.read()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abz  \n\t▁é日😀\x00 .")), max_size=14), max_size=6))
def test_chunks_one_by_one_are_what_the_library_gives(texts):
    with open(pieces.default_model(), "rb") as f:
        sp = pieces.processor(f.read())
    chunks, n = pieces.chunks_of(pa.array(texts, pa.string()))
    chunks, ends = chunks.to_pylist(), np.cumsum(n)
    for t, k, e in zip(texts, n, ends, strict=True):
        assert [i for c in chunks[e - k : e] for i in (sp.encode(c) if c else [sp.piece_to_id(pieces.MARK)])] == sp.encode(t)


ODD = [(None, "a null id"), (1, None), (2, ""), (3, "  "), (4, " \n\t "), (5, "same text"), (5, "same text"), (6, "same text"), (7, "word " * 40000), (8, "x" * 30000), (9, "日本語のテキスト 😀\x00 </s>"), (10, "▁ ▁"), (2**60, "﻿​ zero")]


@pytest.mark.parametrize("by_word", [True, False])
def test_pieces_equal_the_library(spark, model, monkeypatch, by_word):
    monkeypatch.setattr(pieces, "separable", lambda m: by_word)
    sp = pieces.processor(model)
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"block": F.lit("b"), "ids": F.lit("clash"), "k0": F.lit(1)})
    got = pieces.decoded(pieces.encoded(df.repartition(3), keep=["doc_id", "text"])).collect()
    assert len(got) == len(ODD)
    for r in got:
        want = [sp.bos_id(), *sp.encode(r.text or ""), sp.eos_id()]
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.decoded == sp.decode(want)
    bare = pieces.encoded(df, add_bos=False, add_eos=False).collect()
    assert sorted(len(r.ids) for r in bare) == sorted(4 * len(sp.encode(t or "")) for _, t in ODD)
    assert pieces.decoded(pieces.encoded(df.limit(0))).count() == 0


def test_small_blocks_and_all_documents(spark, model, monkeypatch):
    sp = pieces.processor(model)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = pieces.cut
    monkeypatch.setattr(pieces, "cut", lambda *a: one(*a, block_bytes=2000))
    docs = docs.unionByName(docs)  # blocks with the same chunks
    got = pieces.decoded(pieces.encoded(docs, keep=["doc_id", "text"])).collect()
    assert len(got) == docs.count()
    assert all(np.frombuffer(r.ids, "<u4").tolist() == [1, *sp.encode(r.text), 2] for r in got)


def test_models_that_are_not_separable(model):
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(model)
    assert pieces.separable(model)
    m.pieces[500].piece = "a▁b"
    assert not pieces.separable(m.SerializeToString())
    m.ParseFromString(model)
    m.normalizer_spec.remove_extra_whitespaces = True
    assert not pieces.separable(m.SerializeToString())
