"""The training-data operators against brute force, round trips, held-out accuracy and odd inputs."""

import hashlib
import itertools
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import chat, language, licenses, media, mixing, ngram_join, packing, quality, sharding, toxicity
from lacuna.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 6000
ODD = [
    (None, "a null id with some words in it", "en", "s", 1), (1, None, "en", None, None), (2, "", None, "s", 0), (3, " \n\t ", "en", "s", 1), (4, "12 %% --", "en", "s", 1),
    (5, "one two three four five six seven", "en", "s", 1), (5, "one two three four five six seven", "en", "s", 1), (6, "one two three four five six seven", "de", "s", 1), (7, LONG, "en", "hot", 1), (2**60 + 1, "big id", "fr", "s", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"score": F.lit("x"), "t": F.lit(1), "bucket": F.lit(2), "slot": F.lit(3)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF).toPandas()
    want = con.sql(ORACLES[name]).df()[list(got.columns)]
    key = list(got.columns)
    assert got.sort_values(key).reset_index(drop=True).astype(str).equals(want.sort_values(key).reset_index(drop=True).astype(str))


# 1 toxicity


def test_toxicity_learns_and_leaves_clean_texts(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.scored(d, toxicity.trained(d, labels)).join(labels, "doc_id").toPandas()
    held = out[out["held_out"]]
    assert (held[held["toxic"] == 0]["predicted"] == 0).mean() > 0.95
    assert (out[out["toxic"] == 1]["predicted"] == 1).mean() > 0.6


def test_toxicity_risk_is_non_negative_learning():
    pos, unl = [[0, 2]] * 40, [[0, 2]] * 20 + [[1, 2]] * 180
    weights, bias = toxicity.fitted(pos, unl, ["bad", "good", "both"], 0.1)
    assert bias + weights["bad"] + weights.get("both", 0) > 0 > bias + weights.get("good", 0) + weights.get("both", 0)


def test_toxicity_odd(spark, odd, none):
    rows = toxicity.scored(odd, ({"one": 2.0}, -1.0)).collect()
    assert len(rows) == len(ODD) and {r["predicted"] for r in rows if r["doc_id"] in (5, 6)} == {1}
    labels = spark.createDataFrame([(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r["score"] < 0.5 for r in toxicity.scored(odd, toxicity.trained(odd, labels)).collect()} == {True}
    assert toxicity.scored(none, ({}, 0.0)).count() == 0


def test_prior_is_found_without_negative_labels():
    """U holds 15 % of texts like P; features 0 to 9 are told by P alone, the others by neither."""
    g = np.random.default_rng(0)
    bad = lambda: sorted({int(k) for k in g.integers(0, 10, 3)} | {int(k) for k in g.integers(10, 40, 6)})
    good = lambda: sorted({int(k) for k in g.integers(10, 40, 8)})
    pos, unl = [bad() for _ in range(300)], [bad() if g.random() < 0.15 else good() for _ in range(2000)]
    names = [f"w{k}" for k in range(40)]
    assert abs(toxicity.estimated_prior(pos, unl, names) - 0.15) < 0.04
    assert toxicity.estimated_prior([], unl, names) == 0.0
    # nothing tells P from U: the guess stands
    assert toxicity.estimated_prior(unl[:30], unl[30:], names) == 0.1 == toxicity.estimated_prior(pos, unl, [])


def test_steps_lower_the_corrected_risk():
    """The fitted weights' risk, worked out text by text, is below that of any of many other weights nearby."""
    g = np.random.default_rng(1)
    names, prior = [f"w{k}" for k in range(6)], 0.3
    text = lambda bad: [0 if g.random() < (0.8 if bad else 0.1) else 1, int(g.integers(2, 6))]
    pos, unl = [text(True) for _ in range(200)], [text(g.random() < prior) for _ in range(600)]
    model = toxicity.fitted(pos, unl, names, prior, 1, 400)

    def risk(weights, bias):
        z = lambda r: bias + sum(weights.get(names[i], 0.0) for i in r)
        plus = np.mean([math.log1p(math.exp(-z(r))) for r in pos])
        minus = np.mean([math.log1p(math.exp(z(r))) for r in unl]) - prior * np.mean([math.log1p(math.exp(z(r))) for r in pos])
        return prior * plus + max(0.0, minus)

    best = risk(*model)
    for _ in range(50):
        assert best < risk({k: v + g.normal() for k, v in model[0].items()}, model[1] + g.normal()) + 1e-3


# 2 mixing


def test_mix_is_less_than_a_block_off(spark):
    rows = [(i, f"t{i}", None, s, 1) for i, s in enumerate(["a"] * 300 + ["b"] * 100 + ["c"] * 37)]
    out = mixing.mixed(spark.createDataFrame(rows, SCHEMA), {"a": 5, "b": 3, "c": 2}, period=50).toPandas().sort_values("position")
    assert out["position"].tolist() == list(range(437)) and out["doc_id"].is_unique
    assert ((out["release"] <= out["position"]) & (out["position"] < out["deadline"])).all()
    on_target = min(300 // 25, 100 // 15, 37 // 10) * 50
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        seen = np.cumsum(out["source"].to_numpy()[:on_target] == s)
        assert np.abs(seen - w * np.arange(1, on_target + 1)).max() < 1


def test_mix_in_blocks_and_odd(spark, odd, none):
    out = mixing.mixed(odd, block=2).toPandas()
    assert len(out) == len(ODD) and set(out["source"]) == {"", "s", "hot"}
    assert mixing.mixed(none).count() == 0
    assert set(mixing.mixed(odd, max_sources=1).toPandas()["mixed_as"]) == {"s", "*"}


def test_mix_of_many_sources(spark):
    """Each of 90 sources has its own weight and is less than a block off while all have blocks; pooled sources add up."""
    sizes = {f"s{i:02}": (64, 16, 4)[i % 3] for i in range(90)}
    rows = [(i, f"t{i}", None, s, 1) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    d = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixed(d, period=50).toPandas().sort_values("position")
    assert out["position"].tolist() == list(range(len(rows))) and out["doc_id"].is_unique and (out["mixed_as"] == out["source"]).all()
    assert ((out["release"] <= out["position"]) & (out["position"] < out["deadline"])).all()
    assert {(sizes[s], w) for s, w in zip(out["source"], out["weight"])} >= {(64, 4), (16, 2), (4, 1)} and out["length"].max() == 210
    names, on_target = out["source"].to_numpy(), 4 * 210
    for s, n in sizes.items():
        assert np.abs(np.cumsum(names[:on_target] == s) - n**0.5 / 2 / 210 * np.arange(1, on_target + 1)).max() < 1
    counted = spark.createDataFrame([("a", "a", 100), ("b", "*", 100), ("c", "*", 100)], "named string, source string, n long")
    assert {r["source"]: r["w"] for r in mixing.weighted(counted, period=30).collect()} == {"a": 10, "*": 20}
    assert {r["source"]: r["w"] for r in mixing.weighted(counted, {"a": 1, "b": 4, "c": 5}, period=10).collect()} == {"a": 1, "*": 9}


# 3 media


def test_media_round_trip_and_resynchronisation(odd):
    for t in ("", None, "x", "é" * 500, "\xff" * 192, LONG):
        payload, n = media.payload_of(t)
        raw = media.encode(payload)
        found = media.parse(raw)
        assert media.stored_payload(raw, found) == payload and found["bad_crc"] == found["skipped"] == 0
        assert found["samples"] == 1152 * len(payload) // 192 and found["table"]["frames"] == len(payload) // 192
        assert len(payload) % 192 == 0 and len(payload) >= max(192, n)
        cut = found["offsets"][-1]
        broken = raw[:cut] + b"\xff\xfbjunk\xff" + raw[cut:]
        assert media.stored_payload(broken, media.parse(broken)) == payload and media.parse(broken)["skipped"] > 0
    raw = bytearray(media.encode(b" " * 384))
    raw[media.parse(bytes(raw))["offsets"][0] + 7] ^= 1
    assert media.parse(bytes(raw))["bad_crc"] == 1
    assert media.parse(None)["offsets"] == []


def test_foreign_stream_with_the_other_table():
    """Frames of 128 kbit/s at 44.1 kHz without checksums, padding now and then, a VBRI table, junk between two frames."""
    plain, padded = bytes((0xFF, 0xFB, 0x90, 0x00)).ljust(417, b"\1"), bytes((0xFF, 0xFB, 0x92, 0x00)).ljust(418, b"\1")
    table = bytes((0xFF, 0xFB, 0x90, 0x00)) + bytes(32) + b"VBRI" + bytes((0, 1, 0, 0, 0, 75)) + (2086).to_bytes(4, "big") + (5).to_bytes(4, "big") + b"\0\2\0\1\0\2\0\3" + (1252).to_bytes(2, "big") + (834).to_bytes(2, "big")
    raw = table.ljust(417, b"\0") + plain + padded + plain + b"junk" + plain + padded
    found = media.parse(raw)
    assert found["table"] == {"frames": 5, "bytes": 2086, "run": 3, "steps": [1252, 834]}
    assert found["offsets"] == [417, 834, 1252, 1673, 2090] and found["lengths"] == [417, 418, 417, 417, 418]
    assert found["samples"] == 5 * 1152 and found["rate"] == 44100 and found["skipped"] == 4 and found["checked"] == 0


def test_media_headers():
    assert media.header(bytes((0xFF, 0xFB, 0x90, 0x00)))[:4] == (417, 1152, 44100, 128)
    assert media.header(bytes((0xFF, 0xFB, 0xF0, 0x00))) is None


def test_media_rows(odd, none):
    rows = media.described(media.with_media(odd)).collect()
    assert len(rows) == len(ODD) and media.described(media.with_media(none)).count() == 0
    blank = [r for r in rows if r["doc_id"] in (1, 2)]
    assert {r["payload_sha256"] for r in blank} == {hashlib.sha256(b" " * 192).hexdigest()} and {r["tail_crc32"] for r in blank} == {zlib.crc32(b" " * 16)}


# 4 n-gram join


def brute(rows, n, num, den):
    sets = {i: ngram_join.grams(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sorted(sets.items()), 2):
        both = len(a & b)
        if both and den * both >= num * (len(a) + len(b) - both):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_join_finds_every_link(spark, n, num, den):
    rng = np.random.default_rng(n)
    base = [[f"w{x}" for x in rng.integers(0, 400, size)] for size in (4, 12, 12, 40, 90, 200)]
    rows = []
    for words in base:
        for _ in range(12):
            w = list(words)
            for _ in range(int(rng.integers(0, max(2, len(w) // 12)))):
                w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, 9999)}"
            rows.append((len(rows), " ".join(w)))
    out = ngram_join.linked(spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA), n, num, den).collect()
    want = brute(rows, n, num, den)
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert all(r["n_shingles"] == len(ngram_join.grams(dict(rows)[r["doc_id"]], n)) for r in out)


def test_links_of_ids_with_several_texts(spark):
    """Rows that share an id are one document with all their sets, however many."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    rows = [(1, a), (5, a), (5, b), (9, b.replace("b59", "x")), (20, a + " y"), (20, c), (20, d), (30, d + " z"), (31, c), (40, "alone in the world")]
    out = {r["doc_id"]: r["component_id"] for r in ngram_join.linked(spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)).collect()}
    assert out == {1: 1, 5: 1, 9: 1, 20: 1, 30: 1, 31: 1, 40: 40}


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100)])
def test_similar_sets_share_a_key(n, num, den):
    """Recall of the pigeonhole join is 1: sets as far apart as the threshold allows, of all sizes, also with empty pieces."""
    rng = np.random.default_rng(n)
    starts, allowed, pieces = ngram_join.bands(num, den)
    used_all = 0
    for size in [*range(2, 60), *rng.integers(60, 2500, 250).tolist()]:
        for _ in range(12 if size < 60 else 1):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64) * np.uint64(2))
            out = int(len(a) * (den - num) // den * rng.random() + 0.5)
            more = int(((len(a) - out) * den - num * len(a)) // num * rng.random() + 0.5)
            b = np.union1d(rng.permutation(a)[out:], rng.integers(0, 2**63, more, dtype=np.int64).astype(np.uint64)) if out or more else a
            both = len(np.intersect1d(a, b))
            if den * both >= num * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
                ka, kb = ngram_join.keys(a, num, den), ngram_join.keys(b, num, den)
                assert len(np.intersect1d(ka, kb)), (len(a), len(b), both)
            band = int(np.searchsorted(starts, len(a), "right")) - 1
            used_all += len(ngram_join.keys(a, num, den)) > 0 and allowed[band] > 0 and len(np.unique(((a >> np.uint64(32)) * np.uint64(pieces[band])) >> np.uint64(32))) <= allowed[band]
    assert used_all <= 10  # sets whose empty pieces are keys are rare


def test_unlike_sets_meet_in_no_bucket():
    rng = np.random.default_rng(8)
    for size in (100, 400):
        for num in (80, 90):
            k = [ngram_join.keys(np.unique(rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64) * np.uint64(2)), num, 100) for _ in range(300)]
            values, counts = np.unique(np.concatenate(k), return_counts=True)
            assert counts.max() == 1


def test_recall_of_the_join_is_one(spark):
    """2,500 texts of mixed sizes, with copies, near copies at both thresholds and shared passages, against brute force."""
    rng = np.random.default_rng(11)
    passage, rows = " ".join(f"p{i}" for i in range(60)), []
    for k in range(500):
        w = [f"w{x}" for x in rng.integers(0, 3000, int(rng.choice([3, 8, 15, 30, 60, 150])))]
        for _ in range(5):
            v = list(w)
            for _ in range(int(rng.integers(0, max(2, len(w) // 25)))):
                v[int(rng.integers(0, len(v)))] = f"x{rng.integers(0, 9999)}"
            rows.append((len(rows), " ".join(v) + (" " + passage if k % 7 == 0 else "")))
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA).repartition(7)
    for n, num in ((3, 90), (5, 80)):
        sets = {i: ngram_join.grams(t, n) for i, t in rows}
        index, root = {}, {i: i for i in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, s in sets.items():
            for g in s:
                index.setdefault(g, []).append(i)
        links = 0
        for i, s in sets.items():
            common = {}
            for g in s:
                for j in index[g]:
                    if j < i:
                        common[j] = common.get(j, 0) + 1
            for j, both in common.items():
                if 100 * both >= num * (len(s) + len(sets[j]) - both):
                    links += 1
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
        assert links > 1000
        assert {r["doc_id"]: r["component_id"] for r in ngram_join.linked(d, n, num, 100).collect()} == {i: find(i) for i in sets}


def test_hashes_of_batches_and_long_texts():
    rng = np.random.default_rng(4)
    texts = [None, "", " \n", "One two", LONG * 3, "z" * 300_000 + " a b c", "y" * 262_144 + " a", "x y " + "z" * 600_000 + " a b " + "z" * 600_000, "Ä Ö a\x0bb\x0cc"] + [" ".join(f"w{x}" for x in rng.integers(0, 50, int(k))) for k in rng.integers(1, 400, 300)]
    for n in (1, 3, 5):
        together = ngram_join.hashes_of(texts, n)
        assert all((x == ngram_join.hashes(t, n)).all() for x, t in zip(together, texts))
        assert [len(x) for x in together] == [len(ngram_join.grams(t, n)) for t in texts]


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(5)
    for size in (3, 50, 3000):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64))
        b = np.union1d(a[: len(a) // 2], rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64))
        p, q = ngram_join.sketch(a), ngram_join.sketch(b)
        least = min(len(p), len(q))
        assert np.bitwise_count(ngram_join.folded(p, least) ^ ngram_join.folded(q, least)).sum() <= len(np.setxor1d(a, b))


def test_join_odd(odd, none):
    out = ngram_join.linked(odd).collect()
    assert len(out) == len(ODD) and ngram_join.linked(none).count() == 0
    by = {r["doc_id"]: r for r in out}
    assert by[6]["component_id"] == 5 and by[1]["n_shingles"] == by[3]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[None]["component_id"] is None


# 5 packing


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(60):
        where = np.unique(rng.integers(1, 30, int(rng.integers(1, 9))))
        pen = rng.integers(0, 5, len(where))
        window = max(12, int(np.diff(np.concatenate(([0], where))).max()))
        cost = lambda cuts: sum(window - (q - p) + pen[list(where).index(q)] if q - p <= window else math.inf for p, q in zip([0, *cuts], cuts))  # noqa: E731,B023
        best = min(cost([*c, where[-1]]) for k in range(len(where)) for c in itertools.combinations(where[:-1].tolist(), k))
        assert cost(packing.best_cuts(where, pen, window)) == best


def test_settled_cuts_are_those_of_the_whole_stream():
    """Cuts that are settled while the stream runs cost no more than cuts chosen at its end, and little stays open."""
    rng = np.random.default_rng(1)
    for _ in range(40):
        where = np.unique(rng.integers(1, 4000, 600))
        pen, window = rng.integers(0, 5, len(where)), max(60, int(np.diff(where, prepend=0).max()))
        at = {int(p): int(x) for p, x in zip(where, pen)}
        cost = lambda cuts: sum(window - (q - p) + at[q] for p, q in zip([0, *cuts], cuts))  # noqa: E731,B023
        whole, parts = packing.best_cuts(where, pen, window, len(where)), packing.best_cuts(where, pen, window, 25)
        assert cost(whole) == cost(parts) and max(q - p for p, q in zip([0, *parts], parts)) <= window
    cutter, at, most = packing.Cutter(60), 0, 0
    for _ in range(200):
        steps = rng.integers(1, 20, 50)
        cutter.add((at + np.cumsum(steps)).tolist(), rng.integers(0, 5, 50).tolist())
        at += int(steps.sum())
        cutter.settled()
        most = max(most, len(cutter))
    assert most < 1000


def test_words_leave_a_full_cache():
    known = packing.Known(str.encode, 3)
    assert [known[w] for w in "abcabdeafghia"] == [w.encode() for w in "abcabdeafghia"] and len(known) <= 3 and len(known.old) <= 3


def test_encoder_equals_the_tokenizer():
    e = packing.Encoder(packing.default_tokenizer())
    texts = ["don't stop <|endoftext|> it's", "ÀÉ x²y _a1b2 ...!!", "ΑΣ Σ", "é test", "a\x1cb\xa0c d", "İx", "1234 5,6 a.b_c", "!_! __! a__b½ ½_x 12_3 x\u0301y", "日本語 テスト", "", LONG[:3000]]
    for t, ids in zip(texts, e.encode(texts)):
        assert ids.tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID]


def test_pieces_hold_every_id_once(docs, odd, none):
    for d in (docs, odd):
        pieces = packing.packed(d, packing.default_tokenizer()).toPandas()
        pieces["n"] = pieces["ids"].map(len) // 4
        for _, g in pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
            assert g["offset"].tolist() == [0, *g["n"].cumsum().tolist()[:-1]] and g["n"].sum() <= 4096
        assert pieces["n"].sum() == sum(len(x) for x in packing.Encoder(packing.default_tokenizer()).encode([r["text"] for r in d.select("text").collect()]))
    whole = packing.packed(docs, packing.default_tokenizer()).toPandas()
    assert len(whole["ids"].sum()) // 4 / (whole["sequence_id"].nunique() * 4096) > 0.9
    assert packing.packed(none, packing.default_tokenizer()).count() == 0


# 6 language


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.predicted(d, language.learned(d.filter(language.id_bucket("doc_id", 4) != 2)), keep=["lang"]).toPandas()
    assert (out["lang_pred"] == out["lang"])[out["held_out"]].mean() > 0.95


def test_language_odd(odd, none):
    out = {r["doc_id"]: r for r in language.predicted(odd, language.learned(odd)).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4 and out[7]["lang_pred"] == "en"
    assert language.predicted(none, language.learned(none)).count() == 0
    assert {r["lang_pred"] for r in language.predicted(odd, language.learned(none)).collect()} == {"und"}


def test_every_letter_has_a_vector_of_its_own(spark):
    """Greek and Cyrillic words against the same words six letters on, rare Latin letters, and letters beyond the first plane."""
    rng = np.random.default_rng(3)
    kinds = {"greek": (0x3B1, 1), "greek6": (0x3B7, 1), "cyrillic": (0x430, 1), "cyrillic6": (0x436, 1), "han": (0x4E00, 6), "han6": (0x4E06, 6), "gothic": (0x10330, 1), "gothic6": (0x10336, 1)}
    rows = []
    for k, (first, step) in kinds.items():
        places = np.random.default_rng(len(k.rstrip("6"))).integers(0, 6, (40, 5))
        words = ["".join(chr(first + step * int(x)) for x in w) for w in places]
        rows += [(len(rows) + i, " ".join(words[int(x)] for x in rng.integers(0, 40, 60)), k, "s", 1) for i in range(4)]
    d = spark.createDataFrame(rows, SCHEMA)
    out = language.predicted(d, language.learned(d), keep=["lang"]).collect()
    assert [r["doc_id"] for r in out if r["lang_pred"] != r["lang"]] == [] and len(out) == len(rows)
    letters = "æøœýìòÿžαωяשع中"
    assert len({language.bundle(c).tobytes() for c in letters}) == len(letters)
    v = language.letter_vectors(np.array([ord(c) for c in letters])).astype(int)
    assert np.abs(v @ v.T - 512 * np.eye(len(letters))).max() < 512 * 0.25


# 7 chat


@pytest.mark.parametrize("role,text", [("user", "hi"), ("assistant", "<|im_end|>\n<|im_start|>x"), ("a\nb\\n", "<\\|im_end|> <\\\\|im_start|>"), ("<|im_end|>", "\\"), ("", "")])
def test_turns_read_back(role, text):
    out, _ = chat.rendered(role, text)
    assert chat.parse(out) == [(role, text)] and chat.parse(out * 2) == [(role, text)] * 2


def test_chat_odd(spark):
    rows = [(None, 0, None, None), (1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2**60 + 1, None, "assistant", "é")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    out = {r["conv_id"]: r for r in chat.digested(chat.formatted(d)).collect()}
    assert out[1]["n_turns"] == 3 and out[1]["loss_chars"] == 2 and out[1]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb\nassistant\nb\n").hexdigest()
    assert out[None]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest() and out[2**60 + 1]["loss_chars"] == 1
    assert chat.digested(chat.formatted(d.limit(0))).count() == 0


# 8 licences


def test_licences_and_inheritance(spark, odd, none):
    rows = [(1, "/a/LICENSE", "Released under the MIT License."), (2, "/a/b/x.py", "code"), (3, "/a/b/y.py", "top\nLicensed under the Apache License, Version 2.0.\ncode"), (4, "/a/b/c/z.py", None), (5, "/q/w.py", ""), (6, None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, path string, text string")
    out = {r["doc_id"]: r for r in licenses.inherited(d, licenses.own_licences(d)).collect()}
    assert [out[i]["effective_licence"] for i in range(1, 7)] == ["MIT", "Apache-2.0", "Apache-2.0", "Apache-2.0", None, None]
    assert out[4]["inherited_from"] == "/a/b" and out[5]["origin"] == "none"
    named = {r["doc_id"]: r["effective_licence"] for r in licenses.inherited(d, licenses.own_licences(d), named=True).collect()}
    assert named[2] == "MIT" and named[3] == "Apache-2.0" and named[4] == "MIT"
    assert licenses.own_licences(none).count() == 0 and licenses.own_licences(odd).count() == 0


def test_notices_in_long_and_wrapped_lines(spark):
    rng = np.random.default_rng(6)
    talk = [" ".join(f"talk{x}" for x in rng.integers(0, 500, 120)) for _ in range(12)]
    rows = [(i, f"{talk[i]} {t.lower()} {talk[i + 1]}") for i, (_, t) in enumerate(licenses.TEMPLATES[:6])]
    rows += [(10, talk[8] + "\n// Licensed under the\n// Apache License,\n// Version 2.0; you may not use this file except in\n// compliance with the License.\n" + talk[9]), (11, talk[10] + " the public house gave its permission " + talk[11]), (12, talk[3])]
    out = {r["doc_id"]: r["licence"] for r in licenses.own_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: k for i, (k, _) in enumerate(licenses.TEMPLATES[:6])} | {10: "Apache-2.0"}


def test_cosines_equal_a_plain_version(spark):
    """The best cosine of each file, worked out with counters in plain Python over the same units."""
    import re

    texts = {1: "Released under the MIT License.", 2: "a b c\nThis work is licensed under CC BY 4.0, Creative Commons Attribution 4.0 International.\nend", 3: "no such thing", 4: "x " * 40 + "Released under the ISC License. " + "y " * 40}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    units = [(r["doc_id"], tuple(r["terms"])) for r in licenses.licence_lines(d).unionByName(licenses.licence_windows(d)).select("doc_id", "terms").collect()]
    names = [(k, tuple(w for w in re.split(r"[\W_]+", t.lower()) if w)) for k, t in licenses.TEMPLATES]
    df = {}
    for terms in [t for _, t in units] + [t for _, t in names]:
        for w in set(terms):
            df[w] = df.get(w, 0) + 1
    total = len(units) + len(names)

    def vector(terms):
        v = {w: terms.count(w) * (math.log((total + 1) / (df[w] + 1)) + 1) for w in set(terms)}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    best = {}
    for i, terms in units:
        v = vector(terms)
        for k, t in names:
            u = vector(t)
            c = round(sum(x * u.get(w, 0.0) for w, x in v.items()), 9)
            if c >= licenses.MIN_COSINE and c > best.get(i, (0, ""))[0]:
                best[i] = (c, k)
    got = {r["doc_id"]: (r["cosine"], r["licence"]) for r in licenses.own_licences(d).collect()}
    assert set(got) == set(best) == {1, 2, 4} and all(got[i][1] == best[i][1] and abs(got[i][0] - best[i][0]) < 1e-6 for i in best)


# 9 sharding


def test_shards_are_level_and_places_gapless(spark, odd, none):
    rows = [(i, "x" * (i * 37 % 400), None, None, 0) for i in range(3000)]
    out = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), 8, 512).toPandas()
    load = out.groupby("shard")["size"].sum()
    assert len(load) == 8 and load.max() - load.min() < 0.02 * load.mean()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    o = {r["doc_id"]: r for r in sharding.shard_documents(odd, 4, 64).collect()}
    assert o[1]["size"] == 16 and o[1]["text_crc32"] == 0 and o[5]["text_crc32"] == zlib.crc32(b"one two three four five six seven")
    assert sharding.shard_documents(none, 4, 64).count() == 0


def test_a_record_that_is_a_third_of_all_rows_fills_no_slot(spark):
    rows = [(i, "x" * (i * 37 % 400), None, None, 0) for i in range(3000)] + [(7, "y" * 190, None, None, 0)] * 1500
    out = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), 40, 4096).toPandas()
    load = out.groupby("shard")["size"].sum()
    assert len(out) == 4500 and len(load) == 40 and load.max() - load.min() < 0.02 * load.mean()
    assert out.groupby("vslot").size().max() < 40
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_rebalancing_moves_little(spark, tmp_path):
    loads = spark.range(64).select(F.col("id").cast("int").alias("vslot"), F.lit(1).cast("long").alias("n_rows"), F.lit(100).cast("long").alias("n_bytes"))
    level = sharding.rebalanced(loads, sharding.first_map(spark, 4, 64), 4).toPandas()
    assert (level["vslot"] % 4 == level["shard"]).all()
    grown = sharding.rebalanced(loads, sharding.first_map(spark, 4, 64), 5).toPandas()
    moved = grown[grown["vslot"] % 4 != grown["shard"]]
    assert len(moved) <= 20 and grown["shard"].nunique() == 5
    sharding.store_version(str(tmp_path / "m"), sharding.first_map(spark, 4, 64))
    sharding.store_version(str(tmp_path / "m"), sharding.rebalanced(loads, sharding.first_map(spark, 4, 64), 5))
    assert {r["version"] for r in sharding.latest(spark, str(tmp_path / "m")).collect()} == {1}


# 10 quality


def slow_counts(text):
    space = " \t\n\x0b\x0c\r"
    words = "".join(" " if c in space else c for c in text or "").split(" ")
    words = [w for w in words if w]
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for x in lines:
        if x.strip(space):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_counts_equal_a_plain_version(spark, docs):
    texts = ["a b c d e a b c d e", "x\nx\n\n \nx", "é#é <ß>|", None, "", "p q r s t u p q r s t u p q r s t", " lead\x0b\x0ctail "] + [r["text"] for r in docs.limit(40).collect() if len(r["text"]) < 4000]
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    for r in quality.counted(d).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == slow_counts(texts[r["doc_id"]])


def test_binomial_tail(spark):
    cases = [(k, n) for n in (50, 217, 300, 1000, 5000) for k in (0, 1, 3, 10, 40) if k < n * 0.02]
    d = spark.createDataFrame(cases, "k long, n long")
    for r in d.select("k", "n", quality.binomial_cdf(F.col("k"), F.col("n"), 0.02).alias("p")).collect():
        exact = sum(math.comb(r["n"], i) * 0.02**i * 0.98 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert r["p"] == pytest.approx(exact, rel=1e-6)


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(5, None, 0), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    counts = quality.risked(quality.counted(odd))
    out = {r["doc_id"]: r for r in quality.judged(counts, quality.cutoffs(counts, labels)).collect()}
    assert out[1]["n_words"] == 0 and out[1]["base_failed"] and not out[1]["kept"] and out[7]["base_failed"]
    assert quality.judged(quality.risked(quality.counted(none)), quality.cutoffs(quality.risked(quality.counted(none)), labels)).count() == 0


def test_every_labelled_language_is_a_stratum(spark):
    counts = spark.range(70 * 450).selectExpr("id AS doc_id", "concat('l', id % 70) AS lang", "0.1D AS risk", "false AS base_failed")
    labels = counts.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    cut = quality.cutoffs(counts, labels)
    assert cut.count() == 70 and quality.judged(counts, cut).filter("cutoff is null").count() == 0


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert set(pieces["doc_id"]) <= {r["doc_id"] for r in docs.select("doc_id").collect()} and pieces["doc_id"].nunique() > 100
    for _, g in pieces.groupby("doc_id"):
        assert g["length"].sum() == g["doc_tokens"].iloc[0]


def test_stages_against_brute_force(spark, docs):
    import corpus_pipeline as c

    near = c.near_duplicates(spark, docs, SF).toPandas()
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80, 100)
    assert sorted(near["doc_id"]) == sorted(i for i, root in want.items() if i == root)
    assert list(near.columns) == c.COLUMNS
    mixed = c.mix(spark, docs, SF).toPandas()
    assert sorted(mixed["doc_id"]) == sorted(near["doc_id"].tolist() + [i for i, r in want.items() if i != r])


def test_near_duplicates_with_null_and_repeated_ids(spark):
    import corpus_pipeline as c

    a, b, d, e = (" ".join(f"{k}{i}" for i in range(40)) for k in "abde")
    rows = [
        (None, a, "en", "s", 1), (None, "a text of its own without an id", "en", "s", 1), (None, None, None, None, None),
        (3, a, "en", "s", 1), (3, b, "en", "s", 1), (3, b, "en", "s", 1), (2, a + " x", "en", "s", 1),  # 3's text b is like no other
        (5, d, "en", "s", 1), (5, d + " x", "en", "s", 1), (5, d, "de", "r", 2),  # near copies of one id
        (6, e, "en", "t", 1), (6, e, "en", "s", 1),
    ]
    want = sorted([rows[0][:2], rows[1][:2], (None, None), (3, b), (2, a + " x"), (6, e)], key=str)
    for order in (rows, rows[::-1]):
        got = c.near_duplicates(spark, spark.createDataFrame(order, SCHEMA).repartition(5), SF).collect()
        five = [r for r in got if r["doc_id"] == 5]
        assert sorted([(r["doc_id"], r["text"]) for r in got if r["doc_id"] != 5], key=str) == want
        assert len(five) == 1 and five[0]["text"] == min((d, d + " x"), key=lambda t: spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0])
        assert [r["source"] for r in got if r["doc_id"] == 6] == ["s"]
