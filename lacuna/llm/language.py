"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A trigram is bound by multiplying its letters' vectors, each
permuted (rotated) by its place; a text or a language is the bundle (sum) of its trigrams' vectors; the language of a text is
the prototype with the largest cosine. The whole text is used.

Letters are lower-cased; the letter of every code point has a vector of its own, hashed from the code point and the seed, and any run of
non-letters is one blank. The distinct trigrams of a text are bound when it is read, BLOCK at a time; no table of trigrams is kept.

Training reads at most `max_train` documents of each language (documented bound; a hash of the id picks them, so that
the choice doesn't depend on partitions). Prediction reads all rows.

Defined results: null text, empty text and text without a letter give `und`, score 0; null languages don't train; with no
trained language everything is `und`; ties go to the language that sorts first; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bucket, kept_ddl, map_arrow

DIMENSIONS, SEED, MAX_TRAIN = 512, 20240229, 2000
#: Trigrams bound at a time; code points whose symbols are worked out at a time.
BLOCK, PAGE = 2048, 4096
_KEPT: dict = {}


def _symbols(raw: np.ndarray) -> np.ndarray:
    """The lower-cased letter of each code point, 0 for what is no letter. Pages of code points are worked out when a text first has them."""
    if not _KEPT:
        _KEPT["symbols"], _KEPT["pages"] = np.zeros(0x110000, np.int32), np.zeros(0x110000 // PAGE, bool)
    table, known = _KEPT["symbols"], _KEPT["pages"]
    pages = np.unique(raw // PAGE)
    for page in pages[~known[pages]].tolist():
        for i in range(page * PAGE, (page + 1) * PAGE):
            c = chr(i).lower()[0]
            table[i] = ord(c) if c.isalpha() else 0
        known[page] = True
    return table[raw].astype(np.int64)


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A row of DIMENSIONS values +1 or -1 for each code point."""
    with np.errstate(over="ignore"):
        x = (points.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS // 64) + np.arange(DIMENSIONS // 64, dtype=np.uint64) + np.uint64(SEED << 32)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (three letters of 21 bits) and counts of the trigrams of a text's letters and blanks; none if it has no letter."""
    symbols = _symbols(np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32))
    if not symbols.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbols = np.concatenate(([0], symbols, [0]))
    symbols = symbols[np.concatenate(([True], (symbols[1:] != 0) | (symbols[:-1] != 0)))]
    codes = symbols[:-2] << 42 | symbols[1:-1] << 21 | symbols[2:]
    codes.sort()
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[starts], np.diff(np.append(starts, len(codes)))


def bundled(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the trigrams' vectors."""
    total, low = np.zeros(DIMENSIONS, np.float32), (1 << 21) - 1
    for i in range(0, len(codes), BLOCK):
        c = codes[i : i + BLOCK]
        points, at = np.unique(np.concatenate((c >> 42, c >> 21 & low, c & low)), return_inverse=True)
        letters, (x, y, z) = letter_vectors(points), at.reshape(3, -1)
        v = np.roll(letters, 2, axis=1)[x]
        v *= np.roll(letters, 1, axis=1)[y]
        v *= letters[z]
        total += counts[i : i + BLOCK].astype(np.float32) @ v.astype(np.float32)
    return total


def bundle(text: str | None) -> np.ndarray:
    return bundled(*trigrams(text))


def learned(docs: DataFrame, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their prototypes, of length 1. Only the sums reach the driver: DIMENSIONS numbers per language."""
    rows = docs.filter("lang is not null").select("doc_id", "text", "lang")
    seen = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not seen:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    share = F.create_map(*(x for k, n in seen.items() for x in (F.lit(k), F.lit(min(1.0, max_train / n)))))
    rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)

    # a task adds up its own texts; the executors add up the tasks', place by place
    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for part in parts:
            for lang, text in zip(part["lang"], part["text"], strict=True):
                total[lang] = total.get(lang, 0) + bundle(text).astype(np.float64)
        if total:
            yield pd.DataFrame({"lang": list(total), "v": [x.tolist() for x in total.values()]})

    parts = rows.select("lang", "text").mapInPandas(sums, "lang string, v array<double>")
    total = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    got: dict[str, np.ndarray] = {}
    for r in total.collect():
        got.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["i"]] = r["x"]
    names = sorted(got)
    matrix = np.array([got[k] for k in names], np.float32)
    return names, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)


def predicted(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: Sequence[str] = ()) -> DataFrame:
    """docs' doc_id with held-out mark, language and cosine (0 where it is negative), and the columns to keep."""
    names, matrix = model

    def score(x):
        langs, scores = [], []
        for text in x["text"].to_pylist():
            codes, counts = trigrams(text)
            if not len(codes) or not names:
                langs.append("und")
                scores.append(0.0)
                continue
            v = bundled(codes, counts)
            cosines = matrix @ v / max(float(np.linalg.norm(v)), 1e-9)
            best = int(np.argmax(cosines))
            langs.append(names[best])
            scores.append(float(min(1.0, max(0.0, cosines[best]))))
        return {"doc_id": x["doc_id"], "held_out": x["held_out"], "lang_pred": langs, "score": scores} | {c: x[c] for c in keep}

    rows = docs.select("doc_id", *{"text", *keep}, (id_bucket("doc_id", 4) == 2).alias("held_out"))
    return map_arrow(rows, score, "doc_id long, held_out boolean, lang_pred string, score double" + kept_ddl(docs, keep))


def least_cosine(n: Column) -> Column:
    """The cosine below which a text of n characters is in none of the learned languages. A text of a language has a cosine of about
    sqrt(n / (n + 400)) with its prototype, as few trigrams are an uneven sample of its profile; chance gives 1 / sqrt(DIMENSIONS). A third of the former, less twice
    the latter, is a bound that rises smoothly with the length; where it is below zero nothing can be told."""
    return F.sqrt(n / (n + 400)) / 3 - 2 / DIMENSIONS**0.5


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predicted(docs, learned(docs.filter(id_bucket("doc_id", 4) != 2)))
