"""Quality rules with risk-controlled thresholds.

Each document gets counts (words, symbols, repeated lines and windows, ...), each count a rate with a fixed scale,
and the largest scaled rate is its risk. Per stratum (language) a cutoff on the risk is chosen from a fixed grid:
labelled good documents are the holdout, and a cutoff is allowed only if the exact binomial bound says that it rejects
at most `alpha` of good documents. Cutoffs are tried from lenient to strict and the first that fails ends the
sequence, so that no correction is needed along the grid; across strata the error `delta` is shared evenly (Bonferroni).
With probability 1 - delta, no stratum loses more than alpha of its good documents to the cutoffs.

The test is P(Bin(n, alpha) <= k) <= delta / strata (the Clopper-Pearson bound is then below alpha). Its sum takes a
fixed number of terms and a bound for the rest, so that its cost doesn't grow with the labels.
Everything is DataFrame expressions; a document's own windows are compared within its row.

Defined results: null text has no words and fails the base rules; a null language is the stratum `und`; labels without
a document and null labels are ignored; repeated label rows count once per (document, label); a stratum with too few
labels gets no cutoff and keeps all that passes the base rules; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, let, stored, text_or_empty

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
ALPHA, DELTA = 0.02, 0.05
#: The rate of each count per word (per word character for symbols and capitals) that makes a risk of 1.
SCALES = {"n_symbols": 0.05, "n_bangs": 0.30, "n_capitals": 0.40, "n_dup_lines": 0.05, "n_repeat_words": 0.20, "n_adjacent": 0.10}
#: Cutoffs on the risk, lenient first.
GRID = (8.0, 5.0, 3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5)
SUM_TERMS = 2000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS), "")


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash stands twice or more: windows are five words, starts ascend."""
    def marked(order: Column) -> Column:
        last = F.size(order) - 1
        twice = F.filter(
            F.transform(order, lambda x, k: F.when(
                (F.get(order, k - 1)["h"] == x["h"]) & (k > 0) | (F.get(order, k + 1)["h"] == x["h"]) & (k < last), x["i"])),
            lambda i: i.isNotNull())
        return let(F.sort_array(twice), lambda at: F.aggregate(
            F.transform(at, lambda i, k: F.when(k == F.size(at) - 1, F.lit(5)).otherwise(F.least(F.lit(5), F.get(at, k + 1) - i))),
            F.lit(0), lambda a, x: a + x))

    order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(order, marked))


def _windows(words: Column) -> Column:
    """A hash of each five words in a row (two windows count as equal when their 64-bit hashes are): hashes of words are joined to pairs, these to
    fours, and a fifth added, array by array, so that no element is looked up by its place."""
    def joined(left: Column, right: Column, step: int) -> Column:
        n = F.size(right) - step
        return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1 + step), n), lambda x, y: F.xxhash64(x, y))

    def fives(h: Column) -> Column:
        return let(joined(h, h, 1), lambda twos: let(joined(twos, twos, 2), lambda fours: joined(fours, h, 4)))

    return F.when(F.size(words) >= 5, let(F.transform(words, lambda x: F.xxhash64(x)), fives)).otherwise(F.array().cast("array<bigint>"))


def _matches(text: Column, pattern: str) -> Column:
    """Bytes that one-byte characters of a class take: nothing is built per character."""
    return F.octet_length(text) - F.octet_length(F.regexp_replace(text, pattern, ""))


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' doc_id and lang with the counts of every whole text."""
    t = text_or_empty(text)
    rows = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), t.alias("t"), words_of(t).alias("w"))
    lines = F.filter(F.split(F.col("t"), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    n, w = F.size("w"), F.col("w")
    # each word beside the one before it
    adjacent = F.zip_with(F.slice(w, F.lit(1), n - 1), F.slice(w, F.lit(2), n - 1), lambda x, y: x == y)
    return rows.select(
        "doc_id", "lang",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _matches(F.col("t"), f"[{SYMBOLS}]+").cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(_windows(w), _covered).cast("long").alias("n_repeat_words"),
        _matches(F.col("t"), "!+").cast("long").alias("n_bangs"),
        _matches(F.col("t"), "[A-Z]+").cast("long").alias("n_capitals"),
        F.when(n > 1, F.size(F.array_remove(adjacent, False))).otherwise(0).cast("long").alias("n_adjacent"),
    )


def risked(counts: DataFrame) -> DataFrame:
    """counts, written once, with risk and base_failed: the texts aren't read again, and the optimiser doesn't repeat the counting in each filter."""
    counts = stored(counts, "quality")
    risk = F.greatest(*(F.col(c) / F.greatest(F.col("word_chars" if c in ("n_symbols", "n_capitals") else "n_words"), F.lit(1)) / s for c, s in SCALES.items()))
    return counts.withColumn("risk", risk).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _log_gamma(x: Column) -> Column:
    """Stirling's series after raising x by 8; x > 0."""
    y = x + 8
    low = F.log(x * (x + 1)) + F.log((x + 2) * (x + 3)) + F.log((x + 4) * (x + 5)) + F.log((x + 6) * (x + 7))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k below n p, where its terms fall from k down; 1 elsewhere (there it is over 1/4, which no test passes).

    SUM_TERMS terms are added one by one and the rest is bounded by a geometric series, so that the result is never too small.
    """
    odds = (1 - p) / p
    log_top = _log_gamma((n + 1).cast("double")) - _log_gamma((k + 1).cast("double")) - _log_gamma((n - k + 1).cast("double")) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))

    def step(s: Column, i: Column) -> Column:
        t = s["t"] * F.greatest(k - i, F.lit(0)) / (n - k + i + 1) * odds
        return F.struct(t.alias("t"), (s["s"] + t).alias("s"))

    summed = F.aggregate(F.sequence(F.lit(0), F.lit(SUM_TERMS - 1)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step)
    ratio = F.greatest(k - SUM_TERMS, F.lit(0)) / (n - k + SUM_TERMS + 1) * odds
    rest = let(summed, lambda x: x["s"] + x["t"] * ratio / (1 - ratio))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(log_top) * rest)


def cutoffs(counts: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum that earns a cutoff: lang, cutoff. Every language with labelled good rows is a stratum."""
    good = labels.filter("doc_id is not null and quality = 1").select("doc_id").distinct()
    held = counts.filter(~F.col("base_failed")).select("doc_id", "lang", "risk").join(good, "doc_id")
    sums = held.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *(F.sum((F.col("risk") > c).cast("long")).alias(f"k{i}") for i, c in enumerate(GRID)))
    strata = sums.crossJoin(F.broadcast(sums.agg(F.count(F.lit(1)).alias("strata"))))
    tests = strata.select("lang", "n", "strata", F.posexplode(F.array(*(F.struct(F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, c in enumerate(GRID))))).select("lang", "n", "strata", "pos", "col.*")
    tests = tests.withColumn("passes", binomial_cdf(F.col("k"), F.col("n"), alpha) <= delta / F.col("strata"))
    so_far = Window.partitionBy("lang").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return tests.withColumn("passes", F.min("passes").over(so_far)).filter("passes").groupBy("lang").agg(F.min("cutoff").alias("cutoff"))


def judged(counts: DataFrame, chosen: DataFrame) -> DataFrame:
    """counts with cutoff and kept. chosen has only languages with hundreds of labelled rows, so it is broadcast."""
    out = counts.join(F.broadcast(chosen), "lang", "left")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("cutoff").isNull() | (F.col("risk") <= F.col("cutoff"))))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = risked(counted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    out = judged(counts, cutoffs(counts, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "cutoff")
