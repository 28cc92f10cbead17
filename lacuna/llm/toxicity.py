"""Toxicity: non-negative positive-unlabelled learning.

Linear classifiers over the distinct lower-cased words of a text and their beginnings (letters only) are trained with numpy from confirmed toxic
examples (P) and unlabelled text (U). The risk is  prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)]);  when the second part
falls below zero, the step goes against it (the non-negative correction). Several classifiers see different two thirds of U; their logits are averaged.

U is drawn from all documents, labelled or not; labels other than toxic are never used. The prior (the share of toxic texts in U) is a parameter, or it is estimated
without negative labels: a classifier of two thirds of P and U scores the rest, and the prior is the least ratio, over cutoffs that most of P is above, of the shares of U
and of P above the cutoff (what is above it in U is at least prior times what is in P).

Bounds (documented parameters): about max_positive toxic and max_unlabelled other texts at most are sampled by a hash of the
id. Scoring reads every whole text.

Defined results: null and empty texts, and texts without known words, get the score of the bias alone; null labels and labels
without a document don't train; repeated label rows count once; without any toxic example all scores are next to 0 (the sigmoid of -30); equal texts get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bucket, kept_ddl, map_arrow, stored

WORD = re.compile(r"[^\W\d_]+")
MAX_POSITIVE, MAX_UNLABELLED, MODELS, STEPS, MIN_Z = 4000, 12000, 3, 80, 4.0
MOST_PRIOR, GUESS_ROWS = 0.5, 100


def features(text: str | None) -> set[str]:
    """Words, and beginnings (^) of 5 to 7 letters of longer words, these also with a mark for two and for three times or
    more: languages that inflect or compound insults share their beginnings."""
    counts = Counter(WORD.findall((text or "").lower()))
    out, starts = set(counts), Counter()
    for w, n in counts.items():
        for k in (5, 6, 7):
            if len(w) > k:
                starts[w[:k]] += n
    for k, n in starts.items():
        out.add("^" + k)
        if n > 1:
            out.add("^2" + k)
            if n > 2:
                out.add("^3" + k)
    return out


def sampled(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """Features w of the sampled texts with their sides p and u. docs are those that may train; labels are read for toxic ones alone."""
    toxic = labels.filter("doc_id is not null and toxic = 1").select("doc_id").distinct()
    n_pos, n_all = toxic.count(), docs.count()

    def part(salt: int, most: int, n: int):
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < int(1e6 * min(1, most / max(1, n)))

    # at most about max_positive rows
    picked = F.broadcast(toxic.filter(part(0, max_positive, n_pos)).withColumn("p", F.lit(True)))
    rows = docs.select("doc_id", "text").withColumn("u", part(1, max_unlabelled, n_all)).join(picked, "doc_id", "left").select("text", F.coalesce("p", F.lit(False)).alias("p"), "u").filter("p or u")
    sets = map_arrow(rows, lambda x: {"w": [sorted(features(t)) for t in x["text"].to_pylist()], "p": x["p"], "u": x["u"]}, "w array<string>, p boolean, u boolean")
    return stored(sets, "toxicity-sample")


def telling(sets: DataFrame, min_z: float = MIN_Z) -> list[str]:
    """Features, sorted, whose share of texts differs between P and U by min_z standard errors: rare words that a classifier
    would only learn by heart stay out."""
    n, m = (max(1, v or 0) for v in sets.agg(F.count_if("p"), F.count_if("u")).first())
    counts = sets.select("p", "u", F.explode("w").alias("w")).groupBy("w").agg(F.count_if("p").alias("a"), F.count_if("u").alias("b")).filter("a + b >= 3")
    both = (F.col("a") + F.col("b") + 1) / (n + m + 2)
    z = F.abs(F.col("a") / n - F.col("b") / m) / F.sqrt(both * (1 - both) * (1 / n + 1 / m))
    return sorted(r["w"] for r in counts.filter((both < 1) & (z >= min_z)).select("w").collect())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fitted(pos: list[list[int]], unl: list[list[int]], names: list[str], prior: float, models: int = MODELS, steps: int = STEPS) -> tuple[dict[str, float], float]:
    """Weights by feature and the bias. pos and unl hold the places in names of each text's features."""
    if not pos:
        return {}, -30.0

    def packed(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.fromiter((i for r in rows for i in r), np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    n = len(names)
    (pi, pr), total_w, total_b = packed(pos), np.zeros(n), 0.0
    for model in range(models):
        part = [r for i, r in enumerate(unl) if models == 1 or i % models != model] or unl
        ui, ur = packed(part)
        w, b, lr = np.zeros(n), float(np.log(prior / (1 - prior))) if prior < 1 else 0.0, 0.05
        m, v = np.zeros(n + 1), np.zeros(n + 1)
        for step in range(1, steps + 1):
            gp = np.bincount(pr, w[pi], len(pos)) + b
            gu = np.bincount(ur, w[ui], len(part)) + b
            sp, su = _sigmoid(gp), _sigmoid(gu)
            # logistic loss: l(+) = log(1 + e^-g), l(-) = log(1 + e^g)
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            dp_plus, dp_minus, du = prior * (sp - 1) / len(pos), prior * sp / len(pos), su / max(1, len(part))
            on_p, on_u = (dp_plus - dp_minus, du) if negative >= 0 else (dp_minus, -du)
            grad = np.append(np.bincount(pi, on_p[pr], n) + np.bincount(ui, on_u[ur], n) + 1e-4 * w, on_p.sum() + on_u.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            move = lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
            w, b = w - move[:-1], b - move[-1]
        total_w, total_b = total_w + w / models, total_b + b / models
    return {k: float(total_w[i]) for i, k in enumerate(names) if abs(total_w[i]) > 1e-4}, float(total_b)


def logits(rows: list[list[int]], names: list[str], model: tuple[dict[str, float], float]) -> np.ndarray:
    weights = [model[0].get(k, 0.0) for k in names]
    return np.array([model[1] + sum(weights[i] for i in r) for r in rows], float)


def estimated_prior(pos: list[list[int]], unl: list[list[int]], names: list[str], guess: float = 0.1) -> float:
    """The share of toxic texts in U, from P and U alone. Rows come in an order that says nothing about them; each third is scored by a classifier of the others. Without P: 0.
    The ratio is a bound from above; where it is over MOST_PRIOR (or no feature tells anything) the sample is too small to tell P from U, and the guess stands. It also counts as much as GUESS_ROWS positives, as a few texts bound little."""
    if not pos or not unl:
        return 0.0
    if not names:
        return guess
    out = []
    for k in range(3):
        model = fitted([r for i, r in enumerate(pos) if i % 3 != k], [r for i, r in enumerate(unl) if i % 3 != k], names, guess, 1)
        p, u = logits(pos[k::3], names, model), logits(unl[k::3], names, model)
        if len(p) and len(u):
            cuts = np.quantile(p, np.linspace(0.02, 0.5, 25))
            out.append(min(max((u >= c).mean(), 1 / len(u)) / (p >= c).mean() for c in cuts))
    if not out or np.mean(out) > MOST_PRIOR:
        return guess
    return float((len(pos) * np.mean(out) + GUESS_ROWS * guess) / (len(pos) + GUESS_ROWS))


def scored(docs: DataFrame, model: tuple[dict[str, float], float], keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, and the columns to keep."""
    weights, bias = model

    def make(x):
        get = weights.get
        s = _sigmoid(np.array([bias + sum(get(w, 0.0) for w in features(t)) for t in x["text"].to_pylist()], float))
        return {"doc_id": x["doc_id"], "held_out": x["held_out"], "score": s, "predicted": (s >= 0.5).astype(np.int32)} | {c: x[c] for c in keep}

    rows = docs.select("doc_id", *{"text", *keep}, (id_bucket("doc_id", 5) == 0).alias("held_out"))
    return map_arrow(rows, make, "doc_id long, held_out boolean, score double, predicted int" + kept_ddl(docs, keep))


def trained(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> tuple[dict[str, float], float]:
    """A model from the rows whose id hash modulo 5 isn't 0; without a prior it is estimated. Only telling features and, of the sample, their places reach the driver."""
    learn = id_bucket("doc_id", 5) != 0
    sets = sampled(docs.filter(learn), labels.filter(learn))
    names = telling(sets)
    place = {w: i for i, w in enumerate(names)}
    rows = map_arrow(sets, lambda x: {"w": [[place[w] for w in ws if w in place] for ws in x["w"].to_pylist()], "p": x["p"], "u": x["u"]}, "w array<int>, p boolean, u boolean").collect()
    rows.sort(key=lambda r: (r["w"], r["p"], r["u"]))
    pos, unl = ([r["w"] for r in rows if r[c]] for c in "pu")
    if prior is None:
        # the order by content says nothing about a row's side
        prior = estimated_prior(*(sorted(x, key=lambda w: hash(tuple(w))) for x in (pos, unl)), names)
    return fitted(pos, unl, names, prior)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
