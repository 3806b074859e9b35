"""Operator 6: toxicity by non-negative positive-unlabelled (nnPU) learning.

Confirmed toxic documents are the positives; all other text is unlabelled, as toxic documents hide in it too. Words
and word beginnings that are far more frequent in positives than in unlabelled texts (G-test) become binary features, and
a few numpy classifiers minimise the class-prior-corrected risk  pi * R+(f) + max(0, Ru-(f) - pi * R+-(f))  with the
sigmoid loss; where the second term falls below zero the step goes against its gradient (Kiryo et al., 2017). The
score is the mean of the members, scaled so that the share of the unlabelled at 0.7 or more is the class prior.

Training uses at most ``max_positive`` positives and about ``max_unlabelled`` unlabelled documents, both picked by a
hash of the id; every document is scored on its whole text, in one pass without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxpress.llm.common import append_columns, fold, materialize, read

_P = "__ctx_"
#: ASCII letters to lower case, ASCII marks and controls to blanks.
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 if b < 128 else b for b in range(256))


def features_of(text: str) -> set[bytes]:
    """The distinct words of a text and, marked by a star, their first four and five bytes (stems of inflected words)."""
    words = set(text.encode("utf-8").translate(_FOLD).split())
    return words | {w[:4] + b"*" for w in words} | {w[:5] + b"*" for w in words}


@dataclass(frozen=True)
class Model:
    """``weights`` by word; a text scores ``sigmoid(scale * (bias + sum of its words' weights) + shift)``."""

    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -1.0
    scale: float = 1.0
    shift: float = 0.0

    def score(self, text: str) -> float:
        found = self.weights.keys() & features_of(text) if self.weights else ()
        z = self.scale * (self.bias + sum(self.weights[w] for w in sorted(found))) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def nnpu_fit(p: np.ndarray, u: np.ndarray, prior: float, seed: int = 0, steps: int = 250, rate: float = 0.05, decay: float = 1e-4, beta: float = 0.0, gamma: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier by the non-negative risk, with Adam on the full sample."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, 0.01, p.shape[1]).astype(np.float32), np.float32(-1.0)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        sp, su = 1 / (1 + np.exp(-np.clip(p @ w + b, -30, 30))), 1 / (1 + np.exp(-np.clip(u @ w + b, -30, 30)))
        negative = su.mean() - prior * sp.mean()  # risk of the negatives, estimated from the unlabelled
        gp, gu = sp * (1 - sp) / len(p), su * (1 - su) / len(u)  # d loss / d f, mean over a sample
        if negative >= -beta:
            dp, du = -2 * prior * gp, gu  # of pi * R+ (falls with f) and of Ru- - pi * R+-
        else:
            dp, du = gamma * prior * gp, -gamma * gu
        grad = np.append(dp @ p + du @ u + decay * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1].astype(np.float32), b - np.float32(step[-1])
    return w, float(b)


def _training_rows(docs: DataFrame, labels: DataFrame, learns, max_positive: int, max_unlabelled: int) -> tuple[DataFrame, float]:
    """(positive, words) of the training sample, and the class prior: the share of toxic rows among the labels learnt from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(learns)
    n, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    order = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(6)), F.lit(1 << 20))
    share = int((1 << 20) * min(1.0, max_positive / max(1, n_toxic)))
    positive = known.where((F.col("toxic") == 1) & (order < share)).select("doc_id", F.lit(True).alias("positive")).limit(2 * max_positive)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(learns & F.col("doc_id").isNotNull())
    part = int((1 << 20) * min(1.0, max_unlabelled / max(1, docs.count())))
    # the positives' ids are at most 2 * max_positive rows
    sample = rows.join(F.broadcast(positive), "doc_id", "left").where(F.col("positive") | (order < part))
    sample = sample.select(F.coalesce("positive", F.lit(False)).alias("positive"), (order < part).alias("unlabelled"), "text")

    def make():
        return lambda texts: {f"{_P}words": pa.array([sorted(features_of(t)) for t in texts], pa.list_(pa.binary()))}

    return materialize(append_columns(sample, f"{_P}words array<binary>", make).drop("text"), "sample"), (n_toxic + 0.5) / (n + 1)


def train(docs: DataFrame, labels: DataFrame, learns=None, max_positive: int = 2000, max_unlabelled: int = 8000, features: int = 256, members: int = 3) -> Model:
    """Fits the model; ``learns`` is the condition on doc_id under which labels and texts may be learnt from.

    Without positives, or if no word sets them apart, the model has no features and scores every text alike, low.
    """
    sample, prior = _training_rows(docs, labels, F.lit(True) if learns is None else learns, max_positive, max_unlabelled)
    n_p, n_u = sample.agg(F.coalesce(F.sum(F.col("positive").cast("int")), F.lit(0)), F.coalesce(F.sum(F.col("unlabelled").cast("int")), F.lit(0))).first()
    if not n_p or not n_u:
        return Model()
    word = F.explode(f"{_P}words").alias("word")
    df = sample.select("positive", "unlabelled", word).groupBy("word").agg(F.sum(F.col("positive").cast("int")).alias("a"), F.sum(F.col("unlabelled").cast("int")).alias("c"))
    pa_, pc = (F.col("a") + 0.5) / (n_p + 1), (F.col("c") + 0.5) / (n_u + 1)
    pool = (F.col("a") + F.col("c") + 1) / (n_p + n_u + 2)
    g = 2 * (F.col("a") * F.log(pa_ / pool) + (n_p - F.col("a")) * F.log((1 - pa_ + 1e-9) / (1 - pool)) + F.col("c") * F.log(pc / pool) + (n_u - F.col("c")) * F.log((1 - pc + 1e-9) / (1 - pool)))
    top = df.where((F.col("a") >= 2) & (pa_ > 2 * pc)).select("word", g.alias("g")).where("g > 15").orderBy(F.desc("g"), "word").limit(features)
    vocabulary = [bytes(r["word"]) for r in top.collect()]  # at most ``features`` rows
    if not vocabulary:
        return Model()
    index = {w: k for k, w in enumerate(vocabulary)}
    lit = F.array(*(F.lit(bytearray(w)) for w in vocabulary))
    rows = sample.select("positive", "unlabelled", F.array_intersect(f"{_P}words", lit).alias("hit")).collect()  # 2 * max_positive + about max_unlabelled rows of a few words
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, r in enumerate(rows):
        x[i, [index[bytes(w)] for w in r["hit"]]] = 1
    is_p, is_u = np.array([r["positive"] for r in rows]), np.array([r["unlabelled"] for r in rows])
    return fit_model(vocabulary, x[is_p], x[is_u], prior, members)


def fit_model(vocabulary: list[bytes], p: np.ndarray, u: np.ndarray, prior: float, members: int = 3) -> Model:
    """Members on bootstrap samples, averaged; then the scale of the score."""
    fits = []
    for k in range(members):
        rng = np.random.default_rng(k)
        fits.append(nnpu_fit(p[rng.integers(0, len(p), len(p))], u[rng.integers(0, len(u), len(u))], prior, k))
    w, b = np.mean([f[0] for f in fits], axis=0), float(np.mean([f[1] for f in fits]))
    f = np.sort(u @ w + b)
    cut = threshold(f, p @ w + b, prior)
    scale = 4.0 / max(0.05, cut - float(np.median(f)))  # the middle of the unlabelled then scores 0.04
    return Model(dict(zip(vocabulary, w.astype(float).tolist(), strict=True)), b, scale, float(np.log(0.7 / 0.3) - scale * cut))


def threshold(u: np.ndarray, p: np.ndarray, prior: float) -> float:
    """The margin that splits the unlabelled at the class prior, moved into the middle of the widest gap near there."""
    k = int(round((1 - prior) * (len(u) - 1)))
    span = max(1, int(0.6 * prior * len(u)))
    lo, hi = max(0, k - span), min(len(u) - 1, k + span)
    if hi <= lo:
        return float(u[k]) + 1e-6
    gaps = np.diff(u[lo : hi + 1])
    at = lo + int(np.argmax(gaps))
    return float((u[at] + u[at + 1]) / 2)


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``__ctx_score``; a null text is empty and scores as a text without any of the words."""

    def make():
        return lambda texts: {f"{_P}score": pa.array([model.score(t) for t in texts], pa.float64())}

    return append_columns(docs, f"{_P}score double", make)


def toxicity_filter(docs: DataFrame, labels: DataFrame, learns=None, cut: float = 0.7, **how) -> DataFrame:
    """The rows of ``docs`` scored below ``cut``, with its own columns."""
    return with_scores(docs, train(docs, labels, learns, **how)).where(F.col(f"{_P}score") < cut).select(*docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"), fold(3) != 1)
    return with_scores(docs, model).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold(3) == 1).alias("held_out"),
        F.col(f"{_P}score").alias("score"),
        (F.col(f"{_P}score") >= 0.7).cast("int").alias("predicted"),
    )
