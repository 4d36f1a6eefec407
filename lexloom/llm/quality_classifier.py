"""Quality by positive-unlabelled learning: a linear model on text measures, fitted by minimising
the non-negative unbiased risk over trusted positives and unlabelled documents, with the class
prior estimated from the share of positives among the training labels.

Risk, with p the prior and l the logistic loss:
    p * E_pos[l(+)] + max(0, E_unl[l(-)] - p * E_pos[l(-)])
When the second term is negative, a step goes up its gradient instead, as the estimator prescribes.

The model is fitted on a bounded sample (MAX_FIT rows of each kind, taken by a hash of doc_id);
scores are computed for every row, by map tasks only. Labels, lang, source and doc_id are never
inputs of a score.

Results for odd inputs: a null text counts as empty and gets the score of an empty text; documents
with several labels count once, as positive if all of them are; null labels are no labels; without
any positive in training all scores equal the prior 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.shared import small_batches, text_or_empty

#: At most so many documents of each kind are fitted on.
MAX_FIT = 6000
#: Penalties on squared weights to choose from, by cross-validation inside the rows that may be learnt from.
PENALTIES, FOLDS, CHOSEN_ON = (1e-4, 1e-3, 1e-2, 1e-1), 3, 2000
BUCKETS = 256
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_KINDS = {
    "upper": np.isin(np.arange(256), list(range(65, 91))),
    "digit": np.isin(np.arange(256), list(range(48, 58))),
    "symbol": np.isin(np.arange(256), list(b"#*$%&|<>{}[]\\^~=+_@")),
    "stop": np.isin(np.arange(256), list(b".!?")),
    "comma": np.isin(np.arange(256), list(b",;:")),
    "line": np.isin(np.arange(256), list(b"\n")),
    "high": np.arange(256) >= 128,
}
N_FEATURES = len(_KINDS) + 9 + BUCKETS


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.mean) / self.scale, -6, 6) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(text: str) -> np.ndarray:
    """Measures of one whole text: shares of byte kinds, word and line shape, repetition, hashed byte pairs."""
    raw = text.encode("utf-8", "replace")
    b = np.frombuffer(raw, np.uint8)
    out = np.zeros(N_FEATURES, np.float32)
    if not len(b):
        return out
    counts = np.bincount(b, minlength=256)
    words = raw.split()
    n = max(1, len(words))
    shares = [np.sqrt(counts[k].sum() / len(b)) for k in _KINDS.values()]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = len(set(words))
    again = sum(map(bytes.__eq__, words[1:], words[:-1]))
    alnum = sum(map(bytes.isalnum, words))
    shares += [
        np.log1p(len(b)) / 10, np.log1p(n) / 8, (len(b) - counts[_SPACE].sum()) / n / 10, distinct / n, np.sqrt(again / n),
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(b) / max(1, len(lines))) / 8, alnum / n, len(zlib.compress(raw, 1)) / len(b),
    ]
    out[: len(shares)] = shares
    if len(b) > 1:
        pairs = (b[:-1].astype(np.uint16) * 40503 + b[1:].astype(np.uint16) * 30103) >> 8
        out[len(shares) :] = np.sqrt(np.bincount(pairs, minlength=BUCKETS) / len(pairs))
    return out


def risk(model: Model, positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The non-negative unbiased risk of a model on other rows."""
    sp, su = (np.clip(model.scores(x), 1e-12, 1 - 1e-12) for x in (positive, unlabelled))
    return float(-model.prior * np.log(sp).mean() + max(0.0, -np.log(1 - su).mean() + model.prior * np.log(1 - sp).mean()))


def chosen_penalty(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """Of PENALTIES, the one with the least risk over FOLDS folds of the rows to fit on: at most CHOSEN_ON of each kind, in their order."""
    p, u = positive[:CHOSEN_ON], unlabelled[:CHOSEN_ON]
    if min(len(p), len(u)) < 2 * FOLDS:
        return PENALTIES[-1]

    def over_folds(penalty: float) -> float:
        out = 0.0
        for k in range(FOLDS):
            a, b = np.arange(len(p)) % FOLDS == k, np.arange(len(u)) % FOLDS == k
            out += risk(fit(p[~a], u[~b], prior, penalty, steps=150), p[a], u[b])
        return out

    return min(PENALTIES, key=over_folds)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, penalty: float | None = None, steps: int = 400, rate: float = 0.05) -> Model:
    """Full-batch Adam on the non-negative risk, with a penalty on squared weights."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, prior)
    l2 = chosen_penalty(positive, unlabelled, prior) if penalty is None else penalty
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    w, m, v = np.zeros(p.shape[1] + 1), 0.0, 0.0
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        as_positive = -(p.T @ (1 - sp)) / len(p)  # gradients of the mean losses
        positive_as_negative, unlabelled_as_negative = p.T @ sp / len(p), u.T @ su / len(u)
        rest = np.log1p(np.exp(u @ w)).mean() - prior * np.log1p(np.exp(p @ w)).mean()
        if rest >= 0:
            g = prior * as_positive + unlabelled_as_negative - prior * positive_as_negative
        else:
            g = prior * positive_as_negative - unlabelled_as_negative
        g = g + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def _features_of(docs: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["features"])

    one = docs.groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id")  # a doc_id counts once
    rows = one.select(text_or_empty().alias("text")).mapInArrow(run, "features binary").collect()  # at most MAX_FIT rows
    return np.array([np.frombuffer(r.features, np.float32) for r in rows], np.float64).reshape(-1, N_FEATURES)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, max_fit: int = MAX_FIT) -> Model:
    """Fit on labels (doc_id, quality) of rows where `may_learn` holds, and on documents without a label in training."""
    small_batches(docs.sparkSession)
    known = labels.where(may_learn & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = known.agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good")).first()
    prior = min(0.98, max(0.02, counts.good / counts.n)) if counts.n else 0.5

    def sample(ids: DataFrame) -> DataFrame:
        return ids.orderBy(F.xxhash64(F.col("doc_id"), F.lit("fit")), "doc_id").limit(max_fit)

    good = sample(known.where("quality = 1").select("doc_id"))
    rest = sample(docs.select("doc_id").distinct().join(known, "doc_id", "left_anti"))
    return fit(_features_of(docs.join(F.broadcast(good), "doc_id", "left_semi")), _features_of(docs.join(F.broadcast(rest), "doc_id", "left_semi")), prior)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row of docs."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            score = sent.value.scores(np.array([features(t) for t in texts], np.float64).reshape(-1, N_FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
