"""Operator 10, toxicity: non-negative positive-unlabelled learning.

Training sees confirmed toxic documents and a sample of all documents, whose labels it does not use. Buckets that the
confirmed documents hold far more often than the sample become features; a logistic model on them minimises the
class-prior-corrected risk  prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)).  Where the second
term falls below zero, the step goes the other way, which keeps the model from fitting the confirmed documents by heart.

A feature's value is its count over the square root of the text's length, so that neither a chance word in a long text
nor the mere length decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import classify, common, features

SPEC = features.Spec(orders=(4, 6, 8), bits=18, lower=True)
#: Bounds of the training sample: so many confirmed and so many unlabelled documents at most, lowest hash of the id first.
POSITIVE_ROWS, UNLABELLED_ROWS = 1536, 3072
#: Features of the model: so many buckets at most, those of the strongest evidence; each in so many confirmed documents
#: at least, and so many times as often as in the sample.
FEATURES, SUPPORT, RATIO = 2048, 4, 3.0
STEPS, RATE, MOMENTUM, DECAY = 400, 1.0, 0.9, 5e-4
UNIT_BYTES = 600.0
#: The class prior where no labels tell it, and its bounds.
PRIOR, PRIOR_RANGE = 0.1, (0.01, 0.5)
THRESHOLD = 0.5


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def logit(self, total: np.ndarray, _count: np.ndarray, size: np.ndarray) -> np.ndarray:
        return total.sum(axis=1) / _scale(size) + self.bias


def _scale(size: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(1.0, np.asarray(size) / UNIT_BYTES))


def strongest(rate_p: np.ndarray, rate_u: np.ndarray, m: int, u: int, most: int = FEATURES) -> np.ndarray:
    """Buckets, rising, that m confirmed documents hold most significantly more often than u unlabelled ones; `most` at most."""
    strength = (rate_p - rate_u) / np.sqrt((rate_u + 1 / u) * (1 / m + 1 / u))
    strength[(rate_p * m < SUPPORT) | (rate_p < RATIO * rate_u)] = 0
    return np.sort(np.argsort(-strength, kind="stable")[: min(most, int((strength > 0).sum()))])


def train(positive: list[tuple[np.ndarray, np.ndarray, int]], unlabelled: list[tuple[np.ndarray, np.ndarray, int]], chosen: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights of the chosen buckets, and the bias. Each document: buckets (all of them chosen ones), counts, bytes."""
    m, n = len(positive), len(positive) + len(unlabelled)
    both = positive + unlabelled
    column = np.searchsorted(chosen, np.concatenate([d[0] for d in both]))
    row = np.repeat(np.arange(n), [len(d[0]) for d in both])
    value = np.concatenate([d[1] for d in both]) / _scale(np.array([d[2] for d in both]))[row]
    w, b, speed, speed_b = np.zeros(len(chosen)), float(np.log(prior / (1 - prior))), np.zeros(len(chosen)), 0.0
    for _ in range(STEPS):
        z = np.bincount(row, w[column] * value, n) + b
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        loss = np.logaddexp(0, z)
        slope = np.empty(n)
        if loss[m:].mean() - prior * loss[:m].mean() >= 0:
            slope[:m], slope[m:] = -prior / m, p[m:] / (n - m)
        else:
            slope[:m], slope[m:] = prior * p[:m] / m, -p[m:] / (n - m)
        speed = MOMENTUM * speed + np.bincount(column, slope[row] * value, len(chosen)) + DECAY * w
        speed_b = MOMENTUM * speed_b + slope.sum()
        w, b = w - RATE * speed, b - RATE * speed_b
    return w, float(b)


def class_prior(labels: DataFrame, label: str, id_col: str) -> float:
    """Share of label 1 among all labelled rows outside fold 0."""
    rows = labels.where(F.col(label).isNotNull() & (common.fold(id_col) != 0))
    found = rows.agg(F.avg(F.col(label).cast("double")).alias("p")).first().p
    return float(np.clip(PRIOR if found is None else found, *PRIOR_RANGE))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most_features: int = FEATURES) -> Model:
    """Learns from confirmed documents (label 1) and unlabelled ones, both outside fold 0.

    Bounds: POSITIVE_ROWS confirmed documents and UNLABELLED_ROWS of all documents, lowest hash of the id first; and the
    size of the model, most_features buckets. Bags are made on executors; the driver gets counts by bucket, and of the
    bags the chosen buckets. Without confirmed or without unlabelled documents the score is the class prior.
    """
    confirmed = classify.labelled_ids(labels.where(F.col(label) == 1), label, id_col, POSITIVE_ROWS)
    pool = docs.where(F.col(id_col).isNotNull() & (common.fold(id_col) != 0)).select(id_col)
    drawn = pool.distinct().orderBy(F.xxhash64(id_col), id_col).limit(UNLABELLED_ROWS)
    ids = confirmed.select(id_col, F.lit(1).alias("label")).unionByName(drawn.select(id_col, F.lit(0).alias("label")))
    ids = ids.groupBy(id_col).agg(F.sum(F.when(F.col("label") == 1, 2).otherwise(1)).cast("int").alias("label"))
    # bit 0: drawn as unlabelled, bit 1: confirmed; a document may be both
    bags = common.written(classify.bagged(docs, ids, SPEC, id_col, text_col).select("id", "label", "size", "ids", "count"))
    bit = lambda k: F.sum(F.col("label").bitwiseAND(k) / k).alias(f"n{k}")
    u, m = (int(x or 0) for x in bags.agg(bit(1), bit(2)).first())
    prior = class_prior(labels, label, id_col)
    weights, start = np.zeros(1 << SPEC.bits, np.float32), float(np.log(prior / (1 - prior)))
    if not m or not u:
        return Model(weights, start)
    rates = bags.select("label", F.explode("ids").alias("bucket")).groupBy("bucket").agg(bit(2), bit(1)).toArrow()
    held = np.zeros((2, 1 << SPEC.bits))
    held[:, rates.column("bucket").to_numpy()] = [rates.column("n2").to_numpy() / m, rates.column("n1").to_numpy() / u]
    chosen = strongest(held[0], held[1], m, u, most_features)
    rows = classify.collected(classify.restricted(bags, chosen), "count")
    take = lambda k: [(x, c, n) for y, n, x, c in rows if y & k]
    weights[chosen], bias = train(take(2), take(1), chosen, prior)
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, score) for every row of docs: the model's probability that the text is toxic.

    A null text is empty; a text without words gets the score of the bias alone; a long text is scored whole. Null ids and
    repeated rows are kept, each with its score; equal texts have equal scores. An empty table gives no rows. Columns that
    are neither id, text nor kept are not read, and those kept may have any name.
    """
    return classify.scored(docs, model.weights, model.logit, SPEC, id_col, text_col, keep)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; held_out is the fold that training never sees."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", common.is_fold("doc_id", 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
