"""Operator 4, quality classifier: supervised subword embeddings.

Every hashed word, pair of neighbouring words and character n-gram has a learned vector. A document's vector is the sum
of the averages of its words', its pairs' and its n-grams' vectors; a softmax over two outputs follows. Vectors and
output are trained by stochastic gradient descent in numpy, one document a step, at a rate that falls to zero.

For scoring the model is folded: the difference of the two outputs is linear in the averages, so one weight a bucket is
enough, and every document is scored whole whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import classify, common, features

SPEC = features.Spec(orders=(3, 4, 5), bits=18, pairs=True)
#: Bounds of the training sample: so many labelled documents and bytes of their texts at most, lowest hash of the id first.
TRAIN_ROWS, TRAIN_BYTES = 2048, 16 << 20
DIMENSIONS, EPOCHS, RATE, SEED = 8, 6, 2.0, 1
#: A document is kept from this score on.
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def logit(self, total: np.ndarray, count: np.ndarray, _size: np.ndarray) -> np.ndarray:
        return (total / np.maximum(count, 1)).sum(axis=1) + self.bias


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], spec: features.Spec = SPEC, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """bags: (distinct buckets, share) of each document. With one class only, or none, the model is a constant."""
    vectors = np.zeros((1 << spec.bits, dimensions), np.float32)
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return Model(np.zeros(1 << spec.bits, np.float32), {(): 0.0, (0,): -20.0, (1,): 20.0}[tuple(set(labels))])
    random = np.random.default_rng(seed)
    first = random.normal(1, 0.3, dimensions).astype(np.float32)
    output, bias = np.stack([-first, first]), np.zeros(2, np.float32)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in random.permutation(len(bags)):
            step = np.float32(rate * (1 - done / steps))
            done += 1
            ids, share = bags[i]
            hidden = share @ vectors[ids]
            z = output @ hidden + bias
            error = np.exp(z - z.max())
            error /= error.sum()
            error[y[i]] -= 1
            back = output.T @ error
            output -= np.float32(0.1) * step * np.outer(error, hidden)
            bias -= np.float32(0.1) * step * error
            vectors[ids] -= step * share[:, None] * back
    return Model(vectors @ (output[1] - output[0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES, spec: features.Spec = SPEC) -> Model:
    """Learns from labelled documents outside fold 0, `most` rows and most_bytes of whole texts at most; their texts are the only input.

    Documents are taken by rising hash of the id while their texts fit the bound of bytes; one that does not fit is passed
    over. One task trains; the driver gets the weights alone.
    """
    texts = classify.chosen_texts(docs, classify.labelled_ids(labels, label, id_col, most), id_col, text_col)
    one = texts.withColumn("h", F.xxhash64("id")).repartition(1).sortWithinPartitions("h", "id").select("label", "data")

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, marks, left = [], [], most_bytes
        for batch in batches:
            for lo, hi in common.blocks(batch.column(1)):
                held = []
                for mark, text in zip(batch.column(0)[lo:hi].to_pylist(), batch.column(1)[lo:hi].to_pylist(), strict=True):
                    if len(text) <= left:
                        left -= len(text)
                        held.append(text)
                        marks.append(mark)
                bags += [(ids, share) for ids, share, _ in features.bags(held, spec)]
        model = train(bags, marks, spec)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype(np.float32).tobytes()], pa.binary()), pa.array([model.bias])], ["weights", "bias"])

    found = one.mapInArrow(trained, "weights binary, bias double").first()
    if found is None:
        return train([], [], spec)
    return Model(np.frombuffer(bytes(found.weights), np.float32), found.bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), spec: features.Spec = SPEC) -> DataFrame:
    """(id, *keep, score) for every row of docs: the model's probability of label 1.

    A null text is empty; a text without words gets the score of the bias alone; a long text is scored whole. Null ids and
    repeated rows are kept, each with its score; equal texts have equal scores. An empty table gives no rows. Columns that
    are neither id, text nor kept are not read, and those kept may have any name.
    """
    return classify.scored(docs, model.weights, model.logit, spec, id_col, text_col, keep)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; held_out is the fold that training never sees."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", common.is_fold("doc_id", 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
