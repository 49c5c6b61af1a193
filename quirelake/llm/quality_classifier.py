"""Quality: hashed word n-gram logistic regression trained by follow-the-regularised-leader.

Tokens are runs of letters and digits and runs of other signs; features are the hashed tokens and
pairs of neighbours that a text has, a pair of equal tokens being one feature whatever the token.
FTRL-proximal (L1 and L2) runs over the texts of the labelled sample, the rarer label's rows weighing
as much in all as the other's, and a text's score is the logistic function of a sparse dot product.

Rows: a null or empty text has no features and gets the base rate; doc_id may be null or repeat
(each row is scored by its text alone); labels that are null or have no document are ignored; with
no usable labels every score is 0.5; a score of exactly 0.3 is predicted good; a very long text is
one row with its tokens whole; empty tables give an empty result. Further columns are not read.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, read_table
from .linear import MAX_ROWS, class_weights, labelled_sample, sample_batches, score, vectors

BITS = 20
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 1.0, 1.0, 4
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0D]+")
_A, _B, _SAME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(1)


def features(text: bytes) -> np.ndarray:
    """Distinct buckets of the text's tokens and pairs of tokens."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return np.empty(0, np.int64)
    one = np.fromiter(map(crc32, tokens), np.uint64, len(tokens))
    two = np.where(one[1:] == one[:-1], _SAME, (one[:-1] * _B) ^ one[1:])
    mixed = np.concatenate([one, two + _A]) * _A
    return np.unique(((mixed ^ (mixed >> np.uint64(32))) * _B >> np.uint64(64 - BITS)).astype(np.int64))


class Ftrl:
    """FTRL-proximal with adaptive rates; the last weight is the bias's, which isn't regularised by L1."""

    def __init__(self, size: int):
        self.z, self.n, self.size = np.zeros(size + 1), np.zeros(size + 1), size

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == self.size, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: float, weight: float = 1.0) -> None:
        at = np.append(at, self.size)
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _train(batches):
    texts, labels = sample_batches(batches, lambda t: features(t).astype(np.int32))
    model, weight = Ftrl(1 << BITS), class_weights(labels)
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(texts)):
            model.learn(texts[i], labels[i], weight[int(labels[i])])
    return [model.weights(np.arange(model.size + 1))]


def classify(docs: DataFrame, labels: DataFrame, learn, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier good) of every row of docs; learn: which rows of labels may be learnt from."""
    (weights,) = vectors(labelled_sample(docs, labels, "quality", learn, max_rows), _train, ((1 << BITS) + 1,), shards=1)
    return score(docs, lambda t, _: (features(t), 1.0), weights[:-1], float(weights[-1]))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = classify(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), fold("doc_id", FOLDS) != HELD_OUT)
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
