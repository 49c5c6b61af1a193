"""Toxicity: a character n-gram linear classifier with features scaled by naive Bayes log-count ratios.

Features are the hashed 3- to 5-character runs of a text, each with the value log(1 + its count). The
labelled sample gives each bucket's log-count ratio r = log((p / |p|) / (q / |q|)) of its counts in
toxic and in other texts (add one). Buckets count that MIN_TEXTS texts have and whose r is at least
MIN_RATIO: what speaks against toxicity is left to the bias, as the many buckets that a handful of
toxic texts happen not to have would swamp a long text. A logistic regression on the values times r
is trained by AdaGrad.

Rows: a null or empty text has no features and gets the base rate; doc_id may be null or repeat
(each row is scored by its text alone); labels that are null or have no document are ignored; with
no usable labels every score is 0.5; a score of exactly 0.7 is predicted toxic; a very long text is
one row whose runs are counted whole; empty tables give an empty result. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, read_table
from .linear import MAX_ROWS, labelled_sample, sample_batches, score, vectors

BITS, SIZES = 20, (3, 4, 5)
MIN_TEXTS, MIN_RATIO = 5, 1.5
EPOCHS, RATE = 6, 0.1
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def features(text: bytes, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the text's character runs and how often they occur, those without weight left out; letters in
    lower case, white space as one blank."""
    line = f" {' '.join(text.decode(errors='replace').lower().split())} "
    if len(line) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    rolled, found = code * _A, []
    for n in range(2, SIZES[-1] + 1):
        if n > len(code):
            break
        rolled = (rolled[: len(code) - n + 1] ^ (rolled[: len(code) - n + 1] >> np.uint64(29))) * _B + code[n - 1 :] * _A
        if n in SIZES:
            mixed = (rolled ^ (rolled >> np.uint64(31))) * _A
            found.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
    buckets = np.concatenate(found)
    return np.unique(buckets if weights is None else buckets[weights[buckets] != 0], return_counts=True)


def valued(text: bytes, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, counts = features(text, weights)
    return at, np.log1p(counts)


def log_count_ratios(toxic: np.ndarray, other: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The ratios of the buckets that count, from their counts in toxic and other texts and the number of texts; 0 for the rest."""
    p, q = toxic + 1.0, other + 1.0
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    return np.where((texts >= MIN_TEXTS) & (r >= MIN_RATIO), r, 0.0)


def _count(batches):
    counts = np.zeros((3, 1 << BITS))
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at, times = features(text.encode())
            counts[0 if label else 1][at] += times
            counts[2][at] += 1
    return list(counts)


def _train(ratios: np.ndarray):
    def scaled(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        at, values = valued(text, ratios)
        return at.astype(np.int32), (values * ratios[at]).astype(np.float32)

    def train(batches):
        texts, labels = sample_batches(batches, scaled)
        w, g, b, gb = np.zeros(1 << BITS), np.full(1 << BITS, 1.0), 0.0, 1.0
        for epoch in range(EPOCHS):
            for i in np.random.default_rng(epoch).permutation(len(texts)):
                at, x = texts[i]
                error = 1 / (1 + np.exp(-np.clip(b + w[at] @ x, -35, 35))) - labels[i]
                step = error * x
                g[at] += step * step
                w[at] -= RATE * step / np.sqrt(g[at])
                gb += error * error
                b -= RATE * error / np.sqrt(gb)
        return [w, np.array([b])]

    return train


def classify(docs: DataFrame, labels: DataFrame, learn, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of every row of docs; learn: which rows of labels may be learnt from."""
    sample = labelled_sample(docs, labels, "toxic", learn, max_rows)
    ratios = log_count_ratios(*vectors(sample, _count, (1 << BITS,) * 3))
    weights, (bias,) = vectors(sample, _train(ratios), (1 << BITS, 1), shards=1)
    return score(docs, valued, weights * ratios, bias)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = classify(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), fold("doc_id", FOLDS) != HELD_OUT)
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
