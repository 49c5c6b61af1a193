"""What the two text classifiers share: a bounded labelled sample, training on it, scoring in batches.

A model is learnt from at most `max_rows` labelled rows (a documented bound: those with the smallest
hash of their doc_id). One task trains on them in an order that the rows alone decide, as models
trained apart on parts of a small sample and averaged are under-fit; its memory is bounded by
max_rows texts and their features. The model's size is fixed by the number of hash buckets. Scoring
is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialize, text_of

MAX_ROWS, SHARDS = 16_000, 4

#: text and weights -> distinct bucket numbers, those without weight left out or not, and their values
Features = Callable[[bytes, np.ndarray], tuple[np.ndarray, np.ndarray | float]]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, max_rows: int = MAX_ROWS) -> DataFrame:
    """label (0 or 1), text and shard (for counts) of at most max_rows rows whose label is known and for whose doc_id `learn` holds."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
    order = F.xxhash64(id_text("_id"))
    some = materialize(known.orderBy(order, "_id", "label").limit(max_rows), "labels")
    rows = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("_id"))  # max_rows short rows
    return materialize(rows.select("label", "text", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(SHARDS)).cast("int").alias("shard")), "sample")


def sample_batches(frames: Iterator, features: Callable) -> tuple[list, np.ndarray]:
    """The features and labels of a sample's rows, in an order that the rows alone decide."""
    rows = []
    for batch in frames:
        rows += zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())
    rows.sort(key=lambda r: (hash_of(r[1]), r[0]))
    return [features(t) for _, t in rows], np.array([y for y, _ in rows], float)


def hash_of(text: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text)


def class_weights(labels: np.ndarray) -> tuple[float, float]:
    """The weights of rows labelled 0 and 1: the rarer label's rows count as much, taken together, as the other's."""
    ones = float(labels.sum())
    zeros = len(labels) - ones
    return max(1.0, ones / zeros if zeros else 1.0), max(1.0, zeros / ones if ones else 1.0)


def vectors(sample: DataFrame, of: Callable[[Iterator], list[np.ndarray]], sizes: tuple[int, ...], shards: int = SHARDS) -> list[np.ndarray]:
    """of(rows of a shard) for each shard, added up element by element; vectors of these sizes, zeros for an empty sample."""

    def run(batches):
        out = of(batches)
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float64).tobytes() for x in out], pa.binary()), pa.array(range(len(out)), pa.int32())], names=["v", "i"])

    dealt = (sample.repartition(shards, "shard") if shards > 1 else sample.coalesce(1)).select("label", "text")
    sums = [np.zeros(n) for n in sizes]
    for row in dealt.mapInArrow(run, "v binary, i int").toLocalIterator():  # shards x vectors rows of fixed length
        sums[row["i"]] += np.frombuffer(row["v"], np.float64)
    return sums


def score(docs: DataFrame, features: Features, weights: np.ndarray, bias: float) -> DataFrame:
    """Per row of docs doc_id and score: the logistic function of the sum of its features' weights."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # a fixed number of buckets

    def run(batches):
        w = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [features(t, w) for t in part.column(1).cast(pa.binary()).to_pylist()]
                z = np.array([bias + float((w[at] * values).sum(dtype=np.float64)) for at, values in found])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(z, -35, 35))), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(run, "doc_id long, score double")

