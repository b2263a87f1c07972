"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text is the set of its words and word pairs, hashed into ``2 ** BITS`` coordinates; runs of letters and digits and
runs of other characters are words of their own. Labelled rows that are not held out train it, at most ``train_rows``
of them, those with the smallest hash of their id. Their features are made where the texts are; one task then passes
over these few rows. Scores are sparse dot products with the weights, 2 MB that travel with the function.

Defined results: a NULL or empty text has only the coordinate of its length and gets a score like any other. Repeated
rows are scored each by itself; of repeated labels of a document the lowest counts; NULL labels and ids train nothing.
Extra columns are ignored. Without labelled rows every score is 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mrkit.llm.common import texts

BITS = 18
TRAIN_ROWS = 16_384
EPOCHS = 4
THRESHOLD = 0.3

# Step size, its offset and the two penalties of the learner.
ALPHA, BETA, L1, L2 = 3.0, 1.0, 0.001, 0.0

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x00-\x20]+")


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of a text and their values: words, pairs of neighbours and the order of magnitude of the length.

    A value is the root of the coordinate's share, so that the values are a vector of unit length.
    """
    words = WORDS.findall(text.lower())
    hashed = np.array([*map(xxhash.xxh3_64_intdigest, words)], dtype=np.uint64)
    pairs = (hashed[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ hashed[1:]
    length = np.array([xxhash.xxh3_64_intdigest(b" length %d" % len(words).bit_length())], dtype=np.uint64)
    every = np.concatenate([hashed, pairs * np.uint64(0xC2B2AE3D27D4EB4F), length]) >> np.uint64(64 - BITS)
    at, n = np.unique(every, return_counts=True)
    return at.astype(np.int32), np.sqrt(n / len(every)).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after so many passes over ``(coordinates, values, label)``; the last weight is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for coordinates, values, label in rows:
            at, x = np.append(coordinates, 1 << BITS), np.append(values, 1.0)
            w = weights(at)
            gradient = (_sigmoid(w @ x) - label) * x
            grown = np.sqrt(n[at] + gradient * gradient)
            z[at] += gradient - (grown - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown * grown
    return weights(slice(None))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _features(text: str) -> Column:
    @F.arrow_udf("struct<at: binary, values: binary>")
    def made(text: pa.Array) -> pa.Array:
        rows = [(at.tobytes(), values.tobytes()) for at, values in map(features, texts(text))]
        columns = zip(*rows) if rows else [(), ()]
        return pa.StructArray.from_arrays([pa.array(c, pa.binary()) for c in columns], ["at", "values"])

    return made(text)


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights learnt from ``documents(doc_id, text)`` with ``labels(doc_id, label)``, at most ``train_rows`` of them."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    # At most train_rows small rows, which bounds what is broadcast.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = documents.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", _features("text").alias("f"))
    rows = rows.select("doc_id", "label", "f.at", "f.values")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = []
        for batch in batches:
            given += zip(*(batch.column(name).to_pylist() for name in ("doc_id", "label", "at", "values")))
        given.sort(key=lambda row: (xxhash.xxh3_64_intdigest(str(row[0])), *row))
        rows = [(np.frombuffer(at, np.int32), np.frombuffer(x, np.float32), label) for _, label, at, x in given]
        weights = train(rows, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()])], ["weights"])

    learnt = rows.repartition(1).mapInArrow(learn, "weights binary").first()
    # An empty relation has no task.
    return np.frombuffer(learnt.weights) if learnt else train([])


def score(text: str | Column, weights: np.ndarray) -> Column:
    """Probability of label 1."""

    @F.arrow_udf("double")
    def dot(text: pa.Array) -> pa.Array:
        sums = [weights[at] @ values + weights[-1] for at, values in map(features, texts(text))]
        return pa.array(_sigmoid(np.array(sums, dtype=np.float64)), pa.float64())

    return dot.asNondeterministic()(text)


def held_out(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def quality_classifier(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document; ``labels`` is ``(doc_id, quality)``."""
    documents = documents.select("doc_id", "text")
    usable = labels.where(~held_out("doc_id")).select("doc_id", F.col("quality").alias("label"))
    scored = documents.select("doc_id", held_out("doc_id").alias("held_out"), score("text", fit(documents, usable, train_rows)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
