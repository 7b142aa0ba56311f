"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

Features are the hashed word unigrams and bigrams of the whole text, in two spellings: the words
(lower-cased, a word equal to the one before it becomes one marker) and their shapes (letters, digits
and other characters in runs).  Counts are damped by log1p and scaled to unit length.

Fitting is bounded: at most ``per_class`` labelled rows of each class, chosen by hash of the id; their
features go to the driver, which makes the sequential follow-the-regularised-leader updates.  Scoring
is a sparse dot product per document with the broadcast weights (4 MB, fixed).

Null and empty texts have no features: their score is that of the bias.  Rows with null ids and
repeated rows are scored row by row; without labelled rows of both classes every score is the share
of class 1 (0.5 without labels); an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labels import labelled_sample, rows_of
from .support import bounded_batches, held_out, table
from .textkit import ngram_hashes, text_bytes, word_hashes

_BITS = 20
_MASK = np.uint64((1 << _BITS) - 1)
_SAME = np.uint64(0x5BD1E995)
_SHAPE_SALT = np.uint64(0x27D4EB2F165667C5)
# letters (and all bytes of letters beyond ASCII) and digits, each as one sign
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = ord("a")
_SHAPE[48:58] = ord("0")
_RUNS = np.zeros(256, bool)
_RUNS[[ord("a"), ord("0")]] = True


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's sparse vector."""
    words = word_hashes(text)
    if not len(words):
        return np.empty(0, np.int32), np.empty(0, np.float32)
    words[1:][words[1:] == words[:-1]] = _SAME
    signs = _SHAPE[np.frombuffer(text, np.uint8)]
    kept = np.r_[True, (signs[1:] != signs[:-1]) | ~_RUNS[signs[1:]]]
    shapes = word_hashes(signs[kept].tobytes(), lower=False) ^ _SHAPE_SALT
    at = np.sort(np.concatenate([ngram_hashes(x, n) for x in (words, shapes) for n in (1, 2)]) & _MASK)
    first = np.r_[True, at[1:] != at[:-1]].nonzero()[0]
    values = np.log1p(np.diff(first, append=len(at)))
    return at[first].astype(np.int32), (values / math.sqrt(float(values @ values))).astype(np.float32)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0002, l2: float = 0.0) -> tuple[np.ndarray, float]:
    """Per-coordinate FTRL-proximal updates in the given order -> weights and bias."""
    z, n = np.zeros((1 << _BITS) + 1), np.zeros((1 << _BITS) + 1)
    bias = 1 << _BITS

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    positive = sum(y for *_, y in rows)
    weight = {1: len(rows) / (2 * positive), 0: len(rows) / (2 * (len(rows) - positive))}
    for _ in range(epochs):
        for at, x, y in rows:
            at, x = np.append(at, bias), np.append(x, 1.0)
            w = weights(at)
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, float(w @ x))))) - y) * weight[y] * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(len(z)))
    return w[:-1].astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 4000, id_col: str = "doc_id", text_col: str = "text"):
    """(weights, bias), or the constant score where there aren't two classes."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(labels, label, per_class, id_col)

    def run(batches):
        for batch in batches:
            made = [features(text) for text in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], names=["id", "y", "at", "x"])

    got = rows_of(docs, sample, id_col, text_col).mapInArrow(run, "id long, y int, at binary, x binary").collect() if sample else []
    # an order that depends on the rows alone
    got = sorted(got, key=lambda r: (xxhash.xxh64_intdigest(str(r.id)), bytes(r.at)))
    if len({r.y for r in got}) < 2:
        return sum(r.y for r in got) / len(got) if got else 0.5
    return train_ftrl([(np.frombuffer(r.at, np.int32), np.frombuffer(r.x, np.float32), r.y) for r in got])


def quality_scores(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``score`` for each row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            scores = []
            for text in text_bytes(batch.column(1)):
                if isinstance(model, float):
                    scores.append(model)
                    continue
                at, x = features(text)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(model[0][at] @ x) + model[1])))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = quality_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scores.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
