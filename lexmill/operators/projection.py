"""A linear projection of vectors, trained so that a question lies near its own passage and far from those of its batch.

The loss of a batch is the mean over its rows of the softmax cross-entropy of the row's own passage among all passages
of the batch, by ``SCALE`` times the cosine of the projected vectors.  Batches are written once, a row each, dealt to
``updates`` parts of an epoch; an update reads its part, sums gradients in each task and then over tasks by entry of the
matrix, so the driver gets one matrix whatever the data's size.  Sums are rounded before they are used: a rerun
gives the same matrix.  Rows without a vector, or with one of zeros, are left out; a batch of one row teaches nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import new_folder, written
from . import dense

SCALE = 20.0
_DIGITS = 9


def batches(pairs: DataFrame, batch_size: int = 16) -> DataFrame:
    """(batch, rows): pairs (``ordinal``, ``anchor``, ``positive``) whose ordinals share a batch.  Ordinals are unique."""
    usable = lambda c: F.coalesce(F.exists(c, lambda x: x != 0), F.lit(False))
    kept = pairs.where(usable("anchor") & usable("positive"))
    return kept.groupBy(F.floor(F.col("ordinal") / batch_size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "anchor", "positive"))).alias("rows"))


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x / length, length


def loss_and_gradient(anchors: np.ndarray, positives: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed over the rows of one batch."""
    (u, lu), (v, lv) = _unit(anchors @ w), _unit(positives @ w)
    s = SCALE * (u @ v.T)
    s -= s.max(1, keepdims=True)
    share = np.exp(s)
    total = share.sum(1, keepdims=True)
    loss = float((np.log(total[:, 0]) - np.diag(s)).sum())
    pull = SCALE * (share / total - np.eye(len(s)))
    du, dv = pull @ v, pull.T @ u
    # the gradient of a unit vector has no part along it
    du, dv = (du - (du * u).sum(1, keepdims=True) * u) / lu, (dv - (dv * v).sum(1, keepdims=True) * v) / lv
    return loss, anchors.T @ du + positives.T @ dv


def _arrays(made: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch, rows in zip(made.column("batch").to_pylist(), made.column("rows")):
        rows = rows.as_py()
        yield batch, np.array([r["anchor"] for r in rows], np.float64), np.array([r["positive"] for r in rows], np.float64)


def losses(made: DataFrame, w: np.ndarray | None = None) -> DataFrame:
    """(batch, rows, loss): the mean loss of each of ``batches``; without a matrix, of the vectors as they are."""

    def run(parts):
        for part in parts:
            out = [(b, len(a), loss_and_gradient(a, p, np.eye(a.shape[1]) if w is None else w)[0] / len(a)) for b, a, p in _arrays(part)]
            yield pa.RecordBatch.from_pydict({"batch": pa.array([o[0] for o in out], pa.int64()), "rows": pa.array([o[1] for o in out], pa.int64()), "loss": pa.array([o[2] for o in out], pa.float64())})

    return made.select("batch", "rows").mapInArrow(run, "batch long, rows long, loss double")


def _step(made: DataFrame, w: np.ndarray) -> tuple[float, int, np.ndarray]:
    """(loss, rows, gradient), summed over ``made``; entry -1 carries the loss, -2 the rows."""
    shared = made.sparkSession.sparkContext.broadcast(w)

    def run(parts):
        w = shared.value
        loss, n, g = 0.0, 0, np.zeros(w.shape)
        for part in parts:
            for _, a, p in _arrays(part):
                if len(a) > 1:
                    own, by = loss_and_gradient(a, p, w)
                    loss, n, g = loss + own, n + len(a), g + by
        if n:
            yield pa.RecordBatch.from_pydict({"entry": pa.array(np.arange(-2, g.size), pa.int32()), "value": pa.array(np.concatenate([[n, loss], g.ravel()]))})

    summed = made.select("batch", "rows").mapInArrow(run, "entry int, value double").groupBy("entry").agg(F.round(F.sum("value"), _DIGITS).alias("value"))
    got = {r["entry"]: r["value"] for r in summed.collect()}  # as many as the matrix has entries
    if not got:
        return 0.0, 0, np.zeros(w.shape)
    return got[-1], int(got[-2]), np.array([got[i] for i in range(w.size)]).reshape(w.shape)


@dataclass
class Projection:
    w: np.ndarray
    epoch_losses: list[float] = field(default_factory=list)

    @classmethod
    def train(cls, pairs: DataFrame, dimensions: int = 64, batch_size: int = 16, epochs: int = 5, learning_rate: float = 0.01, warmup_ratio: float = 0.1, updates: int = 4, seed: int = 42) -> "Projection":
        """pairs: ``ordinal``, ``anchor``, ``positive`` (vectors).  Adam, with a linear rise and fall of the rate."""
        spark = pairs.sparkSession
        folder = new_folder(spark, "batches")
        dealt = batches(pairs, batch_size).withColumn("part", F.pmod("batch", F.lit(updates)).cast("int"))
        dealt.write.partitionBy("part").parquet(folder)
        made = spark.read.schema(dealt.schema).parquet(folder)
        first = made.select(F.size(F.col("rows")[0]["anchor"]).alias("d")).first()
        if first is None:
            raise ValueError("no pair has two vectors")
        d = first["d"]
        w = np.random.default_rng(seed).normal(size=(d, dimensions)) / np.sqrt(dimensions)
        m, v, steps = np.zeros_like(w), np.zeros_like(w), epochs * updates
        rise, told = max(1, int(steps * warmup_ratio)), []
        for epoch in range(epochs):
            loss = rows = 0
            for part in range(updates):
                own, n, g = _step(made.where(F.col("part") == part), w)
                loss, rows = loss + own, rows + n
                if not n:
                    continue
                t = epoch * updates + part + 1
                g = g / n
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                rate = learning_rate * min(t / rise, (steps - t + 1) / max(1, steps - rise + 1))
                w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            told.append(loss / max(rows, 1))
        return cls(w, told)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, [float(x) for x in row]) for i, row in enumerate(self.w)]
        spark.createDataFrame(rows, "i int, weights array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Projection":
        rows = spark.read.parquet(path).orderBy("i").collect()  # as many as the encoder has dimensions
        return cls(np.array([r["weights"] for r in rows]))

    def encoder(self, base: dense.Encoder) -> dense.Encoder:
        """``base``, projected."""
        return _projected(base, self.w)


def _projected(base: dense.Encoder, w: np.ndarray) -> Callable[[list[str]], np.ndarray]:
    return lambda texts: (np.asarray(base(texts), np.float64) @ w).astype(np.float32)


def own_rank(pairs: DataFrame, k: int = 10) -> DataFrame:
    """(mrr, queries): mean reciprocal rank of each anchor's own passage among all distinct ones, 0 beyond ``k``.

    Passages are ranked by inner product: vectors of unit length are ranked as they were trained.
    """
    named = pairs.select("ordinal", "anchor", "positive", F.xxhash64("positive").alias("doc"))
    named = written(named, new_folder(pairs.sparkSession, "ranked"))
    passages = named.select("doc", F.col("positive").alias("embedding")).dropDuplicates(["doc"])
    hits = dense.search_flat(passages, named.select(F.col("ordinal").alias("query"), F.col("anchor").alias("embedding")), k)
    gold = named.select(F.col("ordinal").alias("query"), "doc")
    ranks = gold.join(hits.select("query", "doc", "rank"), ["query", "doc"], "left")
    return ranks.agg(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.count("*").alias("queries"))
