"""Dense vectors: encoding, exact inner-product search and what inverted lists are trained on."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bm25 import top

Encoder = Callable[[list[str]], np.ndarray]
_QUERY_BLOCK = 2048


def sentence_encoder(model: str, device: str | None = None, batch_size: int = 32) -> Encoder:
    """A sentence-transformers model, loaded once in each Python worker; fails at once where the library is missing."""
    from importlib.util import find_spec

    if find_spec("sentence_transformers") is None:
        raise ImportError("sentence_encoder needs sentence-transformers")

    def run(texts: list[str]) -> np.ndarray:
        return np.asarray(_loaded(model, device).encode(texts, batch_size=batch_size, show_progress_bar=False), np.float32)

    return run


@functools.lru_cache(1)
def _loaded(model: str, device: str | None):
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(model, device=device)


def hashed_encoder(texts: list[str], dimensions: int = 256) -> np.ndarray:
    """The offline default: hashed character trigram counts."""
    import zlib

    out = np.zeros((len(texts), dimensions), np.float32)
    for i, text in enumerate(texts):
        padded = f"^{text}$"
        for j in range(len(padded) - 2):
            out[i, zlib.crc32(padded[j : j + 3].encode()) % dimensions] += 1
    return out


def encode(frame: DataFrame, encoder: Encoder = hashed_encoder, normalize: bool = True, text: str = "text") -> DataFrame:
    """Adds ``embedding``; the encoder is injected and runs on Arrow batches."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema) + ", embedding array<float>"

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            vectors = np.asarray(encoder([t or "" for t in pdf[text]]), np.float32)
            if normalize:
                vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            yield pdf.assign(embedding=list(vectors))

    return frame.mapInPandas(run, schema)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def query_blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    ids, vectors = [], []
    for row in queries.select("query", "embedding").where("embedding is not null").toLocalIterator():
        ids.append(row.query)
        vectors.append(row.embedding)
        if len(ids) == _QUERY_BLOCK:
            yield ids, np.array(vectors, np.float64)
            ids, vectors = [], []
    if ids:
        yield ids, np.array(vectors, np.float64)


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices that bound the scores held at once."""
    for at in range(0, batch.num_rows, _QUERY_BLOCK):
        yield batch.slice(at, _QUERY_BLOCK)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The lists of each vector, nearest first."""
    return np.argsort(-(vectors @ centroids.T - 0.5 * (centroids**2).sum(1)), 1, kind="stable")


def search_flat(vectors: DataFrame, queries: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """Exact inner-product top-k.

    vectors: ``doc``, ``embedding``; queries: ``query``, ``embedding``, searched in blocks of a bounded size.
    Rows without an embedding find nothing and aren't found.
    A task multiplies its batches and keeps k rows a query, so what is shuffled doesn't grow with the
    vectors it has read.
    """
    spark = vectors.sparkSession
    kinds = dict(vectors.dtypes)["doc"], dict(queries.dtypes)["query"]
    found = None
    for ids, q in query_blocks(queries):
        shared = spark.sparkContext.broadcast((ids, q))

        def best(batches, shared=shared):
            ids, q = shared.value
            docs = scores = None
            for batch in (part for whole in batches for part in parts(whole)):
                own, s = np.array(batch.column(0).to_pylist()), np.round(q @ matrix(batch.column(1)).T, digits)
                if s.shape[1] > 4 * k:  # what the k-th best score leaves, ties too; only that is sorted
                    hopeful = (s >= np.partition(s, -k, axis=1)[:, -k, None]).any(0)
                    own, s = own[hopeful], s[:, hopeful]
                d = np.broadcast_to(own, s.shape)
                if docs is not None:
                    s, d = np.concatenate([scores, s], 1), np.concatenate([docs, d], 1)
                order = np.stack([np.lexsort((d[i], -s[i]))[:k] for i in range(len(ids))])
                scores, docs = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)
            if docs is not None and docs.shape[1]:
                yield pa.RecordBatch.from_pydict({"query": pa.array(np.repeat(np.array(ids, object), docs.shape[1]).tolist()), "doc": pa.array(docs.ravel().tolist()), "score": pa.array(scores.ravel())})

        part = vectors.select("doc", "embedding").where("embedding is not null").mapInArrow(best, f"query {kinds[1]}, doc {kinds[0]}, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"query {kinds[1]}, doc {kinds[0]}, score double, rank int")
    return top(found, k)


def sample(vectors: DataFrame, most: int = 20_000) -> np.ndarray:
    """At most ``most`` vectors, those with the lowest hash of the id."""
    rows = vectors.where("embedding is not null").orderBy(F.xxhash64("doc"), "doc").limit(most).select("embedding").collect()
    return np.array([r.embedding for r in rows], np.float64)


def train_lists(x: np.ndarray, nlist: int, rounds: int = 10) -> np.ndarray:
    """Centroids of ``nlist`` lists by k-means on a sample."""
    centroids = x[:nlist].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centroids.T - 0.5 * (centroids**2).sum(1), 1)
        for c in range(len(centroids)):
            if (near == c).any():
                centroids[c] = x[near == c].mean(0)
    return centroids


def probes_for(x: np.ndarray, centroids: np.ndarray, recall: float, k: int = 10, queries: int = 200) -> int:
    """The fewest lists to probe so that the first ``queries`` rows of a sample find ``recall`` of their k nearest others.

    Measured exactly within the sample; in the whole table neighbours are nearer, so they share lists more.
    """
    if len(x) < 2:
        return len(centroids)
    near = x @ centroids.T - 0.5 * (centroids**2).sum(1)
    own, asked = np.argmax(near, 1), near[:queries]
    turn = np.argsort(np.argsort(-asked, 1, kind="stable"), 1)
    scores = x[:queries] @ x.T
    np.fill_diagonal(scores, -np.inf)
    found = np.argsort(-scores, 1, kind="stable")[:, : min(k, len(x) - 1)]
    needed = np.sort(np.take_along_axis(turn, own[found], 1).ravel())
    return int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1


def list_count(n: int, most: int = 100) -> int:
    return min(most, n // 10 + 1)
