"""Inverted lists of vectors as a table: written once, searched by reading the lists that are asked.

``lists`` is partitioned by ``list_id``; a row is a vector, its residual against the list's centroid in one
byte a dimension, and the length of what the bytes leave out.  A search

1. picks each query's nearest ``nprobe`` lists; only their partitions are read, and of them the bytes alone;
2. bounds each inner product from both sides (the error is at most the query's length times what the bytes
   leave out) and keeps the rows whose upper bound reaches the k-th best lower bound, in each task and then
   over all tasks;
3. reads the vectors of those rows and scores them exactly.

So the result is exactly the top k of the probed lists, whatever the bytes lose.  A list is dealt to files of
about ``rows_a_file`` by hash of the id, so one that holds a third of all vectors is many tasks.  Ties go to
the smaller id.  Rows without a vector aren't indexed; queries without one find nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..store import new_folder, written
from . import dense
from .bm25 import top
from .sizes import small

_LITERALS = 2_000  # ids that are handed to the scan as a filter
_CANDIDATES = "query {q}, doc {d}, list_id int, low double, high double"


def _coded(m: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(list, bytes, step, error) of each vector."""
    own = dense.nearest(m, centroids)[:, 0]
    rest = m - centroids[own]
    step = np.maximum(np.abs(rest).max(1, initial=0.0) / 127, 1e-30)
    code = np.rint(rest / step[:, None]).astype(np.int8)
    # a little more than the error, for the rounding of the bounds themselves
    error = np.linalg.norm(rest - code * step[:, None], axis=1) * (1 + 1e-6) + 1e-9 * (1 + np.linalg.norm(m, axis=1))
    return own.astype(np.int32), code, step, error


@dataclass
class Lists:
    spark: SparkSession
    path: str
    centroids: np.ndarray
    nprobe: int = 10

    @classmethod
    def build(cls, vectors: DataFrame, path: str, nlist: int = 100, nprobe: int = 10, recall: float | None = None, rows_a_file: int = 500_000, k: int = 10) -> "Lists":
        """Writes ``vectors`` (``doc``, ``embedding``) as lists under ``path``.

        With ``recall``, ``nprobe`` grows to what a sample of the vectors needs to reach it.
        """
        spark = vectors.sparkSession
        given = vectors.select("doc", "embedding").where("embedding is not null")
        n = given.count()
        x = dense.sample(vectors)
        centroids = dense.train_lists(x, dense.list_count(n, nlist))
        if recall is not None:
            nprobe = max(nprobe, dense.probes_for(x, centroids, recall, k))
        shared = spark.sparkContext.broadcast(centroids)

        def code(batches):
            for batch in batches:
                for part in dense.parts(batch):
                    own, code, step, error = _coded(dense.matrix(part.column(1)), shared.value)
                    rows = pa.array([c.tobytes() for c in code], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own), rows, pa.array(step), pa.array(error), part.column(1)], names=["doc", "list_id", "code", "step", "error", "embedding"])

        kind = dict(vectors.dtypes)
        coded = given.mapInArrow(code, f"doc {kind['doc']}, list_id int, code binary, step double, error double, embedding {kind['embedding']}")
        # a file for each list, and more for each ``rows_a_file`` vectors beyond
        files = F.lit(1 + n // rows_a_file)
        dealt = coded.repartition(F.col("list_id"), F.pmod(F.xxhash64("doc"), files)).sortWithinPartitions("list_id", "doc")
        dealt.write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/lists")
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
        spark.createDataFrame(rows, "list_id int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        spark.createDataFrame([(nprobe,)], "nprobe int").coalesce(1).write.mode("overwrite").parquet(f"{path}/params")
        return cls(spark, path, centroids, nprobe)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Lists":
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()  # as many as there are lists
        return cls(spark, path, np.array([r.centroid for r in rows], np.float64).reshape(len(rows), -1), spark.read.parquet(f"{path}/params").first().nprobe)

    def copy(self, path: str) -> "Lists":
        """The same lists under another path."""
        self.table().repartition("list_id", F.spark_partition_id()).sortWithinPartitions("list_id", "doc").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/lists")
        for name in ("centroids", "params"):
            self.spark.read.parquet(f"{self.path}/{name}").write.mode("overwrite").parquet(f"{path}/{name}")
        return Lists(self.spark, path, self.centroids, self.nprobe)

    def table(self, asked: list[int] | None = None) -> DataFrame:
        """The lists, or those asked for: other partitions aren't read."""
        lists = self.spark.read.parquet(f"{self.path}/lists").withColumn("list_id", F.col("list_id").cast("int"))
        return lists if asked is None else lists.where(F.col("list_id").isin(asked))

    def search(self, queries: DataFrame, k: int = 10, nprobe: int | None = None, digits: int = 6) -> DataFrame:
        """(query, doc, score, rank) of ``queries`` (``query``, ``embedding``), searched in blocks of a bounded size."""
        kind, found = dict(queries.dtypes)["query"], None
        for ids, q in dense.query_blocks(queries):
            part = self._search(ids, q, kind, k, nprobe or self.nprobe, digits)
            found = part if found is None else found.unionByName(part)
        if found is None:
            doc = dict(self.table().dtypes)["doc"] if len(self.centroids) else "long"
            return self.spark.createDataFrame([], f"query {kind}, doc {doc}, score double, rank int")
        return top(found, k)

    def candidates(self, ids: list, q: np.ndarray, kind: str, k: int, nprobe: int) -> tuple[DataFrame, list[int]]:
        """Rows of the probed lists that may be among a query's k best, with bounds of their scores; and the lists read."""
        asked = np.zeros((len(ids), len(self.centroids)), bool)
        np.put_along_axis(asked, dense.nearest(q, self.centroids)[:, :nprobe], True, 1)
        lists = asked.any(0).nonzero()[0].tolist()
        shared = self.spark.sparkContext.broadcast((ids, q, asked, self.centroids))
        source = self.table(lists)

        def bound(batches):
            ids, q, asked, centroids = shared.value
            length = np.linalg.norm(q, axis=1)
            best = np.full((len(ids), k), -np.inf)  # the k best lower bounds of each query
            held: list[tuple[np.ndarray, ...]] = []  # query, doc, list, low, high
            names: list = []
            for batch in (part for whole in batches for part in dense.parts(whole)):
                own = batch.column("list_id").to_numpy()
                docs = batch.column("doc").to_pylist()
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(len(docs), -1).astype(np.float64)
                step, error = batch.column("step").to_numpy(), batch.column("error").to_numpy()
                for c in np.unique(own):
                    asking, rows = asked[:, c].nonzero()[0], (own == c).nonzero()[0]
                    about = (q[asking] @ centroids[c])[:, None] + (q[asking] @ codes[rows].T) * step[rows]
                    slack = length[asking, None] * error[rows]
                    low, high = about - slack, about + slack
                    first = np.partition(np.concatenate([best[asking], low], 1), -k, axis=1)[:, -k:]
                    best[asking] = first
                    i, j = (high >= first.min(1)[:, None]).nonzero()
                    held.append((asking[i], rows[j] + len(names), np.full(len(i), c), low[i, j], high[i, j]))
                names += docs
                if sum(len(h[0]) for h in held) > 4 * k * len(ids) + 100_000:
                    held, names = _still_in(held, names, best)
            held, names = _still_in(held, names, best)
            at, doc, lists, low, high = held[0]
            if len(at):
                yield pa.RecordBatch.from_pydict({"query": pa.array([ids[i] for i in at]), "doc": pa.array([names[i] for i in doc]), "list_id": pa.array(lists, pa.int32()), "low": pa.array(low), "high": pa.array(high)})

        light = source.select("doc", "list_id", "code", "step", "error")
        return light.mapInArrow(bound, _CANDIDATES.format(q=kind, d=dict(source.dtypes)["doc"])), lists

    def _search(self, ids: list, q: np.ndarray, kind: str, k: int, nprobe: int, digits: int) -> DataFrame:
        found, lists = self.candidates(ids, q, kind, k, nprobe)
        kth = F.row_number().over(W.partitionBy("query").orderBy(F.desc("low"), "doc"))
        # the rounding of scores may let a row up by half a unit of the last digit, and another down
        floor = F.max(F.when(F.col("turn") == k, F.col("low"))).over(W.partitionBy("query")) - 10.0**-digits
        kept = found.withColumn("turn", kth).withColumn("floor", floor).where(F.col("floor").isNull() | (F.col("high") >= F.col("floor")))
        kept = written(kept.select("query", "doc", "list_id"), new_folder(self.spark, "candidates"))
        asked = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, q)], f"query {kind}, q array<double>")
        exact = self.table(lists).select("doc", "list_id", "embedding")
        named = [r[0] for r in kept.select("doc").distinct().limit(_LITERALS + 1).collect()]
        if len(named) <= _LITERALS:  # rows are sorted by id, so the scan skips row groups
            exact = exact.where(F.col("doc").isin(named))
        dot = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
        rows = exact.join(small(kept), ["list_id", "doc"]).join(F.broadcast(asked), "query")
        return rows.select("query", "doc", F.round(dot, digits).alias("score"))


def _still_in(held: list, names: list, best: np.ndarray) -> tuple[list, list]:
    """What the k best lower bounds so far have not ruled out, as one part; names that nobody needs go."""
    at, doc, lists, low, high = (np.concatenate([h[i] for h in held]) if held else np.empty(0, np.int64 if i < 3 else np.float64) for i in range(5))
    kept = high >= best[at].min(1) if len(at) else np.zeros(0, bool)
    used, doc = np.unique(doc[kept], return_inverse=True)
    return [(at[kept], doc, lists[kept], low[kept], high[kept])], [names[i] for i in used]


def search_ivf(vectors: DataFrame, queries: DataFrame, k: int = 10, nlist: int = 100, nprobe: int = 10, digits: int = 6, recall: float | None = None) -> DataFrame:
    """Approximate top-k of vectors that have no lists yet: they are written to the shared folder, then searched."""
    return Lists.build(vectors, new_folder(vectors.sparkSession, "lists"), nlist, nprobe, recall, k=k).search(queries, k, digits=digits)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, index_type: str = "flat", **options) -> DataFrame:
    """flat and hnsw (searched exactly) or ivf."""
    return search_ivf(vectors, queries, k, **options) if index_type == "ivf" else dense.search_flat(vectors, queries, k)
