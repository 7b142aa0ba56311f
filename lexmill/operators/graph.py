"""A neighbour graph of vectors as a table: made by repeated joins, searched from node to node for all queries at once.

``nodes`` holds a row for each vector: its id, the vector and the ids of about ``degree`` near vectors (by Euclidean
distance, and as many that name it as theirs).  It is made by

1. sorting all vectors along a few random directions and comparing those that stand in one block of the order;
2. descent: neighbours of one vector are likely neighbours of each other, so each vector's list is compared
   with itself, and every member keeps its best.  A list has at most ``2 * degree`` members, however many
   vectors name it, so no group is large.  Rounds end when less than ``settled`` of the links change.

A search holds ``beam`` rows a query.  It begins at a fixed number of entries, and looks at the neighbours of all rows
it has not yet looked at, until there are none; each step is a join, for all queries together.  Results are approximate:
recall is measured in the tests and grows with ``beam``.  Inner products are ranked, so vectors should have about
one length.  Ties go to the smaller id.  Rows without a vector aren't indexed; queries without one find nothing.
Ids are unique.  An empty table finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..store import new_folder, written
from .bm25 import top
from .dense import matrix
from .sizes import small

_BLOCK = 128  # rows of an order that are compared
_ENTRIES = 256


def _best_of(ids: list, x: np.ndarray, degree: int) -> tuple[list, list, np.ndarray]:
    """(doc, neighbour, closeness) of rows that are all compared, ``degree`` a row."""
    half = (x**2).sum(1) / 2
    close = x @ x.T - half - half[:, None]
    np.fill_diagonal(close, -np.inf)
    near = np.argsort(-close, 1, kind="stable")[:, : min(degree, len(ids) - 1)]
    at = np.repeat(np.arange(len(ids)), near.shape[1])
    return [ids[i] for i in at], [ids[i] for i in near.ravel()], close[at, near.ravel()]


def _links(found: Iterator[tuple[list, list, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    docs, others, close = [], [], []
    for d, o, c in found:
        docs, others = docs + d, others + o
        close.append(c)
    if docs:
        yield pa.RecordBatch.from_pydict({"doc": pa.array(docs), "other": pa.array(others), "close": pa.array(np.concatenate(close))})


def _closest(links: DataFrame, degree: int) -> DataFrame:
    """``degree`` links of each doc; a pair that was found again counts once."""
    order = W.partitionBy("doc").orderBy(F.desc("close"), "other")
    once = links.groupBy("doc", "other").agg(F.max("close").alias("close"))
    return once.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= degree).drop("turn")


def _both_ways(links: DataFrame, degree: int) -> DataFrame:
    """Adds up to ``degree`` links of those that name a doc."""
    back = links.select(F.col("other").alias("doc"), F.col("doc").alias("other"), "close")
    return links.unionByName(_closest(back, degree)).groupBy("doc", "other").agg(F.max("close").alias("close"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


@dataclass
class Graph:
    spark: SparkSession
    path: str

    @classmethod
    def build(cls, vectors: DataFrame, path: str, degree: int = 16, orders: int = 4, rounds: int = 8, settled: float = 0.02, seed: int = 42) -> "Graph":
        """Writes the graph of ``vectors`` (``doc``, ``embedding``) under ``path``."""
        spark, work = vectors.sparkSession, new_folder(vectors.sparkSession, "graph")
        given = written(vectors.select("doc", "embedding").where("embedding is not null"), f"{work}/vectors")
        kind = dict(given.dtypes)["doc"]
        schema = f"doc {kind}, other {kind}, close double"
        first = given.first()
        size = len(first["embedding"]) if first else 1

        def along_order(batches):
            def found():
                for batch in batches:
                    for at in range(0, batch.num_rows, _BLOCK):
                        part = batch.slice(at, _BLOCK)
                        if part.num_rows > 1:
                            yield _best_of(part.column(0).to_pylist(), matrix(part.column(1)), degree)

            yield from _links(found())

        links = None
        for direction in np.random.default_rng(seed).normal(size=(orders, size)):
            along = _dot(F.col("embedding"), F.array(*map(F.lit, direction.tolist())))
            ordered = given.withColumn("along", along).repartitionByRange("along", "doc").sortWithinPartitions("along", "doc")
            part = ordered.select("doc", "embedding").mapInArrow(along_order, schema)
            links = part if links is None else links.unionByName(part)
        links = written(_closest(links, degree), f"{work}/links0")

        def in_lists(batches):
            def found():
                for batch in batches:
                    for members in batch.column("members"):
                        rows = members.as_py()
                        if len(rows) > 1:
                            yield _best_of([r["doc"] for r in rows], np.array([r["embedding"] for r in rows], np.float64), degree)

            yield from _links(found())

        total = links.count()
        for r in range(1, rounds + 1):
            lists = _both_ways(links, degree).select(F.col("doc").alias("of"), F.col("other").alias("doc"))
            members = lists.join(given, "doc").groupBy("of").agg(F.array_sort(F.collect_list(F.struct("doc", "embedding"))).alias("members"))
            found = members.select("members").mapInArrow(in_lists, schema)
            better = written(_closest(links.unionByName(found), degree), f"{work}/links{r}")
            new = better.join(links, ["doc", "other"], "left_anti").count()
            links = better
            if new <= settled * total:
                break
        near = _both_ways(links, degree).groupBy("doc").agg(F.sort_array(F.collect_list("other")).alias("near"))
        nodes = given.join(near, "doc", "left").withColumn("near", F.coalesce("near", F.array().cast(f"array<{kind}>")))
        nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        entries = given.orderBy(F.xxhash64("doc"), "doc").limit(_ENTRIES)
        entries.coalesce(1).write.mode("overwrite").parquet(f"{path}/entries")
        return cls(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Graph":
        return cls(spark, path)

    def copy(self, path: str) -> "Graph":
        for name in ("nodes", "entries"):
            self.spark.read.parquet(f"{self.path}/{name}").write.mode("overwrite").parquet(f"{path}/{name}")
        return Graph(self.spark, path)

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/nodes")

    def search(self, queries: DataFrame, k: int = 10, beam: int = 64, digits: int = 6) -> DataFrame:
        """(query, doc, score, rank) of ``queries`` (``query``, ``embedding``)."""
        work, nodes = new_folder(self.spark, "walk"), self.table()
        asked = written(queries.select("query", F.col("embedding").alias("q")).where("embedding is not null"), f"{work}/asked")
        score = F.round(_dot(F.col("embedding"), F.col("q")), digits).alias("score")
        keep = max(beam, k)
        entries = F.broadcast(self.spark.read.parquet(f"{self.path}/entries"))  # _ENTRIES rows
        seen = top(asked.crossJoin(entries).select("query", "doc", score), keep).withColumn("looked", F.lit(False))
        seen, step = written(seen.drop("rank"), f"{work}/step0"), 0
        while not (edge := seen.where(~F.col("looked"))).isEmpty():
            step += 1
            hop = nodes.select("doc", "near").join(small(edge.select("query", "doc")), "doc").select("query", F.explode("near").alias("doc"))
            new = written(hop.distinct().join(seen.select("query", "doc"), ["query", "doc"], "left_anti"), f"{work}/new{step}")
            scored = nodes.select("doc", "embedding").join(small(new), "doc").join(small(asked), "query").select("query", "doc", score)
            held = seen.select("query", "doc", "score", F.lit(True).alias("looked")).unionByName(scored.withColumn("looked", F.lit(False)))
            order = W.partitionBy("query").orderBy(F.desc("score"), "doc")
            held = held.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= keep).drop("turn")
            seen = written(held, f"{work}/step{step}")
        return top(seen, k)
