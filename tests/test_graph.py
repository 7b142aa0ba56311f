import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import dense
from lexmill.operators.graph import Graph
from lexmill.operators.retrievers import Dense


def vectors(spark, n, d, seed, centers=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    if centers:
        x = r.normal(size=(centers, d))[r.integers(0, centers, n)] + 0.3 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "doc long, embedding array<float>")


@pytest.mark.parametrize("centers", [0, 20])
def test_recall(spark, tmp_path, centers):
    df = vectors(spark, 1500, 16, 3, centers)
    queries = df.where("doc % 50 = 0").withColumnRenamed("doc", "query")
    exact = {(r.query, r.doc): r.score for r in dense.search_flat(df, queries, 10).collect()}
    made = Graph.build(df, str(tmp_path / "g"))
    near = {(r.query, r.doc): r.score for r in made.search(queries, 10).collect()}
    assert len(exact.keys() & near.keys()) >= 0.9 * len(exact) and len(near) == len(exact)
    assert all(abs(near[p] - exact[p]) < 2e-6 for p in exact.keys() & near.keys())
    assert made.table().agg(F.max(F.size("near"))).first()[0] <= 32


def test_small_and_odd_tables(spark, tmp_path):
    schema = "doc string, embedding array<float>"
    none = Graph.build(spark.createDataFrame([], schema), str(tmp_path / "none"))
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("r", None)], "query string, embedding array<float>")
    assert none.search(asked, 3).count() == 0
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", None), *((f"e{i:03d}", [0.6, 0.8]) for i in range(300))]
    made = Graph.build(spark.createDataFrame(rows, schema), str(tmp_path / "g"))
    assert [(r.query, r.doc, r["rank"]) for r in made.search(asked, 2).orderBy("rank").collect()] == [("q", "a", 1), ("q", "b", 2)]
    assert made.search(asked.limit(0), 2).count() == 0
    one = Graph.build(spark.createDataFrame(rows[:1], schema), str(tmp_path / "one"))
    assert one.search(asked, 2).count() == 1


def test_dense_retriever_keeps_its_graph(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", f"river farm {i} boat {i % 7}") for i in range(40)], "chunk_id string, text string")
    made = Dense(index_type="graph").index(chunks)
    found = [r.chunk_id for r in made.retrieve_one("river farm 3", 5).collect()]
    made.save(str(tmp_path / "d"))
    again = Dense().load(spark, str(tmp_path / "d"))
    assert again.index_type == "graph" and [r.chunk_id for r in again.retrieve_one("river farm 3", 5).collect()] == found
    flat = [r.chunk_id for r in Dense().index(chunks).retrieve_one("river farm 3", 5).collect()]
    assert found == flat
