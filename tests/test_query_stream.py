import pytest

from lexmill.operators.retrievers import WordBM25
from lexmill.streaming.search import answer_batch, search_stream

TEXTS = {"a1": "river delta farm", "a2": "delta music", "a3": "river river boat"}
SCHEMA = "query string, text string"


def test_batches_replay_and_only_new_queries(spark, tmp_path):
    chunks = spark.createDataFrame(list(TEXTS.items()), "chunk_id string, text string")
    word, out = WordBM25(), str(tmp_path / "out")
    with pytest.raises(RuntimeError):
        search_stream(spark.readStream.schema(SCHEMA).json(str(tmp_path)), word, out, str(tmp_path / "c"))
    word.index(chunks)

    def run(name, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        search_stream(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), word, out, str(tmp_path / "c"), 2).awaitTermination()
        return sorted((r.batch, r["query"], r["rank"], r.chunk_id) for r in spark.read.parquet(out).collect())

    first = run("one", [("q1", "music"), ("q1", "river")])
    assert first == [(0, "q1", 1, "a2"), (0, "q1", 2, "a1")]
    second = run("two", [("q2", "boat"), ("q3", None)])
    assert second[:2] == first and [r for r in second if r[0] == 1] == [(1, "q2", 1, "a3"), (1, "q2", 2, "a1"), (1, "q3", 1, "a1"), (1, "q3", 2, "a2")]
    answer_batch(word, spark.createDataFrame([("q2", "boat"), ("q3", None)], SCHEMA), 1, out, 2)
    assert sorted((r.batch, r["query"], r["rank"], r.chunk_id) for r in spark.read.parquet(out).collect()) == second
