"""A stream of queries against an index that stands: each micro-batch is searched at once and written to its own folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.retrievers import Retriever
from ..store import new_folder, written


def answer_batch(retriever: Retriever, batch: DataFrame, batch_id: int, out_path: str, k: int = 10) -> None:
    """For foreachBatch: the hits of a batch's queries (``query``, ``text``) at ``out_path/batch=N``.

    A replayed batch overwrites its own folder, so it leaves what one run leaves.  A query id that a batch holds
    twice is searched once, by the text that sorts first; null texts find what empty ones find.  A batch without
    queries writes an empty folder.
    """
    asked = batch.groupBy("query").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    asked = written(asked, new_folder(batch.sparkSession, "asked"))  # a search reads its queries more than once
    hits = retriever.retrieve(asked, k).select("query", "chunk_id", "score", "rank", "text")
    hits.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")


def search_stream(queries: DataFrame, retriever: Retriever, out_path: str, checkpoint: str, k: int = 10):
    """A started query that takes what is new in ``queries`` (a stream) and ends; a later one goes on from ``checkpoint``."""
    retriever._checked()
    sink = lambda batch, batch_id: answer_batch(retriever, batch, batch_id, out_path, k)
    return queries.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
