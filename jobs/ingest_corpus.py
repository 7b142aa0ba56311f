"""Takes new files of documents into a corpus of cleaned, distinct texts and their chunks.

    python -m jobs.ingest_corpus --config jobs/ingest_corpus.json --documents IN --output OUT --checkpoint STATE

A file stream hands over what has arrived since the last run and ends (``availableNow``); its checkpoint
is the high-water mark.  Of each micro-batch the texts are cleaned, short ones and those that this or an
earlier batch has already are left out, and the rest is cut into chunks:

* ``output/documents/batch=N``: doc_id, source, text
* ``output/chunks/batch=N/source=S``: chunk_id, text, doc_id, chunk_index
* ``output/stats/batch=N``: what the batch read and wrote, as JSON
* ``checkpoint/stream`` and ``checkpoint/seen``: the stream's state and the hashes of all texts so far

A batch overwrites its own folders and looks at the hashes of earlier batches alone, so a batch that is
replayed after a crash leaves what it would have left at once, and a run without new files changes nothing.
An empty source is read back as null.  Of equal texts in one batch the smallest doc_id stays; between batches the earlier one does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import main
from lexmill.functions.text import clean_text
from lexmill.operators import chunking
from lexmill.operators.sizes import spread
from lexmill.runlog import logger
from lexmill.sources.files import is_folder
from lexmill.streaming.ingest import Seen

CHUNKS = "chunk_id string, text string, doc_id string, chunk_index int, batch int, source string"
_LOG = "jobs.ingest_corpus"


def ingest(batch: DataFrame, batch_id: int, seen: Seen, output: str, least: int, chunk_size: int, chunk_overlap: int) -> None:
    """One micro-batch."""
    spark, told = batch.sparkSession, Observation()
    here = lambda table: f"{output}/{table}/batch={batch_id}"
    rows = spread(batch.select("doc_id", "source", "text"))
    rows = rows.observe(told, F.count("*").alias("rows"))
    cleaned = rows.withColumn("text", clean_text(F.col("text")))
    # equal texts are equally long: the length comes last, or the filter would clean every text once more
    kept = seen.unseen(cleaned, batch_id, ordinal="doc_id").where(F.length("text") >= least)
    kept.write.mode("overwrite").parquet(here("documents"))
    kept = spark.read.schema(kept.schema).parquet(here("documents"))
    chunks = chunking.fixed(kept, chunk_size, chunk_overlap)
    chunks.select("chunk_id", "text", "doc_id", "chunk_index", "source").write.mode("overwrite").partitionBy("source").parquet(here("chunks"))
    seen.add(kept, batch_id)
    texts = kept.count()
    made = spark.read.schema(CHUNKS).parquet(here("chunks")).count() if texts else 0
    stats = (int(told.get.get("rows", 0)), texts, made)
    spark.createDataFrame([stats], "documents_read long, documents_written long, chunks_written long").coalesce(1).write.mode("overwrite").json(here("stats"))
    logger(_LOG).info("batch %d: read %d documents, wrote %d documents and %d chunks to %s", batch_id, *stats, output)


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, least: int = 20, chunk_size: int = 256, chunk_overlap: int = 64, buckets: int = 200, files_a_batch: int | None = None) -> DataFrame:
    """Takes in what is new under ``documents``; returns all chunks under ``output``."""
    chunking.check(chunk_size, chunk_overlap)
    schema = spark.read.parquet(documents).select("doc_id", "source", "text").schema
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    with Seen(spark, f"{checkpoint}/seen", buckets) as seen:
        step = lambda batch, batch_id: ingest(batch, batch_id, seen, output, least, chunk_size, chunk_overlap)
        stream = reader.parquet(_streamed(spark, documents)).writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/stream")
        query = stream.trigger(availableNow=True).start()
        query.awaitTermination()
    chunks = read(spark, output)
    logger(_LOG).info("%s: %d chunks in all", output, chunks.count())
    return chunks


def _streamed(spark: SparkSession, path: str) -> str:
    """A stream reads a folder or a pattern; a single file becomes the pattern that it alone fits."""
    return path if is_folder(spark, path) else f"{path[:-1]}[{path[-1]}]"


def read(spark: SparkSession, output: str) -> DataFrame:
    """All chunks."""
    return spark.read.schema(CHUNKS).option("basePath", f"{output}/chunks").parquet(f"{output}/chunks")


if __name__ == "__main__":
    main(run, ["documents", "output", "checkpoint"])
