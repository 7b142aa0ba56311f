"""Streaming ingest: cleaning and dedup that remembers earlier micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators.dedup import keep_first, text_hash
from ..sources.files import exists


def cleaned_stream(docs: DataFrame, least: int = 20, event_time: str | None = None, delay: str = "1 day", **cleaning) -> DataFrame:
    """Cleaned texts of ``least`` characters or more, each text once.

    The seen hashes are the state.  With ``event_time`` they are forgotten ``delay`` after they were seen,
    which bounds the state; without, they are kept for good, as the batch operator keeps them.
    """
    kept = docs.withColumn("text", clean_text(F.col("text"), **cleaning)).where(F.length("text") >= least).withColumn("h", text_hash())
    if event_time:
        return kept.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["h"])
    return kept.dropDuplicates(["h"])


def remember(batch: DataFrame, batch_id: int, seen_path: str, out_path: str, ordinal: str = "ordinal") -> None:
    """For foreachBatch: writes a batch's unseen texts and their hashes, each to the batch's own folder.

    A batch looks at earlier batches alone and overwrites its own folders, so one that is replayed after a
    crash, between the two writes too, leaves what it would have left at once.
    """
    spark = batch.sparkSession
    fresh = keep_first(batch, ordinal=ordinal).withColumn("h", text_hash())
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(seen_path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        seen = spark.read.schema("h string, batch long").parquet(seen_path).where(F.col("batch") < batch_id)
        fresh = fresh.join(seen.select("h").distinct(), "h", "left_anti")
    written = f"{out_path}/batch={batch_id}"
    fresh.drop("h").write.mode("overwrite").parquet(written)
    spark.read.schema(batch.schema).parquet(written).select(text_hash().alias("h")).write.mode("overwrite").parquet(f"{seen_path}/batch={batch_id}")


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, **options):
    """A started query from a folder of Parquet files to Parquet."""
    stream = cleaned_stream(spark.readStream.schema(schema).parquet(source), **options)
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").start()


class Seen:
    """Hashes of texts seen so far, in a bucketed table at ``path``.

    A batch's hashes are shuffled into the table's buckets and meet each bucket where it is stored, so what
    was seen earlier is read but never shuffled, however much there is (given at least as many buckets as
    ``spark.sql.shuffle.partitions``, or Spark prefers to deal both sides anew).  Hashes carry their batch and
    a batch looks at earlier ones alone, so a replayed batch finds what it found at first.  The number of
    buckets is fixed for good when the table is new; a different one is refused.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 200):
        self.spark, self.path, self.buckets, self.name = spark, path, buckets, f"lexmill_seen_{uuid.uuid4().hex}"

    def __enter__(self) -> "Seen":
        at = f"{self.path}/buckets={self.buckets}"
        if exists(self.spark, self.path) and not exists(self.spark, at):
            raise ValueError(f"{self.path} has another number of buckets than {self.buckets}")
        self.spark.sql(f"create table {self.name} (h string, batch bigint) using parquet clustered by (h) into {self.buckets} buckets location '{at}'")
        return self

    def __exit__(self, *_) -> None:
        self.spark.sql(f"drop table {self.name}")  # its files are its own and stay

    def before(self, batch_id: int, spark: SparkSession | None = None) -> DataFrame:
        return (spark or self.spark).table(self.name).where(F.col("batch") < batch_id).select("h")

    def unseen(self, batch: DataFrame, batch_id: int, text: str = "text", ordinal: str = "ordinal") -> DataFrame:
        """The first row by ordinal of each text that no earlier batch had."""
        first = keep_first(batch, text, ordinal).withColumn("_h", text_hash(text))
        earlier = self.before(batch_id, batch.sparkSession)
        return first.join(earlier, F.col("_h") == F.col("h"), "left_anti").drop("_h")

    def add(self, texts: DataFrame, batch_id: int, text: str = "text") -> None:
        hashes = texts.select(text_hash(text).alias("h"), F.lit(batch_id).cast("long").alias("batch"))
        hashes.repartition(self.buckets, "h").write.insertInto(self.name)
