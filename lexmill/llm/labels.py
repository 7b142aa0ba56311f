"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import held_out


def labelled_sample(labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id") -> list[tuple[int, int]]:
    """(id, label) on the driver: at most ``per_class`` rows of each class, those with the lowest hash.

    Held-out rows, null ids and null labels are left out; an id with several labels takes the largest.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    found: list[tuple[int, int]] = []
    for y in (0, 1):
        found += [(r.id, r.y) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class).collect()]
    return found


def rows_of(docs: DataFrame, sample: list[tuple[int, int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, y, text) of the sampled ids; the sample is bounded, so it is broadcast."""
    spark = docs.sparkSession
    side = spark.createDataFrame(sample, "id long, y int")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(side), "id").select("id", "y", "text")
