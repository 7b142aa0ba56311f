"""Filters, exact dedup and their counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def long_enough(df: DataFrame, text: str = "text", least: int = 20) -> DataFrame:
    return df.where(F.length(text) >= least)


def text_hash(text: str = "text") -> Column:
    return F.md5(F.col(text).cast("binary"))


def keep_first(df: DataFrame, text: str = "text", ordinal: str = "ordinal") -> DataFrame:
    """The first row by ordinal of each text; null ordinals come last, null texts count as one text.

    A rank limit runs before the shuffle, so a task sends one row of a text however many copies it holds,
    and ``df`` is computed once.
    """
    first = W.partitionBy("_h").orderBy(F.col(ordinal).asc_nulls_last())
    return df.withColumn("_h", text_hash(text)).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_h", "_n")


def first_long(df: DataFrame, text: str = "text", ordinal: str = "ordinal", least: int = 20) -> DataFrame:
    """First rows of the texts that are long enough.

    Equal texts are equally long, so the filter may come last: there it isn't pushed below the cleaning of
    ``df``, which would be computed for it once more.
    """
    return long_enough(keep_first(df, text, ordinal), text, least)


def unseen(df: DataFrame, seen: DataFrame, text: str = "text", ordinal: str = "ordinal") -> DataFrame:
    """First rows whose hash isn't in ``seen`` (column ``h``)."""
    return keep_first(df, text, ordinal).withColumn("h", text_hash(text)).join(seen.select("h").distinct(), "h", "left_anti").drop("h")


def status(df: DataFrame, text: str = "text", ordinal: str = "ordinal", least: int = 20) -> DataFrame:
    """Adds ``status``: short (checked first), dup or kept."""
    long = F.length(text) >= least
    first = F.row_number().over(W.partitionBy("_h", long).orderBy(ordinal)) == 1
    return df.withColumn("_h", text_hash(text)).withColumn("status", F.when(~long, "short").when(first, "kept").otherwise("dup")).drop("_h")


def clean_stats(df: DataFrame, text: str = "text", ordinal: str = "ordinal", least: int = 20) -> DataFrame:
    """total, kept, removed_short and removed_dup, from aggregates alone."""
    long = F.length(text) >= least
    per_text = df.groupBy(text_hash(text).alias("h")).agg(F.count("*").alias("n"), F.count(F.when(long, 1)).alias("long"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    kept = F.when(F.col("long") > 0, 1).otherwise(0)
    return per_text.agg(total("n").alias("total"), total(kept).alias("kept"), total(F.col("n") - F.col("long")).alias("removed_short"), total(F.col("long") - kept).alias("removed_dup"))


def corpus_stats(raw: DataFrame, cleaned: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counts and the average chunk length, 0 without chunks."""
    parts = raw.select(F.lit("raw").alias("k"), F.lit(0).alias("n")).unionByName(cleaned.select(F.lit("cleaned").alias("k"), F.lit(0).alias("n")))
    parts = parts.unionByName(chunks.select(F.lit("chunk").alias("k"), F.length("text").alias("n")))
    count = lambda k: F.count(F.when(F.col("k") == k, 1))
    average = F.sum(F.when(F.col("k") == "chunk", F.col("n"))) / F.greatest(count("chunk"), F.lit(1))
    return parts.agg(count("raw").alias("raw_documents"), count("cleaned").alias("cleaned_documents"), count("chunk").alias("chunks"), F.coalesce(average, F.lit(0.0)).alias("avg_chunk_length"))
