"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir) and gives the next one's documents.

1. toxicity: documents with a toxicity score of 0.7 or more go.
2. near_join: of each class of near-duplicates, the document with the smallest id stays.
3. decontaminate: documents that contain a benchmark item go.
4. pii: personal data and the terms that disclose it are replaced in the texts.
5. mix: each document as it is now, how often and how many of its words the mix of sources takes.

Each stage is written as Parquet and read again, so a lost executor costs no earlier stage.  Nulls,
empty texts, repeated rows and empty tables are treated as the operators' modules say; columns beyond
those of ``documents`` are carried through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, mixing, near_join, pii, toxicity
from lexmill.llm.support import Shelf, fresh, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.Sanitiser(docs).sanitised()
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed(docs, carry=docs.columns)
    return mixed.select("row.*", *(F.col(c).alias(fresh(docs, c)) for c in ("size", "source_size", "target", "times", "taken")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", sanitise),
    ("mix", mix),
]

#: The fitted, compressed and iterated stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, shelf = table(spark, sf_dir, "documents"), Shelf(spark)
    for name, stage in STAGES:
        docs = shelf.put(stage(spark, docs, sf_dir), name)
    return docs
