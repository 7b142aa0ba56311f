"""Builds the rows that a retriever is trained on: question, positive and hard negatives.

    python -m jobs.training_rows --config jobs/training_rows.json --items IN --documents IN --output OUT

The documents that hold a question's text are its gold; the one with the smallest id is its positive.  Of the
``depth`` best documents of word BM25 the first ``negatives`` that aren't gold are its hard negatives.
Questions are split by position into train and eval, and into batches whose other positives serve as
in-batch negatives.  A row for each negative, with all texts:

* ``output/rows/part=train|eval``: batch, query, question, positive, positive_text, position, negative, negative_text, score

A question that no document holds has no positive and gives no row; the log says how many those are.  A rerun
writes the same rows over the old ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main
from lexmill.operators import analysis, bm25, questions
from lexmill.operators.evaluation import containing
from lexmill.operators.sizes import small, spread
from lexmill.runlog import logger
from lexmill.store import new_folder, written

_LOG = "jobs.training_rows"


def run(spark: SparkSession, items: str, documents: str, output: str, depth: int = 50, negatives: int = 5, eval_fraction: float = 0.1, batch_size: int = 16) -> DataFrame:
    """Writes the rows of all questions; returns them as written."""
    docs = spread(spark.read.parquet(documents).select(F.col("doc_id").alias("doc"), "text"))
    asked = spark.read.parquet(items).select(F.col("item_id").alias("query"), "text")
    n = asked.count()
    logger(_LOG).info("read %d questions from %s and %d documents from %s", n, items, docs.count(), documents)
    # what three later steps read is written once
    scratch = new_folder(spark, "training_rows")
    gold = written(containing(docs, asked).distinct(), f"{scratch}/gold")
    wrong = analysis.hard_negatives(bm25.search_words(docs, asked, depth), gold, negatives)
    pairs = wrong.withColumnRenamed("doc", "negative").join(gold.groupBy("query").agg(F.min("doc").alias("positive")), "query")
    pairs = written(pairs, f"{scratch}/pairs")
    # only the texts that a row names are shuffled
    named = pairs.select(F.explode(F.array("positive", "negative")).alias("doc")).distinct()
    texts = written(docs.join(small(named), "doc", "left_semi"), f"{scratch}/texts")
    text_of = lambda role: texts.select(F.col("doc").alias(role), F.col("text").alias(f"{role}_text"))
    rows = pairs.join(asked.withColumnRenamed("text", "question"), "query").join(text_of("positive"), "positive").join(text_of("negative"), "negative")
    rows = questions.split(rows, "query", n, eval_fraction).withColumn("batch", F.floor(F.col("query") / batch_size))
    rows = rows.select("batch", "query", "question", "positive", "positive_text", "position", "negative", "negative_text", "score", "part")
    rows.repartition("part", "batch").sortWithinPartitions("part", "batch", "query", "position").write.mode("overwrite").partitionBy("part").parquet(f"{output}/rows")
    made = read(spark, output, rows.schema)
    told = made.groupBy("part").agg(F.count("*").alias("rows"), F.count_distinct("query").alias("questions")).collect()
    for r in sorted(told):
        logger(_LOG).info("wrote %d rows of %d questions to %s/rows/part=%s", r["rows"], r["questions"], output, r["part"])
    logger(_LOG).info("%d questions are held by no document or have no negative", n - sum(r["questions"] for r in told))
    return made


def read(spark: SparkSession, output: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("basePath", f"{output}/rows").parquet(f"{output}/rows")


if __name__ == "__main__":
    main(run, ["items", "documents", "output"])
