"""Retrieval metrics over (retriever, query, doc, rank) runs and (query, doc) gold.

Queries count when they are in the run and in gold; a gold row with a null or empty doc makes its
query known with nothing to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gold_sets(gold: DataFrame) -> DataFrame:
    """(query, size) of every known query."""
    known = F.when(F.col("doc").isNotNull() & (F.col("doc").cast("string") != ""), F.col("doc"))
    return gold.groupBy("query").agg(F.count_distinct(known).alias("size"))


def judged(run: DataFrame, gold: DataFrame) -> DataFrame:
    """The run's rows of known queries, with ``hit`` and the gold ``size``."""
    if "retriever" not in run.columns:
        run = run.withColumn("retriever", F.lit("run"))
    right = gold.select("query", "doc").distinct().withColumn("hit", F.lit(1))
    return run.join(gold_sets(gold), "query").join(right, ["query", "doc"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def _ideal(size: Column, k: int) -> Column:
    """Discounted gain of ``least(size, k)`` hits at the top."""
    gains = [F.lit(0.0)]
    for i in range(1, k + 1):
        gains.append(gains[-1] + F.lit(1.0) / F.log2(F.lit(i + 1.0)))
    return F.element_at(F.array(*gains), (F.least(size, F.lit(k)) + 1).cast("int"))


def per_query(run: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """retriever, query, size, rr, recall, precision, ndcg and ap (over the whole list)."""
    j = judged(run, gold)
    order = W.partitionBy("retriever", "query").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    j = j.withColumn("so_far", F.sum("hit").over(order))
    top_hit = (F.col("hit") == 1) & (F.col("rank") <= k)
    q = j.groupBy("retriever", "query", "size").agg(
        F.min(F.when(top_hit, F.col("rank"))).alias("first"),
        F.count_distinct(F.when(top_hit, F.col("doc"))).alias("found"),
        F.coalesce(F.sum(F.when(top_hit, 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("gain"),
        F.sum(F.col("hit") * F.col("so_far") / F.col("rank")).alias("precisions"),
    )
    any_gold = F.col("size") > 0
    return q.select(
        "retriever", "query", "size",
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.when(any_gold, F.col("found") / F.col("size")).alias("recall"),
        (F.col("found") / F.lit(k)).alias("precision"),
        F.when(any_gold, F.col("gain") / _ideal(F.col("size"), k)).otherwise(0.0).alias("ndcg"),
        F.when(any_gold, F.col("precisions") / F.col("size")).alias("ap"),
    )


def all_metrics(run: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(retriever, metric, value): recall and map leave out queries without gold."""
    means = per_query(run, gold, k).groupBy("retriever").agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("rr", "recall", "ndcg", "precision", "ap")))
    names = {"rr": f"mrr@{k}", "recall": f"recall@{k}", "ndcg": f"ndcg@{k}", "precision": f"precision@{k}", "ap": "map"}
    rows = ", ".join(f"'{name}', {c}" for c, name in names.items())
    return means.select("retriever", F.expr(f"stack({len(names)}, {rows}) as (metric, value)")).withColumn("value", F.round("value", 6))


def query_ids(ordinal: str) -> Column:
    return F.format_string("q_%04d", F.col(ordinal))
