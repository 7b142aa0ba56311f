"""Fusion of runs.  A run has query, doc, score, rank; systems are numbered in the order given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fetch_depth(k: int) -> int:
    return max(2 * k, 50)


def stacked(runs: dict[str, DataFrame], weights: list[float] | None = None) -> DataFrame:
    """The runs in one frame, with ``sys``, ``name`` and ``weight``."""
    weights = weights if weights is not None else [1.0] * len(runs)
    if len(weights) != len(runs):
        raise ValueError(f"Number of weights ({len(weights)}) must match number of retrievers ({len(runs)})")
    parts = [run.select("query", "doc", "score", "rank", F.lit(i).alias("sys"), F.lit(name).alias("name"), F.lit(float(w)).alias("weight")) for i, ((name, run), w) in enumerate(zip(runs.items(), weights))]
    return reduce(DataFrame.unionByName, parts)


def _ranked(fused: DataFrame, k: int, *by: str) -> DataFrame:
    order = W.partitionBy(*by, "query").orderBy(F.desc("score"), "seen", "doc")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("seen")


def rrf(runs: dict[str, DataFrame], k: int = 10, rrf_k: int = 60, weights: list[float] | None = None) -> DataFrame:
    """Sum of weight / (rrf_k + rank); ties by first appearance (system, rank).  ``sources``: rank by system."""
    s = stacked(runs, weights)
    fused = s.groupBy("query", "doc").agg(
        F.round(F.sum(F.col("weight") / (rrf_k + F.col("rank"))), 8).alias("score"),
        F.min(F.struct("sys", "rank")).alias("seen"),
        F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("sys", "name", "rank"))), lambda x: F.struct(x["name"], x["rank"]))).alias("sources"),
    )
    return _ranked(fused, k).select("query", "doc", "score", "rank", "sources")


def weighted(runs: dict[str, DataFrame], k: int = 10, weights: list[float] | None = None) -> DataFrame:
    """Weighted sum of scores scaled to 0..1 over each system's fetched rows of a query; equal scores scale to 0."""
    s = stacked(runs, weights)
    own = W.partitionBy("query", "sys")
    low, high = F.min("score").over(own), F.max("score").over(own)
    scaled = s.withColumn("part", F.col("weight") * (F.col("score") - low) / F.when(high > low, high - low).otherwise(1.0))
    fused = scaled.groupBy("query", "doc").agg(F.round(F.sum("part"), 8).alias("score"), F.min(F.struct("sys", "rank")).alias("seen"))
    return _ranked(fused, k).select("query", "doc", "score", "rank")


def fuse(runs: dict[str, DataFrame], method: str = "rrf", k: int = 10, rrf_k: int = 60, weights: list[float] | None = None) -> DataFrame:
    if method == "rrf":
        return rrf(runs, k, rrf_k, weights)
    if method == "weighted":
        return weighted(runs, k, weights)
    raise ValueError(f"Unknown fusion method: {method}")


def rrf_sweep(runs: dict[str, DataFrame], values: list[int], k: int = 10) -> DataFrame:
    """``rrf`` for several constants in one pass: (rrf_k, query, doc, score, rank)."""
    s = stacked(runs).withColumn("rrf_k", F.explode(F.array(*map(F.lit, values))))
    fused = s.groupBy("rrf_k", "query", "doc").agg(F.round(F.sum(F.col("weight") / (F.col("rrf_k") + F.col("rank"))), 8).alias("score"), F.min(F.struct("sys", "rank")).alias("seen"))
    return _ranked(fused, k, "rrf_k").select("rrf_k", "query", "doc", "score", "rank")
