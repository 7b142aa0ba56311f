"""Report files: aggregate CSV, per-query JSON, error buckets, LaTeX."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analysis import comparison, latex


def aggregate_csv(metrics: DataFrame, names: list[str], path: str) -> bool:
    """retriever and metrics with four decimals; nothing is written without rows."""
    wide = comparison(metrics, names)
    if wide.isEmpty():
        return False
    wide.select("retriever", *(F.format_string("%.4f", F.col(f"`{n}`")).alias(n) for n in names)).orderBy("retriever").coalesce(1).write.mode("overwrite").csv(path, header=True)
    return True


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A results CSV; its first column is named System."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    first, *rest = df.columns
    return df.select(F.col(f"`{first}`").alias("System"), *(F.col(f"`{c}`").cast("double").alias(c) for c in rest))


def write_results(wide: DataFrame, path: str) -> None:
    """Results with the first column named System, as one CSV."""
    wide.coalesce(1).write.mode("overwrite").csv(path, header=True)


def details_json(per_query: DataFrame, path: str, totals: DataFrame | None = None, retrieved: DataFrame | None = None, k: int = 10) -> None:
    """A record for each retriever: top_k, its metrics, those of each query and, if given, what each query found."""
    gathered = lambda df, row, name: df.groupBy("retriever").agg(F.sort_array(F.collect_list(row)).alias(name))
    out = gathered(per_query, F.struct("query", "rr", "recall", "precision", "ndcg"), "per_query_metrics").withColumn("top_k", F.lit(k))
    if totals is not None:
        out = out.join(gathered(totals, F.struct("metric", "value"), "m").select("retriever", F.map_from_entries("m").alias("aggregate_metrics")), "retriever", "left")
    if retrieved is not None:
        out = out.join(gathered(retrieved, F.struct("query", "question", "gold_ids", "retrieved"), "per_query_details"), "retriever", "left")
    out.write.mode("overwrite").json(path)


def error_files(cases: DataFrame, summary: DataFrame, path: str) -> None:
    cases.write.mode("overwrite").partitionBy("bucket").json(f"{path}/cases")
    summary.write.mode("overwrite").json(f"{path}/summary")


def latex_file(metrics: DataFrame, names: list[str], title: str, path: str, **options: str) -> None:
    spark = metrics.sparkSession
    spark.createDataFrame([(latex(metrics, names, title, **options),)], "value string").coalesce(1).write.mode("overwrite").text(path)
