"""Error analysis, ablation and report frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bm25 import search_char_ranges
from .metrics import all_metrics, gold_sets


def buckets(sparse: DataFrame, dense: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(query, bucket): which system has a gold document in its top k; queries without gold are left out."""
    g = gold.select("query", "doc").where(F.col("doc").isNotNull()).distinct()
    found = lambda run, name: run.where(F.col("rank") <= k).join(g, ["query", "doc"], "left_semi").select("query").distinct().withColumn(name, F.lit(True))
    q = gold_sets(gold).where("size > 0").select("query").join(found(sparse, "s"), "query", "left").join(found(dense, "d"), "query", "left")
    s, d = F.coalesce("s", F.lit(False)), F.coalesce("d", F.lit(False))
    return q.select("query", F.when(s & d, "both_succeed").when(s, "sparse_only").when(d, "dense_only").otherwise("both_fail").alias("bucket"))


def summary(queries: DataFrame, bucketed: DataFrame) -> DataFrame:
    """One row of counts and shares; the shares' base counts queries without gold too."""
    q = queries.select("query").join(bucketed, "query", "left")
    n = lambda b: F.count(F.when(F.col("bucket") == b, 1))
    share = lambda x: F.round(x / F.greatest(F.count("*"), F.lit(1)), 6)
    both, sparse, dense = n("both_succeed"), n("sparse_only"), n("dense_only")
    return q.agg(
        F.count("*").alias("total_queries"), both.alias("both_succeed"), sparse.alias("sparse_only_wins"), dense.alias("dense_only_wins"), n("both_fail").alias("both_fail"),
        share(both + sparse).alias("sparse_recall"), share(both + dense).alias("dense_recall"), share(both).alias("agreement_rate"),
    )


def first_five(run: DataFrame, name: str) -> DataFrame:
    """(query, {name}_retrieved, {name}_scores): the top five, in order."""
    top = F.slice(F.sort_array(F.collect_list(F.struct("rank", "doc", "score"))), 1, 5)
    got = run.where("rank <= 5").groupBy("query").agg(top.alias("t"))
    return got.select("query", F.transform("t", lambda x: x["doc"]).alias(f"{name}_retrieved"), F.transform("t", lambda x: x["score"]).alias(f"{name}_scores"))


def cases(queries: DataFrame, sparse: DataFrame, dense: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    golds = gold.where(F.col("doc").isNotNull()).groupBy("query").agg(F.sort_array(F.collect_set("doc")).alias("gold_chunks"))
    out = buckets(sparse, dense, gold, k).join(queries.select("query", F.col("text").alias("query_text")), "query").join(golds, "query")
    return out.join(first_five(sparse, "sparse"), "query", "left").join(first_five(dense, "dense"), "query", "left")


def displacement(sparse: DataFrame, dense: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(query, doc, sparse_rank, dense_rank, displacement) of each gold pair; a miss is null."""
    g = gold.select("query", "doc").where(F.col("doc").isNotNull()).distinct()
    rank = lambda run, name: run.where(F.col("rank") <= k).select("query", "doc", F.col("rank").alias(name))
    j = g.join(rank(sparse, "sparse_rank"), ["query", "doc"], "left").join(rank(dense, "dense_rank"), ["query", "doc"], "left")
    return j.withColumn("displacement", F.abs(F.col("sparse_rank") - F.col("dense_rank")))


def ngram_ablation(docs: DataFrame, queries: DataFrame, gold: DataFrame, ranges: list[tuple[int, int]], k: int = 10) -> DataFrame:
    """All metrics of character BM25 for each n-gram range."""
    name = F.element_at(F.array(*(F.lit(f"char_bm25_{low}_{high}") for low, high in ranges)), F.col("range") + 1)
    return all_metrics(search_char_ranges(docs, queries, ranges, k).withColumn("retriever", name).drop("range"), gold, k)


def comparison(metrics: DataFrame, names: list[str]) -> DataFrame:
    """A row for each retriever, a column for each metric."""
    return metrics.groupBy("retriever").pivot("metric", names).agg(F.first("value"))


def best(metrics: DataFrame) -> DataFrame:
    """Adds ``best``: the value equals its metric's maximum (ties are all best)."""
    return metrics.withColumn("best", F.col("value") == F.max("value").over(W.partitionBy("metric")))


def hard_negatives(run: DataFrame, gold: DataFrame, per_query: int = 5) -> DataFrame:
    """The best-ranked documents that aren't gold: (query, doc, score, position)."""
    wrong = run.join(gold.select("query", "doc"), ["query", "doc"], "left_anti")
    order = W.partitionBy("query").orderBy("rank")
    return wrong.withColumn("position", F.row_number().over(order)).where(F.col("position") <= per_query).select("query", "doc", "score", "position")


def latex(metrics: DataFrame, names: list[str], title: str, caption: str = "", label: str = "tab:results") -> str:
    """The comparison as a LaTeX table; every best value is bold.  Rows are retrievers, so few."""
    rows: dict[str, dict[str, str]] = {}
    for r in best(metrics).orderBy("retriever").collect():
        text = f"{r.value:.4f}"
        rows.setdefault(r.retriever, {})[r.metric] = rf"\textbf{{{text}}}" if r.best else text
    head = " & ".join([r"\textbf{System}", *(rf"\textbf{{{n}}}" for n in names)])
    body = [" & ".join([system.replace("_", r"\_"), *(cells.get(n, "") for n in names)]) + r" \\" for system, cells in rows.items()]
    lines = [r"\begin{table}[ht]", r"\centering", rf"\caption{{{caption or title}}}", rf"\label{{{label}}}", r"\begin{tabular}{l" + "c" * len(names) + "}", r"\toprule", head + r" \\", r"\midrule"]
    return "\n".join([*lines, *body, r"\bottomrule", r"\end{tabular}", r"\end{table}"])
