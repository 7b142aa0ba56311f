"""BM25 search of a frame of queries: scans of the texts and a top-k window; the fill of short lists.

Scores are rounded before they are ranked, so that the order of a sum doesn't change a result; ties go
to the smaller document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..store import new_folder, written
from . import text_scan
from .index import Analyzer
from .sizes import small

DIGITS = 6
_STEP = 4096


def query_terms(queries: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(query, term, times)."""
    return queries.select("query", F.explode(analyzer.terms(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query: (query, doc, score, rank)."""
    best = W.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "doc", "score", "rank")


def search_chars(docs: DataFrame, queries: DataFrame, k: int = 10, low: int = 2, high: int = 4, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Character n-gram BM25: distinct query n-grams, unknown ones ignored, positive scores only.

    docs: ``doc``, ``text``; queries: ``query``, ``text``.  The texts are read, in two passes (``text_scan``);
    an index that is built once is searched by ``postings``.
    """
    found = text_scan.search_grams(docs, queries, [(low, high)], k, k1, b, DIGITS).drop("range")
    return written(top(found, k), new_folder(docs.sparkSession, "chars"))  # k rows a query, whatever reads them


def search_char_ranges(docs: DataFrame, queries: DataFrame, ranges: list[tuple[int, int]], k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``search_chars`` for several n-gram ranges in the same two passes: adds ``range``, the position in ``ranges``."""
    best = W.partitionBy("range", "query").orderBy(F.desc("score"), "doc")
    found = text_scan.search_grams(docs, queries, ranges, k, k1, b, DIGITS)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


EPSILON = 0.25


def _raw_idf(df: DataFrame, n: int) -> DataFrame:
    return df.select("term", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))


def word_idf(df: DataFrame, n: int, epsilon: float = EPSILON) -> DataFrame:
    """ln(N - df + 0.5) - ln(df + 0.5); negative ones become ``epsilon`` times the vocabulary's mean."""
    raw = _raw_idf(df, n)
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def search_words(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Word BM25: a repeated query word counts again; always min(k, N) rows a query, so the best of the
    documents without a shared word follow with score 0, before negative scores.

    The texts are read in two passes (``text_scan``), which keep k rows a query and task and score every document;
    a third one counts the vocabulary where an idf is negative.
    """
    mean = lambda n: _raw_idf(text_scan.word_df(docs), n).agg(F.avg("raw")).first()[0]
    found = text_scan.search_words(docs, queries, mean, k, k1, b, DIGITS, EPSILON)
    return written(top(found, k), new_folder(docs.sparkSession, "words"))  # k rows a query, whatever reads them


def filled(docs: DataFrame, queries: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query; the first documents without a score follow with 0, before negative scores.

    ``scored`` may lack documents of the queries that have k positive scores.
    """
    best = written(top(scored, k), new_folder(docs.sparkSession, "best"))  # k rows a query
    above = queries.select("query").distinct().join(best.groupBy("query").agg(F.count(F.when(F.col("score") > 0, 1)).alias("above")), "query", "left")
    short = above.where(F.coalesce("above", F.lit(0)) < k).select("query")
    if short.isEmpty():
        return best
    matched = scored.join(short, "query", "left_semi").groupBy("query").agg(F.count("*").alias("m"))
    need = short.join(matched, "query", "left").select("query", F.coalesce("m", F.lit(0)).alias("m"))
    return top(best.select("query", "doc", "score").unionByName(_first_unmatched(docs, need, scored, k)), k)


def _first_unmatched(docs: DataFrame, need: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """For each query in need, the k smallest documents that share no word with it, score 0.

    Among the k + m smallest documents, m the query's matches, k are unmatched.
    """
    most = int(need.agg(F.max("m")).first()[0]) + k
    first = small(positions(docs).where(F.col("at") <= most))
    upto, step = F.col("m") + k, F.lit(_STEP)
    blocks = need.select("query", "m", F.explode(F.sequence(F.lit(0), F.floor((upto - 1) / step))).alias("b"))
    asked = blocks.select("query", F.explode(F.sequence(F.col("b") * step + 1, F.least((F.col("b") + 1) * step, upto))).alias("at"))
    pairs = asked.join(first, "at").select("query", "doc")
    free = pairs.join(scored.select("query", "doc"), ["query", "doc"], "left_anti")
    return top(free.withColumn("score", F.lit(0.0)), k).select("query", "doc", "score")


def positions(docs: DataFrame) -> DataFrame:
    """(doc, at): ids counted from 1 by size.

    Sorted by ranges and written; each range then starts after the rows of those before it, a number a task.
    """
    ids = docs.select("doc").repartitionByRange("doc").sortWithinPartitions("doc")
    ids = written(ids.select("doc", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("i")), new_folder(docs.sparkSession, "positions"))
    sizes = ids.groupBy("part").agg(F.count("*").alias("n"), F.min("i").alias("first")).orderBy("part").collect()
    shifts, before = [], 1
    for r in sizes:
        shifts.append((r["part"], before - r["first"]))
        before += r["n"]
    shift = docs.sparkSession.createDataFrame(shifts, "part int, shift long")
    return ids.join(F.broadcast(shift), "part").select("doc", (F.col("i") + F.col("shift")).alias("at"))
