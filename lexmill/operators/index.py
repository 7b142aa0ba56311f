"""Term frequencies, document frequencies and lengths, and a stats row; ``postings`` makes an index of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import char_ngrams, ngram_length, words


@dataclass(frozen=True)
class Analyzer:
    """How texts become terms: words, or character n-grams of a range."""

    kind: str = "word"
    low: int = 2
    high: int = 4

    def terms(self, text: Column) -> Column:
        return words(text) if self.kind == "word" else char_ngrams(text, self.low, self.high)

    def length(self, text: Column) -> Column:
        """Number of terms, without making n-grams."""
        return F.size(words(text)).cast("long") if self.kind == "word" else ngram_length(text, self.low, self.high)


def term_frequency(docs: DataFrame, analyzer: Analyzer, only: DataFrame | None = None) -> DataFrame:
    """(doc, term, tf); with ``only``, other terms are dropped right where they are made, before the shuffle."""
    terms = docs.select("doc", F.explode(analyzer.terms(F.col("text"))).alias("term"))
    if only is not None:
        terms = terms.join(only, "term", "left_semi")
    return terms.groupBy("doc", "term").agg(F.count("*").alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def corpus_df(docs: DataFrame, analyzer: Analyzer) -> DataFrame:
    """Document frequency of the whole vocabulary: each document gives a term once, then one partial sum."""
    return docs.select(F.explode(F.array_distinct(analyzer.terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def document_length(docs: DataFrame, analyzer: Analyzer) -> DataFrame:
    return docs.select("doc", analyzer.length(F.col("text")).alias("dl"))


def stats(lengths: DataFrame) -> DataFrame:
    """One row: n documents and their average length (1.0 without documents)."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def ids(frame: DataFrame, id_col: str, text_col: str = "text", name: str = "doc") -> DataFrame:
    return frame.select(F.col(id_col).alias(name), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
