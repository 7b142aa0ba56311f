"""A BM25 index as tables: blocks of postings in layers of impact, built once and searched with pruning.

A posting's impact is the saturated term frequency, tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)), which a
query weighs by idf and by the times it names the term.  ``postings`` holds a row for each block: the term, its
layer (sixteenths of the largest impact there can be), the block's largest impact and its documents.  Blocks
have about ``block`` documents: a frequent term's layers are split by hash of the document, so no group is
large.  The table is partitioned by a hash of the term, and a search reads the partitions of its terms.

A search finds the exact top k in two steps:

1. each query's terms with the largest bounds (the seeds) are scored alone; the k-th best of these partial
   scores is a floor that k documents reach for certain;
2. a block is left out where its largest impact and all other terms' bounds together stay below the floor; and
   a document that only has terms whose bounds together stay below it is no candidate.  What is left is summed.

Without k such documents, or where an idf is negative, nothing is left out.

``terms``: bucket, term, df, most (largest impact), idf; ``lengths``: doc, dl; ``corpus``: as given; ``params``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tokens import char_ngrams, words
from ..store import new_folder, written
from .bm25 import DIGITS, filled, query_terms, top, word_idf
from .index import Analyzer, document_length, stats
from .sizes import small

LAYERS = 16
_SEEDS = 8
_LITERALS = 1_000  # partitions or terms that are handed to the scan as a filter
_TERMS = "bucket int, term string, df long, most double, idf double"


def frequencies(docs: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(doc, dl, term, tf); n-grams are made once for each distinct word of a document."""
    sized = docs.select("doc", "text", analyzer.length(F.col("text")).alias("dl"))
    tf = sized.select("doc", "dl", F.explode(words(F.col("text"))).alias("term")).groupBy("doc", "dl", "term").agg(F.count("*").alias("tf"))
    if analyzer.kind == "word":
        return tf
    grams = tf.select("doc", "dl", F.explode(char_ngrams(F.col("term"), analyzer.low, analyzer.high)).alias("term"), "tf")
    return grams.groupBy("doc", "dl", "term").agg(F.sum("tf").alias("tf"))


@dataclass
class Postings:
    spark: SparkSession
    path: str
    analyzer: Analyzer
    k1: float = 1.5
    b: float = 0.75
    buckets: int = 1

    @classmethod
    def build(cls, corpus: DataFrame, path: str, analyzer: Analyzer, k1: float = 1.5, b: float = 0.75, buckets: int | None = None, block: int = 1_024) -> "Postings":
        """corpus: ``doc``, ``text`` and anything else worth keeping; a partition for each 2,000 terms, unless told otherwise."""
        made = cls(corpus.sparkSession, path, analyzer, k1, b)
        kept = written(corpus, f"{path}/corpus")
        lengths = written(document_length(kept, analyzer), f"{path}/lengths")
        row = stats(lengths).first()
        n, avgdl = row["n"], row["avgdl"]
        impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
        tf = written(frequencies(kept, analyzer).select("doc", "term", impact.alias("impact")), new_folder(made.spark, "impacts"))
        seen = written(tf.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("most")), new_folder(made.spark, "terms"))
        made.buckets = buckets = buckets or min(1_024, 1 + seen.count() // 2_000)
        idf = word_idf(seen, n) if analyzer.kind == "word" else seen.select("term", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
        terms = seen.join(idf, "term").select(made._bucket(), "term", "df", "most", "idf")
        terms.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
        # only a term of more than a block is split
        often = seen.where(F.col("df") > block).select("term", F.ceil(F.col("df") / block).alias("parts"))
        layer = F.least(F.floor(F.col("impact") / (k1 + 1) * LAYERS), F.lit(LAYERS - 1)).cast("int")
        part = F.coalesce(F.pmod(F.xxhash64("doc"), F.col("parts")), F.lit(0)).cast("int")
        rows = tf.join(small(often), "term", "left").select("term", layer.alias("layer"), part.alias("part"), "doc", "impact")
        blocks = rows.groupBy("term", "layer", "part").agg(F.max("impact").alias("best"), F.collect_list(F.struct("doc", "impact")).alias("docs"))
        blocks = blocks.select(made._bucket(), "term", "layer", "part", "best", "docs")
        dealt = blocks.repartition("bucket", F.col("part") % 8).sortWithinPartitions("bucket", "term", F.desc("layer"), "part")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        params = (analyzer.kind, analyzer.low, analyzer.high, k1, b, buckets)
        made.spark.createDataFrame([params], "kind string, low int, high int, k1 double, b double, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/params")
        return made

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Postings":
        p = spark.read.parquet(f"{path}/params").first()
        return cls(spark, path, Analyzer(p.kind, p.low, p.high), p.k1, p.b, p.buckets)

    def copy(self, path: str) -> "Postings":
        """The same tables under another path."""
        for name in ("corpus", "lengths", "params"):
            self._read(name).write.mode("overwrite").parquet(f"{path}/{name}")
        for name, by in (("terms", ("bucket", "term")), ("postings", ("bucket", "term", "layer", "part"))):
            self._read(name).repartition("bucket", F.spark_partition_id()).sortWithinPartitions(*by).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
        return Postings(self.spark, path, self.analyzer, self.k1, self.b, self.buckets)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def corpus(self) -> DataFrame:
        return self._read("corpus")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _terms(self, queries: DataFrame) -> DataFrame:
        """(query, term, weight, bound, df, bucket) of the queries' known terms, written: every later step reads it."""
        asked = query_terms(queries, self.analyzer)
        asked = asked.withColumn("times", F.lit(1)) if self.analyzer.kind == "char" else asked
        asked = written(asked.select("query", "term", "times", self._bucket()), new_folder(self.spark, "asked"))
        known = self.spark.read.schema(_TERMS).parquet(f"{self.path}/terms").where(self._among(asked))
        weight = F.col("times") * F.col("idf")
        both = known.join(small(asked), ["bucket", "term"]).select("query", "term", weight.alias("weight"), (weight * F.col("most")).alias("bound"), "df", "bucket")
        return written(both, new_folder(self.spark, "weights"))

    def _among(self, terms: DataFrame) -> Column:
        """The partitions of these terms, as a filter that prunes the scan."""
        found = [r.bucket for r in terms.select("bucket").distinct().limit(_LITERALS + 1).collect()]
        return F.col("bucket").isin(found) if len(found) <= _LITERALS else F.lit(True)

    def _matches(self, terms: DataFrame) -> DataFrame:
        """(query, doc, part, essential) of the blocks of these weighed terms; ``others`` and ``floor`` leave blocks out."""
        source = self._read("postings").withColumn("bucket", F.col("bucket").cast("int")).where(self._among(terms))
        blocks = source.join(small(terms), ["bucket", "term"])
        hopeful = blocks.where(F.col("floor").isNull() | (F.col("weight") * F.col("best") + F.col("others") >= F.col("floor")))
        return hopeful.select("query", "weight", "essential", F.inline("docs")).select("query", "doc", (F.col("weight") * F.col("impact")).alias("part"), "essential")

    def weighed(self, queries: DataFrame, k: int, prune: bool = True) -> DataFrame:
        """The queries' terms with what decides which blocks are read: ``others``, ``floor`` and ``essential``."""
        terms = self._terms(queries)
        free = terms.withColumns({"others": F.lit(0.0), "floor": F.lit(None).cast("double"), "essential": F.lit(True)})
        if not prune:
            return free
        ahead = W.partitionBy("query").orderBy(F.desc("bound"), "term")
        seeds = free.withColumn("turn", F.row_number().over(ahead)).where(F.col("turn") <= _SEEDS).drop("turn")
        partial = self._matches(seeds).groupBy("query", "doc").agg(F.sum("part").alias("score"))
        kth = partial.withColumn("turn", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doc"))).where(F.col("turn") == k)
        # a hair lower, for the rounding of scores and of sums
        floors = kth.select("query", (F.col("score") - 2 * 10.0**-DIGITS).alias("floor"))
        whole = terms.groupBy("query").agg(F.sum("bound").alias("whole"), F.min("weight").alias("least"))
        floors = whole.join(floors, "query", "left").select("query", "whole", F.when(F.col("least") >= 0, F.col("floor")).alias("floor"))
        below = F.sum("bound").over(W.partitionBy("query").orderBy("bound", "term").rowsBetween(W.unboundedPreceding, 0))
        judged = terms.join(small(written(floors, new_folder(self.spark, "floors"))), "query")
        judged = judged.withColumns({"others": F.col("whole") - F.col("bound"), "essential": F.col("floor").isNull() | (below >= F.col("floor"))})
        return written(judged.drop("whole"), new_folder(self.spark, "judged"))

    def hits(self, terms: DataFrame) -> DataFrame:
        """(query, doc, part) of what ``weighed`` terms leave to be summed."""
        found = self._matches(terms.where("essential")).drop("essential")
        rest = terms.where("not essential")
        if rest.isEmpty():
            return found
        # documents that have an essential term; a frequent term's other documents go before the shuffle where they are few
        candidates = written(found.select("query", "doc").distinct(), new_folder(self.spark, "candidates"))
        return found.unionByName(self._matches(rest).drop("essential").join(small(candidates), ["query", "doc"], "left_semi"))

    def search(self, queries: DataFrame, k: int = 10, prune: bool = True) -> DataFrame:
        """(query, doc, score, rank): what ``bm25`` finds in the texts."""
        terms = self.weighed(queries, k, prune)
        scored = self.hits(terms).groupBy("query", "doc").agg(F.round(F.sum("part"), DIGITS).alias("score"))
        if self.analyzer.kind == "char":
            return top(scored.where("score > 0"), k)
        scored = written(scored, new_folder(self.spark, "scored"))
        return filled(self._read("lengths"), queries, scored, k)
