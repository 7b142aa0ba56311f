"""Evaluation of retrievers: one frame of runs, shared by metrics, details and error analysis."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tokens import words
from . import analysis, metrics, text_scan
from .retrievers import Retriever
from .sizes import small

_KEY_WORDS = 7
_SHORT_BLOCK = 1_000
_BEGINS = 10_000  # so many items with keys are looked for in one scan


def eval_set(pairs: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """Question pairs -> (queries, gold).  Queries are named by their position in ``order``.

    The window is over the questions of an evaluation, not over a corpus.
    """
    numbered = pairs.withColumn("n", F.row_number().over(W.orderBy(*order)) - 1).withColumn("query", metrics.query_ids("n"))
    return numbered.select("query", F.col("question").alias("text")), numbered.select("query", F.nullif("chunk_id", F.lit("")).alias("doc"))


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(query, doc) where the document holds the item's text, character for character.

    An item's first and last word may be parts of a document's words, all others are whole.  Items with nine
    words or more meet the documents by the seven words after the first; shorter ones have no such key and are
    looked for in blocks of ``_SHORT_BLOCK``, all of a block in one scan of the documents.  Then texts are
    compared.  Up to ``_BEGINS`` items with keys go to the documents; more meet them in a shuffle of keys.  An item
    without words is held by nothing; null texts hold nothing.

    docs: ``doc``, ``text``; items: ``query``, ``text``.
    """
    key = lambda w, at: F.array_join(F.slice(w, at, F.lit(_KEY_WORDS)), " ")
    sized = items.withColumn("w", words(F.col("text"))).where(F.size("w") > 0)
    q = sized.where(F.size("w") >= _KEY_WORDS + 2).select("query", F.col("text").alias("item"), key(F.col("w"), F.lit(2)).alias("key"))
    d = docs.where("text is not null").withColumn("w", words(F.col("text")))
    at = F.when(F.size("w") >= _KEY_WORDS, F.sequence(F.lit(1), F.size("w") - _KEY_WORDS + 1)).otherwise(F.array().cast("array<int>"))
    asked = q.limit(_BEGINS + 1).collect()
    if len(asked) <= _BEGINS:  # the text is at hand where it is compared: no document is shuffled
        found = _keyed(docs, asked, q.schema["query"].dataType.simpleString())
    else:
        keys = F.explode(F.array_distinct(F.transform(at, lambda i: key(F.col("w"), i)))).alias("key")
        held = d.select("doc", keys).join(small(q.select("key").distinct()), "key", "left_semi").join(small(q), "key").join(docs, "doc")
        found = held.where(F.contains("text", "item")).select("query", "doc")
    short, block = sized.where(F.size("w") < _KEY_WORDS + 2).select("query", "text"), []
    kind = short.schema["query"].dataType
    for row in short.toLocalIterator():
        block.append((row["query"], row["text"]))
        if len(block) == _SHORT_BLOCK:
            found, block = found.unionByName(_holding(docs, block, kind)), []
    return found.unionByName(_holding(docs, block, kind)) if block else found


def _keyed(docs: DataFrame, asked: list, kind: str) -> DataFrame:
    """(query, doc) of the items with a key, in one scan.

    Words of keys are numbers, and a sum of seven numbers says where a key may stand; there the text is compared.
    """
    parts = [r["key"].split() for r in asked]
    vocabulary = sorted({w for key in parts for w in key})
    number = {w: i + 1 for i, w in enumerate(vocabulary)}
    factors = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(_KEY_WORDS)], np.uint64)
    sums: dict[int, list[int]] = {}
    for i, key in enumerate(parts):
        sums.setdefault(int((np.array([number[w] for w in key], np.uint64) * factors).sum()), []).append(i)
    items = [(r["query"], r["item"]) for r in asked]
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, np.array(sorted(sums), np.uint64), sums, items))

    def scan(batches):
        vocabulary, sought, sums, items = shared.value
        known = pa.array(vocabulary, pa.string())
        for docs, texts in text_scan.parts_of(batches):
            words, row = text_scan.split_words(texts)
            here = pc.fill_null(pc.index_in(words, value_set=known.cast(words.type)), -1).to_numpy().astype(np.uint64) + np.uint64(1)
            n = max(0, len(here) - _KEY_WORDS + 1)
            total = np.zeros(n, np.uint64)
            for j, factor in enumerate(factors):
                total += here[j : j + n] * factor
            at = np.flatnonzero(np.isin(total, sought)) if len(sought) else np.empty(0, np.int64)
            out = []
            for r, value in sorted(set(zip(row[at].tolist(), total[at].tolist()))):
                text, doc = texts[r].as_py(), docs[r].as_py()
                out += [(items[i][0], doc) for i in sums[value] if items[i][1] in text]
            if out:
                yield pa.RecordBatch.from_pydict({"query": [q for q, _ in out], "doc": [d for _, d in out]})

    return docs.select("doc", "text").mapInArrow(scan, f"query {kind}, doc {dict(docs.dtypes)['doc']}")


def _holding(docs: DataFrame, block: list[tuple], kind) -> DataFrame:
    asked = F.array(*(F.struct(F.lit(query).cast(kind).alias("query"), F.lit(text).alias("item")) for query, text in block))
    held = F.filter(asked, lambda q: F.contains("text", q["item"]))
    return docs.where("text is not null").select("doc", F.inline(held)).select("query", "doc")


@dataclass
class Evaluation:
    runs: DataFrame
    gold: DataFrame
    queries: DataFrame
    k: int

    def metrics(self) -> DataFrame:
        return metrics.all_metrics(self.runs, self.gold, self.k)

    def per_query(self) -> DataFrame:
        return metrics.per_query(self.runs, self.gold, self.k).select("retriever", "query", "rr", "recall", "precision", "ndcg")

    def retrieved(self) -> DataFrame:
        """(retriever, query, question, gold_ids, retrieved): what each query found, best first."""
        found = F.sort_array(F.collect_list(F.struct("rank", F.col("doc").cast("string").alias("chunk_id"), "score"))).alias("retrieved")
        gold = self.gold.groupBy("query").agg(F.sort_array(F.collect_set(F.col("doc").cast("string"))).alias("gold_ids"))
        names = F.array(*(F.lit(r.retriever) for r in self.runs.select("retriever").distinct().collect())).cast("array<string>")
        asked = self.queries.select("query", F.col("text").alias("question")).join(gold, "query", "left").withColumn("retriever", F.explode(names))
        runs = self.runs.where(F.col("rank") <= self.k).groupBy("retriever", "query").agg(found)
        empty = F.array().cast("array<struct<rank:int,chunk_id:string,score:double>>")
        return asked.join(runs, ["retriever", "query"], "left").select("retriever", "query", "question", F.coalesce("gold_ids", F.array().cast("array<string>")).alias("gold_ids"), F.coalesce("retrieved", empty).alias("retrieved"))

    def run_of(self, retriever: str) -> DataFrame:
        return self.runs.where(F.col("retriever") == retriever).drop("retriever")

    def errors(self, sparse: str, dense: str) -> tuple[DataFrame, DataFrame]:
        """(cases, summary) of two retrievers."""
        a, b = self.run_of(sparse), self.run_of(dense)
        cases = analysis.cases(self.queries, a, b, self.gold, self.k)
        return cases, analysis.summary(self.queries, analysis.buckets(a, b, self.gold, self.k))

    def displacement(self, sparse: str, dense: str) -> DataFrame:
        return analysis.displacement(self.run_of(sparse), self.run_of(dense), self.gold, self.k)


def evaluate(retrievers: dict[str, Retriever], queries: DataFrame, gold: DataFrame, k: int = 10) -> Evaluation:
    """Each retriever runs once; its k rows a query are kept for everything that follows."""
    runs = [r.run(queries, k).select("query", "doc", "score", "rank").withColumn("retriever", F.lit(name)) for name, r in retrievers.items()]
    return Evaluation(reduce(DataFrame.unionByName, runs).persist(), gold, queries, k)
