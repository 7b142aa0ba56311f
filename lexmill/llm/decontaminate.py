"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A test item is the set of its five-word shingles (a shorter item is one shingle of all its words); a
document contains it when at least 0.8 of the item's shingles are among the document's.

A MinHash signature of a whole document meets a short item's with probability |item| / |document|,
which loses items in long documents.  Containment needs only the item's side: its k smallest hashes
are tested against all shingles of the document.  Items are partitioned by size (powers of two).  Each
partition has its own table of keys, takes k = u - ceil(0.8 u) + 1 for its largest size u, and is
searched only for documents with at least 0.8 of its smallest size: a document that has 0.8 of the item
must have one of those k, so the search loses nothing at any document length.  Candidates are verified
by exact shingle containment in the same pass, so no document is shuffled and an item that a third of
the corpus holds costs no task more than another.

The items are a stated query set: they are searched in blocks of at most ``block_shingles``, each a
broadcast of bounded size; where there are several, a block's result is written and its broadcast freed
before the next.  Items and texts that are null or without words match nothing; repeated
items and documents are matched row by row; empty tables give an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import Shelf, bounded_batches, table
from .textkit import SHINGLE_WORDS, distinct, ngram_hashes, shingle_set, text_bytes, word_hashes

_SIEVE = 1 << 20


class Partition:
    """Items of one size class: their bottom-k hashes, sorted, and whose they are."""

    def __init__(self, sets: list[tuple[int, np.ndarray]], largest: int, percent: int):
        k = largest - (percent * largest + 99) // 100 + 1
        smallest = min(len(s) for _, s in sets)
        self.least = (percent * smallest + 99) // 100
        keys = np.concatenate([s[:k] for _, s in sets])
        owners = np.concatenate([np.full(len(s[:k]), item) for item, s in sets])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]

    def candidates(self, near: np.ndarray) -> set[int]:
        low, high = np.searchsorted(self.keys, near, "left"), np.searchsorted(self.keys, near, "right")
        return {int(o) for a, b in zip(low[high > low], high[high > low]) for o in self.owners[a:b]}


class ItemSketches:
    """The partitions of a block of items, and the items' shingles for the exact check."""

    def __init__(self, items: list[tuple[int, bytes]], percent: int):
        self.percent = percent
        self.ids, self.shingles, self.lengths = [], [], set()
        classes: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text in items:
            words = word_hashes(text)
            s = shingle_set(words)
            if len(s):
                self.lengths.add(min(len(words), SHINGLE_WORDS))
                classes.setdefault(1 << (len(s) - 1).bit_length(), []).append((len(self.ids), s))
                self.ids.append(item_id)
                self.shingles.append(s)
        self.partitions = [Partition(sets, largest, percent) for largest, sets in sorted(classes.items())]
        self.sieve = np.zeros(_SIEVE, bool)
        for p in self.partitions:
            self.sieve[p.keys >> np.uint64(44)] = True

    def found(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, shared, item size) for each item that the document holds."""
        grams = [ngram_hashes(words, n) for n in sorted(self.lengths)]
        s = distinct(np.concatenate(grams)) if grams else np.empty(0, np.uint64)
        near = s[self.sieve[s >> np.uint64(44)]]
        for item in sorted(set().union(*(p.candidates(near) for p in self.partitions if p.least <= len(s)))) if len(near) else ():
            own = self.shingles[item]
            at = np.searchsorted(s, own)
            shared = int((s[np.minimum(at, len(s) - 1)] == own).sum())
            if 100 * shared >= self.percent * len(own):
                yield self.ids[item], shared, len(own)


def _blocks(items: DataFrame, id_col: str, text_col: str, block_shingles: int) -> Iterator[list[tuple[int, bytes]]]:
    block, size = [], 0
    for row in items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).toLocalIterator():
        text = bytes(row.text or b"")
        block.append((row.id, text))
        size += len(text.split()) + 1
        if size >= block_shingles:
            yield block
            block, size = [], 0
    if block:
        yield block


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    percent: int = 80,
    block_shingles: int = 500_000,
) -> DataFrame:
    """(id, item_id, n_shared, n_item) for each document and each item it contains."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    schema = "id long, item_id long, n_shared long, n_item long"
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def search(sketches):
        def run(batches):
            block = sketches.value
            for batch in batches:
                out = [(i, *hit) for i, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))) for hit in block.found(word_hashes(text))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["id", "item_id", "n_shared", "n_item"])

        return docs.mapInArrow(run, schema)

    return _by_block(spark, _blocks(items, item_col, item_text_col, block_shingles), percent, lambda found, sketches: search(sketches) if found is None else found.unionByName(search(sketches)), spark.createDataFrame([], schema))


def _by_block(spark: SparkSession, blocks: Iterator[list], percent: int, step, empty: DataFrame) -> DataFrame:
    """``step(so far, broadcast block)`` for all blocks; all but the last block's results are written."""
    shelf, done, turn = Shelf(spark), None, 0
    shared = None
    for block in blocks:
        if shared is not None:
            done = shelf.put(done, f"block_{turn}")
            shelf.drop(f"block_{turn - 1}")
            shared.destroy()
            turn += 1
        shared = spark.sparkContext.broadcast(ItemSketches(block, percent))
        done = step(done, shared)
    return done if done is not None else empty


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = 80, block_shingles: int = 500_000) -> DataFrame:
    """The rows of ``docs`` that contain none of the items, in the search pass itself."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def keep(found, shared):
        found = docs if found is None else found

        def run(batches):
            sketches = shared.value
            for batch in batches:
                yield batch.filter(pa.array([next(sketches.found(word_hashes(text)), None) is None for text in text_bytes(batch.column(at))], pa.bool_()))

        return found.mapInArrow(run, found.schema)

    return _by_block(docs.sparkSession, _blocks(items, item_col, item_text_col, block_shingles), percent, keep, docs)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


#: Fixed value: 80 percent of an item's shingles.
OP5_SQL = r"""
with item_words as (
  select item_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from benchmark),
items as (select *, least(5, len(w)) as n from item_words where len(w) > 0),
item_shingles as (
  select distinct item_id, r, n, array_to_string(w[k : k + n - 1], ' ') as s
  from (select *, unnest(range(1, len(w) - n + 2)) as k from items)),
sizes as (select r, count(*) as n_item from item_shingles group by r),
doc_words as (
  select doc_id, row_number() over () as d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
lengths as (select distinct n from items),
doc_shingles as (
  select distinct doc_id, d, n, array_to_string(w[k : k + n - 1], ' ') as s
  from (select *, unnest(range(1, greatest(len(w) - n + 2, 1))) as k from doc_words, lengths)),
hits as (select doc_id, d, item_id, r, count(*) as n_shared from doc_shingles join item_shingles using (n, s) group by all)
select doc_id, item_id, n_shared, n_item, n_shared / n_item::double as containment
from hits join sizes using (r) where 100 * n_shared >= 80 * n_item
"""
