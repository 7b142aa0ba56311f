"""Quality rules: hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

Word unigrams and bigrams are hashed into a fixed number of buckets.  One pass counts the buckets over
all documents (raw) and over all trusted ones (target): labelled good and not held out.  A text's verdict
is the mean over its n-grams of log p_target - log p_raw; it is kept when that is at least ``threshold``,
a constant, so the same text always has the same verdict under the same counts.  Its value, -0.35 nats
an n-gram, lies between the labelled texts of either class: at sf0.1, of those that pass the base rule,
good ones have -0.245 or more and bad ones -0.467 or less.

Base counts come before the verdict: words are runs outside 0x20 and 0x09-0x0D.

Null and empty texts have no words and fail the base rule; null ids and repeated rows are treated row
by row; without trusted rows every ratio is 0 and the base rule decides; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizes import small
from . import counters
from .support import bounded_batches, held_out, table
from .textkit import SPACE, ngram_hashes, text_bytes, word_hashes

_BUCKETS = np.uint64((1 << 18) - 1)
_SYMBOLS = b"#*$%&|<>"
_WINDOW = 3


def _buckets(words: np.ndarray) -> np.ndarray:
    return np.concatenate([ngram_hashes(words, 1), ngram_hashes(words, 2)]) & _BUCKETS


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """``id`` of all rows labelled 1 that aren't held out."""
    return labels.where((F.col(label) == 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("long").alias("id")).distinct()


def ratio_table(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log p_target - log p_raw for each bucket (float32), with half a count of smoothing.

    trusted: distinct ``id``; broadcast while they are few (counted), else joined by a shuffle.
    """
    bounded_batches(docs.sparkSession)
    size = int(_BUCKETS) + 1

    def run(batches):
        raw, target = counters.Tally(size), counters.Tally(size)
        for batch in batches:
            for good, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                at = _buckets(word_hashes(text))
                raw.add(at)
                if good:
                    target.add(at)
        rows = list(counters.block_rows(np.concatenate([raw.total(), target.total()]), TaskContext.get().partitionId()))
        if rows:
            block, salt, counts = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(salt, pa.int32()), pa.array(counts, pa.binary())], names=["block", "salt", "counts"])

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(small(trusted.withColumn("good", F.lit(True))), "id", "left")
    blocks = named.select(F.coalesce("good", F.lit(False)).alias("good"), "text").mapInArrow(run, counters.BLOCK_SCHEMA)
    both = counters.summed(blocks, 2 * size)
    raw, target = both[:size] + 0.5, both[size:] + 0.5
    if not both[size:].any():
        return np.zeros(size, np.float32)
    return (np.log(target / target.sum()) - np.log(raw / raw.sum())).astype(np.float32)


def base_counts(text: bytes, words: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = np.frombuffer(text, np.uint8)
    chars = int((~SPACE[raw] & ((raw & 0xC0) != 0x80)).sum())
    seen, dup = set(), 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                dup += 1
            elif line.strip(b" \t\n\x0b\x0c\r"):
                seen.add(line)
    windows = ngram_hashes(words, _WINDOW)
    repeated = 0
    if len(windows) > 1:
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        twice = np.zeros(len(windows), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(words), bool)
        for i in range(_WINDOW):
            covered[i : i + len(windows)] |= twice
        repeated = int(covered.sum())
    return chars, len(text) - len(text.translate(None, _SYMBOLS)), dup, repeated


def rule_verdicts(docs: DataFrame, ratios: np.ndarray, threshold: float = -0.35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, the four base counts, base_failed, ratio and kept for each row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept"]

    def run(batches):
        table_ = shared.value
        for batch in batches:
            rows = []
            for text in text_bytes(batch.column(1)):
                words = word_hashes(text, lower=False)
                base = base_counts(text, words)
                at = _buckets(word_hashes(text))
                ratio = float(table_[at].mean(dtype=np.float64)) if len(at) else 0.0
                failed = len(words) < 50 or 100 * base[3] > 50 * len(words)
                rows.append((len(words), *base, failed, ratio, not failed and ratio >= threshold))
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    schema = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, kept boolean"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rule_verdicts(docs, ratio_table(docs, trusted_ids(table(spark, sf_dir, "labels")))).withColumnRenamed("id", "doc_id")
