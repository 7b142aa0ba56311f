"""Token counts from pre-token frequencies.

A byte-level BPE without normaliser maps each pre-token on its own, so a document's token count is
the sum over its pre-tokens of frequency times pieces.

1. The distinct pre-tokens of the corpus and how often they occur; a task sends each of its own once.
2. Pieces are counted once per distinct pre-token; this is the only place where the model runs.
3. Per document, pre-token frequencies are joined to the pieces.  Up to ``hot`` most frequent ones, and
   up to ``hot_long`` most frequent ones of over 64 bytes (those by their digest, whatever their length),
   are joined in the worker; the others become (document, pre-token, frequency) rows and meet the table
   of pieces in a shuffle join.  Both give exact sums, ids are never made.

The library's added special tokens are matched in the text first, one token each, as its default is.
Null and empty texts have no tokens; null ids and repeated rows are counted row by row; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import Shelf, table

#: Fixed value: the published pattern that byte-level BPE vocabularies of this family split text by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that all Unicode versions in use class alike; a text with others is split by the library itself.
_OTHERS = regex.compile(r"[^\u0000-\u0557\u0900-\u097f\u2010-\u2046\u20a0-\u20bf\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fcc\uac00-\ud7a3]")
_HELD = 300_000
_HOT_BYTES = 64


class PreTokens:
    """Splits a text as the tokenizer file says: special strings, then the pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level files without normaliser or prefix space are counted by pre-token")
        added = spec.get("added_tokens") or []
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that strip, normalise or need word bounds are not supported")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.path, self.library = path, None
        self.pattern = regex.compile(PATTERN)

    def find(self, text: str) -> list[str]:
        if text.isascii() or not _OTHERS.search(text):
            return self.pattern.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def of(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings."""
        if self.special is None or not (cuts := self.special.findall(text)):
            return self.find(text), 0
        return [p for part in self.special.split(text) for p in self.find(part)], len(cuts)


def _distinct(texts: DataFrame, path: str) -> DataFrame:
    def run(batches):
        pre, held = PreTokens(path), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(pre.of(text or "")[0])
                if len(held) > _HELD:
                    yield _counts(held)
                    held.clear()
        yield _counts(held)

    return texts.mapInArrow(run, "piece string, f long").groupBy("piece").agg(F.sum("f").alias("f"))


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["piece", "f"])


def _with_pieces(distinct: DataFrame, path: str) -> DataFrame:
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for batch in batches:
            words = batch.column(0).to_pylist()
            n = [len(e.ids) for e in tokenizer.encode_batch(words, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["piece", "f", "n"])

    return distinct.mapInArrow(run, "piece string, f long, n long")


def _per_document(docs: DataFrame, path: str, hot) -> DataFrame:
    schema = "row long, id long, n_bytes long, n_hot long, cold array<struct<piece: string, f: long>>"

    def run(batches):
        pre, (known, known_long) = PreTokens(path), hot.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, sizes, hots, colds = [], [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                words, n = pre.of(text)
                cold = []
                for word, f in Counter(words).items():
                    pieces = known.get(word)
                    if pieces is None and len(data := word.encode()) > _HOT_BYTES:
                        pieces = known_long.get(hashlib.md5(data).digest())
                    if pieces is None:
                        cold.append({"piece": word, "f": f})
                    else:
                        n += f * pieces
                rows.append(row)
                row += 1
                sizes.append(len(text.encode()))
                hots.append(n)
                colds.append(cold)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(hots, pa.int64()), pa.array(colds, pa.list_(pa.struct([("piece", pa.string()), ("f", pa.int64())])))],
                names=["row", "id", "n_bytes", "n_hot", "cold"],
            )

    return docs.mapInArrow(run, schema)


def _most_frequent(pieces: DataFrame, most: int) -> DataFrame:
    """The rows of highest ``f``, at most ``most``: whole classes of frequency, so nothing is sorted and a task sends only those."""
    classes = pieces.groupBy(F.floor(8 * F.log2("f")).alias("class")).agg(F.count("*").alias("rows"), F.min("f").alias("f"))
    taken, least = 0, None
    for found in sorted(classes.collect(), key=lambda c: -c["f"]):
        taken += found["rows"]
        if taken > most:
            break
        least = found["f"]
    return pieces.where(F.lit(False) if least is None else F.col("f") >= least)


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", hot: int = 100_000, hot_long: int = 10_000) -> DataFrame:
    """``id``, ``n_bytes`` and ``n_tokens`` for each row of ``docs``."""
    spark = docs.sparkSession
    shelf = Shelf(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = shelf.put(_with_pieces(_distinct(docs.select("text"), tokenizer_path), tokenizer_path), "pieces")
    long = F.octet_length("piece") > _HOT_BYTES
    frequent = _most_frequent(pieces.where(~long), hot).select("piece", "n").collect()
    digests = _most_frequent(pieces.where(long), hot_long).select(F.unhex(F.md5(F.col("piece").cast("binary"))).alias("digest"), "n").collect()
    known = spark.sparkContext.broadcast(({r.piece: r.n for r in frequent}, {bytes(r.digest): r.n for r in digests}))
    counted = shelf.put(_per_document(docs, tokenizer_path, known), "counted")
    cold = counted.select("row", F.inline("cold")).join(pieces.select("piece", "n"), "piece").groupBy("row").agg(F.sum(F.col("f") * F.col("n")).alias("n_cold"))
    return counted.select("row", "id", "n_bytes", "n_hot").join(cold, "row", "left").select("id", "n_bytes", (F.col("n_hot") + F.coalesce("n_cold", F.lit(0))).alias("n_tokens"))


def op10_token_counts(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    counts = token_counts(table(spark, sf_dir, "documents"), tokenizer_path)
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
