"""Fixed-window and sentence chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import numbered
from ..functions.tokens import words

_SENTENCE_END = r"(?<=[।.?!])(?U)[\s\x1c-\x1f]+"


def check(size: int, overlap: int) -> None:
    if overlap >= size:
        raise ValueError(f"chunk_overlap ({overlap}) must be less than chunk_size ({size})")


def _with_method(metadata: Column, method: str) -> Column:
    return F.map_concat(F.map_filter(metadata, lambda k, _: k != "chunk_method"), F.create_map(F.lit("chunk_method"), F.lit(method)))


def _finished(df: DataFrame, method: str) -> DataFrame:
    return df.select(
        numbered(F.col("doc_id"), "c", F.col("chunk_index")).alias("chunk_id"), "text", "doc_id", "source", F.col("chunk_index").cast("int").alias("chunk_index"),
        _with_method(F.col("metadata"), method).alias("metadata"),
    )


def _documents(docs: DataFrame) -> DataFrame:
    for name, empty in (("source", F.lit("")), ("metadata", F.create_map().cast("map<string,string>"))):
        if name not in docs.columns:
            docs = docs.withColumn(name, empty)
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.coalesce("source", F.lit("")).alias("source"), "metadata")


def fixed(docs: DataFrame, size: int = 256, overlap: int = 64) -> DataFrame:
    """Windows of ``size`` words, ``size - overlap`` apart.

    With n words the last window starts at the largest multiple of the step up to n - max(overlap, 1).
    """
    check(size, overlap)
    step = size - overlap
    d = _documents(docs).withColumn("w", words(F.col("text"))).where(F.size("w") > 0)
    last = F.greatest(F.floor((F.size("w") - max(overlap, 1)) / step), F.lit(0)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda j: F.array_join(F.slice("w", j * step + 1, F.lit(size)), " "))
    return _finished(d.select("doc_id", "source", "metadata", F.posexplode(windows).alias("chunk_index", "text")), "fixed")


def pack(sentences: list[list[str]], size: int, overlap: int, legacy_carry: bool = False) -> Iterator[list[str]]:
    """Greedy packing; a full chunk hands its last ``overlap`` words on.

    A sentence is never split.  With ``overlap`` 0 nothing is carried; ``legacy_carry`` then carries all.
    """
    held: list[str] = []
    for sentence in sentences:
        if held and len(held) + len(sentence) > size:
            yield held
            held = held[-overlap:] if overlap or legacy_carry else []
        held = held + sentence
    if held:
        yield held


def sentences(docs: DataFrame, size: int = 256, overlap: int = 64, legacy_carry: bool = False) -> DataFrame:
    """Sentences grouped up to ``size`` words.  The fold is sequential, so each text is folded in an Arrow worker."""
    check(size, overlap)
    d = _documents(docs).withColumn("s", F.filter(F.split("text", _SENTENCE_END), lambda s: F.size(words(s)) > 0))
    d = d.select("doc_id", "source", "metadata", F.transform("s", words).alias("s"))

    def fold(batches):
        for batch in batches:
            rows, at, text = [], [], []
            for i, own in enumerate(batch.column("s").to_pylist()):
                for k, chunk in enumerate(pack(own or [], size, overlap, legacy_carry)):
                    rows.append(i)
                    at.append(k)
                    text.append(" ".join(chunk))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("doc_id", "source", "metadata")), pa.array(at, pa.int32()), pa.array(text, pa.string())], names=["doc_id", "source", "metadata", "chunk_index", "text"])

    folded = d.mapInArrow(fold, "doc_id string, source string, metadata map<string,string>, chunk_index int, text string")
    return _finished(folded, "sentence")


def chunk(docs: DataFrame, method: str = "fixed", size: int = 256, overlap: int = 64) -> DataFrame:
    return sentences(docs, size, overlap) if method == "sentence" else fixed(docs, size, overlap)
