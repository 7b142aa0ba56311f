"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 16 bytes cuts a text where its top bits are zero, so cuts follow the
content and an insertion moves only the chunks around it.  Where 64 bytes have no such place, the one with the
smallest hash is cut, which follows the content too: periodic text has its cuts in the same phase wherever it
stands.  Chunks have 16 to 64 bytes, about 30 on average, so that a passage of 50 words holds several.  A chunk
repeats if its digest occurs before, in the order (doc_id, row, position); adjacent repeated chunks form a span.
Spans of at least ``min_chars`` characters are removed, and texts that are one span as a whole, however short.
Other shorter repeats are phrases that texts share by chance.

A task holds the smallest occurrence of each digest that it meets, up to ``_HELD`` digests at a time;
any other is settled there and then, in whatever order rows come.  Only the smallest go by digest, so a
line that a third of the corpus holds sends a few rows for each task; settled ones go by row.  A digest's
occurrences are then read in order from a sorted stream, never held.  The result does not depend on how
rows are dealt.

Rows with equal id and text are one document (their spans are the same).  Null and empty texts have
no chunks; null ids are allowed and come first; an empty table gives an empty result; other columns
are never read.  Offsets are code points, end exclusive; cuts never fall inside a character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import bounded_batches, table
from .textkit import text_bytes

_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) & 0xFFFF for b in range(256)], np.uint16)
_LEAST, _MOST = 16, 64
_LAST = 1 << 11  # beside a chunk's length: it ends its text
_TOP = np.uint16(16 - 4)  # 4 top bits: a cut in 16 positions
_HELD = 600_000
_NULL = -(1 << 63)


def cut_points(data: bytes) -> list[int]:
    """Byte offsets of the chunk ends; the last is the text's end."""
    raw = np.frombuffer(data, np.uint8)
    rolled = _GEAR[raw]
    for shift in (1, 2, 4, 8):  # doubles the window: sum of gear[byte j back] << j
        rolled[shift:] = rolled[shift:] + (rolled[:-shift] << np.uint16(shift))
    ends, last = [], 0
    for at in [*((rolled >> _TOP == 0).nonzero()[0] + 1).tolist(), len(data)]:
        while at - last > _MOST:
            last += _LEAST + int(rolled[last + _LEAST - 1 : last + _MOST].argmin())
            ends.append(last)
        if at - last >= _LEAST and at < len(data):
            ends.append(last := at)
    if last < len(data):
        ends.append(len(data))
    if not data.isascii():  # to the start of the next character
        starts = np.r_[((raw & 0xC0) != 0x80).nonzero()[0], len(data)]
        ends = np.unique(starts[np.searchsorted(starts, ends)]).tolist()
    return ends


def chunks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, start, end) of each chunk, in code points."""
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    ends = cut_points(data)
    digest = xxhash.xxh3_64_intdigest
    starts = [0, *ends[:-1]]
    names = np.array([digest(data[a:b]) for a, b in zip(starts, ends)], np.uint64).view(np.int64)
    ends, starts = np.array(ends), np.array(starts)
    if not data.isascii():
        points = np.r_[0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)]
        starts, ends = points[starts], points[ends]
    return names, starts.astype(np.int64), ends.astype(np.int64)


_CHUNK = "digest long, id long, row long, at long, settled boolean"


def _occurrences(docs: DataFrame) -> DataFrame:
    """A row for each chunk; settled ones follow an occurrence of the same task."""

    def run(batches):
        least: dict[int, tuple[int, int, int]] = {}  # digest -> smallest (id, row, at) so far; null ids come first
        settled: list[tuple[int, int, int, int]] = []
        for batch in batches:
            for row, doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                names, starts, ends = chunks(data)
                own = _NULL if doc_id is None else doc_id
                places = (starts << 12) | (ends - starts)
                places[-1:] |= _LAST
                for name, at in zip(names.tolist(), places.tolist()):
                    now = (own, row, at)
                    known = least.get(name)
                    if known is None:
                        least[name] = now
                    elif now > known:
                        settled.append((name, *now))
                    elif now < known:
                        least[name] = now
                        settled.append((name, *known))
                if len(settled) >= 100_000:
                    yield _occurrence_batch(settled, True)
                    settled = []
                if len(least) >= _HELD:
                    yield from _smallest(least)
                    least.clear()
        if settled:
            yield _occurrence_batch(settled, True)
        yield from _smallest(least)

    return docs.mapInArrow(run, _CHUNK)


def _smallest(least: dict):
    found = [(name, *where) for name, where in least.items()]
    for i in range(0, len(found), 100_000):
        yield _occurrence_batch(found[i : i + 100_000], False)


def _occurrence_batch(rows: list[tuple[int, int, int, int]], settled: bool) -> pa.RecordBatch:
    digest, ids, row, at = np.array(rows, np.int64).reshape(-1, 4).T
    return pa.RecordBatch.from_arrays(
        [pa.array(digest), pa.array(ids, mask=ids == _NULL), pa.array(row), pa.array(at), pa.array(np.full(len(rows), settled))],
        names=["digest", "id", "row", "at", "settled"],
    )


def _repeats(occurrences: DataFrame) -> DataFrame:
    """(row, id, at) of each occurrence that follows another of its digest.

    Settled ones are dealt by row, so that a frequent digest's don't meet.
    """

    def run(batches):
        last = None  # digest, and the row and place of its first occurrence
        for batch in batches:
            settled = batch.column("settled")
            if settled.true_count:  # known already, and sorted behind all others
                yield batch.filter(settled).select(["row", "id", "at"])
                batch = batch.filter(pc.invert(settled))
            digest, row, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("digest", "row", "at"))
            if not len(digest):
                continue
            fresh = np.r_[last is None or last[0] != digest[0], digest[1:] != digest[:-1]]
            lead = np.maximum.accumulate(np.where(fresh, np.arange(len(digest)), -1))
            first_row, first_at = row[lead], at[lead]
            if (inside := lead < 0).any():  # the batch begins inside the last run
                first_row[inside], first_at[inside] = last[1:]
            repeated = ~fresh & ~((row == first_row) & (at == first_at))
            last = digest[-1], first_row[-1], first_at[-1]
            if repeated.any():
                yield batch.filter(pa.array(repeated)).select(["row", "id", "at"])

    ready = occurrences.repartition(F.when(F.col("settled"), F.col("row")).otherwise(F.col("digest"))).sortWithinPartitions("settled", "digest", F.asc_nulls_first("id"), "row", "at")
    return ready.select("row", "id", "at", "digest", "settled").mapInArrow(run, "row long, id long, at long")


def _spans(repeats: DataFrame, min_chars: int) -> DataFrame:
    """Adjacent repeated chunks of a row become a span; short ones are left alone unless they are the whole text."""

    def run(batches):
        now, whole = None, False  # row, id, start, end, chunks; whether it ends its text
        out: list[tuple] = []

        def close():
            if now is not None and (now[3] - now[2] >= min_chars or (whole and now[2] == 0)):
                out.append(now)

        for batch in batches:
            for row, doc_id, at in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "at"))):
                start, end = at >> 12, (at >> 12) + (at & (_LAST - 1))
                if now is not None and row == now[0] and start <= now[3]:
                    if end > now[3]:
                        now, whole = (*now[:3], end, now[4] + 1), bool(at & _LAST)
                else:
                    close()
                    now, whole = (row, doc_id, start, end, 1), bool(at & _LAST)
            if out:
                yield _span_batch(out)
                out.clear()
        close()
        if out:
            yield _span_batch(out)

    return repeats.repartition("row").sortWithinPartitions("row", "at").mapInArrow(run, _SPAN)


_SPAN = "row long, id long, start long, end long, n_chunks long"


def _span_batch(spans: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*spans)], names=["row", "id", "start", "end", "n_chunks"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return docs.select(F.xxhash64("id", "text").alias("row"), "id", "text")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 100) -> DataFrame:
    """``row`` (hash of id and text), ``id``, ``start``, ``end`` and ``n_chunks`` of each removed span."""
    bounded_batches(docs.sparkSession)
    return _spans(_repeats(_occurrences(_keyed(docs, id_col, text_col))), min_chars)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 100) -> DataFrame:
    """``id`` and ``text`` of each row with its repeated spans removed."""
    spans = repeated_spans(docs, id_col, text_col, min_chars).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))

    def run(batches):
        for batch in batches:
            texts = []
            for text, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if text is not None and cut:
                    ends = [0, *(s["end"] for s in cut)]
                    text = "".join(text[a:b] for a, b in zip(ends, [*(s["start"] for s in cut), len(text)]))
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return _keyed(docs, id_col, text_col).join(spans, "row", "left").select("id", "text", "spans").mapInArrow(run, "id long, text string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = repeated_spans(table(spark, sf_dir, "documents"))
    return spans.select(F.col("id").alias("doc_id"), "start", "end", "n_chunks").distinct()
