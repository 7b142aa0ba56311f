"""A fixed-size array of counters, summed over a whole DataFrame without collecting rows.

Each task adds into its own array and emits it in blocks; blocks are summed in two salted rounds,
so no task receives more than a share of them.  What reaches the driver is the array: 16 MB at 2**22.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 1 << 22
_BLOCK = 1 << 14
_BITS = 1 << 17
BLOCK_SCHEMA = "block int, salt int, counts binary"


class Tally:
    """Counts slots; many small additions are made as a few large ones."""

    def __init__(self, size: int = SIZE):
        self.counts, self.held, self.n = np.zeros(size, np.uint32), [], 0

    def add(self, slots: np.ndarray) -> None:
        self.held.append(slots.astype(np.uint32))
        self.n += len(slots)
        if self.n > 1 << 20:
            self.total()

    def total(self) -> np.ndarray:
        if self.held:
            slots, times = np.unique(np.concatenate(self.held), return_counts=True)
            self.counts[slots] += times.astype(np.uint32)
            self.held, self.n = [], 0
        return self.counts


def block_rows(counts: np.ndarray, salt: int) -> Iterator[tuple[int, int, bytes]]:
    """Blocks that aren't all zero; the narrowest type that holds them."""
    for i in range(0, len(counts), _BLOCK):
        piece = counts[i : i + _BLOCK]
        if top := piece.max():
            yield i // _BLOCK, salt, _packed(piece, top)


def _packed(piece: np.ndarray, top: int) -> bytes:
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.int64
    return piece.astype(kind).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 8: np.int64}[len(raw) // _BLOCK])


def has(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots are set in the bits that ``marked`` gives."""
    slots = slots.astype(np.int64)
    return (bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1


def marked(slots: DataFrame, size: int) -> np.ndarray:
    """A frame of one int column of slots -> bits (packed, size / 8 bytes): which slots occur."""

    def mark(batches):
        seen = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            np.bitwise_or.at(seen, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        for i in range(0, size // 8, _BITS // 8):
            if (piece := seen[i : i + _BITS // 8]).any():
                yield _block_batch(i * 8 // _BITS, piece.tobytes())

    def union(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                bits = np.frombuffer(raw, np.uint8)
                held[block] = held[block] | bits if block in held else bits
        for block, bits in held.items():
            yield _block_batch(block, bits.tobytes())

    out = np.zeros(size // 8, np.uint8)
    once = slots.mapInArrow(mark, BLOCK_SCHEMA).withColumn("salt", F.spark_partition_id() % 8).repartition("block", "salt").mapInArrow(union, BLOCK_SCHEMA)
    for row in once.repartition("block").mapInArrow(union, BLOCK_SCHEMA).collect():
        out[row.block * _BITS // 8 : (row.block + 1) * _BITS // 8] = np.frombuffer(bytes(row.counts), np.uint8)
    return out


def _block_batch(block: int, raw: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "salt": pa.array([0], pa.int32()), "counts": pa.array([raw], pa.binary())})


def summed(blocks: DataFrame, size: int = SIZE, salts: int = 8) -> np.ndarray:
    """Rows of ``BLOCK_SCHEMA`` -> the summed array (int64), on the driver."""

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, salt, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "salt", "counts"))):
                if (block, salt) in sums:
                    sums[block, salt] += _unpacked(raw)
                else:
                    sums[block, salt] = _unpacked(raw).astype(np.int64)
        for (block, salt), values in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "salt": pa.array([salt], pa.int32()), "counts": pa.array([_packed(values, values.max())], pa.binary())})

    once = blocks.withColumn("salt", F.col("salt") % salts).repartition("block", "salt").mapInArrow(add, BLOCK_SCHEMA)
    twice = once.withColumn("salt", F.lit(0)).repartition("block").mapInArrow(add, BLOCK_SCHEMA)
    out = np.zeros(size, np.int64)
    for row in twice.collect():
        out[row.block * _BLOCK : (row.block + 1) * _BLOCK] = _unpacked(bytes(row.counts))
    return out
