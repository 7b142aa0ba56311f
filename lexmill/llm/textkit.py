"""Word splitting and 64-bit hashing shared by the operators that run in Python workers.

Words are the maximal runs outside 0x20 and 0x09-0x0D of the UTF-8 text; lower-casing touches A-Z
alone.  A word's hash is a polynomial of random values of its bytes, taken for all words of a text at
once from one prefix sum (arithmetic modulo 2**64, where an odd base has an inverse).  All n-gram
hashes are then NumPy arithmetic on the word hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE_WORDS = 5
_PIECE = 1 << 16
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x2545F4914F6CDD1D  # odd
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)
_LOWER_VALUES = _VALUES.copy()
_LOWER_VALUES[65:91] = _VALUES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``size`` of each."""
    global _powers
    if len(_powers[0]) < size:
        n = 1 << (size - 1).bit_length()
        made = []
        for base in (_BASE, _BASE_INVERSE):
            table = np.full(n, np.uint64(base))
            table[0] = 1
            made.append(np.multiply.accumulate(table))
        _powers = tuple(made)
    return _powers


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words start and end."""
    edges = np.diff(SPACE[raw], prepend=True, append=True).nonzero()[0]
    return edges[0::2], edges[1::2]


def _hashes(raw: np.ndarray, values: np.ndarray) -> np.ndarray:
    starts, ends = word_bounds(raw)
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes, lower: bool = True) -> np.ndarray:
    """A hash for each word, in text order."""
    values = _LOWER_VALUES if lower else _VALUES
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= 2 * _PIECE:
        return _hashes(raw, values)
    # long texts in pieces that end at white space, so that memory stays small
    found, at = [], 0
    gaps = SPACE[raw].nonzero()[0]
    while at < len(raw):
        i = int(np.searchsorted(gaps, at + _PIECE))
        end = int(gaps[i]) if i < len(gaps) else len(raw)
        found.append(_hashes(raw[at:end], values))
        at = end
    return np.concatenate(found)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each window of ``n`` words, in text order; none if there are fewer words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    folded = words[:count].copy()
    for i in range(1, n):
        folded *= _MULTIPLIER
        folded += words[i : i + count]
    return mix(folded + np.uint64(n))


def shingle_set(words: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct shingles; a shorter text is one shingle, a text without words none."""
    return distinct(ngram_hashes(words, min(n, len(words)) or n))


def set_digest(shingles: np.ndarray) -> int:
    """One signed 64-bit name for a shingle set."""
    value = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return value - (1 << 64) if value >> 63 else value


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]
