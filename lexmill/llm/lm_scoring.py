"""Language-model scores by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of all orders up to ``order`` with the
uniform one,

    P(w | h) = sum over k of weight[b][k] * c(h_k w) / c(h_k)  +  weight[b][0] / (V + 1),

where h_k is the k - 1 tokens before w and b the bucket of the context's frequency: the longest context
that training has met, and the logarithm of its count.  A bucket's weights sum to one and a bucket depends
on the context alone, so P sums to one over the V known tokens and one unknown.  Counts are taken from all
training texts.  The weights come from held-out counts: every ``held_part``-th training text (by hash) is
deleted from the counts, and expectation-maximisation fits the weights to its tokens; each step is a sum
over all of these texts in the cluster.

Counts and texts meet without a table of n-grams on any one machine:

1. Texts are dealt by hash into blocks of about ``block_bytes``; the deleted texts have blocks of their own.
2. A block sends its distinct n-grams, packed and sorted, to ranges of hashes, each once.  A range sums
   them and answers every block with the counts that it asked for.  Ranges grow in number with the text;
   a frequent n-gram is one entry a block, whoever holds it.
3. Texts and answers meet again by block, where the scores are taken.

Tokens are the words of a text, lower-cased in A-Z, and one end.  N-grams are told apart by 64-bit hashes.
Null and empty texts are one end token.  Null ids count as the empty id; repeated rows are scored, and
counted, row by row; an empty table gives an empty result; without training texts every count is 0 and a
token has the uniform probability 1 / (V + 1) = 1; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import Shelf, table
from .textkit import ngram_hashes, text_bytes, word_hashes

ORDER = 2
_BLOCK_BYTES = 8 << 20
_RANGE_BYTES = 16 << 20  # of text, for each range of hashes
_LEVELS = 24  # logarithms of a context's count
_BEGIN, _END = np.uint64(0x8F2D1B6A4C3E5971), np.uint64(0x1D4B7A9E6F8C2350)
_NO_BLOCK = -1
_ASKED = "k int, range int, block int, n int, grams binary, counts binary"
_ANSWER = "block int, k int, range int, n int, counts binary, deleted binary"
_TUPLES = "rows binary, times binary"


def _shrunk(values: np.ndarray, width: int = 8) -> bytes:
    """Unsigned numbers as byte planes, compressed: planes of zeros cost nothing."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())


def _grown(raw: bytes, n: int, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=max(1, n * width)), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(f"<u{width}").ravel()


def token_grams(texts: list[bytes], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Tokens of each text, and for each k the hash of the k-gram that ends at each token of all texts."""
    parts, sizes = [], []
    begin, end = np.full(order - 1, _BEGIN), np.array([_END])
    for text in texts:
        words = word_hashes(text)
        parts += [begin, words, end]
        sizes.append(len(words) + 1)
    sizes, padded = np.array(sizes, np.int64), np.concatenate(parts)
    real = np.ones(len(padded), bool)
    starts = np.cumsum(sizes + order - 1) - sizes - (order - 1)
    for j in range(order - 1):
        real[starts + j] = False
    # a k-gram that ends at a token never reaches before its text's begin marks
    at = real.nonzero()[0]
    return sizes, [ngram_hashes(padded, k)[at - k + 1] for k in range(1, order + 1)]


def _edges(ranges: int) -> np.ndarray:
    return np.array([(j << 64) // ranges for j in range(ranges)], np.uint64)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of one block after the other; they are sorted by their first column."""
    held, now = [], None
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        cuts = np.r_[0, (blocks[1:] != blocks[:-1]).nonzero()[0] + 1, len(blocks)] if len(blocks) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if now is not None and blocks[a] != now:
                yield now, held
                held = []
            now = int(blocks[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held


def bucket_of(contexts: list[np.ndarray]) -> np.ndarray:
    """Bucket of each token: contexts[k - 2] is the count of the context of order k."""
    out = np.zeros(len(contexts[0]) if contexts else 0, np.int64)
    for i, count in enumerate(contexts):  # a longer context that training has met takes over
        level = np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), _LEVELS - 1)
        out = np.where(count > 0, 1 + i * _LEVELS + level, out)
    return out


def _estimates(counts: list[np.ndarray], contexts: list[np.ndarray], tokens: int) -> np.ndarray:
    """A row for each order from 1: the maximum-likelihood estimate of each token."""
    of = [counts[0] / max(tokens, 1)]
    return np.array(of + [np.where(ctx > 0, c / np.maximum(ctx, 1), 0.0) for c, ctx in zip(counts[1:], contexts)])


class DeletedInterpolation:
    """Counts, weights and scores of a corpus; ``trains`` says of an id column which rows are learnt from."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trains: Callable[[Column], Column] | None = None, order: int = ORDER, held_part: int = 10, block_bytes: int = _BLOCK_BYTES, rounds: int = 12):
        self.order, self.shelf = order, Shelf(docs.sparkSession)
        doc_id, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.select(doc_id.cast("long").alias("id"), text.alias("text"), (trains or (lambda _: F.lit(True)))(doc_id).alias("train"))
        row = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
        size = row[0] + row[1]
        self.blocks, self.ranges = 1 + size // block_bytes, 1 + size // _RANGE_BYTES
        held_blocks = 1 + size // held_part // block_bytes
        # the deleted texts' blocks come after all others
        at, deleted = F.xxhash64("id", "text"), F.col("train") & (F.pmod(F.xxhash64("text", "id"), F.lit(held_part)) == 0)
        block = F.when(deleted, self.blocks + F.pmod(at, F.lit(held_blocks))).otherwise(F.pmod(at, F.lit(self.blocks)))
        self.rows = rows.withColumn("block", block.cast("int")).select("block", "id", "train", "text")
        self.parts = int(self.blocks + held_blocks)
        self.answers = self.shelf.put(self._counted(), "answers")
        told = self.answers.where(F.col("block") == _NO_BLOCK).select("k", "n", "counts").collect()
        figures = sum((_grown(bytes(r["counts"]), 3).astype(np.int64) for r in told), np.zeros(3, np.int64))
        self.tokens, self.kept_tokens, self.vocabulary = map(int, figures)
        texts = self.rows.agg(F.count(F.when(F.col("train"), 1)), F.count(F.when(F.col("train") & (F.col("block") < self.blocks), 1))).first()
        self.texts, self.kept_texts = texts[0], texts[1]
        self.weights = self._learnt(rounds)

    def _counted(self) -> DataFrame:
        """Answers to every block's n-grams, and the corpus figures of each range as the answer to block -1."""
        order, ranges, first_deleted = self.order, self.ranges, self.blocks

        def ask(batches):
            edges = _edges(ranges)
            for block, held in _by_block(batches):
                texts = [t for b in held for t in text_bytes(b.column("text"))]
                sizes, grams = token_grams(texts, order)
                train = np.repeat(np.concatenate([b.column("train").to_numpy(zero_copy_only=False) for b in held]), sizes)
                out = []
                for k, hashes in enumerate(grams, 1):
                    found, at = np.unique(hashes, return_inverse=True)
                    counts = np.bincount(at, train, len(found)).astype(np.uint64)
                    cuts = np.r_[np.searchsorted(found, edges), len(found)]
                    for r in range(ranges):
                        a, b = cuts[r], cuts[r + 1]
                        if b > a:
                            out.append((k, r, block, int(b - a), _shrunk(np.diff(found[a:b], prepend=np.uint64(0))), _shrunk(counts[a:b])))
                for i in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 64]), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["k", "range", "block", "n", "grams", "counts"])

        def answer(batches):
            def replies(k, r, asked):
                grams = [np.cumsum(_grown(raw, n)) for _, n, raw, _ in asked]
                counts = [_grown(raw, n).astype(np.int64) for _, n, _, raw in asked]
                found, at = np.unique(np.concatenate(grams), return_inverse=True)
                every, gone = np.concatenate(counts), np.repeat([block >= first_deleted for block, *_ in asked], [n for _, n, *_ in asked])
                total = np.bincount(at, every, len(found)).astype(np.uint64)
                kept = np.bincount(at, every * ~gone, len(found)).astype(np.uint64)
                if k == 1:
                    figures = np.array([total.sum(), kept.sum(), (total > 0).sum()], np.uint64)
                    yield _NO_BLOCK, k, r, 3, _shrunk(figures), None
                start = 0
                for block, n, *_ in asked:
                    own = at[start : start + n]
                    start += n
                    yield block, k, r, n, _shrunk(total[own]), _shrunk(kept[own]) if block >= first_deleted else None

            def written(rows):
                rows = list(rows)
                for i in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "k", "range", "n", "counts", "deleted"])

            asked, now = [], None
            for batch in batches:
                for k, r, block, n, grams, counts in zip(*(c.to_pylist() for c in batch.columns)):
                    if now is not None and now != (k, r):
                        yield from written(replies(*now, asked))
                        asked = []
                    now = k, r
                    asked.append((block, n, grams, counts))
            if asked:
                yield from written(replies(*now, asked))

        dealt = self.rows.select("block", "train", "text").repartition(self.parts, "block").sortWithinPartitions("block")
        asked = dealt.mapInArrow(ask, _ASKED).repartition(self.ranges * self.order, "k", "range").sortWithinPartitions("k", "range", "block")
        return asked.mapInArrow(answer, _ANSWER)

    def _met(self, deleted: bool, run, schema: str) -> DataFrame:
        """``run(ids, trains, sizes, counts)`` for each block of texts; counts[k - 1] are those of the k-grams that end at its tokens."""
        order = self.order

        def blocks(batches):
            for _, held in _by_block(batches):
                ids, texts, got = [], [], {k: [] for k in range(1, order + 1)}
                for batch in held:
                    real = np.array(batch.column("k").is_null())
                    own = batch.filter(pa.array(real))
                    ids += own.column("id").to_pylist()
                    texts += text_bytes(own.column("text"))
                    told = batch.filter(pa.array(~real))
                    for k, r, n, counts in zip(*(told.column(c).to_pylist() for c in ("k", "range", "n", "counts"))):
                        got[k].append((r, n, counts))
                if not texts:
                    continue
                sizes, grams = token_grams(texts, order)
                counts = []
                for k, hashes in enumerate(grams, 1):
                    found, at = np.unique(hashes, return_inverse=True)
                    known = np.concatenate([_grown(raw, n) for _, n, raw in sorted(got[k])]).astype(np.int64)
                    if len(known) != len(found):
                        raise RuntimeError(f"a block asked for {len(known)} n-grams and now has {len(found)}")
                    counts.append(known[at])
                yield from run(ids, sizes, counts)

        docs = self.rows.select("block", "id", "text", *(F.lit(None).cast(t).alias(c) for c, t in (("k", "int"), ("range", "int"), ("n", "int"), ("counts", "binary"))))
        told = self.answers.where(F.col("block") >= 0).select("block", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text"), "k", "range", "n", F.col("deleted" if deleted else "counts").alias("counts"))
        both = docs.unionByName(told)
        if deleted:
            both = both.where(F.col("block") >= self.blocks)
        return both.repartition(self.parts, "block").sortWithinPartitions("block").mapInArrow(blocks, schema)

    def _contexts(self, sizes: np.ndarray, counts: list[np.ndarray], texts: int) -> list[np.ndarray]:
        return contexts_of(sizes, counts, texts)

    def _learnt(self, rounds: int) -> np.ndarray:
        """(bucket, order from 0) weights by expectation-maximisation on the deleted texts."""
        order, kept_texts, kept_tokens = self.order, self.kept_texts, self.kept_tokens
        buckets, uniform = 1 + (order - 1) * _LEVELS, 1.0 / (self.vocabulary + 1)

        def tuples(ids, sizes, counts):
            contexts = contexts_of(sizes, counts, kept_texts)
            rows = np.array([bucket_of(contexts) if contexts else np.zeros(len(counts[0]), np.int64), *counts, *contexts]).T
            found, times = np.unique(rows, axis=0, return_counts=True)
            for i in range(0, len(found), 1 << 16):
                part = found[i : i + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"rows": pa.array([_shrunk(part.ravel())], pa.binary()), "times": pa.array([_shrunk(times[i : i + (1 << 16)])], pa.binary())}, schema=pa.schema([("rows", pa.binary()), ("times", pa.binary())]))

        held = self.shelf.put(self._met(True, tuples, _TUPLES), "deleted")
        weights, before = np.full((buckets, order + 1), 1.0 / (order + 1)), -np.inf
        for _ in range(rounds):

            def expect(batches, weights=weights):
                sums, told = np.zeros((buckets, order + 1)), 0.0
                for batch in batches:
                    for raw, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        # 65,536 rows at most; a row is the bucket, the counts and the contexts
                        times = np.frombuffer(zstandard.ZstdDecompressor().decompress(times), np.uint8)
                        n = len(times) // 8
                        times = np.ascontiguousarray(times.reshape(8, n).T).view("<u8").ravel()
                        rows = _grown(raw, n * 2 * order).reshape(n, 2 * order).astype(np.int64).T
                        p = np.vstack([np.full(n, uniform), _estimates(list(rows[1 : 1 + order]), list(rows[1 + order :]), kept_tokens)])
                        joint = weights[rows[0]].T * p
                        total = joint.sum(0)
                        for k in range(order + 1):
                            sums[:, k] += np.bincount(rows[0], times * joint[k] / total, buckets)
                        told += float((times * np.log(total)).sum())
                yield pa.RecordBatch.from_pydict({"sums": pa.array([sums.ravel()], pa.list_(pa.float64())), "told": pa.array([told])})

            got = sorted((r["told"], r["sums"]) for r in held.mapInArrow(expect, "sums array<double>, told double").collect())
            sums, told = sum((np.array(s) for _, s in got), np.zeros(weights.size)).reshape(weights.shape), sum(t for t, _ in got)
            # an empty bucket leans on the shorter estimates alone, as bucket 0 does
            seen = sums.sum(1, keepdims=True)
            weights = np.where(seen > 0, sums / np.maximum(seen, 1e-300), weights)
            floor = 1e-6  # no estimate is ruled out by the deleted texts alone
            weights = (weights + floor) / (1 + floor * (order + 1))
            if told - before < 1e-4 * abs(told):
                break
            before = told
        return weights

    def scores(self) -> DataFrame:
        """``id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (base-10 logarithms) for each row."""
        tokens, vocabulary, texts = self.tokens, self.vocabulary, self.texts
        weights, uniform = self.weights, 1.0 / (self.vocabulary + 1)

        def run(ids, sizes, counts):
            contexts = contexts_of(sizes, counts, texts)
            bucket = bucket_of(contexts) if contexts else np.zeros(len(counts[0]), np.int64)
            p = np.vstack([np.full(len(bucket), uniform), _estimates(counts, contexts, tokens)])
            # orders that a context can't serve hand their weight to the others
            usable = np.vstack([np.ones(len(bucket), bool), np.full(len(bucket), tokens > 0), *(c > 0 for c in contexts)])
            mixed = (weights[bucket].T * p).sum(0) / (weights[bucket].T * usable).sum(0)
            starts = np.cumsum(sizes) - sizes
            total = lambda values: np.add.reduceat(values, starts)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": pa.array(ids, pa.int64()),
                    "n_tokens": pa.array(sizes),
                    "n_known": pa.array(total((counts[0] > 0).astype(np.int64))),
                    "train_tokens": pa.array(np.full(len(ids), tokens)),
                    "base_score": pa.array(total(np.log10((counts[0] + 1) / (tokens + vocabulary + 1)))),
                    "score": pa.array(total(np.log10(mixed))),
                }
            )

        return self._met(False, run, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def contexts_of(sizes: np.ndarray, counts: list[np.ndarray], texts: int) -> list[np.ndarray]:
    """How often the context of each order from 2 occurs: the shorter n-gram one token before; at a text's start, the number of texts."""
    out, starts = [], np.cumsum(sizes) - sizes
    for shorter in counts[:-1]:
        before = np.r_[0, shorter[:-1]]
        before[starts] = texts
        out.append(before)
    return out


def _learnt_from(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 != 2


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = DeletedInterpolation(table(spark, sf_dir, "documents"), trains=_learnt_from).scores()
    return scores.select(F.col("id").alias("doc_id"), (~_learnt_from(F.col("id"))).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
