"""Toxicity by compression distance.

Three zstandard dictionaries are trained: one on ordinary text, two on passages of toxic text.  A text is cut
into windows; the bytes that a toxic dictionary saves on a window, against the ordinary one, say how toxic it
is.  A logistic calibration over a document's window savings gives its score, and its threshold the verdict.

Toxic documents are mostly ordinary text, and a dictionary trained on all of it holds what ordinary text holds
too.  So the toxic dictionaries are trained on the passages that set the toxic texts apart: the compressor works
by matches of bytes, so the evidence is counted in byte strings of ``GRAM`` bytes.

* *Telling* strings are in ``ratio`` times as many toxic as ordinary training texts, beyond chance
  (log-likelihood ratio of at least ``evidence``): words that ordinary text doesn't have.  Windows of
  ``windows[0]`` words.
* *Frequent* strings are not among those, but ``often`` times as frequent in toxic as in ordinary text, in
  ``least_texts`` toxic texts or more (a text counts a string four times at most): forms that ordinary text has
  now and then, as in the languages with few toxic examples.  Windows of ``windows[1]`` words.

Of each toxic text, the words that hold such a string, in text order, are a training sample.  A text that mostly
repeats the shingles of earlier ones doesn't train.  The compressors get the ordinary dictionary, the toxic ones
with theirs before it: on ordinary words all save the same.

Fitting is bounded: at most ``per_class`` labelled rows of each class with at most ``fit_chars``
characters, chosen by hash of the id; two thirds train the dictionaries, one third calibrates; of the
ordinary windows, the ``ordinary_windows`` with the lowest hash train.  Every text is scored whole.

Null and empty texts score as a text without savings.  Null ids and repeated rows are scored row by
row; without labelled rows of both classes every score is the share of class 1 (0.5 without labels);
an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labels import labelled_sample, rows_of
from .support import bounded_batches, held_out, table
from .textkit import shingle_set, text_bytes, word_bounds, word_hashes

GRAM = 6
_FEATURES = 14
_SEEN = 1 << 25
_PORTION = 1 << 19
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SIEVE_SHIFT = np.uint64(64 - 22)


@dataclass
class ToxicityModel:
    ordinary: bytes
    telling: bytes
    frequent: bytes
    windows: tuple[int, int]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.plain = model, _compressor(model.ordinary)
        self.sides = [(_compressor(toxic + model.ordinary), w) for toxic, w in zip((model.telling, model.frequent), model.windows)]

    def features(self, text: bytes) -> list[float]:
        """What the windows save with each toxic dictionary: the best, the three and six best, the share of the text, and how often."""
        words, out = text.lower().split(), []
        if not words:
            return [0.0] * _FEATURES
        plain = self.plain.compress
        for side, w in self.sides:
            toxic, saved, size = side.compress, [], 0
            for i in range(0, len(words), w):
                window = b" " + b" ".join(words[i : i + w]) + b" "
                saved.append(len(plain(window)) - len(toxic(window)))
                size += len(window)
            saved.sort(reverse=True)
            n = len(saved)
            out += [saved[0], sum(saved[:3]) / min(3, n), sum(saved[:6]) / 6, 100 * sum(s for s in saved if s > 0) / size, sum(s >= 2 for s in saved) / n, sum(s >= 4 for s in saved) / n, min(sum(s >= 3 for s in saved), 8)]
        return out

    def score(self, text: bytes) -> float:
        x = (np.array(self.features(text)) - self.model.mean) / self.model.scale
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.model.weights[0] + x @ self.model.weights[1:])))))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(compression_level=3, min_match=5, strategy=zstandard.STRATEGY_LAZY2, window_log=17, hash_log=14, chain_log=14, search_log=4, write_content_size=0)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings)


def _dictionary(size: int, samples: list[bytes], k: int) -> bytes:
    """Too little text to train on is itself the dictionary."""
    total = sum(map(len, samples))
    if not total:
        return b" " * 8
    samples = samples * max(1, -(-12 * size // total))
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:].ljust(8)


def _spaced(text: bytes) -> bytes:
    return b" " + b" ".join(text.split()) + b" "


def _grams(text: bytes) -> np.ndarray:
    """Each byte string of length GRAM as a number, in text order."""
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = max(0, len(raw) - GRAM + 1)
    packed = np.zeros(n, np.uint64)
    for j in range(GRAM):
        packed = (packed << np.uint64(8)) | raw[j : j + n]
    return packed


class _Among:
    """Which numbers are in a sorted set: a sieve first, then exactly."""

    def __init__(self, values: np.ndarray):
        self.values, self.sieve = values, np.zeros(1 << 22, bool)
        self.sieve[values * _SPREAD >> _SIEVE_SHIFT] = True

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        """Their positions."""
        at = self.sieve[numbers * _SPREAD >> _SIEVE_SHIFT].nonzero()[0]
        found = np.searchsorted(self.values, numbers[at])
        return at[self.values[np.minimum(found, len(self.values) - 1)] == numbers[at]] if len(self.values) else at[:0]


def _tally(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The sorted byte strings of the texts, the texts that hold each, its occurrences (four a text at most), and all occurrences.

    Portions of ``_PORTION`` strings are merged one after another: memory follows the distinct strings, not all.
    """
    grams, held, met, total = np.empty(0, np.uint64), np.empty(0), np.empty(0), 0
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for i, text in enumerate(texts):
        own, counts = np.unique(_grams(_spaced(text)), return_counts=True)
        waiting.append((own, np.minimum(counts, 4)))
        total += int(counts.sum())
        if i + 1 < len(texts) and sum(len(g) for g, _ in waiting) < _PORTION:
            continue
        fresh = np.concatenate([g for g, _ in waiting])
        every, at = np.unique(np.concatenate([grams, fresh]), return_inverse=True)
        held = np.bincount(at, np.r_[held, np.ones(len(fresh))], len(every))
        met = np.bincount(at, np.r_[met, np.concatenate([c for _, c in waiting])], len(every))
        grams, waiting = every, []
    return grams, held, met, total


def evident_grams(toxic: list[bytes], ordinary: list[bytes], ratio: float, evidence: float) -> np.ndarray:
    """The sorted byte strings that ``ratio`` and ``evidence`` ask for; counts are numbers of texts."""
    n1, n0 = len(toxic), len(ordinary)
    grams, c1, _, _ = _tally(toxic)
    grams, c1 = grams[c1 >= min(2, n1)], c1[c1 >= min(2, n1)]
    among, c0 = _Among(grams), np.zeros(len(grams))
    for text in ordinary:
        own = _grams(_spaced(text))
        c0[np.searchsorted(grams, np.unique(own[among(own)]))] += 1
    share = (c1 + c0) / (n1 + n0)
    told = 2 * (c1 * np.log(c1 / n1 / share) + c0 * np.log(np.maximum(c0, 1) / n0 / share))
    return grams[(c1 / n1 >= ratio * (c0 + 0.5) / (n0 + 1)) & (told >= (evidence if n1 >= 10 else 0.0))]


def frequent_grams(toxic: list[bytes], ordinary: list[bytes], often: float, least_texts: int) -> np.ndarray:
    """The sorted byte strings that are ``often`` times as frequent in toxic text; counts are occurrences, four a text at most."""
    every, texts, c1, n1 = _tally(toxic)
    kept = texts >= min(least_texts, len(toxic))
    every, c1 = every[kept], c1[kept]
    among, c0, n0 = _Among(every), np.zeros(len(every)), 0
    for text in ordinary:
        own = _grams(_spaced(text))
        n0 += len(own)
        np.add.at(c0, np.searchsorted(every, own[among(own)]), 1)
    return every[c1 / max(1, n1) >= often * (c0 + 0.5) / max(1, n0)]


def evident_windows(text: bytes, among: _Among) -> bytes:
    """The windows of one word, with the blanks around it, that hold an evident string; joined."""
    text = _spaced(text)
    starts, ends = word_bounds(np.frombuffer(text, np.uint8))
    at = among(_grams(text))
    word = np.searchsorted(starts - 1, at, "right") - 1
    kept = np.unique(word[at + GRAM <= ends[word] + 1])
    return _spaced(b" ".join(text[starts[i] : ends[i]] for i in kept))


def fit_texts(rows: list[tuple[bytes, int]], windows: tuple[int, int] = (12, 3), ratio: float = 20.0, evidence: float = 25.0, often: float = 12.0, least_texts: int = 4, ordinary_bytes: int = 4_096, telling_bytes: int = 1_024, frequent_bytes: int = 2_048, ordinary_windows: int = 60_000) -> ToxicityModel:
    """rows: distinct (text, label) in a fixed order, both labels present."""
    seen = np.zeros(_SEEN, bool)
    split: dict[int, list[bytes]] = {0: [], 1: []}
    for text, label in rows:
        slots = (shingle_set(word_hashes(text)) % np.uint64(_SEEN)).astype(np.int64)
        if 3 * seen[slots].sum() <= len(slots) or not split[label]:
            split[label].append(text.lower())
        seen[slots] = True
    train = {y: docs[: max(1, len(docs) * 2 // 3)] for y, docs in split.items()}
    held = {y: docs[len(train[y]) :] or train[y] for y, docs in split.items()}
    told = evident_grams(train[1], train[0], ratio, evidence)
    often_met = np.setdiff1d(frequent_grams(train[1], train[0], often, least_texts), told)
    toxic = []
    for grams, size, k in ((told, telling_bytes, 24), (often_met, frequent_bytes, 16)):
        among = _Among(grams)
        toxic.append(_dictionary(size, [w for text in train[1] if len(w := evident_windows(text, among)) >= 8], k))
    plain = {b" ".join(words[i : i + 10]) for words in map(bytes.split, train[0]) for i in range(0, len(words), 10)}
    ordinary = _dictionary(ordinary_bytes, sorted(plain, key=lambda w: (xxhash.xxh64_intdigest(w), w))[:ordinary_windows], 64)
    model = ToxicityModel(ordinary, *toxic, windows, np.zeros(_FEATURES), np.ones(_FEATURES), np.zeros(1 + _FEATURES))
    scorer = model.scorer()
    x = np.array([scorer.features(text) for y in (0, 1) for text in held[y]])
    y = np.r_[np.zeros(len(held[0])), np.ones(len(held[1]))]
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - model.mean) / model.scale]
    for _ in range(25):  # Newton steps of the ridge logistic calibration
        p = 1 / (1 + np.exp(-z @ model.weights))
        model.weights = model.weights + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1.0 * np.eye(1 + _FEATURES), z.T @ (y - p) - 1.0 * model.weights)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 4000, fit_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text", **options) -> ToxicityModel | float:
    sample = labelled_sample(labels, label, per_class, id_col)
    got = rows_of(docs, sample, id_col, text_col).where(F.col("text").isNotNull() & (F.length("text") <= fit_chars)).collect() if sample else []
    texts = {r.text.encode(): r.y for r in sorted(got, key=lambda r: r.y)}
    if len(set(texts.values())) < 2:
        return sum(r.y for r in got) / len(got) if got else 0.5
    return fit_texts(sorted(texts.items(), key=lambda r: xxhash.xxh64_intdigest(r[0])), **options)


def toxicity_scores(docs: DataFrame, model: ToxicityModel | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``score`` for each row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        scorer = None if isinstance(model, float) else model.scorer()
        for batch in batches:
            scores = [scorer.score(text) if scorer else model for text in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")


def without_toxic(docs: DataFrame, model: ToxicityModel | float, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, in the scoring pass itself."""
    bounded_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        model = shared.value
        scorer = None if isinstance(model, float) else model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([(scorer.score(text) if scorer else model) < threshold for text in text_bytes(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scores.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
