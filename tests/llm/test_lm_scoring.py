import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import SCHEMA, odd_documents, prose, rows
from lexmill.llm import lm_scoring
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return [w.lower() for w in WORD.findall((text or "").encode())] + [None]


def grams(text, k, order):
    padded = ["<"] * (order - 1) + tokens(text)
    return [tuple(padded[i - k + 1 : i + 1]) for i in range(order - 1, len(padded))]


class Plain:
    """The same model with dictionaries; weights are given."""

    def __init__(self, texts, order):
        self.order, self.texts = order, len(texts)
        self.counts = [Counter(g for t in texts for g in grams(t, k, order)) for k in range(1, order + 1)]
        self.tokens, self.vocabulary = sum(self.counts[0].values()), len(self.counts[0])

    def context(self, gram):
        shorter = gram[:-1]
        return self.texts if set(shorter) == {"<"} else self.counts[len(shorter) - 1][shorter]

    def parts(self, text):
        """(bucket, estimates from order 0) of each token."""
        for window in zip(*(grams(text, k, self.order) for k in range(1, self.order + 1))):
            bucket, p = 0, [1 / (self.vocabulary + 1), self.counts[0][window[0]] / max(1, self.tokens)]
            for k, gram in enumerate(window[1:], 2):
                ctx = self.context(gram)
                p.append(self.counts[k - 1][gram] / ctx if ctx else 0.0)
                if ctx:
                    bucket = 1 + (k - 2) * lm_scoring._LEVELS + min(int(math.log2(ctx)), lm_scoring._LEVELS - 1)
            usable = [True, self.tokens > 0, *(self.context(g) > 0 for g in window[1:])]
            yield bucket, np.array(p), np.array(usable)

    def score(self, text, weights):
        return sum(math.log10((weights[b] * p).sum() / (weights[b] * u).sum()) for b, p, u in self.parts(text))

    def base(self, text):
        return sum(math.log10((self.counts[0][g] + 1) / (self.tokens + self.vocabulary + 1)) for g in grams(text, 1, self.order))


def corpus(spark):
    texts = [prose(i % 40, 30 + i) + f" only{i}" for i in range(160)]
    return spark.createDataFrame(rows(texts) + [(1000 + (d[0] or 50), *d[1:]) for d in odd_documents()] + [(None, "a null id", None, None, None)], SCHEMA)


def learnt_from(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 != 2


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order):
    docs = corpus(spark)
    model = lm_scoring.DeletedInterpolation(docs, trains=lm_scoring._learnt_from, order=order, block_bytes=20_000)
    got = sorted(model.scores().collect(), key=str)
    all_rows = [(r.doc_id, r.text) for r in docs.collect()]
    plain = Plain([t for i, t in all_rows if learnt_from(i)], order)
    want = sorted(((i, len(tokens(t)), sum(plain.counts[0][g] > 0 for g in grams(t, 1, order)), plain.base(t), plain.score(t, model.weights)) for i, t in all_rows), key=lambda r: (str(r[0]), r[3]))
    got = sorted(((r.id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=lambda r: (str(r[0]), r[3]))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want):
        assert g[3:] == pytest.approx(w[3:], rel=1e-9)
    assert (model.tokens, model.vocabulary, model.texts) == (plain.tokens, plain.vocabulary, plain.texts)


def test_weights_are_those_of_expectation_maximisation(spark):
    docs = corpus(spark)
    model = lm_scoring.DeletedInterpolation(docs, trains=lm_scoring._learnt_from, order=2, block_bytes=20_000, held_part=4)
    marked = model.rows.where("train").select((F.col("block") >= model.blocks).alias("gone"), "text").collect()
    kept, gone = [r.text for r in marked if not r.gone], [r.text for r in marked if r.gone]
    assert len(kept) == model.kept_texts and 20 < len(gone) < 80
    plain = Plain(kept, 2)
    plain.vocabulary = model.vocabulary
    parts = [part for text in gone for part in plain.parts(text)]
    weights, before = np.full(model.weights.shape, 1 / 3), -math.inf
    for _ in range(12):
        sums, told = np.zeros_like(weights), 0.0
        for b, p, _ in parts:
            joint = weights[b] * p
            sums[b] += joint / joint.sum()
            told += math.log(joint.sum())
        seen = sums.sum(1, keepdims=True)
        weights = np.where(seen > 0, sums / np.maximum(seen, 1e-300), weights)
        weights = (weights + 1e-6) / (1 + 3e-6)
        if told - before < 1e-4 * abs(told):
            break
        before = told
    assert model.weights == pytest.approx(weights, abs=1e-9)
    assert model.weights.sum(1) == pytest.approx(1)


def test_probabilities_sum_to_one(spark):
    docs = corpus(spark)
    model = lm_scoring.DeletedInterpolation(docs, order=2, block_bytes=50_000)
    plain = Plain([r.text for r in docs.collect()], 2)
    for before in ("<", tokens(prose(3, 5))[0], b"never-met"):
        total = 0.0
        ctx = plain.texts if before == "<" else plain.counts[0][(before,)]
        bucket = 1 + min(int(math.log2(ctx)), lm_scoring._LEVELS - 1) if ctx else 0
        w = model.weights[bucket] * np.array([1, 1, ctx > 0])
        for (word,) in [*plain.counts[0], ("unknown",)]:
            p = np.array([1 / (plain.vocabulary + 1), plain.counts[0][(word,)] / plain.tokens, plain.counts[1][(before, word)] / ctx if ctx else 0])
            total += (w * p).sum() / w.sum()
        assert total == pytest.approx(1)


def test_repeats_of_the_training_text_score_above_the_base(spark):
    docs = corpus(spark)
    got = lm_scoring.DeletedInterpolation(docs, trains=lm_scoring._learnt_from).scores().where("n_tokens > 40").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.id: r for r in lm_scoring.DeletedInterpolation(docs, trains=lambda _: F.lit(False)).scores().collect()}
    assert {i: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for i, r in got.items()} == {1: (3, 0, 0, 0.0, 0.0), 2: (1, 0, 0, 0.0, 0.0)}
    assert lm_scoring.DeletedInterpolation(docs.limit(0)).scores().collect() == []


def test_other_columns_are_ignored_and_dealing_does_not_matter(spark):
    docs = corpus(spark).select("doc_id", "text", F.lit(1).alias("block"), F.lit("x").alias("train"), F.lit("y").alias("id"), F.lit(3).alias("k"))
    small, large = (sorted(lm_scoring.DeletedInterpolation(d, block_bytes=b).scores().collect(), key=str) for d, b in ((docs, 10_000), (docs.repartition(7), 10_000)))
    assert [(r.id, round(r.score, 9)) for r in small] == [(r.id, round(r.score, 9)) for r in large]
