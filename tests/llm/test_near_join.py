import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from cases import SCHEMA, odd_documents, prose, rows
from lexmill.llm import near_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")


def shingles(text):
    w = WORD.findall(lowered(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_force(documents):
    """(id, size, class) of each row, by comparing all pairs."""
    sets = [shingles(t) for _, t, *_ in documents]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (doc_id, *_) in enumerate(documents):
        ids = [documents[j][0] for j in range(len(sets)) if find(j) == find(i) and documents[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus(n=160, seed=5):
    """Groups of near copies around the limit, chains, a passage that many share, short texts."""
    r = random.Random(seed)
    passage = prose(999, 40)
    texts = []
    for g in range(n // 8):
        words = prose(1000 + g, r.choice([6, 12, 60, 150])).split()
        if g % 3 == 0:
            words = passage.split() + words
        for _ in range(8):
            copy = list(words)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(["x", "Y", "zz"])
            texts.append(" ".join(copy))
    return rows(texts)


def classes(spark, documents, **options):
    got, _ = near_join.jaccard_classes(spark.createDataFrame(documents, SCHEMA), **options)
    return sorted(((r.id, r.n_shingles, r.component_id) for r in got.collect()), key=str)


def test_matches_brute_force_on_odd_documents(spark):
    documents = odd_documents()
    assert classes(spark, documents) == brute_force(documents)


@pytest.mark.parametrize("cell_elements", [8_000_000, 300])
def test_matches_brute_force_whole_or_in_tiles(spark, cell_elements):
    """Tiny tiles take the path of cells that are too large for one task."""
    documents = corpus()
    assert classes(spark, documents, cell_elements=cell_elements) == brute_force(documents)


def test_every_link(spark):
    documents = corpus(64, 8)
    _, links = near_join.jaccard_classes(spark.createDataFrame(documents, SCHEMA), every_link=True)
    _, tiled = near_join.jaccard_classes(spark.createDataFrame(documents, SCHEMA), every_link=True, cell_elements=300)
    sets = list({shingles(t) for _, t, *_ in documents})
    expected = sum(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    pairs = {tuple(sorted((r.a, r.b))) for r in links.collect()}
    assert len(pairs) == expected
    assert {tuple(sorted((r.a, r.b))) for r in tiled.collect()} == pairs


def test_one_of_each_keeps_one_row_of_a_class(spark):
    documents = odd_documents()
    kept = near_join.one_of_each(spark.createDataFrame(documents, SCHEMA)).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([0, 1, 2, 3, 4, 5, 8, 9, None], key=str)
    assert kept[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_clashing_columns_are_carried(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 7, 8), (2, "a b c d e f", 9, 10)], "doc_id long, text string, id long, digest long")
    assert [tuple(r) for r in near_join.one_of_each(docs).collect()] == [(1, "a b c d e f", 7, 8)]


def test_empty_table(spark):
    assert classes(spark, []) == []


def test_ranks_never_fall_and_filters_follow_their_members():
    counts = np.r_[np.arange(100), 2 ** np.arange(7, 62, dtype=np.int64)]
    ranks = near_join.rarity_ranks(counts).astype(int)
    assert (np.diff(ranks) > 0).all() and ranks[99] == 99
    assert [near_join._filter_bits(n) for n in (0, 10, 1 << 20, 1 << 40)] == [22, 22, 25, 28]


def test_one_of_each_bears_clashing_columns(spark):
    base = prose(1, 60)
    docs = spark.createDataFrame(rows([base, base, prose(2, 40), None, ""]), SCHEMA)
    for c in ("_th", "th", "class", "_n", "head", "_head_id", "rows", "id"):
        docs = docs.withColumn(c, F.lit(1))
    out = near_join.one_of_each(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 2, 3, 4]
