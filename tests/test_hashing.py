import hashlib
import math
from collections import Counter

import pytest

from lexmill.operators import hashing
from lexmill.operators.hashing import HashedWords
from lexmill.operators.retrievers import HASHED_WORDS, Dense

TEXTS = {1: "river delta farm river", 2: "delta music", 3: "boat song  river boat", 4: None, 5: " ", 6: "delta delta delta", 7: "उत्तर river"}


def vector(text, texts, dimensions):
    df = Counter(w for t in texts for w in set((t or "").split()))
    out = [0.0] * dimensions
    for word, tf in Counter((text or "").split()).items():
        digest = hashlib.md5(word.encode()).hexdigest()
        sign = 1 if int(digest[8:16], 16) % 2 == 0 else -1
        out[int(digest[:8], 16) % dimensions] += sign * (1 + math.log(tf)) * (math.log((len(texts) + 1) / (df[word] + 1)) + 1)
    size = math.sqrt(sum(x * x for x in out))
    return [round(x / size, 6) if size else 0.0 for x in out]


@pytest.mark.parametrize("common", [1_000, 2])
def test_vectors_equal_brute_force(spark, common, monkeypatch):
    """Whether most words count as common or none does."""
    monkeypatch.setattr("lexmill.operators.hashing._COMMON", common)
    docs = spark.createDataFrame(list(TEXTS.items()), "doc long, text string")
    queries = spark.createDataFrame([("a", "river unknown"), ("b", ""), ("c", "delta music")], "query string, text string")
    encoder = HashedWords.fit(docs, 16)
    for frame, key in ((docs, "doc"), (queries, "query")):
        given = {r[key]: r.text for r in frame.collect()}
        got = {r[key]: r.embedding for r in encoder.encode(frame, key).collect()}
        assert got == {k: pytest.approx(vector(t, TEXTS.values(), 16), abs=2e-6) for k, t in given.items()}


@pytest.mark.parametrize("index_type", ["flat", "ivf"])
def test_retriever_keeps_its_encoder(spark, tmp_path, index_type):
    chunks = spark.createDataFrame([(str(k), v) for k, v in TEXTS.items() if v], "chunk_id string, text string")
    made = Dense(HASHED_WORDS, index_type=index_type).index(chunks)
    made.save(f"{tmp_path}/i")
    loaded = Dense().load(spark, f"{tmp_path}/i")
    found, again = ([(r.chunk_id, r.score) for r in d.retrieve_one("boat song", 3).collect()] for d in (made, loaded))
    assert found[0][0] == "3" and found == again
    assert loaded.retrieve_one("boat", 1).first().metadata["model"] == "hashed-words"
    plan = made.run(spark.createDataFrame([("q", "boat")], "query string, text string"), 2)
    assert plan.count() == 2


def test_only_words_that_are_not_held_are_shuffled(spark, monkeypatch):
    """Each word of each document was shuffled four times."""
    kept, write = [], hashing.written
    monkeypatch.setattr(hashing, "written", lambda df, path: kept.append(write(df, path)) or kept[-1])
    monkeypatch.setattr(hashing, "_HELD", 2)
    docs = spark.createDataFrame(list(TEXTS.items()), "doc long, text string")
    got = {r.doc: r.embedding for r in HashedWords.fit(docs, 16).encode(docs, "doc").collect()}
    assert got == {k: pytest.approx(vector(t, TEXTS.values(), 16), abs=2e-6) for k, t in TEXTS.items()}
    rare = [r.word for r in kept[-1].selectExpr("inline(rare)").collect()]
    assert sorted(rare) == sorted({"farm", "music", "boat", "song", "उत्तर"})
