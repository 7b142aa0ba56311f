import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.operators import chunking, dedup, questions


def windows(n, size, overlap):
    """Word windows one after another until less than an overlap is left."""
    out, at = [], 0
    while at < n:
        out.append((at, min(at + size, n)))
        at += size - overlap
        if at < n and n - at < overlap:
            break
    return out


def docs(spark, texts):
    return spark.createDataFrame([(f"d{i}", t, "s") for i, t in enumerate(texts)], "doc_id string, text string, source string")


@pytest.mark.parametrize("size,overlap", [(4, 1), (5, 0), (6, 5), (256, 64)])
def test_fixed_windows(spark, size, overlap):
    lengths = [0, 1, size - 1, size, size + 1, 3 * size + 2, 50]
    texts = [" ".join(f"w{i}" for i in range(n)) for n in lengths]
    got = {}
    for r in chunking.fixed(docs(spark, texts), size, overlap).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.text)
        assert r.chunk_id == f"{r.doc_id}_c{r.chunk_index:04d}" and r.metadata == {"chunk_method": "fixed"}
    for i, n in enumerate(lengths):
        assert got.get(f"d{i}", []) == [" ".join(f"w{k}" for k in range(a, b)) for a, b in windows(n, size, overlap)]


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        chunking.chunk(docs(spark, ["a"]), "fixed", 4, 4)


def test_sentences(spark):
    text = "one two. three four five! six। seven eight nine ten eleven twelve? tail"
    got = [r.text for r in chunking.chunk(docs(spark, [text, "", None]), "sentence", 5, 1).orderBy("doc_id", "chunk_index").collect()]
    assert got == ["one two. three four five!", "five! six।", "six। seven eight nine ten eleven twelve?", "twelve? tail"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), max_size=12), st.integers(2, 8), st.integers(0, 1))
def test_packing_keeps_every_sentence(sentences, size, overlap):
    chunks = list(chunking.pack(sentences, size, overlap))
    carried = sum(min(overlap, len(c)) for c in chunks[:-1])
    assert sum(map(len, chunks)) == sum(map(len, sentences)) + carried


def test_legacy_carry():
    assert list(chunking.pack([["a", "b"], ["c", "d"]], 3, 0)) == [["a", "b"], ["c", "d"]]
    assert list(chunking.pack([["a", "b"], ["c", "d"]], 3, 0, legacy_carry=True)) == [["a", "b"], ["a", "b", "c", "d"]]


def test_metadata_is_merged(spark):
    d = docs(spark, ["a b"]).withColumn("metadata", F.create_map(F.lit("k"), F.lit("v"), F.lit("chunk_method"), F.lit("x")))
    assert chunking.fixed(d).first().metadata == {"k": "v", "chunk_method": "fixed"}


def test_dedup(spark):
    rows = [(0, "x" * 19), (1, "y" * 20), (2, "y" * 20), (3, "z" * 25), (4, "x" * 19)]
    df = spark.createDataFrame(rows, "ordinal long, text string")
    assert dedup.clean_stats(df).first().asDict() == {"total": 5, "kept": 2, "removed_short": 2, "removed_dup": 1}
    assert [r.status for r in dedup.status(df).orderBy("ordinal").collect()] == ["short", "kept", "dup", "kept", "short"]
    kept = dedup.keep_first(dedup.long_enough(df))
    assert sorted(r.ordinal for r in kept.collect()) == sorted(r.ordinal for r in dedup.first_long(df).collect()) == [1, 3]
    seen = df.where("ordinal = 1").select(dedup.text_hash().alias("h"))
    assert [r.ordinal for r in dedup.unseen(dedup.long_enough(df), seen).collect()] == [3]
    assert dedup.clean_stats(df.limit(0)).first().total == 0


def test_keep_first_of_null_ordinals(spark):
    df = spark.createDataFrame([(None, "a"), (7, "a"), (None, "b"), (None, None), (3, "a")], "ordinal long, text string")
    assert sorted(dedup.keep_first(df).collect(), key=str) == sorted([(3, "a"), (None, "b"), (None, None)], key=str)


def test_corpus_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "text string")
    assert dedup.corpus_stats(empty, empty, empty).first().asDict() == {"raw_documents": 0, "cleaned_documents": 0, "chunks": 0, "avg_chunk_length": 0.0}


def test_questions(spark):
    chunks = spark.createDataFrame([("c1", "a b c d", "s"), ("c2", " ".join(f"w{i}" for i in range(9)), "s")], "chunk_id string, text string, source string")
    made = questions.generate(chunks, per_chunk=3).collect()
    assert len(made) == 3 and {r.chunk_id for r in made} == {"c2"}
    assert made == questions.generate(chunks, per_chunk=3).collect()
    with pytest.raises(ValueError):
        questions.generate(chunks, "other")


def test_questions_of_a_model(spark):
    def client(text, n):
        if "bad" in text:
            raise OSError("down")
        return f"1. What of {text}?\n\n 2) - And?\nmore"

    chunks = spark.createDataFrame([("c1", "bad", "s"), ("c2", "good", "s")], "chunk_id string, text string, source string")
    assert sorted(r.question for r in questions.generate(chunks, "llm", client=client, per_chunk=3).collect()) == ["And?", "What of good?"]


def test_training_frames(spark):
    pairs = spark.range(5).select(F.col("id").alias("n"), F.lit("q").alias("question"), F.lit("a").alias("answer"))
    assert [r.part for r in questions.split(pairs, "n", 5, 0.4).orderBy("n").collect()] == ["train"] * 3 + ["eval"] * 2
    assert questions.in_batch_negatives(pairs, "n", 2).count() == 4
    assert questions.positives(pairs).columns == ["anchor", "positive"]
    assert questions.schedule(33, 16, 5, 0.1) == {"total_steps": 15, "warmup_steps": 1}
