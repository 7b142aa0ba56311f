import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import dense, fusion, ivf, rag
from lexmill.operators.bm25 import _first_unmatched, positions, search_chars, search_words
from lexmill.operators.index import Analyzer
from lexmill.operators.postings import Postings
from lexmill.operators.retrievers import CharBM25, Dense, Hybrid, WordBM25
from lexmill.plans.queries import QUERIES

TEXTS = {"a1": "river delta farm", "a2": "delta music", "a3": "river river boat", "a4": "rivver dellta", "a5": "boat song river"}


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(k, v, {"k": k}) for k, v in TEXTS.items()], "chunk_id string, text string, metadata map<string,string>")


@pytest.fixture(scope="module")
def word(chunks):
    return WordBM25().index(chunks)


@pytest.fixture(scope="module")
def char(chunks):
    return CharBM25().index(chunks)


def ranked(df):
    return {r.chunk_id: round(r.score, 6) for r in df.orderBy("rank").collect()}


def test_goldens(word, char):
    found = ranked(char.retrieve_one("river delta"))
    assert found == {"a1": 13.489084, "a4": 10.137372, "a2": 10.025283, "a3": 6.991965, "a5": 4.997778}
    found = ranked(word.retrieve_one("river delta"))
    assert found == {"a1": 0.485064, "a2": 0.375463, "a3": 0.247984, "a5": 0.170378, "a4": 0.0}
    assert list(found)[-1] == "a4"


def test_word_list_is_always_full(word):
    r = word
    assert ranked(r.retrieve_one("nothing known", 3)) == {"a1": 0.0, "a2": 0.0, "a3": 0.0}
    assert ranked(r.retrieve_one("", 2)) == {"a1": 0.0, "a2": 0.0}
    twice, once = ranked(r.retrieve_one("music music")), ranked(r.retrieve_one("music"))
    assert twice["a2"] == pytest.approx(2 * once["a2"], abs=2e-6)


def test_fill_of_queries_with_many_matches(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc"), F.when(F.col("id") % 4500 == 4499, "moss").otherwise("fern").alias("text")).repartition(5)
    asked = spark.createDataFrame([("a", "fern"), ("b", "moss"), ("c", "none"), ("d", "fern moss")], "query string, text string")
    got = {}
    for r in search_words(docs, asked, 3).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["doc"], r["score"] > 0, r["score"] < 0))
    assert [d for d, *_ in got["a"]] == [0, 1, 2]
    assert [d for d, *_ in got["b"]] == [4499, 8999, 0] and [d for d, *_ in got["c"]] == [0, 1, 2]
    at = positions(docs).collect()
    assert sorted((r["at"], r["doc"]) for r in at) == [(i + 1, i) for i in range(9000)]
    free = _first_unmatched(docs, spark.createDataFrame([("a", 8998), ("b", 2)], "query string, m long"), docs.selectExpr("if(text = 'fern', 'a', 'b') as query", "doc"), 3)
    assert "SinglePartition" not in free._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, free.collect())) == [("a", 4499, 0.0), ("a", 8999, 0.0), ("b", 0, 0.0), ("b", 1, 0.0), ("b", 2, 0.0)]


def test_char_list_holds_matches_only(char):
    r = char
    assert ranked(r.retrieve_one("zzz")) == {} and ranked(r.retrieve_one("")) == {}
    assert r.retrieve_one("river", 1).first().metadata == {"k": "a3", "retriever": "char_ngram_bm25", "ngram_range": "(2, 4)"}
    assert ranked(r.retrieve_one("river river")) == ranked(r.retrieve_one("river"))


def test_not_indexed():
    for r in (WordBM25(), CharBM25(), Dense(), Hybrid()):
        assert not r.is_indexed and "indexed=False" in repr(r)
        with pytest.raises(RuntimeError):
            r.retrieve_one("x")


def test_saved_indexes_search_alike(spark, chunks, tmp_path):
    for made, fresh in ((WordBM25(1.2, 0.5), WordBM25()), (CharBM25((3, 4)), CharBM25()), (Dense(index_type="hnsw"), Dense(normalize=False))):
        made.index(chunks).save(f"{tmp_path}/{made.name}")
        fresh.load(spark, f"{tmp_path}/{made.name}")
        assert ranked(fresh.retrieve_one("river delta")) == ranked(made.retrieve_one("river delta"))
    assert Postings.load(spark, f"{tmp_path}/word_bm25").k1 == 1.2


def random_texts(n, seed=4):
    r = np.random.default_rng(seed)
    weights = 1 / np.arange(1, 301)
    return [" ".join(f"w{i}" for i in r.choice(300, r.integers(1, 40), p=weights / weights.sum())) for _ in range(n)]


@pytest.mark.parametrize("analyzer", [Analyzer("word"), Analyzer("char", 2, 3)])
def test_pruned_search_of_an_index_finds_what_the_texts_hold(spark, tmp_path, analyzer):
    texts = random_texts(500)
    docs = spark.createDataFrame([*enumerate(texts), *((1000 + i, texts[7]) for i in range(20)), (2000, ""), (2001, None)], "doc long, text string")
    docs = docs.fillna("", "text")
    asked = [(0, "w200 w150 w1"), (1, "w250 w0 w0 w1"), (2, "w5"), (3, "unknown"), (4, ""), (5, " ".join(texts[7].split()[:6])), (6, "w0 w1 w2 w3 w299 w298 w297 w296 w295 w294 w293 w292")]
    queries = spark.createDataFrame(asked, "query long, text string")
    made = Postings.build(docs, f"{tmp_path}/a", analyzer, buckets=16, block=50).copy(f"{tmp_path}/b")
    index = Postings.load(spark, made.path)
    plain = search_words(docs, queries, 5) if analyzer.kind == "word" else search_chars(docs, queries, 5, 2, 3)
    rows = lambda df: sorted((r.query, r.rank, r.doc, round(r.score, 5)) for r in df.collect())
    assert rows(index.search(queries, 5)) == rows(plain) == rows(index.search(queries, 5, prune=False))
    read = [index.hits(index.weighed(queries, 5, prune)).count() for prune in (True, False)]
    assert read[0] < (0.8 if analyzer.kind == "word" else 1.0) * read[1]  # postings that are summed
    largest = spark.read.parquet(f"{made.path}/postings").select(F.max(F.size("docs"))).first()[0]
    assert largest < 150  # a term of all documents is many blocks
    one = queries.where("query = 2")
    if analyzer.kind == "word":
        assert _files_read(index._matches(index.weighed(one, 5))) < _files_read(spark.read.parquet(f"{made.path}/postings"))


def vectors(spark, n=400, d=16, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "doc long, embedding array<float>").repartition(3)


def test_flat_search_is_exact(spark):
    x, df = vectors(spark)
    queries = df.where("doc % 50 = 0").withColumnRenamed("doc", "query")
    x32 = x.astype(np.float32).astype(np.float64)
    got = {}
    for r in ivf.search(df, queries, 5).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.doc)
    for q, found in got.items():
        s = np.round(x32 @ x32[q], 6)
        assert found == sorted(range(len(x)), key=lambda i: (-s[i], i))[:5]


def test_inverted_lists_recall(spark):
    r = np.random.default_rng(0)
    centers = r.normal(size=(20, 16))
    x = centers[r.integers(0, 20, 1000)] + 0.3 * r.normal(size=(1000, 16))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "doc long, embedding array<float>")
    queries = df.where("doc % 50 = 0").withColumnRenamed("doc", "query")
    exact = {(a.query, a.doc) for a in ivf.search(df, queries, 10).collect()}
    near = {(a.query, a.doc) for a in ivf.search(df, queries, 10, "ivf").collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_lists_are_read_by_partition_and_give_their_exact_best(spark, tmp_path):
    r = np.random.default_rng(3)
    centers = r.normal(size=(12, 16))
    x = centers[np.where(np.arange(900) < 300, 0, r.integers(0, 12, 900))] + 0.3 * r.normal(size=(900, 16))
    x[100:140] = x[100]  # ties, all in one list
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(9999, None)], "doc long, embedding array<float>")
    queries = df.where("doc % 60 = 40 or doc > 9000").withColumnRenamed("doc", "query")
    made = ivf.Lists.build(df, f"{tmp_path}/a", nlist=20, rows_a_file=100)
    lists = made.copy(f"{tmp_path}/b") and ivf.Lists.load(spark, f"{tmp_path}/b")
    table = lists.table()
    assert (table.count(), table.select("doc").distinct().count(), lists.nprobe) == (900, 900, 10)
    own = {r.doc: r.list_id for r in table.select("doc", "list_id").collect()}
    x32 = x.astype(np.float32).astype(np.float64)
    files = []
    for nprobe in (1, 3, 20):
        got = {}
        for row in lists.search(queries, 7, nprobe).orderBy("query", "rank").collect():
            got.setdefault(row.query, []).append((row.doc, row.score))
        assert set(got) == {q.query for q in queries.where("embedding is not null").collect()}
        for q, found in got.items():
            asked = set(dense.nearest(x32[[q]], lists.centroids)[0][:nprobe].tolist())
            s = {i: round(float(np.float64(x32[i] @ x32[q])), 6) for i in range(900) if own[i] in asked}
            want = sorted(s, key=lambda i: (-s[i], i))[:7]
            assert [d for d, _ in found] == want and [v for _, v in found] == pytest.approx([s[i] for i in want], abs=2e-6)
        found, read = lists.candidates([40], x32[[40]], "long", 7, nprobe)
        assert len(read) == nprobe or nprobe == 20
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "embedding" not in plan
        files.append(_files_read(found))
    assert files[0] < files[1] < files[2]


def _files_read(df):
    """Files that the largest scan reads after partition pruning."""
    df.collect()
    nodes, read = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if node.metrics().contains("numFiles"):
            read = max(read, node.metrics().apply("numFiles").value())
        children = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
        nodes += children
    return read


def test_inverted_lists_recall_without_clusters(spark):
    _, df = vectors(spark, 1000, 64)
    queries = df.where("doc % 25 = 0").withColumnRenamed("doc", "query")
    exact = {(a.query, a.doc) for a in ivf.search(df, queries, 10).collect()}
    few, found = ({(a.query, a.doc) for a in ivf.search(df, queries, 10, "ivf", **options).collect()} for options in ({}, {"recall": 0.95}))
    assert len(exact & few) < 0.9 * len(exact) <= len(exact & found)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_ivf_query_finds_nine_of_ten(spark, sf):
    folder = f"/root/testdata/{sf}"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    exact, found = ({(a.query, a.doc) for a in QUERIES[name](spark, folder).collect()} for name in ("dense_flat_topk", "dense_ivf_topk"))
    assert len(exact & found) >= 0.9 * len(exact)


def test_rows_without_a_vector(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "doc long, embedding array<float>")
    queries = vectors.withColumnRenamed("doc", "query")
    for found in (dense.search_flat(vectors, queries, 2), ivf.search_ivf(vectors, queries, 2)):
        assert {(r.query, r.doc) for r in found.where("rank = 1").collect()} == {(1, 1), (3, 3)}
        assert found.where("doc = 2 or query = 2").isEmpty()


def test_default_vectors_are_named_for_what_they_are():
    assert Dense(model="some/model").model == "hashed-trigrams" and Dense(lambda texts: texts, "some/model").model == "some/model"


def test_sentence_encoder(monkeypatch):
    import sys
    import types
    from importlib.machinery import ModuleSpec

    with pytest.raises(ImportError):
        dense.sentence_encoder("m")
    fake = types.ModuleType("sentence_transformers")
    fake.__spec__ = ModuleSpec("sentence_transformers", None)
    fake.SentenceTransformer = lambda model, device: types.SimpleNamespace(encode=lambda texts, **_: [[len(t)] for t in texts])
    monkeypatch.setitem(sys.modules, "sentence_transformers", fake)
    assert dense.sentence_encoder("m")(["a", "bcd"]).tolist() == [[1.0], [3.0]]


def test_no_queries(spark):
    _, df = vectors(spark, 10)
    assert ivf.search(df, df.limit(0).withColumnRenamed("doc", "query"), 3).count() == 0


def test_encoder_normalises(spark):
    df = spark.createDataFrame([("a", "some text"), ("b", None)], "doc string, text string")
    rows = dense.encode(df).collect()
    assert abs(np.linalg.norm(rows[0].embedding) - 1) < 1e-5 and len(rows) == 2
    assert np.linalg.norm(dense.encode(df, normalize=False).first().embedding) > 1.5


RUN_A = [("q", "c1", 0.9, 1), ("q", "c2", 0.8, 2), ("q", "c3", 0.2, 3)]
RUN_B = [("q", "c2", 0.95, 1), ("q", "c4", 0.7, 2), ("q", "c1", 0.45, 3)]
RUN = "query string, doc string, score double, rank int"


def runs(spark):
    return {"a": spark.createDataFrame(RUN_A, RUN), "b": spark.createDataFrame(RUN_B, RUN)}


def test_rrf_golden(spark):
    out = fusion.fuse(runs(spark)).orderBy("rank").collect()
    assert [(r.doc, round(r.score, 6)) for r in out] == [("c2", 0.032522), ("c1", 0.032266), ("c4", 0.016129), ("c3", 0.015873)]
    assert out[0].sources == {"a": 2, "b": 1}
    sweep = fusion.rrf_sweep(runs(spark), [60]).orderBy("rank").collect()
    assert [(r.doc, r.score) for r in sweep] == [(r.doc, r.score) for r in out]


def test_weighted_fusion(spark):
    out = {r.doc: r.score for r in fusion.fuse(runs(spark), "weighted", weights=[0.7, 0.3]).collect()}
    assert out == pytest.approx({"c1": 0.7, "c2": 0.7 * 0.6 / 0.7 + 0.3, "c4": 0.3 * 0.25 / 0.5, "c3": 0.0}, abs=1e-6)
    flat = {"a": spark.createDataFrame([("q", "x", 1.0, 1), ("q", "y", 1.0, 2)], RUN)}
    assert {r.score for r in fusion.weighted(flat).collect()} == {0.0}


def test_fusion_errors(spark, chunks):
    with pytest.raises(ValueError):
        fusion.fuse(runs(spark), "other")
    with pytest.raises(ValueError):
        fusion.rrf(runs(spark), weights=[1.0])
    with pytest.raises(ValueError):
        Hybrid([WordBM25()], [0.5, 0.5])


def test_hybrid(chunks):
    h = Hybrid([CharBM25(), Dense()])
    h.add_retriever(WordBM25(), 0.5)
    out = h.index(chunks).retrieve_one("river delta", 3).collect()
    assert len(out) == 3 and out[0].chunk_id == "a1" and out[0].metadata["fusion_method"] == "rrf"
    assert fusion.fetch_depth(10) == 50 and fusion.fetch_depth(40) == 80


def test_rag(spark, chunks):
    g = rag.Generator(CharBM25().index(chunks), top_k=2)
    queries = spark.createDataFrame([("q1", "river"), ("q2", "zzz")], "query string, text string")
    with pytest.raises(RuntimeError):
        g.generate(queries)
    g.set_llm(rag.CallableLLM(lambda p: f"{p.count('[')} passages", "echo"))
    out = {r.query_id: r for r in g.generate(queries, 0).collect()}
    assert out["q1"].answer == "2 passages" and out["q1"].num_sources == 2 and out["q2"].answer == "0 passages"
    assert [s.rank for s in out["q1"].sources] == [1, 2] and out["q1"].model == "echo"
    plan = g.generate(queries)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("collect_list") == 1  # retrieval stands in the plan once
    with pytest.raises(ValueError):
        rag.prompt("other", F.lit("q"), F.array())
    with pytest.raises(ValueError):
        rag.get_llm("other")


def test_api_needs_a_key(monkeypatch):
    for k in ("OPENAI_API_KEY", "GOOGLE_API_KEY"):
        monkeypatch.delenv(k, raising=False)
    with pytest.raises(ValueError):
        rag.get_llm("api")
    assert rag.CallableLLM(lambda p: 1 / 0, "m").generate("x").startswith("[Generation Error")


def test_interactive(chunks):
    lines, said = iter(["river", "quit"]), []
    rag.interactive(rag.Generator(CharBM25().index(chunks)), lambda: next(lines), said.append)
    assert len(said) == 3 and said[0].startswith("1. [")
