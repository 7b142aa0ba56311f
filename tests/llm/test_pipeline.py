import corpus_pipeline
from cases import SCHEMA, odd_documents, prose, rows
from lexmill.llm import queries
from test_classifiers import LABELS
from test_decontaminate import brute_force as contained
from test_native import targets
from test_near_join import WORD
from test_near_join import brute_force as near
from test_pii import brute_force as base_spans


def tables(spark, tmp_path):
    texts = [prose(i, 60) for i in range(120)]
    insults = "scoundrel blockhead nitwit".split()
    for i in range(0, 120, 4):
        words = texts[i].split()
        for k, w in enumerate(insults * 2):
            words.insert(5 + 7 * k, w)
        texts[i] = " ".join(words)
    texts[1] += " mail zb@mail.example or +1 377 555 0271 today"
    texts[2] = texts[3] + " again"
    texts[5] += " " + prose(900, 20)
    documents = rows(texts) + [(1000 + (d[0] if d[0] is not None else 50), *d[1:]) for d in odd_documents()]
    spark.createDataFrame(documents, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, prose(900, 20)), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return documents


def test_stages_and_run(spark, tmp_path):
    documents = tables(spark, tmp_path)
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.Shelf(spark).put(stage(spark, docs, sf), name)
        out = [tuple(r) for r in docs.collect()]
        if name != "mix":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "toxicity":
            gone = {r[0] for r in kept} - {r[0] for r in out}
            assert gone <= {i for i in range(0, 120, 4)} and len(gone) > 20
        if name == "near_join":
            classes = near(kept)
            heads = {(i, n) for i, n, head in classes if i == head or not n}
            assert sorted((r[0] for r in out), key=str) == sorted((i for i, _ in heads), key=str)
        if name == "decontaminate":
            bad = {i for i, *_ in contained(kept, [(0, prose(900, 20))])}
            assert bad == {5} and {r[0] for r in out} == {r[0] for r in kept} - bad
        if name == "pii":
            assert {r[0] for r in out} == {r[0] for r in kept}
            assert not any(base_spans(r[1]) for r in out) and all(r[4] == len(r[1]) for r in out if r[1] is not None)
            same = {r[0]: r[1] for r in kept}
            assert all(r[1] == same[r[0]] for r in out if not base_spans(same[r[0]]))
        if name == "mix":
            sizes = {}
            for r in kept:
                sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
            goal = targets(sizes)
            assert all(abs(r.target - goal[r.source]) < 1e-6 for r in docs.collect())
        kept = out
    assert len(documents) > len(kept)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(kept)


def test_registered():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert {f"op{n}" for n in range(1, 13)} == {name.split("_")[0] for name in queries.QUERIES if name.startswith("op")}
    assert "pipeline" in queries.QUERIES
