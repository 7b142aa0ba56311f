import pytest

from lexmill.operators import analysis, metrics

RANKED = {"q1": "d1 d2 d3 d4 d5".split(), "q2": "d6 d7 d8 d9 d10".split(), "q3": "d11 d12 d13 d14 d15".split()}
GOLD = [("q1", "d1"), ("q1", "d3"), ("q2", "d7"), ("q3", "d14"), ("q3", "d15")]


def frames(spark, ranked=RANKED, gold=GOLD):
    run = spark.createDataFrame([("r", q, d, i + 1, 1.0 - i / 10) for q, ds in ranked.items() for i, d in enumerate(ds)], "retriever string, query string, doc string, rank int, score double")
    return run, spark.createDataFrame(gold, "query string, doc string")


def test_goldens(spark):
    run, gold = frames(spark)
    got = {r["query"]: r for r in metrics.per_query(run, gold, 5).collect()}
    expected = {
        "q1": (1, 1, 0.4, 0.919721, 0.833333),
        "q2": (0.5, 1, 0.2, 0.630930, 0.5),
        "q3": (0.25, 1, 0.4, 0.501266, 0.325),
    }
    for q, values in expected.items():
        assert [got[q][c] for c in ("rr", "recall", "precision", "ndcg", "ap")] == pytest.approx(values, abs=1e-6)
    means = {r.metric: r.value for r in metrics.all_metrics(run, gold, 5).collect()}
    assert means == pytest.approx({"mrr@5": 0.583333, "recall@5": 1, "precision@5": 0.333333, "ndcg@5": 0.683972, "map": 0.552778}, abs=1e-6)


def test_queries_without_gold_and_empty_gold(spark):
    run, gold = frames(spark, {**RANKED, "q9": ["x"], "q8": ["y"]}, [*GOLD, ("q8", None), ("q7", "z")])
    got = {r["query"]: r for r in metrics.per_query(run, gold, 5).collect()}
    assert set(got) == {"q1", "q2", "q3", "q8"}
    assert (got["q8"].rr, got["q8"].recall, got["q8"].precision, got["q8"].ndcg, got["q8"].ap) == (0, None, 0, 0, None)
    assert {r.metric: r.value for r in metrics.all_metrics(run, gold, 5).collect()}["mrr@5"] == pytest.approx(1.75 / 4, abs=1e-6)


def test_cut_off_and_short_lists(spark):
    run, gold = frames(spark, {"q1": ["d9", "d1"]}, [("q1", "d1")])
    one = {r.metric: r.value for r in metrics.all_metrics(run, gold, 1).collect()}
    assert one == {"mrr@1": 0, "recall@1": 0, "precision@1": 0, "ndcg@1": 0, "map": 0.5}
    assert {r.metric: r.value for r in metrics.all_metrics(run, gold, 10).collect()}["precision@10"] == 0.1
    assert metrics.all_metrics(run.limit(0), gold).count() == 0


def test_errors_and_displacement(spark):
    sparse, gold = frames(spark)
    dense, _ = frames(spark, {"q1": ["d3", "x"], "q2": ["x"], "q3": ["x"]})
    got = {r["query"]: r.bucket for r in analysis.buckets(sparse, dense, gold, 3).collect()}
    assert got == {"q1": "both_succeed", "q2": "sparse_only", "q3": "both_fail"}
    queries = spark.createDataFrame([("q1", "t"), ("q2", "t"), ("q3", "t"), ("q0", "t")], "query string, text string")
    row = analysis.summary(queries, analysis.buckets(sparse, dense, gold, 3)).first()
    assert (row.total_queries, row.both_fail, row.sparse_recall, row.dense_recall, row.agreement_rate) == (4, 1, 0.5, 0.25, 0.25)
    moved = {(r["query"], r.doc): (r.sparse_rank, r.dense_rank, r.displacement) for r in analysis.displacement(sparse, dense, gold).collect()}
    assert moved[("q1", "d3")] == (3, 1, 2) and moved[("q1", "d1")] == (1, None, None)
    case = {r["query"]: r for r in analysis.cases(queries, sparse, dense, gold).collect()}["q1"]
    assert case.sparse_retrieved == RANKED["q1"] and case.gold_chunks == ["d1", "d3"]
    assert {r.doc for r in analysis.hard_negatives(sparse.where("query = 'q1'"), gold, 2).collect()} == {"d2", "d4"}


def test_tables(spark, tmp_path):
    from lexmill.sources import reports

    values = [("a_b", "mrr@10", 0.5), ("c", "mrr@10", 0.5), ("a_b", "map", 0.1), ("c", "map", 0.2)]
    m = spark.createDataFrame(values, "retriever string, metric string, value double")
    assert {(r.retriever, r.metric) for r in analysis.best(m).where("best").collect()} == {("a_b", "mrr@10"), ("c", "mrr@10"), ("c", "map")}
    text = analysis.latex(m, ["mrr@10", "map"], "t")
    assert r"a\_b & \textbf{0.5000} & 0.1000 \\" in text and r"c & \textbf{0.5000} & \textbf{0.2000} \\" in text
    assert reports.aggregate_csv(m, ["mrr@10", "map"], f"{tmp_path}/csv")
    assert not reports.aggregate_csv(m.limit(0), ["map"], f"{tmp_path}/none")
    back = reports.read_results(spark, f"{tmp_path}/csv")
    assert back.columns == ["System", "mrr@10", "map"] and back.where("System = 'c'").first()["map"] == 0.2
    run, gold = frames(spark)
    reports.details_json(metrics.per_query(run, gold), f"{tmp_path}/details")
    reports.error_files(analysis.cases(spark.createDataFrame([("q1", "t")], "query string, text string"), run, run, gold), m, f"{tmp_path}/errors")
    reports.latex_file(m, ["map"], "t", f"{tmp_path}/tex")
    assert spark.read.text(f"{tmp_path}/tex").count() == text.count("\n") + 1
