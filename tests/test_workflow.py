import json

import pytest
from pyspark.sql import functions as F

from lexmill.__main__ import main
from lexmill.config import Config, merge
from lexmill.operators import rag
from lexmill.plans import workflow

WORDS = "river delta farm boat music song field water grain seed plough rain cloud market road bridge".split()


@pytest.fixture
def cfg(tmp_path):
    paragraphs = [" ".join(WORDS[(i * k) % 16] for k in range(1, 15)) + f" number{i}" for i in range(1, 9)]
    (tmp_path / "corpus.txt").write_text("\n\n".join([*paragraphs, paragraphs[0], "short"]))
    d = {"corpus_path": f"{tmp_path}/corpus.txt", "processed_dir": f"{tmp_path}/p", "qa_pairs_path": f"{tmp_path}/qa", "chunk_size": 12, "chunk_overlap": 2}
    over = {"data": d, "evaluation": {"results_dir": f"{tmp_path}/r", "ablation": {"ngram_sizes": [[2, 3]]}}, "paper_assets": {"tables_dir": f"{tmp_path}/t"}, "training": {"output_dir": f"{tmp_path}/m", "eval_fraction": 0.3}, "experiment": {"tracking": "json", "output_dir": f"{tmp_path}/o"}}
    return merge(Config(), over)


def test_a_study(spark, cfg, tmp_path):
    stats = workflow.prepare(spark, cfg).first()
    assert (stats.raw_documents, stats.cleaned_documents, stats.chunk_size) == (10, 8, 12)
    assert workflow.load_chunks(spark, cfg).count() == stats.chunks
    assert workflow.make_questions(spark, cfg).count() <= 20
    assert workflow.tuned_encoder(spark, cfg) is None
    learnt = workflow.train(spark, cfg)
    assert learnt["last_loss"] < learnt["first_loss"] and 0 <= learnt["mrr_after"] <= 1
    assert workflow.tuned_encoder(spark, cfg)(["river", "delta boat"]).shape == (2, 64)
    found = workflow.build_indices(spark, cfg, f"{tmp_path}/i", "number3").first()
    assert "number3" in found.text
    done = workflow.evaluate_all(spark, cfg, index_dir=f"{tmp_path}/i")
    saved = workflow.opened(workflow.retrievers(cfg), workflow.load_chunks(spark, cfg), f"{tmp_path}/i")
    assert saved["word_bm25"].postings.path == f"{tmp_path}/i/word_bm25" and saved["hybrid"].retrievers[0].postings.path == f"{tmp_path}/i/char_ngram_bm25"
    values = {(r.retriever, r.metric): r.value for r in done.metrics().collect()}
    assert len(values) == 20 and all(0 <= v <= 1 for v in values.values())
    assert done.displacement("char_ngram_bm25", "dense_zeroshot").count() == done.gold.count()
    assert spark.read.json(f"{tmp_path}/r/error_analysis/cases").count() == done.gold.count()
    told = {r.retriever: r for r in spark.read.json(f"{tmp_path}/r/detailed_results").collect()}
    detail = told["char_ngram_bm25"].per_query_details[0]
    assert told["hybrid"].top_k == 10 and 0 <= told["hybrid"].aggregate_metrics["map"] <= 1 and len(told) == 4
    assert [r["rank"] for r in detail.retrieved] == list(range(1, len(detail.retrieved) + 1)) and len(detail.gold_ids) == 1
    assert len(told["hybrid"].per_query_details) == done.queries.count()
    workflow.assets(spark, cfg)
    assert spark.read.csv(f"{tmp_path}/t/aggregate_results_csv", header=True).columns[0] == "System"
    assert "tabular" in "".join(r.value for r in spark.read.text(f"{tmp_path}/t/aggregate_results").collect())
    asked = spark.createDataFrame([("a", "number3 river")], "query string, text string")
    told = workflow.answer(spark, cfg, asked, rag.CallableLLM(lambda p: "yes", "m")).first()
    assert told.answer == "yes" and told.num_sources == 5
    assert workflow.answer(spark, cfg, asked, sparse_only=True).first().answer is None


def test_command_line(spark, cfg, tmp_path, capsys):
    (tmp_path / "c.json").write_text(json.dumps(workflow.describe(cfg)))
    at = ["--config", f"{tmp_path}/c.json"]
    with pytest.raises(FileNotFoundError):
        main(["evaluate", "--dry-run", *at])
    main(["prepare", *at])
    main(["questions", *at])
    main(["evaluate", "--dry-run", *at])
    main(["answer", "--sparse-only", "--output", f"{tmp_path}/a", *at])
    assert spark.read.json(f"{tmp_path}/a").where(F.col("retriever") == "char_ngram_bm25").count() == 4
