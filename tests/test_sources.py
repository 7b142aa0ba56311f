import json
import re

import pytest
from pyspark.sql import functions as F

from lexmill import config, runlog
from lexmill.functions.text import clean_text
from lexmill.sources import files
from lexmill.streaming import ingest


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.TXT").write_bytes("one\r\n\r\n \r\n  two\nlines \n\n\n".encode())
    (tmp_path / "sub" / "a.jsonl").write_text('{"text": "x", "metadata": {"k": "v"}}\n\n{"text": "é"}\n', encoding="utf-8")
    (tmp_path / "c.pdf").write_bytes(b"page one|  |page three")
    (tmp_path / "d.md").write_text("ignored")
    return tmp_path


def test_load_a_folder(spark, corpus):
    docs = files.load(spark, str(corpus)).where(~F.col("source").endswith(".pdf")).collect()
    got = {r.doc_id: (r.text, r.metadata) for r in docs}
    assert got == {"b_0000": ("one", {"paragraph_index": "0"}), "b_0001": ("two\nlines", {"paragraph_index": "1"}), "a_0000": ("x", {"k": "v"}), "a_0002": ("é", {})}
    by = {r.doc_id: r.ordinal for r in docs}
    assert by["b_0000"] < by["b_0001"] and by["a_0000"] < by["a_0002"]


def test_pdf_pages(spark, corpus):
    paths = [p for p in files._files(spark, str(corpus)) if p.endswith("pdf")]
    got = files.read_pdf(spark, paths, lambda data: data.decode().split("|")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [("c_p0000", "page one"), ("c_p0002", "page three")] and got[0].metadata.keys() == {"page"}


def test_missing_and_unknown(spark, corpus):
    with pytest.raises(FileNotFoundError):
        files.load(spark, str(corpus / "none"))
    assert files.load(spark, str(corpus / "d.md")).count() == 0


def test_bad_records_fail(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": "a"}\n{"meta": 1}\n')
    with pytest.raises(Exception, match="no text at .*x.jsonl:2"):
        files.load(spark, str(tmp_path / "x.jsonl")).collect()
    (tmp_path / "y.jsonl").write_text('{"n": 1, "s": "a"}\n\nnot json\n')
    with pytest.raises(Exception, match="y.jsonl:3"):
        files.load_jsonl(spark, str(tmp_path / "y.jsonl"), "n int, s string").collect()
    (tmp_path / "z.jsonl").write_text('{"n": 1, "s": "a"}\n\n{"n": 2}\n')
    assert [tuple(r) for r in files.load_jsonl(spark, str(tmp_path / "z.jsonl"), "n int, s string").collect()] == [(1, "a"), (2, None)]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    records = [json.dumps({"text": f"text {i}"}) if i % 7 else "" for i in range(2000)]
    (tmp_path / "a.jsonl").write_text("\n".join(records))
    (tmp_path / "b.jsonl").write_text("\r\n".join(records[:50]))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        docs = files.load(spark, str(tmp_path))
        assert docs.rdd.getNumPartitions() > 4
        rows = docs.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    want = {(f"{name}_{i:04d}", f"text {i}") for name, n in (("a", 2000), ("b", 50)) for i in range(n) if i % 7}
    assert {(r.doc_id, r.text) for r in rows} == want and len(rows) == len(want)
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.ordinal)] == sorted((d for d, _ in want), key=lambda d: (d[0], int(d[2:])))


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "n int, s string")
    files.save_jsonl(df, f"{tmp_path}/j")
    files.save_jsonl(df, f"{tmp_path}/j", append=True)
    assert spark.read.schema("n int, s string").json(f"{tmp_path}/j").count() == 4
    (tmp_path / "t.tsv").write_text("a\tb\t\n \n c\td\n")
    assert [r.cells for r in files.load_tsv(spark, str(tmp_path / "t.tsv")).orderBy("ordinal").collect()] == [["a", "b"], ["c", "d"]]
    files.save_tsv(df, f"{tmp_path}/tsv", header=True)
    files.save_text(df.select("s").where("s is not null"), f"{tmp_path}/txt")
    assert files.load_text(spark, f"{tmp_path}/txt").count() >= 1
    files.ensure_dir(spark, f"{tmp_path}/deep/er")
    assert files.exists(spark, f"{tmp_path}/deep/er") and not files.exists(spark, f"{tmp_path}/nope")


def test_config(tmp_path):
    base = config.Config()
    assert base.hybrid.rrf_k == 60 and base.sparse.ngram_range == (2, 4) and base.evaluation.error_analysis
    merged = config.merge(base, {"experiment": {"name": "x"}, "sparse": {"ngram_range": [3, 5]}})
    assert merged.experiment.name == "x" and merged.experiment.seed == 42 and merged.sparse.ngram_range == (3, 5)
    (tmp_path / "c.json").write_text(json.dumps({"dense": {"index_type": "ivf"}, "training": {"learning_rate": 1}}))
    assert config.load_config(tmp_path / "c.json").dense.index_type == "ivf"
    with pytest.raises(FileNotFoundError):
        config.load_config(tmp_path / "none.yaml")
    for bad in ({"dense": {"index_type": "tree"}}, {"hybrid": {"method": "sum"}}, {"data": {"chunk_size": "big"}}):
        with pytest.raises(ValueError):
            config.merge(base, bad)


def test_run_log(tmp_path):
    log = runlog.RunLog("e", output_dir=str(tmp_path))
    with pytest.raises(RuntimeError):
        log.params({"a": 1})
    log.start("r")
    log.params({"a": 1})
    log.metrics({"mrr@10": 0.5})
    log.artifact("f")
    saved = json.loads(open(log.end()).read())
    assert saved["metrics"] == {"mrr_at_10": 0.5} and saved["artifacts"] == ["f"] and saved["end_time"]
    assert len(runlog.logger("l").handlers) == len(runlog.logger("l").handlers) == 1


def test_streaming_dedup(spark, tmp_path):
    rows = [(0, "the same long enough text"), (1, "the  same long enough text"), (2, "short"), (3, "another text, long enough")]
    spark.createDataFrame(rows[:2], "ordinal long, text string").write.parquet(f"{tmp_path}/in")
    query = ingest.ingest(spark, f"{tmp_path}/in", "ordinal long, text string", f"{tmp_path}/out", f"{tmp_path}/state")
    query.processAllAvailable()
    spark.createDataFrame(rows, "ordinal long, text string").write.mode("append").parquet(f"{tmp_path}/in")
    query.processAllAvailable()
    query.stop()
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["another text, long enough", "the same long enough text"]


def test_seen_table(spark, tmp_path):
    batch = lambda *rows: spark.createDataFrame(rows, "ordinal long, text string").withColumn("text", clean_text(F.col("text")))
    batches = [batch((0, "a"), (1, "a"), (2, "b")), batch((3, "b"), (4, "c"))]
    for i in (0, 1, 1, 0):  # replays change nothing
        ingest.remember(batches[i], i, f"{tmp_path}/seen", f"{tmp_path}/kept")
    assert sorted((r.ordinal, r.text) for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == [(0, "a"), (2, "b"), (4, "c")]


def test_paragraphs_span_splits(spark, tmp_path):
    parts = ["  \n", "one\n", "\n", "two " * 150 + "\n", "line\n" * 90, " \t\n\n", " \n\n", "\n" * 120, "  three  \n \nstill three\n", "\n", "four \n", "\n "]
    (tmp_path / "a.txt").write_text("".join(parts))
    (tmp_path / "b.txt").write_text("".join(parts[::-1]) + "\n\nlast")
    (tmp_path / "c.txt").write_text("x" * 300)
    (tmp_path / "d.txt").write_text("")
    want = {}
    for name in "abcd":
        kept = [p for p in (p.strip() for p in re.split(r"\n[ \t\n\x0b\f\r]*\n", (tmp_path / f"{name}.txt").read_text())) if p]
        want.update({f"{name}_{i:04d}": p for i, p in enumerate(kept)})
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("64", "200", size):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            docs = files.load(spark, str(tmp_path)).collect()
            assert {r.doc_id: r.text for r in docs} == want and len(docs) == len(want)
            assert [r.doc_id for r in sorted(docs, key=lambda r: r.ordinal)] == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
