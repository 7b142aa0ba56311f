"""The jobs on copies that grow between runs."""

import json
import os
import subprocess
import sys
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from jobs import ingest_corpus, queries, training_rows
from lexmill.operators.evaluation import containing
from lexmill.streaming.ingest import Seen

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
WORDS = "river delta farm boat music song field water grain seed plough rain cloud market road bridge".split()


def doc(i, text, source="s0"):
    return (i, text, "en", source, len(text or ""))


def prose(k, n=30):
    return " ".join(WORDS[(j * k + j // 5) % 16] for j in range(n)) + f" end{k}."


def add(spark, folder, *rows):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(folder)


def chunks(frame):
    return sorted((r.chunk_id, r.text, r.doc_id, r.chunk_index, r.source) for r in frame.collect())


def test_new_files_alone_are_taken(spark, tmp_path):
    at = (f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state")
    size = {"chunk_size": 10, "chunk_overlap": 2, "buckets": 4}
    add(spark, at[0], doc(5, prose(3)), doc(7, f"  {prose(3)} "), doc(8, "short"), doc(9, None), doc(10, prose(5), None))
    first = chunks(ingest_corpus.run(spark, *at, **size))
    assert {c[2] for c in first} == {"5", "10"} and {c[4] for c in first} == {"s0", None}
    # the second file repeats texts of the first, under smaller ids too
    add(spark, at[0], doc(1, prose(3)), doc(2, prose(7), "s1"), doc(3, prose(7), "s2"))
    second = chunks(ingest_corpus.run(spark, *at, **size))
    assert set(first) < set(second) and {c[2] for c in second} == {"5", "10", "2"}
    files = lambda: {p: os.path.getmtime(p) for p in map(str, (tmp_path / "out").rglob("*.parquet"))}
    before = files()
    assert chunks(ingest_corpus.run(spark, *at, **size)) == second and files() == before
    stats = sorted((r.batch, r.documents_read, r.documents_written, r.chunks_written) for r in spark.read.json(f"{at[1]}/stats").collect())
    n = len(first), len(second) - len(first)
    assert stats == [(0, 5, 2, n[0]), (1, 3, 1, n[1])]
    texts = spark.read.parquet(f"{at[1]}/documents")
    assert sorted((r.batch, r.doc_id, r.text) for r in texts.collect()) == [(0, 5, prose(3)), (0, 10, prose(5)), (1, 2, prose(7))]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lexmill_seen")]
    with pytest.raises(ValueError, match="buckets"):
        ingest_corpus.run(spark, *at, **{**size, "buckets": 8})


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """Between any two of its writes a batch may end and be run again."""
    first = spark.createDataFrame([doc(1, prose(3)), doc(2, prose(3)), doc(3, prose(5))], DOCS)
    second = spark.createDataFrame([doc(4, prose(5)), doc(5, prose(7))], DOCS)
    out = f"{tmp_path}/out"
    with Seen(spark, f"{tmp_path}/seen", 4) as seen:
        for i in (0, 0, 1, 1, 0):
            ingest_corpus.ingest((first, second)[i], i, seen, out, 20, 10, 2)
    assert sorted(r.doc_id for r in spark.read.parquet(f"{out}/documents").collect()) == [1, 3, 5]
    assert {c[2] for c in chunks(ingest_corpus.read(spark, out))} == {"1", "3", "5"}


def test_seen_hashes_are_not_shuffled(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with Seen(spark, f"{tmp_path}/seen", 8) as seen:
            seen.add(spark.createDataFrame([("a",), ("b",)], "text string"), 0)
            batch = spark.createDataFrame([(0, "b"), (1, "c"), (2, "c"), (3, None)], "ordinal long, text string")
            found = seen.unseen(batch, 1)
            assert sorted((r.ordinal, r.text) for r in found.collect()) == [(1, "c"), (3, None)]
            plan = found._jdf.queryExecution().executedPlan().toString()
            side = plan[plan.index("FileScan") - 600 :]
            assert "Bucketed: true" in plan and "SelectedBucketsCount: 8 out of 8" in plan
            above = plan[: plan.index("FileScan")].splitlines()[-4:]  # between the scan and the join
            assert not any("Exchange" in line for line in above), side
            assert sorted(r.ordinal for r in seen.unseen(batch, 0).collect()) == [0, 1, 3]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def held_by(docs, items):
    return sorted((q, d) for q, item in items if item and item.split() for d, text in docs if text is not None and item in text)


def test_containing_items_of_any_length(spark):
    nine, ten = " ".join(WORDS[:9]), " ".join(WORDS[3:13])
    docs = [(0, f"x{nine}y"), (1, f"{ten} {nine}"), (2, "a boat"), (3, "boats, a boat\nand water"), (4, None), (5, ""), (6, ten.replace(" ", "  ")), (7, "music song field"), (8, " ".join(WORDS[:8]) + "s")]
    items = [(0, nine), (1, ten), (2, "oat"), (3, "a boat\nand"), (4, ""), (5, " "), (6, None), (7, "music song field"), (8, " ".join(WORDS[:8])), (9, "usic song fiel"), (10, nine), (11, "never")]
    frames = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "query long, text string")
    got = sorted((r.query, r.doc) for r in containing(*frames).collect())
    assert got == held_by(docs, items) and {q for q, _ in got} == {0, 1, 2, 3, 7, 8, 9, 10}
    import lexmill.operators.evaluation as e

    e._SHORT_BLOCK, before = 2, e._SHORT_BLOCK
    assert sorted((r.query, r.doc) for r in containing(*frames).collect()) == got
    e._SHORT_BLOCK = before


def test_training_rows(spark, tmp_path):
    texts = {i: prose(i, 25) for i in range(1, 15)}
    texts[20] = texts[3] + " more"
    items = {0: " ".join(texts[3].split()[2:14]), 1: "river delta", 2: "nothing holds this", 3: " ".join(texts[7].split()[:6])}
    spark.createDataFrame([doc(i, t) for i, t in texts.items()] + [doc(99, None)], DOCS).write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/items")
    at = (f"{tmp_path}/items", f"{tmp_path}/documents", f"{tmp_path}/out")
    made = sorted(tuple(r) for r in training_rows.run(spark, *at, depth=10, negatives=3, eval_fraction=0.5, batch_size=2).collect())
    assert made == sorted(tuple(r) for r in training_rows.run(spark, *at, depth=10, negatives=3, eval_fraction=0.5, batch_size=2).collect())
    assert sorted(os.listdir(tmp_path / "out" / "rows"))[-2:] == ["part=eval", "part=train"]
    gold = defaultdict(set)
    for q, d in held_by(list(texts.items()), list(items.items())):
        gold[q].add(d)
    rows = training_rows.read(spark, at[2], spark.read.parquet(f"{at[2]}/rows").schema)
    got = defaultdict(list)
    for r in rows.collect():
        assert (r.batch, r.part) == (r.query // 2, "train" if r.query < 2 else "eval")
        assert r.positive == min(gold[r.query]) and r.negative not in gold[r.query]
        assert (r.question, r.positive_text, r.negative_text) == (items[r.query], texts[r.positive], texts[r.negative])
        got[r.query].append(r.position)
    assert set(got) == set(gold) and all(sorted(p) == [1, 2, 3] for p in got.values())


def test_registered_jobs_leave_no_trace_in_the_session(spark, tmp_path):
    before = {r.key: r.value for r in spark.sql("set").collect()}
    add(spark, f"{tmp_path}/documents.parquet", *(doc(i, prose(i)) for i in range(9)))
    assert queries.job1_ingest_corpus(spark, str(tmp_path)).count() == 9
    assert {r.key: r.value for r in spark.sql("set").collect()} == before
    assert not spark.streams.active


def test_command_line(tmp_path, spark):
    add(spark, f"{tmp_path}/in", doc(1, prose(3)), doc(2, prose(5)))
    (tmp_path / "c.json").write_text(json.dumps({"documents": "elsewhere", "output": f"{tmp_path}/out", "buckets": 2, "chunk_size": 12, "chunk_overlap": 2}))
    command = [sys.executable, "-m", "jobs.ingest_corpus", "--config", f"{tmp_path}/c.json", "--documents", f"{tmp_path}/in", "--checkpoint", f"{tmp_path}/state", "--master", "local[2]"]
    done = subprocess.run(command, cwd=ROOT, check=True, capture_output=True, text=True, timeout=300)
    assert "read 2 documents, wrote 2 documents" in done.stderr
    assert spark.read.parquet(f"{tmp_path}/out/chunks").select(F.count_distinct("doc_id")).first()[0] == 2
    assert subprocess.run([sys.executable, "-m", "jobs.training_rows"], cwd=ROOT, capture_output=True, timeout=300).returncode == 2
