import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@needs_data
def test_entry(spark):
    assert entry.entry(spark).columns == ["query", "doc", "score", "rank"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@needs_data
@pytest.mark.parametrize("name", ["clean_text", "nfc_devanagari", "chunk_fixed", "chunk_sentence", "bm25_word_topk", "bm25_char_topk", "metrics_all", "qa_template", "dense_flat_topk", "weighted_fusion", "error_cases"])
def test_query_equals_its_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = lambda rs: sorted(map(repr, rs))
    assert rows(tuple(plain(r[c]) for c in columns) for r in df.collect()) == rows(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_without_the_training_data_part(tmp_path):
    """A copy without that subpackage and the pipeline still imports and lists the other queries."""
    import shutil

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/lexmill", tmp_path / "lexmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(f"{root}/jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'bm25_word_topk' in e.queries() and not any(n.startswith('op') for n in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
