import pytest

from lexmill.operators import evaluation

DOCS = [(1, "x one two three four five six seven eight nine ten"), (2, "one two three four five six seven eight nin"), (3, None), (4, ""), (5, "a stone two three  four five six seven eight nine. one two three four five six seven eight nine")]
ITEMS = [(0, "one two three four five six seven eight nine"), (1, "two three four five six seven eight nine ten"), (2, "e two"), (3, " "), (4, "one two three four five six seven eight never")]


@pytest.mark.parametrize("begins", [10_000, 0])
def test_no_document_is_shuffled_for_gold(spark, monkeypatch, begins):
    """All documents were shuffled by id to compare their texts, and a key was made for each of their words."""
    monkeypatch.setattr(evaluation, "_BEGINS", begins)
    docs = spark.createDataFrame(DOCS, "doc long, text string")
    found = evaluation.containing(docs, spark.createDataFrame(ITEMS, "query long, text string"))
    want = [(q, d) for q, item in ITEMS for d, text in DOCS if item.strip() and item in (text or "")]
    assert sorted(map(tuple, found.collect())) == want
    assert begins == 0 or "hashpartitioning(doc" not in found._jdf.queryExecution().executedPlan().toString()


def test_items_with_a_key_are_found_in_the_scan_of_the_texts(spark):
    """A key was made and exploded for each word of a document that began one; equal keys and windows over two texts are no pairs."""
    docs = [(1, "x one two three four five six seven eight nine ten x one two three four five six seven eight nine"), (2, "one two three four"), (3, "five six seven eight nine"), (4, "y one two three four five six seven eight nine")]
    items = [(0, "x one two three four five six seven eight"), (1, "y one two three four five six seven eight"), (2, "one two three four five six seven eight nine")]
    found = evaluation.containing(spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "query long, text string"))
    assert sorted(map(tuple, found.collect())) == [(q, d) for q, item in items for d, text in docs if item in text]
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
