import random

from cases import SCHEMA, odd_documents, prose, rows
from lexmill.llm import decontaminate
from test_near_join import WORD, lowered, shingles


def grams(text, n):
    w = WORD.findall(lowered(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_force(documents, items):
    out = []
    for doc_id, text, *_ in documents:
        for item_id, item in items:
            own = shingles(item)
            if own:
                shared = len(own & grams(text, len(next(iter(own)))))
                if 100 * shared >= 80 * len(own):
                    out.append((doc_id, item_id, shared, len(own)))
    return sorted(out, key=str)


def planted():
    r = random.Random(2)
    items = [(i, prose(500 + i, r.choice([3, 5, 9, 20, 60]))) for i in range(30)] + [(30, None), (31, ""), (4, prose(504, 9))]
    texts = []
    for i in range(60):
        words = prose(i, r.choice([10, 100, 5000])).split()
        item = (items[i % 30][1] or "").split()
        if i % 2 and len(item) > 8:
            item[r.randrange(len(item))] = "other"
        at = r.randrange(len(words))
        texts.append(" ".join(words[:at] + item + words[at:]).title())
    return rows(texts) + odd_documents(), items


def test_matches_brute_force_in_one_block_or_many(spark):
    documents, items = planted()
    docs, bench = spark.createDataFrame(documents, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    expected = brute_force(documents, items)
    assert len(expected) > 30
    for size in (500_000, 100):
        got = decontaminate.contained_items(docs, bench, block_shingles=size)
        assert sorted((tuple(r) for r in got.collect()), key=str) == expected
        clean = decontaminate.without_items(docs, bench, block_shingles=size)
        assert clean.columns == docs.columns
        hit = {e[0] for e in expected}
        assert sorted((r.doc_id for r in clean.collect() if r.doc_id is not None and r.doc_id >= 10)) == sorted(d[0] for d in documents if d[0] is not None and d[0] >= 10 and d[0] not in hit)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained_items(docs, items).count() == 0
    some = spark.createDataFrame(odd_documents(), SCHEMA)
    assert decontaminate.contained_items(some, items).count() == 0
    assert decontaminate.without_items(some, items).count() == len(odd_documents())
