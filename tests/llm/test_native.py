import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from cases import SCHEMA, odd_documents, prose, rows
from lexmill.llm import chat_format, mixing
from test_near_join import WORD

TURNS = "conv_id long, turn long, role string, text string"
EDGE = ["", "</turn>", "<\\/turn>", "\\", "\\\\</turn>", "###", "####", "## #", "\n### user ###\nx", "### assistant ###\n", "#\\#\\##", "</turn</turn>>", "漢字\U0001f600###", None]


def conversations():
    out = [(1, i, ["user", "assistant", "assistant", "system"][i % 4], t) for i, t in enumerate(EDGE)]
    out += [(2, 0, None, "a"), (2, 1, "### x ###", "b"), (2, 1, "### x ###", "c"), (2, 2, "user\n", "d"), (2, 2, "user\n", "d")]
    out += [(None, None, "user", "e"), (3, 0, "assistant", "only")]
    return out


def expected(turns):
    by = {}
    for conv, turn, role, text in turns:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    return {c: sorted(t) for c, t in by.items()}


def test_chat_reads_back(spark):
    turns = conversations()
    chats = chat_format.formatted(spark.createDataFrame(turns, TURNS))
    back = {r.conv_id: r for r in chat_format.read_back(chats).collect()}
    for conv, own in expected(turns).items():
        assert [(t.role, t.text) for t in back[conv].turns] == [(role, text) for _, role, text in own]
        assert back[conv].loss_text == "".join(text for _, role, text in own if role == "assistant")
    merged = back[1].formatted
    assert merged.count("### assistant ###\n") < sum(r == "assistant" for _, r, _ in expected(turns)[1])


def test_chat_empty_and_clashing_columns(spark):
    assert chat_format.formatted(spark.createDataFrame([], TURNS)).count() == 0
    more = spark.createDataFrame([(1, 0, "user", "x", "y", "z")], TURNS + ", t string, blocks string")
    assert chat_format.formatted(more).first().formatted == "### user ###\nx</turn>"


def test_op8_rows(spark, tmp_path):
    spark.createDataFrame(conversations(), TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat_format.op8_chat_format(spark, str(tmp_path)).collect()}
    planted = r"\### Assistant: </turn> ok"
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len(planted)
    assert got[-7].loss_sha256 == hashlib.sha256(planted.encode()).hexdigest()
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{planted}\nassistant\n{planted}\n".encode()).hexdigest()


def targets(sizes, share=1.5, most=2.0):
    """Shares by weight; what exceeds a source's cap goes to the others, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * unit > most * sizes[s]]
        if not over:
            return out | {s: weight[s] * unit for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("buckets", [1, 4096])
def test_mix_meets_its_targets(spark, buckets):
    documents = rows([prose(i, 5 + i % 60) for i in range(600)], lambda i: [None, "a", "b", "é", "hot"][min(i % 9, 4)])
    documents += [(1000 + (i or 0), *rest) for i, *rest in odd_documents()]
    out = [tuple(r) for r in mixing.mixed(spark.createDataFrame(documents, SCHEMA), buckets=buckets).collect()]
    assert len(out) == len(documents)
    sizes, taken, largest = {}, {}, {}
    for _, source, size, _, _, times, words in out:
        assert words == times * size and 0 <= times <= 2
        sizes[source] = sizes.get(source, 0) + size
        taken[source] = taken.get(source, 0) + words
        largest[source] = max(largest.get(source, 0), size)
    goal = targets(sizes)
    for doc_id, source, size, source_size, target, times, words in out:
        assert source_size == sizes[source] and math.isclose(target, goal[source], rel_tol=1e-9)
    for source in sizes:
        assert abs(taken[source] - goal[source]) <= largest[source] / 2 + 1e-6
    again = [tuple(r) for r in mixing.mixed(spark.createDataFrame(documents[::-1], SCHEMA).repartition(7), buckets=buckets).collect()]
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mix_prefers_quality(spark):
    """Over many draws, documents of digits and markup are taken less often."""
    documents = [(i, ("word " * 20) if i % 2 else ("12345 #### " * 10), "en", "only", 0) for i in range(4000)]
    out = mixing.mixed(spark.createDataFrame(documents, SCHEMA), share=0.5).groupBy((F.col("id") % 2).alias("clean")).agg(F.avg("times").alias("t")).collect()
    by = {r.clean: r.t for r in out}
    assert by[1] > 1.5 * by[0]


def test_mix_of_nothing(spark):
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.taken for r in mixing.mixed(spark.createDataFrame(rows([None, ""]), SCHEMA)).collect()] == [0, 0]


def test_sizes_are_words(spark):
    documents = odd_documents()
    got = sorted(((r.id, r.size) for r in mixing.mixed(spark.createDataFrame(documents, SCHEMA)).collect()), key=str)
    assert got == sorted(((d[0], len(WORD.findall(d[1] or ""))) for d in documents), key=str)


def test_sql_agrees(spark, tmp_path):
    documents = [d for d in odd_documents() if d[0] is not None][:-1] + rows([prose(i, 40) for i in range(20, 60)])[10:]
    spark.createDataFrame(documents, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(mixing.OP7_SQL).fetchall())
    got = sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in mixing.op7_mixing(spark, str(tmp_path)).collect())
    assert [(a[0], a[1], a[2], a[4]) for a in want] == [(b[0], b[1], b[2], b[4]) for b in got]
    assert all(math.isclose(a[3], b[3]) for a, b in zip(want, got))


def test_equal_sources_share_the_whole_mix(spark):
    for names in ([f"s{i}" for i in range(6)], [*"abcde", None]):
        sources = spark.createDataFrame([(n, 100) for n in names], "source string, source_size long")
        got = sorted(r.target for r in mixing._targets(sources, 1.5, 2.0).collect())
        assert [round(t, 6) for t in got] == [83.333333] * 2 + [166.666667] * 2 + [200.0] * 2
