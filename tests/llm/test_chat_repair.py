import hashlib
import itertools
import random
import re
from collections import defaultdict

import duckdb
import pytest
from lexmill.llm import chat_repair

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")
BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")


def ordered(rows):
    return sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        stripped = text.rstrip(" \t\n\x0b\x0c\r")
        out.append(1 if BLANK.match(text) else 2 if (role, text) in seen else 0 if stripped[-1] in ".!?" else 3)
        seen.add((role, text))
    return out


def cheapest(rows):
    """Every series of edits with at most two inserts before each row and at the end."""
    found = faults(rows)
    best = None
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    choices = [[("D", 4, None)] if f in (1, 2) else [("D", 4, None), ("K", 3 * (f == 3), role), ("R", 3 + 3 * (f == 3), "user"), ("R", 3 + 3 * (f == 3), "assistant")] for f, (_, role, _) in zip(found, rows)]
    for edits in itertools.product(*choices):
        for added in itertools.product(inserts, repeat=len(rows) + 1):
            roles, audit, cost, lines = [], "", 0, []
            for i, before in enumerate(added):
                for role in before:
                    roles.append(role[0])
                    audit, cost = audit + "I", cost + 3
                    lines.append(f"{role}:")
                if i < len(rows):
                    letter, price, role = edits[i]
                    audit, cost = audit + letter, cost + price
                    if role is not None:
                        roles.append(role[:1] or " ")
                        lines.append(f"{role}:{rows[i][2]}")
            if LEGAL.match("".join(roles)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best


def conversations(seed, count):
    r = random.Random(seed)
    texts = ["fine.", "cut", "", " \t", "yes!", "no? ", "fine."]
    return {c: [(r.choice([None, 0, 1, 2, 3, 5]), r.choice(["user", "assistant", "system", "tool", None]), r.choice([*texts, None])) for _ in range(r.randint(0, 3))] for c in range(count)}


@pytest.mark.parametrize("seed", [1, 2])
def test_plans_are_the_cheapest(spark, seed):
    given = conversations(seed, 40)
    frame = spark.createDataFrame([(c, *row) for c, own in given.items() for row in own], SCHEMA)
    rows = chat_repair.judged(frame)
    plans = chat_repair.plan(rows)
    turns = defaultdict(list)
    for r in sorted(chat_repair.repaired(rows, plans).collect(), key=lambda r: (r.conv_id, r.seq)):
        turns[r.conv_id].append(f"{r.role}:{r.text}")
    digests = {r.conv_id: r.digest for r in chat_repair.digests(chat_repair.repaired(rows, plans)).collect()}
    got = {r.conv_id: (r.cost, r.audit) for r in plans.collect()}
    assert set(got) == {c for c, own in given.items() if own}
    for c in got:
        cost, audit, lines = cheapest(ordered(given[c]))
        assert (got[c], turns[c]) == ((cost, audit), lines), given[c]
        assert digests.get(c) == (hashlib.sha256("\n".join(lines).encode()).hexdigest() if lines else None)
    judged = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: (r.conv_id, r["at"])):
        judged[r.conv_id].append(r.fault)
    assert dict(judged) == {c: faults(ordered(own)) for c, own in given.items() if own}


def test_long_and_short_conversations_share_no_stack_but_agree():
    r = random.Random(5)
    stack = [bytes(r.choice([0, 1, 2, 3, 5, 6, 9, 10]) for _ in range(n)) for n in (1, 2, 3, 40, 400)]
    costs, audits = chat_repair.edits_of(stack)
    for own, cost, audit in zip(stack, costs, audits):
        alone = chat_repair.edits_of([own])
        assert (alone[0][0], alone[1][0]) == (cost, audit)
        assert len(audit.replace(b"I", b"")) == len(own)


def odd_table():
    rows = [
        (1, 0, "user", "Hello."), (1, 1, "assistant", "Hi."),
        (2, None, "user", None), (2, 0, None, "x."), (2, 0, None, "x."), (2, 7, "", "y."),
        (None, 0, "user", "a."), (None, 0, "user", "a."), (None, None, "assistant", "b"),
        (3, 0, "user", "w " * 60_000), (3, 1, "assistant", "é\U0001f600."),
    ]
    return rows + [(10 + c, t, ("system" if not t else ("user", "assistant")[t % 2 == 0]), f"{c} says {t}." if (c + t) % 5 else "\n") for c in range(60) for t in range(c % 9)] + [(5, t, "user", "a third of all rows.") for t in range(300)]


def test_query_equals_its_sql(spark, tmp_path):
    spark.createDataFrame([(*r, "extra", 1) for r in odd_table()], SCHEMA + ", look string, at int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat_repair.op12_chat_repair(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(chat_repair.OP12_SQL)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall())) and got.columns == list(want.columns)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert chat_repair.op12_chat_repair(spark, str(tmp_path)).collect() == []


def test_all_rows_dropped(spark, tmp_path):
    rows = [(c, t, "user", "x.") for c in range(200) for t in (3,)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat_repair.op12_chat_repair(spark, str(tmp_path)).collect()}
    gone = [r for r in got.values() if not r.audit]
    assert len(got) == 200 and gone
    assert all((r.cost, r.gaps, r.illegal, r.repaired_sha256) == (0, 0, 0, hashlib.sha256(b"").hexdigest()) for r in gone)
