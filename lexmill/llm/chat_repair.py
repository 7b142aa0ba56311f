"""Repair of a conversation's structure by a cheapest series of edits.

A conversation is repaired when the initials of its roles read ``(s?(ua)+)?``.  Rows are taken by
(turn, role, text), nulls first.  A row's first fault counts: blank (nothing but white space), duplicate
(role and text seen earlier in the conversation), truncated (doesn't end in ``.``, ``!`` or ``?``).
Edits and costs: Keep 0, Rerole to user or assistant 3, Delete 4 (blank and duplicate rows must go),
Insert an empty text of user or assistant 3; a truncated row that stays adds 3.  Among the cheapest series
the one whose initials come first in ASCII is taken.

Four states (nothing, after s, after u, after a) are all that an edit needs to know, and a state says
which role a Rerole or an Insert has.  Conversations of about equal length are stacked into an array of
time x conversation; costs from a row to the end are taken backwards for all conversations and states at
once and stored, then the edits are traced forwards, again for all at once.

A conversation's texts are never held: rows are sorted by conversation and streamed, once to number and
judge them, once to meet their edits.  What is held of a conversation while its edits are found is 5 bytes
a row and, in the arrays, about 40 (``_CELLS`` bounds the arrays of many conversations; the edits of one
conversation, a letter each, are one row of the result anyway).

Null roles and texts count as one space.  A null conv_id is a conversation of its own; repeated rows are
duplicates; an empty table gives an empty result; other columns are never read.  A role without a letter
fits no state.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import Shelf, table

ROLES = ("user", "assistant")
_SPACE = "\\x20\\x09-\\x0D"
_CELLS = 1 << 21  # rows of one stack of conversations, unless it is a single one
_FAR = 1 << 28
#: Costs of the edits.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# the state after the next role: nothing or s or a -> u, u -> a
_NEXT = np.array([2, 2, 3, 2])
# the state after a kept row of initial s, u, a or another; -1 where it doesn't fit
_KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])


def judged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``at`` (position from 0), ``turn``, ``role``, ``text``, ``initial`` and ``fault`` (0 none, 1 blank, 2 duplicate, 3 truncated)."""
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    df = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    fault = F.when(~F.rlike("text", F.lit(f"[^{_SPACE}]")), 1).when(F.rlike("text", F.lit(f"[.!?][{_SPACE}]*\\z")), 0).otherwise(3)
    df = df.withColumns({"look": F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")), "fault": fault.cast("byte")})
    kind = {r.name: r.dataType.simpleString() for r in df.schema}

    def run(batches):
        now, at, seen = (), 0, set()
        for batch in batches:
            numbers, faults = [], batch.column("fault").to_pylist()
            for i, (conv, look) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("look").to_pylist())):
                if (conv,) != now:
                    now, at, seen = (conv,), 0, set()
                mark = bytes.fromhex(look)
                if mark in seen:
                    faults[i] = faults[i] if faults[i] == 1 else 2
                seen.add(mark)
                numbers.append(at)
                at += 1
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(numbers, pa.int64()), batch.column("turn"), batch.column("role"), batch.column("text"), pa.array(faults, pa.int8())], names=["conv_id", "at", "turn", "role", "text", "fault"])

    dealt = df.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    found = dealt.mapInArrow(run, f"conv_id long, at long, turn long, role {kind['role']}, text {kind['text']}, fault byte")
    return found.withColumn("initial", F.substring("role", 1, 1))


def edits_of(stack: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Costs and edits of conversations whose rows are bytes: initial (0 s, 1 u, 2 a, 3 other) + 4 * (1 must go, 2 truncated)."""
    n, longest = len(stack), max(map(len, stack))
    sizes = np.fromiter(map(len, stack), np.int64, n)
    codes = np.full((longest, n), 255, np.uint8)
    for i, own in enumerate(stack):
        codes[: len(own), i] = np.frombuffer(own, np.uint8)
    # costs from each row to the end; the row after the last may end in nothing or after a
    after = np.full((longest + 1, 4, n), _FAR, np.int32)
    end = np.full((4, n), _FAR, np.int32)
    end[0], end[3] = 0, 0
    for t in range(longest, -1, -1):
        best = end.copy()
        if t < longest:
            row = _row_costs(codes[t], after[t + 1])
            best = np.where(t < sizes, row.min(0), end)
        for _ in range(2):  # at most two inserts in a row
            best = np.minimum(best, INSERT + best[_NEXT])
        after[t] = best
    letters: list[np.ndarray] = []
    state, place, every = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    costs = after[0, 0].astype(np.int64)
    # D, I, K and R in this order: the first letter that keeps the cost is taken
    while True:
        live = (place < sizes) | ((state != 0) & (state != 3)) | (after[place, state, every] > 0)
        if not live.any():
            break
        have, here = place < sizes, after[place, state, every]
        then = after[np.minimum(place + 1, longest), :, every].T
        row = _row_costs(codes[np.minimum(place, longest - 1), every], then, state) if longest else np.full((3, n), _FAR)
        insert = INSERT + after[place, _NEXT[state], every]
        options = np.array([np.where(have, row[0], _FAR), insert, np.where(have, row[1], _FAR), np.where(have, row[2], _FAR)])
        choice = np.argmax(options == here, 0)
        letters.append(np.where(live, np.frombuffer(b"DIKR", np.uint8)[choice], 0))
        code = np.where(have, codes[np.minimum(place, longest - 1), every] & 3, 3) if longest else np.full(n, 3)
        moved = np.where(choice == 0, state, np.where(choice == 2, _KEEP[state, code], _NEXT[state]))
        state, place = np.where(live, moved, state), np.where(live & (choice != 1), place + 1, place)
    traced = np.array(letters, np.uint8).reshape(-1, n)
    return costs, [own[own > 0].tobytes() for own in traced.T]


def _row_costs(codes: np.ndarray, after: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """Costs of Delete, Keep and Rerole of a row in each state (or in the one given), with all that follows."""
    initial, must_go, extra = codes & 3, (codes >> 2) & 1 == 1, np.where((codes >> 3) & 1 == 1, TRUNCATED, 0)
    every = np.arange(len(codes))
    out = np.full((3, 4, len(codes)), _FAR, np.int32)
    for s in range(4):
        to = _KEEP[s, initial]
        out[0, s] = DELETE + after[s]
        out[1, s] = np.where(must_go | (to < 0), _FAR, extra + after[to, every])
        out[2, s] = np.where(must_go, _FAR, RENAME + extra + after[_NEXT[s]])
    return out if state is None else out[:, state, every]


def plan(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``cost`` and ``audit`` of each conversation of ``judged`` rows, with its counts of faults."""
    code = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in (("s", 0), ("u", 1), ("a", 2)) for x in pair)), F.col("initial")), F.lit(3))
    code = code + F.when(F.col("fault").isin(1, 2), 4).when(F.col("fault") == 3, 8).otherwise(0)

    def solve(group):
        sizes = np.array([len(c) for _, c in group])
        costs, audits = np.zeros(len(group), np.int64), [b""] * len(group)
        order, start = np.argsort(sizes, kind="stable"), 0
        while start < len(order):  # about equal lengths share a stack
            end = start + 1
            while end < len(order) and sizes[order[end]] <= 2 * sizes[order[start]] + 8 and (end - start + 1) * sizes[order[end]] <= _CELLS:
                end += 1
            own = order[start:end]
            costs[own], found = edits_of([group[i][1] for i in own])
            for i, audit in zip(own, found):
                audits[i] = audit
            start = end
        return pa.RecordBatch.from_pydict({"conv_id": pa.array([c for c, _ in group], pa.int64()), "cost": pa.array(costs), "audit": pa.array([a.decode() for a in audits])})

    def run(batches):
        group, held, now, codes = [], 0, (), bytearray()
        for batch in batches:
            for conv, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (conv,) != now:
                    if now:
                        group.append((now[0], bytes(codes)))
                        held += len(codes)
                    if held > _CELLS:
                        yield solve(group)
                        group, held = [], 0
                    now, codes = (conv,), bytearray()
                codes.append(own)
        if now:
            yield solve([*group, (now[0], bytes(codes))])

    light = rows.select("conv_id", code.cast("byte").alias("code"), "at").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return light.select("conv_id", "code").mapInArrow(run, "conv_id long, cost long, audit string")


def _steps(plans: DataFrame) -> DataFrame:
    """``conv_id``, ``at``, ``edits``: the edits of each row with the inserts before it; those at the end have a row of their own."""

    def run(batches):
        for batch in batches:
            for conv, audit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, held, out = 0, bytearray(), []
                for letter in audit.encode():
                    held.append(letter)
                    if letter != ord("I"):
                        out.append((conv, at, held.decode()))
                        at, held = at + 1, bytearray()
                    if len(out) >= 1 << 16:
                        yield _step_batch(out)
                        out = []
                if held:
                    out.append((conv, at, held.decode()))
                if out:
                    yield _step_batch(out)

    return plans.select("conv_id", "audit").mapInArrow(run, "conv_id long, at long, edits string")


def _step_batch(rows: list[tuple]) -> pa.RecordBatch:
    conv, at, edits = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(at, pa.int64()), pa.array(edits)], names=["conv_id", "at", "edits"])


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``conv_id``, ``seq`` (from 0), ``role`` and ``text`` of the repaired conversations; a conversation's rows come in order in one partition."""
    steps = _steps(plans).select("conv_id", "at", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "edits")
    both = steps.unionByName(rows.select("conv_id", "at", "role", "text", F.lit(None).cast("string").alias("edits")))

    def run(batches):
        now, seq, last, edits = (), 0, "", ""
        for batch in batches:
            out: list[tuple] = []

            def put(role, text):
                nonlocal seq, last
                out.append((now[0], seq, role, text))
                seq, last = seq + 1, role[:1]

            turn = lambda: ROLES[last == "u"]  # noqa: E731  the role that comes next
            for conv, role, text, told in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "edits"))):
                if (conv,) != now:
                    now, seq, last, edits = (conv,), 0, "", ""
                if told is not None:  # comes before its row
                    for _ in range(told.count("I")):
                        put(turn(), "")
                    edits = told[-1]
                elif edits == "K":
                    put(role, text)
                elif edits == "R":
                    put(turn(), text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["conv_id", "seq", "role", "text"])

    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "at", F.asc_nulls_last("edits"))
    return ordered.select("conv_id", "role", "text", "edits").mapInArrow(run, "conv_id long, seq long, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id`` and the SHA-256 of ``role:text`` lines of what ``repaired`` gives, taken as it streams by."""

    def run(batches):
        now, state = (), None
        for batch in batches:
            done = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if (conv,) != now:
                    if now:
                        done.append((now[0], state.hexdigest()))
                    now, state = (conv,), hashlib.sha256(f"{role}:{text}".encode())
                else:
                    state.update(f"\n{role}:{text}".encode())
            if done:
                yield _digest_batch(done)
        if now:
            yield _digest_batch([(now[0], state.hexdigest())])

    return turns.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, digest string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    conv, digest = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(digest)], names=["conv_id", "digest"])


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id`` with ``gaps``, ``blank``, ``duplicate``, ``truncated`` and ``illegal`` of ``judged`` rows."""
    count = lambda k: F.count(F.when(F.col("fault") == k, 1))
    # distinct turns are counted over partial groups first, so a long conversation's rows don't meet
    turns = rows.groupBy("conv_id", "turn").agg(count(1).alias("blank"), count(2).alias("duplicate"), count(3).alias("truncated"))
    per = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated"))
    )
    # neighbours meet by position: a row under its own place and under the one before
    places = rows.select("conv_id", F.explode(F.array(F.struct(F.col("at").alias("pair"), F.lit(0).alias("side")), F.struct((F.col("at") - 1).alias("pair"), F.lit(1).alias("side")))).alias("p"), "initial").select("conv_id", "p.*", "initial").where("pair >= 0")
    pairs = places.groupBy("conv_id", "pair").agg(F.max(F.when(F.col("side") == 0, F.col("initial"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("initial"))).alias("b")).where("a is not null and b is not null")
    wrong = pairs.groupBy("conv_id").agg(F.count(F.when(~F.concat("a", "b").isin("su", "ua", "au"), 1)).alias("illegal"))
    return _by_conversation(per, wrong).select("conv_id", "gaps", "blank", "duplicate", "truncated", F.coalesce("illegal", F.lit(0).cast("long")).alias("illegal"))


def _by_conversation(left: DataFrame, right: DataFrame) -> DataFrame:
    """A left join in which null is a conversation like any other."""
    return left.alias("l").join(right.withColumnRenamed("conv_id", "_conv").alias("r"), F.col("l.conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` with one row in four spoilt, by the checksum of ``conv_id:turn`` (nulls: one space)."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), shown(role_col).alias("role"), shown(text_col).alias("text"), (F.crc32(F.concat(shown(conv_col), F.lit(":"), shown(turn_col))) % 20).alias("_d"))
    rows = rows.where("_d <> 0").withColumn("text", F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, shelf = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), Shelf(spark)
    rows = shelf.put(judged(damaged(turns)), "rows")
    plans = shelf.put(plan(rows), "plans")
    found = _by_conversation(turns.select(F.col("conv_id").cast("long")).distinct(), faults(rows))
    found = _by_conversation(_by_conversation(found, plans), digests(repaired(rows, plans)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return found.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


#: CRC-32 of the ASCII key, bit by bit, and its remainder.
CRC = """
bytes as (select key, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))) as b from (select distinct key from h)),
crc as (
  select key, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(b, lambda x: x::bigint)), lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end)), 4294967295) % 20 as k
  from bytes)"""


#: Edits as a relation: a forward search over (row, state) keeps the cheapest and least series of each.
OP12_SQL = r"""
with recursive h as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
""" + CRC + r""",
d as (
  select h.conv_id, turn, case when k = 4 then 'user' else role end as role,
         case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when k = 3 then [0, 1] else [0] end) as copy
  from h join crc using (key) where k <> 0),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as pos from d),
r as (
  select conv_id, pos, turn, role, text, substr(role, 1, 1) as initial,
         case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1 when row_number() over (partition by conv_id, role, text order by pos) > 1 then 2
              when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 3 else 0 end as fault
  from n),
edit(letter, s, initial, to_, base) as (values
  ('D', 0, '', 0, 4), ('D', 1, '', 1, 4), ('D', 2, '', 2, 4), ('D', 3, '', 3, 4),
  ('K', 0, 's', 1, 0), ('K', 0, 'u', 2, 0), ('K', 1, 'u', 2, 0), ('K', 3, 'u', 2, 0), ('K', 2, 'a', 3, 0),
  ('R', 0, '', 2, 3), ('R', 1, '', 2, 3), ('R', 3, '', 2, 3), ('R', 2, '', 3, 3)),
added(s, to_, letters, lines) as (values
  (0, 0, '', []::varchar[]), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']), (3, 2, 'I', ['user:']), (2, 3, 'I', ['assistant:']),
  (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:']), (3, 3, 'II', ['user:', 'assistant:']), (2, 2, 'II', ['assistant:', 'user:'])),
dp as (
  select c.conv_id, 0::bigint as i, to_ as s, 3 * length(letters)::bigint as c, letters as a, lines as t from (select distinct conv_id from r) c, added where s = 0
  union all
  select conv_id, i, s, c, a, t from (
    select m.conv_id, m.i, x.to_ as s, m.c + 3 * length(letters) as c, m.a || letters as a, list_concat(m.t, lines) as t,
           row_number() over (partition by m.conv_id, m.i, x.to_ order by m.c + 3 * length(letters), m.a || letters) as best
    from (select dp.conv_id, dp.i + 1 as i, e.to_ as s, dp.c + base + case when letter <> 'D' and fault = 3 then 3 else 0 end as c, dp.a || letter as a,
                 case letter when 'D' then dp.t when 'K' then list_append(dp.t, role || ':' || text) else list_append(dp.t, case when e.to_ = 2 then 'user:' else 'assistant:' end || text) end as t
          from dp join r on r.conv_id is not distinct from dp.conv_id and r.pos = dp.i
          join edit e on e.s = dp.s and (letter = 'D' or fault not in (1, 2)) and (letter <> 'K' or e.initial = r.initial)) m
    join added x on x.s = m.s)
  where best = 1),
ends as (
  select conv_id, c, a, t from dp join (select conv_id as conv, max(pos) + 1 as size from r group by all) z on z.conv is not distinct from dp.conv_id and z.size = dp.i
  where s in (0, 3) qualify row_number() over (partition by conv_id order by c, a) = 1),
pairs as (select conv_id, lag(initial) over (partition by conv_id order by pos) || initial as pair from r),
wrong as (select conv_id, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from pairs group by conv_id),
f as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated from r group by conv_id)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
       coalesce(illegal, 0)::bigint as illegal, coalesce(c, 0)::bigint as cost, coalesce(a, '') as audit, sha256(coalesce(array_to_string(t, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join f on f.conv_id is not distinct from o.conv_id left join wrong on wrong.conv_id is not distinct from o.conv_id left join ends on ends.conv_id is not distinct from o.conv_id
"""
