"""Chat formatting with Spark expressions only.

A conversation's turn structs are collected and sorted; adjacent turns of one role become one block:

    ### role ###
    text</turn>text of the next turn of the same role</turn>
    ### other role ###
    text</turn>

Control strings inside roles and texts are escaped by a backslash: every backslash, the slash of
``</turn>``, and each ``#`` after two others, so that neither ``</turn>`` nor ``###`` can occur in
escaped text, and ``\\x`` reads back as ``x``.  The loss mask is the spans of assistant texts, without
their end marks.

Turns sort by (turn, role, text), nulls first, so ties and repeated rows have one result; a null text
is empty, a null role is an empty role that merges with its like; a null conv_id is a conversation of
its own; an empty table gives an empty result; other columns are never read.  A conversation is one
output row, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import running_sums, table

END = "</turn>"
_SLAB = 8192


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\|(?<=<)/(?=turn>)|(?<=##)#)", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\/#])", "$1")


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss`` (array of start, end in code points of ``formatted``)."""
    row = F.struct(F.col(turn_col).alias("turn"), escape(F.coalesce(F.col(role_col), F.lit(""))).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    c = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("t"))
    # where each block begins, and where the next one does
    c = c.withColumn("first", F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.element_at("t", i)["role"] != F.get("t", F.greatest(i - 2, F.lit(0)))["role"])))
    after = lambda i: F.coalesce(F.get("first", i + 1), F.size("t") + 1)
    block = lambda at, i: F.struct(
        F.concat(F.when(i > 0, F.lit("\n")).otherwise(F.lit("")), F.lit("### "), F.element_at("t", at)["role"], F.lit(" ###\n")).alias("head"),
        (F.element_at("t", at)["role"] == escape(F.lit(loss_role))).alias("loss"),
        F.transform(F.slice("t", at, after(i) - at), lambda t: escape(t["text"])).alias("texts"),
    )
    c = c.withColumn("blocks", F.transform("first", block))
    text = F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(b["texts"], END), F.lit(END))), "")
    piece = lambda b: F.transform(b["texts"], lambda t, i: F.struct(F.when(i == 0, F.length(b["head"])).otherwise(0).alias("head"), F.length(t).alias("size"), b["loss"].alias("loss")))
    c = c.withColumn("pieces", F.flatten(F.transform("blocks", piece)))
    starts = running_sums(F.transform("pieces", lambda p: p["head"] + p["size"] + len(END)))
    spans = F.zip_with("pieces", starts, lambda p, at: F.struct((at + p["head"]).alias("start"), (at + p["head"] + p["size"]).alias("end"), p["loss"].alias("loss")))
    mask = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return c.select("conv_id", text.alias("formatted"), mask.alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """``conv_id``, ``turns`` (array of role, text) and ``loss_text`` from the formatted string alone."""
    blocks = F.filter(F.split("formatted", r"(?:^|\n)### "), lambda b: b != "")
    role = lambda b: unescape(F.substring_index(b, " ###\n", 1))
    rest = lambda b: F.substring(b, F.length(F.substring_index(b, " ###\n", 1)) + 6, F.length(b))
    texts = lambda b: F.split(rest(b), END, -1)
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(F.slice(texts(b), F.lit(1), F.size(texts(b)) - 1), lambda t: F.struct(role(b).alias("role"), unescape(t).alias("text")))))
    # a substring costs its place in the string, so spans are cut from slabs
    slabs = F.transform(F.sequence(F.lit(0), F.floor(F.length("formatted") / _SLAB).cast("int")), lambda i: F.substring(F.col("formatted"), i * _SLAB + 1, F.lit(_SLAB)))
    chats = chats.withColumn("slabs", slabs)
    slab = lambda at: F.floor(at / _SLAB).cast("int")
    cut = lambda s: F.substring(F.array_join(F.slice("slabs", slab(s["start"]) + 1, slab(s["end"]) - slab(s["start"]) + 1), ""), s["start"] - slab(s["start"]) * _SLAB + 1, s["end"] - s["start"])
    loss = F.array_join(F.transform("loss", lambda s: unescape(cut(s))), "")
    return chats.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql(r"select * from values (-7L, 0L, 'user'), (-7L, 1L, 'assistant') as t(conv_id, turn, role)").withColumn("text", F.lit(r"\### Assistant: </turn> ok"))
    back = read_back(formatted(turns.unionByName(planted)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (
  select *, length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
            + coalesce(list_sum(list_transform(regexp_extract_all(text, '###+'), lambda r: length(r) - 2)), 0) as added,
         lag(role) over (partition by conv_id order by turn, role, text) as before
  from t)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
       (sum(length(text) + added + 7) + sum(case when before is null or before <> role then 4 + length(role) + 5 + 1 else 0 end) - 1)::bigint as formatted_chars
from e group by conv_id
"""
