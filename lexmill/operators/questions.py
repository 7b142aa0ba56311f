"""Synthetic questions, training splits and batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import words

#: Question templates.
TEMPLATES = (
    "ई बारे में बताईं कि {snippet}?",
    "{snippet} के बारे में का जानकारी बा?",
    "{snippet} का ह?",
    "ई के बारे में समझाईं: {snippet}",
    "{snippet} कइसे होला?",
    "{snippet} काहे जरूरी बा?",
    "{snippet} क्या है?",
    "{snippet} के बारे में बताइए।",
    "{snippet} कैसे होता है?",
    "{snippet} क्यों महत्वपूर्ण है?",
)


def draw(name: str, *key: Column, below: Column | int, seed: int = 42) -> Column:
    """A reproducible draw from 0 to ``below`` - 1 for each key: no order, no state between rows."""
    digest = F.md5(F.concat_ws("|", *(k.cast("string") for k in key), F.lit(str(seed)), F.lit(name)))
    below = F.lit(below) if isinstance(below, int) else below
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), below).cast("int")


def from_templates(chunks: DataFrame, per_chunk: int = 2, templates: Iterable[str] = TEMPLATES, seed: int = 42) -> DataFrame:
    """``per_chunk`` questions for each chunk of five words or more: a snippet of 3 to 8 words in a template."""
    templates = list(templates)
    c = chunks.withColumn("w", words(F.col("text"))).where(F.size("w") >= 5)
    c = c.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(per_chunk))))
    key = (F.col("chunk_id"), F.col("i"))
    c = c.withColumn("n", F.least(draw("len", *key, below=6, seed=seed) + 3, F.size("w")))
    c = c.withColumn("at", draw("at", *key, below=F.size("w") - F.col("n") + 1, seed=seed))
    template = F.element_at(F.array(*map(F.lit, templates)), draw("template", *key, below=len(templates), seed=seed) + 1)
    snippet = F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ")
    return c.select(F.replace(template, F.lit("{snippet}"), snippet).alias("question"), F.col("text").alias("answer"), "chunk_id", "source", "i")


def parse_reply(reply: Column, most: int) -> Column:
    """Questions of a model's reply: its first lines, without their numbering."""
    lines = F.slice(F.split(F.trim(reply), "\n"), 1, most)
    bare = F.transform(lines, lambda q: F.regexp_replace(F.trim(q), r"^[0-9.\-) ]+", ""))
    return F.filter(bare, lambda q: q != "")


def from_model(chunks: DataFrame, client: Callable[[str, int], str], per_chunk: int = 2) -> DataFrame:
    """Questions by a model; a chunk whose call fails gives none."""

    def ask(batches):
        for pdf in batches:
            replies = []
            for text in pdf["text"]:
                try:
                    replies.append(client(text, per_chunk))
                except Exception:  # noqa: BLE001  any failure of a client skips the chunk
                    replies.append("")
            yield pd.DataFrame({"answer": pdf["text"], "chunk_id": pdf["chunk_id"], "source": pdf["source"], "reply": replies})

    replies = chunks.select("text", "chunk_id", "source").mapInPandas(ask, "answer string, chunk_id string, source string, reply string")
    return replies.select(F.explode(parse_reply(F.col("reply"), per_chunk)).alias("question"), "answer", "chunk_id", "source")


def generate(chunks: DataFrame, method: str = "template", **options) -> DataFrame:
    if method == "template":
        return from_templates(chunks, **options)
    if method == "llm":
        return from_model(chunks, **options)
    raise ValueError(f"Unknown QA generation method: {method}")


def split(pairs: DataFrame, ordinal: str, total: int, eval_fraction: float = 0.1) -> DataFrame:
    """Adds ``part``: train up to ``max(1, int(total * (1 - eval_fraction)))`` rows by position, then eval."""
    return pairs.withColumn("part", F.when(F.col(ordinal) < max(1, int(total * (1 - eval_fraction))), "train").otherwise("eval"))


def positives(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("question").alias("anchor"), F.col("answer").alias("positive"))


def in_batch_negatives(pairs: DataFrame, ordinal: str, batch_size: int = 16) -> DataFrame:
    """(anchor, negative) positions: each anchor against the other answers of its batch."""
    left = pairs.select(F.floor(F.col(ordinal) / batch_size).alias("batch"), F.col(ordinal).alias("anchor"))
    return left.join(left.select("batch", F.col("anchor").alias("negative")), "batch").where("anchor <> negative")


def schedule(rows: int, batch_size: int = 16, epochs: int = 5, warmup_ratio: float = 0.1) -> dict[str, int]:
    steps = math.ceil(rows / batch_size) * epochs
    return {"total_steps": steps, "warmup_steps": int(steps * warmup_ratio)}
