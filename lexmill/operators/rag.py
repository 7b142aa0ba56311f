"""Prompts and answers over retrieved passages."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.text import preview
from .retrievers import Retriever

#: Instructions of the three prompts; passages and question follow.
INSTRUCTIONS = {
    "grounded_qa": "Answer in Bhojpuri, using only the passages below. If they do not hold the answer, say so.",
    "chain_of_thought": "Work through the passages below step by step, then answer the question in Bhojpuri.",
    "hindi_bridge": "Understand the passages through Hindi first, then answer the question in Bhojpuri.",
}


class LLM(Protocol):
    def generate(self, prompt: str) -> str: ...

    def get_model_name(self) -> str: ...


class CallableLLM:
    """A model behind a function; a failing call becomes text, it is never raised."""

    def __init__(self, call: Callable[[str], str], name: str):
        self.call, self.name = call, name

    def generate(self, prompt: str) -> str:
        try:
            return self.call(prompt)
        except Exception as e:  # noqa: BLE001  any failure of a backend is answered
            return f"[Generation Error: {e}]"

    def get_model_name(self) -> str:
        return self.name


def _api_call(model: str, base_url: str | None, temperature: float, max_tokens: int) -> Callable[[str], str]:
    import os

    key = os.environ.get("OPENAI_API_KEY") or os.environ.get("GOOGLE_API_KEY")
    if not key:
        raise ValueError("no API key: set OPENAI_API_KEY or GOOGLE_API_KEY")

    def call(prompt: str) -> str:
        from openai import OpenAI

        client = OpenAI(api_key=key, base_url=base_url)
        reply = client.chat.completions.create(model=model, messages=[{"role": "user", "content": prompt}], temperature=temperature, max_tokens=max_tokens)
        return reply.choices[0].message.content.strip()

    return call


def _local_call(model: str, quantization: str | None, max_tokens: int, temperature: float, device: str) -> Callable[[str], str]:
    held: list = []

    def call(prompt: str) -> str:
        if not held:  # loaded on first use
            from transformers import pipeline

            options = {"load_in_4bit": True} if quantization == "4bit" else {"load_in_8bit": True} if quantization == "8bit" else {}
            held.append(pipeline("text-generation", model=model, device_map=device, model_kwargs=options))
        return held[0](prompt, max_new_tokens=max_tokens, temperature=temperature, do_sample=temperature > 0, return_full_text=False)[0]["generated_text"].strip()

    return call


def get_llm(backend: str = "api", model: str | None = None, api_base_url: str | None = None, temperature: float = 0.3, max_tokens: int = 512, quantization: str | None = None, device: str = "auto") -> LLM:
    if backend == "api":
        name = model or "gemini-1.5-flash"
        return CallableLLM(_api_call(name, api_base_url, temperature, max_tokens), name)
    if backend == "local":
        name = model or "meta-llama/Meta-Llama-3-8B-Instruct"
        return CallableLLM(_local_call(name, quantization, max_tokens, temperature, device), name)
    raise ValueError(f"Unknown LLM backend: {backend}")


def prompt(template: str, question: Column, passages: Column) -> Column:
    """passages: array of texts in rank order, numbered from 1."""
    if template not in INSTRUCTIONS:
        raise ValueError(f"Unknown prompt template: {template}")
    numbered = F.transform(passages, lambda text, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), text))
    return F.concat(F.lit(INSTRUCTIONS[template] + "\n\n"), F.array_join(numbered, "\n\n"), F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def contexts(hits: DataFrame) -> DataFrame:
    """(query, sources): chunk_id, score, rank and text of each query's hits, by rank."""
    row = F.struct("rank", "chunk_id", "score", "text")
    return hits.groupBy("query").agg(F.sort_array(F.collect_list(row)).alias("sources"))


class Generator:
    def __init__(self, retriever: Retriever, llm: LLM | None = None, template: str = "grounded_qa", top_k: int = 5):
        self.retriever, self.llm, self.template, self.top_k = retriever, llm, template, top_k

    def set_llm(self, llm: LLM) -> None:
        self.llm = llm

    def set_retriever(self, retriever: Retriever) -> None:
        self.retriever = retriever

    def prompts(self, queries: DataFrame, top_k: int | None = None, template: str | None = None) -> DataFrame:
        """query, text, sources, prompt: retrieval alone, without a model."""
        hits = contexts(self.retriever.retrieve(queries, top_k or self.top_k))
        rows = queries.select("query", "text").join(hits, "query", "left")
        none = F.array().cast(hits.schema["sources"].dataType)
        rows = rows.withColumn("sources", F.coalesce("sources", none))
        return rows.withColumn("prompt", prompt(template or self.template, F.col("text"), F.transform("sources", lambda s: s["text"])))

    def generate(self, queries: DataFrame, top_k: int | None = None, template: str | None = None) -> DataFrame:
        """A response row for each query."""
        if self.llm is None:
            raise RuntimeError("No LLM configured. Use set_llm().")
        llm = self.llm

        def answer(batches):
            for batch in batches:
                answers = [llm.generate(p) for p in batch.column("prompt").to_pylist()]
                yield batch.append_column("answer", pa.array(answers, pa.string()))

        made = self.prompts(queries, top_k, template)  # retrieved once: its columns go through the model's step
        answered = made.mapInArrow(answer, StructType(list(made.schema.fields)).add("answer", StringType()))
        return responses(answered, llm.get_model_name(), self.retriever.name)


def responses(rows: DataFrame, model: str, retriever: str) -> DataFrame:
    """The record that is logged: sources with previews of their texts."""
    sources = F.transform("sources", lambda s: F.struct(s["chunk_id"].alias("chunk_id"), s["score"].alias("score"), s["rank"].alias("rank"), preview(s["text"]).alias("text_preview")))
    return rows.select(F.col("query").alias("query_id"), F.col("text").alias("query"), "answer", F.lit(model).alias("model"), F.lit(retriever).alias("retriever"), F.size("sources").alias("num_sources"), sources.alias("sources"), "prompt")


def first_queries(queries: DataFrame, ordinal: str = "query", most: int = 50) -> DataFrame:
    """A batch answers the first ``most`` queries."""
    return queries.orderBy(ordinal).limit(most)


def interactive(generator: Generator, read: Callable[[], str], write: Callable[[str], None], k: int = 3) -> None:
    """Asks until quit, exit or q."""
    spark = generator.retriever._checked().sparkSession
    while (line := read().strip()) and line.lower() not in ("quit", "exit", "q"):
        q = spark.createDataFrame([("q", line)], "query string, text string")
        if generator.llm is not None:
            write(generator.generate(q, k).first()["answer"])
        else:
            for row in generator.retriever.retrieve(q, k).orderBy("rank").collect():
                write(f"{row['rank']}. [{row['score']:.4f}] {row['text'][:200]}")
