"""The steps of a study, from raw files to tables: what ``python -m lexmill`` runs."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import clean_text, preview
from ..operators import analysis, chunking, dedup, dense, questions, rag
from ..operators.bm25 import positions
from ..operators.evaluation import Evaluation, eval_set, evaluate
from ..operators.projection import Projection, own_rank
from ..operators.retrievers import CharBM25, Dense, Hybrid, Retriever, WordBM25, build  # noqa: F401
from ..runlog import RunLog
from ..schemas import CHUNK, QUESTION
from ..sources import files, reports
from ..store import new_folder, written


def prepare(spark: SparkSession, cfg: Config) -> DataFrame:
    """Raw files -> documents, chunks and corpus statistics under ``processed_dir``; returns the statistics."""
    d = cfg.data
    raw = files.load(spark, d.corpus_path)
    text = clean_text(F.col("text"), d.normalize_unicode, d.remove_urls, d.remove_emails, d.lowercase, d.transliteration.enabled)
    cleaned = dedup.first_long(raw.withColumn("text", text), least=d.min_doc_length)
    files.save_jsonl(cleaned.orderBy("ordinal").select("doc_id", "text", "source", "metadata"), f"{d.processed_dir}/documents.jsonl")
    kept = spark.read.schema("doc_id string, text string, source string, metadata map<string,string>").json(f"{d.processed_dir}/documents.jsonl")
    chunks = chunking.chunk(kept, d.chunking_method, d.chunk_size, d.chunk_overlap)
    files.save_jsonl(chunks, f"{d.processed_dir}/chunks.jsonl")
    stats = dedup.corpus_stats(raw, kept, load_chunks(spark, cfg))
    stats = stats.withColumns({"chunk_size": F.lit(d.chunk_size), "chunk_overlap": F.lit(d.chunk_overlap), "chunking_method": F.lit(d.chunking_method)})
    files.save_jsonl(stats.coalesce(1), f"{d.processed_dir}/corpus_stats.json")
    return stats


def load_chunks(spark: SparkSession, cfg: Config) -> DataFrame:
    """Chunks as they were written; missing metadata is empty."""
    chunks = spark.read.schema(CHUNK).json(f"{cfg.data.processed_dir}/chunks.jsonl").drop("ordinal")
    return chunks.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))


def make_questions(spark: SparkSession, cfg: Config, **client) -> DataFrame:
    """Chunks -> question pairs at ``qa_pairs_path``; returns a preview of 20."""
    q = cfg.qa_generation
    options = {"per_chunk": q.num_questions_per_chunk, **({"seed": cfg.experiment.seed} if q.method == "template" else client)}
    pairs = questions.generate(load_chunks(spark, cfg), q.method, **options)
    files.save_jsonl(pairs.select("question", "answer", "chunk_id", "source"), cfg.data.qa_pairs_path)
    return load_questions(spark, cfg).orderBy("chunk_id", "question").limit(20).withColumn("answer", preview(F.col("answer")))


def load_questions(spark: SparkSession, cfg: Config) -> DataFrame:
    return spark.read.schema(QUESTION).json(cfg.data.qa_pairs_path)


def train(spark: SparkSession, cfg: Config, encoder: dense.Encoder = dense.hashed_encoder) -> dict[str, float]:
    """Trains a projection of the encoder on the question pairs and saves it to ``training.output_dir``.

    Returns the loss of the first and last epoch, and the MRR of the eval part before and after.
    """
    t = cfg.training
    named = load_questions(spark, cfg).select(F.struct("chunk_id", "question", "answer").alias("doc")).distinct()
    pairs = written(positions(named).select((F.col("at") - 1).alias("ordinal"), "doc.*"), new_folder(spark, "pairs"))
    pairs = questions.split(pairs, "ordinal", pairs.count(), t.eval_fraction)

    def vectors(part: str, use: dense.Encoder) -> DataFrame:
        own = pairs.where(F.col("part") == part)
        coded = lambda c, name: dense.encode(own.select("ordinal", F.col(c).alias("text")), use).select("ordinal", F.col("embedding").alias(name))
        return coded("question", "anchor").join(coded("answer", "positive"), "ordinal")

    made = Projection.train(vectors("train", encoder), batch_size=t.batch_size, epochs=t.epochs, learning_rate=t.learning_rate, warmup_ratio=t.warmup_ratio, seed=cfg.experiment.seed)
    made.save(spark, t.output_dir)
    before, after = (own_rank(vectors("eval", use)).first()["mrr"] for use in (encoder, made.encoder(encoder)))
    return {"first_loss": made.epoch_losses[0], "last_loss": made.epoch_losses[-1], "mrr_before": before, "mrr_after": after}


def tuned_encoder(spark: SparkSession, cfg: Config, encoder: dense.Encoder = dense.hashed_encoder) -> dense.Encoder | None:
    """The encoder with the projection that ``train`` saved; None where there is none."""
    path = cfg.training.output_dir
    return Projection.load(spark, path).encoder(encoder) if files.exists(spark, path) else None


def retrievers(cfg: Config, sparse_only: bool = False, encoder: dense.Encoder = dense.hashed_encoder, tuned: dense.Encoder | None = None) -> dict[str, Retriever]:
    """word and char BM25, dense search (base and fine-tuned) and their fusion."""
    s, h, v = cfg.sparse, cfg.hybrid, cfg.dense
    char = CharBM25(s.ngram_range, s.bm25_k1, s.bm25_b)
    out: dict[str, Retriever] = {"word_bm25": WordBM25(s.bm25_k1, s.bm25_b), "char_ngram_bm25": char}
    if not sparse_only:
        vectors = {"normalize": v.normalize_embeddings, "index_type": v.index_type, "nlist": v.nlist, "nprobe": v.nprobe}
        out["dense_zeroshot"] = best = Dense(encoder, v.model_name, name="dense_zeroshot", **vectors)
        if tuned is not None:
            out["dense_finetuned"] = best = Dense(tuned, cfg.training.output_dir, name="dense_finetuned", **vectors)
        weights = [h.sparse_weight, h.dense_weight] if h.method == "weighted" else None
        out["hybrid"] = Hybrid([char, best], weights, h.method, h.rrf_k)
    return out


def opened(made: dict[str, Retriever], chunks: DataFrame, index_dir: str | None) -> dict[str, Retriever]:
    """Each retriever with the index that ``build_indices`` saved for it, or with a new one where there is none."""
    spark = chunks.sparkSession
    for name, r in made.items():
        if not isinstance(r, Hybrid) and index_dir and files.exists(spark, f"{index_dir}/{name}"):
            r.load(spark, f"{index_dir}/{name}")
        elif not r.is_indexed:
            r.index(chunks)
    return made


def build_indices(spark: SparkSession, cfg: Config, path: str, probe: str | None = None, **options) -> DataFrame | None:
    """Saves every index; with ``probe``, returns what the character index finds."""
    chunks = load_chunks(spark, cfg)
    for name, r in retrievers(cfg, **options).items():
        if not isinstance(r, Hybrid):
            r.index(chunks).save(f"{path}/{name}")
    return CharBM25().load(spark, f"{path}/char_ngram_bm25").retrieve_one(probe, 3) if probe else None


def evaluate_all(spark: SparkSession, cfg: Config, log: RunLog | None = None, k: int = 10, index_dir: str | None = None, **options) -> Evaluation:
    """Metrics, details, error analysis and ablation under ``results_dir``; saved indexes are searched where there are some."""
    out, chunks = cfg.evaluation.results_dir, load_chunks(spark, cfg)
    queries, gold = eval_set(load_questions(spark, cfg), "chunk_id", "question")
    made = opened(retrievers(cfg, **options), chunks, index_dir)
    done = evaluate(made, queries, gold, k)
    names = [f"{m}@{k}" for m in ("mrr", "recall", "ndcg", "precision")] + ["map"]
    totals = done.metrics().persist()
    reports.aggregate_csv(totals, names, f"{out}/aggregate_results")
    if cfg.evaluation.save_per_query:
        reports.details_json(done.per_query(), f"{out}/detailed_results", totals, done.retrieved(), k)
    if cfg.evaluation.error_analysis and len(made) > 2:
        best_dense = "dense_finetuned" if "dense_finetuned" in made else "dense_zeroshot"
        reports.error_files(*done.errors("char_ngram_bm25", best_dense), f"{out}/error_analysis")
    docs = chunks.select(F.col("chunk_id").alias("doc"), "text")
    ranges = [tuple(r) for r in cfg.evaluation.ablation.ngram_sizes]
    reports.aggregate_csv(analysis.ngram_ablation(docs, queries, gold, ranges, k), names, f"{out}/ablation_ngram")
    if log is not None:
        log.metrics({f"{r.retriever}/{r.metric}": r.value for r in totals.collect()})
    return done


def answer(spark: SparkSession, cfg: Config, texts: DataFrame, llm: rag.LLM | None = None, sparse_only: bool = False, encoder: dense.Encoder = dense.hashed_encoder, k: int | None = None, index_dir: str | None = None) -> DataFrame:
    """Responses for ``texts`` (query, text), 50 at most; without a model, what was retrieved (``k`` sources, or as configured)."""
    g = cfg.generation
    made = retrievers(cfg, sparse_only, encoder)
    name = "char_ngram_bm25" if sparse_only else "hybrid"
    children = made[name].retrievers if name == "hybrid" else []
    found = opened({r.name: r for r in [*children, made[name]]}, load_chunks(spark, cfg), index_dir)[name]
    generator = rag.Generator(found, llm, g.prompt_template, k or g.top_k_context)
    queries = rag.first_queries(texts)
    if llm is not None:
        return generator.generate(queries)
    rows = generator.prompts(queries)
    return rag.responses(rows.withColumn("answer", F.lit(None).cast("string")), "none", found.name)


def assets(spark: SparkSession, cfg: Config) -> None:
    """LaTeX tables of the result files."""
    for name, title in (("aggregate_results", "Retrieval results"), ("ablation_ngram", "Character n-gram ranges")):
        path = f"{cfg.evaluation.results_dir}/{name}"
        if files.exists(spark, path):
            wide = reports.read_results(spark, path)
            reports.write_results(wide, f"{cfg.paper_assets.tables_dir}/{name}_csv")
            names = wide.columns[1:]
            stacked = ", ".join(f"'{n}', `{n}`" for n in names)
            long = wide.select(F.col("System").alias("retriever"), F.expr(f"stack({len(names)}, {stacked}) as (metric, value)"))
            reports.latex_file(long, names, title, f"{cfg.paper_assets.tables_dir}/{name}", label=f"tab:{name}")


def describe(cfg: Config) -> dict:
    return dataclasses.asdict(cfg)
