"""Retrievers: index a frame of chunks once, search with a frame of queries.

``index`` takes ``chunk_id``, ``text`` (and ``metadata``); ``retrieve`` takes ``query``, ``text`` and gives
``query, chunk_id, score, rank, text, metadata``.  A single query is a frame of one row.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import new_folder
from . import bm25, dense, fusion, ivf
from .graph import Graph
from .hashing import HashedWords
from .index import Analyzer
from .postings import Postings
from .sizes import fits

_FEW_QUERIES = 64


class Retriever(ABC):
    def __init__(self, name: str = "base"):
        self.name = name
        self.corpus: DataFrame | None = None

    @property
    def is_indexed(self) -> bool:
        return self.corpus is not None

    def index(self, chunks: DataFrame) -> "Retriever":
        meta = F.col("metadata") if "metadata" in chunks.columns else F.create_map().cast("map<string,string>")
        self.corpus = chunks.select(F.col("chunk_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"), meta.alias("metadata"))
        self._build()
        return self

    def _build(self) -> None:
        pass

    @abstractmethod
    def run(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, doc, score, rank)."""

    def _checked(self) -> DataFrame:
        if self.corpus is None:
            raise RuntimeError("Index not built. Call index() first.")
        return self.corpus

    def _marks(self) -> dict[str, str]:
        return {"retriever": self.name}

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        corpus = self._checked()
        marks = F.create_map(*(F.lit(x) for pair in self._marks().items() for x in pair))
        own = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda key, _: ~key.isin(*self._marks()))
        rows = self.run(queries, k).join(corpus, "doc")
        return rows.select("query", F.col("doc").alias("chunk_id"), "score", "rank", "text", F.map_concat(own, marks).alias("metadata"))

    def retrieve_one(self, query: str, k: int = 10) -> DataFrame:
        spark = self._checked().sparkSession
        return self.retrieve(spark.createDataFrame([("q", query)], "query string, text string"), k).drop("query").orderBy("rank")

    def save(self, path: str) -> None:
        raise NotImplementedError(f"{type(self).__name__} keeps no index")

    def __repr__(self) -> str:
        return f"{type(self).__name__}(name={self.name!r}, indexed={self.is_indexed})"


class _Bm25(Retriever):
    """``index`` writes the postings once; every search reads those of its terms."""

    analyzer: Analyzer

    def __init__(self, k1: float, b: float, name: str):
        super().__init__(name)
        self.k1, self.b, self.postings = k1, b, None

    def _build(self) -> None:
        made = Postings.build(self.corpus, new_folder(self.corpus.sparkSession, self.name), self.analyzer, self.k1, self.b)
        self.postings, self.corpus = made, made.corpus

    def save(self, path: str) -> None:
        self._checked()
        self.postings.copy(path)

    def load(self, spark: SparkSession, path: str) -> "_Bm25":
        self.postings = saved = Postings.load(spark, path)
        self.analyzer, self.k1, self.b, self.corpus = saved.analyzer, saved.k1, saved.b, saved.corpus
        return self

    def run(self, queries: DataFrame, k: int) -> DataFrame:
        self._checked()
        return self.postings.search(queries, k)


class WordBM25(_Bm25):
    def __init__(self, k1: float = 1.5, b: float = 0.75, name: str = "word_bm25"):
        super().__init__(k1, b, name)
        self.analyzer = Analyzer("word")


class CharBM25(_Bm25):
    def __init__(self, ngram_range: tuple[int, int] = (2, 4), k1: float = 1.5, b: float = 0.75, name: str = "char_ngram_bm25"):
        super().__init__(k1, b, name)
        self.analyzer = Analyzer("char", *ngram_range)

    def _marks(self) -> dict[str, str]:
        return {**super()._marks(), "ngram_range": f"({self.analyzer.low}, {self.analyzer.high})"}

    def run(self, queries: DataFrame, k: int) -> DataFrame:
        """Postings for a few queries; for many, whose n-grams are most of the index, two passes over the texts."""
        if fits(queries, _FEW_QUERIES):
            return super().run(queries, k)
        return bm25.search_chars(self._checked(), queries, k, self.analyzer.low, self.analyzer.high, self.k1, self.b)


#: The encoder that is a plan: signed feature hashing with the corpus' idf, see ``hashing``.
HASHED_WORDS = "hashed-words"


class Dense(Retriever):
    def __init__(self, encoder: dense.Encoder | str = dense.hashed_encoder, model: str | None = None, normalize: bool = True, index_type: str = "flat", nlist: int = 100, nprobe: int = 10, name: str = "dense"):
        super().__init__(name)
        own = "hashed-trigrams" if encoder is dense.hashed_encoder else HASHED_WORDS if encoder == HASHED_WORDS else None  # the default has its name, whatever is configured
        self.encoder, self.model, self.normalize, self.index_type, self.nlist, self.nprobe = encoder, own or model or name, normalize, index_type, nlist, nprobe
        self.vectors: DataFrame | None = None
        self.lists: ivf.Lists | Graph | None = None
        self.words: HashedWords | None = None

    def _build(self) -> None:
        """Vectors stay a plan, or are written as inverted lists or as a graph once and for all searches."""
        if self.encoder == HASHED_WORDS:
            self.words = HashedWords.fit(self.corpus)
        self.vectors = self._encoded(self.corpus, "doc")
        if self.index_type == "ivf":
            self._listed(ivf.Lists.build(self.vectors, new_folder(self.corpus.sparkSession, "lists"), self.nlist, self.nprobe))
        elif self.index_type == "graph":
            self._listed(Graph.build(self.vectors, new_folder(self.corpus.sparkSession, "graph")))

    def _encoded(self, frame: DataFrame, key: str) -> DataFrame:
        if self.words is not None:
            return self.words.encode(frame, key)
        return dense.encode(frame.select(key, "text"), self.encoder, self.normalize).select(key, "embedding")

    def _listed(self, lists: ivf.Lists | Graph) -> None:
        self.lists, self.vectors = lists, lists.table().select("doc", "embedding")

    def _marks(self) -> dict[str, str]:
        return {**super()._marks(), "model": self.model}

    def run(self, queries: DataFrame, k: int) -> DataFrame:
        self._checked()
        q = self._encoded(queries, "query")
        if isinstance(self.lists, Graph):
            return self.lists.search(q, k)
        return self.lists.search(q, k, self.nprobe) if self.lists is not None else dense.search_flat(self.vectors, q, k)

    def save(self, path: str) -> None:
        spark = self._checked().sparkSession
        if self.words is not None:
            self.words.save(f"{path}/encoder")
        if self.lists is not None:
            self.lists.copy(f"{path}/{self.index_type}")
        else:
            self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        self.corpus.write.mode("overwrite").parquet(f"{path}/corpus")
        row = (self.model, self.normalize, self.index_type, self.nlist, self.nprobe)
        spark.createDataFrame([row], "model string, normalize boolean, index_type string, nlist int, nprobe int").write.mode("overwrite").parquet(f"{path}/params")

    def load(self, spark: SparkSession, path: str) -> "Dense":
        p = spark.read.parquet(f"{path}/params").first()
        self.model, self.normalize, self.index_type, self.nlist, self.nprobe = p
        self.corpus = spark.read.parquet(f"{path}/corpus")
        if self.model == HASHED_WORDS:
            self.encoder, self.words = HASHED_WORDS, HashedWords.load(spark, f"{path}/encoder")
        if self.index_type == "ivf":
            self._listed(ivf.Lists.load(spark, f"{path}/ivf"))
        elif self.index_type == "graph":
            self._listed(Graph.load(spark, f"{path}/graph"))
        else:
            self.vectors = spark.read.parquet(f"{path}/vectors")
        return self


class Hybrid(Retriever):
    def __init__(self, retrievers: list[Retriever] | None = None, weights: list[float] | None = None, method: str = "rrf", rrf_k: int = 60, name: str = "hybrid"):
        super().__init__(name)
        self.retrievers = list(retrievers or [])
        self.weights = list(weights) if weights is not None else [1.0] * len(self.retrievers)
        if len(self.weights) != len(self.retrievers):
            raise ValueError(f"Number of weights ({len(self.weights)}) must match number of retrievers ({len(self.retrievers)})")
        self.method, self.rrf_k = method, rrf_k

    def add_retriever(self, retriever: Retriever, weight: float = 1.0) -> None:
        self.retrievers.append(retriever)
        self.weights.append(weight)

    def index(self, chunks: DataFrame) -> "Hybrid":
        for r in self.retrievers:
            if not r.is_indexed:
                r.index(chunks)
        super().index(chunks)
        return self

    def _marks(self) -> dict[str, str]:
        return {**super()._marks(), "fusion_method": self.method}

    def run(self, queries: DataFrame, k: int) -> DataFrame:
        self._checked()
        depth = fusion.fetch_depth(k)
        runs = {f"{i}:{r.name}": r.run(queries, depth) for i, r in enumerate(self.retrievers)}
        return fusion.fuse(runs, self.method, k, self.rrf_k, self.weights).select("query", "doc", "score", "rank")


def build(sparse_only: bool = False, encoder: dense.Encoder = dense.hashed_encoder, model: str | None = None, ngram_range: tuple[int, int] = (2, 4), k1: float = 1.5, b: float = 0.75, method: str = "rrf", rrf_k: int = 60, weights: list[float] | None = None, **vectors) -> Retriever:
    """Character BM25 alone, or fused with dense search (``encoder`` is the fine-tuned one where there is one)."""
    char = CharBM25(ngram_range, k1, b)
    if sparse_only:
        return char
    return Hybrid([char, Dense(encoder, model, **vectors)], weights, method, rrf_k)
