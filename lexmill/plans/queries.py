"""Registered queries over the driver's tables, and an oracle for each that SQL can express.

Documents are the searched texts, benchmark items the queries; a document that holds an item's text is
its gold.  Every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import char_ngrams, ngram_length, words
from ..operators import analysis, bm25, chunking, dedup, dense, fusion, hashing, index, ivf, metrics, projection, questions, rag
from ..operators.evaluation import containing
from ..operators.sizes import spread
from ..store import new_folder, written
from . import oracle as O

QUERIES = {}
ORACLE_SQL = {}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(found) if name in ("documents", "embeddings", "pages") else found


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, sf) -> DataFrame:
    return _table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")


def _items(spark, sf) -> DataFrame:
    return _table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")


def _cleaned(spark, sf) -> DataFrame:
    return _table(spark, sf, "documents").select(F.col("doc_id").alias("ordinal"), T.clean_text(F.col("text")).alias("text"))


def _chunks(spark, sf) -> DataFrame:
    return chunking.fixed(_table(spark, sf, "documents").select("doc_id", "text", "source"))


def _word_run(spark, sf, k=10) -> DataFrame:
    return bm25.search_words(_docs(spark, sf), _items(spark, sf), k)


def _char_run(spark, sf, k=10) -> DataFrame:
    return bm25.search_chars(_docs(spark, sf), _items(spark, sf), k)


def _both(spark, sf) -> DataFrame:
    word, char = (run.withColumn("retriever", F.lit(name)) for name, run in (("word_bm25", _word_run(spark, sf)), ("char_bm25", _char_run(spark, sf))))
    return word.unionByName(char)


def _gold(spark, sf) -> DataFrame:
    return written(containing(_docs(spark, sf), _items(spark, sf)), new_folder(spark, "gold"))  # metrics read it more than once


def _fetched(spark, sf) -> dict[str, DataFrame]:
    depth = fusion.fetch_depth(10)
    return {"char_bm25": _char_run(spark, sf, depth), "word_bm25": _word_run(spark, sf, depth)}


# --- cleaning, filters, dedup ---


@query(f"select doc_id, {O.clean('text')} as text from documents")
def clean_text(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query(f"select doc_id, {O.squeeze(O.devanagari(f'''nfc_normalize(text || '{O.ODD}')'''))} as text from documents")
def nfc_devanagari(spark, sf):
    odd = F.concat("text", F.lit(O.ODD))
    return _table(spark, sf, "documents").select("doc_id", T.squeeze(T.chandrabindu(T.strip_nukta(T.strip_zero_width(T.nfc(odd))))).alias("text"))


@query(f"select doc_id, {O.transliterated('text')} as text from documents")
def transliterate(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", T.transliterate(F.col("text")).alias("text"))


@query(rf"select page_id, {O.no_urls('url')} as url, {O.squeeze(O.no_emails(O.no_urls('html')))} as html from pages")
def url_strip(spark, sf):
    return _table(spark, sf, "pages").select("page_id", T.strip_urls(F.col("url")).alias("url"), T.squeeze(T.strip_emails(T.strip_urls(F.col("html")))).alias("html"))


@query(f"select doc_id, lower({O.clean('text')}) as text from documents")
def clean_lowercase(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text"), lowercase=True).alias("text"))


@query(f"with c as (select doc_id, {O.clean('text')} as text from documents) select * from c where length(text) >= 20")
def min_length_filter(spark, sf):
    return dedup.long_enough(_cleaned(spark, sf)).withColumnRenamed("ordinal", "doc_id")


@query(f"with c as (select doc_id, {O.clean('text')} as text from documents) select doc_id, text from c where length(text) >= 20 qualify row_number() over (partition by md5(text) order by doc_id) = 1")
def exact_dedup(spark, sf):
    return dedup.first_long(_cleaned(spark, sf)).withColumnRenamed("ordinal", "doc_id")


@query(f"""with c as (select doc_id, {O.clean('text')} as text from documents),
seen as (select distinct md5(text) as h from c where doc_id % 3 = 0)
select doc_id, text from c where doc_id % 3 <> 0 and md5(text) not in (select h from seen) qualify row_number() over (partition by md5(text) order by doc_id) = 1""")
def incremental_dedup_anti(spark, sf):
    """A second batch against the hashes of a first: the two batches together are the whole table."""
    cleaned = _cleaned(spark, sf)
    seen = cleaned.where("ordinal % 3 = 0").select(dedup.text_hash().alias("h"))
    return dedup.unseen(cleaned.where("ordinal % 3 <> 0"), seen).select(F.col("ordinal").alias("doc_id"), "text")


@query(f"""with c as (select {O.clean('text')} as text, doc_id from documents),
s as (select case when length(text) < 20 then 'short' when row_number() over (partition by md5(text) order by doc_id) = 1 then 'kept' else 'dup' end as status from c)
select count(*) as total, count(*) filter (status = 'kept') as kept, count(*) filter (status = 'short') as removed_short, count(*) filter (status = 'dup') as removed_dup from s""")
def clean_stats(spark, sf):
    return dedup.clean_stats(_cleaned(spark, sf))


@query(f"""with {O.CHUNKS}, c as (select {O.clean('text')} as text, doc_id from documents)
select (select count(*) from documents) as raw_documents, (select count(distinct md5(text)) from c where length(text) >= 20) as cleaned_documents,
       count(*) as chunks, round(coalesce(sum(length(text))::double / greatest(count(*), 1), 0), 6) as avg_chunk_length from chunks""")
def corpus_stats(spark, sf):
    raw = _table(spark, sf, "documents").select("doc_id")
    kept = dedup.first_long(_cleaned(spark, sf))
    return dedup.corpus_stats(raw, kept, _chunks(spark, sf)).withColumn("avg_chunk_length", F.round("avg_chunk_length", 6))


# --- chunks and tokens ---


@query(f"with {O.CHUNKS} select chunk_id, text, doc_id, source, chunk_index from chunks")
def chunk_fixed(spark, sf):
    return _chunks(spark, sf).drop("metadata")


@query(f"with recursive {O.SENTENCES} select printf('%s_c%04d', doc_id, k) as chunk_id, array_to_string(w, ' ') as text, doc_id, source, k::int as chunk_index from sentence_chunks")
def chunk_sentence(spark, sf):
    return chunking.sentences(_table(spark, sf, "documents").select("doc_id", "text", "source")).drop("metadata")


@query(f"with {O.CHUNKS} select c.chunk_id, d.lang as lang, 'fixed' as chunk_method from chunks c join documents d on d.doc_id::varchar = c.doc_id")
def chunk_metadata(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "text", "source", F.create_map(F.lit("lang"), F.col("lang"), F.lit("chunk_method"), F.lit("old")).alias("metadata"))
    return chunking.fixed(docs).select("chunk_id", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["chunk_method"].alias("chunk_method"))


@query(f"select doc_id, unnest({O.words('text')}) as word, generate_subscripts({O.words('text')}, 1)::int - 1 as position from documents")
def word_tokens(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.posexplode(words(F.col("text"))).alias("position", "word"))


@query(f"with g as (select doc_id, unnest({O.words('text')}) as w from documents) select gram, count(*) as n from (select unnest({O.grams('w', 2, 4)}) as gram from g) group by gram")
def char_ngrams_count(spark, sf):
    # n-grams are made per word: each distinct word once, weighed by its count
    counted = _table(spark, sf, "documents").select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("times"))
    return counted.select(F.explode(char_ngrams(F.col("word"))).alias("gram"), "times").groupBy("gram").agg(F.sum("times").alias("n"))


@query(f"select item_id, unnest(flatten(list_transform({O.words('text')}, lambda v: {O.grams('v', 2, 3)}))) as gram, generate_subscripts(flatten(list_transform({O.words('text')}, lambda v: {O.grams('v', 2, 3)})), 1)::int - 1 as position from benchmark")
def char_ngrams_order(spark, sf):
    return _table(spark, sf, "benchmark").select("item_id", F.posexplode(char_ngrams(F.col("text"), 2, 3)).alias("position", "gram"))


# --- index ---


@query(f"with {O.BASE}, {O.WORD_INDEX} select doc, term, tf from w_tf")
def term_freq(spark, sf):
    return index.term_frequency(_docs(spark, sf), index.Analyzer("word"))


@query(f"with {O.BASE}, {O.WORD_INDEX} select term, df from w_df")
def doc_freq(spark, sf):
    return index.corpus_df(_docs(spark, sf), index.Analyzer("word"))


@query(f"with {O.BASE}, {O.char_index()} select doc, dl::bigint as dl from c_dl")
def doc_length_ngram(spark, sf):
    return _docs(spark, sf).select("doc", ngram_length(F.col("text")).alias("dl"))


@query(f"with {O.BASE}, {O.WORD_INDEX} select n, round(avgdl, 6) as avgdl, (select count(*) from w_df) as vocabulary from w_st")
def index_stats(spark, sf):
    docs, analyzer = _docs(spark, sf), index.Analyzer("word")
    vocabulary = docs.select(F.explode(words(F.col("text"))).alias("t")).agg(F.count_distinct("t").alias("vocabulary"))
    return index.stats(index.document_length(docs, analyzer)).crossJoin(F.broadcast(vocabulary)).withColumn("avgdl", F.round("avgdl", 6))


# --- retrieval ---


@query(f"with {O.BASE}, {O.word_run(10)} select query, doc, score, rank::int as rank from word_run")
def bm25_word_topk(spark, sf):
    return _word_run(spark, sf)


@query(f"with {O.BASE}, {O.char_run(10)} select query, doc, score, rank::int as rank from char_run")
def bm25_char_topk(spark, sf):
    return _char_run(spark, sf)


def _vectors(spark, sf) -> tuple[DataFrame, DataFrame]:
    v = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc"), "embedding")
    return v, v.where("doc % 50 = 0").withColumnRenamed("doc", "query")


_DENSE = """s as (select a.vec_id as query, b.vec_id as doc, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a, embeddings b where a.vec_id % 50 = 0),
dense_run as (select query, doc, score, row_number() over (partition by query order by score desc, doc) as rank from s qualify rank <= 10)"""


@query(f"with {_DENSE} select query, doc, score, rank::int as rank from dense_run")
def dense_flat_topk(spark, sf):
    """The stated query set, every 50th vector, against all vectors."""
    return dense.search_flat(*_vectors(spark, sf))


@query()
def dense_ivf_topk(spark, sf):
    """At least 0.9 of the exact top ten: lists are probed until 0.95 is reached on a sample."""
    return ivf.search_ivf(*_vectors(spark, sf), recall=0.95)


@query(f"""with {_DENSE}, labels_ as (select vec_id, label from embeddings),
j as (select r.query, r.rank, (a.label = b.label)::int as hit from dense_run r join labels_ a on a.vec_id = r.query join labels_ b on b.vec_id = r.doc)
select query, round(sum(hit) / 10.0, 6) as precision from j group by query""")
def dense_label_precision(spark, sf):
    """Precision at 10 where gold is the same label."""
    vectors, queries = _vectors(spark, sf)
    labels = _table(spark, sf, "embeddings").select("vec_id", "label")
    run = dense.search_flat(vectors, queries)
    j = run.join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("a")), "query").join(labels.select(F.col("vec_id").alias("doc"), F.col("label").alias("b")), "doc")
    return j.groupBy("query").agg(F.round(F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(0)) / 10.0, 6).alias("precision"))


# --- fusion ---

_RRF = "f as (select query, doc, round(sum(1.0::double / (60 + rank)), 8) as score, min((sys, rank)) as seen from fetched group by query, doc), fused as (select query, doc, score, row_number() over (partition by query order by score desc, seen, doc) as rank from f qualify rank <= 10)"

_SCALED = """r as (select *, min(score) over (partition by query, sys) as low, max(score) over (partition by query, sys) as high from fetched),
f as (select query, doc, round(sum(case sys when 0 then 0.7 else 0.3 end * (score - low) / case when high > low then high - low else 1 end), 8) as score, min((sys, rank)) as seen from r group by query, doc)
select query, doc, score, (row_number() over (partition by query order by score desc, seen, doc))::int as rank from f qualify rank <= 10"""


@query(f"{O.FIFTY}, {_RRF} select query, doc, score, rank::int as rank from fused")
def rrf_fusion(spark, sf):
    return fusion.rrf(_fetched(spark, sf)).drop("sources")


@query(f"{O.FIFTY}, {_SCALED}")
def weighted_fusion(spark, sf):
    return fusion.weighted(_fetched(spark, sf), weights=[0.7, 0.3])


@query(f"{O.FIFTY}, {_RRF} select u.query, u.doc, max(case when sys = 0 then f.rank end)::int as char_rank, max(case when sys = 1 then f.rank end)::int as word_rank from fused u join fetched f using (query, doc) group by u.query, u.doc")
def rrf_source_ranks(spark, sf):
    return fusion.rrf(_fetched(spark, sf)).select("query", "doc", F.col("sources")["char_bm25"].alias("char_rank"), F.col("sources")["word_bm25"].alias("word_rank"))


@query(f"with {O.BASE}, {O.ENCODED} select doc as doc_id, embedding from d_vectors")
def encode_documents(spark, sf):
    docs = _docs(spark, sf)
    return hashing.HashedWords.fit(docs).encode(docs, "doc").withColumnRenamed("doc", "doc_id")


def _char_and_dense(spark, sf) -> dict[str, DataFrame]:
    """Both runs of the items over all documents; vectors are those of the texts."""
    docs, items, depth = _docs(spark, sf), _items(spark, sf), fusion.fetch_depth(10)
    encoder = hashing.HashedWords.fit(docs)
    return {"char_bm25": _char_run(spark, sf, depth), "dense": dense.search_flat(encoder.encode(docs, "doc"), encoder.encode(items, "query"), depth)}


@query(f"{O.CHAR_DENSE}, {_RRF} select query, doc, score, rank::int as rank from fused")
def hybrid_rrf(spark, sf):
    return fusion.rrf(_char_and_dense(spark, sf)).drop("sources")


@query(f"{O.CHAR_DENSE}, {_SCALED}")
def hybrid_weighted(spark, sf):
    return fusion.weighted(_char_and_dense(spark, sf), weights=[0.7, 0.3])


@query(f"{O.FIFTY}, c as (select unnest([10, 30, 60, 100]) as rrf_k), f as (select rrf_k, query, doc, round(sum(1.0::double / (rrf_k + rank)), 8) as score, min((sys, rank)) as seen from fetched, c group by all) select rrf_k, query, doc, score, (row_number() over (partition by rrf_k, query order by score desc, seen, doc))::int as rank from f qualify rank <= 10")
def rrf_k_sweep(spark, sf):
    return fusion.rrf_sweep(_fetched(spark, sf), [10, 30, 60, 100])


# --- evaluation ---


@query(f"with {O.BASE}, {O.GOLD} select query, doc from gold")
def gold_pairs(spark, sf):
    return _gold(spark, sf)


@query("select printf('q_%04d', item_id) as query_id, text as question from benchmark")
def query_ids(spark, sf):
    return _table(spark, sf, "benchmark").select(metrics.query_ids("item_id").alias("query_id"), F.col("text").alias("question"))


def _one_metric(name: str, column: str):
    @query(f"{O.TEN} select retriever, value from long_metrics where metric = '{column}'")
    def one(spark, sf):
        return metrics.all_metrics(_both(spark, sf), _gold(spark, sf)).where(F.col("metric") == column).select("retriever", "value")

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("one"), ORACLE_SQL.pop("one")


for _name, _column in (("mrr", "mrr@10"), ("recall", "recall@10"), ("precision", "precision@10"), ("ndcg", "ndcg@10"), ("map", "map")):
    _one_metric(_name, _column)


@query(f"{O.TEN} select retriever, metric, value from long_metrics")
def metrics_all(spark, sf):
    return metrics.all_metrics(_both(spark, sf), _gold(spark, sf))


@query(f"{O.TEN} select retriever, query, round(rr, 6) as rr, round(recall, 6) as recall, round(precision, 6) as precision, round(ndcg, 6) as ndcg from per_query")
def metrics_per_query(spark, sf):
    rows = metrics.per_query(_both(spark, sf), _gold(spark, sf))
    return rows.select("retriever", "query", *(F.round(c, 6).alias(c) for c in ("rr", "recall", "precision", "ndcg")))


# --- analysis and reports ---

_HITS = "hits as (select query, max((retriever = 'char_bm25' and hit = 1)::int) as s, max((retriever = 'word_bm25' and hit = 1)::int) as d from judged group by query), b as (select z.query, case when s = 1 and h.d = 1 then 'both_succeed' when s = 1 then 'sparse_only' when h.d = 1 then 'dense_only' else 'both_fail' end as bucket from sizes z left join hits h using (query))"


@query(f"{O.TEN}, {_HITS} select query, bucket from b")
def error_buckets(spark, sf):
    return analysis.buckets(_char_run(spark, sf), _word_run(spark, sf), _gold(spark, sf))


@query(f"""{O.TEN}, {_HITS}, n as (select count(*) as total, count(*) filter (bucket = 'both_succeed') as both_, count(*) filter (bucket = 'sparse_only') as s, count(*) filter (bucket = 'dense_only') as d_, count(*) filter (bucket = 'both_fail') as f from q left join b using (query))
select total as total_queries, both_ as both_succeed, s as sparse_only_wins, d_ as dense_only_wins, f as both_fail,
       round((both_ + s) / greatest(total, 1)::double, 6) as sparse_recall, round((both_ + d_) / greatest(total, 1)::double, 6) as dense_recall, round(both_ / greatest(total, 1)::double, 6) as agreement_rate from n""")
def error_summary(spark, sf):
    char, word, g = _char_run(spark, sf), _word_run(spark, sf), _gold(spark, sf)
    return analysis.summary(_items(spark, sf), analysis.buckets(char, word, g))


@query(f"""{O.TEN}, {_HITS},
five as (select query, retriever, list(doc order by rank) as docs from both_runs where rank <= 5 group by all)
select b.query, b.bucket, q.text as query_text, (select list_sort(list(distinct doc)) from gold g where g.query = b.query) as gold_chunks, s.docs as sparse_retrieved, w.docs as dense_retrieved
from b join q using (query) left join five s on s.query = b.query and s.retriever = 'char_bm25' left join five w on w.query = b.query and w.retriever = 'word_bm25'""")
def error_cases(spark, sf):
    return analysis.cases(_items(spark, sf), _char_run(spark, sf), _word_run(spark, sf), _gold(spark, sf)).drop("sparse_scores", "dense_scores")


@query(f"{O.TEN} select g.query, g.doc, c.rank::int as sparse_rank, w.rank::int as dense_rank, abs(c.rank - w.rank)::int as displacement from (select distinct query, doc from gold) g left join char_run c using (query, doc) left join word_run w using (query, doc)")
def rank_displacement(spark, sf):
    return analysis.displacement(_char_run(spark, sf), _word_run(spark, sf), _gold(spark, sf))


_RANGES = [(2, 3), (2, 4), (2, 5), (3, 4), (3, 5)]
_ABLATED = " union all ".join(f"select 'char_bm25_{a}_{b}' as retriever, query, doc, rank from run_{a}_{b}" for a, b in _RANGES)
_ABLATION_RUNS = ", ".join(O.char_run(10, a, b, f"c{a}{b}", f"run_{a}_{b}") for a, b in _RANGES)


@query(f"with {O.BASE}, {_ABLATION_RUNS}, {O.GOLD}, ablated as ({_ABLATED}), {O.metrics('ablated')} select retriever, metric, value from long_metrics")
def ngram_ablation(spark, sf):
    return analysis.ngram_ablation(_docs(spark, sf), _items(spark, sf), _gold(spark, sf), _RANGES)


_NAMES = ["mrr@10", "recall@10", "ndcg@10", "precision@10", "map"]


@query(f"""{O.TEN} select retriever, {', '.join(f"printf('%.4f', max(case when metric = '{n}' then value end)) as {n.replace('@', '_at_')}" for n in _NAMES)} from long_metrics group by retriever""")
def metric_pivot(spark, sf):
    wide = analysis.comparison(metrics.all_metrics(_both(spark, sf), _gold(spark, sf)), _NAMES)
    return wide.select("retriever", *(F.format_string("%.4f", F.col(f"`{n}`")).alias(n.replace("@", "_at_")) for n in _NAMES))


@query(f"{O.TEN} select retriever, metric, value, value = max(value) over (partition by metric) as best from long_metrics")
def best_per_metric(spark, sf):
    return analysis.best(metrics.all_metrics(_both(spark, sf), _gold(spark, sf)))


@query(f"{O.TEN}, wrong as (select r.* from word_run r where not exists (select 1 from gold g where g.query = r.query and g.doc = r.doc)) select query, doc, score, (row_number() over (partition by query order by rank))::int as position from wrong qualify position <= 5")
def hard_negatives(spark, sf):
    return analysis.hard_negatives(_word_run(spark, sf), _gold(spark, sf))


# --- questions, training, prompts ---

_TEMPLATES = ", ".join(f"'{t}'" for t in questions.TEMPLATES)


def _draw(name: str, below: str) -> str:
    return f"(('0x' || substr(md5(chunk_id || '|' || i || '|42|{name}'), 1, 8))::bigint % {below})"


_QA = f"""with {O.CHUNKS},
qa as (select chunk_id, source, text, string_split(text, ' ') as w, unnest([1, 2]) as i from chunks where len(string_split(text, ' ')) >= 5),
qb as (select *, least({_draw('len', '6')} + 3, len(w)) as n from qa),
qc as (select *, {_draw('at', '(len(w) - n + 1)')} as pos, [{_TEMPLATES}][{_draw('template', str(len(questions.TEMPLATES)))} + 1] as template from qb),
pairs as (select replace(template, '{{snippet}}', array_to_string(w[pos + 1 : pos + n], ' ')) as question, text as answer, chunk_id, source, i::int as i from qc)"""


@query(f"{_QA} select question, answer, chunk_id, source, i from pairs")
def qa_template(spark, sf):
    return questions.from_templates(_chunks(spark, sf))


@query(r"""with r as (select item_id, '1. ' || text || chr(10) || ' 2) - second?' || chr(10) || chr(10) || '3. third' as reply from benchmark),
l as (select item_id, list_filter(list_transform(string_split(trim(reply), chr(10))[1:3], lambda s: regexp_replace(trim(s), '^[0-9.\-) ]+', '')), lambda s: s <> '') as qs from r)
select item_id, unnest(qs) as question from l""")
def qa_llm_parse(spark, sf):
    reply = F.concat(F.lit("1. "), "text", F.lit("\n 2) - second?\n\n3. third"))
    return _table(spark, sf, "benchmark").select("item_id", F.explode(questions.parse_reply(reply, 3)).alias("question"))


@query("select item_id, text as anchor, case when item_id < greatest(1, ((select count(*) from benchmark) * 0.9)::int) then 'train' else 'eval' end as part from benchmark")
def train_split(spark, sf):
    items = _table(spark, sf, "benchmark")
    return questions.split(items.select("item_id", F.col("text").alias("anchor")), "item_id", items.count())


@query("select a.item_id as anchor, b.item_id as negative, a.item_id // 16 as batch from benchmark a join benchmark b on a.item_id // 16 = b.item_id // 16 and a.item_id <> b.item_id")
def inbatch_negatives(spark, sf):
    return questions.in_batch_negatives(_table(spark, sf, "benchmark"), "item_id")


@query("""with p as (select a.vec_id // 2 as i, a.embedding::double[] as x, b.embedding::double[] as y from embeddings a join embeddings b on a.vec_id % 2 = 0 and b.vec_id = a.vec_id + 1),
s as (select a.i // 16 as batch, a.i as i, b.i as j, 20 * list_cosine_similarity(a.x, b.y) as s from p a join p b on a.i // 16 = b.i // 16),
l as (select batch, i, ln(sum(exp(s))) - max(case when i = j then s end) as loss from s group by batch, i)
select batch, count(*) as "rows", round(avg(loss), 6) as loss from l group by batch""")
def contrastive_loss(spark, sf):
    """The loss of each batch of neighbouring vectors before a step of training (``projection``)."""
    v = _table(spark, sf, "embeddings").select("vec_id", "embedding")
    left = v.where("vec_id % 2 = 0").select((F.col("vec_id") / 2).cast("long").alias("ordinal"), F.col("embedding").alias("anchor"))
    right = v.where("vec_id % 2 = 1").select(F.floor(F.col("vec_id") / 2).alias("ordinal"), F.col("embedding").alias("positive"))
    return projection.losses(projection.batches(left.join(right, "ordinal"))).withColumn("loss", F.round("loss", 6))


def _contexts(spark, sf, k: int) -> DataFrame:
    hits = _word_run(spark, sf, k).join(_docs(spark, sf), "doc").withColumnRenamed("doc", "chunk_id")
    return _items(spark, sf).join(rag.contexts(hits), "query")


def _prompt_sql(template: str) -> str:
    head = rag.INSTRUCTIONS[template].replace("'", "''")
    return f"""with {O.BASE}, {O.word_run(3)},
p as (select query, string_agg('[' || rank || '] ' || d.text, chr(10) || chr(10) order by rank) as passages from word_run join d using (doc) group by query)
select query, '{head}' || chr(10) || chr(10) || passages || chr(10) || chr(10) || 'Question: ' || q.text || chr(10) || 'Answer:' as prompt from p join q using (query)"""


def _prompt_query(template: str):
    @query(_prompt_sql(template))
    def made(spark, sf):
        passages = F.transform("sources", lambda s: s["text"])
        return _contexts(spark, sf, 3).select("query", rag.prompt(template, F.col("text"), passages).alias("prompt"))

    QUERIES[f"prompt_{template}"], ORACLE_SQL[f"prompt_{template}"] = QUERIES.pop("made"), ORACLE_SQL.pop("made")


for _template in rag.INSTRUCTIONS:
    _prompt_query(_template)


@query(f"with {O.BASE}, {O.word_run(5)} select query, rank::int as rank, doc as chunk_id, score, substr(d.text, 1, 200) as text_preview from word_run join d using (doc)")
def rag_sources(spark, sf):
    rows = rag.responses(_contexts(spark, sf, 5).withColumn("answer", F.lit("")).withColumn("prompt", F.lit("")), "none", "word_bm25")
    return rows.select(F.col("query_id").alias("query"), F.inline("sources")).select("query", "rank", "chunk_id", "score", "text_preview")


@query("select item_id as query, text from benchmark order by item_id limit 50")
def batch_cap(spark, sf):
    """Answering a batch is capped at its first 50 queries."""
    return rag.first_queries(_items(spark, sf))


@query(f"{_QA} select printf('%s_%d', chunk_id, i) as id, question, substr(answer, 1, 200) as answer from pairs order by chunk_id, i limit 20")
def qa_preview(spark, sf):
    """The preview shows the first 20 pairs."""
    pairs = questions.from_templates(_chunks(spark, sf))
    return pairs.orderBy("chunk_id", "i").limit(20).select(F.format_string("%s_%d", "chunk_id", "i").alias("id"), "question", T.preview(F.col("answer")).alias("answer"))
