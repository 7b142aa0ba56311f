"""SQL fragments for the queries' oracles, in DuckDB's dialect."""

from __future__ import annotations

from ..functions.text import LATIN_TO_DEVANAGARI, NUKTA, ZERO_WIDTH

#: Characters that the driver's tables lack, for the cleaning queries.
ODD = " \u0958 \u0929 \u091a\u093e\u0901\u0926 \u0939\u0901 a\u200bb\u200c\u200d\ufeff e\u0301 "


def squeeze(c: str) -> str:
    return rf"trim(regexp_replace({c}, '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}]+', ' ', 'g'))"


def words(c: str) -> str:
    return f"list_filter(string_split({squeeze(c)}, ' '), lambda w: w <> '')"


def no_urls(c: str) -> str:
    return rf"regexp_replace({c}, 'https?://\S+|www\.\S+', '', 'g')"


def no_emails(c: str) -> str:
    return rf"regexp_replace({c}, '\S+@\S+\.\S+', '', 'g')"


def no_control(c: str) -> str:
    return rf"regexp_replace({c}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{{7f}}-\x{{9f}}]', '', 'g')"


def devanagari(c: str) -> str:
    bare = f"translate({c}, '{ZERO_WIDTH}{NUKTA}', '')"
    return f"regexp_replace({bare}, '\u0901([\u0915-\u0939])', '\u0902\\1', 'g')"


def clean(c: str, nfc: bool = True) -> str:
    c = f"nfc_normalize({c})" if nfc else c
    return squeeze(devanagari(no_control(no_emails(no_urls(c)))))


def transliterated(c: str) -> str:
    pairs = ", ".join(f"'{k}': '{v}'" for k, v in LATIN_TO_DEVANAGARI.items())
    return f"array_to_string(list_transform(string_split({squeeze(c)}, ' '), lambda w: case when regexp_full_match(w, '[A-Za-z]+') then coalesce(map {{{pairs}}}[lower(w)], w) else w end), ' ')"


def grams(w: str, low: int, high: int) -> str:
    sizes = [f"list_transform(range(1, greatest(length({w}) + 3 - {n}, 0) + 1), lambda i: substr('^' || {w} || '$', i, {n}))" for n in range(low, high + 1)]
    return f"flatten([{', '.join(sizes)}])"


CHUNKS = f"""
chunk_words as (select doc_id::varchar as doc_id, source, {words('text')} as w from documents),
chunk_starts as (select *, unnest(range(0, greatest((len(w) - 64) // 192, 0)::bigint + 1)) as j from chunk_words where len(w) > 0),
chunks as (select printf('%s_c%04d', doc_id, j) as chunk_id, array_to_string(w[j * 192 + 1 : j * 192 + 256], ' ') as text, doc_id, source, j::int as chunk_index from chunk_starts)"""

SENTENCES = f"""
pieces as (select doc_id::varchar as doc_id, source, unnest(string_split(regexp_replace(text, '([।.?!])\\s+', '\\1' || chr(1), 'g'), chr(1))) as s, generate_subscripts(string_split(regexp_replace(text, '([।.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) as pos from documents),
sentences as (select doc_id, source, {words('s')} as w, row_number() over (partition by doc_id order by pos) as i from pieces where len({words('s')}) > 0),
packed as (
  select doc_id, source, 0::bigint as i, []::varchar[] as cur, null::varchar[] as done from sentences where i = 1
  union all
  select p.doc_id, p.source, s.i,
         case when len(p.cur) > 0 and len(p.cur) + len(s.w) > 256 then list_concat(p.cur[greatest(len(p.cur) - 63, 1) : len(p.cur)], s.w) else list_concat(p.cur, s.w) end,
         case when len(p.cur) > 0 and len(p.cur) + len(s.w) > 256 then p.cur end
  from packed p join sentences s on s.doc_id = p.doc_id and s.i = p.i + 1),
ends as (select doc_id, source, i, done as w from packed where done is not null
         union all select doc_id, source, i + 1, cur from packed qualify i = max(i) over (partition by doc_id)),
sentence_chunks as (select *, row_number() over (partition by doc_id order by i) - 1 as k from ends)"""

BASE = """
q as (select item_id as query, text from benchmark),
d as (select doc_id as doc, text from documents)"""

WORD_INDEX = f"""
w_tf as (select doc, term, count(*) as tf from (select doc, unnest({words('text')}) as term from d) group by all),
w_df as (select term, count(*) as df from w_tf group by term),
w_dl as (select doc, len({words('text')}) as dl from d),
w_st as (select count(*) as n, coalesce(avg(dl), 1.0) as avgdl from w_dl)"""


def word_run(k: int) -> str:
    return f"""{WORD_INDEX},
w_raw as (select term, ln(n - df + 0.5) - ln(df + 0.5) as raw from w_df, w_st),
w_idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from w_raw) else raw end as idf from w_raw),
w_q as (select query, term, count(*) as times from (select query, unnest({words('text')}) as term from q) group by all),
w_hit as (select query, doc, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
          from w_q join w_tf using (term) join w_idf using (term) join w_dl using (doc), w_st group by all),
w_all as (select query, doc, coalesce(score, 0.0) as score from (select query from q) cross join (select doc from d) left join w_hit using (query, doc)),
word_run as (select query, doc, score, row_number() over (partition by query order by score desc, doc) as rank from w_all qualify rank <= {k})"""


def char_index(low: int = 2, high: int = 4, c: str = "c") -> str:
    return f"""
{c}_w as (select doc, w, count(*) as times from (select doc, unnest({words('text')}) as w from d) group by all),
{c}_tf as (select doc, term, sum(times) as tf from (select doc, times, unnest({grams('w', low, high)}) as term from {c}_w) group by all),
{c}_df as (select term, count(*) as df from {c}_tf group by term),
{c}_dl as (select d.doc, coalesce(sum(tf), 0) as dl from d left join {c}_tf using (doc) group by d.doc),
{c}_st as (select count(*) as n, coalesce(avg(dl), 1.0) as avgdl from {c}_dl)"""


def char_run(k: int, low: int = 2, high: int = 4, c: str = "c", name: str = "char_run") -> str:
    return f"""{char_index(low, high, c)},
{c}_qw as (select distinct query, unnest({words('text')}) as w from q),
{c}_q as (select distinct query, unnest({grams('w', low, high)}) as term from {c}_qw),
{c}_hit as (select query, doc, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
          from {c}_q join {c}_tf using (term) join {c}_df using (term) join {c}_dl using (doc), {c}_st group by all),
{name} as (select query, doc, score, row_number() over (partition by query order by score desc, doc) as rank from {c}_hit where score > 0 qualify rank <= {k})"""


GOLD = f"""
gold as (select q.query, d.doc from q join d on contains(d.text, q.text) where len({words('q.text')}) > 0)"""


def metrics(run: str, k: int = 10) -> str:
    """CTEs per_query and totals over ``run`` (retriever, query, doc, rank) and gold."""
    return f"""
sizes as (select query, count(distinct doc) as size from gold group by query),
judged as (select r.retriever, r.query, r.doc, r.rank, s.size, (g.doc is not null)::int as hit
           from {run} r join sizes s using (query) left join (select distinct query, doc from gold) g on g.query = r.query and g.doc = r.doc),
running as (select *, sum(hit) over (partition by retriever, query order by rank rows unbounded preceding) as so_far from judged),
per_query as (
  select retriever, query, size,
         coalesce(1.0::double / min(case when hit = 1 and rank <= {k} then rank end), 0) as rr,
         count(distinct case when hit = 1 and rank <= {k} then doc end)::double / size as recall,
         count(distinct case when hit = 1 and rank <= {k} then doc end)::double / {k} as precision,
         coalesce(sum(case when hit = 1 and rank <= {k} then 1 / log2(rank + 1.0) end), 0) / list_sum(list_transform(range(1, least(size, {k}) + 1), lambda i: 1 / log2(i + 1.0))) as ndcg,
         sum(hit * so_far / rank::double) / size as ap
  from running group by retriever, query, size),
totals as (select retriever, avg(rr) as rr, avg(recall) as recall, avg(ndcg) as ndcg, avg(precision) as precision, avg(ap) as ap from per_query group by retriever),
long_metrics as (
  select retriever, unnest(['mrr@{k}', 'recall@{k}', 'ndcg@{k}', 'precision@{k}', 'map']) as metric, round(unnest([rr, recall, ndcg, precision, ap]), 6) as value from totals)"""


BOTH = "both_runs as (select 'word_bm25' as retriever, query, doc, rank from word_run union all select 'char_bm25', query, doc, rank from char_run)"
TEN = f"with {BASE}, {word_run(10)}, {char_run(10)}, {GOLD}, {BOTH}, {metrics('both_runs')}"


def encoded(name: str, source: str, key: str, dimensions: int = 64) -> str:
    """CTEs of unit vectors by signed feature hashing with the documents' idf."""
    part = lambda at, below: f"(('0x' || substr(md5(word), {at}, 8))::bigint % {below})"
    return f"""
{name}_tf as (select {key}, word, count(*) as tf from (select {key}, unnest({words('text')}) as word from {source}) group by all),
{name}_part as (select {key}, {part(1, dimensions)} as slot, sum(case {part(9, 2)} when 0 then 1.0::double else -1.0::double end * (1 + ln(tf)) * (ln((e_n + 1.0::double) / (coalesce(df, 0) + 1)) + 1)) as part
                from {name}_tf left join e_df using (word), e_n group by all),
{name}_size as (select {key}, sqrt(sum(part * part)) as size from {name}_part group by {key}),
{name}_slots as (select {key}, slot, coalesce(part, 0) / coalesce(nullif(size, 0), 1) as x
                 from (select distinct {key} from {source}) cross join (select unnest(range(0, {dimensions})) as slot) left join {name}_part using ({key}, slot) left join {name}_size using ({key})),
{name} as (select {key}, list(round(x, 6) + 0.0 order by slot) as embedding from {name}_slots group by {key})"""


ENCODED = f"""
e_n as (select count(*) as e_n from d),
e_df as (select word, count(*) as df from (select doc, unnest(list_distinct({words('text')})) as word from d) group by word),{encoded('d_vectors', 'd', 'doc')}"""
CHAR_DENSE = f"""with {BASE}, {char_run(50)}, {ENCODED}, {encoded('q_vectors', 'q', 'query')},
dense_scores as (select a.query, b.doc, round(list_dot_product(a.embedding, b.embedding), 6) as score from q_vectors a, d_vectors b),
dense_run as (select query, doc, score, row_number() over (partition by query order by score desc, doc) as rank from dense_scores qualify rank <= 50),
fetched as (select 0 as sys, 'char_bm25' as name, * from char_run union all select 1, 'dense', * from dense_run)"""
FIFTY = f"with {BASE}, {word_run(50)}, {char_run(50)}, fetched as (select 0 as sys, 'char_bm25' as name, * from char_run union all select 1, 'word_bm25', * from word_run)"
