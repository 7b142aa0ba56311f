"""The jobs as registered queries: each runs twice into one new folder and returns all it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import ingest_corpus, training_rows
from lexmill.plans import oracle as O
from lexmill.store import new_folder


def job1_ingest_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run finds nothing new and leaves the chunks of the first."""
    folder = new_folder(spark, "job1")
    at = (f"{sf_dir}/documents.parquet", f"{folder}/corpus", f"{folder}/state")
    ingest_corpus.run(spark, *at)
    return ingest_corpus.run(spark, *at)


def job2_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job2")
    at = (f"{sf_dir}/benchmark.parquet", f"{sf_dir}/documents.parquet", folder)
    training_rows.run(spark, *at)
    return training_rows.run(spark, *at)


QUERIES = {"job1_ingest_corpus": job1_ingest_corpus, "job2_training_rows": job2_training_rows}
ORACLE_SQL = {
    "job1_ingest_corpus": f"""with cleaned as (select doc_id, source, {O.clean('text')} as text from documents),
kept as (select * from cleaned where length(text) >= 20 qualify row_number() over (partition by md5(text) order by doc_id) = 1),
{O.CHUNKS.replace('from documents', 'from kept')}
select chunk_id, text, doc_id, chunk_index, 0::int as batch, nullif(source, '') as source from chunks""",
    "job2_training_rows": f"""with {O.BASE}, {O.word_run(50)}, {O.GOLD}, n as (select count(*) as n from q),
wrong as (select r.* from word_run r where not exists (select 1 from gold g where g.query = r.query and g.doc = r.doc)),
hard as (select query, doc as negative, score, (row_number() over (partition by query order by rank))::int as position from wrong qualify position <= 5),
positives as (select query, min(doc) as positive from gold group by query)
select query // 16 as batch, query, q.text as question, positive, a.text as positive_text, position, negative, b.text as negative_text, score,
       case when query < greatest(1, (n * 0.9)::int) then 'train' else 'eval' end as part
from hard join positives using (query) join q using (query) join d a on a.doc = positive join d b on b.doc = negative, n""",
}
