"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A document's size is its number of words.  The k-th source by code point (null last) has the weight
5, 2 or 1, repeating; all sources share ``share`` times the corpus by weight, no target above ``most``
times its source's size, the excess reshared by weight (water-filling, solved in one ordered pass over
the sources).

A source first gives its complete epochs, every document as often.  What its target still lacks is
drawn: each document has the key -ln(u) / w, u a hash of its id and the seed, w its quality weight (the
share of its characters that are not digits or markup); documents are taken by ascending key while
the middle of the document lies within the budget, so a source misses its target by half a document
at most.

Prefix sums never sort a whole source: keys fall into ``buckets`` ordered buckets, bucket sums are
prefix-summed, and only the bucket that the budget ends in is sorted.  A source with a third of all
rows costs no task more than its share.

Null texts have size 0 and the least weight; null ids share one u; repeated rows are drawn one by one
(equal rows are interchangeable, so reruns agree); an empty table gives an empty result; other columns
are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .support import Shelf, table

#: The sources' weights by their order, repeating.
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
_MARKUP = "0123456789#*$%&|<>{}[]_=~^\\"
_MOST_BROADCAST_SOURCES = 50_000


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, buckets: int, carry: list[str]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    sized = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        (F.length(F.translate(text, _MARKUP, "")) / F.greatest(F.length(text), F.lit(1)) + 0.25).alias("w"),
        u.alias("u"),
        *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []),
    )
    key = -F.log("u") / F.col("w")
    return sized.select("id", "source", "size", key.alias("key"), F.floor((1 - F.exp(-key)) * buckets).cast("int").alias("bucket"), *(["row"] if carry else []))


def _targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """(source, source_size) -> its target.  One row a source: the unpartitioned windows are over those."""
    order = W.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).withColumn("level", F.col("cap") / F.col("weight"))
    by_level = W.orderBy("level", F.asc_nulls_last("source"))
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    s = s.withColumn("given", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("water", (F.sum("source_size").over(everything) * share - F.col("given")) / F.col("left"))
    # sources in the order of the windows, ties by source: the first whose level the water doesn't pass sets it
    s = s.withColumn("water", F.min(F.when(F.col("water") <= F.col("level"), F.struct("level", F.col("source").isNull().alias("last"), "source", "water"))).over(everything)["water"])
    return s.select("source", "source_size", F.least("cap", F.col("weight") * F.coalesce("water", F.lit(float("inf")))).alias("target"))


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    buckets: int = 4096,
    carry: list[str] | None = None,
) -> DataFrame:
    """``id``, ``source``, ``size``, ``source_size``, ``target``, ``times`` and ``taken`` for each row.

    ``carry`` names columns to keep beside them, as a struct ``row``.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark)
    sized = shelf.put(_sized(docs, id_col, text_col, source_col, seed, buckets, carry or []), "sized")
    sums = shelf.put(sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "sums")
    targets = _targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), share, most)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    up_to = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    ends = sums.withColumn("up_to", F.sum("bucket_size").over(up_to)).withColumnRenamed("source", "s")
    # the bucket that the budget ends in, and what lies before it
    ends = ends.join(targets.select("source", "budget"), F.col("s").eqNullSafe(F.col("source"))).where("up_to > budget")
    ends = ends.groupBy("s").agg(F.min(F.struct("bucket", (F.col("up_to") - F.col("bucket_size")).alias("before"))).alias("end"))
    cuts = targets.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "epochs", "budget", F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("before"))
    cuts = shelf.put(cuts, "cuts")
    if cuts.count() <= _MOST_BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    rows = sized.join(cuts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    clear = rows.where("end_bucket is null or bucket <> end_bucket").withColumn("drawn", F.col("end_bucket").isNull() & (F.col("budget") > 0) | F.coalesce(F.col("bucket") < F.col("end_bucket"), F.lit(False)))
    in_order = W.partitionBy("source").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    ending = rows.where("bucket = end_bucket").withColumn("to", F.sum("size").over(in_order))
    ending = ending.withColumn("drawn", F.col("before") + F.col("to") - F.col("size") / 2 <= F.col("budget")).drop("to")
    times = F.col("epochs") + F.col("drawn").cast("long")
    return clear.unionByName(ending).select("id", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"), *(["row"] if carry else []))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


#: Fixed values as in ``mixed``: share 1.5, most 2, seed 17, 4096 buckets.
OP7_SQL = r"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         length(translate(coalesce(text, ''), '0123456789#*$%&|<>{}[]_=~^\', '')) / greatest(length(coalesce(text, '')), 1)::double + 0.25 as w,
         (('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':17'), 1, 13))::bigint::double + 0.5) / pow(2, 52) as u
  from documents),
keyed as (select *, -ln(u) / w as key, cast(floor((1 - exp(-(-ln(u) / w))) * 4096) as int) as bucket from sized),
sources as (select source, sum(size)::double as source_size from keyed group by source),
weighted as (select *, list_value(5, 2, 1)[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from sources),
levels as (select *, source_size * 2 as cap, source_size * 2 / weight as level from weighted),
waters as (
  select *, (sum(source_size) over () * 1.5 - coalesce(sum(cap) over (order by level, source nulls last rows between unbounded preceding and 1 preceding), 0))
            / (sum(weight) over () - coalesce(sum(weight) over (order by level, source nulls last rows between unbounded preceding and 1 preceding), 0)) as water
  from levels),
water as (select water from waters where water <= level order by level, water limit 1),
targets as (
  select source, source_size, least(cap, coalesce(weight * (select water from water), cap)) as target from waters),
cuts as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from targets),
summed as (
  select k.doc_id, k.size, c.source_size, c.target, c.epochs, c.target - c.epochs * c.source_size as budget,
         sum(k.size) over (partition by k.source order by k.bucket, k.key, k.doc_id, k.size rows unbounded preceding) as up_to
  from keyed k join cuts c on k.source is not distinct from c.source)
select doc_id, size, cast(source_size as bigint) as source_size, target,
       cast((epochs + case when budget > 0 and up_to - size / 2.0 <= budget then 1 else 0 end) * size as bigint) as taken
from summed
"""
