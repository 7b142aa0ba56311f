"""Shared folders and small-table helpers."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizes import spread

_SUMMED = 128
_LOCAL_FOLDER = "/tmp/checkpoints/lexmill"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where everything is one process."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or _LOCAL_FOLDER


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches of at most ``most`` bytes: a Python worker holds a few of them, whatever the texts' length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, "64m")).lower().rstrip("b")
    size = int(now[:-1]) << {"k": 10, "m": 20, "g": 30}[now[-1]] if now[-1] in "kmg" else int(now)
    if size > most or size <= 0:
        spark.conf.set(key, str(most))


class Shelf:
    """Intermediate tables in the shared folder: written once, read by later steps.

    A written table cuts the lineage, so a lost executor costs its running tasks and nothing before.
    ``drop`` removes what no result reads; the rest, which lazy results still read, goes at the driver's end.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        bounded_batches(spark)
        self.root = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        atexit.register(_remove, files, path)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _remove(files, path) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        files.delete(path, True)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(lengths: Column) -> Column:
    """Sums of all earlier elements; two levels, so that long arrays stay cheap."""

    def before(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    def joined(blocks: Column) -> Column:
        offsets = before(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)))
        return F.flatten(F.zip_with(blocks, offsets, lambda b, o: F.transform(before(b), lambda x: x + o)))

    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _SUMMED).cast("int")), lambda b: F.slice(all_, b * _SUMMED + 1, F.lit(_SUMMED)))
    return let(lengths, lambda all_: F.when(F.size(all_) > 0, let(cut(all_), joined)).otherwise(F.array().cast("array<int>")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in ("documents", "conversations") else found


def connected_components(spark: SparkSession, edges: DataFrame, shelf: Shelf, name: str, edges_a_task: int = 500_000) -> DataFrame:
    """(a, b) long pairs -> (node, root): root is the smallest node reachable.

    Alternates large-star and small-star until no pair changes; rounds grow with the logarithm of the
    longest chain.  Pairs stay in the cluster; each round is one written table.  A round's tables have
    one partition for each ``edges_a_task`` pairs, so a small graph is spared the shuffles.
    """
    e = edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = shelf.put(e.distinct(), f"{name}_0")
    before, turn = _names(e), 0
    while True:
        parts = before[0] // edges_a_task + 1
        few = lambda df: df.coalesce(parts)
        both = few(e).select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = few(large.unionByName(low.where("u <> m").select("u", F.col("m").alias("v")))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        turn += 1
        e = shelf.put(few(small.unionByName(low.select("u", F.col("m").alias("v")))).distinct(), f"{name}_{turn}")
        shelf.drop(f"{name}_{turn - 1}")
        now = _names(e)
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _names(e: DataFrame) -> tuple:
    """Count and hash sum of a set of pairs: equal on two turns, nothing moved."""
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
