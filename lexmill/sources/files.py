"""Readers and writers for corpus files.

All reading goes through Spark's sources, so any file system Spark knows works; order is explicit:
``ordinal`` follows the sorted file paths, then the position in the file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import numbered
from ..runlog import logger
from ..schemas import DOCUMENT

_STEM = r"([^/]*?)(?:\.[^./]*)?$"
_SPLIT = 4 << 20
_FILE_STEP = 1 << 32  # positions below one file in ``ordinal``
_BLANK = r"^[ \t\x0b\f]*$"  # a line that parts paragraphs
_BODY = r"(?U)[^\s\x1c-\x1f]"


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.getFileStatus(p).isDirectory()


def ensure_dir(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    fs.mkdirs(p)
    return path


def _files(spark: SparkSession, path: str) -> list[str]:
    """Sorted files under a path; a file is itself.  Listing only: contents stay with the executors."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(p).isDirectory():
        return [fs.getFileStatus(p).getPath().toString()]
    found, todo = [], fs.listFiles(p, True)
    while todo.hasNext():
        found.append(todo.next().getPath().toString())
    return sorted(found)


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, start of the split, file ordinal, line number from 0, line); a line ends in any newline.

    A large file is read in splits.  Lines are numbered within their split; a split's offset is the sum of
    the line counts of the file's earlier splits, one small row each.
    """
    at = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    rows = spark.read.text(files).select(*at, F.col("value").alias("line"))
    splits = rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("path", "block", (F.dense_rank().over(W.orderBy("path")) - 1).alias("file"), (earlier - F.col("first")).alias("shift"))
    return rows.join(_few_splits(splits, rows, files), ["path", "block"]).select("path", "block", "file", (F.col("at") + F.col("shift")).alias("i"), "line")


def _few_splits(splits: DataFrame, rows: DataFrame, files: list[str]) -> DataFrame:
    """A broadcast hint for a row a split of ``files``, of which ``rows`` were read, where they are few.

    A split has 4 MB (the cost of opening a file) or its file's rest, so their number has a known bound.
    """
    size = int(rows._jdf.queryExecution().analyzed().stats().sizeInBytes())
    return F.broadcast(splits) if len(files) + size // _SPLIT <= 100_000 else splits


def _stem() -> Column:
    return F.regexp_extract(F.col("path"), _STEM, 1)


def _document(doc_id: Column, position: Column, text: Column, metadata: Column) -> list[Column]:
    ordinal = F.col("file").cast("long") * _FILE_STEP + position.cast("long")
    return [doc_id.alias("doc_id"), ordinal.alias("ordinal"), text.alias("text"), F.col("path").alias("source"), metadata.cast("map<string,string>").alias("metadata")]


def _paragraphs(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, file, number from 0, text) of runs of lines between blank ones; runs of white space alone don't count.

    Splits are numbered apart.  A row for each split then says how many paragraphs earlier ones began, and whether
    the last of those is still open where the split begins: the lines up to its first blank one go on with it.
    """
    line, i = F.col("line"), F.col("i")
    rows = _lines(spark, files).withColumns({"blank": F.when(line.rlike(_BLANK), i), "body": F.when(line.rlike(_BODY), i)})
    own = W.partitionBy("path", "block").orderBy("i")
    latest = lambda c, end, none: F.coalesce(F.max(c).over(own.rowsBetween(W.unboundedPreceding, end)), F.lit(none))
    begins = F.col("body").isNotNull() & (latest("body", -1, -2) < latest("blank", 0, -1))
    rows = rows.withColumn("begins", begins).withColumn("n", F.sum(F.col("begins").cast("long")).over(own.rowsBetween(W.unboundedPreceding, 0)))

    ends = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("blank", "body")]
    splits = rows.groupBy("path", "block").agg(F.max("n").alias("begun"), *ends)
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("open", F.coalesce(F.max("max_body").over(earlier), F.lit(-2)) > F.coalesce(F.max("max_blank").over(earlier), F.lit(-1)))
    goes_on = F.col("open") & F.coalesce(F.col("min_body") < F.coalesce("min_blank", F.col("max_body") + 1), F.lit(False))
    splits = splits.withColumn("joined", goes_on.cast("long")).withColumn("before", F.coalesce(F.sum(F.col("begun") - F.col("joined")).over(earlier), F.lit(0)))
    splits = splits.select("path", "block", "open", "min_blank", "joined", "before")

    rows = rows.where("blank is null").join(_few_splits(splits, rows, files), ["path", "block"])
    head = F.col("open") & (i < F.coalesce("min_blank", i + 1))
    rows = rows.withColumn("number", F.when(head, F.col("before")).otherwise(F.col("before") + F.col("n") - F.col("joined"))).where("number > 0")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda r: r["line"])
    text = F.regexp_replace(F.array_join(lines, "\n"), r"^(?U)[\s\x1c-\x1f]+|(?U)[\s\x1c-\x1f]+$", "")
    return rows.groupBy("path", "file", "number").agg(text.alias("text")).select("path", "file", (F.col("number") - 1).alias("i"), "text")


def read_txt(spark: SparkSession, files: list[str]) -> DataFrame:
    """A document for each paragraph; numbers count the paragraphs that aren't empty.

    A large file is read in splits; a paragraph may span any number of them.
    """
    df = _paragraphs(spark, files)
    return df.select(*_document(numbered_plain(_stem(), F.col("i")), F.col("i"), F.col("text"), F.create_map(F.lit("paragraph_index"), F.col("i").cast("string"))))


def numbered_plain(stem: Column, number: Column) -> Column:
    return F.format_string("%s_%04d", stem, number)


def read_jsonl(spark: SparkSession, files: list[str]) -> DataFrame:
    """A document for each JSON line; numbers count all lines, blank ones too."""
    lines = _lines(spark, files).where(F.trim("line") != "")
    record = lines.withColumn("r", F.from_json("line", "text string, metadata map<string,string>", {"mode": "FAILFAST"}))
    text = F.coalesce(F.col("r.text"), F.raise_error(F.concat(F.lit("no text at "), F.col("path"), F.lit(":"), (F.col("i") + 1).cast("string"))))
    return record.select(*_document(numbered_plain(_stem(), F.col("i")), F.col("i"), text, F.coalesce("r.metadata", F.create_map().cast("map<string,string>"))))


def pdf_pages(data: bytes) -> list[str]:
    """Page texts by pypdf or PyPDF2; none where neither is installed."""
    import io

    try:
        from pypdf import PdfReader
    except ImportError:
        try:
            from PyPDF2 import PdfReader
        except ImportError:
            return []
    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]


def read_pdf(spark: SparkSession, files: list[str], parse: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """A document for each page with text, ``{stem}_p0001``."""

    def pages(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            rows = [(path, i, text) for path, content in zip(pdf["path"], pdf["content"]) for i, text in enumerate(parse(bytes(content))) if text.strip()]
            yield pd.DataFrame(rows, columns=["path", "i", "text"])

    df = spark.read.format("binaryFile").load(files).select("path", "content").mapInPandas(pages, "path string, i int, text string")
    order = spark.createDataFrame([(f, i) for i, f in enumerate(files)], "path string, file int")
    return df.join(order, "path").select(*_document(F.format_string("%s_p%04d", _stem(), F.col("i")), F.col("i"), F.trim("text"), F.create_map(F.lit("page"), F.col("i").cast("string"))))


_READERS = {".txt": read_txt, ".jsonl": read_jsonl, ".pdf": read_pdf}


def load(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file or of all files under a folder; other suffixes are left out with a warning."""
    files, docs = _files(spark, path), None
    if odd := [f for f in files if not re.search(r"\.(txt|jsonl|pdf)$", f, re.IGNORECASE)]:
        logger("lexmill").warning("%d files of other kinds left out, the first is %s", len(odd), odd[0])
    for suffix, read in _READERS.items():
        if own := [f for f in files if re.search(rf"{re.escape(suffix)}$", f, re.IGNORECASE)]:
            part = read(spark, own)
            docs = part if docs is None else docs.unionByName(part)
    return docs if docs is not None else spark.createDataFrame([], DOCUMENT)


def load_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; a bad line fails and names path and line."""
    lines = _lines(spark, _files(spark, path)).where(F.trim("line") != "")
    record = F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = F.try_parse_json("line").isNull()
    where = F.concat(F.lit("bad JSON at "), F.col("path"), F.lit(":"), (F.col("i") + 1).cast("string"))
    return lines.select(F.when(bad, F.raise_error(where).cast(record_type(schema))).otherwise(record).alias("r")).select("r.*")


def record_type(schema: str) -> str:
    return f"struct<{', '.join(': '.join(field.strip().split(' ', 1)) for field in _fields(schema))}>"


def _fields(schema: str) -> list[str]:
    """Top-level fields of a DDL schema."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[last:i])
            last = i + 1
    return [*out, schema[last:]]


def save_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def load_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def save_text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def load_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, cells): lines are stripped before they are split, so empty cells at the end are lost."""
    lines = _lines(spark, _files(spark, path))
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    return lines.select((F.col("file").cast("long") * _FILE_STEP + F.col("i")).alias("ordinal"), line.alias("line")).where("line <> ''").select("ordinal", F.split("line", "\t").alias("cells"))


def save_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("quote", "").option("escape", "").csv(path, header=header)
