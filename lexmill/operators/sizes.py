"""Broadcasts behind a check of their size; small files dealt over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 500_000


def fits(df: DataFrame, most: int = MOST_ROWS) -> bool:
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows; else as it is, for a shuffle join."""
    return F.broadcast(df) if fits(df, most) else df


def spread(scan: DataFrame) -> DataFrame:
    """A table as read, dealt over the cores where its files come in fewer pieces than there are cores.

    A file of one row group is one task whatever the cluster; larger tables stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
