"""Array columns to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unfold(df: DataFrame, array: str | Column, value: str, position: str | None = None) -> DataFrame:
    """One row per element of ``array``; rows without elements drop out.

    The outer form keeps the optimizer from copying the array's expression into
    a filter on its size below the generator, where it would be computed again.
    """
    place = position or "_place"
    kept = df.select("*", F.posexplode_outer(array).alias(place, value)).where(F.col(place).isNotNull())
    return kept if position else kept.drop(place)


def with_parallelism(df: DataFrame, key: str | None = None, tasks_per_core: int = 1) -> DataFrame:
    """Spread a table that arrives in fewer splits or files than wanted, by its first column.

    Tables of many files pass through untouched.  A split may hold no rows at all: a file is as many tasks as it has row groups,
    however many ranges of bytes it is cut into, so that only files count.  Rows that are narrow and costly want some tasks for
    each core.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism * tasks_per_core
    files = len(df.inputFiles()) or wanted
    return df.repartition(wanted, key or df.columns[0]) if min(files, df.rdd.getNumPartitions()) < wanted else df


def dealt(df: DataFrame, rows: int, per_task: int, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to more tasks than Spark would take, where those would get more than ``per_task`` of ``rows``."""
    wanted = -(-rows // per_task)
    return df.repartition(wanted, *keys) if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
