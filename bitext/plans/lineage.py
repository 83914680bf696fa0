"""Cutting lineage with reliable checkpoints in the folder the cluster names."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Temporary folders of local sessions; each goes when the driver ends.
_temporary: list[tempfile.TemporaryDirectory] = []


def _bare(path: str) -> str:
    return re.sub(r"^[A-Za-z0-9+.-]+:/+", "/", path).rstrip("/")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only for a local master."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named and (current is None or _bare(current).rpartition("/")[0] != _bare(named)):
        context.setCheckpointDir(named)
    elif current is None:
        if not context.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that every executor reads.")
        _temporary.append(tempfile.TemporaryDirectory(prefix="bitext-checkpoint-", ignore_cleanup_errors=True))
        context.setCheckpointDir(_temporary[-1].name)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, written, and read back; survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """``df`` computed once, written as columns, and read back: later reads take the columns they need.

    The files lie in the checkpoint folder and go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/kept-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
