"""Folders as Spark names them, reached from tasks."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import SparkSession


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a folder, with or without scheme."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: one without lies in the file system that Spark uses by default."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
