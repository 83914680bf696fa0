"""Artifacts of processed documents as tables, catalogs, and readable text.

Tables are kept in buckets of documents rather than in one folder per document:
the number of files follows the data, not the number of documents.  They lie in a
store of versions, so that a reader never meets half of a write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext import schemas
from bitext.sources.store import Store

BUCKETS = 64
TABLES = ["segments", "translations", "math_objects", "alignments", "metadata", "source_text", "markdown"]


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table ``<store>/<name>`` as the last version has it; None when there is none."""
    root, _, name = path.rstrip("/").rpartition("/")
    return Store(spark, root).table(name)


def write_artifacts(
    tables: dict[str, DataFrame], path: str, buckets: int = BUCKETS, documents: DataFrame | None = None, batch: tuple[str, int] | None = None
) -> int:
    """Write the tables of processed documents; what these documents had before is replaced in all tables at once.

    The written documents are those of ``documents`` (doc_id), else all that any table has: one that no longer has rows in a table
    loses its old ones there.  Readers see the version before until all tables are written, also where the write is lost
    on the way.  Give ``buckets`` the size of the collection at the first write.  Gives the number of the version.
    """
    spark = next(iter(tables.values())).sparkSession
    return Store(spark, path).write(tables, "doc_id", buckets, documents, batch)


def read_reader_artifacts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Segments, translations and alignments of the documents that have all three."""
    names = ["segments", "translations", "alignments"]
    store = Store(spark, path)
    version = store.read_version()
    tables = {n: store.table(n, version) for n in names}
    if any(t is None for t in tables.values()):
        return {}
    complete = None
    for table in tables.values():
        ids = table.select("doc_id").distinct()
        complete = ids if complete is None else complete.join(ids, "doc_id", "left_semi")
    return {n: t.join(complete, "doc_id", "left_semi") for n, t in tables.items()}


def write_pages_as_text(pages: DataFrame, path: str, column: str = "text") -> None:
    """One folder of text files per document: its pages in order, a blank line after each.

    The files of a document sort by name into its order, however many there are.
    """
    (
        pages.select("doc_id", "page", F.concat(F.col(column), F.lit("\n")).alias("value"))
        .repartitionByRange("doc_id", "page")
        .sortWithinPartitions("doc_id", "page")
        .select("doc_id", "value")
        .write.mode("overwrite")
        .partitionBy("doc_id")
        .text(path)
    )


def write_catalog(records: DataFrame, path: str, batch: tuple[str, int] | None = None) -> int:
    """Catalog rows; all records of the projects they name are replaced.  A known ``batch`` (stream, number) changes nothing."""
    columns = ["project_id", "document_id", "ordinal", "original", "translation", "hidden"]
    return Store(records.sparkSession, path).write({"catalog": records.select(*columns)}, "project_id", BUCKETS, batch=batch)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows; a missing catalog is an empty one."""
    found = Store(spark, path).table("catalog")
    return spark.createDataFrame([], schemas.CATALOG) if found is None else found
