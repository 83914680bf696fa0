"""Catalogs kept up to date from a stream of file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from bitext.operators.catalog import reconcile
from bitext.plans.lineage import cut
from bitext.sources.artifacts import read_catalog, write_catalog
from bitext.sources.store import Store


def incremental_reconcile(listings: DataFrame, projects: DataFrame, path: str, name: str = "listings") -> DataStreamWriter:
    """A writer that reconciles every micro-batch of listings with the kept catalog.

    ``listings`` has the columns of the files table; a micro-batch holds whole
    listings of the projects it names.  The number of the batch is published with the catalog, under the
    stream's ``name``: a batch that is run again after that is known, and nothing is matched or written.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if Store(spark, path).knows((name, batch_id)):
            return
        files = cut(batch.dropDuplicates(["project_id", "side", "relative_path"]))
        named = files.select("project_id").distinct()
        catalog = read_catalog(spark, path).join(named, "project_id", "left_semi")
        known = projects.join(named, "project_id", "left_semi")
        write_catalog(cut(reconcile(catalog, files, known, snapshot=str(batch_id))), path, (name, batch_id))

    return listings.writeStream.foreachBatch(apply)
