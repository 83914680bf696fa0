"""The library as a tree of folders and documents, kept as a flat table of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitext.functions import paths as P

SORTS = ["name-asc", "name-desc", "modified-asc", "modified-desc"]


def modified_at(original: Column, translation: Column) -> Column:
    """Latest modification of either side, 0 when neither is known."""
    return F.greatest(
        F.coalesce(original["modified_at"], F.lit(0)), F.coalesce(translation["modified_at"], F.lit(0))
    )


def with_folder(summary: DataFrame) -> DataFrame:
    """Add ``folder`` and ``modified_at`` to document summaries."""
    o, t = F.col("original"), F.col("translation")
    return summary.withColumn(
        "folder", P.document_folder(o["relative_path"], t["relative_path"])
    ).withColumn("modified_at", modified_at(o, t))


def _step(kind: int | Column, amount: Column, name: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, int) else kind
    return F.struct(kind.alias("kind"), amount.cast("long").alias("amount"), name.alias("name"))


def library_tree(summary: DataFrame, folders: DataFrame, sort: str = "name-asc") -> DataFrame:
    """All nodes of the library; ``orderBy`` of ``tree_order(sort)`` walks it top down.

    ``summary`` has project_id, document_id, title, original, translation;
    ``folders`` has project_id, relative_path.  Folders of documents are added.
    """
    if sort not in SORTS:
        raise ValueError(sort)
    descending = sort == "name-desc"
    # Folders come before documents.  Going down in the order, the larger step
    # comes first and a closing step puts a folder before its content.
    folder_kind, document_kind = (1, 0) if descending else (0, 1)
    close = F.array(_step(2, F.lit(0), F.lit(""))) if descending else None
    zero = F.lit(0)

    def steps(folder: Column) -> Column:
        return F.transform(P.components(folder), lambda c: _step(folder_kind, zero, P.sort_name(c)))

    def closed(key: Column) -> Column:
        return F.concat(key, close) if descending else key

    documents = with_folder(summary)
    paths = (
        folders.select("project_id", F.explode(P.ancestors(F.col("relative_path"))).alias("path"))
        .unionByName(
            documents.select("project_id", "folder").distinct()
            .select("project_id", F.explode(P.ancestors(F.col("folder"))).alias("path"))
        )
        .distinct()
    )
    path = F.col("path")
    folder_nodes = paths.select(
        "project_id",
        F.lit("folder").alias("kind"),
        F.concat(F.lit("folder:"), path).alias("key"),
        F.element_at(F.split(path, "/"), -1).alias("name"),
        path,
        P.parent_folder(path).alias("parent_path"),
        closed(steps(path)).alias("sort_key"),
    )
    amount = {"modified-desc": -F.col("modified_at"), "modified-asc": F.col("modified_at")}.get(sort, zero)
    own = F.array(_step(document_kind, amount, P.sort_name(F.col("title"))))
    document_nodes = documents.select(
        "project_id",
        F.lit("document").alias("kind"),
        F.concat(F.lit("document:"), "document_id").alias("key"),
        F.col("title").alias("name"),
        F.lit(None).cast("string").alias("path"),
        F.col("folder").alias("parent_path"),
        closed(F.concat(steps(F.col("folder")), own)).alias("sort_key"),
    )
    return folder_nodes.unionByName(document_nodes).withColumn(
        "depth", F.size(P.components(F.col("parent_path")))
    )


def tree_order(sort: str = "name-asc") -> list[Column]:
    """Order of the nodes from top to bottom, per project."""
    key = F.col("sort_key").desc() if sort == "name-desc" else F.col("sort_key").asc()
    return [F.col("project_id"), key, F.col("key")]


def visible_nodes(nodes: DataFrame, expanded: DataFrame) -> DataFrame:
    """Nodes below expanded folders only; ``expanded`` has project_id, path."""
    open_folders = expanded.select("project_id", F.col("path").alias("_above")).distinct().withColumn(
        "_open", F.lit(True)
    )
    # One row per folder on the way to a folder; documents share their folder's answer.
    places = nodes.select("project_id", "parent_path").distinct()
    shut = (
        places.select("project_id", "parent_path", F.explode(P.ancestors(F.col("parent_path"))).alias("_above"))
        .join(open_folders, ["project_id", "_above"], "left")
        .where(F.col("_open").isNull())
        .select("project_id", "parent_path")
        .distinct()
    )
    return nodes.join(shut, ["project_id", "parent_path"], "left_anti")


def folder_rollup(summary: DataFrame) -> DataFrame:
    """Documents and latest change below every folder, subfolders included."""
    # Counted per folder first, so that a folder with most documents moves one row per task.
    per_folder = with_folder(summary).groupBy("project_id", "folder").agg(
        F.count("*").alias("n"), F.max("modified_at").alias("m")
    )
    return (
        per_folder.select("project_id", F.explode(P.ancestors(F.col("folder"))).alias("path"), "n", "m")
        .groupBy("project_id", "path")
        .agg(F.sum("n").alias("documents"), F.max("m").alias("modified_at"))
    )
