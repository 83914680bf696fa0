"""Project folders: their files, manifests and catalogs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext import constants as K
from bitext import schemas
from bitext.functions import paths as P
from bitext.functions import text as T
from bitext.sources.listing import RANGE_BYTES, list_files, read_lines, read_whole
from bitext.sources.paths import open_path, qualified


def _below(root: str, path: Column) -> Column:
    """Path relative to ``root``, whatever scheme either is written with."""
    bare = lambda c: F.regexp_replace(c, r"^[a-z0-9]+:/+", "/")
    top = F.concat(F.regexp_replace(bare(F.lit(root)), r"/+\z", ""), F.lit("/"))
    return F.substr(bare(path), F.length(top) + 1)


def _digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each file, read a megabyte at a time."""
    for frame in frames:
        digests = []
        for path in frame["path"]:
            system, plain = open_path(path)
            state = hashlib.sha256()
            with system.open_input_stream(plain) as source:
                while chunk := source.read(1 << 20):
                    state.update(chunk)
            digests.append(state.hexdigest())
        yield frame.assign(sha256=digests)


def _known(path: Column, extensions: list[str]) -> Column:
    return P.extension(path).isin([e.lower() for e in extensions])


def _with_digest(files: DataFrame, root: str) -> DataFrame:
    """Files with the SHA-256 of their content; they are dealt to tasks anew, whatever folder they are in."""
    top = qualified(files.sparkSession, root).rstrip("/") + "/"
    types = ", ".join(f"`{n}` {t}" for n, t in files.dtypes)
    full = files.withColumn("relative", F.col("path")).withColumn("path", F.concat(F.lit(top), "path"))
    hashed = full.repartition("path").mapInPandas(_digest, f"{types}, relative string, sha256 string")
    return hashed.withColumn("path", F.col("relative")).drop("relative")


def scan_files(
    spark: SparkSession, root: str, directory: str, side: str, project_id: str, extensions: list[str] | None = None
) -> DataFrame:
    """The files of one side of a project with digest, size and time.

    All names count, also those that start with ``.`` or ``_``; symbolic links do not.  Folders are listed and files hashed in
    tasks; a file is hashed in pieces, whatever its size.
    """
    allowed = extensions or (K.ORIGINAL_EXTENSIONS if side == "original" else K.TRANSLATION_EXTENSIONS)
    folder = f"{root.rstrip('/')}/{directory}"
    files = list_files(spark, folder).where(_known(F.col("path"), allowed))
    path = F.concat(F.lit(f"{directory.strip('/')}/"), "path")
    return _with_digest(files.drop("unit"), folder).select(
        F.lit(project_id).alias("project_id"), F.lit(side).alias("side"), path.alias("relative_path"),
        "sha256", "size", "modified_at", P.media_type(P.extension(path)).alias("media_type"),
    )


def files_of_projects(listed: DataFrame, root: str, projects: DataFrame) -> DataFrame:
    """The files table of many projects from a listing below ``root`` (batch or stream) whose units are the projects' folders.

    ``projects`` has unit (its folder below the root), project_id, original_dir and translation_dir.  Files outside of both
    folders, or of other kinds, are left out.
    """
    inner = F.substring("path", F.length("unit") + 2, F.length("path"))
    joined = listed.withColumn("relative_path", inner).join(projects.withColumnRenamed("unit", "_unit"), F.col("unit") == F.col("_unit"))
    below = lambda c: F.startswith(F.col("relative_path"), F.concat(F.col(c), F.lit("/")))
    kind = P.extension(F.col("relative_path"))
    original = below("original_dir") & kind.isin([e.lower() for e in K.ORIGINAL_EXTENSIONS])
    translation = below("translation_dir") & kind.isin([e.lower() for e in K.TRANSLATION_EXTENSIONS])
    sided = joined.withColumn("side", F.when(original, "original").when(translation, "translation")).where("side IS NOT NULL")
    return _with_digest(sided.select("path", "project_id", "side", "relative_path", "size", "modified_at"), root).select(
        "project_id", "side", "relative_path", "sha256", "size", "modified_at",
        P.media_type(P.extension(F.col("relative_path"))).alias("media_type"),
    )


def read_translation_texts(spark: SparkSession, root: str, directory: str) -> DataFrame:
    """``(relative_path, text)`` of the Markdown and text files of a translation folder, of every name that a scan finds."""
    folder = f"{root.rstrip('/')}/{directory}"
    files = list_files(spark, folder).where(_known(F.col("path"), [e for e in K.TRANSLATION_EXTENSIONS if e != "pdf"]))
    return read_whole(files, folder).select(F.concat(F.lit(f"{directory.strip('/')}/"), "path").alias("relative_path"), "text")


def read_translation_lines(spark: SparkSession, root: str, directory: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(relative_path, start, line)`` of the same files, large ones read by ranges in many tasks."""
    folder = f"{root.rstrip('/')}/{directory}"
    files = list_files(spark, folder).where(_known(F.col("path"), [e for e in K.TRANSLATION_EXTENSIONS if e != "pdf"]))
    return read_lines(files, folder, range_bytes).select(F.concat(F.lit(f"{directory.strip('/')}/"), "path").alias("relative_path"), "start", "line")


def load_project_manifests(spark: SparkSession, pattern: str, below: str = "/") -> DataFrame:
    """Valid projects among the manifest files a glob finds, by name.

    ``pattern`` ends in ``<project root>/<state folder>/project.json``; folders on
    the way from ``below`` to a project that hold build output, copies or hidden
    data rule it out.  Of roots that differ in letter case only, one is kept.
    """
    read = (
        spark.read.schema(schemas.PROJECT_FILE + ", _broken string")
        .option("multiLine", "true")
        .option("columnNameOfCorruptRecord", "_broken")
        .json(pattern)
        .select(
            "*",
            F.col("_metadata.file_path").alias("_path"),
            F.unix_timestamp("_metadata.file_modification_time").alias("modified_at"),
        )
    )
    single = lambda c: (
        ~T.is_blank(T.or_empty(F.col(c))) & ~F.regexp_like(c, F.lit(r"[/\\]")) & ~F.col(c).isin(".", "..")
    )
    root = F.regexp_replace(F.regexp_replace("_path", r"^[a-z0-9]+:/+", "/"), r"/[^/]+/[^/]+\z", "")
    between = P.components(_below(below, root))
    skipped = F.exists(
        F.transform(between, F.lower),
        lambda c: c.isin(K.SKIPPED_DIRECTORIES) | F.regexp_like(c, F.lit(r"^\.|_orig\z|_trad\z")),
    )
    valid = (
        F.col("_broken").isNull()
        & (F.col("schemaVersion") == K.SCHEMA_VERSION)
        & ~T.is_blank(T.or_empty(F.col("projectId")))
        & ~T.is_blank(T.or_empty(F.col("name")))
        & single("originalDir")
        & single("translationDir")
    )
    record = F.struct(
        F.col("root").alias("root"), F.col("projectId").alias("project_id"), "name",
        F.col("originalDir").alias("original_dir"), F.col("translationDir").alias("translation_dir"), "modified_at",
    )
    return (
        read.where(valid)
        .withColumn("root", root)
        .where(~skipped)
        .groupBy(F.lower("root"))
        .agg(F.min(record).alias("_r"))
        .select("_r.*")
        .orderBy(F.lower("name"), "root")
    )


def _reference(c: str) -> Column:
    return F.when(
        F.col(c).isNotNull(),
        F.struct(
            F.col(f"{c}.relativePath").alias("relative_path"), F.col(f"{c}.sha256").alias("sha256"),
            F.col(f"{c}.size").alias("size"), F.col(f"{c}.modifiedAt").alias("modified_at"),
            F.col(f"{c}.mediaType").alias("media_type"),
        ),
    )


def _records(read: DataFrame, project: Column) -> DataFrame:
    """Catalog rows of documents files that Spark has read."""
    rows = read.where(F.col("schemaVersion") == K.SCHEMA_VERSION).select(
        project.alias("project_id"), F.posexplode("documents").alias("ordinal", "d")
    ).select("project_id", "ordinal", "d.*")
    return rows.select(
        "project_id", F.col("documentId").alias("document_id"), F.col("ordinal").cast("long").alias("ordinal"),
        _reference("original").alias("original"), _reference("translation").alias("translation"),
        F.coalesce("hidden", F.lit(False)).alias("hidden"),
    )


def read_catalog_file(spark: SparkSession, path: str, project_id: str) -> DataFrame:
    """The catalog of one project folder; a missing file is an empty catalog."""
    try:
        read = spark.read.schema(schemas.CATALOG_FILE).option("multiLine", "true").json(path)
        return _records(read, F.lit(project_id))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schemas.CATALOG)


def read_catalog_files(projects: DataFrame, pattern: str) -> DataFrame:
    """The catalogs of many projects in one read; ``projects`` has root and project_id, as ``load_project_manifests`` gives them.

    ``pattern`` is a glob that ends in ``<project root>/<state folder>/<file>``.  A broken file, or one of another schema
    version, is an empty catalog.
    """
    read = projects.sparkSession.read.schema(schemas.CATALOG_FILE).option("multiLine", "true").json(pattern)
    root = F.regexp_replace(F.regexp_replace("_metadata.file_path", r"^[a-z0-9]+:/+", "/"), r"/[^/]+/[^/]+\z", "")
    known = projects.select(F.col("root").alias("_root"), "project_id")
    return _records(read.withColumn("_place", root).join(known, F.col("_place") == F.col("_root")), F.col("project_id"))
