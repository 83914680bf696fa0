"""Project folders on disk, stores of versions and catalogs that grow, laid out from the given tables.

Documents are written as files of projects, some under hidden names, beside files that do not count.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext import schemas
from bitext.sources import artifacts as S
from bitext.sources import files as FS
from bitext.sources.listing import list_files, read_lines, write_files
from bitext.sources.store import Store
from bitext.streaming.catalog import incremental_reconcile
from checks import adapters as A
from checks import catalog as C
from checks.register import registry
from checks.sql import VIEWS
from checks.stream import new_folder

QUERIES, SQL, check = registry()

# ---------------------------------------------------------------- files on disk


def laid(spark, folder) -> DataFrame:
    """The files of the documents with their text; every seventh one lies under hidden names."""
    texts = A.table(spark, folder, "documents").select("doc_id", "text").where("text IS NOT NULL")
    path = F.when(F.col("doc_id") % 7 == 0, F.regexp_replace("relative_path", "^(C_orig|C_trad)/", "$1/.kept/_")).otherwise(F.col("relative_path"))
    return C.files(spark, folder).join(texts, "doc_id").withColumn("relative_path", path)


VIEWS["v_laid"] = r"""
SELECT v.* EXCLUDE (relative_path), text,
  CASE WHEN v.doc_id % 7 = 0 THEN regexp_replace(relative_path, '^(C_orig|C_trad)/', '\1/.kept/_') ELSE relative_path END AS relative_path
FROM v_files v JOIN documents d USING (doc_id) WHERE text IS NOT NULL
"""


def lay_out(spark, folder) -> str:
    """Writes the files below a new folder, and a note beside every eleventh one; gives the folder."""
    root = new_folder(spark, "projects")
    rows = laid(spark, folder).withColumn("path", F.concat("project_id", F.lit("/"), "relative_path"))
    notes = rows.where("doc_id % 11 = 0").withColumn("path", F.concat("path", F.lit(".doc")))
    write_files(rows.unionByName(notes), root)
    return root


@check(
    "scan_files",
    "SELECT project_id, side, relative_path, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size, media_type FROM v_laid",
)
def _(spark, folder):
    root = lay_out(spark, folder)
    projects = C.projects(spark, folder).withColumn("unit", F.col("project_id"))
    return FS.files_of_projects(list_files(spark, root, folders=8), root, projects).drop("modified_at")


@check(
    "translation_lines",
    """SELECT path, start, regexp_replace(line, '\r$', '') AS line FROM (
         SELECT project_id || '/' || relative_path AS path, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS k, len(lines) AS n,
                CAST(unnest(list_transform(range(1, len(lines) + 1), lambda i: coalesce(list_sum(list_transform(lines[1:i-1], lambda l: strlen(l) + 1)), 0))) AS BIGINT) AS start
         FROM (SELECT *, string_split(text, chr(10)) AS lines FROM v_laid WHERE side = 'translation' AND media_type <> 'application/pdf'))
       WHERE k < n OR line <> ''""".replace("\r", "' || chr(13) || '"),
)
def _(spark, folder):
    root = lay_out(spark, folder)
    files = list_files(spark, root).where(F.regexp_like("path", F.lit(r"^[^/]+/C_trad/.*\.(md|markdown|txt)\z")))
    return read_lines(files, root, range_bytes=1500)


# Projects of twenty documents; some manifests are of another version, broken, or in folders that do not count.
VIEWS["v_manifests"] = """
SELECT n, 'p' || n AS project_id, CASE n % 9 WHEN 8 THEN ' ' ELSE 'Project ' || (n % 4) || ' ' || n END AS name,
       CASE n % 4 WHEN 1 THEN 'build' WHEN 2 THEN '.cache' ELSE 'shelf' END AS shelf, CASE n % 5 WHEN 0 THEN 2 ELSE 1 END AS version,
       CASE n % 7 WHEN 6 THEN 'a/b' ELSE 'C_trad' END AS translation_dir, n % 6 = 5 AS broken
FROM (SELECT DISTINCT doc_id // 20 AS n FROM documents)
"""


def manifests(spark, folder) -> DataFrame:
    n = F.col("n")
    return A.table(spark, folder, "documents").select(F.floor(F.col("doc_id") / 20).alias("n")).distinct().select(
        "n", F.concat(F.lit("p"), n.cast("string")).alias("project_id"),
        F.when(n % 9 == 8, " ").otherwise(F.concat(F.lit("Project "), (n % 4).cast("string"), F.lit(" "), n.cast("string"))).alias("name"),
        F.when(n % 4 == 1, "build").when(n % 4 == 2, ".cache").otherwise("shelf").alias("shelf"), F.when(n % 5 == 0, 2).otherwise(1).alias("version"),
        F.when(n % 7 == 6, "a/b").otherwise("C_trad").alias("translation_dir"), (n % 6 == 5).alias("broken"),
    )


VALID = "version = 1 AND NOT broken AND name <> ' ' AND translation_dir <> 'a/b' AND shelf = 'shelf'"


def written_manifests(spark, folder) -> str:
    root = new_folder(spark, "manifests")
    config = F.to_json(F.struct(
        F.col("project_id").alias("projectId"), "name", F.col("version").alias("schemaVersion"), F.lit("C_orig").alias("originalDir"),
        F.col("translation_dir").alias("translationDir"),
    ))
    write_files(manifests(spark, folder).select(
        F.concat("shelf", F.lit("/"), "project_id", F.lit("/state/project.json")).alias("path"),
        F.when(F.col("broken"), F.expr("'{nope'")).otherwise(config).alias("text"),
    ), root)
    return root


def loaded(spark, root: str) -> DataFrame:
    return FS.load_project_manifests(spark, f"{root}/*/*/state/project.json", root)


@check("project_manifests", f"SELECT shelf || '/' || project_id AS place, project_id, name, 'C_orig' AS original_dir, translation_dir FROM v_manifests WHERE {VALID}")
def _(spark, folder):
    root = written_manifests(spark, folder)
    place = F.regexp_extract("root", r"([^/]+/[^/]+)\z", 1)
    return loaded(spark, root).select(place.alias("place"), "project_id", "name", "original_dir", "translation_dir")


@check(
    "catalog_files",
    f"""SELECT m.project_id, 'doc' || doc_id AS document_id, row_number() OVER (PARTITION BY m.project_id ORDER BY doc_id) - 1 AS ordinal,
               CASE WHEN side = 'original' THEN relative_path END AS original_path, CASE WHEN side = 'original' THEN sha256 END AS original_sha256,
               CASE WHEN side = 'translation' THEN relative_path END AS translation_path, doc_id % 13 = 0 AS hidden
        FROM v_files f JOIN v_manifests m ON f.doc_id // 20 = m.n WHERE {VALID}""",
)
def _(spark, folder):
    root = written_manifests(spark, folder)
    files = C.files(spark, folder).withColumn("n", F.floor(F.col("doc_id") / 20)).drop("project_id")
    reference = F.struct(
        F.col("relative_path").alias("relativePath"), "sha256", "size", F.col("modified_at").alias("modifiedAt"), F.col("media_type").alias("mediaType")
    )
    document = F.struct(
        "doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("documentId"),
        F.when(F.col("side") == "original", reference).alias("original"), F.when(F.col("side") == "translation", reference).alias("translation"),
        F.when(F.col("doc_id") % 13 == 0, True).alias("hidden"),
    )
    state = files.join(manifests(spark, folder), "n").groupBy("shelf", "project_id").agg(F.sort_array(F.collect_list(document)).alias("documents"))
    write_files(state.select(
        F.concat("shelf", F.lit("/"), "project_id", F.lit("/state/documents.json")).alias("path"),
        F.to_json(F.struct(F.lit(1).alias("schemaVersion"), "documents")).alias("text"),
    ), root)
    found = FS.read_catalog_files(loaded(spark, root), f"{root}/*/*/state/documents.json")
    return found.select(
        "project_id", "document_id", "ordinal", F.col("original.relative_path").alias("original_path"), F.col("original.sha256").alias("original_sha256"),
        F.col("translation.relative_path").alias("translation_path"), "hidden",
    )


# ------------------------------------------------------------ versions of a store

VIEWS["v_lines"] = """
SELECT doc_id, unnest(range(0, len(lines))) AS ordinal, unnest(lines) AS text
FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)
"""


def lines(spark, folder) -> DataFrame:
    docs = A.table(spark, folder, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))


# First all documents are written, then every third one anew, with its even lines and translations of those with a later letter.
NEW = "doc_id % 3 = 0"
VIEWS["v_rewritten"] = f"""
SELECT 'segments' AS name, doc_id, ordinal, CASE WHEN {NEW} THEN 'new ' || text ELSE text END AS text FROM v_lines WHERE NOT ({NEW}) OR ordinal % 2 = 0
UNION ALL SELECT 'translations', doc_id, ordinal, CASE WHEN {NEW} THEN 'neu ' || text ELSE 'alt ' || text END FROM v_lines
WHERE NOT ({NEW}) OR (ordinal % 2 = 0 AND doc_id % 2 = 0)
"""


@check(
    "artifact_store",
    """SELECT 'lost' AS stage, 1::BIGINT AS version, 'segments' AS name, doc_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM v_lines GROUP BY doc_id
       UNION ALL SELECT 'lost', 1, 'translations', doc_id, count(*), sum(length(text) + 4)::BIGINT FROM v_lines GROUP BY doc_id
       UNION ALL SELECT 'written', 2, name, doc_id, count(*), sum(length(text))::BIGINT FROM v_rewritten GROUP BY name, doc_id""",
)
def _(spark, folder):
    root = new_folder(spark, "store")
    all_lines = lines(spark, folder)
    said = lambda rows, word: rows.withColumn("text", F.concat(F.lit(word), "text"))
    S.write_artifacts({"segments": all_lines, "translations": said(all_lines, "alt ")}, root, buckets=8, batch=("documents", 0))
    again = all_lines.where(f"{NEW} AND ordinal % 2 = 0")
    anew = {"segments": said(again, "new "), "translations": said(again.where("doc_id % 2 = 0"), "neu ")}
    documents = all_lines.where(NEW).select("doc_id").distinct()
    # The second table is lost on the way, after the first one was written.
    broken = {**anew, "translations": anew["translations"].withColumn("text", F.when(F.col("ordinal") >= 0, F.raise_error(F.lit("lost"))))}
    try:
        S.write_artifacts(broken, root, documents=documents, batch=("documents", 1))
    except PySparkException as error:
        if "lost" not in str(error):
            raise

    def read(stage: str) -> DataFrame:
        store = Store(spark, root)
        version = store.read_version()
        tables = [store.table(name, version).withColumn("name", F.lit(name)) for name in ("segments", "translations")]
        counted = tables[0].unionByName(tables[1]).groupBy("name", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
        return counted.select(F.lit(stage).alias("stage"), F.lit(version["version"]).cast("long").alias("version"), "name", "doc_id", "n", "chars")

    lost = read("lost")
    for _ in range(2):  # the second time the batch is known
        S.write_artifacts(anew, root, documents=documents, batch=("documents", 1))
    return lost.unionByName(read("written"))


# In the second scan every translation has moved; what has equal content is matched in path order.
@check(
    "incremental_reconcile",
    """SELECT coalesce(o.project_id, t.project_id) AS project_id, o.relative_path AS original_path,
              replace(t.relative_path, 'C_trad/', 'C_trad/moved/') AS translation_path,
              sha256(concat_ws(':', '0', coalesce(o.project_id, t.project_id), coalesce(o.relative_path, ''), coalesce(o.sha256, ''),
                     coalesce(t.relative_path, ''), coalesce(t.sha256, ''))) AS document_id, 2::BIGINT AS versions
       FROM (SELECT *, row_number() OVER (PARTITION BY project_id, k ORDER BY relative_path) AS n FROM (SELECT *, KEY AS k FROM v_files) WHERE side = 'original') o
       FULL JOIN (SELECT *, row_number() OVER (PARTITION BY project_id, k ORDER BY relative_path) AS n FROM (SELECT *, KEY AS k FROM v_files) WHERE side = 'translation') t
       ON o.project_id = t.project_id AND o.k = t.k AND o.n = t.n""".replace("KEY", C.key("relative_path")),
)
def _(spark, folder):
    root = new_folder(spark, "catalog")
    first = C.plain_files(spark, folder)
    moved = first.withColumn("relative_path", F.regexp_replace("relative_path", "^C_trad/", "C_trad/moved/"))
    names = [f.name for f in spark.createDataFrame([], schemas.FILES).schema]

    def listen() -> None:
        inbox, state = new_folder(spark, "listings"), new_folder(spark, "stream-state")
        for listing in (first, moved):
            # What is new when the stream wakes is one micro-batch: a scan, in as many files as it has tasks.
            listing.select(*names).write.mode("append").parquet(inbox)
            listings = spark.readStream.schema(schemas.FILES).parquet(inbox)
            query = incremental_reconcile(listings, C.projects(spark, folder), root)
            query.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    listen()
    listen()  # another stream state: both batches come again, and are known
    return S.read_catalog(spark, root).select(
        "project_id", F.col("original.relative_path").alias("original_path"), F.col("translation.relative_path").alias("translation_path"),
        "document_id", F.lit(len(Store(spark, root).versions())).cast("long").alias("versions"),
    )
