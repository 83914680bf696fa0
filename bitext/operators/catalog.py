"""File catalogs: which file belongs to which document, and in what state the pair is.

Tables: ``files(project_id, side, relative_path, sha256, size, modified_at,
media_type)``; ``catalog(project_id, document_id, ordinal, original, translation,
hidden)`` where both sides are structs of the file columns; ``projects(project_id,
original_dir, translation_dir)``.

Matching is positional inside groups of equal files or equal keys, so that one
group of copies may be large; ``match_in_order`` cuts such groups by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitext import constants as K
from bitext.functions import paths as P
from bitext.functions import text as T
from bitext.plans.lineage import cut
from bitext.plans.ordered import HOT_ROWS, match_in_order, rank_within

REFERENCE = ["relative_path", "sha256", "size", "modified_at", "media_type"]
FILE = ["project_id", "side", "relative_path"]


def reference_of(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in REFERENCE])


def with_keys(rows: DataFrame, projects: DataFrame, path: Column, side: Column) -> DataFrame:
    """Add ``pair_key`` of a path on a side of its project."""
    directory = F.when(side == "original", F.col("original_dir")).otherwise(F.col("translation_dir"))
    return (
        rows.join(projects.select("project_id", "original_dir", "translation_dir"), "project_id")
        .withColumn("pair_key", P.pair_key(path, directory))
        .drop("original_dir", "translation_dir")
    )


def catalog_sides(catalog: DataFrame) -> DataFrame:
    """One row per catalogued file: ``(project_id, document_id, ordinal, side, <file columns>)``."""
    sides = F.array(
        *[
            F.when(F.col(s).isNotNull(), F.struct(F.lit(s).alias("side"), F.col(s).alias("file")))
            for s in ("original", "translation")
        ]
    )
    return (
        catalog.select("project_id", "document_id", "ordinal", F.explode(sides).alias("_s"))
        .where(F.col("_s").isNotNull())
        .select("project_id", "document_id", "ordinal", "_s.side", "_s.file.*")
    )


def folders(files: DataFrame, projects: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """Every folder below the two roots; ``explicit`` adds folders without files."""
    directory = F.when(F.col("side") == "original", F.col("original_dir")).otherwise(F.col("translation_dir"))
    inside = P.components(P.without_directory(F.col("relative_path"), directory))
    above = F.array_join(F.slice(inside, F.lit(1), F.greatest(F.size(inside) - 1, F.lit(0))), "/")
    found = (
        files.join(projects.select("project_id", "original_dir", "translation_dir"), "project_id")
        .select("project_id", above.alias("_folder"))
        .distinct()
    )
    if explicit is not None:
        found = found.unionByName(explicit.select("project_id", F.col("relative_path").alias("_folder")))
    return (
        found.select("project_id", F.explode(P.ancestors(F.col("_folder"))).alias("relative_path"))
        .distinct()
        .withColumn("name", F.element_at(F.split("relative_path", "/"), -1))
    )


# ------------------------------------------------------------------ matching


def refresh_references(catalog: DataFrame, files: DataFrame, hot_rows: int = HOT_ROWS, largest: int | None = None) -> DataFrame:
    """Find every catalogued file again, by path, then by content.

    Returns the catalog's sides with the file columns of what was found (the old
    ones when nothing was) and ``available``.  Where copies of equal content
    were moved, earlier records take earlier paths.
    """
    sides = catalog_sides(catalog)
    first = sides.groupBy(*FILE).agg(F.min(F.struct("ordinal", "document_id"))["document_id"].alias("document_id"))
    # Every path of either side, with the record and the file that have it.
    per_path = cut(files.select(*FILE, *REFERENCE[1:]).join(first, FILE, "full"))
    has_file, has_record = F.col("sha256").isNotNull(), F.col("document_id").isNotNull()
    by_path = per_path.where(has_file & has_record)
    spare = per_path.where(has_file & ~has_record).drop("document_id")
    lost = sides.join(
        by_path.select("project_id", "side", "document_id"), ["project_id", "side", "document_id"], "left_anti"
    ).select("project_id", "side", "sha256", "size", "ordinal", "document_id")
    by_content = match_in_order(
        lost, spare, ["project_id", "side", "sha256", "size"], ["ordinal", "document_id"], ["relative_path"],
        hot_rows=hot_rows, largest=largest,
    )
    names = ["project_id", "side", "document_id", *REFERENCE]
    found = by_path.select(*names).unionByName(by_content.select(*names)).select(
        "project_id", "side", "document_id", reference_of().alias("_new")
    )
    return (
        sides.join(found, ["project_id", "side", "document_id"], "left")
        .select(
            "project_id", "document_id", "ordinal", "side",
            *[F.coalesce(F.col("_new")[c], F.col(c)).alias(c) for c in REFERENCE],
            F.col("_new").isNotNull().alias("available"),
        )
    )


def unused_files(files: DataFrame, taken: DataFrame) -> DataFrame:
    """Files no available side of ``taken`` stands for."""
    return files.join(taken.where("available").select(*FILE), FILE, "left_anti")


def adopt_counterparts(
    sides: DataFrame, files: DataFrame, projects: DataFrame, hot_rows: int = HOT_ROWS, largest: int | None = None
) -> DataFrame:
    """Unused files for the empty side of documents whose other side has the same key.

    ``sides`` comes from ``refresh_references``; the result has its columns.
    """
    alone = (
        sides.groupBy("project_id", "document_id")
        .agg(F.count("*").alias("_n"), F.min("ordinal").alias("ordinal"),
             F.min("side").alias("side"), F.min("relative_path").alias("relative_path"))
        .where("_n = 1")
        .drop("_n")
    )
    waiting = with_keys(alone, projects, F.col("relative_path"), F.col("side")).select(
        "project_id", "document_id", "ordinal", "pair_key",
        F.when(F.col("side") == "original", "translation").otherwise("original").alias("side"),
    )
    offered = with_keys(unused_files(files, sides), projects, F.col("relative_path"), F.col("side"))
    return match_in_order(
        waiting, offered, ["project_id", "side", "pair_key"], ["ordinal", "document_id"], ["relative_path"],
        hot_rows=hot_rows, largest=largest,
    ).select(
        "project_id", "document_id", "ordinal", "side", *REFERENCE, F.lit(True).alias("available")
    )


def pair_new_files(
    files: DataFrame, projects: DataFrame, snapshot: str = "", hot_rows: int = HOT_ROWS, largest: int | None = None
) -> DataFrame:
    """New documents from unused files: equal keys are paired in path order.

    The identifier is a digest of the project, the paired paths and contents and
    ``snapshot``; give each scan its own label so that an identifier never returns.
    """
    keyed = with_keys(files, projects, F.col("relative_path"), F.col("side"))

    def one(side):
        return keyed.where(F.col("side") == side).select(
            "project_id", "pair_key", reference_of().alias(side), F.col("relative_path").alias(f"_{side}")
        )

    paired = match_in_order(
        one("original"), one("translation"), ["project_id", "pair_key"], ["_original"], ["_translation"],
        how="full", hot_rows=hot_rows, largest=largest,
    )
    part = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(""))
    return paired.select(
        "project_id",
        F.sha2(
            F.concat_ws(
                ":", F.lit(snapshot), "project_id",
                part("original", "relative_path"), part("original", "sha256"),
                part("translation", "relative_path"), part("translation", "sha256"),
            ),
            256,
        ).alias("document_id"),
        "original",
        "translation",
    )


def _numbered(fresh: DataFrame, catalog: DataFrame, projects: DataFrame, hot_rows: int, largest: int | None) -> DataFrame:
    """New documents with their ``ordinal``: after the highest of their project, by key and then in the order of pairing."""
    path = lambda side: F.col(f"{side}.relative_path")
    keyed = cut(fresh).join(projects.select("project_id", "original_dir", "translation_dir"), "project_id").select(
        *fresh.columns,
        F.coalesce(
            P.pair_key(path("original"), F.col("original_dir")), P.pair_key(path("translation"), F.col("translation_dir"))
        ).alias("_key"),
        path("original").isNull().alias("_late"), path("original").alias("_original"), path("translation").alias("_translation"),
    )
    placed = rank_within(keyed, ["project_id"], ["_key", "_late", "_original", "_translation"], "_n", hot_rows, largest)
    highest = catalog.groupBy("project_id").agg(F.max("ordinal").alias("_highest"))
    return placed.join(highest, "project_id", "left").select(
        *fresh.columns, (F.coalesce("_highest", F.lit(-1)) + F.col("_n")).cast("long").alias("ordinal")
    )


def reconcile(
    catalog: DataFrame, files: DataFrame, projects: DataFrame, snapshot: str = "", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The catalog after a scan: records with refreshed, adopted and new files.

    New records come after the old ones of their project, so that the next scan serves the older first.
    Adds ``original_available`` and ``translation_available``.
    """
    # No group is larger than all files and records together: where that is little, groups are not measured one matching at a time.
    rows = files.count() + 2 * catalog.count()
    largest = rows if rows <= hot_rows else None
    sides = cut(refresh_references(catalog, files, hot_rows, largest))
    sides = cut(sides.unionByName(adopt_counterparts(sides, files, projects, hot_rows, largest)))
    fresh = _numbered(pair_new_files(unused_files(files, sides), projects, snapshot, hot_rows, largest), catalog, projects, hot_rows, largest)

    def pick(side, value):
        return F.first(F.when(F.col("side") == side, value), ignorenulls=True)

    known = sides.groupBy("project_id", "document_id").agg(
        pick("original", reference_of()).alias("original"),
        pick("translation", reference_of()).alias("translation"),
        *[F.coalesce(pick(s, F.col("available")), F.lit(False)).alias(f"{s}_available")
          for s in ("original", "translation")],
    )
    kept = catalog.select("project_id", "document_id", "ordinal", "hidden").join(
        known, ["project_id", "document_id"], "left"
    )
    new = fresh.select(
        "project_id", "document_id", "ordinal", F.lit(False).alias("hidden"),
        "original", "translation",
        F.col("original").isNotNull().alias("original_available"),
        F.col("translation").isNotNull().alias("translation_available"),
    )
    flags = ["original_available", "translation_available"]
    return kept.fillna(False, subset=flags).unionByName(new)


# -------------------------------------------------------------------- states


def _record_keys(records: DataFrame, projects: DataFrame) -> DataFrame:
    return (
        records.join(projects.select("project_id", "original_dir", "translation_dir"), "project_id")
        .withColumn("original_key", P.pair_key(F.col("original.relative_path"), F.col("original_dir")))
        .withColumn("translation_key", P.pair_key(F.col("translation.relative_path"), F.col("translation_dir")))
        .drop("original_dir", "translation_dir")
    )


def conflict_keys(records: DataFrame, projects: DataFrame) -> DataFrame:
    """Keys that several available originals, or several available translations, share.

    Hidden records count too.
    """
    keyed = _record_keys(records, projects)
    sides = F.array(
        *[
            F.when(F.col(f"{s}_available"), F.struct(F.lit(s).alias("side"), F.col(f"{s}_key").alias("pair_key")))
            for s in ("original", "translation")
        ]
    )
    return (
        keyed.select("project_id", F.explode(sides).alias("_s"))
        .where(F.col("_s").isNotNull())
        .groupBy("project_id", "_s.side", "_s.pair_key")
        .count()
        .where("count > 1")
        .select("project_id", "pair_key")
        .distinct()
    )


def summaries(records: DataFrame, projects: DataFrame) -> DataFrame:
    """Title and pair state of every record, hidden ones included."""
    conflicts = conflict_keys(records, projects).withColumn("_conflict", F.lit(True))
    o, t = F.col("original_available"), F.col("translation_available")
    gone = (F.col("original").isNotNull() & ~o) | (F.col("translation").isNotNull() & ~t)
    state = (
        F.when(F.col("_conflict"), "conflict")
        .when(gone, "unavailable")
        .when(o & t & (F.col("original_key") == F.col("translation_key")), "paired")
        .when(o & t, "manually-linked")
        .when(o, "missing-translation")
        .when(t, "missing-original")
        .otherwise("unavailable")
    )
    return (
        _record_keys(records, projects)
        .withColumn("pair_key", F.coalesce("original_key", "translation_key"))
        .join(conflicts, ["project_id", "pair_key"], "left")
        .select(
            "project_id", "document_id", P.key_title(F.col("pair_key")).alias("title"),
            state.alias("pair_state"), "original", "translation", "hidden",
        )
    )


def visible_documents(summary: DataFrame) -> DataFrame:
    """The listed documents, by title."""
    return summary.where(~F.col("hidden")).drop("hidden").orderBy(F.lower("title"), "document_id")


def hidden_documents(summary: DataFrame) -> DataFrame:
    """Hidden documents: titled after the file, never available."""
    path = F.coalesce("original.relative_path", "translation.relative_path")
    name = F.element_at(F.split(P.stem(path), "/"), -1)
    return (
        summary.where("hidden")
        .withColumn("title", F.coalesce(name, F.lit(K.UNTITLED)))
        .withColumn("pair_state", F.lit("unavailable"))
        .drop("hidden")
    )


def present_pair_state(state: Column) -> Column:
    """``struct<icon, label>`` of a pair state."""
    icon = F.create_map(*[F.lit(x) for s, (i, _) in K.PAIR_STATES.items() for x in (s, i)])
    label = F.create_map(*[F.lit(x) for s, (_, n) in K.PAIR_STATES.items() for x in (s, n)])
    return F.struct(icon[state].alias("icon"), label[state].alias("label"))


# ------------------------------------------------------------------- changes

ACTIONS = ["hide", "restore", "delete-original", "delete-translation", "delete-both"]


def apply_catalog_actions(catalog: DataFrame, actions: DataFrame) -> DataFrame:
    """The catalog after ``actions(project_id, document_id, seq, action)``; empty records go.

    Deletions do not depend on their order, and the last action that touches
    ``hidden`` decides it, so that one map-side combined aggregate per document is enough.
    """
    action = F.col("action")
    effect = actions.where(action.isin(ACTIONS)).groupBy("project_id", "document_id").agg(
        F.bool_or(action.isin("delete-original", "delete-both")).alias("_no_original"),
        F.bool_or(action.isin("delete-translation", "delete-both")).alias("_no_translation"),
        F.max_by(
            F.when(action != "delete-both", action == "hide"),
            F.when(action != "delete-both", F.col("seq")),
        ).alias("_hidden"),
    )
    kept = lambda side: F.when(~F.coalesce(F.col(f"_no_{side}"), F.lit(False)), F.col(side))
    return (
        catalog.join(effect, ["project_id", "document_id"], "left")
        .withColumn("original", kept("original"))
        .withColumn("translation", kept("translation"))
        .withColumn("hidden", F.coalesce("_hidden", "hidden"))
        .where(F.col("original").isNotNull() | F.col("translation").isNotNull())
        .select(*catalog.columns)
    )


def rejected_actions(catalog: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions that name no known action or no catalogued document."""
    known = catalog.select("project_id", "document_id").distinct().withColumn("_known", F.lit(True))
    reason = F.when(~F.col("action").isin(ACTIONS), "unknown action").when(F.col("_known").isNull(), "unknown document")
    return (
        actions.join(known, ["project_id", "document_id"], "left")
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .drop("_known")
    )


def import_batch(files: DataFrame, incoming: DataFrame, projects: DataFrame) -> DataFrame:
    """Where ``incoming(project_id, seq, folder, original_name, translation_name)`` would go.

    Adds both destinations and ``rejected``: null when the import may proceed.
    The translation is renamed after the original; the first of two imports with
    one destination wins.
    """
    folder = F.trim(F.coalesce("folder", F.lit("")))
    at = lambda directory, name: F.concat_ws(
        "/", F.col(directory), F.when(folder != "", folder), name
    )
    renamed = F.concat(P.stem(F.col("original_name")), F.lit("."), F.regexp_extract("translation_name", r"\.([^.]*)\z", 1))
    placed = (
        incoming.join(projects.select("project_id", "original_dir", "translation_dir"), "project_id")
        .withColumn("original_path", at("original_dir", F.col("original_name")))
        .withColumn("translation_path", F.when(F.col("translation_name").isNotNull(), at("translation_dir", renamed)))
        .drop("original_dir", "translation_dir")
    )
    bad = (
        ~P.extension(F.col("original_name")).isin(K.ORIGINAL_EXTENSIONS)
        | ~F.coalesce(P.extension(F.col("translation_name")).isin(K.TRANSLATION_EXTENSIONS), F.lit(True))
    )
    unsafe = (folder != "") & ~P.safe_path(folder)

    def occupied(rows, side):
        path = f"{side}_path"
        there = files.where(F.col("side") == side).select(
            "project_id", F.col("relative_path").alias(path), F.lit(True).alias(f"_{side}_there")
        )
        return rows.join(there, ["project_id", path], "left")

    checked = occupied(occupied(placed, "original"), "translation").withColumn(
        "rejected",
        F.when(bad, "unsupported file")
        .when(unsafe, "unsafe folder")
        .when(F.col("_original_there") | F.coalesce("_translation_there", F.lit(False)), "name exists"),
    )
    for side in ("original", "translation"):
        winners = checked.where(F.col("rejected").isNull()).groupBy("project_id", f"{side}_path").agg(
            F.min("seq").alias(f"_{side}_first")
        )
        checked = checked.join(winners, ["project_id", f"{side}_path"], "left")
    late = (F.col("seq") > F.col("_original_first")) | F.coalesce(
        F.col("seq") > F.col("_translation_first"), F.lit(False)
    )
    return checked.withColumn(
        "rejected", F.coalesce("rejected", F.when(late, "name exists"))
    ).select(*incoming.columns, "original_path", "translation_path", "rejected")


def publishable(
    outputs: DataFrame, catalog: DataFrame, projects: DataFrame, artifacts: DataFrame, files: DataFrame
) -> DataFrame:
    """Where a generated translation goes, and why it may not.

    ``outputs(project_id, document_id, target_language)``; ``artifacts`` lists the
    documents with artifacts of an earlier run.  ``rejected`` is null when the
    output may be published: it fills an empty side or replaces its own earlier output.
    """
    inside = P.without_directory(F.col("original.relative_path"), F.col("original_dir"))
    expected = F.concat(
        F.col("translation_dir"), F.lit("/"), P.stem(inside), F.lit("."), F.col("target_language"), F.lit(".md")
    )
    there = files.where("side = 'translation'").select(
        "project_id", F.col("relative_path").alias("output_path"), F.lit(True).alias("_there")
    )
    made = artifacts.select("project_id", "document_id").distinct().withColumn("_made", F.lit(True))
    own = F.coalesce(
        F.col("_made") & (F.col("translation.relative_path") == F.col("output_path")), F.lit(False)
    )
    return (
        outputs.join(catalog.select("project_id", "document_id", "original", "translation"), ["project_id", "document_id"], "left")
        .join(projects.select("project_id", "original_dir", "translation_dir"), "project_id")
        .withColumn("output_path", expected)
        .join(made, ["project_id", "document_id"], "left")
        .join(there, ["project_id", "output_path"], "left")
        .select(
            "project_id", "document_id", "target_language", "output_path",
            F.when(F.col("original").isNull() & F.col("translation").isNull(), "unknown document")
            .when(F.col("original").isNull(), "no original")
            .when(~F.startswith("original.relative_path", F.concat("original_dir", F.lit("/"))), "outside the project")
            .when(F.col("translation").isNotNull() & ~own, "imported translation")
            .when(F.col("_there") & ~own, "file exists")
            .alias("rejected"),
        )
    )


def validate_runs(runs: DataFrame) -> DataFrame:
    """Processing results with the rules each one breaks.

    ``runs`` has document_id, source_text, markdown, segments, translations,
    math_objects (counts), math_object_count, target_language, review_level.
    """
    rules = [
        (~F.regexp_like("document_id", F.lit(r"^[A-Za-z0-9-]+\z")), "document_id"),
        (T.is_blank(T.or_empty(F.col("source_text"))), "source_text"),
        (T.is_blank(T.or_empty(F.col("markdown"))), "markdown"),
        (F.col("segments") == 0, "segments"),
        (F.col("segments") != F.col("translations"), "translations"),
        (F.col("math_object_count") != F.col("math_objects"), "math_objects"),
        (~F.col("target_language").isin(K.LANGUAGES), "target_language"),
        (~F.col("review_level").isin(K.REVIEW_LEVELS), "review_level"),
    ]
    return runs.withColumn(
        "violations",
        F.filter(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules]), lambda v: v.isNotNull()),
    )


# ------------------------------------------------------------------- recents


def recent_projects(opened: DataFrame, k: int = K.RECENT_PROJECTS) -> DataFrame:
    """Per reader the last ``k`` projects of ``opened(reader_id, project_id, name, root, opened_at)``."""
    filled = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("project_id", "name", "root")]
    valid = opened.where(filled[0] & filled[1] & filled[2] & F.col("opened_at").isNotNull())
    last = valid.groupBy("reader_id", "project_id").agg(
        F.max(F.struct("opened_at", "name", "root")).alias("_last")
    ).select("reader_id", "project_id", "_last.*")
    return _top(last, "project_id", k)


def recent_locations(opened: DataFrame, k: int = K.RECENT_LOCATIONS) -> DataFrame:
    """Per reader the last ``k`` parent folders, letter case aside, in the latest spelling."""
    parent = F.regexp_replace("root", r"[/\\][^/\\]*\z", "")
    last = (
        opened.withColumn("location", parent)
        .where(~T.is_blank(T.or_empty(F.col("location"))))
        .groupBy("reader_id", F.lower("location").alias("_folded"))
        .agg(F.max(F.struct("opened_at", "location")).alias("_last"))
        .select("reader_id", "_folded", "_last.*")
    )
    return _top(last, "_folded", k).drop("_folded")


def _top(last: DataFrame, tie: str, k: int) -> DataFrame:
    # Spark keeps at most k rows per reader in each task before the shuffle.
    from pyspark.sql import Window

    newest = Window.partitionBy("reader_id").orderBy(F.desc("opened_at"), tie)
    return last.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= k)


def distinct_first(rows: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """The first spelling of every value, letter case aside."""
    return (
        rows.groupBy(*keys, F.lower(value).alias("_folded"))
        .agg(F.min(F.struct(position, value)).alias("_first"))
        .select(*keys, F.col(f"_first.{value}").alias(value), F.col(f"_first.{position}").alias(position))
    )


def not_recent(discovered: DataFrame, recent: DataFrame) -> DataFrame:
    """Discovered projects outside the recent ones."""
    return discovered.join(recent.select("project_id").distinct(), "project_id", "left_anti")
