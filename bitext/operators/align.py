"""Alignments: sentence-level resegmentation, projection of selections, coverage.

``alignments(doc_id, alignment_id, ordinal, source_segment_ids,
target_segment_ids, type, method, confidence)``; the other tables are the
segments and translations of the documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitext import constants as K
from bitext.functions import text as T
from bitext.plans.lineage import keep
from bitext.plans.ordered import kept_with_running
from bitext.plans.rows import unfold

SPLITTABLE = ["paragraph", "footnote"]


def identity_alignments(segments: DataFrame) -> DataFrame:
    """Every segment aligned with the translation of the same identifier."""
    own = F.array("segment_id")
    return segments.select(
        "doc_id",
        F.concat(F.lit(K.ALIGNMENT_ID), "segment_id").alias("alignment_id"),
        "ordinal",
        own.alias("source_segment_ids"),
        own.alias("target_segment_ids"),
        F.lit("1:1").alias("type"),
        F.lit("generated-id").alias("method"),
        F.lit(None).cast("double").alias("confidence"),
    )


def alignment_type(sources: Column, targets: Column) -> Column:
    """``1:1``, ``1:n``, ``n:1`` or ``n:m`` from the number of segments on each side."""
    one = lambda n, many: F.when(n == 1, "1").otherwise(many)
    return F.when((sources > 1) & (targets > 1), "n:m").otherwise(
        F.concat(one(sources, "n"), F.lit(":"), one(targets, "n"))
    )


def explode_side(alignments: DataFrame, side: str) -> DataFrame:
    """``(doc_id, alignment_id, alignment_ordinal, segment_id, place)`` of one side."""
    column = "source_segment_ids" if side == "source" else "target_segment_ids"
    return alignments.select(
        "doc_id", "alignment_id", F.col("ordinal").alias("alignment_ordinal"),
        F.posexplode(column).alias("place", "segment_id"),
    )


# -------------------------------------------------------------- resegmentation


def places_of_cuts(lengths: np.ndarray, groups: int) -> np.ndarray:
    """Last unit (1, 2, …) of all groups but the last, when units are cut into ``groups`` runs.

    Cut j lies where the running length is nearest to j/groups of the total, the
    first such unit winning, and leaves a unit for every group.  Because running
    lengths grow strictly, the nearest units come in order and are found by one sweep; cuts are the
    running maximum of (nearest - j), bounded by the units to spare, plus j.
    """
    ends = np.cumsum(np.maximum(lengths, 1), dtype=np.int64).astype(np.float64)
    cut = np.arange(1, groups)
    goals = ends[-1] * cut / groups
    after = np.minimum(np.searchsorted(ends, goals), len(ends) - 1)
    before = np.maximum(after - 1, 0)
    nearest = np.where(np.abs(ends[before] - goals) <= np.abs(ends[after] - goals), before, after) + 1
    shift = np.maximum.accumulate(np.maximum(nearest - cut, 0))
    return cut + np.minimum(shift, len(ends) - groups)


def cut_ends(lengths: Column, groups: Column) -> Column:
    """``places_of_cuts`` of an array of lengths; null where either is null, empty for one group or none."""

    @F.pandas_udf("array<int>")
    def ends(lengths: pd.Series, groups: pd.Series) -> pd.Series:
        found = []
        for values, n in zip(lengths, groups, strict=True):
            if values is None or n != n:
                found.append(None)
            else:
                found.append(places_of_cuts(np.asarray(values), int(n)).astype(np.int32) if n > 1 else np.zeros(0, dtype=np.int32))
        return pd.Series(found)

    return ends(lengths, groups)


def _runs(ids: Column, cuts: Column) -> Column:
    """``ids`` cut after the given places."""
    first = F.concat(F.array(F.lit(1)), F.transform(cuts, lambda e: e + 1))
    last = F.concat(cuts, F.array(F.size(ids)))
    return F.zip_with(first, last, lambda a, b: F.slice(ids, a, b - a + 1))


def _children(rows: DataFrame, divisible: Column, letter: str) -> DataFrame:
    """Rows cut into sentence groups; identifiers, parents and ordinals follow.

    Adds ``_root``: the identifier of the row the child came from.
    """
    whole = F.array("text")
    divided = rows.withColumn(
        "_units", F.when(divisible, T.sentence_groups(F.col("text"))).otherwise(whole)
    ).withColumn("_units", F.when(F.size("_units") > 1, F.col("_units")).otherwise(F.array("text")))
    placed = kept_with_running(divided, ["doc_id"], "ordinal", {"_before": F.size("_units")})
    out = unfold(placed, "_units", "_unit", "_i")
    several = F.size("_units") > 1
    name = F.concat("segment_id", F.lit(f"::{letter}"), F.format_string("%03d", F.col("_i") + 1))
    return (
        out.withColumn("_root", F.col("segment_id"))
        .withColumn("segment_id", F.when(several, name).otherwise(F.col("segment_id")))
        .withColumn("parent_segment_id", F.when(several, F.col("_root")).otherwise(F.col("parent_segment_id")))
        .withColumn("unit_ordinal", F.when(several, F.col("_i")).otherwise(F.col("unit_ordinal")))
        .withColumn("text", F.col("_unit"))
        .withColumn("ordinal", (F.col("_before") + F.col("_i") + 1).cast("int"))
        .withColumn("_divided", several)
        .drop("_units", "_unit", "_i", "_before")
    )


def _optional(rows: DataFrame) -> DataFrame:
    for name, kind in (("parent_segment_id", "string"), ("unit_ordinal", "int")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


def resegment(
    segments: DataFrame, translations: DataFrame, alignments: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, translations and alignments at the level of sentence groups.

    Only paragraphs and footnotes are cut, and translations aligned with one.
    Returned alignments keep ``parent_alignment_id`` and ``groups``: how many
    alignments the old one became, null where it passed through.
    """
    types = segments.select("doc_id", "segment_id", F.col("block_type").isin(SPLITTABLE).alias("_can"))
    divisible = (
        explode_side(alignments, "source")
        .join(types, ["doc_id", "segment_id"])
        .groupBy("doc_id", "alignment_id")
        .agg(F.bool_or("_can").alias("_can"))
    )
    targets = (
        explode_side(alignments, "target")
        .join(divisible, ["doc_id", "alignment_id"])
        .groupBy("doc_id", "segment_id")
        .agg(F.bool_or("_can").alias("_can"))
    )
    source = keep(_children(_optional(segments), F.col("block_type").isin(SPLITTABLE), "s"))
    marked = _optional(translations).join(targets, ["doc_id", "segment_id"], "left")
    target = keep(_children(marked, F.coalesce("_can", F.lit(False)), "t").drop("_can"))
    for name in ("base_text", "reviewed_text"):
        if name in target.columns:
            target = target.withColumn(name, F.when(~F.col("_divided"), F.col(name)))

    def units(children, side):
        unit = F.struct("place", "unit_ordinal", "segment_id", T.utf16_len(F.col("text")).alias("size"))
        named = children.select(
            "doc_id", F.col("_root").alias("_id"), F.coalesce("unit_ordinal", F.lit(0)).alias("unit_ordinal"),
            "segment_id", "text",
        )
        return (
            explode_side(alignments, side).withColumnRenamed("segment_id", "_id")
            .join(named, ["doc_id", "_id"])
            .groupBy("doc_id", "alignment_id")
            .agg(F.array_sort(F.collect_list(unit)).alias(f"_{side}"))
        )

    key = ["doc_id", "alignment_id"]
    both = (
        alignments.join(units(source, "source"), key, "left").join(units(target, "target"), key, "left")
    )
    ns, nt = F.size("_source"), F.size("_target")
    changed = (
        F.col("_source").isNotNull() & F.col("_target").isNotNull()
        & ((ns != F.size("source_segment_ids")) | (nt != F.size("target_segment_ids")))
    )
    grouped = both.withColumn("groups", F.when(changed, F.least(ns, nt))).withColumn(
        "_s_cuts", F.when(changed, cut_ends(F.col("_source.size"), F.col("groups")))
    ).withColumn("_t_cuts", F.when(changed, cut_ends(F.col("_target.size"), F.col("groups"))))
    pair = F.arrays_zip(
        _runs(F.col("_source.segment_id"), F.col("_s_cuts")).alias("s"),
        _runs(F.col("_target.segment_id"), F.col("_t_cuts")).alias("t"),
    )
    kept = F.array(F.struct(F.col("source_segment_ids").alias("s"), F.col("target_segment_ids").alias("t")))
    rows = unfold(
        grouped.withColumn("_pairs", F.when(F.col("groups").isNotNull(), pair).otherwise(kept)), "_pairs", "_p", "_i"
    )
    new = F.col("groups").isNotNull()
    renamed = F.concat(F.lit("exp:"), "alignment_id", F.lit(":"), F.format_string("%03d", F.col("_i") + 1))
    certainty = F.when(ns == nt, K.EQUAL_CONFIDENCE).otherwise(K.UNEQUAL_CONFIDENCE)
    aligned = rows.select(
        "doc_id",
        F.when(new, renamed).otherwise(F.col("alignment_id")).alias("alignment_id"),
        "ordinal",
        F.col("_i").alias("part"),
        F.col("_p.s").alias("source_segment_ids"),
        F.col("_p.t").alias("target_segment_ids"),
        F.when(new, alignment_type(F.size("_p.s"), F.size("_p.t"))).otherwise(F.col("type")).alias("type"),
        F.when(new, K.RESEGMENT_METHOD).otherwise(F.col("method")).alias("method"),
        F.when(new, F.least(F.coalesce("confidence", F.lit(1.0)), certainty)).otherwise(F.col("confidence")).alias("confidence"),
        F.col("alignment_id").alias("parent_alignment_id"),
        "groups",
    )
    return source.drop("_root", "_divided"), target.drop("_root", "_divided"), aligned


def resegment_report(
    before: tuple[DataFrame, DataFrame, DataFrame], after: tuple[DataFrame, DataFrame, DataFrame]
) -> DataFrame:
    """Counts per document before and after resegmentation: one aggregate over flags."""
    names = [
        "original_source_segments", "source_segments", "original_target_segments", "target_segments",
        "original_alignments", "alignments", "subdivided_alignments", "paragraph_fallbacks",
    ]
    first = F.col("part") == 0
    tables = [
        (before[0], {"original_source_segments": F.lit(1)}),
        (after[0], {"source_segments": F.lit(1)}),
        (before[1], {"original_target_segments": F.lit(1)}),
        (after[1], {"target_segments": F.lit(1)}),
        (before[2], {"original_alignments": F.lit(1)}),
        (after[2], {
            "alignments": F.lit(1),
            "subdivided_alignments": (first & (F.col("groups") > 1)).cast("int"),
            "paragraph_fallbacks": (first & (F.col("groups") == 1)).cast("int"),
        }),
    ]
    flags = None
    for table, values in tables:
        rows = table.select("doc_id", *[F.coalesce(values.get(n, F.lit(0)), F.lit(0)).alias(n) for n in names])
        flags = rows if flags is None else flags.unionByName(rows)
    return flags.groupBy("doc_id").agg(*[F.sum(n).alias(n) for n in names])


# ------------------------------------------------------------------ projection


def project_selection(selections: DataFrame, alignments: DataFrame, target_side: str) -> DataFrame:
    """Segments of the other side that belong to a selection, in first-seen order.

    ``selections(doc_id, selection_id, side, segment_ids)``.  One row per
    projected segment; ``alignment_ordinal`` and ``place`` order them.
    """
    side = "translation" if target_side == "source" else "source"
    picked = selections.where(F.col("side") == side).select(
        "doc_id", "selection_id", F.explode("segment_ids").alias("segment_id")
    )
    other = "source" if target_side == "source" else "target"
    touched = (
        picked.join(explode_side(alignments, "source" if side == "source" else "target"), ["doc_id", "segment_id"])
        .select("doc_id", "selection_id", "alignment_id")
        .distinct()
    )
    return (
        touched.join(explode_side(alignments, other), ["doc_id", "alignment_id"])
        .groupBy("doc_id", "selection_id", "segment_id")
        .agg(F.min(F.struct("alignment_ordinal", "place")).alias("_first"))
        .select("doc_id", "selection_id", "segment_id", "_first.*")
    )


def source_for_target(segments: DataFrame, translations: DataFrame, alignments: DataFrame) -> DataFrame:
    """The source segment a translation belongs to; null when there is none.

    The segment of the same identifier, else the first known source of the last
    alignment that lists the translation.
    """
    known = segments.select("doc_id", "segment_id")
    head = (
        explode_side(alignments, "source")
        .join(known, ["doc_id", "segment_id"])
        .groupBy("doc_id", "alignment_id")
        .agg(F.min_by("segment_id", "place").alias("_source"))
    )
    by_alignment = (
        explode_side(alignments, "target")
        .join(head, ["doc_id", "alignment_id"])
        .groupBy("doc_id", "segment_id")
        .agg(F.max_by("_source", "alignment_ordinal").alias("_aligned"))
    )
    direct = known.withColumn("_direct", F.col("segment_id"))
    return (
        translations.select("doc_id", "segment_id")
        .join(direct, ["doc_id", "segment_id"], "left")
        .join(by_alignment, ["doc_id", "segment_id"], "left")
        .select("doc_id", "segment_id", F.coalesce("_direct", "_aligned").alias("source_segment_id"))
    )


# --------------------------------------------------------------------- checks


def alignment_coverage(segments: DataFrame, translations: DataFrame, alignments: DataFrame) -> DataFrame:
    """Identifiers that repeat, that no segment has, or that are not aligned exactly once."""
    def listed(rows, side, defined):
        return rows.select(
            "doc_id", F.lit(side).alias("side"), "segment_id",
            F.lit(int(defined)).alias("_defined"), F.lit(int(not defined)).alias("_aligned"),
        )

    rows = (
        listed(segments, "source", True)
        .unionByName(listed(translations, "target", True))
        .unionByName(listed(explode_side(alignments, "source"), "source", False))
        .unionByName(listed(explode_side(alignments, "target"), "target", False))
    )
    counted = rows.groupBy("doc_id", "side", "segment_id").agg(
        F.sum("_defined").alias("defined"), F.sum("_aligned").alias("aligned")
    )
    problem = (
        F.when(F.col("defined") > 1, "repeated")
        .when(F.col("defined") == 0, "unknown")
        .when(F.col("aligned") != 1, "not aligned once")
    )
    return counted.withColumn("problem", problem).where(F.col("problem").isNotNull())


def corpus_shape(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Text-free shape of every segment pair: lengths, sentence lengths, review outcome."""
    lengths = lambda t: F.transform(T.sentences(t), T.utf16_len)
    words = translations.select(
        "doc_id", "segment_id",
        T.utf16_len(F.col("text")).alias("target_length"),
        lengths(F.col("text")).alias("target_sentence_lengths"),
        F.coalesce("review_status", F.lit("not-reviewed")).alias("review_status"),
        F.coalesce(F.size("review_warnings"), F.lit(0)).alias("review_warning_count"),
    )
    return segments.select(
        "doc_id", "segment_id", "page", "block_type",
        T.utf16_len(F.col("text")).alias("source_length"),
        lengths(F.col("text")).alias("source_sentence_lengths"),
    ).join(words, ["doc_id", "segment_id"])


def document_shape(
    segments: DataFrame, translations: DataFrame, alignments: DataFrame, pages: DataFrame
) -> DataFrame:
    """Per document: last page, pages by method, and how many parts each table has."""
    rows = None
    parts = [
        (segments, {"segments": F.lit(1), "page": F.col("page")}),
        (translations, {"translations": F.lit(1)}),
        (alignments, {"alignments": F.lit(1)}),
        (pages, {"native_pages": (F.col("method") == "native").cast("int"),
                 "ocr_pages": (F.col("method") == "ocr").cast("int")}),
    ]
    names = ["segments", "translations", "alignments", "native_pages", "ocr_pages", "page"]
    for table, values in parts:
        part = table.select("doc_id", *[values.get(n, F.lit(0)).alias(n) for n in names])
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("doc_id").agg(
        *[F.sum(n).alias(n) for n in names[:-1]], F.max("page").alias("page_count")
    )
