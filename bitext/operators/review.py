"""Choosing between a base translation and its reviewed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitext import constants as K
from bitext.functions import text as T


def revision_warnings(source: Column, base: Column, reviewed: Column, level: str) -> Column:
    """``array<string>`` of what a revision changed that it must not change."""
    low, high = K.REVIEW_RATIO[level]
    size = T.utf16_len(T.trim(reviewed))
    ratio = size / F.greatest(F.lit(1), T.utf16_len(T.trim(base)))
    rules = [
        (T.math_placeholders(base) != T.math_placeholders(reviewed), K.WARN_MATH),
        (T.stable_placeholders(base) != T.stable_placeholders(reviewed), K.WARN_STABLE),
        (T.numeric_tokens(base) != T.numeric_tokens(reviewed), K.WARN_NUMBER),
        (T.reference_tokens(base) != T.reference_tokens(reviewed), K.WARN_REFERENCE),
        ((ratio < low) | (ratio > high), K.WARN_LENGTH),
    ]
    if level == "strict":
        rules.append((~T.is_blank(source) & (size < K.STRICT_MIN_CHARACTERS), K.WARN_SHORT))
    return F.filter(
        F.array(*[F.when(broken, F.lit(message)) for broken, message in rules]),
        lambda w: w.isNotNull(),
    )


def select_reviewed(
    source: DataFrame, base: DataFrame, reviewed: DataFrame | None, level: str
) -> DataFrame:
    """Base translations with the review decision, its warnings and the chosen text."""
    columns = [c for c in base.columns if c not in ("base_text", "reviewed_text", "review_status", "review_warnings")]
    none = F.array().cast("array<string>")
    if level == "none" or reviewed is None:
        return base.select(
            *columns,
            F.col("text").alias("base_text"),
            F.lit(None).cast("string").alias("reviewed_text"),
            F.lit("not-reviewed").alias("review_status"),
            none.alias("review_warnings"),
        )
    joined = base.join(
        reviewed.select("doc_id", "segment_id", F.col("text").alias("_new")), ["doc_id", "segment_id"], "left"
    ).join(
        source.select("doc_id", "segment_id", F.col("text").alias("_source")), ["doc_id", "segment_id"], "left"
    )
    missing = T.is_blank(T.or_empty(F.col("_new")))
    warnings = revision_warnings(T.or_empty(F.col("_source")), F.col("text"), F.col("_new"), level)
    return (
        joined.withColumn("_missing", missing)
        .withColumn(
            "review_warnings",
            F.when(F.col("_missing"), F.array(F.lit(K.WARN_MISSING))).otherwise(warnings),
        )
        .withColumn(
            "review_status",
            F.when(F.col("_missing"), "needs-review")
            .when(F.size("review_warnings") > 0, "base-retained")
            .otherwise("approved"),
        )
        .withColumn("base_text", F.col("text"))
        .withColumn("reviewed_text", F.when(~F.col("_missing"), F.col("_new")))
        .withColumn(
            "text", F.when(F.col("review_status") == "approved", F.col("_new")).otherwise(F.col("text"))
        )
        .select(*columns, "base_text", "reviewed_text", "review_status", "review_warnings")
    )
