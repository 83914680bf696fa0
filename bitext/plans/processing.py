"""A corpus of pages to everything a reader needs, with a model the user supplies.

Each stage that later stages read more than once is checkpointed, which also
cuts the lineage: a lost executor costs the tasks it ran, not the stages before.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext import constants as K
from bitext.operators import align, inference, protect, segment
from bitext.operators import review as review_choice
from bitext.plans.lineage import cut, keep
from bitext.plans.ordered import group_sizes


def prepare(pages: DataFrame) -> dict[str, DataFrame]:
    """Segments, their protected form, what was protected, and the batches to translate."""
    safe = keep(protect.protected_pages(pages))
    segments = safe.drop("math", "tokens", "text").withColumnRenamed("source", "text")
    batches = segment.batch_segments(safe, gapless=True)
    batched = safe.select("doc_id", "ordinal", "segment_id", "text").join(batches, ["doc_id", "ordinal"])
    return {
        "segments": segments,
        "protected": safe,
        "math_objects": protect.math_objects(safe),
        "tokens": protect.stable_tokens(safe),
        "batched": batched,
        "requests": inference.request_payload(batched),
    }


_MATH = re.compile(K.MATH_PLACEHOLDER)


def _math_of(text: str) -> list[str]:
    return _MATH.findall(text) if "⟦" in text else []


def keeps_math(asked: list[dict], answered: list[dict]) -> None:
    """Validation of an answer: math placeholders as they were; raises what a retry understands."""
    texts = {s["segmentId"]: s["text"] for s in answered}
    for s in asked:
        if _math_of(s["text"]) != _math_of(texts.get(s["segmentId"], "")):
            raise ValueError(f"A math placeholder changed in segment {s['segmentId']}.")


def keeps_marks(asked: list[dict], answered: list[dict]) -> None:
    """Validation of a review: math, number and reference placeholders as in the base text."""
    stable = re.compile(K.STABLE_PLACEHOLDER)
    for s, new in zip(asked, answered, strict=True):
        if _math_of(s["baseText"]) != _math_of(new["text"]):
            raise ValueError(f"The review changed a math placeholder of segment {s['segmentId']}.")
        if stable.findall(s["baseText"]) != stable.findall(new["text"]):
            raise ValueError(f"The review changed a protected marker of segment {s['segmentId']}.")


def gate(source: DataFrame, base: DataFrame) -> DataFrame:
    """``(doc_id, detail)`` of documents that must not be published, a row per reason.

    Every segment has to be translated, none may be blank or unknown, and math placeholders have to be as they were.
    """
    counts = protect.translation_completeness(source, base).where(~F.col("complete"))
    incomplete = counts.select("doc_id", F.format_string(
        "Incomplete: %d segments missing, %d blank, %d unexpected.", "missing", "blank", "unexpected"
    ).alias("detail"))
    changed = protect.math_integrity(source, base).groupBy("doc_id").agg(
        F.format_string("Math placeholders changed, first in segment %s.", F.min("segment_id")).alias("detail")
    )
    return incomplete.unionByName(changed)


def review(
    batched: DataFrame, base: DataFrame, make_reviewer: Callable[[], Callable[[list[dict]], dict]]
) -> DataFrame:
    """Reviewed texts of the batches whose review succeeded; of the others the base stays."""
    answers = inference.run_batches(inference.review_payload(batched, base), make_reviewer, keeps_marks)
    return answers.where(F.col("error").isNull()).select("doc_id", F.explode("segments").alias("s")).select(
        "doc_id", F.col("s.segmentId").alias("segment_id"), F.col("s.text").alias("text")
    )


def process(
    pages: DataFrame,
    make_translator: Callable[[], Callable[[list[dict]], dict]],
    reviewed: Callable[[DataFrame], DataFrame] | None = None,
    review_level: str = "none",
    make_reviewer: Callable[[], Callable[[list[dict]], dict]] | None = None,
) -> dict[str, DataFrame]:
    """Translate, review, restore and align: the tables ``sources.artifacts`` writes.

    ``make_translator`` opens a session per partition and returns the call for a
    batch.  ``make_reviewer`` does the same for batches of ``{"segmentId", "sourceText", "baseText"}``; a review
    that fails keeps the base.  ``reviewed`` instead turns base translations into reviewed ones as a whole.
    Only complete documents leave: one with a failed batch, a missing or blank segment or changed math
    is in no table but ``failures``, with the reasons (batch_id is null where the document as a whole failed).
    """
    ready = prepare(pages)
    answers = keep(inference.run_batches(ready["requests"], make_translator, keeps_math))
    told = answers.select("doc_id", F.explode("segments").alias("s")).select(
        "doc_id", F.col("s.segmentId").alias("segment_id"), F.col("s.text").alias("text")
    )
    stopped = cut(gate(ready["protected"], told))
    failures = (
        answers.where(F.col("error").isNotNull()).select("doc_id", "batch_id", F.col("error").alias("detail"))
        .unionByName(stopped.select("doc_id", F.lit(None).cast("int").alias("batch_id"), "detail"))
    )
    bad = cut(failures.select("doc_id").distinct())
    whole = {name: ready[name].join(bad, "doc_id", "left_anti") for name in ("segments", "protected", "batched", "math_objects", "tokens")}
    noted = keep(protect.annotate_lost(whole["protected"], told.join(bad, "doc_id", "left_anti")))
    candidate = reviewed(noted) if reviewed else None
    if make_reviewer and review_level != "none":
        candidate = cut(review(whole["batched"], noted, make_reviewer))
    chosen = review_choice.select_reviewed(whole["protected"], noted, candidate, review_level)
    # Without a review the choice only names the columns of what is kept already.
    chosen = chosen if candidate is None or review_level == "none" else keep(chosen)
    loose = keep(protect.restore_tokens(chosen, whole["tokens"]))
    plain = protect.restore_math(loose, whole["math_objects"], "plain")
    marked = protect.restore_math(loose, whole["math_objects"], "markdown")
    order = whole["segments"].select("doc_id", "segment_id", "ordinal")
    kept = pages.join(bad, "doc_id", "left_anti")
    return {
        "segments": whole["segments"],
        "translations": plain.join(order, ["doc_id", "segment_id"]),
        "math_objects": whole["math_objects"],
        "alignments": align.identity_alignments(whole["segments"]),
        "metadata": inference.run_metadata(kept, chosen, whole["math_objects"]),
        "source_text": segment.source_text(kept),
        "markdown": segment.translated_markdown(whole["segments"], marked, sizes=group_sizes(ready["segments"], ["doc_id"])),
        "failures": failures,
    }
