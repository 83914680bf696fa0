"""Batches for a model the user supplies: requests, calls with recovery, answers, failures."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitext import constants as K
from bitext.functions import text as T
from bitext.plans.rows import unfold

ENVELOPE = "struct<segments:array<struct<segmentId:string,text:string>>>"
BATCH_KEY = ["doc_id", "batch_id"]


# ------------------------------------------------------------------ requests


def request_payload(batched: DataFrame) -> DataFrame:
    """``(doc_id, batch_id, payload)``: the JSON of each batch's segments, in order.

    ``batched`` has doc_id, batch_id, ordinal, segment_id, text; batches are small by construction.
    """
    items = F.array_sort(F.collect_list(F.struct("ordinal", F.col("segment_id").alias("segmentId"), "text")))
    return batched.groupBy(*BATCH_KEY).agg(
        F.to_json(
            F.transform(items, lambda s: F.struct(s["segmentId"].alias("segmentId"), s["text"].alias("text")))
        ).alias("payload")
    )


def review_payload(batched: DataFrame, base: DataFrame) -> DataFrame:
    """``(doc_id, batch_id, payload)`` for a reviewer: source and base text of each batch's segments, in order.

    ``batched`` as for ``request_payload``; ``base`` has doc_id, segment_id and the base translation as text.
    """
    joined = batched.join(
        base.select("doc_id", "segment_id", F.col("text").alias("base_text")), ["doc_id", "segment_id"]
    )
    items = F.array_sort(F.collect_list(F.struct("ordinal", "segment_id", "text", "base_text")))
    return joined.groupBy(*BATCH_KEY).agg(
        F.to_json(
            F.transform(items, lambda s: F.struct(
                s["segment_id"].alias("segmentId"), s["text"].alias("sourceText"), s["base_text"].alias("baseText")
            ))
        ).alias("payload")
    )


def batch_admission(batched: DataFrame, task: str = "translate") -> DataFrame:
    """Per batch: sizes, and whether the service takes it.

    For ``review`` the text is ``source_text`` and ``base_text`` together.
    """
    review = task == "review"
    limit, size = (
        (K.REVIEW_MAX_SEGMENTS, K.REVIEW_MAX_BYTES) if review else (K.TRANSLATE_MAX_SEGMENTS, K.TRANSLATE_MAX_BYTES)
    )
    parts = [F.col(c) for c in (["source_text", "base_text"] if review else ["text"])]
    blank = T.is_blank(F.col("segment_id"))
    width = F.lit(0)
    for part in parts:
        blank = blank | T.is_blank(part)
        width = width + F.octet_length(part)
    counted = batched.groupBy(*BATCH_KEY).agg(
        F.count("*").alias("segments"),
        F.sum(width).alias("bytes"),
        F.count_if(blank).alias("blank"),
        F.count_distinct("segment_id").alias("ids"),
    )
    admitted = (F.col("segments") <= limit) & (F.col("bytes") <= size) & (F.col("blank") == 0)
    if not review:
        admitted = admitted & (F.col("ids") == F.col("segments"))
    return counted.withColumn("admitted", admitted)


# --------------------------------------------------------------------- calls


def checked_answer(asked: list[dict], answered: list[dict]) -> list[dict]:
    """The answered segments under the identifiers asked for, in their order; raises what a retry understands.

    By identifier where exactly those asked for came back, else by position; an answer with another number of
    segments, or with a blank text, is refused.
    """
    if len(answered) != len(asked):
        raise ValueError(f"{len(asked)} segments were sent and {len(answered)} came back: not every segment identifier is there.")
    names = [s["segmentId"] for s in asked]
    texts = {s.get("segmentId"): s.get("text") for s in answered}
    if texts.keys() != set(names):
        texts = dict(zip(names, (s.get("text") for s in answered), strict=True))
    for name in names:
        if not (texts[name] or "").strip():
            raise ValueError(f"Segment {name} came back as an empty translation.")
    return [{"segmentId": name, "text": texts[name]} for name in names]


_OUTPUT_FAILURE, _SERVER_FAILURE = (re.compile(p.replace("(?iu)", "(?i)")) for p in (K.OUTPUT_FAILURE, K.SERVER_FAILURE))


def _failure_kind(error: Exception) -> str | None:
    detail = str(error)
    if _OUTPUT_FAILURE.search(detail):
        return "output"
    if _SERVER_FAILURE.search(detail):
        return "server"
    return None


def _add(a, b):
    return b if a is None else a if b is None else a + b


def call_with_recovery(
    call: Callable[[list[dict]], dict],
    segments: list[dict],
    validate: Callable[[list[dict], list[dict]], None] | None = None,
    pause: Callable[[float], None] = time.sleep,
) -> dict:
    """One batch through ``call``: halved on bad output, retried on a failing server.

    ``call`` returns ``segments`` and optional ``elapsed_ms``,
    ``prompt_token_count`` and ``output_token_count``.  Every answer has to hold what
    ``checked_answer`` and ``validate`` ask for.  The result carries the
    segments that worked, in order, and the error that stopped the batch, if any.
    """
    total = {"segments": [], "elapsed_ms": None, "prompt_token_count": None,
             "output_token_count": None, "calls": 0, "recoveries": 0, "error": None}
    work = [(segments, 0)]
    while work:
        items, failed = work.pop()
        total["calls"] += 1
        try:
            answer = call(items)
            segments = checked_answer(items, answer["segments"])
            if validate:
                validate(items, segments)
        except Exception as error:  # noqa: BLE001
            kind = _failure_kind(error)
            halve = kind == "output" and len(items) > 1
            if kind is None or (not halve and failed == K.MAX_RETRIES):
                total["error"] = str(error)
                return total
            total["recoveries"] += 1
            if halve:
                half = (len(items) + 1) // 2
                work += [(items[half:], 0), (items[:half], 0)]
                continue
            if kind == "server":
                pause(min(K.RETRY_STEP_MS * (failed + 1), K.RETRY_CEILING_MS) / 1000)
            work.append((items, failed + 1))
            continue
        total["segments"] += segments
        for counter in ("elapsed_ms", "prompt_token_count", "output_token_count"):
            total[counter] = _add(total[counter], answer.get(counter))
    return total


def run_batches(
    requests: DataFrame,
    make_call: Callable[[], Callable[[list[dict]], dict]],
    validate: Callable[[list[dict], list[dict]], None] | None = None,
) -> DataFrame:
    """Answers of a user's model, one row per batch; failures are rows, not exceptions.

    ``make_call`` runs once per partition, so that a session is opened once and
    only where there is work.  Repartition ``requests`` to the model's capacity.
    """
    schema = (
        "doc_id long, batch_id int, segments array<struct<segmentId:string,text:string>>, elapsed_ms long, "
        "prompt_token_count long, output_token_count long, calls int, recoveries int, error string"
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = None
        for frame in frames:
            rows = []
            for doc_id, batch_id, payload in zip(frame.doc_id, frame.batch_id, frame.payload):
                call = call or make_call()
                rows.append(
                    {"doc_id": doc_id, "batch_id": batch_id,
                     **call_with_recovery(call, json.loads(payload), validate)}
                )
            if rows:
                out = pd.DataFrame(rows)
                for counter in ("elapsed_ms", "prompt_token_count", "output_token_count"):
                    out[counter] = out[counter].astype("Int64")
                yield out[["doc_id", "batch_id", "segments", "elapsed_ms", "prompt_token_count",
                           "output_token_count", "calls", "recoveries", "error"]]

    return requests.select("doc_id", "batch_id", "payload").mapInPandas(run, schema)


# ------------------------------------------------------------------- answers


def parse_envelope(raw: Column) -> Column:
    """The segments of a raw answer; null when it is not the expected JSON."""
    body = T.trim(raw)
    body = F.regexp_replace(body, "^```(?:json)?", "")
    body = T.trim(F.regexp_replace(body, r"```\z", ""))
    return F.from_json(body, ENVELOPE)["segments"]


def parsed_outputs(outputs: DataFrame) -> DataFrame:
    """Raw answers to ``(doc_id, batch_id, position, segment_id, text)`` rows."""
    parsed = outputs.select(*BATCH_KEY, parse_envelope(F.col("raw")).alias("_all"))
    return unfold(parsed, "_all", "_s", "_at").select(
        *BATCH_KEY, (F.col("_at") + 1).alias("position"),
        F.col("_s.segmentId").alias("segment_id"), F.col("_s.text").alias("text"),
    )


def reconcile_outputs(expected: DataFrame, received: DataFrame) -> DataFrame:
    """Match answers to the segments of their batch.

    By identifier where a batch returned exactly its identifiers, by position
    where it returned as many segments under other identifiers; a batch with
    another count has no text.  Both inputs have doc_id, batch_id, position,
    segment_id and text.
    """
    flags = expected.select(*BATCH_KEY, "segment_id", F.lit(1).alias("e"), F.lit(0).alias("r")).unionByName(
        received.select(*BATCH_KEY, "segment_id", F.lit(0).alias("e"), F.lit(1).alias("r"))
    )
    shape = (
        flags.groupBy(*BATCH_KEY, "segment_id")
        .agg(F.sum("e").alias("e"), F.sum("r").alias("r"))
        .groupBy(*BATCH_KEY)
        .agg(
            F.when(F.sum("e") != F.sum("r"), "none")
            .when(F.bool_and((F.col("e") > 0) & (F.col("r") > 0)), "identifier")
            .otherwise("position")
            .alias("matched_by")
        )
    )
    # One join serves both ways of matching: the partner is a name or a place.
    name = lambda by: F.when(by == "identifier", F.col("segment_id")).otherwise(
        F.col("position").cast("string")
    )
    asked = expected.select(*BATCH_KEY, "position", "segment_id").join(shape, BATCH_KEY)
    got = received.join(shape, BATCH_KEY).where("matched_by <> 'none'").select(
        *BATCH_KEY, name(F.col("matched_by")).alias("_partner"), "text"
    )
    return (
        asked.withColumn("_partner", name(F.col("matched_by")))
        .join(got, [*BATCH_KEY, "_partner"], "left")
        .select(
            *BATCH_KEY, "position", "segment_id", "text", "matched_by",
            F.when(F.col("matched_by") == "none", "count")
            .when(T.is_blank(T.or_empty(F.col("text"))), "empty")
            .alias("error"),
        )
    )


# ------------------------------------------------------------------ failures


def classify_failure(detail: Column, fallback: Column) -> Column:
    """``struct<code, recoverable, action>`` of a failure message."""
    actions = F.create_map(*[F.lit(x) for pair in K.FALLBACK_ACTIONS.items() for x in pair])

    def outcome(code, recoverable, action):
        return F.struct(
            code.alias("code"), recoverable.alias("recoverable"), action.alias("action")
        )

    chain = None
    for pattern, code, recoverable, action in K.FAILURE_RULES:
        result = outcome(F.lit(code), F.lit(recoverable), F.lit(action))
        rule = T.matches(detail, pattern)
        chain = F.when(rule, result) if chain is None else chain.when(rule, result)
    return chain.otherwise(
        outcome(
            fallback,
            fallback != "PDF_LOAD_FAILED",
            F.coalesce(actions[fallback], F.lit(K.FALLBACK_ACTIONS["UNKNOWN"])),
        )
    )


def failure_kind(detail: Column) -> Column:
    """``output``, ``server`` or null: how a failed model call is recovered."""
    return F.when(T.matches(detail, K.OUTPUT_FAILURE), "output").when(
        T.matches(detail, K.SERVER_FAILURE), "server"
    )


def classify_failures(failures: DataFrame) -> DataFrame:
    """Failures with code, recoverability, advice and the message for the user."""
    lookup = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    fallback = F.coalesce(lookup(K.STAGE_FALLBACK)[F.col("stage")], F.lit("UNKNOWN"))
    out = failures.withColumn("_f", classify_failure(F.col("detail"), fallback))
    message = F.concat(
        F.lit("No se pudo "), lookup(K.STAGE_LABELS)[F.col("stage")], F.lit(". "), F.col("action")
    )
    return (
        out.select(*failures.columns, "_f.code", "_f.recoverable", "_f.action")
        .withColumn("message", message)
        .withColumn(
            "message",
            F.when(
                T.is_blank(F.col("detail")) | F.contains("message", T.trim(F.col("detail"))), F.col("message")
            ).otherwise(F.concat("message", F.lit(" Detalle: "), T.trim(F.col("detail")))),
        )
    )


# ------------------------------------------------------------------- reports


def run_metadata(pages: DataFrame, translations: DataFrame, objects: DataFrame) -> DataFrame:
    """Per document: pages by method, translations by decision, protected notation."""
    names = ["native_page_count", "ocr_page_count", "reviewed_segment_count",
             "base_retained_segment_count", "math_object_count"]
    where = {
        "native_page_count": (pages, F.col("method") == "native"),
        "ocr_page_count": (pages, F.col("method") == "ocr"),
        "reviewed_segment_count": (translations, F.col("review_status") == "approved"),
        "base_retained_segment_count": (
            translations, F.col("review_status").isin("base-retained", "needs-review")),
        "math_object_count": (objects, F.lit(True)),
    }
    flags = None
    for source in (pages, translations, objects):
        columns = [
            (F.when(where[n][1], 1).otherwise(0) if where[n][0] is source else F.lit(0)).alias(n)
            for n in names
        ]
        rows = source.select("doc_id", *columns)
        flags = rows if flags is None else flags.unionByName(rows)
    return flags.groupBy("doc_id").agg(*[F.sum(n).alias(n) for n in names])


def batch_counters(answers: DataFrame) -> DataFrame:
    """Per document: elapsed time and token counts; a count nobody reported stays null."""
    return answers.groupBy("doc_id").agg(
        F.count("*").alias("batches"),
        F.sum("elapsed_ms").alias("elapsed_ms"),
        F.sum("prompt_token_count").alias("prompt_token_count"),
        F.sum("output_token_count").alias("output_token_count"),
    )


def status_counts(translations: DataFrame) -> DataFrame:
    return translations.groupBy(
        F.coalesce("review_status", F.lit("not-reviewed")).alias("review_status")
    ).agg(F.count("*").alias("segments"))
