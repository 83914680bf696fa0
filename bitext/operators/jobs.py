"""State of background jobs from their events, and scroll events that count.

``job_events(project_id, document_id, seq, type, progress, error)``; the same
state is kept by ``bitext.streaming.jobs`` on a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext import constants as K
from bitext.plans.ordered import previous, rank_within, running_before

JOB = ["project_id", "document_id"]
TYPES = ["started", "progressed", "failed", "finished"]


def job_state(events: DataFrame) -> DataFrame:
    """The jobs that are running or failed: one map-side combined aggregate per job."""
    kind = F.col("type")
    decisive = kind != "progressed"
    folded = events.where(kind.isin(TYPES)).groupBy(*JOB).agg(
        F.max(F.when(decisive, F.struct("seq", kind.alias("type"), "error"))).alias("_last"),
        F.max_by(F.when(~decisive, F.col("progress")), F.when(~decisive, F.col("seq"))).alias("_progress"),
        F.max(F.when(~decisive, F.col("seq"))).alias("_progress_seq"),
    )
    running = F.col("_last.type") == "started"
    return folded.where(F.col("_last.type").isin("started", "failed")).select(
        *JOB,
        F.when(running, "running").otherwise("failed").alias("phase"),
        F.when(running & (F.col("_progress_seq") > F.col("_last.seq")), F.col("_progress")).alias("progress"),
        F.when(~running, F.col("_last.error")).alias("error"),
    )


def accepted_starts(events: DataFrame) -> DataFrame:
    """Start events of jobs that are not running already."""
    decisive = events.where(F.col("type").isin("started", "failed", "finished"))
    lagged = previous(decisive, JOB, "seq", {"type": "_before"})
    return lagged.where(
        (F.col("type") == "started") & ~F.col("_before").eqNullSafe(F.lit("started"))
    ).drop("_before")


def debounced_sync(events: DataFrame, hot_rows: int = 4_000_000) -> DataFrame:
    """Scroll events that make their side the leader: those not caused by a move of ours.

    ``events(reader_id, seq, at_ms, kind, side, behavior)`` with kind scroll or
    intent, and optionally ``moved``, false for scrolls that moved nothing (``position.sync_decisions`` tells).
    An accepted scroll that moves the other side has that side's scroll events
    ignored for a while; an intent ends that.  Nothing outlasts the longest such
    while, so that a pause of that length cuts a reader's events into sessions
    that are folded independently.
    """
    ranked = rank_within(with_moved(events), ["reader_id"], ["at_ms", "seq"], "_n", hot_rows)
    lagged = previous(ranked, ["reader_id"], "_n", {"at_ms": "_before"})
    opens = F.coalesce(F.col("at_ms") - F.col("_before") >= K.SUPPRESS_SMOOTH_MS, F.lit(True))
    sessions = running_before(
        lagged.withColumn("_opens", opens.cast("int")), ["reader_id"], "_n", {"_earlier": ("sum", F.col("_opens"))}
    ).withColumn("_session", F.col("_earlier") + F.col("_opens"))
    return (
        sessions.select("reader_id", "_session", "_n", "seq", "at_ms", "kind", "side", "behavior", "moved")
        .repartition("reader_id", "_session")
        .sortWithinPartitions("reader_id", "_session", "_n")
        .mapInPandas(_fold_scrolls, "reader_id long, seq long, at_ms long, side string")
    )


def with_moved(events: DataFrame) -> DataFrame:
    """``events`` with ``moved``, true where it is not said."""
    said = F.coalesce(F.col("moved"), F.lit(True)) if "moved" in events.columns else F.lit(True)
    return events.withColumn("moved", said)


def scroll_step(state: tuple[str, int] | None, kind: str, side: str, at_ms: int, behavior: str, moved: bool = True):
    """(new state, accepted) after one event; the state is the silenced side and until when."""
    if kind == "intent":
        return None, False
    if state and state[0] == side and at_ms < state[1]:
        return state, False
    if not moved:
        return state, True
    other = "translation" if side == "source" else "source"
    quiet = K.SUPPRESS_SMOOTH_MS if behavior == "smooth" else K.SUPPRESS_AUTO_MS
    return (other, at_ms + quiet), True


def _fold_scrolls(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    session, state = None, None
    for frame in frames:
        keep = []
        for row in zip(frame.reader_id, frame["_session"], frame.kind,
                       frame.side, frame.at_ms, frame.behavior, frame.moved):
            if row[:2] != session:
                session, state = row[:2], None
            state, accepted = scroll_step(state, *row[2:])
            keep.append(accepted)
        yield frame.loc[keep, ["reader_id", "seq", "at_ms", "side"]]
