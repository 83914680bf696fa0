"""The state of background jobs and readers on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bitext.operators.jobs import JOB, TYPES, scroll_step, with_moved
from bitext.streaming.ordered import fold_in_order

STATE = "seq long, type string, error string, progress_seq long, progress string"
OUTPUT = "project_id string, document_id string, seq long, phase string, progress string, error string"


def _fold_jobs(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Latest decisive event and latest progress of one job; order inside a batch does not matter."""
    if state.hasTimedOut:
        state.remove()
        return
    seq, kind, error, progress_seq, progress = state.get if state.exists else (-1, None, None, -1, None)
    expires = state.getCurrentWatermarkMs() + 1
    for frame in frames:
        expires = max(expires, int(frame["_expires_ms"].max()))
        decisive = frame[frame["type"] != "progressed"]
        if len(decisive):
            last = decisive.loc[decisive["seq"].idxmax()]
            if last["seq"] > seq:
                seq, kind, error = int(last["seq"]), last["type"], last["error"]
        steps = frame[frame["type"] == "progressed"]
        if len(steps):
            last = steps.loc[steps["seq"].idxmax()]
            if last["seq"] > progress_seq:
                progress_seq, progress = int(last["seq"]), last["progress"]
    # A finished job stays known too, or an event that comes late would revive it.
    state.update((seq, kind, error, progress_seq, progress))
    state.setTimeoutTimestamp(expires)
    if kind is not None:
        running = kind == "started"
        yield pd.DataFrame(
            [[*key, seq, {"started": "running", "failed": "failed"}.get(kind, "finished"),
              progress if running and progress_seq > seq else None, error if kind == "failed" else None]],
            columns=["project_id", "document_id", "seq", "phase", "progress", "error"],
        )


def _expires(ttl_ms: int):
    return (F.unix_millis("ts") + ttl_ms).alias("_expires_ms")


def stream_job_state(events: DataFrame, watermark: str = "1 hour", ttl_hours: int = 72) -> DataFrame:
    """Changes of job state, one row per job and micro-batch: running, failed or finished.

    ``events`` has the columns of ``operators.jobs`` and a timestamp ``ts``.  The
    state of a job, also of a finished one, goes ``ttl_hours`` after the watermark
    passed its last event.  ``progress`` is JSON.
    """
    return (
        events.where(F.col("type").isin(TYPES))
        .withWatermark("ts", watermark)
        .select(*JOB, "seq", "ts", "type", F.to_json("progress").alias("progress"), "error",
                _expires(ttl_hours * 3_600_000))
        .groupBy(*JOB)
        .applyInPandasWithState(_fold_jobs, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
    )


def _scroll(state: tuple | None, at_ms: int, seq: int, kind: str, side: str, behavior: str, moved: bool):
    quiet, accepted = scroll_step(tuple(state) if state else None, kind, side, at_ms, behavior, moved)
    return quiet, accepted


def _silenced_until(state: tuple) -> int:
    return state[1]


def stream_debounced_sync(events: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """Scroll events that make their side the leader, as ``operators.jobs.debounced_sync``: reader_id, seq, at_ms, side.

    Events count in the order of ``at_ms`` and ``seq``, whatever micro-batch brings them: a reader's events wait until the watermark
    on ``at_ms`` (milliseconds since the epoch) has passed them.  What is kept of a reader is the events that wait and one silenced
    side, until its silence ends.  Events without reader or time are left out.  ``ordered.use_state_lists`` keeps states on disk.
    """
    return fold_in_order(
        with_moved(events), ["reader_id"], "at_ms", ["seq", "kind", "side", "behavior", "moved"],
        "side string, until long", _scroll, _silenced_until, ["seq", "at_ms", "side"], watermark,
    )


def _start(state: tuple | None, at_ms: int, seq: int, type: str, expires_ms: int):
    """A job runs from a start until its end, or until a start's time is up."""
    running = state is not None and at_ms < state[0]
    if type == "started":
        return (state, False) if running else ((expires_ms,), True)
    return None, False


def _runs_until(state: tuple) -> int:
    return state[0]


def stream_accepted_starts(events: DataFrame, watermark: str = "1 hour", ttl_hours: int = 24 * 365) -> DataFrame:
    """Start events of jobs that are not running already, as ``operators.jobs.accepted_starts``: the job, seq, at_ms.

    Events count in the order of their time ``ts``, then ``seq``.  A start is refused while an accepted one of its job is neither
    finished nor failed, for ``ttl_hours`` at most: a job that never ends is forgotten then.  Progress says nothing here.
    """
    clocked = events.where(F.col("type").isin("started", "failed", "finished")).select(
        *JOB, F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "seq", "type"
    ).withColumn("expires_ms", F.col("at_ms") + ttl_hours * 3_600_000)
    return fold_in_order(clocked, JOB, "at_ms", ["seq", "type", "expires_ms"], "until long", _start, _runs_until, ["seq", "at_ms"], watermark)
