"""Folding a stream key by key in event-time order, however its rows are dealt to micro-batches.

A key's rows wait in the state of its bucket until the watermark has passed them; a timeout then wakes the bucket, the
rows that no late row can come before any more are folded key by key in order, and the rest wait on.  Keys are few rows
each and many: dealt to buckets by their hash, they cost no call and no frame of their own.  So the
result is that of the batch form for every split of the input and for all rows that come inside the watermark.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 4096


def use_state_lists(spark: SparkSession) -> None:
    """States on disk, by the RocksDB state store: what waits need not fit into the memory of the executors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _ranked(row: tuple) -> list[tuple]:
    return [(v is not None, v) for v in row]


def _values(column: pd.Series, whole: bool) -> list:
    """Plain values, null for missing ones, which make a column of whole numbers one of fractions."""
    return [None if v is None or v != v else int(v) if whole else v for v in column.tolist()]


def _sorted(rows: list[tuple]) -> list[tuple]:
    try:
        return sorted(rows)
    except TypeError:  # nulls come first
        return sorted(rows, key=_ranked)


def _in_order(key: list[str], names: list[str], whole: list[bool], step: Callable, until: Callable, put_out: list[str]) -> Callable:
    """A fold of the keys of a bucket for ``applyInPandasWithState``.

    ``step(state, *row)`` gives (new state, keep) for a key's rows in order; rows with ``keep`` are put out.  Rows begin with
    the time in milliseconds and then sort by all their columns.  ``until(state)`` is the time from which a state says nothing
    any more, null for never; it goes when the watermark passes it.
    """
    at, columns = len(key), [*key, *names]

    def fold(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        upto = state.getCurrentWatermarkMs()
        waiting, states = state.get if state.exists else ([], [])
        rows = [tuple(r) for r in waiting]
        held = {tuple(r[:at]): tuple(r[at:]) for r in states}
        if not state.hasTimedOut:
            for frame in frames:
                rows += zip(*[_values(frame[n], w) for n, w in zip(columns, whole, strict=True)], strict=True)
        kept = []
        for name, due in itertools.groupby(_sorted([r for r in rows if r[at] <= upto]), lambda r: r[:at]):
            now = held.get(name)
            for row in due:
                now, keep = step(now, *row[at:])
                if keep:
                    kept.append(row)
            held[name] = now
        rest = [r for r in rows if r[at] > upto]
        ends = {name: until(now) for name, now in held.items() if now is not None}
        left = [(*name, *held[name]) for name, end in ends.items() if end is None or end > upto]
        if rest or left:
            state.update((rest, left))
            wakes = [r[at] for r in rest] + [end for end in ends.values() if end is not None and end > upto]
            if wakes:
                # A bucket is woken once the watermark is past this time, that is, once it has reached the first of them.
                state.setTimeoutTimestamp(max(int(min(wakes)) - 1, upto, 1))
        elif state.exists:
            state.remove()
        if kept:
            yield pd.DataFrame(kept, columns=columns)[[*key, *put_out]]

    return fold


def fold_in_order(
    events: DataFrame, key: list[str], time: str, row: list[str], state: str, step: Callable, until: Callable, put_out: list[str], watermark: str,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The rows of a stream that ``step`` keeps: the key and the columns ``put_out``.

    ``time`` is a column of milliseconds, ``row`` the columns after it that order rows of one time and go to ``step``.  Rows
    without key or time are left out; rows later than the watermark are dropped by Spark.  A bucket of keys has to fit into
    a task; their number is part of the stream's state, and cannot change while it is kept.
    """
    clocked = events.where(F.col(time).isNotNull() & ~F.greatest(*[F.col(k).isNull() for k in key], F.lit(False)))
    clocked = clocked.withColumn("_clock", F.timestamp_millis(time)).withWatermark("_clock", watermark)
    clocked = clocked.select(*key, time, *row, "_clock")
    types = {f.name: f.dataType.simpleString() for f in clocked.schema.fields}
    columns = [*key, time, *row]
    whole = [types[n] in ("bigint", "int", "smallint", "tinyint") for n in columns]
    ddl = lambda names: ", ".join(f"`{n}` {types[n]}" for n in names)
    kept_as = f"waiting array<{StructType.fromDDL(ddl(columns)).simpleString()}>, states array<{StructType.fromDDL(f'{ddl(key)}, {state}').simpleString()}>"
    fold = _in_order(key, [time, *row], whole, step, until, put_out)
    return clocked.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets))).groupBy("_bucket").applyInPandasWithState(
        fold, ddl([*key, *put_out]), kept_as, "append", GroupStateTimeout.EventTimeTimeout
    )
