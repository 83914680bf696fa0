"""Best-fit packing by patterns: non-negative least squares over a histogram of lengths.

All that the plan needs is how many pieces have each length, at most as many numbers
as a sequence has tokens.  Patterns of up to three pieces that fill a sequence exactly are
fitted to the histogram, their repeat counts rounded and bounded by it, and the rest
is packed best-fit-decreasing, again by length and count.  The pieces then look their place up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext.llm.common import Encoder, arrow_blocks, running, without

RESULT = ["sequence_id", "offset"]


def patterns(capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ways to fill ``capacity`` with one, two or three lengths, longest first; 0 stands for no piece."""
    first, second = np.meshgrid(np.arange(capacity + 1), np.arange(capacity + 1), indexing="ij")
    third = capacity - first - second
    use = (first >= second) & (second >= third) & (third >= 0)
    return first[use], second[use], third[use]


def fit_counts(histogram: np.ndarray, parts: tuple[np.ndarray, np.ndarray, np.ndarray], rounds: int = 400) -> np.ndarray:
    """How often to use each pattern: least squares against the histogram, no count below 0.

    Projected gradient steps with momentum.  ``histogram[l]`` counts pieces of length l; its entry 0 is ignored.
    A miss weighs as the square of the length: short pieces left over find a gap, long ones need a sequence.
    """
    size = len(histogram)
    weight = (np.arange(size) / (size - 1)) ** 2
    wanted = histogram.astype(float).copy()
    wanted[0] = 0

    def uses(x: np.ndarray) -> np.ndarray:
        total = sum(np.bincount(p, weights=x, minlength=size) for p in parts)
        total[0] = 0
        return total

    def slope(miss: np.ndarray) -> np.ndarray:
        miss = miss * weight
        return sum(miss[p] for p in parts)

    # The largest eigenvalue of the normal matrix, by power steps.
    v = np.ones(len(parts[0]))
    for _ in range(20):
        v = slope(uses(v))
        step = np.linalg.norm(v)
        v /= step
    x = ahead = np.zeros(len(parts[0]))
    pace = 1.0
    for _ in range(rounds):
        new = np.maximum(ahead + slope(wanted - uses(ahead)) / (1.02 * step), 0)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = new + (pace - 1) / faster * (new - x)
        x, pace = new, faster
    return x


@dataclass
class Plan:
    """Runs of places: the pieces of ``length`` with ranks from ``rank`` go to the sequences from ``sequence``, one each."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def plan(histogram: np.ndarray) -> Plan:
    """Places for all pieces that ``histogram`` counts; its last index is the capacity."""
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    used = np.zeros(capacity + 1, dtype=np.int64)
    runs: list[tuple[int, int, int, int]] = []
    sequences = 0

    def place(lengths: list[int], count: int) -> int:
        nonlocal sequences
        offset = 0
        for length in lengths:
            # Equal lengths in one pattern take ranks one after the other.
            runs.append((length, int(used[length]), sequences, offset))
            used[length] += count
            left[length] -= count
            offset += length
        sequences += count
        return sequences - count

    if left.sum():
        parts = patterns(capacity)
        wanted = fit_counts(left, parts)
        order = np.lexsort((parts[1], parts[0]))[::-1]
        # Rounding the running sum keeps the total; single patterns are off by less than one.
        ends = np.floor(np.cumsum(wanted[order]) + 0.5).astype(np.int64)
        repeats = np.diff(ends, prepend=0)
        for p in np.flatnonzero(repeats):
            lengths = [int(part[order[p]]) for part in parts if part[order[p]]]
            need = {length: lengths.count(length) for length in lengths}
            count = min(int(repeats[p]), *(int(left[length]) // n for length, n in need.items()))
            if count > 0:
                place(lengths, count)
    # Best-fit-decreasing of the rest: open sequences by room, as (first sequence, how many, filled).
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    def fill(start: int, count: int, gap: int, length: int, per: int) -> None:
        for k in range(per):
            runs.append((length, int(used[length]), start, capacity - gap + k * length))
            used[length] += count
            left[length] -= count
        room[gap - per * length].append((start, count))

    for length in range(capacity, 0, -1):
        for gap in range(length, capacity):
            while left[length] and room[gap]:
                start, many = room[gap].pop()
                # The tightest sequence stays the tightest while it has room for the same length.
                per = gap // length
                whole = min(many, int(left[length]) // per)
                if whole:
                    fill(start, whole, gap, length, per)
                elif left[length]:
                    whole = 1
                    fill(start, 1, gap, length, int(left[length]))
                if whole < many:
                    room[gap].append((start + whole, many - whole))
        if left[length]:
            each = capacity // length
            whole, rest = divmod(int(left[length]), each)
            for per, many in ((each, whole), (rest, 1)):
                if per and many:
                    start = place([length] * per, many)
                    room[capacity - per * length].append((start, many))
    table = np.array(runs, dtype=np.int64).reshape(-1, 4)
    order = np.lexsort((table[:, 1], table[:, 0]))
    return Plan(*table[order].T.copy(), sequences)


def pack(pieces: DataFrame, capacity: int = 2048, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """The rows of ``pieces`` with sequence_id (from 0) and offset (place in the sequence, without gaps).

    Every piece has 1 to ``capacity`` tokens; a piece outside of that, or without length, ends the job with an error.
    Pieces of one length are ranked by ``order``, rows that tie in an order of their own choice, fixed for
    the run.  Columns named like a result column give way.  An empty table gives an empty one.
    The plan is bounded by the capacity, not by the data: a histogram of ``capacity`` numbers comes to the driver.
    """
    kept = without(pieces, RESULT)
    checked = F.when(F.col(length).between(1, capacity), F.col(length).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit(f"Pieces need 1 to {capacity} tokens, found "), F.coalesce(F.col(length).cast("string"), F.lit("null"))))
    )
    rows = pieces.select(F.struct(*kept).alias("row"), checked.alias("length"), *[F.col(c).alias(f"by{k}") for k, c in enumerate(order)])
    ranked = running(rows, ["length"], [f"by{k}" for k in range(len(order))], {"rank": F.lit(1)}, "pieces")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for found in ranked.groupBy("length").count().collect():
        histogram[found["length"]] = found["count"]
    places = pieces.sparkSession.sparkContext.broadcast(plan(histogram))

    @F.pandas_udf("sequence_id long, offset long")
    def look_up(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        p = places.value
        width = int(p.rank.max()) + 1 if len(p.rank) else 1
        width = max(width, int(ranks.max()) + 1)
        at = np.searchsorted(p.length * width + p.rank, lengths.to_numpy(dtype=np.int64) * width + ranks.to_numpy(dtype=np.int64), "right") - 1
        return pd.DataFrame({"sequence_id": p.sequence[at] + ranks.to_numpy() - p.rank[at], "offset": p.offset[at]})

    return ranked.withColumn("place", look_up("length", "rank")).select("row.*", "place.*")


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, id: str = "doc_id", text: str = "text", end_id: int = 0, with_ids: bool = True
) -> DataFrame:
    """Per piece: the id column, piece (from 0), start, length, ids_crc32, and ids (array) where asked for.

    A text's ids and then ``end_id`` make a document; one longer than ``capacity`` is cut into pieces of that
    length, of which the first takes what is over.  A null text is empty: a document of one end id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            for some in arrow_blocks(batch, "text"):
                ids, bounds = encoder.encode(some.column("text"))
                ends = bounds[1:] + np.arange(1, len(bounds))
                ids = np.insert(ids, bounds[1:], np.uint32(end_id)).astype("<u4")
                lengths = np.diff(ends, prepend=0)
                first = (lengths - 1) % capacity + 1
                pieces = 1 + (lengths - first) // capacity
                owner = np.repeat(np.arange(len(some)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.where(piece == 0, 0, first[owner] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[owner], capacity)
                at = (ends - lengths)[owner] + start
                raw = memoryview(ids).cast("B")
                digests = [zlib.crc32(raw[4 * lo : 4 * hi]) for lo, hi in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [some.column("id").take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(digests, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    kind = dict(docs.dtypes)[id]
    types = f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(cut, types).withColumnRenamed("id", id)


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """Packed pieces with their ids to training sequences: sequence_id, ids, and the lengths of the pieces in order."""
    return (
        packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", F.col(ids).alias("ids")))).alias("parts"))
        .select("sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: F.size(p["ids"])).alias("lengths"))
    )
