"""Mixture-controlled packing: windows of fixed size, each filled from all sources in target proportions.

Every source is a queue of tokens.  Deficit round-robin serves the queues in rounds of one window: a round adds a queue's
share of the window to its deficit, and the queue then sends as many whole grains of tokens as its deficit covers, the rest
being carried into the next round.  A queue that runs dry gives its share to the others.  What the rounds send, one after
the other, is cut into windows, so that windows are full and hold the proportions up to a few grains.

The deficits need no run from the first window on: what a queue has sent after n rounds is the whole grains of its credit
then, and credit is a function of n.  So any task knows the deficits that the rounds before its documents left over, and places
its documents on its own; all that it is told is the length of each queue and where in its queue a document stands.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bitext.llm.common import Encoder, arrow_blocks, running, same, staged

QUEUES = 1024  # sources of their own; the smaller ones share the last queue
GRAIN = 32
CELLS = 1 << 18  # numbers in memory at a time while rounds are added up


@dataclass
class Rounds:
    """Deficit round-robin over queues of ``length`` tokens with weights ``weight``, ``capacity`` tokens a round.

    While n rounds are served, the credit of every queue that is not dry grows in proportion to its weight, by ``capacity`` a
    round in all.  Numbers are doubles; all that counts is that what was sent never shrinks with n and ends at the length.
    """

    length: np.ndarray
    weight: np.ndarray
    capacity: int
    grain: int

    def __post_init__(self) -> None:
        self.length = np.asarray(self.length, dtype=np.int64)
        self.weight = np.asarray(self.weight, dtype=np.float64)
        self.total = int(self.length.sum())
        self.last = -(-self.total // self.capacity)
        # Credit per weight at which queues run dry, and the tokens of all queues until then.
        self.dry = self.length / self.weight
        order = np.argsort(self.dry, kind="stable")
        self.levels = np.concatenate([[0.0], self.dry[order]])
        open_weight = np.cumsum(self.weight[order][::-1])[::-1]
        self.served = np.concatenate([[0.0], np.cumsum(np.diff(self.levels) * open_weight)])
        self.pace = np.append(np.divide(1.0, open_weight, out=np.zeros(len(order)), where=open_weight > 0), 0.0)

    def level(self, n: np.ndarray) -> np.ndarray:
        """Credit per weight after n rounds."""
        tokens = np.clip(n, 0, self.last).astype(np.float64) * self.capacity
        at = np.clip(np.searchsorted(self.served, tokens, "right") - 1, 0, len(self.levels) - 1)
        upper = np.append(self.levels, self.levels[-1])[at + 1]
        return np.minimum(self.levels[at] + (tokens - self.served[at]) * self.pace[at], upper)

    def sent(self, queue: np.ndarray, n: np.ndarray, level: np.ndarray | None = None) -> np.ndarray:
        """Tokens that queues have sent after n rounds: the whole grains of their credit, all of them once they are dry."""
        level = self.level(n) if level is None else level
        length = self.length[queue]
        whole = np.minimum(np.floor(level * self.weight[queue] / self.grain).astype(np.int64) * self.grain, length)
        return np.where((level >= self.dry[queue]) | (n >= self.last), np.where(n > 0, length, 0), whole)

    def round_of(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The round, from 1, that sends a token of a queue."""
        due = np.minimum((token // self.grain + 1) * self.grain, self.length[queue]) / self.weight[queue]
        at = np.clip(np.searchsorted(self.levels, due, "left") - 1, 0, len(self.levels) - 2)
        slope = np.where(self.pace[at] > 0, self.pace[at], 1.0)
        n = np.clip(np.ceil((self.served[at] + (due - self.levels[at]) / slope) / self.capacity), 1, max(self.last, 1)).astype(np.int64)
        while (late := self.sent(queue, n) <= token).any():
            n += late
        while (early := (n > 1) & (self.sent(queue, n - 1) > token)).any():
            n -= early
        return n

    def begins(self, queue: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Where in the stream of all rounds that begins which a queue sends in round n."""
        found = np.empty(len(n), dtype=np.int64)
        rounds, which = np.unique(n, return_inverse=True)
        queues = np.arange(len(self.length))
        step = max(1, CELLS // len(queues))
        order = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[order], np.arange(0, len(rounds) + step, step))
        for k, lo in enumerate(range(0, len(rounds), step)):
            some = rounds[lo : lo + step, None]
            after, before = self.sent(queues, some, self.level(some)), self.sent(queues, some - 1, self.level(some - 1))
            upto = before.sum(axis=1)[:, None] + np.cumsum(after - before, axis=1) - (after - before)
            mine = order[cuts[k] : cuts[k + 1]]
            found[mine] = upto[which[mine] - lo, queue[mine]]
        return found


@dataclass
class Cuts:
    """Windows over a stream of ``total`` tokens: full ones, then what is over in powers of two, the largest first."""

    total: int
    capacity: int

    def __post_init__(self) -> None:
        self.full = self.total // self.capacity
        over = self.total - self.full * self.capacity
        sizes = [1 << b for b in range(over.bit_length() - 1, -1, -1) if over >> b & 1]
        self.tail = self.full * self.capacity + np.cumsum([0, *sizes], dtype=np.int64)

    def window(self, place: np.ndarray) -> np.ndarray:
        return np.where(place < self.tail[0], place // self.capacity, self.full + np.searchsorted(self.tail, place, "right") - 1)

    def begin(self, window: np.ndarray) -> np.ndarray:
        return np.where(window < self.full, window * self.capacity, self.tail[np.clip(window - self.full, 0, len(self.tail) - 1)])


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers from first to last of each row: the row, and the number."""
    many = last - first + 1
    row = np.repeat(np.arange(len(first)), many)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many - first, many)


def place_pieces(rounds: Rounds, cuts: Cuts, queue: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of documents that stand at ``at`` in their queues: document, start, length, window, offset."""
    doc, grain = _spread(at // rounds.grain, (at + length - 1) // rounds.grain)
    lo = np.maximum(grain * rounds.grain, at[doc])
    n = rounds.round_of(queue[doc], lo)
    # Grains of a document in one round are one piece.
    opens = np.append(True, (doc[1:] != doc[:-1]) | (n[1:] != n[:-1]))[: len(doc)]
    doc, lo, n = doc[opens], lo[opens], n[opens]
    same_doc = np.append(doc[1:] == doc[:-1], False)[: len(doc)]
    hi = np.where(same_doc, np.append(lo[1:], 0)[: len(doc)], (at + length)[doc])
    mine = queue[doc]
    place = rounds.begins(mine, n) + lo - rounds.sent(mine, n - 1)
    row, window = _spread(cuts.window(place), cuts.window(place + hi - lo - 1))
    begin, end = np.maximum(place[row], cuts.begin(window)), np.minimum((place + hi - lo)[row], cuts.begin(window + 1))
    start = lo[row] + begin - place[row] - at[doc[row]]
    return doc[row], start, end - begin, window, begin - cuts.begin(window)


def _tokens(docs: DataFrame, tokenizer: str, id: str, text: str, source: str, end_id: int) -> DataFrame:
    """Rows id, source, ids (unsigned 32-bit, little-endian, with the end id), doc_tokens, part, before.

    ``part`` is the task that read the row, ``before`` the tokens of the same source that it read earlier.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = Encoder.of(tokenizer), TaskContext.get().partitionId(), {}
        for batch in batches:
            for some in arrow_blocks(batch, "text"):
                ids, bounds = encoder.encode(some.column("text"))
                ids = np.insert(ids, bounds[1:], np.uint32(end_id)).astype("<u4")
                bounds = bounds + np.arange(len(bounds))
                lengths = np.diff(bounds)
                coded = some.column("source").dictionary_encode(null_encoding="encode")
                codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                order = np.argsort(codes, kind="stable")
                opens = np.searchsorted(codes[order], np.arange(len(names) + 1))
                upto = np.concatenate([[0], np.cumsum(lengths[order])])
                earlier = np.array([seen.get(name, 0) for name in names], dtype=np.int64) - upto[opens[:-1]]
                before = np.empty(len(some), dtype=np.int64)
                before[order] = upto[:-1] + np.repeat(earlier, np.diff(opens))
                seen.update(zip(names, (earlier + upto[opens[1:]]).tolist(), strict=True))
                raw = pa.Array.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(4 * bounds), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [some.column("id"), some.column("source"), raw.cast(pa.binary()), pa.array(lengths), pa.array(np.full(len(some), part)), pa.array(before)],
                    names=["id", "source", "ids", "doc_tokens", "part", "before"],
                )

    rows = docs.select(F.col(id).alias("id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    types = StructType.fromDDL("source string, ids binary, doc_tokens long, part long, before long")
    return rows.mapInArrow(encode, StructType([rows.schema["id"], *types.fields]))


def pack_mixture(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    weights: Mapping[str | None, float] | None = None,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    end_id: int = 1,
    grain: int = GRAIN,
    queues: int = QUEUES,
) -> DataFrame:
    """Pieces of the documents' token ids in windows: the id column, source, start, length, doc_tokens, sequence_id, offset, ids.

    A text's ids and then ``end_id`` are a document; a null text is empty.  Every window but the last few has ``capacity`` tokens;
    what is over is split into windows of powers of two, so that none needs padding.  ``weights`` are the targets of the sources
    (one that is not named, or not above 0, waits until the named ones are dry); without them the targets are the sources' shares of all
    tokens, so that all windows hold the mixture of the whole corpus.  A source sends whole grains of ``grain`` tokens, which keeps pieces
    from being splintered.  ``ids`` are little-endian unsigned 32-bit integers.

    A null source is a source of its own.  The ``queues`` - 1 largest sources have queues of their own, all smaller ones share
    one; that bounds what tasks are told, and touches the mixture inside that queue only.  Identifiers may be null or
    repeated, each row is a document.  Queues stand in the order in which the rows were read.  Extra columns play no part.  An empty
    table gives an empty one.  A document's ids are held by one task.
    """
    rows = staged(_tokens(docs, tokenizer, id, text, source, end_id), "tokens")
    spark = docs.sparkSession
    parts = staged(rows.groupBy("source", "part").agg(F.sum("doc_tokens").alias("tokens")), "parts")
    sources = staged(parts.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    largest = sources.orderBy(F.desc("tokens"), "source").limit(queues - 1).collect()
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    named = [(r["source"], k, int(r["tokens"])) for k, r in enumerate(sorted(largest, key=lambda r: (r["source"] is not None, r["source"])))]
    lengths = [n for *_, n in named]
    rest = total - sum(lengths)
    targets = [float((weights or {}).get(name, 0)) if weights else float(n) for name, _, n in named] + [0.0 if weights else float(rest)]
    # A queue without a target gets next to nothing while others are served.
    least = min([w for w in targets if w > 0], default=1.0) * 1e-12
    lengths, targets = [*lengths, rest], [max(w, least) for w in targets]
    rounds, cuts = Rounds(lengths, targets, capacity, grain), Cuts(total, capacity)
    table = spark.createDataFrame([(n, k) for n, k, _ in named], "name string, queue int")
    queued = parts.join(F.broadcast(table), same(F.col("source"), F.col("name")), "left")
    queued = queued.withColumn("queue", F.coalesce("queue", F.lit(len(named)))).drop("name")
    carried = running(queued, ["queue"], ["part", "source"], {"carried": F.col("tokens")}, "carried")
    carried = staged(carried.select(F.col("source").alias("_source"), F.col("part").alias("_part"), "queue", "carried"), "carried")
    # A row per task and source: small enough to be broadcast, or joined by both, which no hot source hurts.
    told = rows.join(carried, same(F.col("source"), F.col("_source")) & (F.col("part") == F.col("_part")))
    told = told.select("id", "source", "doc_tokens", "queue", (F.col("carried") + F.col("before")).alias("at"), "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in arrow_blocks(batch, "ids", 1 << 23):
                length = some.column("doc_tokens").to_numpy()
                doc, start, count, window, offset = place_pieces(
                    rounds, cuts, some.column("queue").to_numpy().astype(np.int64), some.column("at").to_numpy(), length
                )
                ids = some.column("ids").cast(pa.large_binary())
                begin = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset : ids.offset + len(ids)]
                lo = begin[doc] + 4 * start
                # Pieces of a document follow each other, as documents do: their bounds are the pieces'.
                bounds = np.append(lo, lo[-1] + 4 * count[-1])
                raw = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(bounds), ids.buffers()[2]])
                pick = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("id").take(pick), some.column("source").take(pick), pa.array(start), pa.array(count),
                        some.column("doc_tokens").take(pick), pa.array(window), pa.array(offset), raw.cast(pa.binary()),
                    ],
                    names=["id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    types = StructType.fromDDL("source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    found = told.mapInArrow(cut, StructType([told.schema["id"], *types.fields]))
    return found.withColumnsRenamed({"id": id, "source": source} if id != source else {"id": id})
