"""Periodic runs of words by an online sparse diagonal DP.

Two equal words at a distance are a match on the diagonal of that lag; the length of the matches in a
row on a diagonal is the length of the repeat less the period.  Going over the words, every active lag either counts
the next match or ends, and a diagonal that ends long enough emits its run at once.

What keeps it sparse is which earlier occurrences may open a lag.  In a run of period q that holds q four times, the nearest
earlier occurrence of the words around a place, taken at least q at a time, is q words back: a nearer one would make the
period smaller (Fine and Wilf).  So for each power of two only the nearest earlier occurrence of that many
words is asked, and it may open lags between half as many and as many; a repeated lag, or a multiple of the
period, opens nothing.  Texts without such an occurrence, nearly all, need no pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bitext.llm.common import arrow_blocks, without

TIMES, LEAST = 4, 6  # a run holds its period four times, and six words
RUN = "struct<start:long,length:long,period:long>"
RESULT = ["n_words", "runs", "longest", "collapsed"]
BLOCK_BYTES = 1 << 21
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def openings(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags at which diagonals open, sorted by place.

    ``words`` numbers the words of many texts in a row, equal ones alike, and ``bounds`` says where texts begin and end.  At
    the place the text repeats what stands the lag before, for as many words as twice the lag rounded down to a power of two.
    """
    places, lags = [], []
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][text]
    names = _mix(words.astype(np.uint64) * _A + text.astype(np.uint64) + np.uint64(1))
    # Where ``width`` words begin inside a text that holds four periods, and their names.
    at, width = np.flatnonzero(end - bounds[:-1][text] >= LEAST), 1
    names = names[at]
    while True:
        # Names of twice as many words; they are held at the places that have so many before them in the same text.
        whole = np.full(len(words), 0, dtype=np.uint64)
        whole[at] = names
        long = (at + 2 * width <= end[at]) & ((end - bounds[:-1][text])[at] >= max(LEAST, TIMES * width))
        at, left = at[long], names[long]
        if not len(at):
            break
        names = _mix(left * _A + whole[at + width] + np.uint64(width))
        width *= 2
        order = np.argsort(names, kind="stable")
        again = np.flatnonzero(names[order[1:]] == names[order[:-1]])
        here, before = at[order[again + 1]], at[order[again]]
        lag = here - before
        fits = (lag >= width // 2) & (lag < width)
        places.append(here[fits])
        lags.append(lag[fits])
        # A text in which so many words never come again has no longer ones that do.
        goes_on = np.zeros(len(bounds) - 1, dtype=bool)
        goes_on[text[here]] = True
        keep = goes_on[text[at]]
        at, names = at[keep], names[keep]
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    places, lags = np.concatenate(places), np.concatenate(lags)
    order = np.lexsort((lags, places))
    return places[order], lags[order]


def runs_of(words: list[int], opened: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of one text, sorted; ``opened`` are its openings (place, lag) by place."""
    runs, active = [], {}  # active: lag to the place where its matches in a row began
    n, k, i = len(words), 0, 0
    while k < len(opened) or active:
        if not active:
            i = opened[k][0]
        while k < len(opened) and opened[k][0] == i:
            lag = opened[k][1]
            k += 1
            if lag not in active:
                # The matches before the opening, where a nearer occurrence hid the lag.
                first = i
                while first > lag and words[first - 1] == words[first - 1 - lag]:
                    first -= 1
                active[lag] = first
        for lag in [lag for lag in active if i == n or words[i] != words[i - lag]]:
            start = active.pop(lag) - lag
            if i - start >= max(LEAST, TIMES * lag):
                runs.append((start, i - start, lag))
        i += 1
    return sorted(runs)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when every run keeps its first period only."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and the n + 1 bounds of the texts in them."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = lists.flatten()
    full = pc.not_equal(pc.binary_length(words), 0)
    sizes = np.diff(lists.offsets.to_numpy())
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(sizes)
    return words.filter(full), np.concatenate([[0], before[ends]]).astype(np.int64)


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without the text, with n_words, runs, longest and collapsed.

    Words are what stands between ASCII white space, numbered from 0.  A run is a stretch of words with smallest period q, at least six
    words and 4 q long, that no neighbouring word extends keeping the period.  ``runs`` holds (start, length, period), sorted;
    ``longest`` is the longest of them (ties: the smallest start, then period), null without runs.  ``collapsed`` is the text
    without the words that any run holds after its first period, joined by blanks.

    A null text is one without words; like a text of white space it has no runs and collapses to the empty text.  Texts
    count each on their own: repeated rows, null or equal identifiers change nothing.  An empty table gives an empty one; other
    columns come along, those named like a result column give way.  A text is the unit of work: it is held by one task.
    """
    kept = [c for c in without(docs, RESULT) if c.lower() != text.lower()]
    rows = docs.select(F.struct(*kept).alias("row") if kept else F.lit(None).cast("int").alias("row"), F.col(text).alias("text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in arrow_blocks(batch, "text", BLOCK_BYTES):
                words, bounds = _split(some.column("text"))
                codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
                places, lags = openings(codes, bounds)
                runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(some))]
                stays = np.ones(len(codes), dtype=bool)
                owner = np.searchsorted(bounds, places, "right") - 1
                cuts = np.searchsorted(owner, np.arange(len(some) + 1))
                for t in np.unique(owner).tolist():
                    lo, hi, mine = int(bounds[t]), int(bounds[t + 1]), slice(cuts[t], cuts[t + 1])
                    opened = list(zip((places[mine] - lo).tolist(), lags[mine].tolist(), strict=True))
                    runs[t] = runs_of(codes[lo:hi].tolist(), opened)
                    stays[lo:hi] = kept_words(hi - lo, runs[t])
                upto = np.concatenate([[0], np.cumsum(stays)])[bounds]
                left = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), words.filter(pa.array(stays)))
                collapsed = pc.binary_join(left, pa.scalar(" ", pa.large_string()))
                longest = [min(r, key=lambda x: (-x[1], x[0], x[2])) if r else None for r in runs]
                fields = ("start", "length", "period")
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("row"), pa.array(np.diff(bounds)),
                        pa.array([[dict(zip(fields, x, strict=True)) for x in r] for r in runs], pa.list_(run)),
                        pa.array([dict(zip(fields, x, strict=True)) if x else None for x in longest], run), collapsed.cast(pa.string()),
                    ],
                    names=["row", *RESULT],
                )

    types = StructType.fromDDL(f"n_words long, runs array<{RUN}>, longest {RUN}, collapsed string")
    found = rows.mapInArrow(find, StructType([rows.schema["row"], *types.fields]))
    return found.select(*(["row.*"] if kept else []), *RESULT)
