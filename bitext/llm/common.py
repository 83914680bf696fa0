"""What several operators share: written tables, running sums in order, word counts, token ids.

A table that is read more than once is written to the folder that the cluster
names in ``spark.checkpoint.dir`` and read back, so that a lost executor never
costs the work before it.  Those tables go when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import itertools
import json
import os
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitext.plans.lineage import checkpoint_folder

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNSIGNED = 1 << 32


_scratch: list[list[str]] = []  # folders of the scopes that are open


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of this driver."""
    with contextlib.suppress(Exception):  # the session may be gone already
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared checkpoint folder; deleted when the driver ends, or before with its scope."""
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    if _scratch:
        _scratch[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope whose staged tables are deleted at its end: write what comes out of it inside."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            delete(spark, path)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` computed once, written as columns into the shared folder, and read back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(left: Column, right: Column) -> Column:
    """Equality under which null equals null."""
    return left.eqNullSafe(right)


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: dict[str, Column], name: str = "running"
) -> DataFrame:
    """Add, per key and in ``order``, the sums of values over the rows *before* each row.

    The rows are cut by range of (keys, order), so a key with a third of all
    rows spreads over many tasks.  Only a part's first group can have begun in
    an earlier part; hence what is carried across the cuts is one row per part
    at most, the only thing that is broadcast.  Names starting with ``_run``
    are this function's own.
    """
    keys, order = list(keys), list(order)
    cut = df.repartitionByRange(*keys, *order).withColumn("_run_part", F.spark_partition_id())
    rows = staged(cut, name)
    inside = Window.partitionBy("_run_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_run_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy("_run_part", *keys)
        .agg(*[F.sum(v).alias(f"_run_{n}") for n, v in totals.items()])
        .select(
            F.col("_run_part").alias("_run_at"),
            *[F.col(k).alias(f"_run_k{i}") for i, k in enumerate(keys)],
            F.count(F.lit(1)).over(earlier).alias("_run_seen"),
            *[F.sum(f"_run_{n}").over(earlier).alias(f"_run_{n}") for n in totals],
        )
        .where("_run_seen > 0")
    )
    on = F.col("_run_part") == F.col("_run_at")
    for i, k in enumerate(keys):
        on = on & same(F.col(k), F.col(f"_run_k{i}"))
    zero = F.lit(0)
    return (
        rows.select("*", *[F.coalesce(F.sum(v).over(inside), zero).alias(f"_run_in_{n}") for n, v in totals.items()])
        .join(F.broadcast(carried), on, "left")
        .select(
            *df.columns,
            *[(F.col(f"_run_in_{n}") + F.coalesce(F.col(f"_run_{n}"), zero)).alias(n) for n in totals],
        )
    )


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def without(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The columns of ``df`` that do not clash with the result columns ``names``."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


# --- token ids ---------------------------------------------------------------

# Classes of bytes for the cuts: ASCII letters, digits, marks, white space but the blank; others are left alone.
_LETTER, _DIGIT, _MARK, _WHITE, _BLANK = 1, 2, 4, 8, 16
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x09:0x0E] = _WHITE
_CLASS[0x20] = _BLANK
#: Bytes that surely open no white space.
_WORD_OPENS = np.ones(256, dtype=bool)
_WORD_OPENS[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0xC2, 0xE1, 0xE2, 0xE3]] = False


def _piece_starts(data: np.ndarray) -> np.ndarray:
    """Marks bytes before which the pre-tokenizer cuts in any case, also when the two sides are looked at alone.

    That is: a blank that opens a word; white space other than a blank, and what follows it, before a word; the end of
    letters before another ASCII byte; the end of digits before a blank, mark or letter; the end of marks, but the
    apostrophe, before a blank, digit or letter.  Accented Latin letters are letters, where both their bytes are at hand.
    """
    kind = _CLASS[data]
    accented = (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7) & (data[:-1] == 0xC3)
    kind[1:][accented] = _LETTER
    left, right, opens = kind[:-1], kind[1:], _WORD_OPENS[data[1:]]
    starts = np.zeros(len(data), dtype=bool)
    starts[:-1] = (kind[:-1] & (_BLANK | _WHITE) != 0) & opens
    lone = (left == _WHITE) & opens
    after = lone | ((left == _LETTER) & (right & (_DIGIT | _MARK | _WHITE | _BLANK) != 0)) | ((left == _DIGIT) & (right & (_LETTER | _MARK | _WHITE | _BLANK) != 0))
    after |= (left == _MARK) & (data[:-1] != 0x27) & (right & (_LETTER | _DIGIT | _WHITE | _BLANK) != 0)
    # The second byte of an accented letter opens nothing.
    starts[1:] |= after & (data[1:] < 0x80)
    return starts


PIECES_AT_ONCE = 1 << 20


class Encoder:
    """A byte-level BPE file of the ``tokenizers`` library; every distinct piece is encoded once while it is remembered.

    Texts are cut before a blank that opens a word, where the pre-tokenizer cuts anyway, so the ids of a text are those
    of its pieces in a row.  Cutting, counting pieces as distinct and putting ids together run over the bytes of a whole
    block of texts.  A text that holds one of the tokenizer's added strings is one piece, and so is every text of a
    tokenizer that normalizes or does not work on bytes.  ``remember`` and ``held`` bound the pieces and bytes kept.
    """

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str, remember: int = 500_000, held: int = 1 << 26):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        self.cuts = (
            kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space", True)
            and self.tokenizer.normalizer is None and self.tokenizer.post_processor is None and self.tokenizer.truncation is None
        )
        # Signs that stand for bytes in the vocabulary: printable ones for themselves, the others from 256 on in order.
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.signs = {b: 0x100 + k for k, b in enumerate(sorted(set(range(256)) - printable))}
        self.blank = chr(self.signs[0x20])
        self.remember, self.held = remember, held
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes = 0
        self.first = np.zeros(0, dtype=np.int64)  # where the ids of a known piece begin in flat
        self.count = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of this Python worker for a tokenizer file."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    @classmethod
    def forget(cls) -> None:
        """Free what this Python worker, which Spark uses again for other operators, remembers of pieces."""
        cls._open.clear()

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and the ids in a row.

        A word, with or without a blank before it, is one piece to the pre-tokenizer too: the merges alone give its ids.
        """
        found: list[list[int]] = [[]] * len(pieces)
        others = []
        merge = self.tokenizer.model.tokenize
        for k, piece in enumerate(pieces):
            if self.cuts and piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
                signs = piece.replace(" ", self.blank) if piece.isascii() else piece.encode().decode("latin-1").translate(self.signs)
                found[k] = [t.id for t in merge(signs)]
            else:
                others.append(k)
        for lo in range(0, len(others), 4096):
            some = others[lo : lo + 4096]
            for k, e in zip(some, self.tokenizer.encode_batch_fast([pieces[k] for k in some], add_special_tokens=False), strict=True):
                found[k] = e.ids
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return counts, np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32, count=int(counts.sum()))

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Numbers of the pieces in ``first`` and ``count``; new ones are encoded."""
        if len(self.known) > self.remember or self.bytes > self.held:
            self._clear()
        found = list(map(self.known.get, pieces))
        new = [piece for piece, at in zip(pieces, found, strict=True) if at is None]
        if new:
            counts, ids = self._encode_pieces(new)
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.flat = np.concatenate([self.flat, ids])
            self.bytes += sum(map(len, new))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            found = list(map(self.known.__getitem__, pieces))
        return np.array(found, dtype=np.int64)

    def encode(self, texts: pa.Array | Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row as unsigned 32-bit integers, and n + 1 bounds of the texts in them; null like an empty text."""
        texts = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        _, bounds, data = texts.buffers()
        bounds = np.frombuffer(bounds, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, dtype=np.uint8)
        bounds = bounds - bounds[0]
        some = bounds[1:] > bounds[:-1]
        opens = np.zeros(len(data) + 1, dtype=bool)
        if self.cuts:
            opens[:-1] = _piece_starts(data)
            # White space at the end of a text stands before no word.
            last = bounds[1:][some] - 1
            opens[last[_CLASS[data[last]] & (_BLANK | _WHITE) != 0]] = False
            for added in self.added:
                for t in np.flatnonzero(pc.match_substring(texts, added).to_numpy(zero_copy_only=False)):
                    opens[bounds[t] : bounds[t + 1]] = False
        opens[bounds[:-1][some]] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(data))
        before, ids, total = np.zeros(len(starts) + 1, dtype=np.int64), [], 0
        for lo in range(0, len(starts), PIECES_AT_ONCE):
            part = slice(lo, lo + PIECES_AT_ONCE)
            at = np.append(starts[part], ends[part][-1]) - starts[lo]
            raw = pa.py_buffer(data[starts[lo] : ends[part][-1]])
            coded = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), raw]).dictionary_encode()
            place = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            count = self.count[place]
            upto = np.cumsum(count)
            ids.append(self.flat[np.repeat(self.first[place] - upto + count, count) + np.arange(upto[-1])])
            before[lo + 1 : lo + 1 + len(count)] = total + upto
            total += int(upto[-1])
        return np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32), before[np.searchsorted(starts, bounds)]


def arrow_blocks(batch: pa.RecordBatch, column: str, size: int = 1 << 22) -> Iterable[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of a text column each, so that memory does not follow the batch."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(lengths) - lengths) // size
    bounds = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(lengths)]
    for lo, hi in itertools.pairwise(bounds):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def text_blocks(texts: Sequence[str | None], size: int = 1 << 20) -> Iterable[slice]:
    """Slices of a batch with about ``size`` characters each, so that memory does not follow the batch."""
    lo = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= size:
            yield slice(lo, i + 1)
            lo, held = i + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))
