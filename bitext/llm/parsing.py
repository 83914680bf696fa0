"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing labels the symbols of a text by how they differ from their left
neighbour; symbols whose label exceeds both neighbours' open a phrase, and a phrase's name is a hash of what
it holds.  Whether a phrase opens depends on a few symbols around it, so equal substrings are cut alike
inside, wherever they stand.  Phrases of phrases give a hierarchy; the names of one level are
sketched by one-permutation minimum hashing.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext.llm.common import staged, text_blocks

LEVELS = 3  # phrases of the third level hold some 25 bytes
BINS = 64
U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_POWER = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(256)], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * _M1
    h = (h ^ (h >> U(27))) * _M2
    return h ^ (h >> U(31))


_BYTE_NAMES = _mix(np.arange(1, 257, dtype=np.uint64) * _POWER[0])
_LOW_BIT = np.array([(b & -b).bit_length() - 1 if b else 8 for b in range(256)], dtype=np.uint8)


def _toss(symbols: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Twice the place of the lowest bit in which a symbol differs from its left neighbour, plus its value there."""
    other = np.empty_like(symbols)
    other[1:] = symbols[:-1]
    other[opens] = ~U(0) if symbols.dtype == np.uint64 else 255
    differ = symbols ^ other
    if symbols.dtype == np.uint64:
        place = np.bitwise_count((differ & (~differ + U(1))) - U(1)).astype(np.uint8)
        return (place << 1) | ((symbols >> np.minimum(place, 63).astype(np.uint64)) & U(1)).astype(np.uint8)
    place = _LOW_BIT[differ]
    return (place << 1) | ((symbols >> np.minimum(place, 7)) & 1)


def parse(symbols: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: symbols (bytes or names) of many texts, and where texts open, to phrase names and where texts open.

    Runs of one symbol count as one symbol with its length, so that neighbours differ.
    """
    first = np.zeros(len(symbols), dtype=bool)
    first[opens] = True
    new = np.empty(len(symbols), dtype=bool)
    new[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new |= first
    at = np.flatnonzero(new)
    names = symbols[at] if symbols.dtype == np.uint64 else _BYTE_NAMES[symbols[at]]
    length = np.diff(at, append=len(symbols))
    long = np.flatnonzero(length > 1)
    names[long] = _mix(names[long] + length[long].astype(np.uint64) * _POWER[7])
    start = first[at]
    opens = np.flatnonzero(start)
    labels = names
    for _ in range(4):
        labels = _toss(labels, opens)
    peak = np.zeros(len(labels), dtype=bool)
    peak[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    peak[opens[1:] - 1] = False  # the last symbol of a text opens nothing
    peak[opens] = True
    begins = np.flatnonzero(peak)
    place = np.arange(len(names)) - np.repeat(begins, np.diff(begins, append=len(names)))
    phrases = _mix(np.add.reduceat(names * _POWER[place & 255], begins))
    return phrases, np.searchsorted(begins, opens)


def phrases(texts: list[bytes], levels: int = LEVELS) -> list[np.ndarray]:
    """Phrase names of the last level, for each text; an empty text has none."""
    filled = [k for k, t in enumerate(texts) if t]
    out = [np.zeros(0, dtype=np.uint64)] * len(texts)
    if not filled:
        return out
    symbols = np.frombuffer(b"".join(texts), dtype=np.uint8)
    opens = np.concatenate([[0], np.cumsum([len(texts[k]) for k in filled])[:-1]]).astype(np.int64)
    for _ in range(levels):
        symbols, opens = parse(symbols, opens)
    for k, part in zip(filled, np.split(symbols, opens[1:]), strict=True):
        out[k] = part
    return out


def sketches(texts: list[str | None]) -> np.ndarray:
    """A row of ``BINS`` 16-bit minima per text; 0 is a bin without phrase, all of them for an empty text."""
    names = phrases([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    flat = np.concatenate([np.zeros(0, dtype=np.uint64), *names])
    out = np.zeros(len(texts) * BINS, dtype=np.uint16)
    if len(flat):
        hashed = _mix(flat + _POWER[3])
        slot = np.repeat(np.arange(len(texts)), [len(n) for n in names]) * BINS + (hashed % U(BINS)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot, hashed = slot[order], hashed[order]
        begins = np.flatnonzero(np.diff(slot, prepend=-1))
        # The upper bits of a minimum over many phrases are all zero: 16 bits of it are taken once it is mixed again.
        least = _mix(np.minimum.reduceat(hashed, begins) + _POWER[4])
        out[slot[begins]] = np.maximum(least >> U(48), U(1)).astype(np.uint16)
    return out.reshape(len(texts), BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of phrases in common, of the mean of both texts' phrases; two texts without phrases are alike, 1.0."""
    used = ((a > 0) | (b > 0)).sum(1)
    hits = ((a == b) & (a > 0)).sum(1)
    # Bins agree as often as the intersection fills the union.
    return np.where(used == 0, 1.0, 2 * hits / np.maximum(used + hits, 1))


def to_text(sketch: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in sketch]


def from_text(fingerprints: list[str]) -> np.ndarray:
    return np.array([np.frombuffer(bytes.fromhex(f), ">u2") for f in fingerprints]).astype(np.uint16).reshape(-1, BINS)


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """The rows of ``docs`` with the fingerprint of the whole text, null like an empty one; a column ``out`` gives way."""

    @F.pandas_udf("string")
    def mark(texts: pd.Series) -> pd.Series:
        found: list[str] = []
        for part in text_blocks(texts.tolist()):
            found += to_text(sketches(texts.iloc[part].tolist()))
        return pd.Series(found)

    return docs.withColumn(out, mark(text))


def likeness_column(left: str, right: str):
    """Likeness of two fingerprint columns as a column."""

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(likeness(from_text(a.tolist()), from_text(b.tolist())))

    return alike(left, right)


def edited_pairs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of texts, of their edited texts, and how alike they are to these and to the next document.

    Next is the next lower identifier (null last, equal identifiers by text hash), after the last the first; the edited
    text has its last floor(n/2) code points replaced by as many first ones of the next text, or all it has.
    Null texts are empty; repeated rows follow each other.  One document is its own next one.  An empty table gives
    an empty one.  Texts move once, to the part of the order they are in; the first of a part also goes to the part before.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc_nulls_last("id"), F.asc("tie")]
    placed = staged(rows.select("id", "tie").repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "order")
    # One head per part comes to the driver.
    rank = F.struct(F.col("id").isNull().alias("last"), (-F.coalesce("id", F.lit(0))).alias("down"), "tie")
    heads = sorted(tuple(r["head"]) for r in placed.groupBy("part").agg(F.min(rank).alias("head")).collect())
    heads = sorted(set(heads))

    @F.pandas_udf("array<int>")
    def to_parts(last: pd.Series, down: pd.Series, tie: pd.Series) -> pd.Series:
        out = []
        for key in zip(last.tolist(), down.tolist(), tie.tolist(), strict=True):
            at = bisect_right(heads, key) - 1
            out.append([at, (at - 1) % len(heads)] if heads[at] == key else [at])
        return pd.Series(out)

    ranked = rows.select("id", "text", rank.alias("k"))
    sent = ranked.select("id", "text", "k", F.posexplode(to_parts("k.last", "k.down", "k.tie")).alias("guest", "part"))
    dealt = sent.repartition(parts, "part").sortWithinPartitions("part", "guest", "k")

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row whose next one is still to come
        for batch in batches:
            for part in text_blocks(batch["text"].tolist()):
                rows = batch.iloc[part] if held is None else pd.concat([held, batch.iloc[part]])
                held = rows.iloc[-1:]
                texts, guest = rows["text"].tolist(), rows["guest"].to_numpy()
                own = sketches(texts)
                # A row pairs with its follower; guests only follow.
                use = np.flatnonzero(guest[:-1] == 0)
                if not len(use):
                    continue
                edited = []
                for k in use:
                    half = len(texts[k]) // 2
                    edited.append(texts[k][: len(texts[k]) - half] + texts[k + 1][:half])
                changed = sketches(edited)
                yield pd.DataFrame({
                    "id": rows["id"].iloc[use].to_numpy(),
                    "n_chars": [len(texts[k]) for k in use],
                    "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                    "fingerprint": to_text(own[use]), "edited_fingerprint": to_text(changed),
                    "near_edited": likeness(own[use], changed), "near_next": likeness(own[use], own[use + 1]),
                })

    # Identifiers travel as text: integers with nulls would become doubles.
    return dealt.select(F.col("id").cast("string").alias("id"), "text", "guest").mapInPandas(
        mark, "id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ).withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", id)
