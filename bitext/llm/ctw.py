"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

Every byte is eight binary decisions, each with a tree of byte contexts of its own.  A node holds a
Krichevsky-Trofimov estimate; a parent weighs its own estimate against the product of its children, so that
all depths are mixed.  The counts come from all training texts.

Neither the counts nor the texts pass through one place: texts are packed into blocks, blocks send their
distinct contexts to buckets, buckets build their part of the trees, and answer with the code lengths asked for.
Only the upper trees (contexts of up to two bytes, at most 65,793 of them) are shared.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext.llm.common import Encoder, staged, text_blocks
from bitext.llm.jaccard import LOWER_BYTES, split_words

DEPTH = 5
UPPER_DEPTH = 2
END = 0xFF  # no byte of UTF-8
END_WORD = 0  # name of the end token; words have names above 0
BLOCK_CHARS = 5 << 20
REMEMBER = 150_000
U = np.uint64
STOP, GO = math.log(0.5), math.log(0.5)

_names: dict[bytes, int] = {}


# --- small parts -------------------------------------------------------------


def _half_gammas(size: int) -> np.ndarray:
    """ln(Γ(n + 1/2) / Γ(1/2)) for n below ``size``."""
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(size - 1) + 0.5))])


_TABLE = _half_gammas(1 << 14)
_FACTORIALS = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 1 << 14)))])


def _gamma(z: np.ndarray) -> np.ndarray:
    """ln Γ for large z, by Stirling's series."""
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3)


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""

    def half(n: np.ndarray) -> np.ndarray:
        return np.where(n < len(_TABLE), _TABLE[np.minimum(n, len(_TABLE) - 1)], _gamma(np.maximum(n, 1) + 0.5) - 0.5 * math.log(math.pi))

    total = zeros + ones
    factorial = np.where(total < len(_FACTORIALS), _FACTORIALS[np.minimum(total, len(_FACTORIALS) - 1)], _gamma(np.maximum(total, 1) + 1.0))
    return half(zeros) + half(ones) - factorial


def codes_of(text: bytes, depth: int = DEPTH) -> np.ndarray:
    """For each byte and the end: the ``depth`` bytes before it, the nearest lowest, and the byte itself below."""
    raw = np.frombuffer(bytes(depth) + text + bytes([END]), dtype=np.uint8).astype(np.uint64)
    n = len(text) + 1
    code = np.zeros(n, dtype=np.uint64)
    for k in range(depth + 1):
        code = (code << U(8)) | raw[k : k + n]
    return code


def bit_nodes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context, bits of the byte so far) and the next bit, eight of each per code, bit by bit."""
    symbol, context = codes & U(255), codes >> U(8) << U(8)
    keys, bits = [], []
    for k in range(8):
        keys.append(context | U(1 << k) | (symbol >> U(8 - k)))
        bits.append((symbol >> U(7 - k)) & U(1))
    return np.concatenate(keys), np.concatenate(bits).astype(np.int64)


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[begins], *[np.add.reduceat(v[order], begins) for v in values])


def parents(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys of nodes of contexts of ``depth`` bytes to those of one byte less."""
    return keys & U((1 << (8 * depth)) - 1)


Level = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # keys, zeros, ones, ln of the weighted probability


def leaves(codes: np.ndarray, counts: np.ndarray) -> Level:
    keys, bits = bit_nodes(codes)
    counts = np.tile(counts, 8)
    keys, zeros, ones = _sum_by(keys, counts * (1 - bits), counts * bits)
    return keys, zeros, ones, kt(zeros, ones)


def raise_level(level: Level, depth: int) -> Level:
    """The level above one of ``depth`` bytes: half its own estimate, half the product of its children."""
    keys, zeros, ones, weighted = level
    return weigh(*_sum_by(parents(keys, depth), zeros, ones, weighted))


def weigh(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> Level:
    return keys, zeros, ones, np.logaddexp(STOP + kt(zeros, ones), GO + below)


Mixed = tuple[np.ndarray, np.ndarray, np.ndarray]  # keys, mixed probability of a one so far, weight left for deeper nodes


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool))


def mix_down(level: Level, above: Mixed | None, depth: int, last: bool) -> Mixed:
    """Mix a level into what is mixed above it: the share of its own estimate is that in its weighted probability."""
    keys, zeros, ones, weighted = level
    one, left = np.zeros(len(keys)), np.ones(len(keys))
    if above is not None:
        at, _ = find(above[0], parents(keys, depth))
        one, left = above[1][at], above[2][at]
    share = np.ones(len(keys)) if last else np.exp(np.minimum(STOP + kt(zeros, ones) - weighted, 0.0))
    return keys, one + left * share * (ones + 0.5) / (zeros + ones + 1.0), left * (1 - share)


def code_lengths(codes: np.ndarray, mixed: list[Mixed], depth: int = DEPTH) -> np.ndarray:
    """Bits of each code; ``mixed[d]`` has the nodes with contexts of d bytes.  Below the deepest known node, bits are even."""
    keys, bits = bit_nodes(codes)
    one = np.full(len(keys), 0.5)
    open_ = np.arange(len(keys))
    for d in range(depth, -1, -1):
        known, told, left = mixed[d]
        at, hit = find(known, keys[open_] & U((1 << (8 * d + 8)) - 1))
        one[open_[hit]] = told[at[hit]] + left[at[hit]] * 0.5
        open_ = open_[~hit]
    chance = np.where(bits == 1, one, 1 - one)
    return -np.log2(np.maximum(chance, 1e-12)).reshape(8, -1).sum(0)


# --- blobs -------------------------------------------------------------------


def _pack(names: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted names and their counts; columns of differences compress well."""
    steps = np.diff(names, prepend=U(0))
    return zstandard.compress(np.uint64(len(names)).tobytes() + steps.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    n = int(raw[:8].view(np.uint64)[0])
    steps = np.ascontiguousarray(raw[8 : 8 + 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64), np.ascontiguousarray(raw[8 + 8 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def held_out(id_: int | None, fold: int, folds: int) -> bool:
    return zlib.crc32(str(id_).encode() if id_ is not None else b"") % folds == fold


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names * U(0x9E3779B97F4A7C15) >> U(33)) % U(buckets)).astype(np.int64)


def _code_bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Contexts with the same three nearest bytes share a bucket."""
    return _bucket((codes >> U(8)) & U((1 << 24) - 1), buckets)


def _word_names(texts: list[str | None]) -> list[np.ndarray]:
    if len(_names) > REMEMBER:
        _names.clear()
    split, new = [split_words(t) for t in texts], set()
    for words in split:
        new.update(words)
    for w in new.difference(_names):
        _names[w] = xxhash.xxh3_64_intdigest(w) or 1
    return [np.fromiter(map(_names.__getitem__, words), np.uint64, len(words)) for words in split]


def distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each occurs."""
    names = np.sort(names)
    if not len(names):
        return names, np.zeros(0, dtype=np.int64)
    begins = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    return names[begins], np.diff(begins, append=len(names))


def _counted(names: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names, sorted, and how often each occurs in the training part ``train``."""
    all_, _ = distinct(names)
    some, count = distinct(train)
    counts = np.zeros(len(all_), dtype=np.int64)
    counts[np.searchsorted(all_, some)] = count
    return all_, counts


def _texts(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _asked(table: pa.Table, depth: int, fold: int, folds: int, count: bool):
    """Of a block: which documents are held out, word names and codes, and the distinct ones with their training counts.

    Without ``count`` the counts are left out: the distinct names alone tell in which order answers come.
    """
    ids, texts = table["id"].to_pylist(), table["text"].to_pylist()
    out = np.array([held_out(i, fold, folds) for i in ids], dtype=bool)
    words = _word_names(texts)
    codes = [codes_of((t or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES), depth) for t in texts]
    empty = [np.zeros(0, dtype=np.uint64)]

    def counted(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        train = [x for x, o in zip(lists, out, strict=True) if not o] if count else []
        return _counted(np.concatenate(lists or empty), np.concatenate(train or empty))

    word_names, word_counts = counted(words)
    # The end of a text is a token of every document.
    word_names, word_counts = np.concatenate([[U(END_WORD)], word_names]), np.concatenate([[int((~out).sum())], word_counts])
    code_names, code_counts = counted(codes)
    return ids, out, words, codes, (word_names, word_counts), (code_names, code_counts)


# --- the job -----------------------------------------------------------------


def score_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", depth: int = DEPTH, fold: int = 2, folds: int = 7) -> DataFrame:
    """Per document: the id column, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Training texts are those whose crc32(identifier as text) modulo ``folds`` is not ``fold``.  ``score`` is the log10
    probability of the whole text, A-Z in lower case, with its end, under the trees of all training texts;
    base_score that of its words and one end under add-one word counts.  bits_per_byte counts the end as a byte.  A null
    text is empty: its end alone is scored.  A null identifier hashes like an empty one.  Repeated rows are
    documents of their own.  Other columns play no part.  An empty table gives an empty one; without training texts
    all bits are even.  Words are counted by 64-bit hashes.
    """
    spark = docs.sparkSession
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Encoder.forget()
        block = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            for part in text_blocks(batch.column("text").to_pylist(), BLOCK_CHARS):
                some = batch.slice(part.start, part.stop - part.start)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, some.schema, options=options) as out:
                    out.write_batch(some)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
                block += 1

    blocks = staged(rows.mapInArrow(to_blocks, "block long, data binary"), "blocks")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, data in zip(batch["block"], batch["data"], strict=True):
                *_, words, codes = _asked(_texts(data), depth, fold, folds, True)
                for kind, (names, counts), bucket in (("word", words, _bucket(words[0], buckets)), ("code", codes, _code_bucket(codes[0], buckets))):
                    order = np.argsort(bucket, kind="stable")
                    filled, many = distinct(bucket)
                    parts = np.split(order, np.cumsum(many)[:-1])
                    yield pd.DataFrame({"kind": kind, "bucket": filled, "block": block, "data": [_pack(names[p], counts[p]) for p in parts]})

    asked = staged(blocks.mapInPandas(ask, "kind string, bucket long, block long, data binary"), "asked")

    def count_words(group: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(d) for d in group["data"]]
        names, counts = _sum_by(np.concatenate([n for n, _ in parts]), np.concatenate([c for _, c in parts]))
        answers = [zstandard.compress(counts[np.searchsorted(names, n)].astype("<i8").tobytes(), 1) for n, _ in parts]
        return pd.DataFrame({
            "block": [*group["block"], -1], "kind": "word", "bucket": group["bucket"].iloc[0], "data": [*answers, None],
            "tokens": int(counts.sum()), "distinct": int((counts > 0).sum()),
        })

    reply = "block long, kind string, bucket long, data binary"
    words = staged(asked.where("kind = 'word'").groupBy("bucket").applyInPandas(count_words, reply + ", tokens long, distinct long"), "words")
    total = words.where("block < 0").agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()
    train_tokens, vocabulary = total["n"] or 0, total["v"] or 0

    def lower_levels(group: pd.DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[Level]]:
        parts = [_unpack(d) for d in group["data"]]
        codes, counts = _sum_by(np.concatenate([n for n, _ in parts]), np.concatenate([c for _, c in parts]))
        seen = counts > 0
        levels = [leaves(codes[seen], counts[seen])]
        for d in range(depth, UPPER_DEPTH + 1, -1):
            levels.append(raise_level(levels[-1], d))
        return parts, levels

    def upper_sums(group: pd.DataFrame) -> pd.DataFrame:
        keys, zeros, ones, weighted = lower_levels(group)[1][-1]
        keys, zeros, ones, weighted = _sum_by(parents(keys, UPPER_DEPTH + 1), zeros, ones, weighted)
        return pd.DataFrame({"key": keys.astype(np.int64), "zeros": zeros, "ones": ones, "below": weighted})

    codes = asked.where("kind = 'code'")
    # At most 65,536 contexts of two bytes with 255 bit nodes each come to the driver, however large the corpus.
    upper = (
        codes.groupBy("bucket").applyInPandas(upper_sums, "key long, zeros long, ones long, below double")
        .groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).orderBy("key").toPandas()
    )
    top = [weigh(upper["key"].to_numpy().astype(np.uint64), upper["zeros"].to_numpy(dtype=np.int64), upper["ones"].to_numpy(dtype=np.int64), upper["below"].to_numpy(dtype=float))]
    for d in range(UPPER_DEPTH, 0, -1):
        top.append(raise_level(top[-1], d))
    mixed: list[Mixed] = []
    for d, level in enumerate(reversed(top)):
        mixed.append(mix_down(level, mixed[-1] if mixed else None, d, False))
    shared = spark.sparkContext.broadcast(mixed)

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        parts, levels = lower_levels(group)
        own = list(shared.value)
        for d, level in enumerate(reversed(levels), UPPER_DEPTH + 1):
            own.append(mix_down(level, own[-1], d, d == depth))
        wanted, _ = distinct(np.concatenate([n for n, _ in parts]))
        lengths = code_lengths(wanted, own, depth)
        answers = [zstandard.compress(lengths[np.searchsorted(wanted, n)].astype("<f4").tobytes(), 1) for n, _ in parts]
        return pd.DataFrame({"block": group["block"], "kind": "code", "bucket": group["bucket"], "data": answers})

    answers = words.where("block >= 0").select("block", "kind", "bucket", "data").unionByName(codes.groupBy("bucket").applyInPandas(answer, reply))
    unknown = math.log10(train_tokens + vocabulary + 1)

    def score(block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        ids, out, words, codes, (names, _), (code_names, _) = _asked(_texts(block["data"].iloc[0]), depth, fold, folds, False)
        found = []
        for kind, own, bucket, form in (("word", names, _bucket(names, buckets), "<i8"), ("code", code_names, _code_bucket(code_names, buckets), "<f4")):
            values = np.zeros(len(own))
            for b, data in told.loc[told["kind"] == kind, ["bucket", "data"]].itertuples(index=False):
                values[bucket == b] = np.frombuffer(zstandard.decompress(data), form)
            found.append(values)
        counts, lengths = found
        logs, end = np.log10(counts + 1.0), np.array([END_WORD], dtype=np.uint64)
        rows = []
        for o, w, c in zip(out, words, codes, strict=True):
            at = np.searchsorted(names, np.concatenate([w, end]))
            some, repeat = distinct(c)
            bits = float((lengths[np.searchsorted(code_names, some)] * repeat).sum())
            rows.append((
                bool(o), len(at), int((counts[at] > 0).sum()), train_tokens, float(logs[at].sum()) - len(at) * unknown,
                -bits * math.log10(2), len(c) - 1, bits / len(c),
            ))
        result = pd.DataFrame(rows, columns=["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"])
        result.insert(0, "id", pd.array(ids, dtype="Int64"))
        return result

    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    )
    return scored.withColumnRenamed("id", id)
