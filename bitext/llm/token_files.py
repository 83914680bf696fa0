"""Token ids on disk: a zstandard frame per document under one shared dictionary, with an offset index.

A file is ``MAGIC``, the SHA-256 of the dictionary, the frames, the index and a footer; the index has
identifier, presence, frame offset and token count of each document, so that a short document is read
with two small reads.  Executors write through ``pyarrow.fs`` into a folder they all reach, under names of
their own; only the files of tasks that ended well are listed in ``parts``, which Spark commits.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitext.llm.common import Encoder, arrow_blocks

MAGIC = b"BTXIDS01"
FOOTER = "<QQ"  # where the index begins, how many documents
ENTRY = np.dtype([("id", "<i8"), ("known", "u1"), ("offset", "<u8"), ("tokens", "<u8")])
SAMPLE_CHARS = 4096
PARTS = "part int, file string, documents long, tokens long"
PART_TYPES = pa.schema([("part", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())])


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a folder as Spark names it."""
    if path.startswith("file:"):
        path = "file:///" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _frames(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def train_dictionary(
    docs: DataFrame, tokenizer: str, text: str, width: int, sample_docs: int = 2_000, size: int = 1 << 16
) -> bytes:
    """A dictionary from the serialized ids of ``sample_docs`` short, different texts, those of the least text hash.

    The dictionary is for short documents, so texts over ``SAMPLE_CHARS`` are no samples; copies are one sample.  The sample
    is bounded because zstandard uses a bounded one; all documents are written with the result.  Too few samples: no dictionary.
    """
    sample = docs.select(F.col(text).alias("text")).where(F.length("text").between(1, SAMPLE_CHARS))

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        samples = []
        for batch in batches:
            ids, bounds = Encoder.of(tokenizer).encode(batch["text"].tolist())
            ids = ids.astype(f"<u{width}")
            samples += [ids[lo:hi].tobytes() for lo, hi in itertools.pairwise(bounds.tolist())]
        try:
            found = zstandard.train_dictionary(size, samples).as_bytes() if len(samples) > 7 else b""
        except zstandard.ZstdError:  # too little to learn from
            found = b""
        yield pd.DataFrame({"dictionary": [found]})

    # Combined before the shuffle, so a group of copies is a row per task.
    hashes = sample.select(F.xxhash64("text").alias("hash")).distinct().orderBy("hash").limit(sample_docs)
    chosen = sample.join(F.broadcast(hashes), F.xxhash64("text") == F.col("hash")).select("text").distinct()
    found = chosen.coalesce(1).mapInPandas(train, "dictionary binary").first()
    return bytes(found["dictionary"]) if found else b""


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = 0, width: int = 2, level: int = 3
) -> None:
    """Write the ids of every whole text, ``end_id`` after each, in ascending order of ``id`` under ``path``.

    ``width`` is the bytes of a stored id (2 for vocabularies up to 65,536, else 4).  A null text is a document of
    one end id.  Null identifiers come first; rows with one identifier are kept all, by text hash; repeated rows
    are kept each.  Other columns play no part.  An empty table leaves an empty list of parts.
    """
    dictionary = train_dictionary(docs, tokenizer, text, width)
    system, folder = open_path(path)
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/dictionary") as out:
        out.write(dictionary)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    # Equal rows may fill many partitions: their place in the input breaks the tie.
    keys = ["id", F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions("id", F.xxhash64("text"))
    # Integers with nulls would become doubles.
    ordered = ordered.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("known"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_path(path)
        encoder, end = Encoder.of(tokenizer), np.array([end_id], dtype=f"<u{width}").tobytes()
        frames = _frames(dictionary)
        if frames:
            frames.precompute_compress(level=level)  # else every frame would digest the dictionary anew
        packer = zstandard.ZstdCompressor(level=level, dict_data=frames)
        name = f"ids-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, index, at, tokens = None, [], 0, 0
        for batch in batches:
            for some in arrow_blocks(batch, "text"):
                if out is None:
                    out = system.open_output_stream(f"{folder}/{name}")
                    at = out.write(MAGIC + hashlib.sha256(dictionary).digest() + struct.pack("<B", width))
                entries = np.zeros(len(some), dtype=ENTRY)
                entries["known"] = some.column("known").to_numpy(zero_copy_only=False)
                entries["id"] = some.column("id").to_numpy(zero_copy_only=False)
                ids, bounds = encoder.encode(some.column("text"))
                ids = ids.astype(f"<u{width}")
                entries["tokens"] = np.diff(bounds) + 1
                for k, (lo, hi) in enumerate(itertools.pairwise(bounds.tolist())):
                    entries["offset"][k] = at
                    at += out.write(packer.compress(ids[lo:hi].tobytes() + end))
                index.append(entries)
                tokens += int(entries["tokens"].sum())
        if out is not None:
            whole = np.concatenate(index)
            out.write(whole.tobytes() + struct.pack(FOOTER, at, len(whole)) + MAGIC)
            out.close()
            found = {"part": [TaskContext.get().partitionId()], "file": [name], "documents": [len(whole)], "tokens": [tokens]}
            yield pa.RecordBatch.from_pydict(found, schema=PART_TYPES)

    ordered.mapInArrow(write, PARTS).write.parquet(f"{path}/parts")


class TokenFile:
    """One written file: its index, and the ids of single documents."""

    def __init__(self, path: str, name: str):
        system, folder = open_path(path)
        self.file = system.open_input_file(f"{folder}/{name}")
        size, tail = self.file.size(), struct.calcsize(FOOTER) + len(MAGIC)
        end = self.file.read_at(tail, size - tail)
        head = self.file.read_at(len(MAGIC) + 33, 0)
        if end[-len(MAGIC):] != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{name} is no complete file of token ids.")
        self.index_at, count = struct.unpack(FOOTER, end[: -len(MAGIC)])
        self.index = np.frombuffer(self.file.read_at(count * ENTRY.itemsize, self.index_at), dtype=ENTRY)
        with system.open_input_stream(f"{folder}/dictionary") as source:
            dictionary = source.read()
        if hashlib.sha256(dictionary).digest() != head[len(MAGIC) : -1]:
            raise ValueError(f"{name} was written with another dictionary.")
        self.width = head[-1]
        self.unpacker = zstandard.ZstdDecompressor(dict_data=_frames(dictionary))

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the file, read on their own."""
        lo = int(self.index["offset"][k])
        hi = int(self.index["offset"][k + 1]) if k + 1 < len(self.index) else self.index_at
        raw = self.unpacker.decompress(self.file.read_at(hi - lo, lo))
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def parts(spark: SparkSession, path: str) -> DataFrame:
    """The files in order, with ``start``, the ids before each; one row per file."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    found = spark.read.schema(PARTS).parquet(f"{path}/parts")
    return found.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, path: str, id: str = "doc_id", digest: bool = False) -> DataFrame:
    """Per document: the id column, start (ids before it in all files), n_tokens, and ids, or their ids_crc32 for ``digest``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, start in zip(batch["file"], batch["start"], strict=True):
                file = TokenFile(path, name)
                starts = start + np.cumsum(file.index["tokens"]) - file.index["tokens"]
                for lo in range(0, len(file.index), 1024):
                    some = slice(lo, min(lo + 1024, len(file.index)))
                    ids = [file.ids(k) for k in range(some.start, some.stop)]
                    known = file.index["known"][some].astype(bool)
                    yield pd.DataFrame({
                        "id": pd.Series(file.index["id"][some]).astype("Int64").where(known),
                        "start": starts[some].astype("int64"), "n_tokens": file.index["tokens"][some].astype("int64"),
                        "ids": [zlib.crc32(x.tobytes()) if digest else x.astype(np.int32) for x in ids],
                    })

    files = parts(spark, path)
    tasks = max(1, files.count())
    types = f"id long, start long, n_tokens long, ids {'long' if digest else 'array<int>'}"
    found = files.select("file", "start").repartition(tasks).mapInPandas(read, types)
    return found.withColumnsRenamed({"id": id, "ids": "ids_crc32" if digest else "ids"})
