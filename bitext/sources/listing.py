"""What lies below a folder, as a data source whose partitions are folders, in batch and on streams.

``format("bitext_files")`` lists files below ``root``: unit (the folder right below the root, empty for files of the root
itself), path (relative to the root), size, modified_at.  Every name counts, also hidden ones; symbolic links are passed over.
The driver lists folders only until it has enough of them for the tasks; each task walks its folders to the end.

As a stream, a micro-batch holds whole listings of the units in which anything was changed since the last one.
Its offsets are times, so that a repeated micro-batch asks for the same span.
"""

from __future__ import annotations

import io
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from bitext.sources.paths import open_path, qualified

FILES = "unit string, path string, size long, modified_at long"
FILE_TYPES = pa.schema([("unit", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("modified_at", pa.int64())])
FOLDERS = 64  # how many folders the driver looks for
RANGE_BYTES = 64 << 20


@dataclass
class Folders(InputPartition):
    """Folders of one task, relative to the root; ``deep`` are walked to the end, of ``flat`` only the files count."""

    deep: list[str]
    flat: list[str]


def _entries(system: fs.FileSystem, root: str, folder: str) -> list[fs.FileInfo]:
    """What is in a folder; one that is gone by now is empty."""
    found = system.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/"), allow_not_found=True))
    local = isinstance(system, fs.LocalFileSystem)
    return sorted((e for e in found if not (local and os.path.islink(e.path))), key=lambda e: e.path)


def _rows(files: list[tuple[str, fs.FileInfo]]) -> pa.RecordBatch:
    """Rows of (path relative to the root, file)."""
    return pa.RecordBatch.from_pydict({
        "unit": [path.partition("/")[0] if "/" in path else "" for path, _ in files], "path": [path for path, _ in files],
        "size": [info.size or 0 for _, info in files], "modified_at": [int((info.mtime_ns or 0) // 10**9) for _, info in files],
    }, schema=FILE_TYPES)


def _walk(system: fs.FileSystem, root: str, folders: list[str]) -> Iterator[tuple[str, fs.FileInfo]]:
    """Files and folders below folders, with their paths relative to the root."""
    left = list(folders)
    while left:
        folder = left.pop()
        for info in _entries(system, root, folder):
            path = f"{folder}/{info.base_name}".lstrip("/")
            yield path, info
            if info.type == fs.FileType.Directory:
                left.append(path)


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bitext_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> FilesReader:
        return FilesReader(self.options["root"], int(self.options.get("folders", FOLDERS)))

    def streamReader(self, schema: StructType) -> ChangedUnits:
        return ChangedUnits(self.options["root"], int(self.options.get("settle_ms", 1000)))


class FilesReader(DataSourceReader):
    def __init__(self, root: str, folders: int):
        self.root, self.folders = root, folders

    def partitions(self) -> list[Folders]:
        """Folders are opened level by level until there are enough of them; what is open lists its own files."""
        system, root = open_path(self.root)
        flat, deep = [], [""]
        while deep and len(deep) < self.folders and len(flat) < 4 * self.folders:
            folder = deep.pop(0)
            flat.append(folder)
            deep += [f"{folder}/{e.base_name}".lstrip("/") for e in _entries(system, root, folder) if e.type == fs.FileType.Directory]
        tasks = min(max(len(deep), 1), 4 * self.folders)
        return [Folders(deep[k::tasks], flat[k::tasks]) for k in range(tasks)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        system, root = open_path(self.root)
        files: list[tuple[str, fs.FileInfo]] = []
        for folder in partition.flat:
            files += [(f"{folder}/{e.base_name}".lstrip("/"), e) for e in _entries(system, root, folder) if e.type == fs.FileType.File]
        for path, info in _walk(system, root, partition.deep):
            if info.type == fs.FileType.File:
                files.append((path, info))
            if len(files) >= 4096:
                yield _rows(files)
                files = []
        yield _rows(files)


@dataclass
class Span(InputPartition):
    """A unit, and the span of time in nanoseconds in which a change counts."""

    unit: str
    after: int
    upto: int


class ChangedUnits(DataSourceStreamReader):
    """Units with a file or folder changed after the last offset; ``settle_ms`` lets a folder that is being written rest."""

    def __init__(self, root: str, settle_ms: int):
        self.root, self.settle_ms = root, settle_ms

    def initialOffset(self) -> dict:
        return {"upto": 0}

    def latestOffset(self) -> dict:
        return {"upto": time.time_ns() - self.settle_ms * 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        system, root = open_path(self.root)
        units = [e.base_name for e in _entries(system, root, "") if e.type == fs.FileType.Directory]
        return [Span(unit, start["upto"], end["upto"]) for unit in units]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        system, root = open_path(self.root)
        top = system.get_file_info(f"{root}/{partition.unit}")
        found = [] if top.type == fs.FileType.NotFound else [("", top), *_walk(system, root, [partition.unit])]
        # A file that went leaves its folder changed.
        if any(partition.after < (info.mtime_ns or 0) <= partition.upto for _, info in found):
            yield _rows([(path, info) for path, info in found if info.type == fs.FileType.File])


def list_files(spark: SparkSession, root: str, folders: int = FOLDERS) -> DataFrame:
    """Rows of ``FILES`` for every file below ``root``; a missing folder has none."""
    spark.dataSource.register(FilesSource)
    return spark.read.format("bitext_files").options(root=qualified(spark, root), folders=folders).load()


def stream_changed_units(spark: SparkSession, root: str, settle_ms: int = 1000) -> DataFrame:
    """Whole listings (rows of ``FILES``) of the folders right below ``root`` in which something has changed."""
    spark.dataSource.register(FilesSource)
    return spark.readStream.format("bitext_files").options(root=qualified(spark, root), settle_ms=settle_ms).load()


def read_lines(files: DataFrame, root: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines of text files by ranges of bytes: path, start (where a line begins, in bytes), line.

    ``files`` has path and size.  A range holds the lines that begin in it, so a file of any size is read by as many tasks as it
    has ranges.  Lines end with a line feed, which is not part of them, nor is a carriage return before it.
    """
    spark = files.sparkSession
    top = qualified(spark, root)
    ranges = files.where("size > 0").select(
        "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_path(top)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with io.BufferedReader(system.open_input_file(f"{folder}/{path}"), 1 << 16) as source:
                    at = start
                    if start:
                        # The line that is under way belongs to the range before.
                        source.seek(start - 1)
                        at = start - 1 + len(source.readline())
                    paths, places, lines, held = [], [], [], 0
                    while at < start + range_bytes and (line := source.readline()):
                        paths.append(path)
                        places.append(at)
                        lines.append(line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace"))
                        at += len(line)
                        held += len(line)
                        if held >= 1 << 22:
                            yield pa.RecordBatch.from_pydict({"path": paths, "start": places, "line": lines})
                            paths, places, lines, held = [], [], [], 0
                    if lines:
                        yield pa.RecordBatch.from_pydict({"path": paths, "start": places, "line": lines})

    return ranges.repartition("path", "start").mapInArrow(read, "path string, start long, line string")


def read_whole(files: DataFrame, root: str) -> DataFrame:
    """``files`` (path, size) with text, the content of each; bytes that are no UTF-8 are replaced."""
    spark = files.sparkSession
    top = qualified(spark, root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_path(top)
        for batch in batches:
            for row in range(len(batch)):
                one = batch.slice(row, 1)
                with system.open_input_stream(f"{folder}/{one.column('path')[0].as_py()}") as source:
                    text = source.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([text])], names=[*one.schema.names, "text"])

    return files.select("path", "size").repartition("path").mapInArrow(read, "path string, size long, text string")


def parse_json_files(files: DataFrame, root: str, schema: str) -> DataFrame:
    """Path and value of JSON files, one value each; a broken file has a null value."""
    return read_whole(files, root).select("path", F.from_json("text", schema, {"mode": "PERMISSIVE"}).alias("value"))


def write_files(rows: DataFrame, root: str) -> None:
    """Files from rows (path, text), written by tasks; a path written before is replaced."""
    top = qualified(rows.sparkSession, root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_path(top)
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                place = f"{folder}/{path}"
                system.create_dir(place.rpartition("/")[0], recursive=True)
                with system.open_output_stream(place) as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_pydict({"n": [len(batch)]})

    rows.select("path", "text").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
