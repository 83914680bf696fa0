"""Tables in versions: readers see all of a write or nothing of it.

A store is a folder of Parquet files that never change, and of versions: small JSON files, each with the files of every
table, by bucket.  Tasks write files under names of their own through a data source writer; its commit notes the
files of one table, and only when all tables of a write are noted does the next version name them, by one rename that fails
where another writer was faster.  Whatever is lost before that leaves the last version as it is; files no version
names are removed by ``vacuum``.  A version also carries the ledger of batches that have been written.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from bitext.plans.lineage import cut
from bitext.sources.paths import open_path, qualified

BUCKET = "_bucket"
VERSION = "{:012d}.json"


class Conflict(RuntimeError):
    """Another writer published a version since this write began."""


@dataclass
class Written(WriterCommitMessage):
    """The files of one task: name, bucket, rows."""

    files: list[tuple[str, int, int]]


class StoreSource(DataSource):
    """``format("bitext_store")``: writes the files of one table of a write, of which no reader knows before it is published."""

    @classmethod
    def name(cls) -> str:
        return "bitext_store"

    def writer(self, schema: StructType, overwrite: bool) -> StoreWriter:
        return StoreWriter(self.options["root"], self.options["table"], self.options["run"], schema.json())


class StoreWriter(DataSourceArrowWriter):
    """Rows that come sorted by bucket to a file per task and bucket."""

    def __init__(self, root: str, table: str, run: str, schema: str):
        self.root, self.table, self.run, self.schema = root, table, run, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = open_path(self.root)
        folder = f"{root}/data/{self.table}"
        system.create_dir(folder, recursive=True)
        task = f"{self.run}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        files, out, bucket = [], None, None
        try:
            for batch in iterator:
                buckets = batch.column(BUCKET).to_numpy()
                rows = batch.drop_columns([BUCKET])
                cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if lo == hi:
                        continue
                    if out is None or buckets[lo] != bucket:
                        if out is not None:
                            out.close()
                        bucket = int(buckets[lo])
                        files.append([f"{task}-{len(files):05d}.parquet", bucket, 0])
                        out = pq.ParquetWriter(f"{folder}/{files[-1][0]}", rows.schema, filesystem=system)
                    out.write_batch(rows.slice(lo, hi - lo))
                    files[-1][2] += hi - lo
        except BaseException:
            _remove(system, [f"{folder}/{name}" for name, *_ in files])
            raise
        finally:
            if out is not None:
                out.close()
        return Written([tuple(f) for f in files])

    def commit(self, messages: list[Written | None]) -> None:
        system, root = open_path(self.root)
        system.create_dir(f"{root}/_staged/{self.run}", recursive=True)
        noted = {"schema": self.schema, "files": sorted(f for m in messages if m for f in m.files)}
        with system.open_output_stream(f"{root}/_staged/{self.run}/{self.table}.json") as out:
            out.write(json.dumps(noted).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = open_path(self.root)
        _remove(system, [f"{root}/data/{self.table}/{name}" for m in messages if m for name, *_ in m.files])


def _remove(system: fs.FileSystem, files: list[str]) -> None:
    for file in files:
        try:
            system.delete_file(file)
        except FileNotFoundError:
            pass


class Store:
    """A folder of tables in versions.  A version is ``{"version", "buckets", "ledger", "tables"}``, a table ``{"schema", "files"}``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, qualified(spark, path)
        self.system, self.folder = open_path(self.root)

    def versions(self) -> list[int]:
        found = self.system.get_file_info(fs.FileSelector(f"{self.folder}/_versions", allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))

    def read_version(self, version: int | None = None) -> dict:
        """A version, the last one by default; the empty version 0 where there is none."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "buckets": None, "ledger": {}, "tables": {}}
        with self.system.open_input_stream(f"{self.folder}/_versions/{VERSION.format(version)}") as source:
            return json.loads(source.read())

    def knows(self, batch: tuple[str, int]) -> bool:
        """Whether a batch of a stream, or a later one, has been written."""
        return self.read_version()["ledger"].get(batch[0], -1) >= batch[1]

    def table(self, name: str, version: dict | int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """A table as a version has it; None where the version has no such table."""
        version = version if isinstance(version, dict) else self.read_version(version)
        if name not in version["tables"]:
            return None
        told = version["tables"][name]
        schema = StructType.fromJson(json.loads(told["schema"]))
        schema = StructType([f for f in schema.fields if f.name != BUCKET])
        files = [f"{self.root}/data/{name}/{file}" for file, bucket, _ in told["files"] if buckets is None or bucket in buckets]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def write(
        self, tables: dict[str, DataFrame], key: str, buckets: int = 64, written: DataFrame | None = None, batch: tuple[str, int] | None = None
    ) -> int:
        """Publish a version in which the rows of the written keys are those of ``tables``; gives its number.

        The written keys are those of ``written``, else all that any table has: one that no longer has rows in a table loses its
        old ones there.  Only the buckets of these keys are read and rewritten.  The number of buckets is that of the first
        write.  A ``batch`` (stream, number) that the ledger knows is not written again.
        """
        before = self.read_version()
        if batch is not None and before["ledger"].get(batch[0], -1) >= batch[1]:
            return before["version"]
        buckets = before["buckets"] or buckets
        place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        found = [t.select(key) for t in ([written] if written is not None else tables.values())]
        everyone = found[0]
        for keys in found[1:]:
            everyone = everyone.unionByName(keys)
        everyone = cut(everyone.distinct())
        touched = sorted(r[0] for r in everyone.select(place).distinct().collect())  # at most ``buckets`` numbers
        run = uuid.uuid4().hex
        self.spark.dataSource.register(StoreSource)
        for name, rows in tables.items():
            old = self.table(name, before, touched)
            if old is not None:
                kept = old.join(everyone.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left_anti")
                rows = rows.unionByName(kept, allowMissingColumns=True)
            rows = rows.withColumn(BUCKET, place)
            order = [BUCKET, key, *[c for c in ("ordinal", "page") if c in rows.columns and c != key]]
            # Range partitioning also cuts the bucket of a key that holds most rows.
            ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
            ordered.write.format("bitext_store").mode("append").options(root=self.root, table=name, run=run).save()
        after = {"version": before["version"] + 1, "buckets": buckets, "ledger": dict(before["ledger"]), "tables": dict(before["tables"])}
        if batch is not None:
            after["ledger"][batch[0]] = batch[1]
        for name in tables:
            with self.system.open_input_stream(f"{self.folder}/_staged/{run}/{name}.json") as source:
                noted = json.loads(source.read())
            untouched = [f for f in before["tables"].get(name, {"files": []})["files"] if f[1] not in set(touched)]
            after["tables"][name] = {"schema": noted["schema"], "files": untouched + noted["files"]}
        self._publish(after, run)
        return after["version"]

    def _publish(self, version: dict, run: str) -> None:
        """One rename makes the version known; it fails where a version of that number exists."""
        self.system.create_dir(f"{self.folder}/_versions", recursive=True)
        staged = f"_staged/{run}/version"
        with self.system.open_output_stream(f"{self.folder}/{staged}") as out:
            out.write(json.dumps(version).encode())
        hadoop, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        here, there = hadoop.Path(f"{self.root}/{staged}"), hadoop.Path(f"{self.root}/_versions/{VERSION.format(version['version'])}")
        options = gateway.new_array(hadoop.Options.Rename, 0)
        try:
            hadoop.FileContext.getFileContext(here.toUri(), conf).rename(here, there, options)
        except Exception as error:
            if isinstance(error, PySparkException) or "FileAlreadyExists" not in str(error):
                raise
            raise Conflict(f"Version {version['version']} of {self.root} was published by another writer; write again.") from error
        self.system.delete_dir(f"{self.folder}/_staged/{run}")

    def vacuum(self, keep: int = 2, older_than_s: float = 86_400) -> int:
        """Remove files that the last ``keep`` versions do not name and that are older than a write takes; gives their number."""
        known = set()
        last = self.versions()[-keep:]
        for number in last:
            for name, told in self.read_version(number)["tables"].items():
                known.update(f"{name}/{file}" for file, *_ in told["files"])
        gone = 0
        for info in self.system.get_file_info(fs.FileSelector(f"{self.folder}/data", recursive=True, allow_not_found=True)):
            name = info.path.rpartition("/data/")[2]
            if info.type == fs.FileType.File and name not in known and time.time() - info.mtime_ns / 1e9 >= older_than_s:
                self.system.delete_file(info.path)
                gone += 1
        for number in set(self.versions()) - set(last):
            self.system.delete_file(f"{self.folder}/_versions/{VERSION.format(number)}")
        return gone
