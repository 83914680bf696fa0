"""Inference that stops and goes on: answers are kept as they come, and nobody is asked twice.

Every request is known by the digest of its payload and of the model's label.  Tasks append what the model answered to a
ledger, a folder of Parquet files, a few answers at a time; requests whose digest has an answer there are taken out before
any call.  A task that is tried again also leaves out what its earlier try has appended since.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext.operators.inference import call_with_recovery
from bitext.sources.paths import open_path, qualified

ANSWERS = (
    "digest string, segments array<struct<segmentId:string,text:string>>, elapsed_ms long, prompt_token_count long, "
    "output_token_count long, calls int, recoveries int, error string"
)
_SEGMENT = pa.struct([("segmentId", pa.string()), ("text", pa.string())])
_TYPES = pa.schema([
    ("digest", pa.string()), ("segments", pa.list_(_SEGMENT)), ("elapsed_ms", pa.int64()), ("prompt_token_count", pa.int64()),
    ("output_token_count", pa.int64()), ("calls", pa.int32()), ("recoveries", pa.int32()), ("error", pa.string()),
])


#: A model that answers faster fills no more than a file in so many seconds, or of so many answers.
SECONDS, MOST = 1.0, 16384


class _Ledger:
    """The answers of one task, appended as files that are complete when they get their name."""

    def __init__(self, path: str, run: str, flush: int):
        self.system, self.folder = open_path(path)
        self.task = f"{run}-{TaskContext.get().partitionId():06d}"
        self.flush, self.rows, self.last = flush, [], time.monotonic()
        self.system.create_dir(self.folder, recursive=True)

    def earlier(self) -> set[str]:
        """Digests that an earlier try of this task has appended."""
        if not TaskContext.get().attemptNumber():
            return set()
        found = self.system.get_file_info(fs.FileSelector(self.folder))
        files = [e.path for e in found if e.base_name.startswith(self.task)]
        return {d for f in files for d in pq.read_table(f, columns=["digest"], filesystem=self.system)["digest"].to_pylist()}

    def add(self, row: dict) -> None:
        self.rows.append(row)
        due = len(self.rows) >= self.flush and time.monotonic() - self.last >= SECONDS
        if due or len(self.rows) >= max(self.flush, MOST):
            self.append()

    def append(self) -> None:
        if self.rows:
            name = f"{self.task}-{uuid.uuid4().hex}.parquet"
            # Spark passes over names that begin with a dot.
            pq.write_table(pa.Table.from_pylist(self.rows, schema=_TYPES), f"{self.folder}/.{name}", filesystem=self.system)
            self.system.move(f"{self.folder}/.{name}", f"{self.folder}/{name}")
            self.rows, self.last = [], time.monotonic()


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All answers that were ever appended."""
    try:
        return spark.read.schema(ANSWERS).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], ANSWERS)


def run_batches_once(
    requests: DataFrame,
    make_call: Callable[[], Callable[[list[dict]], dict]],
    ledger: str,
    model: str = "",
    validate: Callable[[list[dict], list[dict]], None] | None = None,
    flush: int = 16,
) -> DataFrame:
    """The answers of ``operators.inference.run_batches``, from a ledger that this call completes first.

    ``requests`` has doc_id, batch_id and payload; ``model`` names the model and its settings.  Requests with equal payloads are
    one call.  A request whose calls failed is asked again by the next run, one that was answered never.  An exception that
    is not the model's own way to fail, or a stopped task, loses nothing that was answered; a killed process loses
    up to ``flush`` answers of its task, or those of the last second where they are more.
    """
    spark, path, run = requests.sparkSession, qualified(requests.sparkSession, ledger), uuid.uuid4().hex
    keyed = requests.select("doc_id", "batch_id", "payload", F.sha2(F.concat(F.lit(f"{model}\n"), "payload"), 256).alias("digest"))
    answered = read_ledger(spark, path).where("error IS NULL").select("digest").distinct()
    left = keyed.select("digest", "payload").dropDuplicates(["digest"]).join(answered, "digest", "left_anti")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, kept = None, _Ledger(path, run, flush)
        known, count = kept.earlier(), 0
        try:
            for frame in frames:
                for digest, payload in zip(frame.digest, frame.payload, strict=True):
                    if digest not in known:
                        call = call or make_call()
                        kept.add({"digest": digest, **call_with_recovery(call, json.loads(payload), validate)})
                        count += 1
        finally:
            kept.append()
        yield pd.DataFrame({"n": [count]})

    left.mapInPandas(ask, "n long").write.format("noop").mode("overwrite").save()
    # Of several tries the one that was answered counts.
    best = F.max_by(F.struct("segments", "elapsed_ms", "prompt_token_count", "output_token_count", "calls", "recoveries", "error"), F.col("error").isNull())
    told = read_ledger(spark, path).groupBy("digest").agg(best.alias("a"), F.count(F.lit(1)).alias("tries"))
    return keyed.join(told, "digest").select("doc_id", "batch_id", "a.*", "tries")
