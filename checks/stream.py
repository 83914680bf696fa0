"""Streaming forms over the events table, dealt to several micro-batches with late rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext.plans.lineage import checkpoint_folder
from bitext.streaming import jobs as SJ
from bitext.streaming.ordered import use_state_lists
from checks import reader
from checks.register import registry

QUERIES, SQL, check = registry()
BATCHES = 4


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Everything a stream of the available data puts out, with the micro-batch, by way of a folder that every executor reads."""
    spark, path = stream.sparkSession, new_folder(stream.sparkSession, "stream-out")

    def keep(batch: DataFrame, number: int) -> None:
        # A repeated micro-batch replaces what it wrote.
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(keep).outputMode(mode)
        .option("checkpointLocation", new_folder(spark, "stream-state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(path)


def dealt_stream(events: DataFrame, time: str, last: dict) -> tuple[DataFrame, int]:
    """``events`` as a stream of several micro-batches by ``time`` (milliseconds), every seventh row one batch late.

    A row of its own, of ``last``, comes long after all others and so ends the wait for late ones.  Also gives how
    late rows are at most, in milliseconds.
    """
    spark, path = events.sparkSession, new_folder(events.sparkSession, "stream-in")
    low, high = events.agg(F.min(time), F.max(time)).first()
    width = (high - low) // BATCHES + 1
    batch = F.floor((F.col(time) - low) / width) + F.when(F.abs(F.hash("seq")) % 7 == 0, 1).otherwise(0)
    for number in range(BATCHES + 1):
        events.where(batch == number).write.mode("append").parquet(path)
    values = {time: F.lit(high + 100 * width).cast("long"), **last}
    if time != "ts" and "ts" in events.columns:
        values["ts"] = F.timestamp_millis(F.lit(high + 100 * width))
    closing = spark.range(1).select(*[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in events.dtypes])
    closing.write.mode("append").parquet(path)
    files = max(1, events.rdd.getNumPartitions())  # as many as one write leaves at most
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream, 2 * width


@check("job_state_stream", reader.SQL["job_state"])
def _(spark, folder):
    events = reader.job_events_of(spark.read.parquet(f"{folder}/events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    closing = {"project_id": F.lit("closing"), "document_id": F.lit("closing"), "seq": F.lit(-1), "type": F.lit("finished")}
    stream, late = dealt_stream(events.withColumn("clock", F.unix_millis("ts")), "clock", closing)
    out = drained(SJ.stream_job_state(stream, f"{late} milliseconds", ttl_hours=24 * 3650), "update")
    last = out.groupBy("project_id", "document_id").agg(F.max_by(F.struct("phase", "progress", "error"), F.struct("seq", "batch")).alias("s"))
    return last.where("s.phase <> 'finished'").select(
        "project_id", "document_id", "s.phase",
        F.get_json_object("s.progress", "$.current").cast("long").alias("progress_at"), "s.error",
    )


@check("debounced_sync_stream", reader.SQL["debounced_sync"])
def _(spark, folder):
    use_state_lists(spark)
    reads = reader.reads_of(spark.read.parquet(f"{folder}/events.parquet")).drop("ts")
    stream, late = dealt_stream(reads, "at_ms", {"reader_id": F.lit(-1), "seq": F.lit(-1), "kind": F.lit("intent")})
    out = drained(SJ.stream_debounced_sync(stream, f"{late} milliseconds"), "append")
    return out.select("reader_id", "seq", "side")


@check("inflight_dedup_stream", reader.SQL["inflight_dedup"])
def _(spark, folder):
    use_state_lists(spark)
    # Events count in the order of their identifiers, as in the batch form: these are the clock.
    events = reader.job_events_of(spark.read.parquet(f"{folder}/events.parquet")).select(
        "project_id", "document_id", "seq", F.timestamp_millis(F.col("seq") + 1).alias("ts"), "type"
    ).withColumn("clock", F.col("seq"))
    stream, late = dealt_stream(events, "clock", {"document_id": F.lit("closing"), "project_id": F.lit("closing"), "seq": F.lit(-1), "type": F.lit("finished")})
    out = drained(SJ.stream_accepted_starts(stream, f"{late} milliseconds"), "append")
    return out.select("document_id", "seq")
