import functools
import random

import pytest
from pyspark.sql import functions as F

from bitext import schemas
from bitext.operators import jobs as J
from bitext.streaming import jobs as SJ
from bitext.streaming.ordered import fold_in_order, use_state_lists


@pytest.fixture(scope="module")
def listed(spark):
    use_state_lists(spark)
    return spark


def dealt(spark, rows, schema, path, batches):
    """Rows as a stream of the given micro-batches, each a list of row numbers."""
    for numbers in batches:
        spark.createDataFrame([rows[k] for k in numbers], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream, folder):
    query = (
        stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
        .outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return [r.asDict() for r in stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out").collect()]


READS = "reader_id long, seq long, at_ms long, kind string, side string, behavior string, moved boolean"


def scrolls(seed, n=60):
    r = random.Random(seed)
    rows = [
        (r.choice([1, 2, 3]), k, r.randint(200, 1000) * 5, r.choices(["scroll", "intent"], [9, 1])[0], r.choice(["source", "translation"]),
         r.choice(["auto", "smooth"]), r.random() < 0.8)
        for k in range(n)
    ]
    return [*rows, (9, n, 1_000_000, "intent", "source", "auto", True)]


def split(seed, n):
    """Row numbers dealt at random to micro-batches, without regard to time; the last row comes last."""
    r = random.Random(seed)
    numbers = list(range(n - 1))
    r.shuffle(numbers)
    cuts = sorted(r.sample(range(1, n - 1), 3))
    return [numbers[lo:hi] for lo, hi in zip([0, *cuts], [*cuts, n - 1], strict=True)] + [[n - 1]]


@pytest.mark.parametrize("seed", [1, 2])
def test_scrolls_in_any_split_are_those_of_the_batch(listed, tmp_path, seed):
    rows = scrolls(seed)
    want = {(r.reader_id, r.seq, r.side) for r in J.debounced_sync(listed.createDataFrame(rows, READS)).collect()}
    stream = dealt(listed, rows, READS, str(tmp_path / "in"), split(seed, len(rows)))
    got = drained(SJ.stream_debounced_sync(stream, "10 seconds"), tmp_path)
    assert {(r["reader_id"], r["seq"], r["side"]) for r in got} == want and len(got) == len(want) > 10


def test_readers_share_a_bucket(listed, tmp_path, monkeypatch):
    monkeypatch.setattr(SJ, "fold_in_order", functools.partial(fold_in_order, buckets=1))
    rows = scrolls(3, 90)
    want = {(r.reader_id, r.seq, r.side) for r in J.debounced_sync(listed.createDataFrame(rows, READS)).collect()}
    stream = dealt(listed, rows, READS, str(tmp_path / "in"), split(3, len(rows)))
    out = SJ.stream_debounced_sync(stream, "10 seconds")
    got = drained(out, tmp_path)
    assert {(r["reader_id"], r["seq"], r["side"]) for r in got} == want and len(got) == len(want) > 10


def test_scrolls_later_than_the_watermark_are_dropped(listed, tmp_path):
    rows = [(1, 0, 10_000, "scroll", "source", "auto", True), (1, 1, 15_000, "scroll", "source", "auto", True), (1, 2, 10_100, "scroll", "translation", "auto", True),
            (1, 3, 14_900, "scroll", "translation", "auto", True), (1, 4, 1_000_000, "intent", "source", "auto", True)]
    stream = dealt(listed, rows, READS, str(tmp_path / "in"), [[0, 1], [3], [2], [4]])
    got = drained(SJ.stream_debounced_sync(stream, "1 second"), tmp_path)
    # Row 2 is four seconds late; row 3 is in time and silences the side of row 1.
    assert sorted(r["seq"] for r in got) == [0, 3]


def test_nulls_wait_for_nobody(listed, tmp_path):
    rows = [(None, 0, 10, "scroll", "source", "auto", True), (1, 1, None, "scroll", "source", "auto", True), (1, 2, 10, "scroll", "source", None, None),
            (1, 3, 1_000_000, "intent", None, None, None)]
    got = drained(SJ.stream_debounced_sync(dealt(listed, rows, READS, str(tmp_path / "in"), [[0, 1, 2], [3]]), "1 second"), tmp_path)
    assert [(r["reader_id"], r["seq"]) for r in got] == [(1, 2)]


@pytest.mark.parametrize("seed", [3, 4])
def test_starts_in_any_split_are_those_of_the_batch(listed, tmp_path, seed):
    r = random.Random(seed)
    rows = [("p", r.choice("abc"), k, f"2024-01-01 00:00:{k:02d}", r.choice(["started", "progressed", "failed", "finished"])) for k in range(50)]
    rows.append(("p", "end", 50, "2025-01-01 00:00:00", "finished"))
    schema = "project_id string, document_id string, seq long, ts string, type string"
    want = {(r.document_id, r.seq) for r in J.accepted_starts(listed.createDataFrame(rows, schema)).collect()}
    stream = dealt(listed, rows, schema, str(tmp_path / "in"), split(seed, len(rows))).withColumn("ts", F.to_timestamp("ts"))
    got = drained(SJ.stream_accepted_starts(stream, "1 hour"), tmp_path)
    assert {(r["document_id"], r["seq"]) for r in got} == want and len(got) == len(want)


def test_a_start_is_forgotten_when_its_time_is_up(listed, tmp_path):
    rows = [("p", "a", k, ts, "started") for k, ts in enumerate(["2024-01-01 00:00:00", "2024-01-01 01:30:00", "2024-01-01 02:30:00"])]
    rows.append(("p", "end", 9, "2025-01-01 00:00:00", "finished"))
    schema = schemas.JOB_EVENTS.split(", type")[0].replace("ts timestamp", "ts string") + ", type string"
    stream = dealt(listed, rows, schema, str(tmp_path / "in"), [[0, 1, 2], [3]]).withColumn("ts", F.to_timestamp("ts"))
    got = drained(SJ.stream_accepted_starts(stream, "1 hour", ttl_hours=2), tmp_path)
    assert sorted(r["seq"] for r in got) == [0, 2]
