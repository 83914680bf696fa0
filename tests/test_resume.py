import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bitext.plans import resume


def requests(spark, n=40):
    rows = [(k, 0, json.dumps([{"segmentId": "s", "text": f"text {k % 30}"}])) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, batch_id int, payload string").repartition(3)


def model(log, stops=None, fails=None):
    class Told(BaseException):
        pass

    def make():
        def call(segments):
            text = segments[0]["text"]
            with open(log, "a") as out:
                out.write(text + "\n")
            if text == stops:
                raise Told("told to stop")
            if text == fails:
                raise ValueError("no idea")
            return {"segments": [{"segmentId": s["segmentId"], "text": "ES " + s["text"]} for s in segments], "elapsed_ms": 2}

        return call

    return make


def test_what_was_answered_is_not_asked_again(spark, tmp_path):
    log, ledger = tmp_path / "calls", f"{tmp_path}/ledger"
    with pytest.raises(PySparkException, match="told to stop"):
        resume.run_batches_once(requests(spark), model(log, stops="text 7"), ledger, flush=1)
    kept = {r.digest for r in resume.read_ledger(spark, ledger).collect()}
    before = log.read_text().splitlines()
    got = resume.run_batches_once(requests(spark), model(log), ledger)
    assert {r.doc_id: r.segments[0].text for r in got.collect()} == {k: f"ES text {k % 30}" for k in range(40)}
    assert {r.tries for r in got.collect()} == {1} and {r.elapsed_ms for r in got.collect()} == {2}
    calls = log.read_text().splitlines()
    # Equal payloads are one call; the one that was told to stop is asked again, and none that was kept.
    assert sorted(set(calls)) == sorted({f"text {k}" for k in range(30)}) and len(calls) - len(before) == 30 - len(kept)
    again = len(calls)
    resume.run_batches_once(requests(spark), model(log), ledger)
    assert len(log.read_text().splitlines()) == again


def test_failed_requests_are_asked_by_the_next_run(spark, tmp_path):
    log, ledger = tmp_path / "calls", f"{tmp_path}/ledger"
    first = resume.run_batches_once(requests(spark), model(log, fails="text 3"), ledger, model="small")
    assert {r.doc_id for r in first.where(F.col("error").isNotNull()).collect()} == {3, 33}
    second = resume.run_batches_once(requests(spark), model(log), ledger, model="small")
    assert second.where(F.col("error").isNotNull()).count() == 0 and {r.doc_id: r.tries for r in second.collect()}[3] == 2
    assert log.read_text().splitlines().count("text 4") == 1
    # Another model's answers are others.
    resume.run_batches_once(requests(spark), model(log), ledger, model="large")
    assert log.read_text().splitlines().count("text 4") == 2


def test_no_requests(spark, tmp_path):
    assert resume.run_batches_once(requests(spark).limit(0), model(tmp_path / "calls"), f"{tmp_path}/ledger").collect() == []


def test_a_fast_model_fills_few_files(spark, tmp_path):
    # a file for every sixteen answers, however fast they come.
    many = spark.range(4000).selectExpr("id AS doc_id", "0 AS batch_id", "concat('[{\"segmentId\":\"s\",\"text\":\"t', id, '\"}]') AS payload")
    got = resume.run_batches_once(many, model(tmp_path / "calls"), f"{tmp_path}/ledger")
    assert got.count() == 4000 and got.where("tries <> 1 OR error IS NOT NULL").count() == 0
    assert len(list((tmp_path / "ledger").glob("*.parquet"))) < 60
