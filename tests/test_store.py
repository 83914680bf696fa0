import os
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bitext.sources.listing import list_files, read_lines, read_whole, stream_changed_units
from bitext.sources.store import Conflict, Store


def rows(spark, keys, text, n=1):
    return spark.createDataFrame([(k, i, text) for k in keys for i in range(n)], "doc_id long, ordinal int, text string")


def texts(table):
    return sorted((r.doc_id, r.text) for r in table.collect())


def test_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.versions() == [] and store.table("a") is None
    assert store.write({"a": rows(spark, range(6), "one"), "b": rows(spark, range(6), "one")}, "doc_id", buckets=3) == 1
    assert store.write({"a": rows(spark, [2], "two"), "b": rows(spark, [], "two")}, "doc_id", buckets=7) == 2
    assert store.read_version()["buckets"] == 3
    assert texts(store.table("a")) == sorted([(k, "one") for k in range(6) if k != 2] + [(2, "two")])
    assert texts(store.table("b")) == [(k, "one") for k in range(6) if k != 2]
    assert texts(store.table("a", 1)) == texts(store.table("b", 1)) == [(k, "one") for k in range(6)]


def test_a_lost_write_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write({"a": rows(spark, range(6), "one"), "b": rows(spark, range(6), "one")}, "doc_id")
    broken = rows(spark, range(6), "two").withColumn("text", F.when(F.col("doc_id") == 5, F.raise_error(F.lit("gone"))).otherwise(F.col("text")))
    with pytest.raises(PySparkException, match="gone"):
        store.write({"a": rows(spark, range(6), "two"), "b": broken}, "doc_id")
    assert store.versions() == [1] and texts(store.table("a")) == [(k, "one") for k in range(6)]
    assert store.write({"a": rows(spark, range(6), "two"), "b": rows(spark, range(6), "two")}, "doc_id") == 2
    assert texts(store.table("a")) == texts(store.table("b")) == [(k, "two") for k in range(6)]
    # Files of the lost write and of the first version go; those of the last one stay.
    assert store.vacuum(keep=1, older_than_s=0) > 0 and store.versions() == [2]
    assert texts(store.table("b")) == [(k, "two") for k in range(6)] and store.vacuum(keep=1, older_than_s=0) == 0


def test_the_slower_of_two_writers_is_told(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write({"a": rows(spark, [1], "one")}, "doc_id")
    before = store.read_version()
    store.write({"a": rows(spark, [1], "two")}, "doc_id")
    store.system.create_dir(f"{store.folder}/_staged/late", recursive=True)
    with pytest.raises(Conflict, match="Version 2"):
        store._publish({**before, "version": 2}, "late")
    assert texts(store.table("a")) == [(1, "two")]


def test_known_batches_are_not_written_again(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.write({"a": rows(spark, [1], "one")}, "doc_id", batch=("s", 4)) == 1
    for number in (4, 3):
        assert store.knows(("s", number)) and store.write({"a": rows(spark, [1], "again")}, "doc_id", batch=("s", number)) == 1
    assert not store.knows(("s", 5)) and not store.knows(("t", 0))
    assert store.write({"a": rows(spark, [1], "two")}, "doc_id", batch=("t", 0)) == 2 and store.read_version()["ledger"] == {"s": 4, "t": 0}


def test_odd_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    some = spark.createDataFrame([(None, 0, None), (1, 0, "x"), (1, 0, "x"), (1, None, "")], "doc_id long, ordinal int, text string")
    store.write({"a": some, "empty": rows(spark, [], "")}, "doc_id")
    assert sorted(map(str, store.table("a").collect())) == sorted(map(str, some.collect()))
    assert store.table("empty").collect() == [] and store.table("empty").columns == ["doc_id", "ordinal", "text"]
    store.write({"a": spark.createDataFrame([(None, 7, "new", 1.5)], "doc_id long, ordinal int, text string, more double")}, "doc_id")
    assert sorted((str(r.doc_id), r.text or "", r.more) for r in store.table("a").where("doc_id IS NULL").collect()) == [("None", "new", 1.5)]
    assert store.table("a").count() == 4


def test_a_hot_key_is_several_files(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.write({"a": rows(spark, [1], "x" * 50, n=3000)}, "doc_id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(store.read_version()["tables"]["a"]["files"]) > 1 and store.table("a").count() == 3000


def spread(folder, names):
    for name in names:
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(name)


@pytest.mark.parametrize("folders", [1, 3, 100])
def test_listing(spark, tmp_path, folders):
    names = ["top.txt", "a/x.md", "a/b/c/y.md", "a/b/.z", "_d/e/f g.txt", "k/1/2/3/4/5.md"]
    spread(tmp_path, names)
    (tmp_path / "empty").mkdir()
    (tmp_path / "loop").symlink_to(tmp_path / "a")
    got = list_files(spark, str(tmp_path), folders).collect()
    assert sorted(r.path for r in got) == sorted(names) and {r.path: r.size for r in got} == {n: len(n) for n in names}
    assert all(r.unit == (r.path.split("/")[0] if "/" in r.path else "") for r in got)
    assert list_files(spark, f"{tmp_path}/none").collect() == []


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_lines_by_ranges(spark, tmp_path, size):
    contents = {"a.md": "one\ntwo é\r\n\nlast", "b.md": "\n\n", "c.md": "", "d.md": "x" * 500 + "\ny\n", "e.md": "no end"}
    for name, text in contents.items():
        (tmp_path / name).write_bytes(text.encode())
    files = list_files(spark, str(tmp_path))
    want = []
    for name, text in contents.items():
        at = 0
        for line in text.encode().split(b"\n")[: None if text and not text.endswith("\n") else -1]:
            want.append((name, at, line.removesuffix(b"\r").decode()))
            at += len(line) + 1
    assert sorted(map(tuple, read_lines(files, str(tmp_path), size).collect())) == sorted(want)
    assert {r.path: r.text for r in read_whole(files, str(tmp_path)).collect()} == contents


def test_stream_of_changed_units(spark, tmp_path):
    root, state = tmp_path / "in", str(tmp_path / "cp")
    spread(root, ["p/a.md", "p/b/c.md", "q/x.md"])

    def arrive():
        seen = []
        stream = stream_changed_units(spark, str(root), settle_ms=0)
        query = (
            stream.writeStream.foreachBatch(lambda df, n: seen.extend(sorted(r.path for r in df.collect())))
            .option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return sorted(seen)

    assert arrive() == ["p/a.md", "p/b/c.md", "q/x.md"]
    assert arrive() == []
    time.sleep(0.05)
    spread(root, ["q/y/z.md"])
    assert arrive() == ["q/x.md", "q/y/z.md"]
    time.sleep(0.05)
    os.remove(root / "p/b/c.md")
    assert arrive() == ["p/a.md"]
