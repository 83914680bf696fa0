import numpy as np
import pytest
from pyspark.sql import functions as F

from bitext.llm import shards


def plain_best_fit(sizes, capacity):
    """One item at a time into the tightest bin."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        at = min((k for k, r in enumerate(rooms) if r >= s), key=lambda k: rooms[k], default=None)
        if at is None:
            rooms.append(capacity)
            at = len(rooms) - 1
        rooms[at] -= s
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_one_at_a_time(seed):
    random = np.random.RandomState(seed)
    sizes = random.randint(1, 60, 200).tolist()
    values, counts = np.unique(sizes, return_counts=True)
    runs = shards.best_fit(sorted(zip(values.tolist(), counts.tolist(), strict=True), reverse=True), 100)
    rooms = {}
    for size, lo, hi, k in runs:
        rooms[k] = rooms.get(k, 100) - size * (hi - lo)
    assert sorted(rooms.values()) == plain_best_fit(sizes, 100)
    for v, c in zip(values, counts, strict=True):
        assert sorted(r for s, lo, hi, _ in runs if s == v for r in range(lo, hi)) == list(range(c))


def test_equal_bins_with_a_group_over_its_share():
    runs = shards.equal_bins([(1000, 2), (10, 100), (1, 50)], 5)
    total = {}
    for size, lo, hi, k in runs:
        total[k] = total.get(k, 0) + size * (hi - lo)
    assert sorted(total.values()) == [350, 350, 350, 1000, 1000] and sum(hi - lo for *_, lo, hi, _ in [(0, *r) for r in runs]) == 152


def test_odd_rows(odd):
    found = shards.shard_groups(odd.withColumn("slot", F.lit("clash")), F.col("text"), F.octet_length("text"), shards=3)
    rows = found.collect()
    assert len(rows) == odd.count() and "taken" in found.columns and found.columns.count("slot") == 1
    for k in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    together = {}
    for r in rows:
        together.setdefault(r.text, set()).add(r.shard)
    assert all(len(s) == 1 for s in together.values())


def test_fixed_capacity(spark):
    docs = spark.range(100).selectExpr("id AS doc_id", "id AS key", "1 + id % 9 AS size")
    rows = shards.shard_groups(docs, F.col("key"), F.col("size"), capacity=50).collect()
    total = {}
    for r in rows:
        total[r.shard] = total.get(r.shard, 0) + r.size
    assert max(total.values()) <= 50 and len(total) == -(-sum(total.values()) // 50)


def test_group_over_the_capacity(spark):
    docs = spark.range(3).selectExpr("id AS doc_id", "1 AS key", "30 AS size")
    with pytest.raises(Exception, match="exceeds the capacity"):
        shards.shard_groups(docs, F.col("key"), F.col("size"), capacity=50).collect()


def test_empty_table(none):
    assert shards.shard_groups(none, F.col("text"), F.octet_length("text")).collect() == []
