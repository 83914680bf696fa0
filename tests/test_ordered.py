import random

from pyspark.sql import functions as F

from bitext.plans import ordered as O


def skewed(spark, rows=400):
    rng = random.Random(1)
    data = [("hot" if i % 3 else rng.choice(["a", "b", None]), i, rng.randint(0, 9), f"n{rng.randint(0, 10**6):07d}") for i in range(rows)]
    return data, spark.createDataFrame(data, "k string, at int, v int, name string").repartition(6)


def test_running_totals_across_chunks(spark):
    data, df = skewed(spark)
    want, sums, tops = {}, {}, {}
    for k, at, v, _ in data:
        want[at] = (sums.get(k, 0), tops.get(k))
        sums[k], tops[k] = sums.get(k, 0) + v, max(v, tops.get(k, -1))
    for chunk in (1, 7, 64, 10_000):
        got = O.running_before(df, ["k"], "at", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, chunk)
        assert {r.at: (r.s, r.m) for r in got.collect()} == want


def test_previous_across_chunks(spark):
    data, df = skewed(spark)
    want, last = {}, {}
    for k, at, v, name in data:
        want[at] = last.get(k, (None, None))
        last[k] = (v, name)
    for chunk in (1, 7, 10_000):
        got = O.previous(df, ["k"], "at", {"v": "pv", "name": "pn"}, chunk)
        assert {r.at: (r.pv, r.pn) for r in got.collect()} == want


def test_hot_groups_rank_as_a_plain_window(spark):
    _, df = skewed(spark)
    plain = {r.at: r.n for r in O.rank_within(df, ["k"], ["name", "at"], "n").collect()}
    cut_up = {r.at: r.n for r in O.rank_within(df, ["k"], ["name", "at"], "n", hot_rows=5).collect()}
    assert plain == cut_up and max(plain.values()) > 200


def test_match_in_order_when_hot(spark):
    _, df = skewed(spark)
    left, right = df.select("k", F.col("at").alias("l")), df.where("v > 4").select("k", F.col("name").alias("r"), "at")
    for how in ("inner", "full"):
        results = [
            {(x.k, x.l, x.r) for x in O.match_in_order(left, right.drop("at"), ["k"], ["l"], ["r"], how, hot).collect()}
            for hot in (3, 10**6)
        ]
        assert results[0] == results[1]


def test_kept_sums_are_the_same_for_small_and_for_hot_keys(spark):
    # F2 F3: keys that fit into a task take one window over the numbers, others chunks.
    data, df = skewed(spark)
    want, sums = {}, {}
    for k, at, v, _ in data:
        want[at] = sums.get(k, 0)
        sums[k] = sums.get(k, 0) + v
    for hot_rows in (5, 10**6):
        got = O.kept_with_running(df, ["k"], "at", {"s": F.col("v")}, chunk=7, hot_rows=hot_rows)
        assert {r.at: r.s for r in got.where("k IS NOT NULL").collect()} == {at: want[at] for k, at, _, _ in data if k}
        assert got.count() == len(data) and ("_chunk" in got._jdf.queryExecution().toString()) == (hot_rows == 5)


def test_many_rows_are_dealt_to_more_tasks_than_spark_would_take(spark):
    # F2 F3: wide rows of a large table are sorted in parts that fit into a task.
    from bitext.plans.rows import dealt

    df, usual = spark.range(100), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt(df, 100, 100 // usual, "id") is df
    many = dealt(df, 100, 5, "id")
    assert many.rdd.getNumPartitions() == 20 and many.count() == 100


def test_kept_tables_are_written_small(spark):
    import pyarrow.parquet as pq

    from bitext.plans.lineage import keep

    kept = keep(spark.range(1000).select("id", F.lit("the same words again").alias("text")))
    [path, *_] = kept.inputFiles()
    column = pq.ParquetFile(path.removeprefix("file://")).metadata.row_group(0).column(1)
    assert column.compression == "ZSTD" and kept.count() == 1000
