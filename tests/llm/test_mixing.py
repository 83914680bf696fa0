import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bitext.llm import mixing, queries


def fair_targets(sizes, cycle=(5, 2, 1), most=3):
    """Targets by rounds of resharing the excess."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: cycle[k % len(cycle)] for k, s in enumerate(names)}
    target, left, open_ = {s: 0.0 for s in names}, float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        left = 0.0
        for s, more in share.items():
            target[s] += more
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    random.seed(seed)
    sizes = {f"s{k}" if k else None: random.choice([0, 1, 5, 80, 3000]) for k in range(random.randint(1, 12))}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = fair_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def corpus(spark, n=600):
    random.seed(1)
    rows = [(k, random.choice("aaaaabbc") if k % 17 else None, random.randint(0, 400), random.choice([0.2, 1.0, 3.0])) for k in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, size long, w double")


def test_copies(spark):
    rows, docs = corpus(spark)
    got = mixing.mix(docs, F.col("size"), F.col("w")).collect()
    again = mixing.mix(docs.repartition(5), F.col("size"), F.col("w")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        assert r.taken == r.copies * r.size <= 3 * r.size
        by[r.source].append(r)
    for some in by.values():
        size, target = some[0].source_size, some[0].target
        assert size == sum(r.size for r in some)
        assert abs(sum(r.taken for r in some) - target) <= max(3, 0.01 * target)
        # Whole epochs before the fraction: nobody is more than one copy ahead.
        assert {r.copies for r in some if r.size} <= {math.floor(target / size), math.floor(target / size) + 1}


def test_weights_raise_the_chance(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "if(id < 18000, 'a', 'b') AS source", "10L AS size", "if(id % 2 = 0, 4.0, 1.0) AS w")
    took = {r.w: r.share for r in mixing.mix(docs, F.col("size"), F.col("w")).where("source = 'a'").groupBy("w").agg(F.avg("copies").alias("share")).collect()}
    # Weighted sampling without replacement of a share p of all: 1 - exp(-w t) of each weight, for one t.
    t = -math.log(1 - float(took[1.0]))
    assert abs((1 - math.exp(-4 * t)) - float(took[4.0])) < 0.02


def test_odd_rows(odd, none):
    found = mixing.mix(odd, F.length("text"), F.when(F.col("doc_id") == 2, 0.0))
    rows = found.collect()
    assert len(rows) == odd.count() and found.columns.count("taken") == 1
    assert all(r.taken == 0 for r in rows if not r.text) and all(0 <= r.copies <= 3 for r in rows)
    assert mixing.mix(none, F.length("text")).collect() == []


def in_turn(sizes, budget):
    """How near a source comes, one document at a time in key order; it may stop where the first does not fit, and
    whenever what is missing falls below a power of two."""
    left, taken, plans, power = budget, set(), [], None
    for k in [*range(len(sizes)), None]:
        first = power is None and (k is None or sizes[k] > left)
        if k is not None and 0 < sizes[k] <= left:
            taken.add(k)
            left -= sizes[k]
        if first or k is None or (power and left < power):
            rest = [s for j, s in enumerate(sizes) if s and j not in taken]
            plans.append(min([left, *(abs(s - left) for s in rest)]))
            power = 2 ** math.floor(math.log2(left)) if left >= 1 else 0
    return min(plans)


@pytest.mark.parametrize("seed", range(3))
def test_dominating_document(spark, seed):
    # Targets are 5, 2 and 1 eighths of 3600; b takes 900 of its 2000, c 450 of its 1600.
    random.seed(seed)
    rows = [(0, "b", 1000)] + [(k, "b", 10) for k in range(1, 101)] + [(200, "c", 1500)] + [(200 + k, "c", random.choice([3, 7, 20])) for k in range(1, 11)]
    rows += [(300, "a", 2000)] + [(300 + k, "a", 50) for k in range(1, 31)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(docs, F.col("size"), F.when(F.col("size") >= 1000, 1000.0), seed=str(seed)).collect()
    order = {r.doc_id: r.key for r in docs.select("doc_id", mixing.sampling_key(F.col("doc_id"), F.when(F.col("size") >= 1000, 1000.0).otherwise(1.0), str(seed)).alias("key")).collect()}
    for source in "abc":
        some = sorted((r for r in got if r.source == source), key=lambda r: order[r.doc_id])
        target, size = some[0].target, some[0].source_size
        want = in_turn([r.size for r in some], target - target // size * size)
        assert abs(abs(sum(r.taken for r in some) - target) - want) < 1e-6
        assert source != "b" or want <= 5


@pytest.mark.parametrize("seed", range(2))
def test_passing_over_against_one_at_a_time(spark, seed):
    random.seed(seed)
    rows = [(k, random.choice(["p", "q", "r", None]), int(2 ** random.uniform(3, 14))) for k in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(docs, F.col("size")).collect()
    order = {r.doc_id: r.key for r in docs.select("doc_id", mixing.sampling_key(F.col("doc_id"), F.lit(1.0), "mix").alias("key")).collect()}
    for source in {r.source for r in got}:
        some = sorted((r for r in got if r.source == source), key=lambda r: order[r.doc_id])
        target, size = some[0].target, some[0].source_size
        want = in_turn([r.size for r in some], target - target // size * size)
        assert abs(abs(sum(r.taken for r in some) - target) - want) < 1e-6
        assert {r.copies for r in some} <= {target // size, target // size + 1}


def test_query_comes_as_near_as_one_at_a_time(spark, tmp_path):
    random.seed(11)
    words = [(k, random.choice(["w", "w", "x", "y", None]), int(2 ** random.uniform(0, 9))) for k in range(120)]
    spark.createDataFrame([(k, " \t".join(["word"] * n) if n > 1 else None, s) for k, s, n in words], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 3 // 2) for k in range(0, 120, 2)] + [(4, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op9_mixing(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.size for r in got} == {k: n if n > 1 else 0 for k, _, n in words}
    home = {k: s for k, s, _ in words}
    weight = {r.doc_id: r.quality_weight for r in got}
    assert weight[4] == 0.25 and weight[2] == 1.0 and weight[0] == 0.25 and weight[1] == 0.5
    targets = fair_targets({s: sum(n if n > 1 else 0 for _, t, n in words if t == s) for s in ("w", "x", "y", None)})
    keyed = spark.createDataFrame(list(weight.items()), "doc_id long, w double").select("doc_id", mixing.sampling_key(F.col("doc_id"), F.col("w"), "mix").alias("key"))
    order = {r.doc_id: r.key for r in keyed.collect()}
    for source, target in targets.items():
        some = sorted((r for r in got if home[r.doc_id] == source), key=lambda r: order[r.doc_id])
        size = some[0].source_size
        assert abs(some[0].target - target) < 1e-6 * target and {r.copies for r in some if r.size} <= {target // size, target // size + 1}
        want = in_turn([r.size for r in some], target - target // size * size)
        assert abs(abs(sum(r.taken for r in some) - target) - want) < 1e-6
