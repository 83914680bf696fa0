"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key divided by its quality weight; inside
its source the documents stand in the order of the keys, which is weighted
sampling without replacement.  A source takes whole epochs first, then in key
order the documents that fit into what is left of its token budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitext.llm.common import running, same, staged, without

TOLD = 10_000  # sources that are broadcast
RESULT = ["source_size", "target", "copies", "taken"]


def source_targets(sizes: DataFrame, cycle: Sequence[int] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Targets of sources: ``sizes`` has ``source, source_size``; adds ``weight, target``.

    Sources by code point, null last, weigh by ``cycle`` in turn and share the sum of all
    sizes; none gets more than ``max_epochs`` times its size, and what is over goes
    to the others by weight.  Sorted by size over weight, the full sources come first, so one
    running sum settles all rounds of resharing.  One row per source, in one task.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weights = F.array(*[F.lit(int(w)) for w in cycle])
    ranked = sizes.withColumn(
        "weight", F.element_at(weights, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(cycle))) + 1)
    ).withColumn("_cap", F.col("source_size") * max_epochs)
    everything = Window.partitionBy(F.lit(0))
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    full = (
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double")
        * F.col("weight")
        >= F.col("_cap").cast("double")
        * (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    return (
        ranked.withColumn("_full", full)
        .withColumn("_rest", F.sum("source_size").over(everything) - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(everything))
        .withColumn("_open", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(everything))
        .select(
            "source", "source_size", "weight",
            F.when(F.col("_full"), F.col("_cap").cast("double"))
            .otherwise(F.try_divide((F.col("weight") * F.col("_rest")).cast("double"), F.col("_open").cast("double")))
            .alias("target"),
        )
    )


def sampling_key(id_: Column, weight: Column, seed: str) -> Column:
    """An exponential variate with rate ``weight``, drawn from the identifier; without weight, the last."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    weight = F.coalesce(weight.cast("double"), F.lit(1.0))
    return F.when(weight > 0, -F.ln(uniform) / weight).otherwise(F.lit(float("inf")))


def per_source(sources: DataFrame) -> DataFrame:
    """A table of a row per source, to be joined by source: broadcast where it is counted and small, so that no hot source is
    dealt to one task; else Spark joins it as it sees fit."""
    return F.broadcast(sources) if sources.limit(TOLD + 1).count() <= TOLD else sources


def _pass_over(left: DataFrame, state: DataFrame) -> DataFrame:
    """Rounds in which sources go on in key order and pass over what is larger than what is missing.

    ``left`` (source, rank, size) are documents not taken, ``state`` (s_source, missing, at) what each source misses
    when the first ``at`` documents have been looked at.  Gives rows (s_source, round, missing, off, last, low, high, limit,
    event): in a round the documents of ranks low to high (without high) up to the size ``limit`` are taken, and that of
    rank ``event``; then ``missing`` is missing, and the one left whose size is nearest to it, ``last``, leaves ``off``.

    With what is missing between a power of two and its double, all documents up to the power fit and at most
    one larger.  So one running sum leads below the power, and rounds are no more than the bits of what is missing.
    """
    none, key = F.lit(None).cast("long"), same(F.col("source"), F.col("s_source"))
    state = state.select("s_source", "missing", "at", none.alias("low"), none.alias("high"), none.alias("limit"), none.alias("event"))
    told, number = None, 0
    while True:
        # What is missing only shrinks: twice as large a document is of no use any more.
        left = staged(
            left.join(per_source(state), key).where(
                (F.col("size") > 0) & (F.col("size") < 2 * F.col("missing"))
                & ~F.coalesce((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")) & (F.col("size") <= F.col("limit")), F.lit(False))
                & ~F.coalesce(F.col("rank") == F.col("event"), F.lit(False))
            ).select("source", "rank", "size"), "mix-left",
        )
        near = left.join(per_source(state), key).groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("missing")).alias("off"), "rank")).alias("best"))
        state = staged(
            state.join(near, key, "left").select(
                "s_source", F.lit(number).alias("round"), "missing", F.least("missing", "best.off").alias("off"),
                F.when(F.col("best.off") < F.col("missing"), F.col("best.rank")).alias("last"), "at", "low", "high", "limit", "event",
            ), "mix-round",
        )
        told = state if told is None else told.union(state)
        # Sizes are whole: nothing is nearer than a half.
        power = F.pow(F.lit(2.0), F.floor(F.log2("missing")))
        power = F.when(power > F.col("missing"), power / 2).otherwise(power).cast("long")
        going = state.where("off > 0.5").withColumn("power", power)
        able = left.join(per_source(going), key).where("rank >= at AND size <= missing").select("source", "rank", "size", "missing", "power")
        small = F.when(F.col("size") <= F.col("power"), F.col("size")).otherwise(0)
        able = running(able, ["source"], ["rank"], {"before": small}, "mix-able")
        rest = F.col("missing") - F.col("before") - F.col("size")
        falls = F.when(F.col("size") <= F.col("power"), rest < F.col("power")).otherwise(rest >= 0)
        steps = able.groupBy("source").agg(
            F.min(F.when(falls, F.struct("rank", rest.alias("rest")))).alias("event"), F.sum(small).alias("all"), F.max("rank").alias("end")
        )
        state = staged(
            going.select("s_source", "missing", "at", "power").join(steps, key).select(
                "s_source", F.coalesce("event.rest", F.col("missing") - F.col("all")).alias("missing"),
                (F.coalesce("event.rank", "end") + 1).alias("at"), F.col("at").alias("low"),
                F.coalesce("event.rank", F.col("end") + 1).alias("high"), F.col("power").alias("limit"), F.col("event.rank").alias("event"),
            ), "mix-state",
        )
        if state.isEmpty():
            return told
        number += 1


def mix(
    docs: DataFrame,
    size: Column,
    weight: Column | None = None,
    id: str = "doc_id",
    source: str = "source",
    cycle: Sequence[int] = (5, 2, 1),
    max_epochs: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """How often each document enters the mix: the rows of ``docs`` with source_size, target, copies, taken.

    ``copies`` is the number of whole epochs of its source, plus one for documents that the
    fraction of an epoch selects; ``taken`` is copies times ``size``.  The fraction takes documents in key
    order while they fit, then goes on and passes over those larger than what is missing; where it stops, the one document
    left over whose size is nearest to what is missing comes last, if that brings the source nearer.  It may stop at the first
    that does not fit, and whenever what is missing falls below a power of two: where the source comes nearest.  Equal input
    gives equal output.

    Null source: a source of its own, the last.  Null or negative size: 0, such documents come along
    with whole epochs.  Null weight: 1; zero or less: last in its source.  Null identifiers draw one key.
    Repeated rows are rows of their own.  An empty table gives an empty one.  Columns of
    ``docs`` named like a result column give way to it.
    """
    kept = without(docs, RESULT)
    rows = docs.select(
        F.struct(*kept).alias("row"),
        F.col(source).alias("source"),
        F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("size"),
        sampling_key(F.col(id), F.lit(1.0) if weight is None else weight, seed).alias("key"),
        F.xxhash64(*kept).alias("tie"),
    )
    ordered = running(rows, ["source"], ["key", "tie"], {"before": F.col("size"), "rank": F.lit(1)}, "mix")
    targets = source_targets(ordered.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, max_epochs)
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0))
    targets = staged(
        targets.withColumn("epochs", epochs.cast("int")).withColumn(
            "budget", F.col("target") - F.col("epochs") * F.col("source_size")
        ),
        "mix-targets",
    ).withColumnRenamed("source", "t_source")
    narrow = ordered.drop("row").join(per_source(targets), same(F.col("source"), F.col("t_source")))
    fits = F.col("before") + F.col("size") <= F.col("budget")
    filled = narrow.groupBy("source").agg(
        F.coalesce(F.max(F.when(fits, F.col("before") + F.col("size"))), F.lit(0)).alias("filled"),
        F.coalesce(F.max(F.when(fits, F.col("rank"))) + 1, F.lit(0)).alias("at"),
    ).withColumnRenamed("source", "f_source")
    missing = F.col("budget") - F.col("filled")
    state = per_source(targets.where("budget > 0")).join(filled, same(F.col("t_source"), F.col("f_source")))
    state = staged(state.select(F.col("t_source").alias("s_source"), missing.alias("missing"), "at"), "mix-start")
    rounds = _pass_over(narrow.where(~fits & (F.col("budget") > 0)).select("source", "rank", "size"), state)
    best = rounds.groupBy("s_source").agg(
        F.min(F.struct("off", "round", "last")).alias("best"), F.collect_list(F.struct("round", "low", "high", "limit", "event")).alias("steps")
    )
    last = best.select(
        F.col("s_source").alias("l_source"), F.col("best.last").alias("last"),
        F.filter("steps", lambda x: (x["round"] > 0) & (x["round"] <= F.col("best.round"))).alias("steps"),
    )
    plan = staged(targets.join(last, same(F.col("t_source"), F.col("l_source")), "left").drop("l_source"), "mix-plan")
    later = F.exists("steps", lambda x: (F.col("rank") >= x["low"]) & (F.col("rank") < x["high"]) & (F.col("size") <= x["limit"])
                     | F.coalesce(F.col("rank") == x["event"], F.lit(False)))
    chosen = fits | F.coalesce(F.col("rank") == F.col("last"), F.lit(False)) | (F.coalesce(later, F.lit(False)) & (F.col("size") > 0))
    extra = (F.col("budget") > 0) & chosen
    copies = (F.col("epochs") + F.when(extra, 1).otherwise(0)).cast("int")
    return (
        ordered.join(per_source(plan), same(F.col("source"), F.col("t_source")))
        .withColumn("copies", copies)
        .select("row.*", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )
