"""Order-dependent operators that keep working when one key holds most of the rows.

A plain window puts a whole key into one task.  The functions here cut a key into
chunks of its integer position, work inside the chunks, and carry one small row
per chunk across the chunk borders.  Where the order is not an integer,
``rank_within`` measures the largest group first and cuts large groups by range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitext.plans.lineage import cut, keep
from bitext.plans.rows import dealt

CHUNK = 1 << 16
HOT_ROWS = 4_000_000
WIDE_ROWS = 200_000


def _chunked(df: DataFrame, position: str, chunk: int) -> DataFrame:
    at = F.col(position).cast("long")
    return df.withColumn("_chunk", at - F.pmod(at, F.lit(chunk)))


def _with_carried(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with what their chunk carries in; null keys are a key like any other."""
    on = F.col("r._chunk") == F.col("c._chunk")
    for key in keys:
        on = on & F.col(f"r.{key}").eqNullSafe(F.col(f"c.{key}"))
    extra = [F.col(f"c.{c}") for c in carried.columns if c not in (*keys, "_chunk")]
    return rows.alias("r").join(carried.alias("c"), on).select("r.*", *extra)


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    totals: dict[str, tuple[str, Column]],
    chunk: int = CHUNK,
) -> DataFrame:
    """Add running totals over the rows before each row, per key.

    ``totals`` maps a new column to ``("sum" | "max", value)``.  ``position`` is an
    integer, unique per key.  One shuffle of the rows on (keys, chunk); what the
    chunks carry to the next is combined on the map side.
    """
    keys = list(keys)
    combine = {"sum": F.sum, "max": F.max}
    rows = _chunked(df, position, chunk)
    for out, (_, value) in totals.items():
        rows = rows.withColumn(f"_v_{out}", value)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(position).rowsBetween(
        Window.unboundedPreceding, -1
    )
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    per_chunk = rows.groupBy(*keys, "_chunk").agg(
        *[combine[kind](f"_v_{out}").alias(f"_t_{out}") for out, (kind, _) in totals.items()]
    )
    carried = per_chunk.select(
        *keys, "_chunk",
        *[combine[kind](f"_t_{out}").over(across).alias(f"_c_{out}") for out, (kind, _) in totals.items()],
    )
    joined = _with_carried(
        rows.select(
            "*", *[combine[kind](f"_v_{out}").over(inside).alias(f"_i_{out}") for out, (kind, _) in totals.items()]
        ),
        carried,
        keys,
    )

    def both(out, kind):
        i, c = F.col(f"_i_{out}"), F.col(f"_c_{out}")
        if kind == "sum":
            return F.coalesce(i, F.lit(0)) + F.coalesce(c, F.lit(0))
        return F.greatest(i, c)  # greatest skips nulls

    return joined.select(*df.columns, *[both(out, kind).alias(out) for out, (kind, _) in totals.items()])


def kept_with_running(
    df: DataFrame, keys: Sequence[str], position: str, totals: dict[str, Column], chunk: int = CHUNK, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add running sums over the rows before each row, per key, to rows that are wide.

    The rows are written once, as columns, with the values to sum; the sums are computed from these numbers alone, and come
    back by a row number.  So wide rows are neither sorted nor computed twice.  Keys whose numbers fit into a task take a
    plain window, else they are cut into chunks.
    """
    values = [f"_value_{out}" for out in totals]
    rows = keep(df.select("*", *[v.cast("long").alias(n) for n, v in zip(values, totals.values(), strict=True)], F.monotonically_increasing_id().alias("_row")))
    narrow = rows.select(*keys, position, "_row", *values)
    largest, count = group_sizes(rows, keys)
    if largest <= hot_rows:
        before = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
        sums = narrow.select("_row", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(out) for out, n in zip(totals, values, strict=True)])
    else:
        sums = running_before(narrow, keys, position, {out: ("sum", F.col(n)) for out, n in zip(totals, values, strict=True)}, chunk)
    # Of many rows, each task sorts so many that they fit into its memory.
    wide, numbers = (dealt(side, count, WIDE_ROWS, "_row") for side in (rows.drop(*values), sums.select("_row", *totals)))
    return wide.join(numbers, "_row").drop("_row")


def running_total(
    df: DataFrame, keys: Sequence[str], position: str, value: Column, out: str, chunk: int = CHUNK
) -> DataFrame:
    """Add ``out``: the integer sum of ``value`` over the rows before this one, per key."""
    return running_before(df, keys, position, {out: ("sum", value.cast("long"))}, chunk)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    columns: dict[str, str],
    chunk: int = CHUNK,
) -> DataFrame:
    """Add the named columns of the row before, per key; null on the first row.

    ``columns`` maps source column to new name.
    """
    keys = list(keys)
    rows = _chunked(df, position, chunk)
    packed = F.struct(F.lit(True).alias("_seen"), *columns)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(position)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    carried = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.max_by(packed, position).alias("_tail"))
        .withColumn("_carry", F.lag("_tail").over(across))
        .drop("_tail")
    )
    joined = _with_carried(rows.withColumn("_inside", F.lag(packed).over(inside)), carried, keys)
    found = F.coalesce("_inside", "_carry")
    for source, name in columns.items():
        joined = joined.withColumn(name, found[source])
    return joined.drop("_chunk", "_inside", "_carry")


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group, and of all: one aggregate over the key columns."""
    row = df.groupBy(*keys).count().agg(F.max("count").alias("largest"), F.sum("count").alias("rows")).first()
    return row["largest"] or 0, row["rows"] or 0


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group: one aggregate over the key columns."""
    return group_sizes(df, keys)[0]


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    hot_rows: int = HOT_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Add ``out``: the place (1, 2, …) of a row in its group, for any order columns.

    Groups that fit into a task take a plain window.  When the largest does not,
    the rows are cut by range of (keys, order), so that a hot group spreads over
    many tasks; the counts that cross the cuts are at most one row per cut.
    ``largest`` saves the measurement where the size is known.
    """
    keys, order = list(keys), list(order)
    if largest is None:
        largest = largest_group(df, keys)
    if largest <= hot_rows:
        return df.withColumn(
            out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
        )
    # The range cut has to be the same in both uses below, hence the checkpoint.
    parts = cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # A group reaches into a part only as the part's first group, so that the
    # rows kept here are bounded by the number of parts: safe to broadcast.
    carried = (
        parts.groupBy(*keys, "_part")
        .count()
        .withColumn("_base", F.sum("count").over(across))
        .where("_base > 0")
        .drop("count")
    )
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*keys, "_part"]]
    condition = same[0]
    for term in same[1:]:
        condition = condition & term
    return (
        parts.withColumn("_inside", F.row_number().over(inside))
        .alias("r")
        .join(F.broadcast(carried.alias("c")), condition, "left")
        .select(
            *[F.col(f"r.{c}") for c in df.columns],
            (F.col("r._inside") + F.coalesce("c._base", F.lit(0))).cast("long").alias(out),
        )
    )


def match_in_order(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_order: Sequence[str],
    right_order: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Join the n-th row of ``left`` with the n-th row of ``right`` inside equal keys.

    One map-side combined count of both sides tells how large the groups are, unless ``largest`` bounds them.
    """
    keys = list(keys)
    if largest is None:
        sizes = (
            left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
            .unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
            .groupBy(*keys)
            .agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
        )
        largest = sizes.agg(F.max(F.greatest("_l", "_r")).alias("rows")).first()["rows"] or 0
    ranked = [
        rank_within(side, keys, order, "_n", hot_rows, largest)
        for side, order in ((left, left_order), (right, right_order))
    ]
    return ranked[0].join(ranked[1], [*keys, "_n"], how).drop("_n")
