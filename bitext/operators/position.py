"""Reading positions: mapping between the two sides, visible pages, spatial overlap.

Range conditions are turned into equal buckets.  The buckets of a document are as
many as its intervals, so that cutting the intervals into buckets at most triples
them, whatever their lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitext import constants as K
from bitext.functions import text as T
from bitext.operators.align import explode_side
from bitext.plans.ordered import HOT_ROWS, previous, rank_within, running_before

CELL = 64.0


# ------------------------------------------------------------------ intervals


def alignment_intervals(alignments: DataFrame, bounds: DataFrame, leader: str = "source") -> DataFrame:
    """Extent of every alignment on both sides; alignments without bounds on a side drop out.

    ``bounds(doc_id, side, segment_id, start, end)`` with side source or translation.
    """
    sides = explode_side(alignments, "source").withColumn("side", F.lit("source")).unionByName(
        explode_side(alignments, "target").withColumn("side", F.lit("translation"))
    )
    leads = F.col("side") == leader
    pick = lambda agg, c, lead: agg(F.when(leads if lead else ~leads, F.col(c)))
    return (
        sides.join(bounds, ["doc_id", "side", "segment_id"])
        .groupBy("doc_id", "alignment_id", "alignment_ordinal")
        .agg(
            pick(F.min, "start", True).alias("leader_start"),
            pick(F.max, "end", True).alias("leader_end"),
            pick(F.min, "start", False).alias("follower_start"),
            pick(F.max, "end", False).alias("follower_end"),
        )
        .where(F.col("leader_start").isNotNull() & F.col("follower_start").isNotNull())
    )


def position_pieces(intervals: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The leader's axis cut into pieces that do not overlap, one mapping each.

    An interval answers for positions beyond everything before it, up to its
    end; the gap in front of it maps between its neighbour and itself.  Before
    the first interval and after the last the mapping is constant.
    """
    ranked = rank_within(
        intervals, ["doc_id"], ["leader_start", "leader_end", "alignment_ordinal"], "n", hot_rows
    )
    known = running_before(
        previous(ranked, ["doc_id"], "n", {"leader_end": "_prev_end", "follower_end": "_prev_follower"}),
        ["doc_id"], "n", {"_reach": ("max", F.col("leader_end"))},
    )
    last = ranked.groupBy("doc_id").agg(
        F.max("leader_end").alias("_all_end"), F.max_by("follower_end", "n").alias("_last_follower"), F.count("*").alias("_count"),
        F.min("leader_start").alias("_low"),
    )
    s, e, reach = F.col("leader_start"), F.col("leader_end"), F.col("_reach")
    fs, fe = F.col("follower_start"), F.col("follower_end")
    first = F.col("n") == 1
    infinity = F.lit(float("inf"))

    def piece(when, lo, lo_closed, hi, hi_closed, a, b, c, d):
        return F.when(
            when,
            F.struct(
                lo.alias("lo"), lo_closed.alias("lo_closed"), hi.alias("hi"), F.lit(hi_closed).alias("hi_closed"),
                a.alias("from_start"), b.alias("from_end"), c.alias("to_start"), d.alias("to_end"),
            ),
        )

    no, yes = F.lit(False), F.lit(True)
    pieces = F.array(
        piece(first, -infinity, no, s, True, s, s, fs, fs),
        piece(~first & (s > reach), reach, no, s, False, F.col("_prev_end"), s, F.col("_prev_follower"), fs),
        piece(first & (e > s), s, no, e, True, s, e, fs, fe),
        piece(~first & (e > reach) & (s > reach), s, yes, e, True, s, e, fs, fe),
        piece(~first & (e > reach) & (s <= reach), reach, no, e, True, s, e, fs, fe),
        piece(
            F.col("n") == F.col("_count"), F.col("_all_end"), no, infinity, True,
            F.col("_all_end"), F.col("_all_end"), F.col("_last_follower"), F.col("_last_follower"),
        ),
    )
    width = (F.col("_all_end") - F.col("_low")) / F.col("_count")
    return (
        known.join(last, "doc_id")
        .withColumn("_width", F.when(width > 0, width).otherwise(1.0))
        .select("doc_id", "_low", "_width", "_count", F.explode(pieces).alias("_p"))
        .where(F.col("_p").isNotNull())
        .select("doc_id", "_low", "_width", "_count", "_p.*")
    )


def _bucket(value: Column) -> Column:
    """Bucket of a position in its document; positions outside go to the end buckets."""
    raw = F.floor((value - F.col("_low")) / F.col("_width"))
    return (
        F.when(value <= F.col("_low"), F.lit(0))
        .when(value >= F.col("_low") + F.col("_width") * F.col("_count"), F.col("_count") - 1)
        .otherwise(F.least(F.greatest(raw, F.lit(0)), F.col("_count") - 1))
        .cast("long")
    )


def interpolate(value: Column, from_start: Column, from_end: Column, to_start: Column, to_end: Column) -> Column:
    """Linear mapping of one extent onto another; the middle when the first is empty."""
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - from_start) / (from_end - from_start)))
    return F.when(from_end <= from_start, (to_start + to_end) / 2).otherwise(
        to_start + progress * (to_end - to_start)
    )


def map_positions(events: DataFrame, intervals: DataFrame, position: str = "position", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``mapped``: the follower's position for a leader's; null without intervals.

    Every event meets the piece it lies in: joins on the document and on the
    bucket, both of which adaptive execution splits when a document is hot.
    """
    pieces = position_pieces(intervals, hot_rows)
    scale = intervals.groupBy("doc_id").agg(
        F.min("leader_start").alias("_low"),
        F.count("*").alias("_count"),
        F.max("leader_end").alias("_all_end"),
    )
    width = (F.col("_all_end") - F.col("_low")) / F.col("_count")
    placed = (
        events.join(
            scale.select("doc_id", "_low", "_count", F.when(width > 0, width).otherwise(1.0).alias("_width")),
            "doc_id", "left",
        )
        .withColumn("_bucket", _bucket(F.col(position)))
        .drop("_low", "_count", "_width")
    )
    spread = pieces.withColumn(
        "_bucket", F.explode(F.sequence(_bucket(F.col("lo")), _bucket(F.col("hi"))))
    ).drop("_low", "_count", "_width")
    p = F.col(f"e.{position}")
    inside = ((p > F.col("i.lo")) | (F.col("i.lo_closed") & (p == F.col("i.lo")))) & (
        (p < F.col("i.hi")) | (F.col("i.hi_closed") & (p == F.col("i.hi")))
    )
    return (
        placed.alias("e")
        .join(
            spread.alias("i"),
            (F.col("e.doc_id") == F.col("i.doc_id")) & (F.col("e._bucket") == F.col("i._bucket")) & inside,
            "left",
        )
        .select(
            *[F.col(f"e.{c}") for c in events.columns],
            interpolate(p, F.col("i.from_start"), F.col("i.from_end"), F.col("i.to_start"), F.col("i.to_end")).alias("mapped"),
        )
    )


def follower_scroll_top(mapped: Column, viewport_height: Column, scroll_height: Column, focus: float = K.FOCUS_RATIO) -> Column:
    """Scroll position that puts ``mapped`` on the focus line, within the document."""
    limit = F.greatest(F.lit(0.0), scroll_height - viewport_height)
    return F.least(limit, F.greatest(F.lit(0.0), mapped - viewport_height * focus))


def sync_decisions(events: DataFrame, alignments: DataFrame, bounds: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Moves of the other side that events ask for; events that ask for none drop out.

    Events have doc_id, side, scroll_top, viewport_height, mode, behavior,
    follower_scroll_top, follower_viewport_height, follower_scroll_height,
    source_visible, translation_visible, source_locked, translation_locked.
    """
    live = events.where(
        (F.col("mode") == "synchronized")
        & F.col("source_visible") & F.col("translation_visible")
        & ~F.col("source_locked") & ~F.col("translation_locked")
        & F.col("scroll_top").isNotNull() & F.col("follower_scroll_top").isNotNull()
    ).withColumn("position", F.col("scroll_top") + F.col("viewport_height") * K.FOCUS_RATIO)
    mapped = None
    for leader in ("source", "translation"):
        part = map_positions(
            live.where(F.col("side") == leader), alignment_intervals(alignments, bounds, leader), hot_rows=hot_rows
        )
        mapped = part if mapped is None else mapped.unionByName(part)
    goal = follower_scroll_top(
        F.col("mapped"), F.col("follower_viewport_height"), F.col("follower_scroll_height")
    )
    near = (F.col("behavior") == "auto") & (F.abs(F.col("next_scroll_top") - F.col("follower_scroll_top")) < K.DEAD_ZONE)
    return mapped.where(F.col("mapped").isNotNull()).withColumn("next_scroll_top", goal).where(~near)


# ----------------------------------------------------------------------- pages


def locate_visible_page(viewports: DataFrame, pages: DataFrame) -> DataFrame:
    """The page that fills most of each viewport, and how far its top is scrolled away.

    ``viewports(doc_id, event_id, top, height)``, ``pages(doc_id, page_number,
    top, height)``.  Viewports that show no page drop out.
    """
    scale = pages.groupBy("doc_id").agg(
        F.min("top").alias("_low"), F.count("*").alias("_count"), F.max(F.col("top") + F.col("height")).alias("_high")
    )
    width = (F.col("_high") - F.col("_low")) / F.col("_count")
    scale = scale.select("doc_id", "_low", "_count", F.when(width > 0, width).otherwise(1.0).alias("_width"))

    def spread(rows, end):
        return rows.join(scale, "doc_id").withColumn(
            "_bucket", F.explode(F.sequence(_bucket(F.col("top")), _bucket(end)))
        ).drop("_low", "_count", "_width")

    shown = spread(viewports.where(F.col("height") > 0), F.col("top") + F.col("height")).select(
        "doc_id", "_bucket", "event_id", F.col("top").alias("_top"), (F.col("top") + F.col("height")).alias("_bottom")
    )
    laid = spread(pages, F.col("top") + F.col("height"))
    bottom = F.col("top") + F.col("height")
    overlap = F.least(bottom, F.col("_bottom")) - F.greatest(F.col("top"), F.col("_top"))
    offset = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("_top") - F.col("top")) / F.col("height")))
    best = F.max_by(
        F.struct("page_number", offset.alias("page_offset")), F.struct(overlap.alias("o"), (-F.col("page_number")).alias("p"))
    )
    return (
        shown.join(laid, ["doc_id", "_bucket"])
        .where((bottom > F.col("_top")) & (F.col("top") < F.col("_bottom")))
        .groupBy("doc_id", "event_id")
        .agg(best.alias("_best"))
        .select("doc_id", "event_id", "_best.*")
    )


def segment_anchors(segments: DataFrame) -> DataFrame:
    """Place of each segment on its page in per cent, shared out by text length."""
    on_page = Window.partitionBy("doc_id", "page")
    before = on_page.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    weighted = segments.withColumn("_w", F.greatest(F.lit(40), T.utf16_len(F.col("text"))))
    placed = weighted.withColumn("_total", F.sum("_w").over(on_page)).withColumn(
        "_before", F.coalesce(F.sum("_w").over(before), F.lit(0))
    )
    start = F.col("_before") / F.col("_total")
    end = (F.col("_before") + F.col("_w")) / F.col("_total")
    return placed.select(
        "doc_id", "page", "segment_id",
        (start * 100).alias("top"), F.greatest(F.lit(0.5), (end - start) * 100).alias("height"),
    )


def overlapping_segments(rects: DataFrame, boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """Segments whose box touches a rectangle of a selection.

    ``rects(doc_id, page, selection_id, left, top, right, bottom)``,
    ``boxes(doc_id, page, segment_id, left, top, right, bottom)``.
    """
    def spread(rows):
        rows_of = F.sequence(F.floor(F.col("top") / cell), F.floor(F.col("bottom") / cell))
        return rows.withColumn("_row", F.explode(rows_of))

    drawn = spread(rects.where((F.col("right") > F.col("left")) & (F.col("bottom") > F.col("top")))).select(
        "doc_id", "page", "_row", "selection_id",
        *[F.col(c).alias("_" + c) for c in ("left", "top", "right", "bottom")],
    )
    touch = (
        (F.col("_bottom") >= F.col("top")) & (F.col("_top") <= F.col("bottom"))
        & (F.col("_right") >= F.col("left")) & (F.col("_left") <= F.col("right"))
    )
    return (
        drawn.join(spread(boxes), ["doc_id", "page", "_row"])
        .where(touch)
        .select("doc_id", "page", "selection_id", "segment_id")
        .distinct()
    )


def monotonicity(alignments: DataFrame, bounds: DataFrame, order: DataFrame, leader: str = "source") -> DataFrame:
    """Per document: whether the mapped middles of consecutive segments never go back.

    ``order(doc_id, segment_id, ordinal)`` lists the leader's segments.
    """
    middles = (
        bounds.where(F.col("side") == leader)
        .join(order, ["doc_id", "segment_id"])
        .select("doc_id", "segment_id", "ordinal", ((F.col("start") + F.col("end")) / 2).alias("position"))
    )
    mapped = map_positions(middles, alignment_intervals(alignments, bounds, leader))
    stepped = previous(mapped, ["doc_id"], "ordinal", {"mapped": "_before"})
    forward = F.coalesce(F.col("mapped") >= F.col("_before"), F.col("_before").isNull())
    return stepped.groupBy("doc_id").agg(
        F.count("*").alias("segments"),
        F.bool_and(F.col("mapped").isNotNull()).alias("all_mapped"),
        F.bool_and(F.col("mapped").isNotNull() & forward).alias("monotone"),
    )
