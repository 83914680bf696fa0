"""Positioned text of printed pages: notes, gaps, runs, lines and reading order.

``text_items(doc_id, page, text, x, y, width, height, source_index)`` and
``page_space(doc_id, page, width, height)``; y grows upwards.  A printed page is
the unit of work: it is small, and there are many of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitext import constants as K
from bitext.functions import text as T

PAGE = ["doc_id", "page"]
L = K.LAYOUT


def clean_text_items(raw: DataFrame) -> DataFrame:
    """Items with text and finite geometry; no item is lower than one unit."""
    finite = ~T.is_blank(T.or_empty(F.col("text")))
    for c in ("x", "y", "width", "height"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return raw.where(finite).withColumn("height", F.greatest(F.col("height"), F.lit(1.0)))


def page_visual_counts(draw_ops: DataFrame) -> DataFrame:
    """Images and vector paths drawn on each page, from ``draw_ops(doc_id, page, op)``."""
    return draw_ops.groupBy(*PAGE).agg(
        F.count_if(F.col("op").isin(K.IMAGE_OPERATORS)).alias("image_count"),
        F.count_if(F.col("op") == K.PATH_OPERATOR).alias("vector_path_count"),
    )


def upper_percentile(values: Column, q: float) -> Column:
    """The value at rank ceil((n - 1) q), counted from 0, of a page's values."""
    ordered = F.array_sort(F.collect_list(values))
    return F.element_at(ordered, (F.ceil((F.count(values) - 1) * q) + 1).cast("int"))


def page_heights(items: DataFrame) -> DataFrame:
    """Median and upper quartile of the text height of each page."""
    height = F.greatest(F.col("height"), F.lit(1.0))
    return items.groupBy(*PAGE).agg(
        F.median(height).alias("median_height"),
        upper_percentile(height, L["note_quantile"]).alias("typical_height"),
    )


def merge_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Islands of overlapping ``(start, end)`` ranges per key, with the gap before each."""
    low, high = F.least("start", "end"), F.greatest("start", "end")
    before_row = Window.unboundedPreceding
    ordered = Window.partitionBy(*keys).orderBy("_lo", "_hi")
    reach = F.max("_hi").over(ordered.rowsBetween(before_row, -1))
    opens = F.when(F.col("_reach").isNull() | (F.col("_lo") > F.col("_reach")), 1).otherwise(0)
    # Of equal ranges the one that opens an island comes first.
    numbered = Window.partitionBy(*keys).orderBy("_lo", "_hi", F.desc("_opens"))
    islands = (
        ranges.select(*keys, low.alias("_lo"), high.alias("_hi"))
        .withColumn("_reach", reach)
        .withColumn("_opens", opens)
        .withColumn("island", F.sum("_opens").over(numbered.rowsBetween(before_row, 0)))
        .groupBy(*keys, "island")
        .agg(F.min("_lo").alias("start"), F.max("_hi").alias("end"))
    )
    before = F.lag("end").over(Window.partitionBy(*keys).orderBy("island"))
    return islands.withColumn("gap", F.col("start") - before)


def largest_gap(islands: DataFrame, keys: list[str], minimum: float | Column) -> DataFrame:
    """The widest gap per key that is at least ``minimum``, the first of equals, and its middle."""
    minimum = minimum if isinstance(minimum, Column) else F.lit(minimum)
    wide = islands.where(F.col("gap") >= minimum)
    return wide.groupBy(*keys).agg(
        F.max_by(F.struct("gap", (F.col("start") - F.col("gap")).alias("_from")),
                 F.struct("gap", (-F.col("island")).alias("_i"))).alias("_g")
    ).select(*keys, F.col("_g.gap").alias("gap"), (F.col("_g._from") + F.col("_g.gap") / 2).alias("position"))


def source_runs(items: DataFrame) -> DataFrame:
    """Number the runs of items in source order: a jump up the page opens a new one."""
    typical = page_heights(items).select(*PAGE, "median_height")
    order = Window.partitionBy(*PAGE).orderBy("source_index")
    jump = F.col("y") - F.lag("y").over(order) > F.col("median_height") * L["run_reset"]
    return (
        items.join(typical, PAGE)
        .withColumn("_jump", F.coalesce(jump, F.lit(False)).cast("int"))
        .withColumn("run", F.sum("_jump").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_jump", "median_height")
    )


def line_texts(items: DataFrame) -> DataFrame:
    """Text of each line of ``items``, which also carry ``line``: pieces joined, blanks where due."""
    on_line = Window.partitionBy(*PAGE, "line").orderBy("x", "source_index")
    was = {c: F.lag(c).over(on_line) for c in ("text", "x", "y", "width", "height")}
    now = {c: F.col(c) for c in was}
    wide = lambda o: o["width"] / F.greatest(T.utf16_len(T.trim(o["text"])), F.lit(1))
    gap = now["x"] - (was["x"] + was["width"])
    raised = (
        (was["height"] <= now["height"] * L["tall"])
        & (now["height"] < was["height"] * L["short"])
        & (now["y"] > was["y"] + was["height"] * L["raised"])
    )
    apart = raised | (gap > F.greatest(F.lit(L["space_gap"]), F.least(wide(was), wide(now)) * L["space_gap_character"]))
    spaced = (
        F.when(was["text"].isNull(), False)
        .when(T.matches(T.trim(now["text"]), K.NO_SPACE_BEFORE), False)
        .when(T.matches(T.trim(was["text"]), K.NO_SPACE_AFTER), False)
        .when(T.matches(was["text"], r"\s\z"), True)
        .otherwise(apart)
    )
    pieces = F.array_sort(F.collect_list(F.struct("x", "source_index", "_piece")))
    return (
        items.where(~T.is_blank(F.col("text")))
        .withColumn("_piece", F.concat(F.when(spaced, " ").otherwise(""), T.trim(F.col("text"))))
        .groupBy(*PAGE, "line")
        .agg(F.array_join(F.transform(pieces, lambda p: p["_piece"]), "").alias("text"))
    )


# --------------------------------------------------------------- reading order
#
# Cutting a page into regions and gathering lines depend on the outcome of every
# step before, which is why one page at a time is handled in Python.  Partitions
# arrive sorted, so that a page is a slice of a batch.


class _Page:
    """Geometry and text of one page."""

    def __init__(self, columns: dict[str, np.ndarray]):
        self.text = columns["text"].tolist()
        self.x, self.y, self.w, self.h = (columns[c] for c in ("x", "y", "width", "height"))
        self.index = columns["source_index"]
        self.page_width, self.page_height = float(columns["page_width"][0]), float(columns["page_height"][0])
        self.middle_x, self.middle_y = self.x + self.w / 2, self.y + self.h / 2
        self.size = np.maximum(self.h, 1.0)


def _widest_gap(starts, lengths, minimum):
    """(size, middle) of the widest gap of a projection, or None."""
    lo, hi = np.minimum(starts, starts + lengths), np.maximum(starts, starts + lengths)
    order = np.argsort(lo, kind="stable")
    reach = np.maximum.accumulate(hi[order])
    gaps = lo[order][1:] - reach[:-1]
    at = int(np.argmax(gaps))
    return (gaps[at], reach[at] + gaps[at] / 2) if gaps[at] >= minimum else None


def _cut(page: _Page, ids: np.ndarray):
    """The two parts of a region in reading order, or None."""
    typical = float(np.median(page.size[ids]))
    across = max(L["horizontal_gap_height"] * typical, L["horizontal_gap_page"] * page.page_height)
    down = max(L["vertical_gap_height"] * typical, L["vertical_gap_page"] * page.page_width)
    horizontal = _widest_gap(page.y[ids], page.h[ids], across)
    vertical = _widest_gap(page.x[ids], page.w[ids], down)
    weight_h = horizontal[0] / across * L["horizontal_bias"] if horizontal else -1.0
    weight_v = vertical[0] / down if vertical else -1.0
    if weight_h < 0 and weight_v < 0:
        return None
    if weight_h >= weight_v:
        parts = ids[page.middle_y[ids] > horizontal[1]], ids[page.middle_y[ids] < horizontal[1]]
    else:
        parts = ids[page.middle_x[ids] < vertical[1]], ids[page.middle_x[ids] > vertical[1]]
    return parts if len(parts[0]) and len(parts[1]) else None


def _regions(page: _Page, ids: np.ndarray) -> Iterator[np.ndarray]:
    todo = [(ids, 0)]
    while todo:
        region, depth = todo.pop()
        parts = _cut(page, region) if len(region) > 1 and depth < L["max_depth"] else None
        if parts:
            todo += [(parts[1], depth + 1), (parts[0], depth + 1)]
        else:
            yield region


SWEEP = 8  # items after which lines that are out of reach are left behind


def _gather_lines(page: _Page, ids: np.ndarray) -> list[dict]:
    """Lines of a region: items from top to bottom, each to the line it sits on.

    The items sweep down the region, so that a line is left behind once no later item can reach it: none begins
    high enough to overlap it, none is large enough to be near its base.
    """
    lines: list[dict] = []
    order = ids[np.lexsort((page.index[ids], page.x[ids], -page.y[ids]))]
    overlap, slack, share, tall = L["line_overlap"], L["line_distance"], L["line_distance_height"], L["tall"]
    # The largest item that is still to come.
    sizes = np.maximum.accumulate(page.size[order][::-1])[::-1].tolist()
    heights_left = np.maximum.accumulate(page.h[order][::-1])[::-1].tolist()
    reached: list[dict] = []
    for k, (i, y, h, size) in enumerate(zip(order.tolist(), page.y[order].tolist(), page.h[order].tolist(), page.size[order].tolist())):
        top = y + size
        near = []
        if k % SWEEP == 0:
            far, above = max(slack, share * heights_left[k]), y + sizes[k]
            reached = [line for line in reached if line["base"] - y <= far or line["low"] <= above]
        for line in reached:
            low, high = line["low"], line["high"]
            span = high - low if high - low < h else h
            away = abs(line["base"] - y)
            shared = (high if high < top else top) - (low if low > y else y)
            if shared >= overlap * span or away <= slack or away <= share * span:
                near.append((away, line))
        if not near:
            lines.append({"items": [i], "low": y, "high": top, "base": y, "ref": h})
            reached.append(lines[-1])
            continue
        if any(h > tall * line["ref"] for _, line in near):
            line = max(near, key=lambda n: n[1]["base"])[1]
        else:
            line = min(near, key=lambda n: n[0])[1]
        line["items"].append(i)
        if h <= tall * line["ref"]:
            line["low"], line["high"] = min(line["low"], y), max(line["high"], top)
            heights = page.h[line["items"]]
            usual = (heights >= L["short"] * line["ref"]) & (heights <= tall * line["ref"])
            if usual.any():
                line["base"] = float(np.median(page.y[line["items"]][usual]))
                line["ref"] = float(np.median(heights[usual]))
    return lines


def _apart(page: _Page, a: int, b: int) -> bool:
    """Whether a blank belongs between two neighbours on a line."""
    left, right = page.text[a].strip(), page.text[b].strip()
    if re.match(K.NO_SPACE_BEFORE, right) or re.search(K.NO_SPACE_AFTER, left):
        return False
    if page.text[a][-1:].isspace():
        return True
    raised = (
        page.h[a] <= L["tall"] * page.h[b]
        and page.h[b] < L["short"] * page.h[a]
        and page.y[b] > page.y[a] + L["raised"] * page.h[a]
    )
    narrow = min(page.w[a] / max(len(left), 1), page.w[b] / max(len(right), 1))
    gap = page.x[b] - (page.x[a] + page.w[a])
    return bool(raised or gap > max(L["space_gap"], L["space_gap_character"] * narrow))


def _render(page: _Page, ids: np.ndarray) -> str:
    lines = _gather_lines(page, ids)
    left = lambda items: page.x[items[0]] if len(items) == 1 else page.x[items].min()
    lines.sort(key=lambda line: (-line["base"], left(line["items"])))
    texts = []
    for line in lines:
        if len(line["items"]) == 1:
            texts.append(page.text[line["items"][0]].strip())
            continue
        members = np.array(line["items"])
        members = members[np.lexsort((page.index[members], page.x[members]))]
        pieces = [page.text[members[0]].strip()]
        for a, b in zip(members, members[1:]):
            pieces.append((" " if _apart(page, a, b) else "") + page.text[b].strip())
        texts.append("".join(pieces))
    return "\n".join(texts)


def _region_text(page: _Page, ids: np.ndarray) -> str:
    ordered = ids[np.argsort(page.index[ids], kind="stable")]
    jumps = np.diff(page.y[ordered]) > L["run_reset"] * float(np.median(page.size[ids]))
    return "\n\n".join(_render(page, run) for run in np.split(ordered, np.flatnonzero(jumps) + 1))


def _note_top(page: _Page) -> float | None:
    """Top of a page's notes: small text low on the page, an item or a line of which opens with a label."""
    ordered = np.sort(page.size)
    typical = ordered[int(np.ceil((len(ordered) - 1) * L["note_quantile"]))]
    small = np.flatnonzero((page.middle_y <= L["note_band"] * page.page_height) & (page.h <= L["note_height"] * typical))
    label = re.compile(K.NOTE_LABEL.replace(r"\z", r"\Z"))
    if len(small) and (
        any(label.match(page.text[i].strip()) for i in small)
        or any(label.match(line) for line in _render(page, small).split("\n"))
    ):
        return float((page.y[small] + page.h[small]).max() + L["note_margin"] * typical)
    return None


def _page_text(page: _Page) -> str:
    everything = np.arange(len(page.text))
    top = _note_top(page)
    bands = [everything] if top is None else [everything[page.middle_y > top], everything[page.middle_y <= top]]
    texts = ["\n\n".join(_region_text(page, r) for r in _regions(page, band)) for band in bands if len(band)]
    if len(bands) == 2:
        texts.insert(len(texts) - 1, K.FOOTNOTE_BOUNDARY)
    return "\n\n".join(texts).strip()


def _pages_of(frames: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole pages from batches sorted by page; a page may lie across batches."""
    rest = None
    for frame in frames:
        columns = {c: frame[c].to_numpy() for c in frame.columns}
        if rest is not None:
            columns = {c: np.concatenate([rest[c], values]) for c, values in columns.items()}
        doc, number = columns["doc_id"], columns["page"]
        starts = np.flatnonzero((doc[1:] != doc[:-1]) | (number[1:] != number[:-1])) + 1
        edges = [0, *starts.tolist()]
        for a, b in zip(edges, edges[1:]):
            yield {c: values[a:b] for c, values in columns.items()}
        rest = {c: values[edges[-1]:] for c, values in columns.items()}
    if rest is not None and len(rest["page"]):
        yield rest


def _per_page(read, name: str):
    """A function for ``mapInPandas`` that makes one row of every page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for columns in _pages_of(frame for frame in frames if len(frame)):
            rows.append((columns["doc_id"][0], columns["page"][0], read(_Page(columns))))
            if len(rows) == 1000:
                yield pd.DataFrame(rows, columns=[*PAGE, name])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=[*PAGE, name])

    return run


def _sorted_pages(items: DataFrame, space: DataFrame) -> DataFrame:
    """Items with the size of their page, whole pages together and in order."""
    sized = items.join(
        space.select(*PAGE, F.col("width").alias("page_width"), F.col("height").alias("page_height")), PAGE
    )
    return (
        sized.select(*PAGE, "text", "x", "y", "width", "height", "source_index", "page_width", "page_height")
        .repartition(*PAGE)
        .sortWithinPartitions(*PAGE, "source_index")
    )


def footnote_top(items: DataFrame, space: DataFrame) -> DataFrame:
    """Top of the notes of each page, null without notes.

    Notes are small text low on the page, an item or a line of which opens with a label.
    """
    return _sorted_pages(items, space).mapInPandas(
        _per_page(_note_top, "footnote_top"), "doc_id long, page int, footnote_top double"
    )


def reading_order(items: DataFrame, space: DataFrame) -> DataFrame:
    """``(doc_id, page, text)``: the items of every page as text in reading order.

    Regions are separated by blank lines; notes follow the boundary marker.
    """
    return _sorted_pages(clean_text_items(items), space).mapInPandas(
        _per_page(_page_text, "text"), "doc_id long, page int, text string"
    )
