"""Pages to typed segments, segments to batches and back to text.

The work on a page stays inside its row: lines, blocks, notes and chunks are
arrays of that row, so no rows move until segments get their document-wide number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitext import constants as K
from bitext.functions import text as T
from bitext.plans.lineage import keep
from bitext.plans.ordered import HOT_ROWS, WIDE_ROWS, group_sizes, kept_with_running, previous, running_total
from bitext.plans.rows import dealt, unfold

BATCH_CHUNK = 4096


def route_pages(native: DataFrame, recognised: DataFrame | None, policy: str = "when-needed") -> DataFrame:
    """Choose the native or the recognised text of every page; pages without text drop out.

    Unless ``policy`` is "never", pages whose own text cannot be used need ``recognised``, which may be empty.
    """
    if policy != "never" and recognised is None:
        raise ValueError('Give the recognised pages, or say policy="never" to keep native text as it is.')
    blank = T.normalize_page(T.or_empty(F.col("text"))) == ""
    usable = T.usable_text(T.normalize_page(T.or_empty(F.col("text"))))
    if policy == "never":
        return native.where(usable | ~blank).withColumn("method", F.lit("native"))
    other = recognised.select("doc_id", "page", F.col("text").alias("_recognised"))
    return (
        native.withColumn("_usable", F.coalesce(usable, F.lit(False)))
        .join(other, ["doc_id", "page"], "left")
        .withColumn("text", F.when(F.col("_usable"), F.col("text")).otherwise(F.col("_recognised")))
        .withColumn("method", F.when(F.col("_usable"), "native").otherwise("ocr"))
        .where(F.col("_usable") | (T.normalize_page(T.or_empty(F.col("text"))) != ""))
        .drop("_usable", "_recognised")
    )


def pages_to_recognise(native: DataFrame) -> DataFrame:
    """Pages whose native text cannot be used: the input of a recognition job."""
    usable = T.usable_text(T.normalize_page(T.or_empty(F.col("text"))))
    return native.where(~F.coalesce(usable, F.lit(False))).select("doc_id", "page")


def _lines_with_kind(text: Column) -> Column:
    """``array<struct<line, kind>>`` of a page, its lines taken one at a time."""
    kind = lambda line: (
        F.when(line == "", "blank")
        .when(line == K.FOOTNOTE_BOUNDARY, "alone")
        .when(T.is_figure_caption(line) | T.is_table_caption(line), "caption")
        .when(T.is_display_equation(line), "alone")
        .otherwise("prose")
    )
    lines = F.transform(F.split(T.unwrap(text), "\n"), T.collapse)
    return F.transform(lines, lambda v: F.struct(v.alias("line"), kind(v).alias("kind")))


def _blocks_by_line(lines: Column) -> Column:
    """The logical blocks of ``_lines_with_kind``, and empty texts."""
    before = F.array_prepend(
        F.slice(lines, F.lit(1), F.size(lines) - 1), F.lit(None).cast("struct<line:string,kind:string>")
    )
    # A prose line goes on with the block above it when that block is prose or a
    # caption; every other line opens a block.  Lines hold no line feed, so that
    # a line feed can stand for "a block opens here".
    piece = lambda now, prev: (
        F.when(now["kind"] == "blank", "")
        .when(
            (now["kind"] == "prose") & F.coalesce(prev["kind"].isin("prose", "caption"), F.lit(False)),
            F.concat(F.lit(" "), now["line"]),
        )
        .otherwise(F.concat(F.lit("\n"), now["line"]))
    )
    return F.split(F.array_join(F.zip_with(lines, before, piece), ""), "\n")


def with_blocks(pages: DataFrame) -> DataFrame:
    """Add ``blocks``: the logical blocks of the page text, in order.

    The lines of a page are searched together, by one pattern over its text that says where a block opens; what a page does
    not hold is told by plain search first.  Patterns do not count code units: where a character has two, lines are taken one
    at a time.
    """
    text, lines, cut = F.col("text"), F.col("_collapsed"), F.col("_cut")
    plain = F.octet_length(text) == F.length(text)
    single = text.isNull() | plain | (T.utf16_len(text) == F.length(text))
    symbolic = F.contains(lines, F.lit("=")) | (~plain & T.matches(lines, K.EQUATION_RELATION_RANGE))
    opened = F.when(symbolic, F.regexp_replace(lines, K.BLOCK_OPENING_OR_SYMBOLIC, "\t$1$2")).otherwise(
        F.regexp_replace(lines, K.BLOCK_OPENING, "\t$1$2")
    )
    # Collapsed lines hold no tabs.  A line that is a block of its own has one line feed more after it, where a block ends too.
    swap = lambda c, old, new: F.replace(c, F.lit(old), F.lit(new))
    blocks = F.split(swap(swap(swap(cut, "\n\t", "\t"), "\n\n", "\t"), "\n", " "), "\t")
    return (
        T.with_collapsed_lines(pages, "text", "_collapsed")
        .withColumn("_lines", F.when(~single, _lines_with_kind(text)))
        .withColumn("_collapsed", F.concat(F.lit("\n\n"), F.btrim("_collapsed", F.lit(" \n"))))
        .withColumn("_cut", opened)
        .withColumn("blocks", F.array_remove(F.when(F.col("_lines").isNull(), blocks).otherwise(_blocks_by_line(F.col("_lines"))), ""))
        .drop("_lines", "_collapsed", "_cut")
    )


def _cut_at_labels(text: Column) -> Column:
    """Text before the first note label, then one element per label."""
    marked = F.regexp_replace(text, K.wide_space(K.FOOTNOTE_LABEL), "$1\n$2$3")
    return F.split(marked, "\n")


def _filled(texts: Column) -> Column:
    return F.filter(F.transform(texts, T.trim), lambda t: t != "")


def _typed(texts: Column, block_type: str | None) -> Column:
    forced = F.lit(block_type).cast("string")
    return F.transform(texts, lambda t: F.struct(t.alias("text"), forced.alias("forced")))


def _unconfirmed_notes(text: Column, pieces: Column) -> Column:
    """The body and the notes of a block that is cut into ``pieces``."""
    notes = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces), F.lit(1)))
    found = (F.size(pieces) > 1) & T.looks_like_citation(F.array_join(notes, ""))
    return F.when(
        found,
        F.concat(
            _typed(_filled(F.slice(pieces, 1, 1)), None),
            _typed(_filled(notes), "footnote"),
        ),
    ).otherwise(_typed(F.array(text), None))


def split_notes(text: Column, confirmed: bool) -> Column:
    """``array<struct<text, forced>>``: the body and the notes found in a block.

    Unconfirmed notes need a citation behind the first label; without one the
    block stays whole.
    """
    pieces = _cut_at_labels(text)
    return _typed(_filled(pieces), "footnote") if confirmed else _unconfirmed_notes(text, pieces)


def with_structure(pages: DataFrame) -> DataFrame:
    """Add ``structure``: blocks with the notes at the foot of the page told apart."""
    size, mark = F.size("blocks"), F.array_position("blocks", K.FOOTNOTE_BOUNDARY).cast("int")
    last = F.when((size > 0) & (mark == 0), _cut_at_labels(F.element_at("blocks", -1)))
    body = F.slice("blocks", F.lit(1), F.greatest(mark - 1, F.lit(0)))
    below = F.slice("blocks", mark + 1, F.greatest(size - mark, F.lit(0)))
    with_mark = F.concat(
        _typed(body, None), F.flatten(F.transform(below, lambda b: split_notes(b, True)))
    )
    without_mark = F.concat(
        _typed(F.slice("blocks", F.lit(1), size - 1), None),
        _unconfirmed_notes(F.element_at("blocks", -1), F.col("_last")),
    )
    empty = _typed(F.array().cast("array<string>"), None)
    return pages.withColumn("_last", last).withColumn(
        "structure", F.when(size == 0, empty).when(mark > 0, with_mark).otherwise(without_mark)
    ).drop("_last")


def with_segments(pages: DataFrame, visual_markers: bool = True) -> DataFrame:
    """Add ``segments``: ``array<struct<text, block_type>>`` of each page."""
    chunks = F.flatten(
        F.transform(
            "structure",
            lambda b: F.transform(
                T.pack_sentences(b["text"]),
                lambda t: F.struct(t.alias("text"), b["forced"].alias("forced")),
            ),
        )
    )
    typed = F.transform(
        "_chunks",
        lambda c: F.struct(
            c["text"].alias("text"),
            F.coalesce(c["forced"], T.classify_block(c["text"])).alias("block_type"),
        ),
    )
    out = (
        with_structure(with_blocks(pages))
        .drop("blocks")
        .withColumn("_chunks", chunks)
        .drop("structure")
        .withColumn("segments", typed)
        .drop("_chunks")
    )
    if not visual_markers or "image_count" not in pages.columns:
        return out
    captioned = F.exists("segments", lambda s: s["block_type"].isin("figure-marker", "table-marker"))
    drawn = F.coalesce(
        (F.col("image_count") >= K.MIN_IMAGES) | (F.col("vector_path_count") >= K.MIN_VECTOR_PATHS),
        F.lit(False),
    )
    marker = F.struct(F.lit(K.VISUAL_TEXT).alias("text"), F.lit("figure-marker").alias("block_type"))
    return out.withColumn(
        "segments",
        F.when(drawn & ~captioned, F.array_append("segments", marker)).otherwise(F.col("segments")),
    )


def segment_pages(pages: DataFrame, visual_markers: bool = True) -> DataFrame:
    """Pages to segments, numbered through the document in page order.

    Numbering needs the segment counts of the pages before: segmented pages are written once, and the
    counts alone are read to be added up.
    """
    paged = with_segments(pages, visual_markers).select("doc_id", "page", "method", "segments")
    placed = kept_with_running(paged, ["doc_id"], "page", {"_offset": F.size("segments")})
    return (
        unfold(placed, "segments", "_s", "_i")
        .withColumn("ordinal", (F.col("_offset") + F.col("_i") + 1).cast("int"))
        .select(
            "doc_id",
            F.format_string(K.SEGMENT_ID, "ordinal").alias("segment_id"),
            "ordinal",
            "page",
            F.col("_s.block_type").alias("block_type"),
            F.col("_s.text").alias("text"),
            F.col("method").alias("extraction_method"),
        )
    )


# ------------------------------------------------------------------- batches
#
# Greedy packing is sequential, but a batch never reaches more than twelve
# segments ahead.  A chunk of a document is therefore described completely by
# twelve entry points: where the packing leaves the chunk, and how many batches
# it opened, when its first batch opens at segment 0, 1, … 11.  Chunks are
# summarised in parallel, the summaries are chained, and the ids are filled in
# in parallel again.


# A segment travels as one number: its ordinal, and below it its size.  The first
# chunk of a document is entered at 0, so that only documents of more than one
# chunk are summarised and chained.

ORDINAL_BITS = 32


def _next_start(lengths: np.ndarray, own: int, max_count: int, max_size: int) -> np.ndarray:
    """For each of the ``own`` segments, the segment after a batch that opens there."""
    ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    here = np.arange(own)
    by_size = np.searchsorted(ends, ends[:own] + max_size, side="right") - 1
    return np.clip(np.minimum(by_size, here + max_count), here + 1, len(lengths))


def _sizes(rows: np.ndarray) -> np.ndarray:
    return rows & ((1 << ORDINAL_BITS) - 1)


def _chunk_summary(max_count: int, max_size: int):
    @F.pandas_udf("struct<exits:array<int>,opened:array<int>>")
    def summary(chunks: pd.Series, own: pd.Series) -> pd.DataFrame:
        exits, opened = [], []
        for rows, m in zip(chunks, own):
            step = _next_start(_sizes(rows), m, max_count, max_size)
            leave = np.arange(m + max_count) - m
            count = np.zeros(m + max_count, dtype=np.int32)
            for i in range(m - 1, -1, -1):
                leave[i] = leave[step[i]]
                count[i] = count[step[i]] + 1
            exits.append(leave[:max_count].astype(np.int32))
            opened.append(count[:max_count])
        return pd.DataFrame({"exits": exits, "opened": opened})

    return summary


def _chain():
    @F.pandas_udf("array<struct<chunk:bigint,entry:int,base:int>>")
    def chain(chunks: pd.Series) -> pd.Series:
        chained = []
        for rows in chunks:
            entry, base, out = 0, 0, []
            for row in rows:
                out.append({"chunk": row["_chunk"], "entry": entry, "base": base})
                entry, base = int(row["exits"][entry]), base + int(row["opened"][entry])
            chained.append(out)
        return pd.Series(chained)

    return chain


def _fill(max_count: int, max_size: int):
    @F.pandas_udf("array<bigint>")
    def ids(chunks: pd.Series, own: pd.Series, entry: pd.Series, base: pd.Series) -> pd.Series:
        out = []
        for rows, m, first, start in zip(chunks, own, entry, base):
            rows, found = rows[:m], []
            batch, count, size = start - 1, 0, 0
            for i, n in enumerate(_sizes(rows).tolist()):
                if i == first or (i > first and (count >= max_count or size + n > max_size)):
                    batch, count, size = batch + 1, 0, 0
                count, size = count + 1, size + n
                found.append(batch)
            out.append((rows >> ORDINAL_BITS << ORDINAL_BITS) + np.array(found, dtype=np.int64))
        return pd.Series(out)

    return ids


def _chunks(placed: DataFrame, chunk: int, max_count: int) -> DataFrame:
    """A row per chunk: its segments in order, and how many of them are its own.

    The first segments of a chunk also go to the chunk before, whose last batch may take them.
    """
    own = F.floor(F.col("_at") / chunk)
    homes = F.when((F.col("_at") % chunk < max_count) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    return (
        placed.select("doc_id", "_row", own.alias("_own"), F.explode(homes).alias("_chunk"))
        .groupBy("doc_id", "_chunk")
        .agg(F.sort_array(F.collect_list("_row")).alias("_rows"), F.count_if(F.col("_own") == F.col("_chunk")).cast("int").alias("_m"))
    )


def _entries(chunks: DataFrame, max_count: int, max_size: int) -> DataFrame:
    """``(doc_id, _chunk, entry, base)``: where a chunk's first own batch opens, and its id.

    One small row per chunk: a document of a billion segments has 250,000 of them.
    """
    return (
        chunks.select("doc_id", "_chunk", _chunk_summary(max_count, max_size)("_rows", "_m").alias("_s"))
        .select("doc_id", "_chunk", "_s.exits", "_s.opened")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("_chunk", "exits", "opened"))).alias("_all"))
        .select("doc_id", F.explode_outer(_chain()("_all")).alias("_e"))
        .select("doc_id", F.col("_e.chunk").alias("_chunk"), "_e.entry", "_e.base")
    )


def batch_segments(
    segments: DataFrame,
    max_count: int = K.MAX_BATCH_SEGMENTS,
    max_size: int = K.MAX_BATCH_CHARACTERS,
    chunk: int = BATCH_CHUNK,
    gapless: bool = False,
) -> DataFrame:
    """``(doc_id, ordinal, batch_id)``: segments packed in order, ids from 0 per document.

    ``chunk`` has to be at least ``max_count``.  ``gapless`` says that the ordinals of every document are 1, 2, 3, … as
    ``segment_pages`` numbers them, so that they need not be counted.  ``segments`` is read more than once.
    """
    ordinal, size = F.col("ordinal").cast("int"), F.coalesce(T.utf16_len(F.col("text")), F.lit(0))
    narrow = segments.select("doc_id", "ordinal", (F.shiftleft(ordinal.cast("long"), ORDINAL_BITS) + size).alias("_row"))
    counted = F.col("ordinal").cast("long") - 1
    place = lambda df: df.withColumn("_at", counted) if gapless else running_total(df, ["doc_id"], "ordinal", F.lit(1), "_at")
    many = segments.where(counted >= chunk).select("doc_id").distinct() if gapless else (
        segments.groupBy("doc_id").agg(F.count("*").alias("_n")).where(F.col("_n") > chunk).select("doc_id")
    )
    # At most one document for ``chunk`` segments; written, so that Spark knows how few they are.
    many = keep(many)
    chunks = _chunks(place(narrow), chunk, max_count)
    if many.isEmpty():
        chunks = chunks.withColumns({"entry": F.lit(0), "base": F.lit(0)})
    else:
        chained = _entries(_chunks(place(narrow.join(many, "doc_id", "left_semi")), chunk, max_count), max_count, max_size)
        chunks = chunks.join(chained, ["doc_id", "_chunk"], "left").withColumns(
            {"entry": F.coalesce("entry", F.lit(0)), "base": F.coalesce("base", F.lit(0))}
        )
    return (
        chunks.select("doc_id", F.explode_outer(_fill(max_count, max_size)("_rows", "_m", "entry", "base")).alias("_id"))
        .select(
            "doc_id", F.shiftright("_id", ORDINAL_BITS).cast("int").cast(segments.schema["ordinal"].dataType).alias("ordinal"),
            F.col("_id").bitwiseAND(F.lit((1 << ORDINAL_BITS) - 1)).cast("int").alias("batch_id"),
        )
    )


# ---------------------------------------------------------------------- text


def source_text(pages: DataFrame) -> DataFrame:
    """``(doc_id, page, text)``: the readable source text, one row per page.

    A document's text is its pages in order with a blank line between them;
    ``sources.artifacts.write_pages_as_text`` writes it that way.
    """
    title = F.format_string(K.PAGE_TITLE, F.col("page").cast("long"), F.upper("method"))
    body = F.replace(
        T.normalize_page(F.col("text")), F.lit(K.FOOTNOTE_BOUNDARY), F.lit(K.FOOTNOTE_MARKER)
    )
    return pages.select("doc_id", "page", F.concat(title, F.lit("\n\n"), body).alias("text"))


def _with_words(segments: DataFrame, words: DataFrame, by_document: int | None) -> DataFrame:
    """``segments`` left joined with ``words`` by doc_id and segment_id.

    ``by_document``, the number of segments, deals both sides by document, once, so that what goes on by document or by page
    moves no row again.
    """
    if by_document is None:
        return segments.join(words, ["doc_id", "segment_id"], "left")
    own = [c for c in segments.columns if c not in ("doc_id", "segment_id")]
    sides = segments.select("doc_id", "segment_id", F.struct(*own).alias("_segment")).unionByName(
        # Null keys meet nothing; a word that is null is a row of its own.
        words.where(F.col("doc_id").isNotNull() & F.col("segment_id").isNotNull()).select("doc_id", "segment_id", F.struct("_words").alias("_word")),
        allowMissingColumns=True,
    )
    met = dealt(sides.repartition("doc_id"), by_document, WIDE_ROWS, "doc_id").groupBy("doc_id", "segment_id").agg(
        F.collect_list("_segment").alias("_segments"), F.collect_list("_word").alias("_found")
    )
    each = met.select("doc_id", "segment_id", "_found", F.explode("_segments").alias("_segment"))
    return each.select("doc_id", "segment_id", "_segment.*", F.explode_outer("_found").alias("_word")).select(
        "doc_id", "segment_id", *own, "_word._words"
    )


def markdown_pieces(segments: DataFrame, translations: DataFrame, by_document: int | None = None) -> DataFrame:
    """``(doc_id, page, ordinal, piece)``: the Markdown each segment contributes.

    ``by_document`` is the number of segments where those of every document fit into a task.
    """
    words = translations.select(
        "doc_id", "segment_id", T.trim(F.col("text")).alias("_words")
    )
    on_page = Window.partitionBy("doc_id", "page").orderBy("ordinal")
    words_of = T.or_empty(F.col("_words"))
    page = F.col("page").cast("long")
    body = (
        F.when(F.col("block_type") == "heading", F.concat(F.lit("## "), words_of))
        .when(F.col("block_type") == "figure-marker", F.concat(F.format_string(K.FIGURE_QUOTE, page), words_of))
        .when(F.col("block_type") == "table-marker", F.concat(F.format_string(K.TABLE_QUOTE, page), words_of))
        .otherwise(words_of)
    )
    opens_notes = (F.col("block_type") == "footnote") & (
        F.coalesce(F.lag("block_type").over(on_page), F.lit("")) != "footnote"
    )
    opens_page = F.row_number().over(on_page) == 1
    narrow = segments.select("doc_id", "segment_id", "page", "ordinal", "block_type")
    return _with_words(narrow, words, by_document).select(
        "doc_id",
        "page",
        "ordinal",
        F.concat(
            F.when(opens_page, F.concat(F.format_string(K.PAGE_MARKER, page), F.lit("\n\n"))).otherwise(""),
            F.when(opens_notes, F.lit(K.FOOTNOTE_MARKER + "\n\n")).otherwise(""),
            body,
        ).alias("piece"),
    )


def translated_markdown(
    segments: DataFrame, translations: DataFrame, hot_rows: int = HOT_ROWS // 4, sizes: tuple[int, int] | None = None
) -> DataFrame:
    """``(doc_id, page, markdown)``: the translated text, one row per page.

    Where the segments of the largest document fit into a task, texts are dealt once, by document; else to their segment and
    then to their page.  ``sizes``, the segments of the largest document and all, saves the measurement where they, or bounds
    of them, are known.
    """
    largest, count = sizes or group_sizes(segments, ["doc_id"])
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "piece")))
    return (
        markdown_pieces(segments, translations, by_document=count if largest <= hot_rows else None)
        .groupBy("doc_id", "page")
        .agg(F.array_join(F.transform(ordered, lambda r: r["piece"]), "\n\n").alias("markdown"))
    )


def boundaries(segments: DataFrame) -> DataFrame:
    """Add ``page_boundary`` (the new page, else null) and ``footnote_boundary``."""
    lagged = previous(
        segments, ["doc_id"], "ordinal", {"page": "_page", "block_type": "_type"}
    )
    same_page = F.col("page").eqNullSafe(F.col("_page"))
    return (
        lagged.withColumn("page_boundary", F.when(~same_page, F.col("page")))
        .withColumn(
            "footnote_boundary",
            (F.col("block_type") == "footnote")
            & (~F.col("_type").eqNullSafe(F.lit("footnote")) | ~same_page),
        )
        .drop("_page", "_type")
    )
