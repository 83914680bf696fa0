"""Values a translation must not touch: swapped for placeholders, checked, put back.

Placeholders are numbered through the document.  Only the running number needs
other rows; finding and rewriting stay inside the segment's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitext import constants as K
from bitext.functions import text as T
from bitext.operators import segment
from bitext.plans.ordered import kept_with_running
from bitext.plans.rows import unfold


def interleave(gaps: Column, fills: Column) -> Column:
    """The text made of gap, fill, gap, fill, …, gap."""
    return F.array_join(
        F.zip_with(gaps, fills, lambda g, f: F.concat(T.or_empty(g), T.or_empty(f))), ""
    )


# ---------------------------------------------------------------------- math


def inferred_latex(value: Column) -> Column:
    """LaTeX for a piece of notation, null when its form says nothing."""
    greek = F.create_map(*[F.lit(x) for pair in K.GREEK_LATEX.items() for x in pair])
    inner = lambda n: F.substr(value, F.lit(n + 1), F.length(value) - 2 * n)
    wrapped = lambda a, b: F.startswith(value, F.lit(a)) & F.endswith(value, F.lit(b))
    script = T.replace(value, r"\s+", "")
    script = F.regexp_replace(script, r"_([A-Za-z0-9]+)\z", "_{$1}")
    script = F.regexp_replace(script, r"\^([A-Za-z0-9]+)\z", "^{$1}")
    relation = value
    for sign, latex in K.RELATION_LATEX.items():
        relation = F.replace(relation, F.lit(sign), F.lit(latex))
    relation = F.regexp_replace(relation, r"^([^,]*),", "$1.")
    return (
        F.when(wrapped("$$", "$$") | wrapped("\\(", "\\)") | wrapped("\\[", "\\]"), inner(2))
        .when(wrapped("$", "$"), inner(1))
        .when(greek[value].isNotNull(), greek[value])
        .when(T.matches(value, r"^[A-Za-z]\s*[_^]"), script)
        .when(T.matches(value, r"^[pPrR]\s*(?:<|>|=|≤|≥|≠|≈)"), relation)
    )


def _is_whole(block_type: Column) -> Column:
    """An equation segment is one display object."""
    return block_type == "equation-marker"


def _math_described(found: Column, whole: Column, offset: Column) -> Column:
    def describe(one: Column, i: Column) -> Column:
        value, latex = one["source"], one["latex"]
        number = (offset + i + 1).cast("int")
        display = whole | F.startswith(value, F.lit("$$")) | F.startswith(value, F.lit("\\["))
        return F.struct(
            T.formatted(K.MATH_ID, number).alias("math_id"),
            F.when(display, "display").otherwise("inline").alias("type"),
            F.when(display, T.formatted(K.MATH_DISPLAY_FORMAT, number))
            .otherwise(T.formatted(K.MATH_INLINE_FORMAT, number)).alias("placeholder"),
            value.alias("source"),
            latex.alias("latex"),
            F.when(F.coalesce(latex, F.lit("")) != "", 0.95)
            .when(whole, 0.55).otherwise(0.65).alias("confidence"),
        )

    # A lambda's expressions are computed wherever they stand: LaTeX is inferred first, once for each piece.
    inferred = F.transform(found, lambda value: F.struct(value.alias("source"), inferred_latex(value).alias("latex")))
    return F.transform(inferred, describe)


def math_pieces(text: Column, block_type: Column) -> Column:
    """Gap, notation, gap, …, gap of a segment."""
    empty = F.lit("")
    return (
        F.when(_is_whole(block_type), F.array(empty, text, empty))
        .when(~F.regexp_like(text, F.lit(K.MATH_SIGN)), F.array(text))
        .otherwise(T.pieces(text, K.MATH))
    )


def protect_math(segments: DataFrame) -> DataFrame:
    """Replace notation by placeholders; ``math`` lists what was replaced.

    An equation segment is one display object; elsewhere each piece of notation
    is an object of its own.
    """
    whole = _is_whole(F.col("block_type"))
    found = segments.withColumn("_pieces", math_pieces(F.col("text"), F.col("block_type")))
    numbered = kept_with_running(found, ["doc_id"], "ordinal", {"_offset": F.floor(F.size("_pieces") / 2)})
    return (
        numbered.withColumn("math", _math_described(T.odd(F.col("_pieces")), whole, F.col("_offset")))
        .withColumn("text", interleave(T.even(F.col("_pieces")), F.col("math.placeholder")))
        .drop("_pieces", "_offset")
    )


def math_objects(protected: DataFrame) -> DataFrame:
    """One row per protected piece of notation."""
    return unfold(protected.select("doc_id", "segment_id", "page", "math"), "math", "_m").select(
        "doc_id", "_m.math_id", "segment_id", "_m.type", "page", "_m.placeholder", "_m.source",
        "_m.latex", "_m.confidence", F.lit(None).cast("string").alias("original_crop"),
    )


def _sequences_differ(source: DataFrame, translations: DataFrame, sequence) -> DataFrame:
    """Source segments whose translation does not repeat a sequence found in the source."""
    received = translations.select("doc_id", "segment_id", sequence(F.col("text")).alias("received"))
    none = F.array().cast("array<string>")
    return (
        source.select("doc_id", "segment_id", sequence(F.col("text")).alias("expected"))
        .join(received, ["doc_id", "segment_id"], "left")
        .withColumn("received", F.coalesce("received", none))
        .where(F.col("expected") != F.col("received"))
    )


def math_integrity(source: DataFrame, translations: DataFrame) -> DataFrame:
    """Segments whose math placeholders are not all back, in order."""
    return _sequences_differ(source, translations, T.math_placeholders)


def _markdown_math(o: Column) -> Column:
    literal = F.replace(o["source"], F.lit("`"), F.lit("\\`"))
    trusted = (F.coalesce(o["latex"], F.lit("")) != "") & (o["confidence"] >= 0.9)
    display = o["type"] == "display"
    fence = lambda a, x, b: F.concat(F.lit(a), x, F.lit(b))
    return (
        F.when(trusted & display, fence("\n\n$$", o["latex"], "$$\n\n"))
        .when(trusted, fence("$", o["latex"], "$"))
        .when(display, fence("\n\n~~~text\n", literal, "\n~~~\n\n"))
        .otherwise(fence("`", literal, "`"))
    )


def _swapped(text: Column, swap: Column, pattern: str, name_group: int) -> Column:
    """A text with every placeholder replaced by its value in ``swap``, where it has one."""
    slow = interleave(
        F.split(text, pattern, -1),
        F.zip_with(T.tokens(text, pattern, name_group), T.tokens(text, pattern), lambda name, found: F.coalesce(swap[name], found)),
    )
    parts = T.cut_at(T.marked(text, pattern, f"$0{T.INNER}${name_group}"), T.MARK)
    # A found part is the whole placeholder and its name.
    value = lambda p: F.coalesce(swap[F.substring_index(p, T.INNER, -1)], F.substring_index(p, T.INNER, 1))
    fast = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, value(p)).otherwise(p)), "")
    return F.when(swap.isNull(), text).when(T.holds_mark(text), slow).otherwise(fast)


def _restore(
    translations: DataFrame, values: DataFrame, pattern: str, name_group: int
) -> DataFrame:
    """Swap every placeholder of ``values`` for its replacement, in one pass over each text.

    ``values`` has doc_id, segment_id, name and replacement; a segment's values
    are as many as its text holds, so that the list per segment stays a cell.
    """
    lookup = values.groupBy("doc_id", "segment_id").agg(
        F.map_from_entries(F.collect_list(F.struct("name", "replacement"))).alias("_swap")
    )
    joined = translations.join(lookup, ["doc_id", "segment_id"], "left")
    for column in ("text", "base_text", "reviewed_text"):
        if column in translations.columns:
            joined = joined.withColumn(column, _swapped(F.col(column), F.col("_swap"), pattern, name_group))
    return joined.select(*translations.columns)


def restore_math(translations: DataFrame, objects: DataFrame, mode: str = "plain") -> DataFrame:
    """Put notation back: as it was, or as Markdown with LaTeX where that is certain."""
    o = {c: F.col(c) for c in ("source", "latex", "confidence", "type")}
    replacement = _markdown_math(o) if mode == "markdown" else F.col("source")
    values = objects.select(
        "doc_id", "segment_id", F.col("placeholder").alias("name"), replacement.alias("replacement")
    )
    return _restore(translations, values, K.MATH_PLACEHOLDER, 0)


# ------------------------------------------------------- numbers, references


TOKEN = "(?iu)" + K.EXISTING_MARKER + "|" + K.STABLE_VALUE
# Of a text without colon and at sign: no address and no reference by name can match, and every match begins with one of few characters.
TOKEN_UNNAMED = r"(?iu)(?-iu:(?=[-+0-9\[⟦]))(?:" + K.EXISTING_MARKER + "|" + K.WORD_START + K.DOI_NUMBER + "|" + K.NUMBER + ")"


def _named(text: Column) -> Column:
    return F.contains(text, F.lit(":")) | F.contains(text, F.lit("@"))


def _bare(text: Column) -> Column:
    """Whether a text that is not ``_named`` has no token: every number and every marker holds a digit."""
    return ~F.regexp_like(text, F.lit("[0-9]"))


def _is_marker(value: Column) -> Column:
    return F.substr(value, F.lit(1), F.lit(1)).isin("⟦", "[") & F.regexp_like(value, F.lit(r"^(?:" + K.EXISTING_MARKER + r")\z"))


def token_pieces(text: Column) -> Column:
    """Gap, match, gap, …, gap; numbers, references and the placeholders that are already there match."""
    return (
        F.when(_named(text), T.pieces(text, TOKEN)).when(_bare(text), F.array(text)).otherwise(T.pieces(text, TOKEN_UNNAMED))
    )


def _tokens_within(pieces: Column) -> Column:
    """How many numbers and references there are among the pieces."""
    return F.size(F.filter(pieces, lambda p, i: (i % 2 == 1) & ~_is_marker(p)))


def _with_tokens(numbered: DataFrame, offset: Column) -> DataFrame:
    """Rows with ``_tokens`` (what ``token_pieces`` gives of their text) to rows with ``tokens`` and the text rewritten."""

    def describe(value: Column, place: Column) -> Column:
        number = (offset + place).cast("int")
        # Every reference holds one of these characters; a plain search spares most values the pattern.
        signed = F.contains(value, F.lit("/")) | F.contains(value, F.lit(":")) | F.contains(value, F.lit("@"))
        described = lambda form, kind: F.struct(
            T.formatted(form, number).alias("placeholder"), value.alias("source"), F.lit(kind).alias("kind")
        )
        return (
            F.when(place == 0, F.struct(value.alias("placeholder"), value.alias("source"), F.lit("").alias("kind")))
            .when(signed & F.regexp_like(value, F.lit(K.STABLE_REFERENCE)), described(K.REFERENCE_FORMAT, "reference"))
            .otherwise(described(K.NUMBER_FORMAT, "number"))
        )

    # The place of a value among the values, 0 for a placeholder that stays.
    state = "struct<used:int,places:array<int>>"
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("places")).cast(state)
    places = F.aggregate(
        "_values",
        start,
        lambda acc, v: F.when(
            _is_marker(v),
            F.struct(acc["used"].alias("used"), F.array_append(acc["places"], F.lit(0)).alias("places")),
        ).otherwise(
            F.struct((acc["used"] + 1).alias("used"), F.array_append(acc["places"], acc["used"] + 1).alias("places"))
        ).cast(state),
        lambda acc: acc["places"],
    )
    # Most texts hold no placeholder yet: places are 1, 2, 3, …
    mixed = F.col("_mixed")
    each = F.when(mixed, F.zip_with("_values", places, describe)).otherwise(F.transform("_values", lambda v, i: describe(v, i + 1)))
    return (
        numbered.withColumn("_values", T.odd(F.col("_tokens")))
        .withColumn("_mixed", F.exists("_values", _is_marker))
        .withColumn("_each", each)
        .withColumn("tokens", F.when(mixed, F.filter("_each", lambda t: t["kind"] != "")).otherwise(F.col("_each")))
        .withColumn(
            "text",
            F.when(F.size("_tokens") == 1, F.element_at("_tokens", 1)).otherwise(interleave(T.even(F.col("_tokens")), F.col("_each.placeholder"))),
        )
        .drop("_tokens", "_values", "_mixed", "_each")
    )


def protect_tokens(segments: DataFrame) -> DataFrame:
    """Replace numbers and references by placeholders; ``tokens`` lists what was replaced.

    Placeholders that are already in the text stay as they are.
    """
    found = segments.withColumn("_tokens", token_pieces(F.col("text")))
    numbered = kept_with_running(found, ["doc_id"], "ordinal", {"_offset": _tokens_within(F.col("_tokens"))})
    return _with_tokens(numbered, F.col("_offset")).drop("_offset")


def _any_math_replaced(pieces: Column) -> Column:
    """The text of ``math_pieces`` with a placeholder of any number for each piece of notation: its tokens are as many as with the right ones."""
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, K.MATH_UNNUMBERED).otherwise(p)), "")


def _tokens_marked(plain: Column) -> Column:
    """``plain`` with its tokens marked, and its notation as one character; null where the text holds such marks itself."""
    found = F.when(_named(plain), T.marked(plain, TOKEN)).when(_bare(plain), plain).otherwise(T.marked(plain, TOKEN_UNNAMED))
    return F.when(~T.holds_mark(plain), F.replace(found, F.lit(K.MATH_UNNUMBERED), F.lit(T.INNER)))


def _with_text_and_tokens(numbered: DataFrame, offset: Column) -> DataFrame:
    """``text`` with ``math`` and tokens replaced, from ``_pieces`` (of notation) and ``_marked`` (its tokens, found before).

    Tokens that were found around unnumbered notation are those around the numbered: only its digits differ.  Where the text
    looks like marked or unnumbered notation itself, tokens are searched again.
    """
    marks = F.col("math.placeholder")
    again = token_pieces(interleave(T.even(F.col("_pieces")), marks))
    known = T.cut_at(interleave(T.cut_at(F.col("_marked"), T.INNER), marks), T.MARK)
    found, none = F.col("_marked").isNotNull(), F.size("math") == 0
    as_found = found & (F.size("math") == F.size(T.cut_at(F.col("_marked"), T.INNER)) - 1)
    bare = found & none & ~F.contains("_marked", F.lit(T.INNER))
    tokens = numbered.withColumn("_tokens", F.when(bare, T.cut_at(F.col("_marked"), T.MARK)).when(as_found, known).otherwise(again))
    return _with_tokens(tokens, offset).drop("_pieces", "_marked")


def protect_values(segments: DataFrame) -> DataFrame:
    """Both protections in one: ``protect_math`` and then ``protect_tokens``.

    How many values a segment has of either kind does not depend on their numbers; so both are searched once, and one
    running sum numbers both.
    """
    block = F.col("block_type")
    found = segments.withColumn("_pieces", math_pieces(F.col("text"), block)).withColumn("_plain", _any_math_replaced(F.col("_pieces")))
    found = found.withColumn("_marked", _tokens_marked(F.col("_plain"))).withColumn("_count", _count_marked(F.col("_marked"), F.col("_plain")))
    numbered = kept_with_running(
        found.drop("_plain"), ["doc_id"], "ordinal", {"_math_offset": F.floor(F.size("_pieces") / 2), "_offset": F.col("_count")}
    )
    safe = numbered.withColumn("math", _math_described(T.odd(F.col("_pieces")), _is_whole(block), F.col("_math_offset")))
    return _with_text_and_tokens(safe.drop("_math_offset", "_count"), F.col("_offset")).drop("_offset")


def _count_marked(marked: Column, plain: Column) -> Column:
    """How many numbers and references a text has; one mark for notation is a placeholder."""
    known = F.filter(T.cut_at(marked, T.MARK), lambda p, i: (i % 2 == 1) & (p != T.INNER) & ~_is_marker(p))
    return F.when(marked.isNotNull(), F.size(known)).otherwise(_tokens_within(token_pieces(plain)))


def protected_pages(pages: DataFrame, visual_markers: bool = True) -> DataFrame:
    """Pages to numbered segments with both kinds of values protected: the columns of ``segment_pages``, source, math and tokens.

    A page has three counts, of its segments, its notation and its tokens; one running sum over these numbers gives all
    numbers of the document, so the pages are segmented and searched once.  ``source`` is the text before.
    """
    paged = segment.with_segments(pages, visual_markers).select("doc_id", "page", "method", "segments")
    paged = paged.withColumn("_math", F.transform("segments", lambda s: math_pieces(s["text"], s["block_type"])))
    paged = paged.withColumn("_plain", F.transform("_math", _any_math_replaced))
    paged = paged.withColumn("_tokens", F.transform("_plain", _tokens_marked))
    paged = paged.withColumn("_counts", F.zip_with("_tokens", "_plain", _count_marked)).drop("_plain")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    sizes = F.transform("_math", lambda m: F.floor(F.size(m) / 2))
    numbered = kept_with_running(
        paged.withColumn("_sizes", sizes), ["doc_id"], "page", {"_at": F.size("segments"), "_math_at": total("_sizes"), "_tokens_at": total("_counts")}
    )
    zipped = F.arrays_zip(F.col("segments").alias("s"), F.col("_math").alias("m"), F.col("_tokens").alias("t"))
    each = numbered.select(
        "doc_id", "page", "method", "_at", "_math_at", "_tokens_at", "_sizes", "_counts", F.posexplode(zipped).alias("_i", "_x")
    )
    before = lambda a: total(F.slice(a, F.lit(1), F.col("_i")))
    segments = each.select(
        "doc_id", T.formatted(K.SEGMENT_ID, F.col("_at") + F.col("_i") + 1).alias("segment_id"),
        (F.col("_at") + F.col("_i") + 1).cast("int").alias("ordinal"), "page", F.col("_x.s.block_type").alias("block_type"),
        F.col("_x.s.text").alias("source"), F.col("method").alias("extraction_method"), F.col("_x.m").alias("_pieces"), F.col("_x.t").alias("_marked"),
        (F.col("_math_at") + before("_sizes")).alias("_math_offset"), (F.col("_tokens_at") + before("_counts")).alias("_offset"),
    )
    whole = _is_whole(F.col("block_type"))
    safe = segments.withColumn("math", _math_described(T.odd(F.col("_pieces")), whole, F.col("_math_offset"))).drop("_math_offset")
    return _with_text_and_tokens(safe, F.col("_offset")).drop("_offset")


def stable_tokens(protected: DataFrame) -> DataFrame:
    """One row per protected number or reference."""
    return unfold(protected.select("doc_id", "segment_id", "tokens"), "tokens", "_t").select(
        "doc_id", "segment_id", "_t.placeholder", "_t.source", "_t.kind"
    )


def stable_integrity(source: DataFrame, translations: DataFrame) -> DataFrame:
    """Segments whose number and reference placeholders are not all back, in order."""
    return _sequences_differ(source, translations, T.stable_placeholders)


def annotate_lost(source: DataFrame, translations: DataFrame) -> DataFrame:
    """Append a note with the lost placeholders to translations that changed the sequence."""
    expected = source.select(
        "doc_id", "segment_id", T.stable_placeholders(F.col("text")).alias("_expected")
    )
    received = T.stable_placeholders(F.col("text"))
    lost = F.filter("_expected", lambda p: ~F.array_contains(F.col("_received"), p))
    return (
        translations.withColumn("_received", received)
        .join(expected, ["doc_id", "segment_id"], "left")
        .withColumn(
            "text",
            F.when(
                F.col("_expected") != F.col("_received"),
                F.concat(T.trim(F.col("text")), F.lit(K.LOST_VALUES_NOTE), F.array_join(lost, " ")),
            ).otherwise(F.col("text")),
        )
        .select(*translations.columns)
    )


def restore_tokens(translations: DataFrame, tokens: DataFrame) -> DataFrame:
    """Put numbers and references back, whatever brackets the placeholders came back with."""
    values = tokens.select(
        "doc_id",
        "segment_id",
        F.regexp_extract("placeholder", K.STABLE_PLACEHOLDER, 1).alias("name"),
        F.col("source").alias("replacement"),
    )
    return _restore(translations, values, K.STABLE_PLACEHOLDER, 1)


# ------------------------------------------------------------------- results


def value_preservation(source: DataFrame, translations: DataFrame) -> DataFrame:
    """Segments whose unprotected numbers or references differ from the source's."""
    pair = lambda t: F.concat(
        T.numeric_tokens(t), F.array(F.lit("\n")), T.reference_tokens(t)
    )
    received = translations.select("doc_id", "segment_id", pair(F.col("text")).alias("_received"))
    return (
        source.select("doc_id", "segment_id", pair(F.col("text")).alias("_expected"))
        .join(received, ["doc_id", "segment_id"], "left")
        .where(F.col("_expected") != F.coalesce("_received", pair(F.lit(""))))
        .select("doc_id", "segment_id")
    )


def translation_completeness(source: DataFrame, translations: DataFrame) -> DataFrame:
    """Per document: segments missing, unexpected and blank, and whether it is complete."""
    sides = source.select(
        "doc_id", "segment_id", F.lit(1).alias("s"), F.lit(0).alias("t"), F.lit(0).alias("b")
    ).unionByName(
        translations.select(
            "doc_id", "segment_id", F.lit(0).alias("s"), F.lit(1).alias("t"),
            T.is_blank(T.or_empty(F.col("text"))).cast("int").alias("b"),
        )
    )
    per_segment = sides.groupBy("doc_id", "segment_id").agg(
        F.max("s").alias("s"), F.max("t").alias("t"), F.max("b").alias("b")
    )
    counted = per_segment.groupBy("doc_id").agg(
        F.count_if(F.col("t") == 0).alias("missing"),
        F.count_if(F.col("s") == 0).alias("unexpected"),
        F.sum("b").alias("blank"),
    )
    return counted.withColumn(
        "complete", (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("blank") == 0)
    )
