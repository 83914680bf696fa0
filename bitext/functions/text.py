"""Column functions over text.  All of them are native Spark expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitext import constants as K
from bitext.constants import java_pattern


def lit_re(pattern: str) -> Column:
    return F.lit(java_pattern(pattern))


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, lit_re(pattern))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, lit_re(pattern))


def replace(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, java_pattern(pattern), replacement)


def tokens(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, lit_re(pattern), F.lit(group))


#: Characters that mark where something was found; texts that hold one take a slower way.
MARK, INNER = "\x1e", "\x1f"


def holds_mark(c: Column) -> Column:
    """Whether a text holds a character that ``marked`` uses."""
    return F.contains(c, F.lit(MARK)) | F.contains(c, F.lit(INNER))


def marked(c: Column, pattern: str, inside: str = "$0") -> Column:
    """The text with ``inside`` between two marks for every match: one search, with a pattern that is compiled once."""
    return replace(c, pattern, MARK + inside + MARK)


def cut_at(c: Column, mark: str) -> Column:
    """The parts between single characters, without a regular expression."""
    return F.split(c, mark, -1)


def odd(parts: Column) -> Column:
    """Of gap, match, gap, …, gap the matches."""
    return F.filter(parts, lambda p, i: i % 2 == 1)


def even(parts: Column) -> Column:
    """Of gap, match, gap, …, gap the gaps."""
    return F.filter(parts, lambda p, i: i % 2 == 0)


def pieces(c: Column, pattern: str) -> Column:
    """Gap, match, gap, match, …, gap: the text cut around every match, by one search."""
    gaps = F.split(c, java_pattern(pattern), -1)
    slow = F.filter(F.flatten(F.zip_with(gaps, tokens(c, pattern), lambda g, t: F.array(g, t))), lambda p: p.isNotNull())
    return F.when(holds_mark(c), slow).otherwise(cut_at(marked(c, pattern), MARK))


def formatted(pattern: str, number: Column) -> Column:
    """A format with one ``%05d``, and a number from 0: as ``format_string`` gives it, at a fraction of its time."""
    before, after = pattern.split("%05d")
    digits = number.cast("string")
    return F.concat(F.lit(before), F.lpad(digits, F.greatest(F.length(digits), F.lit(5)), "0"), F.lit(after))


def utf16_len(c: Column) -> Column:
    """Length in UTF-16 code units, the unit of every character limit."""
    encoded = F.shiftright(F.octet_length(F.encode(c, "UTF-16BE")), 1)
    return F.when(F.octet_length(c) == F.length(c), F.length(c)).otherwise(encoded)


def fits(c: Column, limit: int) -> Column:
    """Whether a text has at most ``limit`` code units; most texts need no recoding for that."""
    return (F.octet_length(c) <= limit) | (utf16_len(c) <= limit)


def trim(c: Column) -> Column:
    """Strip every kind of white space, not only blanks.  A text that begins and ends with plain characters stays."""
    plain = lambda end: F.ascii(end(c, F.lit(1))).between(0x21, 0x7E)
    return F.when(plain(F.left) & plain(F.right), c).otherwise(_stripped(c))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, K.NOT_PLAIN + "(?:^" + K.WS + "+|" + K.WS + r"+\z)", "")


def is_blank(c: Column) -> Column:
    return ~F.regexp_like(c, F.lit(K.NOT_WS))


def collapse(c: Column) -> Column:
    """White space runs to one blank, ends stripped."""
    return F.trim(F.regexp_replace(c, K.WS_RUN, " "))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def usable_text(text: Column) -> Column:
    """Whether the text layer of a page can be used without recognition."""
    compact = F.regexp_replace(text, K.WS + "+", "")
    size = utf16_len(compact)
    letters = F.length(compact) - F.length(F.regexp_replace(compact, r"\p{L}+", ""))
    undecoded = F.length(compact) - F.length(F.translate(compact, "\ufffd", ""))
    return (
        (size >= 80)
        & (count(text, K.USABLE_WORD) >= 12)
        & (letters / size >= 0.45)
        & (undecoded / size < 0.02)
    )


def unwrap(text: Column) -> Column:
    """Line ends to LF, soft hyphens dropped, words broken at a line end joined."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.replace(text, F.lit("\u00ad"), F.lit(""))
    return F.regexp_replace(text, K.HYPHEN_BREAK, "")


def with_collapsed_lines(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add ``out``: ``unwrap`` of the text with every line collapsed.  Patterns run only where plain search finds cause.

    Every step is a column that is used more than once, so that Spark does not copy one into the next.
    """
    c = F.col(out)
    holds = lambda *texts: functools.reduce(Column.__or__, [F.contains(c, F.lit(t)) for t in texts])
    where = lambda found, changed: F.when(found, changed).otherwise(c)
    special = F.octet_length(c) != F.length(c)
    feed = F.lit("\n")
    return (
        df.withColumn(out, F.col(column))
        .withColumn(out, where(holds("\r"), F.regexp_replace(c, r"\r\n?", "\n")))
        .withColumn(out, where(special, F.replace(c, F.lit("\u00ad"), F.lit(""))))
        .withColumn(out, where(holds("-\n"), F.regexp_replace(c, K.HYPHEN_BREAK, "")))
        .withColumn(out, where(special | holds("  ", "\t", "\x0b", "\f"), F.regexp_replace(c, K.WS_RUN_IN_LINE, " ")))
        .withColumn(out, where(holds(" \n", "\n "), F.replace(F.replace(c, F.lit(" \n"), feed), F.lit("\n "), feed)))
    )


def normalize_page(text: Column) -> Column:
    """Paragraphs of a page, each on one line, separated by a blank line."""
    paragraphs = F.split(unwrap(text), "\n" + K.WS + "*\n+")
    return F.array_join(
        F.filter(F.transform(paragraphs, collapse), lambda p: p != ""), "\n\n"
    )


def looks_like_citation(text: Column) -> Column:
    return matches(text, K.CITATION)


def is_figure_caption(text: Column) -> Column:
    return matches(text, K.FIGURE_CAPTION)


def is_table_caption(text: Column) -> Column:
    return matches(text, K.TABLE_CAPTION)


def is_display_equation(text: Column) -> Column:
    symbolic = (
        fits(text, K.EQUATION_MAX_CHARACTERS)
        & matches(text, K.EQUATION_RELATION_RANGE)
        & matches(text, K.EQUATION_RELATION)
        & (count(text, K.EQUATION_SIGNAL) >= 2)
        & (count(text, K.EQUATION_WORD) <= K.EQUATION_MAX_WORDS)
    )
    return matches(text, K.EQUATION_LABEL) | matches(text, K.EQUATION_DELIMITED) | symbolic


def is_heading(text: Column) -> Column:
    # The cheapest first; a text of that many bytes may have more words.
    many = (F.octet_length(text) >= 2 * K.HEADING_MAX_WORDS) & matches(text, K.MANY_WORDS)
    return (
        fits(text, K.HEADING_MAX_CHARACTERS)
        & ~F.right(text, F.lit(1)).isin(K.HEADING_END)
        & ~many
        & ~matches(text, K.HEADING_EXCLUDED)
    )


def classify_block(text: Column) -> Column:
    signs = fits(text, K.EQUATION_MAX_CHARACTERS) & matches(text, K.EQUATION_RELATION_RANGE)
    plain = ~matches(text, K.MARKED_START) & ~signs
    return (
        F.when(plain, F.when(is_heading(text), "heading").otherwise("paragraph"))
        .when(is_figure_caption(text), "figure-marker")
        .when(is_table_caption(text), "table-marker")
        .when(is_display_equation(text), "equation-marker")
        .when(is_heading(text), "heading")
        .otherwise("paragraph")
    )


def strip_reader_metadata(markdown: Column) -> Column:
    return F.regexp_replace(markdown, K.READER_METADATA, "")


def numeric_tokens(text: Column) -> Column:
    return tokens(text, K.NUMBER)


def _none_without(text: Column, signs: list[str], found: Column) -> Column:
    """``found``, an array, of texts that hold one of ``signs``; of others it is empty, which a plain search tells."""
    lacks = functools.reduce(Column.__and__, [~F.contains(text, F.lit(s)) for s in signs])
    return F.when(lacks, F.array().cast("array<string>")).otherwise(found)


def reference_tokens(text: Column) -> Column:
    return _none_without(text, [":", "@"], tokens(text, K.REFERENCE))


def math_placeholders(text: Column) -> Column:
    return _none_without(text, ["⟦"], tokens(text, K.MATH_PLACEHOLDER))


def stable_placeholders(text: Column) -> Column:
    """Placeholders in canonical form, whatever brackets they came back with."""
    found = F.transform(
        tokens(text, K.STABLE_PLACEHOLDER, 1),
        lambda t: F.concat(F.lit("[["), t, F.lit("]]")),
    )
    return _none_without(text, ["NUMBER_", "REFERENCE_"], found)


def sentences(text: Column) -> Column:
    """Sentences of the collapsed text; joining them with a blank gives it back."""
    return F.filter(
        F.split(collapse(text), K.SENTENCE_BREAK), lambda s: s != ""
    )


def sentence_groups(
    text: Column,
    minimum: int = K.MIN_GROUP_CHARACTERS,
    maximum: int = K.MAX_GROUP_CHARACTERS,
) -> Column:
    """Neighbouring sentences merged so that no group but a lone one is short."""
    state = "struct<groups:array<string>,open:string>"
    start = F.struct(
        F.array().cast("array<string>").alias("groups"), F.lit(None).cast("string").alias("open")
    ).cast(state)

    def step(acc, sentence):
        joined = F.concat(acc["open"], F.lit(" "), sentence)
        extend = (utf16_len(acc["open"]) < minimum) | (
            (utf16_len(sentence) < minimum) & (utf16_len(joined) <= maximum)
        )
        return (
            F.when(acc["open"].isNull(), F.struct(acc["groups"].alias("groups"), sentence.alias("open")))
            .when(extend, F.struct(acc["groups"].alias("groups"), joined.alias("open")))
            .otherwise(
                F.struct(
                    F.array_append(acc["groups"], acc["open"]).alias("groups"),
                    sentence.alias("open"),
                )
            )
            .cast(state)
        )

    def finish(acc):
        done, tail = acc["groups"], acc["open"]
        merged = F.concat(F.element_at(done, -1), F.lit(" "), tail)
        fold_back = (
            (F.size(done) > 0)
            & (utf16_len(tail) < minimum)
            & (utf16_len(merged) <= maximum)
        )
        return (
            F.when(tail.isNull(), done)
            .when(fold_back, F.array_append(F.slice(done, 1, F.size(done) - 1), merged))
            .otherwise(F.array_append(done, tail))
        )

    return F.aggregate(sentences(text), start, step, finish)


def pack_sentences(text: Column, limit: int = K.MAX_SEGMENT_CHARACTERS) -> Column:
    """A text over the limit as chunks of whole sentences, packed greedily."""
    state = "struct<chunks:array<string>,open:string,size:int>"
    start = F.struct(
        F.array().cast("array<string>").alias("chunks"),
        F.lit(None).cast("string").alias("open"),
        F.lit(0).alias("size"),
    ).cast(state)

    def step(acc, sentence):
        n = utf16_len(sentence)
        return (
            F.when(
                acc["open"].isNull(),
                F.struct(acc["chunks"].alias("chunks"), sentence.alias("open"), n.alias("size")),
            )
            .when(
                acc["size"] + n + 1 > limit,
                F.struct(
                    F.array_append(acc["chunks"], acc["open"]).alias("chunks"),
                    sentence.alias("open"),
                    n.alias("size"),
                ),
            )
            .otherwise(
                F.struct(
                    acc["chunks"].alias("chunks"),
                    F.concat(acc["open"], F.lit(" "), sentence).alias("open"),
                    (acc["size"] + n + 1).alias("size"),
                )
            )
            .cast(state)
        )

    packed = F.aggregate(
        sentences(text),
        start,
        step,
        lambda acc: F.when(acc["open"].isNull(), acc["chunks"]).otherwise(
            F.array_append(acc["chunks"], acc["open"])
        ),
    )
    return F.when(fits(text, limit), F.array(text)).otherwise(packed)
