"""Page text, segments, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitext import constants as K
from bitext.functions import text as T
from bitext.operators import segment as S
from bitext.plans.lineage import keep
from bitext.plans.rows import unfold
from checks import adapters as A
from checks.register import registry
from checks.sql import NL, VIEWS, WS, collapse, count, lit, matches, re2, strip

QUERIES, SQL, check = registry()

# ------------------------------------------------------------------ SQL views
COMPACT = f"regexp_replace(text, {lit(WS)}, '', 'g')"
USABLE = f"""(length({COMPACT}) >= 80 AND {count('text', K.USABLE_WORD)} >= 12
  AND CAST({count(COMPACT, chr(92) + 'p{L}')} AS DOUBLE) / length({COMPACT}) >= 0.45
  AND CAST({count('text', chr(92) + 'x{FFFD}')} AS DOUBLE) / length({COMPACT}) < 0.02)"""


def unwrap(x):
    return (
        f"regexp_replace(regexp_replace(regexp_replace({x}, '\\r\\n?', {NL}, 'g'), '\\x{{00AD}}', '', 'g'),"
        f" '(\\p{{L}})-\\n(\\p{{Ll}})', '\\1\\2', 'g')"
    )


def normalized(x):
    # A separator that no page holds: U+E000 between paragraphs.
    paragraphs = f"string_split(regexp_replace({unwrap(x)}, {lit(chr(92) + 'n' + WS + '*' + chr(92) + 'n+')}, chr(57344), 'g'), chr(57344))"
    return (
        f"array_to_string(list_filter(list_transform({paragraphs}, lambda p: {collapse('p')}),"
        f" lambda p: p <> ''), {NL} || {NL})"
    )


EQUATION = f"""({matches('x', K.EQUATION_LABEL)} OR {matches('x', K.EQUATION_DELIMITED)} OR
  (length(x) <= 260 AND {matches('x', K.EQUATION_RELATION)} AND {count('x', K.EQUATION_SIGNAL)} >= 2
   AND {count('x', K.EQUATION_WORD)} <= 10))"""
CAPTION = f"({matches('x', K.FIGURE_CAPTION)} OR {matches('x', K.TABLE_CAPTION)})"
HEADING = f"""(length(x) <= 140 AND len(string_split_regex(x, {lit(WS + '+')})) <= 16
  AND right(x, 1) NOT IN ('.', '!', '?', ';', ':') AND NOT {matches('x', K.HEADING_EXCLUDED)})"""


def classify(column):
    def on(sql):
        import re as _re

        return _re.sub(r"\bx\b(?!\{)", column, sql)

    return f"""CASE WHEN {on(matches('x', K.FIGURE_CAPTION))} THEN 'figure-marker'
      WHEN {on(matches('x', K.TABLE_CAPTION))} THEN 'table-marker'
      WHEN {on(EQUATION)} THEN 'equation-marker'
      WHEN {on(HEADING)} THEN 'heading' ELSE 'paragraph' END"""


VIEWS["v_lines"] = f"""
SELECT doc_id, page, n, x,
  CASE WHEN x = '' THEN 'blank' WHEN x = {lit(K.FOOTNOTE_BOUNDARY)} THEN 'mark'
       WHEN {CAPTION} THEN 'caption' WHEN {EQUATION} THEN 'equation' ELSE 'prose' END AS kind
FROM (SELECT doc_id, page, n, {collapse('raw')} AS x FROM (
        SELECT doc_id, page, unnest(lines) AS raw, generate_subscripts(lines, 1) AS n
        FROM (SELECT doc_id, page, string_split({unwrap('text')}, {NL}) AS lines FROM v_corpus_pages)))
"""
# The open block is the latest line that is not prose; a caption takes prose in.
VIEWS["v_blocks"] = f"""
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY b) AS block,
       string_agg(x, ' ' ORDER BY n) AS x
FROM (SELECT doc_id, page, n, x, kind,
             sum(CASE WHEN kind <> 'prose' THEN 1
                      WHEN mode = 'caption' OR before = 'prose' THEN 0 ELSE 1 END)
               OVER (PARTITION BY doc_id, page ORDER BY n) AS b
      FROM (SELECT *, lag(kind) OVER w AS before,
                   last_value(CASE WHEN kind <> 'prose' THEN kind END IGNORE NULLS)
                     OVER (PARTITION BY doc_id, page ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mode
            FROM v_lines WINDOW w AS (PARTITION BY doc_id, page ORDER BY n)))
WHERE kind <> 'blank'
GROUP BY doc_id, page, b
"""
LABELLED = (
    f"string_split(regexp_replace(x, {re2(K.FOOTNOTE_LABEL.replace('(?=', '('))}, "
    f"'\\1' || {NL} || '\\2\\3\\4', 'g'), {NL})"
)
VIEWS["v_structure"] = f"""
SELECT doc_id, page, block, part, x, forced FROM (
  SELECT doc_id, page, block, unnest(texts) AS x, generate_subscripts(texts, 1) AS part,
         unnest(types) AS forced
  FROM (
    SELECT doc_id, page, block,
      CASE WHEN mark IS NOT NULL AND block < mark THEN [x]
           WHEN mark IS NOT NULL THEN list_transform(pieces, lambda p: {strip('p')})
           WHEN block = last AND noted THEN list_transform(pieces, lambda p: {strip('p')})
           ELSE [x] END AS texts,
      CASE WHEN mark IS NOT NULL AND block < mark THEN [NULL::VARCHAR]
           WHEN mark IS NOT NULL THEN list_transform(pieces, lambda p: 'footnote')
           WHEN block = last AND noted
             THEN list_prepend(NULL::VARCHAR, list_transform(pieces[2:], lambda p: 'footnote'))
           ELSE [NULL::VARCHAR] END AS types
    FROM (
      SELECT *, len(pieces) > 1 AND {matches("array_to_string(pieces[2:], '')", K.CITATION)} AS noted
      FROM (SELECT doc_id, page, block, x, {LABELLED} AS pieces,
                   min(CASE WHEN x = {lit(K.FOOTNOTE_BOUNDARY)} THEN block END) OVER (PARTITION BY doc_id, page) AS mark,
                   max(block) OVER (PARTITION BY doc_id, page) AS last
            FROM v_blocks))
    WHERE mark IS NULL OR block <> mark))
WHERE x <> ''
"""
# Sentences end at . ! ? with an optional closing mark, before white space.
CUT = f"regexp_replace({{x}}, {lit('([.!?](?:[' + chr(34) + '”’' + chr(39) + ')' + chr(92) + ']])?) ')}, '\\1' || {NL}, 'g')"


def sentences(x):
    return f"list_filter(string_split({CUT.format(x=collapse(x))}, {NL}), lambda s: s <> '')"


def packed(x):
    start = "{'done': []::VARCHAR[], 'cur': NULL::VARCHAR}"
    return f"""list_reduce(
      list_transform({sentences(x)}, lambda s: {{'done': []::VARCHAR[], 'cur': s}}),
      lambda a, s: CASE
        WHEN a.cur IS NULL THEN {{'done': a.done, 'cur': s.cur}}
        WHEN length(a.cur) + length(s.cur) + 1 > 1400 THEN {{'done': list_append(a.done, a.cur), 'cur': s.cur}}
        ELSE {{'done': a.done, 'cur': a.cur || ' ' || s.cur}} END,
      {start})"""


VIEWS["v_chunks"] = f"""
SELECT doc_id, page, block, part, forced, unnest(texts) AS x, generate_subscripts(texts, 1) AS chunk FROM (
  SELECT doc_id, page, block, part, forced, [x] AS texts FROM v_structure WHERE length(x) <= 1400
  UNION ALL
  SELECT doc_id, page, block, part, forced,
         CASE WHEN p.cur IS NULL THEN p.done ELSE list_append(p.done, p.cur) END AS texts
  FROM (SELECT *, {packed('x')} AS p FROM v_structure WHERE length(x) > 1400))
"""
VIEWS["v_typed"] = f"""
SELECT doc_id, page, block, part, chunk, x AS text,
       coalesce(forced, {classify('x')}) AS block_type
FROM v_chunks
"""
VIEWS["v_marked"] = f"""
SELECT doc_id, page, block, part, chunk, text, block_type FROM v_typed
UNION ALL
SELECT doc_id, page, 1000000, 0, 0, {lit(K.VISUAL_TEXT)}, 'figure-marker'
FROM v_corpus_pages p
WHERE (image_count >= 2 OR vector_path_count >= 24) AND NOT EXISTS (
  SELECT 1 FROM v_typed t WHERE t.doc_id = p.doc_id AND t.page = p.page
     AND t.block_type IN ('figure-marker', 'table-marker'))
"""
VIEWS["v_segments"] = """
SELECT doc_id, printf('seg_%05d', n) AS segment_id, CAST(n AS INT) AS ordinal, page, block_type, text,
       method AS extraction_method
FROM (SELECT m.*, p.method,
             row_number() OVER (PARTITION BY m.doc_id ORDER BY m.page, block, part, chunk) AS n
      FROM v_marked m JOIN v_corpus_pages p ON m.doc_id = p.doc_id AND m.page = p.page)
"""

# -------------------------------------------------------------------- queries


@check("usable_text", f"SELECT doc_id, page, {USABLE} AS usable FROM v_corpus_pages")
def _(spark, folder):
    return A.corpus_pages(spark, folder).select(
        "doc_id", "page", T.usable_text(F.col("text")).alias("usable")
    )


@check("normalize_pages", f"SELECT doc_id, page, {normalized('text')} AS text FROM v_corpus_pages")
def _(spark, folder):
    return A.corpus_pages(spark, folder).select(
        "doc_id", "page", T.normalize_page(F.col("text")).alias("text")
    )


# Short pages stand for failing text layers; the recognised text of a page is its text after a prefix.
@check(
    "route_pages",
    f"""SELECT doc_id, page, CASE WHEN usable THEN 'native' ELSE 'ocr' END AS method,
               CASE WHEN usable THEN text ELSE 'ocr ' || text END AS text
        FROM (SELECT *, {USABLE.replace('text', 'norm')} AS usable
              FROM (SELECT *, {normalized('text')} AS norm FROM v_corpus_pages))
        WHERE usable OR norm <> ''""",
)
def _(spark, folder):
    native = A.corpus_pages(spark, folder).select("doc_id", "page", "text")
    recognised = native.withColumn("text", F.concat(F.lit("ocr "), "text"))
    return S.route_pages(native, recognised).select("doc_id", "page", "method", "text")


@check(
    "pages_to_recognise",
    f"""SELECT doc_id, page FROM (SELECT doc_id, page, {normalized('text')} AS text FROM v_corpus_pages)
        WHERE NOT {USABLE}""",
)
def _(spark, folder):
    return S.pages_to_recognise(A.corpus_pages(spark, folder))


@check("logical_blocks", "SELECT doc_id, page, block, x AS text FROM v_blocks")
def _(spark, folder):
    return unfold(S.with_blocks(A.corpus_pages(spark, folder)), "blocks", "block_text", "_i").withColumn(
        "text", F.col("block_text")
    ).select("doc_id", "page", (F.col("_i") + 1).cast("long").alias("block"), "text")


@check(
    "structured_blocks",
    """SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY block, part) AS part,
              x AS text, coalesce(forced, '') AS forced FROM v_structure""",
)
def _(spark, folder):
    return unfold(
        S.with_structure(S.with_blocks(A.corpus_pages(spark, folder))), "structure", "_s", "_i"
    ).select(
        "doc_id", "page", (F.col("_i") + 1).cast("long").alias("part"), "_s.text",
        F.coalesce("_s.forced", F.lit("")).alias("forced"),
    )


@check(
    "classify_blocks",
    f"""SELECT kind, count(*) AS n, sum(length(x))::BIGINT AS chars
        FROM (SELECT x, {classify('x')} AS kind FROM v_blocks) GROUP BY kind""",
)
def _(spark, folder):
    blocks = unfold(S.with_blocks(A.corpus_pages(spark, folder)), "blocks", "x")
    return blocks.select("x", T.classify_block(F.col("x")).alias("kind")).groupBy("kind").agg(
        F.count("*").alias("n"), F.sum(F.length("x")).alias("chars")
    )


@check(
    "split_long",
    """SELECT doc_id, page, block, part, chunk, x AS text FROM (
         SELECT doc_id, page, chunk, x, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY block, part) AS part,
                block FROM v_chunks)""".replace("block, part, chunk, x AS text FROM", "part, chunk, x AS text FROM"),
)
def _(spark, folder):
    parts = unfold(
        S.with_structure(S.with_blocks(A.corpus_pages(spark, folder))), "structure", "_s", "_i"
    ).select("doc_id", "page", (F.col("_i") + 1).cast("long").alias("part"),
             T.pack_sentences(F.col("_s.text")).alias("chunks"))
    return unfold(parts, "chunks", "text", "_c").select(
        "doc_id", "page", "part", (F.col("_c") + 1).cast("long").alias("chunk"), "text")


@check("segment_pages", "SELECT * FROM v_segments")
def _(spark, folder):
    return S.segment_pages(A.corpus_pages(spark, folder))


@check(
    "visual_markers",
    f"SELECT doc_id, page, segment_id FROM v_segments WHERE text = {lit(K.VISUAL_TEXT)}",
)
def _(spark, folder):
    return S.segment_pages(A.corpus_pages(spark, folder)).where(F.col("text") == K.VISUAL_TEXT).select(
        "doc_id", "page", "segment_id"
    )


VIEWS["v_batched"] = """
SELECT doc_id, unnest(ordinals) AS ordinal, unnest(s.ids) AS batch_id FROM (
  SELECT doc_id, ordinals, list_reduce(
    list_transform(sizes, lambda z: {'ids': []::INT[], 'b': 0, 'c': 0, 'z': z::BIGINT}),
    lambda a, e: CASE
      WHEN a.c > 0 AND (a.c >= 12 OR a.z + e.z > 3200)
        THEN {'ids': list_append(a.ids, a.b + 1), 'b': a.b + 1, 'c': 1, 'z': e.z}
      ELSE {'ids': list_append(a.ids, a.b), 'b': a.b, 'c': a.c + 1, 'z': a.z + e.z} END,
    {'ids': []::INT[], 'b': 0, 'c': 0, 'z': 0::BIGINT}) AS s
  FROM (SELECT doc_id, list(ordinal ORDER BY ordinal) AS ordinals, list(length(text) ORDER BY ordinal) AS sizes
        FROM v_segments GROUP BY doc_id))
"""


@check(
    "batch_segments",
    """SELECT b.doc_id, b.batch_id, count(*) AS segments, sum(length(s.text))::BIGINT AS chars,
              min(b.ordinal) AS first_ordinal
       FROM v_batched b JOIN v_segments s ON b.doc_id = s.doc_id AND b.ordinal = s.ordinal
       GROUP BY b.doc_id, b.batch_id""",
)
def _(spark, folder):
    segments = keep(S.segment_pages(A.corpus_pages(spark, folder)).select("doc_id", "ordinal", "text"))
    return (
        S.batch_segments(segments, gapless=True)
        .join(segments.select("doc_id", "ordinal", F.length("text").alias("_chars")), ["doc_id", "ordinal"])
        .groupBy("doc_id", "batch_id")
        .agg(F.count("*").alias("segments"), F.sum("_chars").alias("chars"),
             F.min("ordinal").alias("first_ordinal"))
    )


@check(
    "source_text",
    f"""SELECT doc_id, page, printf('--- Página %d · %s ---', page, upper(method)) || {NL} || {NL} ||
               replace({normalized('text')}, {lit(K.FOOTNOTE_BOUNDARY)}, {lit(K.FOOTNOTE_MARKER)}) AS text
        FROM v_corpus_pages""",
)
def _(spark, folder):
    return S.source_text(A.corpus_pages(spark, folder))


# The translation of a segment is its text in small letters; headings are left untranslated.
@check(
    "translated_markdown",
    f"""SELECT doc_id, page, string_agg(piece, {NL} || {NL} ORDER BY ordinal) AS markdown FROM (
          SELECT doc_id, page, ordinal,
            CASE WHEN row_number() OVER w = 1 THEN printf('------------[Página N° %d]------------', page) || {NL} || {NL} ELSE '' END ||
            CASE WHEN block_type = 'footnote' AND coalesce(lag(block_type) OVER w, '') <> 'footnote'
                 THEN {lit(K.FOOTNOTE_MARKER)} || {NL} || {NL} ELSE '' END ||
            CASE block_type WHEN 'heading' THEN '## '
              WHEN 'figure-marker' THEN printf('> **Figura o gráfica en el original · página %d.**', page) || {NL} || '>' || {NL} || '> '
              WHEN 'table-marker' THEN printf('> **Tabla en el original · página %d.**', page) || {NL} || '>' || {NL} || '> '
              ELSE '' END ||
            CASE WHEN block_type = 'heading' THEN '' ELSE lower(text) END AS piece
          FROM v_segments WINDOW w AS (PARTITION BY doc_id, page ORDER BY ordinal))
        GROUP BY doc_id, page""",
)
def _(spark, folder):
    segments = keep(S.segment_pages(A.corpus_pages(spark, folder)))
    translations = segments.where("block_type <> 'heading'").select(
        "doc_id", "segment_id", F.lower("text").alias("text")
    )
    return S.translated_markdown(segments, translations)


@check(
    "boundaries",
    """SELECT doc_id, ordinal, CASE WHEN before IS DISTINCT FROM page THEN page END AS page_boundary,
              block_type = 'footnote' AND (kind IS DISTINCT FROM 'footnote' OR before IS DISTINCT FROM page) AS footnote_boundary
       FROM (SELECT *, lag(page) OVER w AS before, lag(block_type) OVER w AS kind
             FROM v_segments WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal))""",
)
def _(spark, folder):
    segments = keep(S.segment_pages(A.corpus_pages(spark, folder)).select(
        "doc_id", "ordinal", "page", "block_type"))
    return S.boundaries(segments).select("doc_id", "ordinal", "page_boundary", "footnote_boundary")


# Pages written with one metadata comment per line, as older files have them.
@check(
    "strip_reader_metadata",
    f"""SELECT doc_id, page, regexp_replace(
          printf('<!-- seg_%05d · página %d -->', page, page) || {NL} || text || {NL} || {NL} ||
          printf('<!-- SEG_%05d · Página %d -->', page + 1, page) || {NL} || 'end',
          {re2(K.READER_METADATA, wide=False)}, '', 'g') AS text FROM v_order_pages""",
)
def _(spark, folder):
    page = F.col("page").cast("long")
    marked = F.concat(
        F.format_string("<!-- seg_%05d · página %d -->\n", page, page), F.col("text"),
        F.format_string("\n\n<!-- SEG_%05d · Página %d -->\nend", page + 1, page),
    )
    return A.order_pages(spark, folder).select(
        "doc_id", "page", T.strip_reader_metadata(marked).alias("text")
    )
