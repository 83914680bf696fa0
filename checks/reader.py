"""Layout, alignments, positions and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext import constants as K
from bitext.functions import text as T
from bitext.operators import align as AL
from bitext.operators import jobs as J
from bitext.operators import layout as LA
from bitext.operators import position as PO
from bitext.plans.lineage import cut
from bitext.plans.rows import unfold
from checks import adapters as A
from checks.register import registry
from checks.segment import sentences
from checks.sql import NL, VIEWS, lit, re2

QUERIES, SQL, check = registry()

# --------------------------------------------------------------------- layout
# Documents printed in two columns of forty rows of sixty characters; the last
# four rows of a column are set small, as notes.
VIEWS["v_items"] = f"""
SELECT doc_id, CAST(i // 80 + 1 AS INT) AS page, CAST(i AS INT) AS source_index,
  CASE WHEN i % 40 = 36 THEN '1. ' ELSE '' END || t AS text,
  CAST(40 + ((i // 40) % 2) * 270 AS DOUBLE) AS x,
  CAST(CASE WHEN i % 40 >= 36 THEN 100 - (i % 40 - 36) * 9 ELSE 760 - (i % 40) * 18 END AS DOUBLE) AS y,
  CAST(length(t) * 4 AS DOUBLE) AS width, CAST(CASE WHEN i % 40 >= 36 THEN 7 ELSE 10 END AS DOUBLE) AS height
FROM (SELECT doc_id, i, substr(text, i * 60 + 1, 60) AS t
      FROM (SELECT doc_id, replace(text, {NL}, ' ') AS text, unnest(range(0, CAST(ceil(length(text) / 60.0) AS BIGINT))) AS i
            FROM documents))
"""


def text_items(spark, folder) -> DataFrame:
    text = F.replace("text", F.lit("\n"), F.lit(" "))
    cut_up = T.tokens(F.col("_t"), r"(?s).{1,60}")  # Java takes a dot ten times faster than a class of two halves
    lined = unfold(
        A.texts(spark, folder, "documents").where(F.length("text") > 0).select("doc_id", "text").withColumn("_t", text).withColumn("_parts", cut_up),
        "_parts", "_part", "_i",
    )
    i, row = F.col("_i"), F.col("_i") % 40
    return lined.select(
        "doc_id", (F.floor(i / 80) + 1).cast("int").alias("page"), i.alias("source_index"),
        F.concat(F.when(row == 36, "1. ").otherwise(""), "_part").alias("text"),
        (F.lit(40) + (F.floor(i / 40) % 2) * 270).cast("double").alias("x"),
        F.when(row >= 36, 100 - (row - 36) * 9).otherwise(760 - row * 18).cast("double").alias("y"),
        (F.length("_part") * 4).cast("double").alias("width"),
        F.when(row >= 36, 7.0).otherwise(10.0).alias("height"),
    )


def page_space(items: DataFrame) -> DataFrame:
    return items.select("doc_id", "page").distinct().select(
        "doc_id", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height")
    )


# Items as a damaged page gives them: blank texts, places that are no numbers or missing, endless widths, flat letters.
VIEWS["v_dirty_items"] = """
SELECT doc_id, page, source_index, CASE WHEN source_index % 29 = 3 THEN ' ' || chr(160) WHEN source_index % 31 = 3 THEN NULL ELSE text END AS text,
  CASE WHEN source_index % 13 = 5 THEN 'nan'::DOUBLE ELSE x END AS x, CASE WHEN source_index % 23 = 5 THEN NULL ELSE y END AS y,
  CASE WHEN source_index % 19 = 5 THEN '-infinity'::DOUBLE ELSE width END AS width, CASE WHEN source_index % 17 = 5 THEN 0.4 ELSE height END AS height
FROM v_items
"""


def dirty_items(spark, folder) -> DataFrame:
    i = F.col("source_index")
    return text_items(spark, folder).withColumns({
        "text": F.when(i % 29 == 3, F.lit(" \u00a0")).when(i % 31 == 3, F.lit(None)).otherwise(F.col("text")),
        "x": F.when(i % 13 == 5, float("nan")).otherwise(F.col("x")), "y": F.when(i % 23 == 5, F.lit(None)).otherwise(F.col("y")),
        "width": F.when(i % 19 == 5, float("-inf")).otherwise(F.col("width")), "height": F.when(i % 17 == 5, 0.4).otherwise(F.col("height")),
    })


@check(
    "clean_text_items",
    """SELECT doc_id, page, source_index, text, x, y, width, greatest(height, 1.0::DOUBLE) AS height FROM v_dirty_items
       WHERE text IS NOT NULL AND trim(replace(text, chr(160), ' ')) <> '' AND NOT isnan(x) AND y IS NOT NULL AND NOT isinf(width)""",
)
def _(spark, folder):
    return LA.clean_text_items(dirty_items(spark, folder)).select("doc_id", "page", "source_index", "text", "x", "y", "width", "height")


@check(
    "page_percentiles",
    """SELECT doc_id, page, median(greatest(height, 1)) AS median_height,
              list_sort(list(greatest(height, 1)))[CAST(ceil((count(*) - 1) * 0.75) AS BIGINT) + 1] AS typical_height
       FROM v_items GROUP BY doc_id, page""",
)
def _(spark, folder):
    return LA.page_heights(text_items(spark, folder))


@check(
    "footnote_top",
    """SELECT doc_id, page, CASE WHEN bool_or(low AND regexp_matches(trim(text), '^(?:\\d{1,3}\\s*[.)]|[*†‡])(?:\\s|$)'))
              THEN max(CASE WHEN low THEN y + height END) + any_value(typical) * 0.35::DOUBLE END AS footnote_top
       FROM (SELECT *, y + height / 2 <= 200 AND height <= typical * 0.86::DOUBLE AS low
             FROM v_items JOIN (SELECT doc_id, page, list_sort(list(greatest(height, 1)))[CAST(ceil((count(*) - 1) * 0.75) AS BIGINT) + 1] AS typical
                                FROM v_items GROUP BY doc_id, page) USING (doc_id, page))
       GROUP BY doc_id, page""",
)
def _(spark, folder):
    items = text_items(spark, folder)
    return LA.footnote_top(items, page_space(items))


VIEWS["v_islands"] = """
SELECT doc_id, page, island, min(y) AS start, max(y + height) AS end FROM (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id, page ORDER BY y, y + height, opens DESC ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, CASE WHEN reach IS NULL OR y > reach THEN 1 ELSE 0 END AS opens FROM (
    SELECT *, max(y + height) OVER (PARTITION BY doc_id, page ORDER BY y, y + height ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
    FROM v_items))) GROUP BY ALL
"""


@check(
    "merge_ranges",
    """SELECT doc_id, page, CAST(island AS BIGINT) AS island, start, "end",
              start - lag("end") OVER (PARTITION BY doc_id, page ORDER BY island) AS gap FROM v_islands""",
)
def _(spark, folder):
    ranges = text_items(spark, folder).select("doc_id", "page", F.col("y").alias("start"), (F.col("y") + F.col("height")).alias("end"))
    return LA.merge_ranges(ranges, ["doc_id", "page"])


@check(
    "largest_gap",
    """SELECT doc_id, page, gap, start - gap + gap / 2 AS position FROM (
         SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY gap DESC, island) AS n FROM (
           SELECT *, start - lag("end") OVER (PARTITION BY doc_id, page ORDER BY island) AS gap FROM v_islands) WHERE gap >= 8) WHERE n = 1""",
)
def _(spark, folder):
    ranges = text_items(spark, folder).select("doc_id", "page", F.col("y").alias("start"), (F.col("y") + F.col("height")).alias("end"))
    return LA.largest_gap(LA.merge_ranges(ranges, ["doc_id", "page"]), ["doc_id", "page"], 8.0)


@check(
    "source_runs",
    """SELECT doc_id, page, source_index, CAST(sum(CASE WHEN y - before > m * 1.5::DOUBLE THEN 1 ELSE 0 END)
                OVER (PARTITION BY doc_id, page ORDER BY source_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
       FROM (SELECT *, lag(y) OVER (PARTITION BY doc_id, page ORDER BY source_index) AS before,
                    median(greatest(height, 1)) OVER (PARTITION BY doc_id, page) AS m FROM v_items)""",
)
def _(spark, folder):
    return LA.source_runs(text_items(spark, folder)).select("doc_id", "page", "source_index", "run")


@check(
    "line_texts",
    """SELECT doc_id, page, line, string_agg(CASE WHEN before IS NULL OR regexp_matches(trim(text), '^[,.;:!?%)\\]}]')
                OR regexp_matches(trim(before), '[(\\[{¿¡]$') THEN '' ELSE ' ' END || trim(text), '' ORDER BY x) AS text
       FROM (SELECT *, y AS line, lag(text) OVER (PARTITION BY doc_id, page, y ORDER BY x) AS before
             FROM v_items WHERE trim(text) <> '') GROUP BY doc_id, page, line""",
)
def _(spark, folder):
    return LA.line_texts(text_items(spark, folder).withColumn("line", F.col("y")))


@check(
    "reading_order",
    f"""SELECT doc_id, page, CASE WHEN max(note) = 1 THEN
          string_agg(col, {NL} || {NL} ORDER BY x) FILTER (note = 0) || {NL} || {NL} || {lit(K.FOOTNOTE_BOUNDARY)} || {NL} || {NL} ||
          string_agg(col, {NL} || {NL} ORDER BY x) FILTER (note = 1)
          ELSE string_agg(col, {NL} || {NL} ORDER BY x) END AS text
        FROM (SELECT doc_id, page, x, (height = 7)::INT AS note, string_agg(trim(text), {NL} ORDER BY source_index) AS col
              FROM v_items WHERE trim(text) <> '' GROUP BY ALL) GROUP BY doc_id, page""",
)
def _(spark, folder):
    items = text_items(spark, folder)
    return LA.reading_order(items, page_space(items))


OPERATORS = ["paintImageXObject", "paintImageMaskXObject", "constructPath", "showText"]


@check(
    "page_visual_counts",
    """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS page,
              sum(CASE WHEN l_returnflag IN ('A', 'R') THEN 1 ELSE 0 END)::BIGINT AS image_count,
              sum(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS vector_path_count
       FROM lineitem GROUP BY ALL""",
)
def _(spark, folder):
    op = (
        F.when(F.col("l_returnflag") == "A", OPERATORS[0]).when(F.col("l_returnflag") == "R", OPERATORS[1])
        .when(F.col("l_linestatus") == "F", OPERATORS[2]).otherwise(OPERATORS[3])
    )
    ops = A.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), op.alias("op")
    )
    return LA.page_visual_counts(ops)


# ---------------------------------------------------------------- alignments
# A conversation is a document: the lines of a user's turn are source segments,
# those of the answer its translations, and the pair of turns is an alignment.
VIEWS["v_turn_lines"] = f"""
SELECT conv_id, turn, role, generate_subscripts(lines, 1) AS line, unnest(lines) AS text
FROM (SELECT conv_id, turn, role, string_split(text, {NL}) AS lines FROM conversations)
"""
VIEWS["v_source"] = """
SELECT conv_id AS doc_id, 's' || turn || '_' || line AS segment_id, CAST(turn * 1000 + line AS INT) AS ordinal,
       CAST(turn // 2 AS INT) AS page, CASE WHEN length(text) < 60 THEN 'heading' ELSE 'paragraph' END AS block_type, text, turn
FROM v_turn_lines WHERE role = 'user' AND text <> ''
"""
VIEWS["v_target"] = """
SELECT conv_id AS doc_id, 't' || turn || '_' || line AS segment_id, CAST(turn * 1000 + line AS INT) AS ordinal, text, turn
FROM v_turn_lines WHERE role = 'assistant' AND text <> ''
"""
VIEWS["v_aligned"] = """
SELECT s.doc_id, 'a' || s.turn AS alignment_id, CAST(s.turn AS INT) AS ordinal, s.ids AS source_ids, t.ids AS target_ids
FROM (SELECT doc_id, turn, list(segment_id ORDER BY ordinal) AS ids FROM v_source GROUP BY ALL) s
JOIN (SELECT doc_id, turn, list(segment_id ORDER BY ordinal) AS ids FROM v_target GROUP BY ALL) t
ON t.doc_id = s.doc_id AND t.turn = s.turn + 1
"""


def _side(spark, folder, role, letter) -> DataFrame:
    lines = F.split("text", "\n")
    turns = A.texts(spark, folder, "conversations").where(F.col("role") == role).withColumn("_lines", lines)
    return unfold(turns.drop("text"), "_lines", "text", "_i").where("text <> ''").select(
        F.col("conv_id").alias("doc_id"),
        F.concat(F.lit(letter), F.col("turn").cast("string"), F.lit("_"), (F.col("_i") + 1).cast("string")).alias("segment_id"),
        (F.col("turn") * 1000 + F.col("_i") + 1).cast("int").alias("ordinal"),
        F.floor(F.col("turn") / 2).cast("int").alias("page"),
        F.when(F.length("text") < 60, "heading").otherwise("paragraph").alias("block_type"),
        "text",
        "turn",
    )


def source_lines(spark, folder) -> DataFrame:
    return _side(spark, folder, "user", "s")


def target_lines(spark, folder) -> DataFrame:
    return _side(spark, folder, "assistant", "t").drop("page", "block_type")


def aligned_turns(spark, folder) -> DataFrame:
    def ids(rows, name, shift):
        listed = F.array_sort(F.collect_list(F.struct("ordinal", "segment_id")))
        return rows.groupBy("doc_id", (F.col("turn") - shift).alias("turn")).agg(listed.alias("_l")).select(
            "doc_id", "turn", F.col("_l.segment_id").alias(name)
        )

    return ids(source_lines(spark, folder), "source_segment_ids", 0).join(
        ids(target_lines(spark, folder), "target_segment_ids", 1), ["doc_id", "turn"]
    ).select(
        "doc_id", F.concat(F.lit("a"), F.col("turn").cast("string")).alias("alignment_id"),
        F.col("turn").cast("int").alias("ordinal"), "source_segment_ids", "target_segment_ids",
        AL.alignment_type(F.size("source_segment_ids"), F.size("target_segment_ids")).alias("type"),
        F.lit("turns").alias("method"), F.lit(0.75).alias("confidence"),
    )


def joined(c):
    return F.array_join(c, ",").alias(c)


@check(
    "identity_alignments",
    """SELECT doc_id, 'al_' || segment_id AS alignment_id, segment_id AS source_segment_ids, segment_id AS target_segment_ids,
              '1:1' AS type, 'generated-id' AS method FROM v_source""",
)
def _(spark, folder):
    return AL.identity_alignments(source_lines(spark, folder)).select(
        "doc_id", "alignment_id", joined("source_segment_ids"), joined("target_segment_ids"), "type", "method"
    )


TYPE = "CASE WHEN len(S) > 1 AND len(T) > 1 THEN 'n:m' WHEN len(S) > 1 THEN 'n:1' WHEN len(T) > 1 THEN '1:n' ELSE '1:1' END"


@check(
    "alignment_types",
    f"SELECT {TYPE.replace('S)', 'source_ids)').replace('T)', 'target_ids)')} AS type, count(*) AS alignments FROM v_aligned GROUP BY ALL",
)
def _(spark, folder):
    return aligned_turns(spark, folder).groupBy("type").agg(F.count("*").alias("alignments"))


def groups_sql(x):
    start = "{'done': []::VARCHAR[], 'cur': NULL::VARCHAR}"
    folded = f"""list_reduce(
      list_transform({sentences(x)}, lambda s: {{'done': []::VARCHAR[], 'cur': s}}),
      lambda a, s: CASE
        WHEN a.cur IS NULL THEN {{'done': a.done, 'cur': s.cur}}
        WHEN length(a.cur) < 90 OR (length(s.cur) < 90 AND length(a.cur) + 1 + length(s.cur) <= 360)
          THEN {{'done': a.done, 'cur': a.cur || ' ' || s.cur}}
        ELSE {{'done': list_append(a.done, a.cur), 'cur': s.cur}} END,
      {start})"""
    return folded


def grouped_sql(source, columns):
    """Rows of ``source`` with ``units``: the sentence groups of their text."""
    return f"""SELECT {columns}, CASE WHEN g.cur IS NULL THEN []
        WHEN len(g.done) > 0 AND length(g.cur) < 90 AND length(g.done[-1]) + 1 + length(g.cur) <= 360
          THEN list_append(g.done[:-2], g.done[-1] || ' ' || g.cur)
        ELSE list_append(g.done, g.cur) END AS units
      FROM (SELECT *, {groups_sql('text')} AS g FROM {source})"""


VIEWS["v_doc_groups"] = grouped_sql("documents", "doc_id")


@check(
    "sentence_groups",
    "SELECT doc_id, generate_subscripts(units, 1) AS n, unnest(units) AS text FROM v_doc_groups",
)
def _(spark, folder):
    cut_up = A.texts(spark, folder, "documents").select("doc_id", T.sentence_groups(F.col("text")).alias("_g"))
    return unfold(cut_up, "_g", "text", "_i").select("doc_id", (F.col("_i") + 1).cast("long").alias("n"), "text")


VIEWS["v_source_units"] = f"""
SELECT doc_id, segment_id AS root, ordinal, block_type, n, text, len(us) > 1 AS divided,
       CASE WHEN len(us) > 1 THEN segment_id || printf('::s%03d', n) ELSE segment_id END AS segment_id
FROM (SELECT *, generate_subscripts(us, 1) AS n, unnest(us) AS text FROM (
  SELECT * EXCLUDE (text), CASE WHEN block_type = 'paragraph' AND len(units) > 1 THEN units ELSE [text] END AS us
  FROM ({grouped_sql('v_source', '* EXCLUDE (g)')})))
"""
VIEWS["v_target_units"] = f"""
SELECT doc_id, segment_id AS root, ordinal, n, text, len(us) > 1 AS divided,
       CASE WHEN len(us) > 1 THEN segment_id || printf('::t%03d', n) ELSE segment_id END AS segment_id
FROM (SELECT *, generate_subscripts(us, 1) AS n, unnest(us) AS text FROM (
  SELECT t.* EXCLUDE (text), CASE WHEN can AND len(units) > 1 THEN units ELSE [text] END AS us
  FROM ({grouped_sql('v_target', '* EXCLUDE (g)')}) t
  LEFT JOIN (SELECT a.doc_id, unnest(a.target_ids) AS segment_id, c.can
             FROM v_aligned a JOIN (SELECT x.doc_id, x.alignment_id, bool_or(s.block_type = 'paragraph') AS can
               FROM (SELECT doc_id, alignment_id, unnest(source_ids) AS id FROM v_aligned) x
               JOIN v_source s ON s.doc_id = x.doc_id AND s.segment_id = x.id GROUP BY ALL) c USING (doc_id, alignment_id))
  USING (doc_id, segment_id)))
"""


def unit_view(side):
    return f"""
    SELECT a.doc_id, a.alignment_id, u.segment_id, length(u.text) AS size, u.n,
      row_number() OVER (PARTITION BY a.doc_id, a.alignment_id ORDER BY a.place, u.n) AS m
    FROM (SELECT doc_id, alignment_id, unnest({side}_ids) AS id, generate_subscripts({side}_ids, 1) AS place FROM v_aligned) a
    JOIN v_{side}_units u ON u.doc_id = a.doc_id AND u.root = a.id"""


VIEWS["v_units"] = f"SELECT 's' AS side, * FROM ({unit_view('source')}) UNION ALL SELECT 't', * FROM ({unit_view('target')})"
VIEWS["v_unit_counts"] = """
SELECT a.*, ns, nt, CASE WHEN ns <> len(source_ids) OR nt <> len(target_ids) THEN least(ns, nt) END AS k
FROM v_aligned a JOIN (SELECT doc_id, alignment_id, sum((side = 's')::INT)::BIGINT AS ns, sum((side = 't')::INT)::BIGINT AS nt FROM v_units GROUP BY ALL)
USING (doc_id, alignment_id)
"""
# Cuts by nearest running length, pushed on so that every group keeps a unit.
VIEWS["v_prefix"] = """
SELECT u.*, sum(greatest(size, 1)) OVER w AS upto, sum(greatest(size, 1)) OVER (PARTITION BY side, doc_id, alignment_id) AS total,
       count(*) OVER (PARTITION BY side, doc_id, alignment_id) AS units, k
FROM v_units u JOIN v_unit_counts USING (doc_id, alignment_id) WHERE k IS NOT NULL
WINDOW w AS (PARTITION BY side, doc_id, alignment_id ORDER BY m)
"""
VIEWS["v_near"] = """
SELECT side, doc_id, alignment_id, j, any_value(k) AS k, any_value(units) AS units,
       arg_min(m, struct_pack(off := abs(CAST(upto AS DOUBLE) - CAST(total * j AS DOUBLE) / k), m := m)) AS near
FROM (SELECT *, unnest(range(1, k)) AS j FROM v_prefix) GROUP BY ALL
"""
VIEWS["v_cuts"] = """
SELECT side, doc_id, alignment_id, j, j + least(units - k, greatest(0, max(near - j) OVER (PARTITION BY side, doc_id, alignment_id ORDER BY j))) AS cut_at
FROM v_near
"""
VIEWS["v_resegmented"] = f"""
SELECT doc_id, 'exp:' || alignment_id || ':' || printf('%03d', CAST(s.g AS BIGINT)) AS alignment_id, s.ids AS source_ids, t.ids AS target_ids,
       {TYPE.replace('S)', 's.ids)').replace('T)', 't.ids)')} AS type, {lit(K.RESEGMENT_METHOD)} AS method,
       least(0.75::DOUBLE, CASE WHEN ns = nt THEN 0.82::DOUBLE ELSE 0.62::DOUBLE END) AS confidence, k, s.g AS part
FROM (SELECT doc_id, alignment_id, g, list(segment_id ORDER BY m) AS ids FROM v_grouped WHERE side = 's' GROUP BY ALL) s
JOIN (SELECT doc_id, alignment_id, g, list(segment_id ORDER BY m) AS ids FROM v_grouped WHERE side = 't' GROUP BY ALL) t USING (doc_id, alignment_id, g)
JOIN v_unit_counts USING (doc_id, alignment_id)
UNION ALL
SELECT doc_id, alignment_id, source_ids, target_ids, {TYPE.replace('S)', 'source_ids)').replace('T)', 'target_ids)')}, 'turns', 0.75::DOUBLE, NULL, 1
FROM v_unit_counts WHERE k IS NULL
"""
VIEWS["v_grouped"] = """
SELECT p.side, p.doc_id, p.alignment_id, p.segment_id, p.m, 1 + count(c.j) AS g
FROM v_prefix p LEFT JOIN v_cuts c ON c.side = p.side AND c.doc_id = p.doc_id AND c.alignment_id = p.alignment_id AND c.cut_at < p.m
GROUP BY ALL
"""


def resegmented(spark, folder):
    return AL.resegment(
        source_lines(spark, folder).drop("turn"), target_lines(spark, folder).drop("turn"), aligned_turns(spark, folder)
    )


@check(
    "resegment",
    """SELECT doc_id, alignment_id, array_to_string(source_ids, ',') AS source_segment_ids,
              array_to_string(target_ids, ',') AS target_segment_ids, type, method, confidence FROM v_resegmented""",
)
def _(spark, folder):
    return resegmented(spark, folder)[2].select(
        "doc_id", "alignment_id", joined("source_segment_ids"), joined("target_segment_ids"), "type", "method", "confidence"
    )


@check(
    "resegmented_segments",
    """SELECT doc_id, segment_id, CASE WHEN divided THEN root END AS parent_segment_id, CASE WHEN divided THEN n - 1 END AS unit_ordinal,
              row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, n) AS ordinal, text FROM v_source_units
       UNION ALL
       SELECT doc_id, segment_id, CASE WHEN divided THEN root END, CASE WHEN divided THEN n - 1 END,
              row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, n), text FROM v_target_units""",
)
def _(spark, folder):
    source, target, _aligned = resegmented(spark, folder)
    names = ["doc_id", "segment_id", "parent_segment_id", "unit_ordinal", "ordinal", "text"]
    return source.select(*names).unionByName(target.select(*names))


@check(
    "resegment_report",
    """SELECT doc_id, sum(a)::BIGINT AS original_source_segments, sum(b)::BIGINT AS source_segments, sum(c)::BIGINT AS original_target_segments,
              sum(d)::BIGINT AS target_segments, sum(e)::BIGINT AS original_alignments, sum(f)::BIGINT AS alignments,
              sum(g)::BIGINT AS subdivided_alignments, sum(h)::BIGINT AS paragraph_fallbacks
       FROM (SELECT doc_id, 1 AS a, 0 AS b, 0 AS c, 0 AS d, 0 AS e, 0 AS f, 0 AS g, 0 AS h FROM v_source
             UNION ALL SELECT doc_id, 0, 1, 0, 0, 0, 0, 0, 0 FROM v_source_units
             UNION ALL SELECT doc_id, 0, 0, 1, 0, 0, 0, 0, 0 FROM v_target
             UNION ALL SELECT doc_id, 0, 0, 0, 1, 0, 0, 0, 0 FROM v_target_units
             UNION ALL SELECT doc_id, 0, 0, 0, 0, 1, 0, coalesce(k > 1, false)::INT, coalesce(k = 1, false)::INT FROM v_unit_counts
             UNION ALL SELECT doc_id, 0, 0, 0, 0, 0, 1, 0, 0 FROM v_resegmented) GROUP BY doc_id""",
)
def _(spark, folder):
    before = source_lines(spark, folder), target_lines(spark, folder), aligned_turns(spark, folder)
    return AL.resegment_report(before, resegmented(spark, folder))


# Events select: the user's event picks the segments of the turn its value points at.
VIEWS["v_selections"] = """
SELECT event_id AS selection_id, user_id AS doc_id, CASE WHEN event_type IN ('view', 'click') THEN 'source' ELSE 'translation' END AS side,
       CASE WHEN event_type IN ('view', 'click') THEN ['s' || (CAST(floor(value) AS BIGINT) % 8) || '_1', 's' || (CAST(floor(value) AS BIGINT) % 5) || '_1']
            ELSE ['t' || (CAST(floor(value) AS BIGINT) % 8) || '_2', 't' || (CAST(floor(value) AS BIGINT) % 5) || '_1'] END AS ids
FROM events
"""


def selections(spark, folder) -> DataFrame:
    v = F.floor("value")
    source = F.col("event_type").isin("view", "click")
    name = lambda letter, n, line: F.concat(F.lit(letter), (v % n).cast("string"), F.lit(f"_{line}"))
    return A.table(spark, folder, "events").select(
        F.col("event_id").alias("selection_id"), F.col("user_id").alias("doc_id"),
        F.when(source, "source").otherwise("translation").alias("side"),
        F.when(source, F.array(name("s", 8, 1), name("s", 5, 1))).otherwise(F.array(name("t", 8, 2), name("t", 5, 1))).alias("segment_ids"),
    )


def projection_sql(picked, side, other):
    return f"""SELECT doc_id, selection_id, segment_id, min(o * 1000 + place)::BIGINT AS first_place FROM (
        SELECT x.doc_id, x.selection_id, a.ordinal AS o, unnest(a.{other}_ids) AS segment_id, generate_subscripts(a.{other}_ids, 1) - 1 AS place
        FROM v_selections x JOIN v_aligned a ON a.doc_id = x.doc_id AND list_has_any(a.{side}_ids, x.ids)
        WHERE x.side = '{picked}') GROUP BY ALL"""


@check(
    "project_selection",
    projection_sql("source", "source", "target") + " UNION ALL " + projection_sql("translation", "target", "source"),
)
def _(spark, folder):
    aligned = cut(aligned_turns(spark, folder))
    picked = selections(spark, folder)
    both = AL.project_selection(picked, aligned, "translation").unionByName(AL.project_selection(picked, aligned, "source"))
    return both.select("doc_id", "selection_id", "segment_id", (F.col("alignment_ordinal") * 1000 + F.col("place")).cast("long").alias("first_place"))


# Half of the sources are unknown: only the first line of each turn counts.
@check(
    "source_for_target",
    """SELECT t.doc_id, t.segment_id, a.source AS source_segment_id FROM v_target t LEFT JOIN (
         SELECT doc_id, unnest(target_ids) AS segment_id, list_filter(source_ids, lambda i: i LIKE '%\\_1' ESCAPE '\\')[1] AS source FROM v_aligned) a
       USING (doc_id, segment_id)
       UNION ALL SELECT doc_id, segment_id, segment_id FROM v_source WHERE segment_id LIKE '%\\_1' ESCAPE '\\'""",
)
def _(spark, folder):
    known = source_lines(spark, folder).where(F.endswith("segment_id", F.lit("_1")))
    own = known.select("doc_id", "segment_id")
    return AL.source_for_target(
        known, target_lines(spark, folder).select("doc_id", "segment_id").unionByName(own), aligned_turns(spark, folder)
    )


@check(
    "alignment_coverage",
    """SELECT * FROM (SELECT coalesce(d.doc_id, a.doc_id) AS doc_id, coalesce(d.side, a.side) AS side, coalesce(d.id, a.id) AS segment_id,
              CAST(coalesce(d.n, 0) AS BIGINT) AS defined, CAST(coalesce(a.n, 0) AS BIGINT) AS aligned,
              CASE WHEN d.n > 1 THEN 'repeated' WHEN d.n IS NULL THEN 'unknown' WHEN coalesce(a.n, 0) <> 1 THEN 'not aligned once' END AS problem
       FROM (SELECT doc_id, side, id, count(*) AS n FROM (SELECT doc_id, 'source' AS side, segment_id AS id FROM v_source WHERE block_type = 'paragraph'
               UNION ALL SELECT doc_id, 'target', segment_id FROM v_target) GROUP BY ALL) d
       FULL JOIN (SELECT doc_id, side, id, count(*) AS n FROM (SELECT doc_id, 'source' AS side, unnest(source_ids) AS id FROM v_aligned
               UNION ALL SELECT doc_id, 'target', unnest(target_ids) FROM v_aligned) GROUP BY ALL) a
       ON a.doc_id = d.doc_id AND a.side = d.side AND a.id = d.id) WHERE problem IS NOT NULL""",
)
def _(spark, folder):
    return AL.alignment_coverage(
        source_lines(spark, folder).where("block_type = 'paragraph'"), target_lines(spark, folder), aligned_turns(spark, folder)
    )


def lengths(x):
    return f"array_to_string(list_transform({sentences(x)}, lambda s: length(s)), ',')"


@check(
    "corpus_shape",
    f"""SELECT doc_id, segment_id, CAST(ordinal AS INT) AS page, block_type, length(text) AS source_length, length(lower(text)) AS target_length,
               {lengths('text')} AS source_sentence_lengths, {lengths("replace(text, 'e', 'ee')")} AS target_sentence_lengths,
               'not-reviewed' AS review_status, 0 AS review_warning_count
        FROM v_source""".replace("length(lower(text))", "length(replace(text, 'e', 'ee'))").replace("CAST(ordinal AS INT) AS page", "page"),
)
def _(spark, folder):
    source = source_lines(spark, folder)
    translated = source.select(
        "doc_id", "segment_id", F.replace("text", F.lit("e"), F.lit("ee")).alias("text"),
        F.lit(None).cast("string").alias("review_status"), F.lit(None).cast("array<string>").alias("review_warnings"),
    )
    return AL.corpus_shape(source, translated).withColumn(
        "source_sentence_lengths", F.array_join("source_sentence_lengths", ",")
    ).withColumn("target_sentence_lengths", F.array_join("target_sentence_lengths", ","))


@check(
    "document_shape",
    """SELECT doc_id, sum(s)::BIGINT AS segments, sum(t)::BIGINT AS translations, sum(a)::BIGINT AS alignments, sum(n)::BIGINT AS native_pages,
              sum(o)::BIGINT AS ocr_pages, max(p) AS page_count FROM (
         SELECT doc_id, 1 AS s, 0 AS t, 0 AS a, 0 AS n, 0 AS o, page AS p FROM v_source
         UNION ALL SELECT doc_id, 0, 1, 0, 0, 0, 0 FROM v_target UNION ALL SELECT doc_id, 0, 0, 1, 0, 0, 0 FROM v_aligned
         UNION ALL SELECT conv_id, 0, 0, 0, (role = 'user')::INT, (role <> 'user')::INT, 0 FROM conversations) GROUP BY doc_id""",
)
def _(spark, folder):
    pages = A.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.when(F.col("role") == "user", "native").otherwise("ocr").alias("method")
    )
    return AL.document_shape(source_lines(spark, folder), target_lines(spark, folder), aligned_turns(spark, folder), pages)


# ------------------------------------------------------------------ positions
HEIGHT = "greatest(28, CAST(floor(11 * sqrt(length(text))) AS BIGINT))"
VIEWS["v_bounds"] = f"""
SELECT doc_id, side, segment_id, ordinal, CAST(bottom - h - 12 AS DOUBLE) AS start, CAST(bottom - 12 AS DOUBLE) AS "end"
FROM (SELECT *, sum(h + 12) OVER (PARTITION BY doc_id, side ORDER BY ordinal) AS bottom
      FROM (SELECT doc_id, 'source' AS side, segment_id, ordinal, {HEIGHT} AS h FROM v_source
            UNION ALL SELECT doc_id, 'translation', segment_id, ordinal, {HEIGHT} FROM v_target))
"""


def bounds(spark, folder) -> DataFrame:
    from bitext.plans.ordered import running_total

    both = source_lines(spark, folder).select("doc_id", F.lit("source").alias("side"), "segment_id", "ordinal", "text").unionByName(
        target_lines(spark, folder).select("doc_id", F.lit("translation").alias("side"), "segment_id", "ordinal", "text")
    )
    tall = F.greatest(F.lit(28), F.floor(11 * F.sqrt(F.length("text"))))
    laid = running_total(both.withColumn("_h", tall), ["doc_id", "side"], "ordinal", F.col("_h") + 12, "_top")
    return laid.select(
        "doc_id", "side", "segment_id", "ordinal", F.col("_top").cast("double").alias("start"),
        (F.col("_top") + F.col("_h")).cast("double").alias("end"),
    )


def intervals_view(lead, follow, lead_side, follow_side):
    def extent(ids, side):
        return f"""SELECT a.doc_id, a.alignment_id, a.ordinal, min(b.start) AS s, max(b."end") AS e
            FROM (SELECT doc_id, alignment_id, ordinal, unnest({ids}_ids) AS id FROM v_aligned) a
            JOIN v_bounds b ON b.doc_id = a.doc_id AND b.side = '{side}' AND b.segment_id = a.id GROUP BY ALL"""

    return f"""SELECT l.doc_id, l.alignment_id, l.ordinal AS alignment_ordinal, l.s AS leader_start, l.e AS leader_end,
        f.s AS follower_start, f.e AS follower_end
      FROM ({extent(lead, lead_side)}) l JOIN ({extent(follow, follow_side)}) f USING (doc_id, alignment_id)"""


VIEWS["v_forward"] = intervals_view("source", "target", "source", "translation")
VIEWS["v_backward"] = intervals_view("target", "source", "translation", "source")


def mapped_sql(events, intervals, columns, p):
    """Positions mapped by the plain definition: the first interval in order that answers."""
    return f"""SELECT {columns}, CASE WHEN n = 0 AND {p} <= first_start THEN first_follower
          WHEN last_only THEN follower_end
          WHEN {p} <= leader_end AND leader_end <= leader_start THEN (follower_start + follower_end) / 2
          WHEN {p} <= leader_end THEN follower_start + least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({p} - leader_start) / (leader_end - leader_start))) * (follower_end - follower_start)
          WHEN next_start <= leader_end THEN (follower_end + next_follower) / 2
          ELSE follower_end + least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({p} - leader_end) / (next_start - leader_end))) * (next_follower - follower_end) END AS mapped
        FROM (SELECT e.*, i.* EXCLUDE (doc_id, k),
                CASE WHEN {p} <= i.first_start THEN 0 ELSE 1 END AS n,
                NOT ({p} <= i.leader_end OR coalesce({p} < i.next_start, false)) AND {p} > i.first_start AS last_only,
                row_number() OVER (PARTITION BY e.event_id, e.doc_id ORDER BY
                  CASE WHEN {p} <= i.leader_end OR coalesce({p} < i.next_start, false) THEN 0 ELSE 1 END,
                  CASE WHEN {p} <= i.leader_end OR coalesce({p} < i.next_start, false) THEN i.k ELSE -i.k END) AS pick
              FROM {events} e JOIN (
                SELECT *, row_number() OVER w AS k, lead(leader_start) OVER w AS next_start, lead(follower_start) OVER w AS next_follower,
                       min(leader_start) OVER (PARTITION BY doc_id) AS first_start, first_value(follower_start) OVER w AS first_follower
                FROM {intervals} WINDOW w AS (PARTITION BY doc_id ORDER BY leader_start, leader_end, alignment_ordinal)) i
              ON i.doc_id = e.doc_id)
        WHERE pick = 1"""


# Users read the conversation of their number; the value of an event is a place in it.
VIEWS["v_positions"] = "SELECT event_id, user_id AS doc_id, value * 4 - 20 AS position FROM events"


def positions(spark, folder) -> DataFrame:
    return A.table(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("doc_id"), (F.col("value") * 4 - 20).alias("position")
    )


@check(
    "alignment_intervals",
    "SELECT 'source' AS leader, * FROM v_forward UNION ALL SELECT 'translation', * FROM v_backward",
)
def _(spark, folder):
    aligned, laid = cut(aligned_turns(spark, folder)), cut(bounds(spark, folder))
    forward = PO.alignment_intervals(aligned, laid, "source").withColumn("leader", F.lit("source"))
    return forward.unionByName(PO.alignment_intervals(aligned, laid, "translation").withColumn("leader", F.lit("translation")))


def _map(leader):
    def run(spark, folder):
        intervals = cut(PO.alignment_intervals(aligned_turns(spark, folder), bounds(spark, folder), leader))
        return PO.map_positions(positions(spark, folder), intervals).select("event_id", "doc_id", "mapped")

    return run


def _with_unmapped(intervals):
    """Events of documents without alignment stay, unmapped."""
    mapped = mapped_sql("v_positions", intervals, "event_id, doc_id", "position")
    return f"SELECT p.event_id, p.doc_id, m.mapped FROM v_positions p LEFT JOIN ({mapped}) m ON m.event_id = p.event_id"


check("map_positions", _with_unmapped("v_forward"))(_map("source"))
check("map_positions_back", _with_unmapped("v_backward"))(_map("translation"))

VIEWS["v_scrolls"] = """
SELECT event_id, user_id AS doc_id, CASE WHEN event_type IN ('view', 'signup') THEN 'source' ELSE 'translation' END AS side,
  value * 4 AS scroll_top, 300.0::DOUBLE AS viewport_height, CASE WHEN value > 1 THEN 'synchronized' ELSE 'free' END AS mode,
  CASE WHEN event_type = 'view' THEN 'smooth' ELSE 'auto' END AS behavior, value * 3 AS follower_scroll_top, 250.0::DOUBLE AS follower_viewport_height,
  1500.0::DOUBLE AS follower_scroll_height, value < 100 AS source_visible, event_type <> 'purchase' AS translation_visible,
  value > 90 AS source_locked, false AS translation_locked,
  value * 4 + 300.0::DOUBLE * 0.35::DOUBLE AS position
FROM events
"""
LIVE = "mode = 'synchronized' AND source_visible AND translation_visible AND NOT source_locked AND NOT translation_locked"
VIEWS["v_scrolls_source"] = f"SELECT * FROM v_scrolls WHERE side = 'source' AND {LIVE}"
VIEWS["v_scrolls_translation"] = f"SELECT * FROM v_scrolls WHERE side = 'translation' AND {LIVE}"


@check(
    "sync_decisions",
    f"""SELECT event_id, doc_id, side, next_scroll_top FROM (
          SELECT *, least(1250.0::DOUBLE, greatest(0.0::DOUBLE, mapped - 250.0::DOUBLE * 0.35::DOUBLE)) AS next_scroll_top FROM (
            {mapped_sql('v_scrolls_source', 'v_forward', 'event_id, doc_id, side, behavior, follower_scroll_top', 'position')}
            UNION ALL {mapped_sql('v_scrolls_translation', 'v_backward', 'event_id, doc_id, side, behavior, follower_scroll_top', 'position')}))
        WHERE NOT (behavior = 'auto' AND abs(next_scroll_top - follower_scroll_top) < 18)""",
)
def _(spark, folder):
    v, kind = F.col("value"), F.col("event_type")
    events = A.table(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("doc_id"),
        F.when(kind.isin("view", "signup"), "source").otherwise("translation").alias("side"),
        (v * 4).alias("scroll_top"), F.lit(300.0).alias("viewport_height"),
        F.when(v > 1, "synchronized").otherwise("free").alias("mode"),
        F.when(kind == "view", "smooth").otherwise("auto").alias("behavior"),
        (v * 3).alias("follower_scroll_top"), F.lit(250.0).alias("follower_viewport_height"),
        F.lit(1500.0).alias("follower_scroll_height"),
        (v < 100).alias("source_visible"), (kind != "purchase").alias("translation_visible"),
        (v > 90).alias("source_locked"), F.lit(False).alias("translation_locked"),
    )
    decided = PO.sync_decisions(events, cut(aligned_turns(spark, folder)), cut(bounds(spark, folder)))
    return decided.select("event_id", "doc_id", "side", "next_scroll_top")


# A turn is a page as tall as its text is long.
VIEWS["v_page_bounds"] = """
SELECT conv_id AS doc_id, CAST(turn AS INT) AS page_number, CAST(bottom - h - 24 AS DOUBLE) AS top, CAST(h AS DOUBLE) AS height
FROM (SELECT *, sum(h + 24) OVER (PARTITION BY conv_id ORDER BY turn) AS bottom FROM (SELECT conv_id, turn, length(text) AS h FROM conversations))
"""


def page_bounds(spark, folder) -> DataFrame:
    from bitext.plans.ordered import running_total

    turns = A.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"), "turn", F.length("text").cast("long").alias("_h")
    )
    return running_total(turns, ["doc_id"], "turn", F.col("_h") + 24, "_top").select(
        "doc_id", F.col("turn").cast("int").alias("page_number"), F.col("_top").cast("double").alias("top"),
        F.col("_h").cast("double").alias("height"),
    )


@check(
    "visible_page",
    """SELECT doc_id, event_id, page_number, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (vt - top) / height)) AS page_offset FROM (
         SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY least(top + height, vb) - greatest(top, vt) DESC, page_number) AS n
         FROM (SELECT event_id, user_id AS doc_id, value * 20 AS vt, value * 20 + 600 AS vb FROM events) e JOIN v_page_bounds p USING (doc_id)
         WHERE top + height > vt AND top < vb) WHERE n = 1""",
)
def _(spark, folder):
    seen = A.table(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("doc_id"), (F.col("value") * 20).alias("top"), F.lit(600.0).alias("height")
    )
    return PO.locate_visible_page(seen, cut(page_bounds(spark, folder)))


@check(
    "segment_anchors",
    """SELECT doc_id, page, segment_id, CAST(upto - w AS DOUBLE) / total * 100 AS top,
              greatest(0.5::DOUBLE, (CAST(upto AS DOUBLE) / total - CAST(upto - w AS DOUBLE) / total) * 100) AS height
       FROM (SELECT *, sum(w) OVER (PARTITION BY doc_id, page ORDER BY ordinal) AS upto, sum(w) OVER (PARTITION BY doc_id, page) AS total
             FROM (SELECT *, greatest(40, length(text)) AS w FROM v_source))""",
)
def _(spark, folder):
    return PO.segment_anchors(source_lines(spark, folder))


# Items are the boxes of their pages; an event draws a rectangle on a page of the user's document.
VIEWS["v_rects"] = """
SELECT event_id AS selection_id, user_id AS doc_id, CAST(CAST(floor(value) AS BIGINT) % 3 + 1 AS INT) AS page, value * 3 AS "left", value * 5 AS top,
       value * 3 + 60 AS "right", value * 5 + CASE WHEN event_type = 'error' THEN 0 ELSE 30 END AS bottom FROM events
"""


@check(
    "overlapping_segments",
    """SELECT DISTINCT r.doc_id, r.page, r.selection_id, b.source_index AS segment_id FROM v_rects r JOIN v_items b USING (doc_id, page)
       WHERE r."right" > r."left" AND r.bottom > r.top AND r.bottom >= b.y AND r.top <= b.y + b.height
         AND r."right" >= b.x AND r."left" <= b.x + b.width""",
)
def _(spark, folder):
    v = F.col("value")
    rects = A.table(spark, folder, "events").select(
        F.col("event_id").alias("selection_id"), F.col("user_id").alias("doc_id"),
        (F.floor(v) % 3 + 1).cast("int").alias("page"), (v * 3).alias("left"), (v * 5).alias("top"), (v * 3 + 60).alias("right"),
        (v * 5 + F.when(F.col("event_type") == "error", 0).otherwise(30)).alias("bottom"),
    )
    boxes = text_items(spark, folder).select(
        "doc_id", "page", F.col("source_index").alias("segment_id"), F.col("x").alias("left"), F.col("y").alias("top"),
        (F.col("x") + F.col("width")).alias("right"), (F.col("y") + F.col("height")).alias("bottom"),
    )
    return PO.overlapping_segments(rects, boxes)


VIEWS["v_middles"] = """
SELECT doc_id, segment_id AS event_id, ordinal, (start + "end") / 2 AS position FROM v_bounds WHERE side = 'source'
"""


@check(
    "monotonicity",
    f"""SELECT m.doc_id, count(*) AS segments, bool_and(mapped IS NOT NULL) AS all_mapped,
               bool_and(mapped IS NOT NULL AND (before IS NULL AND first OR coalesce(mapped >= before, false))) AS monotone
        FROM (SELECT x.doc_id, y.mapped, lag(y.mapped) OVER w AS before, row_number() OVER w = 1 AS first
              FROM v_middles x LEFT JOIN ({mapped_sql('v_middles', 'v_forward', 'event_id, doc_id', 'position')}) y USING (doc_id, event_id)
              WINDOW w AS (PARTITION BY x.doc_id ORDER BY x.ordinal)) m GROUP BY m.doc_id""",
)
def _(spark, folder):
    laid = cut(bounds(spark, folder))
    return PO.monotonicity(
        cut(aligned_turns(spark, folder)), laid.drop("ordinal"), source_lines(spark, folder).select("doc_id", "segment_id", "ordinal")
    )


# ------------------------------------------------------------------------ jobs
JOB_TYPE = {"signup": "started", "view": "progressed", "click": "progressed", "error": "failed", "purchase": "finished"}


def job_events(spark, folder) -> DataFrame:
    return job_events_of(A.table(spark, folder, "events"))


def job_events_of(events) -> DataFrame:
    chain = None
    for kind, name in JOB_TYPE.items():
        is_kind = F.col("event_type") == kind
        chain = F.when(is_kind, name) if chain is None else chain.when(is_kind, name)
    return events.select(
        F.lit("project").alias("project_id"), F.col("user_id").cast("string").alias("document_id"), F.col("event_id").alias("seq"),
        "ts", chain.alias("type"),
        F.struct(F.col("event_type").alias("stage"), F.col("event_id").alias("current")).alias("progress"),
        F.concat(F.lit("failed at "), F.col("event_id").cast("string")).alias("error"),
    )


VIEWS["v_jobs"] = "SELECT user_id, event_id, event_type, CASE event_type " + " ".join(
    f"WHEN {lit(k)} THEN {lit(v)}" for k, v in JOB_TYPE.items()) + " END AS type FROM events"


@check(
    "job_state",
    """SELECT 'project' AS project_id, user_id::VARCHAR AS document_id, CASE type WHEN 'started' THEN 'running' ELSE 'failed' END AS phase,
              CASE WHEN type = 'started' THEN progress_at END AS progress_at, CASE WHEN type = 'failed' THEN 'failed at ' || seq END AS error
       FROM (SELECT b.user_id, b.type, b.seq, (SELECT max(event_id) FROM v_jobs p WHERE p.user_id = b.user_id AND p.type = 'progressed' AND p.event_id > b.seq) AS progress_at
             FROM (SELECT user_id, arg_max(type, event_id) AS type, max(event_id) AS seq FROM v_jobs WHERE type <> 'progressed' GROUP BY user_id) b)
       WHERE type <> 'finished'""",
)
def _(spark, folder):
    return J.job_state(job_events(spark, folder)).select(
        "project_id", "document_id", "phase", F.col("progress.current").alias("progress_at"), "error"
    )


@check(
    "inflight_dedup",
    """SELECT user_id::VARCHAR AS document_id, event_id AS seq FROM (
         SELECT *, lag(type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM v_jobs WHERE type <> 'progressed')
       WHERE type = 'started' AND before IS DISTINCT FROM 'started'""",
)
def _(spark, folder):
    return J.accepted_starts(job_events(spark, folder)).select("document_id", "seq")


# Events of a user a few minutes apart count as the same number of milliseconds.
VIEWS["v_reads"] = """
SELECT user_id AS reader_id, event_id AS seq, epoch_ms(ts) // 60000 AS at_ms,
       CASE WHEN event_type = 'error' THEN 'intent' ELSE 'scroll' END AS kind,
       CASE WHEN event_type IN ('view', 'error') THEN 'source' ELSE 'translation' END AS side,
       CASE WHEN value > 30 THEN 'smooth' ELSE 'auto' END AS behavior
FROM events
"""


@check(
    "debounced_sync",
    """SELECT reader_id, unnest(out.seqs) AS seq, unnest(out.sides) AS side FROM (
         SELECT reader_id, list_reduce(list_transform(list_value_all, lambda e: {'quiet': '', 'until': 0::BIGINT, 'seqs': []::BIGINT[], 'sides': []::VARCHAR[], 'e': e}),
           lambda a, x: CASE
             WHEN x.e.kind = 'intent' THEN {'quiet': '', 'until': 0::BIGINT, 'seqs': a.seqs, 'sides': a.sides, 'e': x.e}
             WHEN a.quiet = x.e.side AND x.e.at_ms < a.until THEN {'quiet': a.quiet, 'until': a.until, 'seqs': a.seqs, 'sides': a.sides, 'e': x.e}
             ELSE {'quiet': CASE x.e.side WHEN 'source' THEN 'translation' ELSE 'source' END,
                   'until': x.e.at_ms + CASE x.e.behavior WHEN 'smooth' THEN 700 ELSE 160 END,
                   'seqs': list_append(a.seqs, x.e.seq), 'sides': list_append(a.sides, x.e.side), 'e': x.e} END,
           {'quiet': '', 'until': 0::BIGINT, 'seqs': []::BIGINT[], 'sides': []::VARCHAR[],
            'e': {'seq': 0::BIGINT, 'at_ms': 0::BIGINT, 'kind': '', 'side': '', 'behavior': ''}}) AS out
         FROM (SELECT reader_id, list({'seq': seq, 'at_ms': at_ms, 'kind': kind, 'side': side, 'behavior': behavior} ORDER BY at_ms, seq) AS list_value_all
               FROM v_reads GROUP BY reader_id))""",
)
def _(spark, folder):
    return J.debounced_sync(reads_of(A.table(spark, folder, "events"))).select("reader_id", "seq", "side")


def reads_of(events) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("reader_id"), F.col("event_id").alias("seq"),
        F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 60000).alias("at_ms"), "ts",
        F.when(kind == "error", "intent").otherwise("scroll").alias("kind"),
        F.when(kind.isin("view", "error"), "source").otherwise("translation").alias("side"),
        F.when(F.col("value") > 30, "smooth").otherwise("auto").alias("behavior"),
    )
