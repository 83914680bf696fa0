"""Protected values, review decisions, and what models return."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitext import constants as K
from bitext.functions import text as T
from bitext.operators import inference as I
from bitext.operators import protect as P
from bitext.operators import review as R
from bitext.plans.lineage import checkpoint_folder, cut, keep
from bitext.plans.processing import process
from bitext.plans.resume import run_batches_once
from checks import adapters as A
from checks.register import registry
from checks.sql import NL, VIEWS, lit, matches, re2, strip

QUERIES, SQL, check = registry()

# ------------------------------------------------------------------ SQL views
# RE2 has no look-behind: a letter and the digit or sign after it are matched as
# a token of their own, and dropped.
SKIP = r"[\p{L}_][-+\d]"
NUMBER_BODY = K.NUMBER.replace(r"(?<![\p{L}_])", "")


def is_skip(t):
    return f"regexp_full_match({t}, {lit(SKIP)})"


def numbers(x):
    return (
        f"list_filter(regexp_extract_all({x}, {re2(SKIP + '|' + NUMBER_BODY)}), lambda t: NOT {is_skip('t')})"
    )


def references(x):
    return f"regexp_extract_all({x}, {re2(K.REFERENCE)})"


def stable(x):
    return (
        f"list_transform(regexp_extract_all({x}, {re2(K.STABLE_PLACEHOLDER)}, 1), lambda t: '[[' || t || ']]')"
    )


def marks(x):
    return f"regexp_extract_all({x}, {re2(K.MATH_PLACEHOLDER)})"


def weave(parts, fills):
    return (
        f"array_to_string(list_transform(range(1, len({parts}) + 1),"
        f" lambda i: {parts}[i] || coalesce({fills}[i], '')), '')"
    )


def listed(values):
    return f"coalesce(array_to_string({values}, '|'), '')"


GREEK = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in K.GREEK_LATEX.items())
LATEX = f"""CASE
  WHEN source LIKE '$$%' AND source LIKE '%$$' THEN substr(source, 3, length(source) - 4)
  WHEN source LIKE '$%' AND source LIKE '%$' THEN substr(source, 2, length(source) - 2)
  WHEN (CASE source {GREEK} END) IS NOT NULL THEN CASE source {GREEK} END
  WHEN {matches('source', '^[A-Za-z]' + chr(92) + 's*[_^]')} THEN
    regexp_replace(regexp_replace(regexp_replace(source, '\\s+', '', 'g'),
      '_([A-Za-z0-9]+)$', '_{{\\1}}'), '\\^([A-Za-z0-9]+)$', '^{{\\1}}')
  WHEN {matches('source', '^[pPrR]' + chr(92) + 's*(?:<|>|=|≤|≥|≠|≈)')} THEN
    regexp_replace(replace(replace(replace(replace(source, '≤', '\\le '), '≥', '\\ge '), '≠', '\\ne '), '≈', '\\approx '), ',', '.')
  END"""
VIEWS["v_math_found"] = f"""
SELECT *, coalesce(sum(len(found)) OVER (PARTITION BY doc_id ORDER BY ordinal
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM (SELECT *, CASE WHEN block_type = 'equation-marker' THEN [text]
                     ELSE regexp_extract_all(text, {re2(K.MATH)}) END AS found FROM v_order_notes)
"""
VIEWS["v_math_objects"] = f"""
SELECT doc_id, segment_id, page, ordinal, i, printf('math_%05d', n) AS math_id,
  CASE WHEN display THEN 'display' ELSE 'inline' END AS type,
  printf(CASE WHEN display THEN '⟦MATH_DISPLAY_%05d⟧' ELSE '⟦MATH_INLINE_%05d⟧' END, n) AS placeholder,
  source, latex, CASE WHEN coalesce(latex, '') <> '' THEN 0.95::DOUBLE
                      WHEN block_type = 'equation-marker' THEN 0.55::DOUBLE ELSE 0.65::DOUBLE END AS confidence
FROM (SELECT *, before + i AS n, block_type = 'equation-marker' OR source LIKE '$$%' AS display, {LATEX} AS latex
      FROM (SELECT *, unnest(found) AS source, generate_subscripts(found, 1) AS i FROM v_math_found))
"""
VIEWS["v_math_text"] = f"""
SELECT f.doc_id, f.segment_id, f.ordinal, f.page, f.block_type, f.priority, f.status,
  CASE WHEN f.block_type = 'equation-marker' THEN m.fills[1]
       ELSE {weave('f.parts', 'm.fills')} END AS text
FROM (SELECT *, string_split_regex(text, {re2(K.MATH)}) AS parts FROM v_math_found) f
LEFT JOIN (SELECT doc_id, segment_id, list(placeholder ORDER BY i) AS fills
           FROM v_math_objects GROUP BY ALL) m USING (doc_id, segment_id)
"""
# The existing markers come first among the alternatives, and stay.
TOKEN = "(?iu)" + K.EXISTING_MARKER + "|" + K.STABLE_VALUE.replace(K.NUMBER, SKIP + "|" + NUMBER_BODY)
KEPT = f"(regexp_full_match(t, {re2(K.EXISTING_MARKER)}) OR {is_skip('t')})"


def token_views(name, source):
    VIEWS[f"v_{name}_all"] = f"""
    SELECT doc_id, segment_id, ordinal, i, t, KEPT AS kept,
      sum(CASE WHEN KEPT THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ordinal, i) AS n
    FROM (SELECT *, unnest(found) AS t, generate_subscripts(found, 1) AS i
          FROM (SELECT *, regexp_extract_all(text, {re2(TOKEN)}) AS found FROM {source}))
    """.replace("KEPT", KEPT)
    VIEWS[f"v_{name}_tokens"] = f"""
    SELECT doc_id, segment_id, i, t AS source, kept,
      CASE WHEN kept THEN t WHEN {matches('t', K.STABLE_REFERENCE)} THEN printf('[[REFERENCE_%05d]]', CAST(n AS BIGINT))
           ELSE printf('[[NUMBER_%05d]]', CAST(n AS BIGINT)) END AS placeholder,
      CASE WHEN {matches('t', K.STABLE_REFERENCE)} THEN 'reference' ELSE 'number' END AS kind
    FROM v_{name}_all
    """
    VIEWS[f"v_{name}_text"] = f"""
    SELECT f.doc_id, f.segment_id, f.ordinal, f.page, f.priority, f.status, {weave('f.parts', 'm.fills')} AS text
    FROM (SELECT *, string_split_regex(text, {re2(TOKEN)}) AS parts FROM {source}) f
    LEFT JOIN (SELECT doc_id, segment_id, list(placeholder ORDER BY i) AS fills
               FROM v_{name}_tokens GROUP BY ALL) m USING (doc_id, segment_id)
    """


token_views("raw", "v_order_notes")
token_views("safe", "v_math_text")
# What a model might return, by priority of the order.
VIEWS["v_returned"] = f"""
SELECT doc_id, segment_id, ordinal, CASE priority
    WHEN '2-HIGH' THEN replace(replace(text, '[[', '['), ']]', ']')
    WHEN '3-MEDIUM' THEN '  '
    WHEN '4-NOT SPECIFIED' THEN regexp_replace(text, '(NUMBER|MATH_INLINE)_\\d', 'X', 'g')
    ELSE 'Pedido: ' || text END AS text, status, priority
FROM v_safe_text WHERE priority <> '1-URGENT'
"""


def restored(text, pattern, group, keys, values):
    whole = f"regexp_extract_all({text}, {re2(pattern)})"
    name = f"regexp_extract_all({text}, {re2(pattern)}, {group})"
    fills = (
        f"list_transform(range(1, len({whole}) + 1), lambda i:"
        f" coalesce({values}[list_position({keys}, ({name})[i])], ({whole})[i]))"
    )
    return weave(f"string_split_regex({text}, {re2(pattern)})", f"({fills})")


VIEWS["v_token_lists"] = f"""
SELECT doc_id, segment_id, list(regexp_extract(placeholder, {re2(K.STABLE_PLACEHOLDER)}, 1) ORDER BY i) AS names,
       list(source ORDER BY i) AS sources FROM v_safe_tokens WHERE NOT kept GROUP BY ALL
"""
VIEWS["v_plain"] = f"""
SELECT r.doc_id, r.segment_id, CASE WHEN names IS NULL THEN text
       ELSE {restored('text', K.STABLE_PLACEHOLDER, 1, 'names', 'sources')} END AS text
FROM v_returned r LEFT JOIN v_token_lists USING (doc_id, segment_id)
"""
VIEWS["v_math_lists"] = f"""
SELECT doc_id, segment_id, list(placeholder ORDER BY i) AS names, list(source ORDER BY i) AS sources,
  list(CASE WHEN confidence >= 0.9 AND type = 'display' THEN {NL} || {NL} || '$$' || latex || '$$' || {NL} || {NL}
            WHEN confidence >= 0.9 THEN '$' || latex || '$'
            WHEN type = 'display' THEN {NL} || {NL} || '~~~text' || {NL} || source || {NL} || '~~~' || {NL} || {NL}
            ELSE '`' || source || '`' END ORDER BY i) AS marked
FROM v_math_objects GROUP BY ALL
"""


# ------------------------------------------------------------- Spark inputs


def math_protected(spark, folder) -> DataFrame:
    return P.protect_math(A.order_notes(spark, folder))


def protected(spark, folder) -> DataFrame:
    """Notes with both kinds of values protected; read several times, hence written once."""
    return keep(P.protect_values(A.order_notes(spark, folder)))


def returned(safe: DataFrame) -> DataFrame:
    text = F.col("text")
    return safe.where("priority <> '1-URGENT'").select(
        "doc_id", "segment_id", "ordinal",
        F.when(F.col("priority") == "2-HIGH", F.replace(F.replace(text, F.lit("[["), F.lit("[")), F.lit("]]"), F.lit("]")))
        .when(F.col("priority") == "3-MEDIUM", "  ")
        .when(F.col("priority") == "4-NOT SPECIFIED", F.regexp_replace(text, r"(NUMBER|MATH_INLINE)_\d", "X"))
        .otherwise(F.concat(F.lit("Pedido: "), text)).alias("text"),
        "status", "priority",
    )


# -------------------------------------------------------------------- queries


@check(
    "value_tokens",
    f"""SELECT doc_id, segment_id, {listed(numbers('text'))} AS numbers, {listed(references('text'))} AS refs
        FROM v_order_notes
        UNION ALL SELECT doc_id, 'document', {listed(numbers('text'))}, {listed(references('text'))} FROM documents""",
)
def _(spark, folder):
    documents = A.texts(spark, folder, "documents").select("doc_id", F.lit("document").alias("segment_id"), "text")
    notes = A.order_notes(spark, folder).select("doc_id", "segment_id", "text")
    return notes.unionByName(documents).select(
        "doc_id", "segment_id",
        F.array_join(T.numeric_tokens(F.col("text")), "|").alias("numbers"),
        F.array_join(T.reference_tokens(F.col("text")), "|").alias("refs"),
    )


@check("protect_math", "SELECT doc_id, segment_id, text FROM v_math_text")
def _(spark, folder):
    return math_protected(spark, folder).select("doc_id", "segment_id", "text")


@check(
    "math_objects",
    "SELECT doc_id, segment_id, page, math_id, type, placeholder, source, latex, confidence FROM v_math_objects",
)
def _(spark, folder):
    return P.math_objects(math_protected(spark, folder)).drop("original_crop")


@check("protect_tokens", "SELECT doc_id, segment_id, text FROM v_raw_text")
def _(spark, folder):
    return P.protect_tokens(A.order_notes(spark, folder)).select("doc_id", "segment_id", "text")


@check(
    "stable_tokens",
    "SELECT doc_id, segment_id, placeholder, source, kind FROM v_raw_tokens WHERE NOT kept",
)
def _(spark, folder):
    return P.stable_tokens(P.protect_tokens(A.order_notes(spark, folder)))


@check(
    "math_integrity",
    f"""SELECT s.doc_id, s.segment_id, {listed(marks('s.text'))} AS expected,
               {listed(marks("coalesce(r.text, '')"))} AS received
        FROM v_safe_text s LEFT JOIN v_returned r USING (doc_id, segment_id)
        WHERE {marks('s.text')} <> {marks("coalesce(r.text, '')")}""",
)
def _(spark, folder):
    safe = protected(spark, folder)
    return P.math_integrity(safe, returned(safe)).select(
        "doc_id", "segment_id", F.array_join("expected", "|").alias("expected"),
        F.array_join("received", "|").alias("received"),
    )


@check(
    "token_integrity",
    f"""SELECT s.doc_id, s.segment_id, {listed(stable('s.text'))} AS expected,
               {listed(stable("coalesce(r.text, '')"))} AS received
        FROM v_safe_text s LEFT JOIN v_returned r USING (doc_id, segment_id)
        WHERE {stable('s.text')} <> {stable("coalesce(r.text, '')")}""",
)
def _(spark, folder):
    safe = protected(spark, folder)
    return P.stable_integrity(safe, returned(safe)).select(
        "doc_id", "segment_id", F.array_join("expected", "|").alias("expected"),
        F.array_join("received", "|").alias("received"),
    )


@check(
    "annotate_lost",
    f"""SELECT r.doc_id, r.segment_id, CASE WHEN {stable('s.text')} <> {stable('r.text')}
          THEN {strip('r.text')} || {NL} || {NL} || {lit(K.LOST_VALUES_NOTE.strip(chr(10)))} ||
               array_to_string(list_filter({stable('s.text')}, lambda t: NOT list_contains({stable('r.text')}, t)), ' ')
          ELSE r.text END AS text
        FROM v_returned r JOIN v_safe_text s USING (doc_id, segment_id)""",
)
def _(spark, folder):
    safe = protected(spark, folder)
    return P.annotate_lost(safe, returned(safe)).select("doc_id", "segment_id", "text")


@check("restore_tokens", "SELECT doc_id, segment_id, text FROM v_plain")
def _(spark, folder):
    safe = protected(spark, folder)
    return P.restore_tokens(returned(safe), P.stable_tokens(safe)).select("doc_id", "segment_id", "text")


@check(
    "restore_math",
    f"""SELECT p.doc_id, p.segment_id, CASE WHEN names IS NULL THEN text
          ELSE {restored('text', K.MATH_PLACEHOLDER, 0, 'names', 'sources')} END AS plain,
          CASE WHEN names IS NULL THEN text
          ELSE {restored('text', K.MATH_PLACEHOLDER, 0, 'names', 'marked')} END AS markdown
        FROM v_plain p LEFT JOIN v_math_lists USING (doc_id, segment_id)""",
)
def _(spark, folder):
    safe = protected(spark, folder)
    objects = P.math_objects(safe)
    base = keep(P.restore_tokens(returned(safe), P.stable_tokens(safe)).select("doc_id", "segment_id", "text"))
    plain = P.restore_math(base, objects, "plain").withColumnRenamed("text", "plain")
    return plain.join(
        P.restore_math(base, objects, "markdown").withColumnRenamed("text", "markdown"), ["doc_id", "segment_id"]
    )


@check(
    "value_preservation",
    f"""SELECT s.doc_id, s.segment_id FROM v_order_notes s LEFT JOIN v_plain r USING (doc_id, segment_id)
        WHERE {numbers('s.text')} <> {numbers("coalesce(r.text, '')")}
           OR {references('s.text')} <> {references("coalesce(r.text, '')")}""",
)
def _(spark, folder):
    safe = protected(spark, folder)
    plain = P.restore_tokens(returned(safe), P.stable_tokens(safe))
    return P.value_preservation(A.order_notes(spark, folder), plain)


# Translations of the notes of open orders also claim a segment the source has not.
@check(
    "completeness",
    """SELECT doc_id, sum(CASE WHEN t.segment_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing,
              sum(CASE WHEN s.segment_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS unexpected,
              sum(CASE WHEN trim(t.text) = '' THEN 1 ELSE 0 END)::BIGINT AS blank,
              bool_and(s.segment_id IS NOT NULL AND t.segment_id IS NOT NULL AND trim(t.text) <> '') AS complete
       FROM v_safe_text s FULL JOIN (
         SELECT doc_id, segment_id, text FROM v_returned UNION ALL
         SELECT doc_id, segment_id || 'x', text FROM v_returned WHERE status = 'O') t USING (doc_id, segment_id)
       GROUP BY doc_id""",
)
def _(spark, folder):
    safe = protected(spark, folder)
    back = returned(safe).select("doc_id", "segment_id", "text", "status")
    extra = back.where("status = 'O'").withColumn("segment_id", F.concat("segment_id", F.lit("x")))
    return P.translation_completeness(safe, back.unionByName(extra))


# ---------------------------------------------------------------------- review
VIEWS["v_revised"] = """
SELECT doc_id, segment_id, CASE status WHEN 'F' THEN replace(text, ' costs ', ' is at ')
       ELSE replace(text, '1', '2') || CASE priority WHEN '2-HIGH' THEN repeat(' more', 30) ELSE '' END END AS text
FROM v_order_notes WHERE status <> 'P'
"""


def warnings(level):
    low, high = K.REVIEW_RATIO[level]
    s, b, r = "s.text", "s.text", "r.text"
    ratio = f"(CAST(length({strip(r)}) AS DOUBLE) / greatest(1, length({strip(b)})))"
    rules = [
        (f"{marks(b)} <> {marks(r)}", K.WARN_MATH),
        (f"{stable(b)} <> {stable(r)}", K.WARN_STABLE),
        (f"{numbers(b)} <> {numbers(r)}", K.WARN_NUMBER),
        (f"{references(b)} <> {references(r)}", K.WARN_REFERENCE),
        (f"({ratio} < {low} OR {ratio} > {high})", K.WARN_LENGTH),
    ]
    if level == "strict":
        rules.append((f"trim({s}) <> '' AND length({strip(r)}) < 20", K.WARN_SHORT))
    cases = ", ".join(f"CASE WHEN {rule} THEN {lit(text)} END" for rule, text in rules)
    return f"list_filter([{cases}], lambda w: w IS NOT NULL)"


def reviewed_sql(level):
    return f"""SELECT doc_id, segment_id,
      CASE WHEN new IS NULL THEN 'needs-review' WHEN len(w) > 0 THEN 'base-retained' ELSE 'approved' END AS review_status,
      CASE WHEN new IS NOT NULL AND len(w) = 0 THEN new ELSE base END AS text,
      CASE WHEN new IS NULL THEN {lit(K.WARN_MISSING)} ELSE {listed('w')} END AS warnings
    FROM (SELECT doc_id, segment_id, s.text AS base, r.text AS new, {warnings(level)} AS w
          FROM v_order_notes s LEFT JOIN v_revised r USING (doc_id, segment_id))"""


VIEWS["v_decided"] = reviewed_sql("strict")


def decided(spark, folder, level):
    notes = A.order_notes(spark, folder)
    text = F.col("text")
    revised = notes.where("status <> 'P'").select(
        "doc_id", "segment_id",
        F.when(F.col("status") == "F", F.replace(text, F.lit(" costs "), F.lit(" is at ")))
        .otherwise(F.concat(
            F.replace(text, F.lit("1"), F.lit("2")),
            F.when(F.col("priority") == "2-HIGH", " more" * 30).otherwise("")))
        .alias("text"),
    )
    base = notes.select("doc_id", "segment_id", "text")
    return R.select_reviewed(notes, base, revised, level)


def _select(level):
    def run(spark, folder):
        return decided(spark, folder, level).select(
            "doc_id", "segment_id", "review_status", "text", F.array_join("review_warnings", "|").alias("warnings")
        )

    return run


for _level in ("normal", "strict"):
    check(f"select_reviewed_{_level}", reviewed_sql(_level))(_select(_level))


@check(
    "status_counts",
    """SELECT coalesce(review_status, 'not-reviewed') AS review_status, count(*) AS segments FROM (
         SELECT review_status FROM v_decided UNION ALL SELECT NULL FROM conversations) GROUP BY ALL""",
)
def _(spark, folder):
    done = decided(spark, folder, "strict").select("review_status")
    other = A.table(spark, folder, "conversations").select(F.lit(None).cast("string").alias("review_status"))
    return I.status_counts(done.unionByName(other))


@check(
    "run_metadata",
    """SELECT doc_id, sum(n)::BIGINT AS native_page_count, sum(o)::BIGINT AS ocr_page_count,
              sum(a)::BIGINT AS reviewed_segment_count, sum(b)::BIGINT AS base_retained_segment_count,
              sum(m)::BIGINT AS math_object_count
       FROM (SELECT doc_id, (status = 'F')::INT AS n, (status <> 'F')::INT AS o, 0 AS a, 0 AS b, 0 AS m FROM v_order_notes
             UNION ALL SELECT doc_id, 0, 0, (review_status = 'approved')::INT,
                              (review_status IN ('base-retained', 'needs-review'))::INT, 0 FROM v_decided
             UNION ALL SELECT doc_id, 0, 0, 0, 0, 1 FROM v_math_objects)
       GROUP BY doc_id""",
)
def _(spark, folder):
    pages = A.order_notes(spark, folder).select(
        "doc_id", F.when(F.col("status") == "F", "native").otherwise("ocr").alias("method")
    )
    return I.run_metadata(pages, decided(spark, folder, "strict"), P.math_objects(math_protected(spark, folder)))


# ------------------------------------------------------------------ inference
# An order is a document of one batch; its lines are the segments.
VIEWS["v_asked"] = """
SELECT l_orderkey AS doc_id, 0 AS batch_id, position, 's' || position AS segment_id, 'part ' || l_partkey AS text,
       l_returnflag, l_linestatus, l_discount, l_tax
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS position FROM lineitem)
"""
VIEWS["v_raw_answers"] = f"""
SELECT doc_id, batch_id,
  CASE WHEN broken THEN substr(json, 1, length(json) - 3)
       WHEN fenced THEN '  ```json' || {NL} || json || {NL} || '``` ' ELSE json END AS raw
FROM (SELECT doc_id, batch_id, max(l_tax) = 0 AS broken, min(l_linestatus) = 'F' AS fenced,
        '{{"segments":' || to_json(list({{'segmentId': CASE WHEN l_returnflag = 'R' THEN 'x' ELSE '' END || segment_id,
                                        'text': CASE WHEN l_discount = 0 THEN ' ' ELSE 'es ' || text END}} ORDER BY position)
                                   FILTER (l_tax > 0 OR l_returnflag <> 'N'))::VARCHAR || '}}' AS json
      FROM v_asked GROUP BY doc_id, batch_id)
"""
VIEWS["v_received"] = """
SELECT doc_id, batch_id, generate_subscripts(items, 1) AS position,
       unnest(items)->>'segmentId' AS segment_id, unnest(items)->>'text' AS text
FROM (SELECT doc_id, batch_id, CAST(json_extract(body, '$.segments') AS JSON[]) AS items
      FROM (SELECT doc_id, batch_id, trim(regexp_replace(regexp_replace(trim(raw), '^```(?:json)?', ''), '```$', ''), chr(10) || ' ') AS body
            FROM v_raw_answers)
      WHERE json_valid(body))
"""


def asked(spark, folder) -> DataFrame:
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return A.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.lit(0).alias("batch_id"),
        F.row_number().over(at).alias("position"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"),
        "l_returnflag", "l_linestatus", "l_discount", "l_tax",
    ).withColumn("segment_id", F.concat(F.lit("s"), F.col("position").cast("string"))).withColumn(
        "ordinal", F.col("position")
    )


def raw_answers(spark, folder) -> DataFrame:
    kept = (F.col("l_tax") > 0) | (F.col("l_returnflag") != "N")
    item = F.struct(
        "position",
        F.concat(F.when(F.col("l_returnflag") == "R", "x").otherwise(""), "segment_id").alias("segmentId"),
        F.when(F.col("l_discount") == 0, " ").otherwise(F.concat(F.lit("es "), "text")).alias("text"),
    )
    items = F.array_sort(F.collect_list(F.when(kept, item)))
    json = F.to_json(F.struct(
        F.transform(items, lambda s: F.struct(s["segmentId"].alias("segmentId"), s["text"].alias("text"))).alias("segments")
    ))
    grouped = asked(spark, folder).groupBy("doc_id", "batch_id").agg(
        (F.max("l_tax") == 0).alias("broken"), (F.min("l_linestatus") == "F").alias("fenced"), json.alias("json")
    )
    return grouped.select(
        "doc_id", "batch_id",
        F.when(F.col("broken"), F.substr("json", F.lit(1), F.length("json") - 3))
        .when(F.col("fenced"), F.concat(F.lit("  ```json\n"), "json", F.lit("\n``` ")))
        .otherwise(F.col("json")).alias("raw"),
    )


@check(
    "request_payload",
    """SELECT doc_id, batch_id, to_json(list({'segmentId': segment_id, 'text': text} ORDER BY position))::VARCHAR AS payload
       FROM v_asked GROUP BY doc_id, batch_id""",
)
def _(spark, folder):
    return I.request_payload(asked(spark, folder))


@check(
    "batch_admission",
    """SELECT doc_id, batch_id, count(*) AS segments, sum(strlen(text))::BIGINT AS bytes,
              sum(CASE WHEN trim(text) = '' THEN 1 ELSE 0 END)::BIGINT AS blank, count(DISTINCT segment_id) AS ids,
              count(*) <= 24 AND sum(strlen(text)) <= 8000 AND bool_and(trim(text) <> '')
                AND count(DISTINCT segment_id) = count(*) AS admitted
       FROM (SELECT doc_id, lang_no AS batch_id, 'p' || n AS segment_id, text FROM (
               SELECT doc_id // 8 AS doc_id, 0 AS lang_no, source AS n, text FROM documents)) GROUP BY ALL""",
)
def _(spark, folder):
    batched = A.texts(spark, folder, "documents").select(
        F.floor(F.col("doc_id") / 8).alias("doc_id"), F.lit(0).alias("batch_id"),
        F.concat(F.lit("p"), "source").alias("segment_id"), "text",
    )
    return I.batch_admission(batched)


@check(
    "review_admission",
    """SELECT doc_id, 0 AS batch_id, count(*) AS segments, sum(strlen(text) + strlen(upper(lang)))::BIGINT AS bytes,
              sum(CASE WHEN trim(text) = '' THEN 1 ELSE 0 END)::BIGINT AS blank, count(DISTINCT source) AS ids,
              count(*) <= 12 AND sum(strlen(text) + strlen(upper(lang))) <= 7000 AND bool_and(trim(text) <> '') AS admitted
       FROM (SELECT doc_id // 4 AS doc_id, source, text, lang FROM documents) GROUP BY doc_id""",
)
def _(spark, folder):
    batched = A.texts(spark, folder, "documents").select(
        F.floor(F.col("doc_id") / 4).alias("doc_id"), F.lit(0).alias("batch_id"),
        F.col("source").alias("segment_id"), F.col("text").alias("source_text"), F.upper("lang").alias("base_text"),
    )
    return I.batch_admission(batched, "review")


@check("parse_envelope", "SELECT doc_id, batch_id, position, segment_id, text FROM v_received")
def _(spark, folder):
    return I.parsed_outputs(raw_answers(spark, folder))


@check(
    "reconcile_outputs",
    """SELECT doc_id, batch_id, position, segment_id, matched_by, text,
              CASE WHEN matched_by = 'none' THEN 'count' WHEN trim(coalesce(text, '')) = '' THEN 'empty' END AS error
       FROM (SELECT a.doc_id, a.batch_id, a.position, a.segment_id, m.matched_by,
               CASE m.matched_by WHEN 'identifier' THEN i.text WHEN 'position' THEN p.text END AS text
             FROM v_asked a
             JOIN (SELECT x.doc_id, CASE WHEN coalesce(y.n, 0) <> x.n THEN 'none' WHEN x.ids = y.ids THEN 'identifier' ELSE 'position' END AS matched_by
                   FROM (SELECT doc_id, count(*) AS n, list_sort(list(DISTINCT segment_id)) AS ids FROM v_asked GROUP BY doc_id) x
                   LEFT JOIN (SELECT doc_id, count(*) AS n, list_sort(list(DISTINCT segment_id)) AS ids FROM v_received GROUP BY doc_id) y
                   USING (doc_id)) m USING (doc_id)
             LEFT JOIN v_received i ON i.doc_id = a.doc_id AND i.segment_id = a.segment_id
             LEFT JOIN v_received p ON p.doc_id = a.doc_id AND p.position = a.position)""",
)
def _(spark, folder):
    return I.reconcile_outputs(asked(spark, folder), I.parsed_outputs(raw_answers(spark, folder)))


def _echo_model():
    """A stand-in for a user's model: takes four segments at most, answers with a prefix."""

    def call(segments):
        if len(segments) > 4:
            raise ValueError("The model did not preserve every segment identifier.")
        return {"segments": [{"segmentId": s["segmentId"], "text": "es " + s["text"]} for s in segments],
                "prompt_token_count": len(segments)}

    return call


@check(
    "run_batches",
    """SELECT doc_id, batch_id, string_agg(segment_id || '=es ' || text, '|' ORDER BY position) AS answer,
              count(*) AS prompt_token_count,
              CASE WHEN count(*) <= 4 THEN 1 WHEN count(*) <= 8 THEN 3 WHEN count(*) = 9 THEN 5
                   WHEN count(*) <= 16 THEN CASE WHEN (count(*) + 1) // 2 > 4 THEN 3 ELSE 1 END
                     + CASE WHEN count(*) // 2 > 4 THEN 3 ELSE 1 END + 1 END AS calls
       FROM v_asked GROUP BY doc_id, batch_id""",
)
def _(spark, folder):
    answers = I.run_batches(I.request_payload(asked(spark, folder)), _echo_model)
    return answers.select(
        "doc_id", "batch_id",
        F.array_join(F.transform("segments", lambda s: F.concat(s["segmentId"], F.lit("="), s["text"])), "|").alias("answer"),
        "prompt_token_count", "calls",
    )


def _careless_model():
    """A stand-in that, by the length of a segment, leaves it out, blanks it, or gives it another identifier."""

    def call(segments):
        kept = [(s, len(s["text"]) % 97) for s in segments if len(s["text"]) % 97 != 0]
        return {"segments": [
            {"segmentId": "other" if kind == 2 else s["segmentId"], "text": " " if kind == 1 else "es " + s["text"]} for s, kind in kept
        ]}

    return call


@check(
    "checked_batches",
    """SELECT doc_id, batch_id, count(*) FILTER (length(text) % 97 IN (0, 1)) > 0 AS failed,
              CASE WHEN count(*) FILTER (length(text) % 97 IN (0, 1)) = 0
                   THEN string_agg(segment_id || '=es ' || text, '|' ORDER BY position) END AS answer
       FROM v_asked GROUP BY doc_id, batch_id""",
)
def _(spark, folder):
    answers = I.run_batches(I.request_payload(asked(spark, folder)), _careless_model)
    said = F.array_join(F.transform("segments", lambda s: F.concat(s["segmentId"], F.lit("="), s["text"])), "|")
    failed = F.col("error").isNotNull()
    return answers.select("doc_id", "batch_id", failed.alias("failed"), F.when(~failed, said).alias("answer"))


class _Stopped(BaseException):
    """What no retry catches: a process that is told to end."""


def _stopping_model():
    """Answers like the other stand-in until it is asked for a batch of more than ten segments."""
    echo = _echo_model()

    def call(segments):
        if len(segments) > 10:
            raise _Stopped("told to stop")
        return echo(segments)

    return call


@check(
    "resumed_batches",
    """SELECT doc_id, batch_id, string_agg(segment_id || '=es ' || text, '|' ORDER BY position) AS answer, 1::BIGINT AS tries
       FROM v_asked GROUP BY doc_id, batch_id""",
)
def _(spark, folder):
    requests, ledger = keep(I.request_payload(asked(spark, folder))), f"{checkpoint_folder(spark)}/ledger-{uuid.uuid4().hex}"
    try:
        run_batches_once(requests, _stopping_model, ledger, flush=4)
    except PySparkException as error:
        if "told to stop" not in str(error):
            raise
    answers = run_batches_once(requests, _echo_model, ledger)
    return answers.select(
        "doc_id", "batch_id",
        F.array_join(F.transform("segments", lambda s: F.concat(s["segmentId"], F.lit("="), s["text"])), "|").alias("answer"), "tries",
    )


FAILURES = [
    ("view", "extracting", "Connection refused by worker "),
    ("click", "translating", "Ollama rechazó la traducción (HTTP 503). Caso "),
    ("signup", "loading", "Not a PDF file: "),
    ("purchase", "reviewing", "The selected model is not installed: "),
    ("error", "saving", "Access is denied to file "),
]
VIEWS["v_failures"] = "SELECT event_id, stage, detail FROM (SELECT event_id, CASE event_type " + " ".join(
    f"WHEN {lit(t)} THEN {lit(s)}" for t, s, _ in FAILURES
) + " END AS stage, CASE event_type " + " ".join(
    f"WHEN {lit(t)} THEN {lit(d)} || user_id" for t, _, d in FAILURES
) + " END AS detail FROM events)"


def failure_sql():
    rules = " ".join(
        f"WHEN {matches('detail', p)} THEN {{'code': {lit(c)}, 'recoverable': {str(r).lower()}, 'action': {lit(a)}}}"
        for p, c, r, a in K.FAILURE_RULES
    )
    fall = "CASE stage " + " ".join(f"WHEN {lit(s)} THEN {lit(c)}" for s, c in K.STAGE_FALLBACK.items()) + " ELSE 'UNKNOWN' END"
    advice = "CASE fall " + " ".join(f"WHEN {lit(c)} THEN {lit(a)}" for c, a in K.FALLBACK_ACTIONS.items()) + (
        f" ELSE {lit(K.FALLBACK_ACTIONS['UNKNOWN'])} END")
    label = "CASE stage " + " ".join(f"WHEN {lit(s)} THEN {lit(a)}" for s, a in K.STAGE_LABELS.items()) + " END"
    return f"""SELECT event_id, stage, detail, f.code, f.recoverable, f.action,
        CASE WHEN contains(m, detail) THEN m ELSE m || ' Detalle: ' || detail END AS message
      FROM (SELECT *, 'No se pudo ' || {label} || '. ' || f.action AS m
            FROM (SELECT *, CASE {rules} ELSE {{'code': fall, 'recoverable': fall <> 'PDF_LOAD_FAILED', 'action': {advice}}} END AS f
                  FROM (SELECT *, {fall} AS fall FROM v_failures)))"""


def failures(spark, folder) -> DataFrame:
    stage = detail = None
    for kind, at, message in FAILURES:
        is_kind = F.col("event_type") == kind
        text = F.concat(F.lit(message), F.col("user_id").cast("string"))
        stage = F.when(is_kind, at) if stage is None else stage.when(is_kind, at)
        detail = F.when(is_kind, text) if detail is None else detail.when(is_kind, text)
    return A.table(spark, folder, "events").select("event_id", stage.alias("stage"), detail.alias("detail"))


@check("classify_failures", failure_sql())
def _(spark, folder):
    return I.classify_failures(failures(spark, folder))


@check(
    "failure_report",
    f"""SELECT stage, code, coalesce(kind, 'none') AS kind, count(*) AS failures FROM (
          SELECT stage, code, CASE WHEN {matches('detail', K.OUTPUT_FAILURE)} THEN 'output'
                                   WHEN {matches('detail', K.SERVER_FAILURE)} THEN 'server' END AS kind
          FROM ({failure_sql()})) GROUP BY ALL""",
)
def _(spark, folder):
    done = I.classify_failures(failures(spark, folder))
    return done.groupBy(
        "stage", "code", F.coalesce(I.failure_kind(F.col("detail")), F.lit("none")).alias("kind")
    ).agg(F.count("*").alias("failures"))


@check(
    "batch_counters",
    """SELECT l_suppkey AS doc_id, count(*) AS batches, sum(CAST(l_quantity AS BIGINT))::BIGINT AS elapsed_ms,
              sum(CASE WHEN l_returnflag = 'R' THEN l_partkey END)::BIGINT AS prompt_token_count,
              sum(CASE WHEN l_discount > 0.1 THEN 1 END)::BIGINT AS output_token_count
       FROM lineitem GROUP BY l_suppkey""",
)
def _(spark, folder):
    answers = A.table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_quantity").cast("long").alias("elapsed_ms"),
        F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).alias("prompt_token_count"),
        F.when(F.col("l_discount") > 0.1, F.lit(1)).alias("output_token_count"),
    )
    return I.batch_counters(answers)


# The model leaves captions of tables blank, whatever it is asked with: documents that have one are not published.
@check(
    "process",
    """SELECT doc_id, CASE WHEN blank = 0 THEN 'published' ELSE 'failed' END AS outcome, CASE WHEN blank = 0 THEN segments END AS translations,
              CASE WHEN blank > 0 THEN 'Incomplete' END AS reason
       FROM (SELECT doc_id, count(*) AS segments, count(*) FILTER (text LIKE '%Items of the order%') AS blank FROM v_segments GROUP BY doc_id)""",
)
def _(spark, folder):
    def model():
        def call(batch):
            return {"segments": [{"segmentId": s["segmentId"], "text": "  " if "Items of the order" in s["text"] else "ES " + s["text"]} for s in batch]}

        return call

    out = process(A.corpus_pages(spark, folder), model)
    published = out["translations"].groupBy("doc_id").agg(F.count("*").alias("translations")).select(
        "doc_id", F.lit("published").alias("outcome"), "translations", F.lit(None).cast("string").alias("reason")
    )
    failed = out["failures"].where("batch_id IS NULL AND detail LIKE 'Incomplete%'")
    return published.unionByName(
        failed.select("doc_id", F.lit("failed").alias("outcome"), F.lit(None).cast("long").alias("translations"), F.substring("detail", 1, 10).alias("reason"))
    )
