"""File catalogs and the library tree.

Files come from the documents: English ones are originals, the others
translations; four neighbouring documents share a pair key.  Labelled documents
are catalogued; toxic ones were moved, low-quality ones changed since.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext import constants as K
from bitext.functions import paths as PF
from bitext.operators import catalog as C
from bitext.operators import library as L
from bitext.plans.lineage import cut
from checks import adapters as A
from checks.register import registry
from checks.sql import VIEWS, lit, re2

QUERIES, SQL, check = registry()

# ------------------------------------------------------------------ adapters


def files(spark, folder) -> DataFrame:
    d = F.col("doc_id")
    k = F.floor(d / 4)
    place = F.concat(F.lit("/Set"), (k % 5).cast("string"), F.lit("/Part "), (k % 12).cast("string"), F.lit("/Dó"), k.cast("string"))
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("", ".en", ".ES", ".pt")]), (d % 4 + 1).cast("int"))
    ext = F.element_at(F.array(*[F.lit(x) for x in ("md", "markdown", "txt", "pdf")]), (d % 4 + 1).cast("int"))
    original = F.col("lang") == "en"
    return A.texts(spark, folder, "documents").select(
        "doc_id",
        F.concat(F.lit("p"), F.floor(d / 200).cast("string")).alias("project_id"),
        F.when(original, "original").otherwise("translation").alias("side"),
        F.when(original, F.concat(F.lit("C_orig"), place, suffix, F.lit(".pdf")))
        .otherwise(F.concat(F.lit("C_trad"), place, F.lit("."), "lang", F.lit("."), ext)).alias("relative_path"),
        F.sha2("text", 256).alias("sha256"),
        F.col("n_chars").alias("size"),
        (F.lit(1700000000) + d * 60).alias("modified_at"),
        PF.media_type(F.when(original, "pdf").otherwise(ext)).alias("media_type"),
    )


def projects(spark, folder) -> DataFrame:
    return A.table(spark, folder, "documents").select(
        F.concat(F.lit("p"), F.floor(F.col("doc_id") / 200).cast("string")).alias("project_id")
    ).distinct().select(
        "project_id", F.lit("C_orig").alias("original_dir"), F.lit("C_trad").alias("translation_dir")
    )


def catalog(spark, folder) -> DataFrame:
    labelled = files(spark, folder).join(A.table(spark, folder, "labels"), "doc_id")
    path = F.when(F.col("toxic") == 1, F.regexp_replace("relative_path", "^(C_orig|C_trad)/", "$1/old/")).otherwise(
        F.when(F.col("quality") == 0, F.concat(F.lit("C_orig/gone/"), F.col("doc_id").cast("string"), F.lit(".pdf")))
        .otherwise(F.col("relative_path"))
    )
    sha = F.when(F.col("quality") == 0, F.sha2("relative_path", 256)).otherwise(F.col("sha256"))
    ref = F.struct(
        path.alias("relative_path"), sha.alias("sha256"), "size", (F.col("modified_at") - 1000).alias("modified_at"), "media_type"
    )
    other = F.struct(
        F.concat(F.regexp_replace(PF.stem(F.col("relative_path")), "^C_orig/", "C_trad/"), F.lit(".de.md")).alias("relative_path"),
        F.lit("none").alias("sha256"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("modified_at"),
        F.lit("text/markdown").alias("media_type"),
    )
    original = F.col("side") == "original"
    return labelled.select(
        "project_id",
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("document_id"),
        F.col("doc_id").alias("ordinal"),
        F.when(original, ref).alias("original"),
        F.when(~original, ref).when(F.col("toxic") == 1, other).alias("translation"),
        ((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("hidden"),
    )


def plain_files(spark, folder) -> DataFrame:
    return files(spark, folder).drop("doc_id")


KEY = f"""lower(regexp_replace(regexp_replace(regexp_replace(replace(PATH, chr(92), '/'), '^(C_orig|C_trad)/', ''),
          '([^/])\\.[^./]*$', '\\1'), {re2(K.LANGUAGE_SUFFIX)}, ''))"""


def key(path):
    return KEY.replace("PATH", path)


VIEWS["v_files"] = """
SELECT doc_id, 'p' || (doc_id // 200) AS project_id,
  CASE WHEN lang = 'en' THEN 'original' ELSE 'translation' END AS side,
  CASE WHEN lang = 'en' THEN 'C_orig' || place || ['', '.en', '.ES', '.pt'][doc_id % 4 + 1] || '.pdf'
       ELSE 'C_trad' || place || '.' || lang || '.' || ext END AS relative_path,
  sha256(text) AS sha256, n_chars AS size, 1700000000 + doc_id * 60 AS modified_at,
  CASE WHEN lang = 'en' OR ext = 'pdf' THEN 'application/pdf' WHEN ext IN ('md', 'markdown') THEN 'text/markdown'
       ELSE 'text/plain' END AS media_type
FROM (SELECT *, '/Set' || ((doc_id // 4) % 5) || '/Part ' || ((doc_id // 4) % 12) || '/Dó' || (doc_id // 4) AS place,
        ['md', 'markdown', 'txt', 'pdf'][doc_id % 4 + 1] AS ext FROM documents)
"""
VIEWS["v_sides"] = """
SELECT project_id, 'doc' || doc_id AS document_id, doc_id AS ordinal, side, quality = 0 AND toxic = 1 AS hidden,
  CASE WHEN toxic = 1 THEN regexp_replace(relative_path, '^(C_orig|C_trad)/', '\\1/old/')
       WHEN quality = 0 THEN 'C_orig/gone/' || doc_id || '.pdf' ELSE relative_path END AS relative_path,
  CASE WHEN quality = 0 THEN sha256(relative_path) ELSE sha256 END AS sha256,
  size, modified_at - 1000 AS modified_at, media_type
FROM v_files JOIN labels USING (doc_id)
UNION ALL
SELECT project_id, 'doc' || doc_id, doc_id, 'translation', quality = 0 AND toxic = 1,
  regexp_replace(regexp_replace(relative_path, '\\.[^./]*$', ''), '^C_orig/', 'C_trad/') || '.de.md', 'none', 0, 0, 'text/markdown'
FROM v_files JOIN labels USING (doc_id) WHERE side = 'original' AND toxic = 1
"""
VIEWS["v_by_path"] = """
SELECT f.*, document_id FROM v_files f JOIN (
  SELECT *, row_number() OVER (PARTITION BY project_id, side, relative_path ORDER BY ordinal) AS n FROM v_sides) s
USING (project_id, side, relative_path) WHERE n = 1
"""
VIEWS["v_by_content"] = """
SELECT f.* EXCLUDE (n), s.document_id FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, side, sha256, size ORDER BY relative_path) AS n FROM v_files f
  WHERE NOT EXISTS (SELECT 1 FROM v_by_path p WHERE p.project_id = f.project_id AND p.side = f.side AND p.relative_path = f.relative_path)) f
JOIN (
  SELECT *, row_number() OVER (PARTITION BY project_id, side, sha256, size ORDER BY ordinal) AS n FROM v_sides s
  WHERE NOT EXISTS (SELECT 1 FROM v_by_path p WHERE p.document_id = s.document_id AND p.side = s.side)) s
USING (project_id, side, sha256, size, n)
"""
VIEWS["v_refreshed"] = """
SELECT s.project_id, s.document_id, s.ordinal, s.side, coalesce(f.relative_path, s.relative_path) AS relative_path,
  coalesce(f.sha256, s.sha256) AS sha256, coalesce(f.size, s.size) AS size,
  coalesce(f.modified_at, s.modified_at) AS modified_at, coalesce(f.media_type, s.media_type) AS media_type,
  f.relative_path IS NOT NULL AS available
FROM v_sides s LEFT JOIN (SELECT * FROM v_by_path UNION ALL SELECT * FROM v_by_content) f
ON f.document_id = s.document_id AND f.side = s.side
"""
VIEWS["v_spare"] = f"""
SELECT f.*, {key('relative_path')} AS pair_key FROM v_files f WHERE NOT EXISTS (
  SELECT 1 FROM v_refreshed r WHERE r.available AND r.project_id = f.project_id AND r.side = f.side AND r.relative_path = f.relative_path)
"""
VIEWS["v_adopted"] = f"""
SELECT w.document_id, w.ordinal, o.* EXCLUDE (n, doc_id, pair_key) FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, side, pair_key ORDER BY ordinal) AS n FROM (
    SELECT project_id, document_id, min(ordinal) AS ordinal, {key('min(relative_path)')} AS pair_key,
           CASE min(side) WHEN 'original' THEN 'translation' ELSE 'original' END AS side
    FROM v_refreshed GROUP BY project_id, document_id HAVING count(*) = 1)) w
JOIN (SELECT *, row_number() OVER (PARTITION BY project_id, side, pair_key ORDER BY relative_path) AS n FROM v_spare) o
USING (project_id, side, pair_key, n)
"""
VIEWS["v_settled"] = """
SELECT project_id, document_id, ordinal, side, relative_path, sha256, size, modified_at, media_type, available FROM v_refreshed
UNION ALL SELECT project_id, document_id, ordinal, side, relative_path, sha256, size, modified_at, media_type, true FROM v_adopted
"""
VIEWS["v_fresh"] = """
SELECT coalesce(o.project_id, t.project_id) AS project_id,
  sha256(concat_ws(':', '', coalesce(o.project_id, t.project_id), coalesce(o.relative_path, ''), coalesce(o.sha256, ''),
                   coalesce(t.relative_path, ''), coalesce(t.sha256, ''))) AS document_id,
  o.relative_path AS original_path, t.relative_path AS translation_path,
  o.modified_at AS original_time, t.modified_at AS translation_time,
  row_number() OVER (PARTITION BY coalesce(o.project_id, t.project_id)
    ORDER BY coalesce(o.pair_key, t.pair_key), o.relative_path NULLS LAST, t.relative_path) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY project_id, pair_key ORDER BY relative_path) AS n FROM v_unused WHERE side = 'original') o
FULL JOIN (SELECT *, row_number() OVER (PARTITION BY project_id, pair_key ORDER BY relative_path) AS n FROM v_unused WHERE side = 'translation') t
ON o.project_id = t.project_id AND o.pair_key = t.pair_key AND o.n = t.n
"""
VIEWS["v_unused"] = """
SELECT * FROM v_spare f WHERE NOT EXISTS (
  SELECT 1 FROM v_adopted a WHERE a.project_id = f.project_id AND a.side = f.side AND a.relative_path = f.relative_path)
"""
VIEWS["v_records"] = """
SELECT c.project_id, c.document_id, c.hidden, o.relative_path AS original_path, t.relative_path AS translation_path,
       o.modified_at AS original_time, t.modified_at AS translation_time,
       coalesce(o.available, false) AS oa, coalesce(t.available, false) AS ta, c.ordinal
FROM (SELECT DISTINCT project_id, document_id, hidden, ordinal FROM v_sides) c
LEFT JOIN v_settled o ON o.document_id = c.document_id AND o.side = 'original'
LEFT JOIN v_settled t ON t.document_id = c.document_id AND t.side = 'translation'
UNION ALL
SELECT project_id, document_id, false, original_path, translation_path, original_time, translation_time,
       original_path IS NOT NULL, translation_path IS NOT NULL,
       coalesce((SELECT max(ordinal) FROM v_sides s WHERE s.project_id = f.project_id), -1) + place FROM v_fresh f
"""
VIEWS["v_conflicts"] = f"""
SELECT DISTINCT project_id, k AS pair_key FROM (
  SELECT project_id, 'o' AS side, {key('original_path')} AS k FROM v_records WHERE oa
  UNION ALL SELECT project_id, 't', {key('translation_path')} FROM v_records WHERE ta)
GROUP BY project_id, side, k HAVING count(*) > 1
"""
VIEWS["v_summaries"] = f"""
SELECT r.project_id, r.document_id, hidden, original_path, translation_path, original_time, translation_time,
  coalesce(nullif(string_split(coalesce(ok, tk), '/')[-1], ''), {lit(K.UNTITLED)}) AS title,
  CASE WHEN c.pair_key IS NOT NULL THEN 'conflict'
       WHEN (original_path IS NOT NULL AND NOT oa) OR (translation_path IS NOT NULL AND NOT ta) THEN 'unavailable'
       WHEN oa AND ta AND ok = tk THEN 'paired' WHEN oa AND ta THEN 'manually-linked'
       WHEN oa THEN 'missing-translation' WHEN ta THEN 'missing-original' ELSE 'unavailable' END AS pair_state
FROM (SELECT *, {key('original_path')} AS ok, {key('translation_path')} AS tk FROM v_records) r
LEFT JOIN v_conflicts c ON c.project_id = r.project_id AND c.pair_key = coalesce(ok, tk)
"""


def records(spark, folder) -> DataFrame:
    return cut(C.reconcile(catalog(spark, folder), plain_files(spark, folder), projects(spark, folder)))


def summaries(spark, folder) -> DataFrame:
    return C.summaries(records(spark, folder), projects(spark, folder))


# -------------------------------------------------------------------- queries


@check("files", "SELECT * EXCLUDE (doc_id) FROM v_files")
def _(spark, folder):
    return plain_files(spark, folder)


@check("pair_key", f"SELECT project_id, relative_path, {key('relative_path')} AS pair_key FROM v_files")
def _(spark, folder):
    return C.with_keys(
        plain_files(spark, folder), projects(spark, folder), F.col("relative_path"), F.col("side")
    ).select("project_id", "relative_path", "pair_key")


@check(
    "folders",
    """SELECT DISTINCT project_id, array_to_string(p[1:n], '/') AS relative_path, p[n] AS name
       FROM (SELECT project_id, p, unnest(range(1, len(p) + 1)) AS n
             FROM (SELECT project_id, string_split(relative_path, '/')[2:-2] AS p FROM v_files
                   UNION ALL SELECT 'p' || (doc_id // 200), ['Empty', source] FROM documents))""",
)
def _(spark, folder):
    explicit = A.table(spark, folder, "documents").select(
        F.concat(F.lit("p"), F.floor(F.col("doc_id") / 200).cast("string")).alias("project_id"),
        F.concat(F.lit("Empty/"), "source").alias("relative_path"),
    ).distinct()
    return C.folders(plain_files(spark, folder), projects(spark, folder), explicit)


@check(
    "refresh_references",
    "SELECT project_id, document_id, side, relative_path, sha256, size, modified_at, media_type, available FROM v_refreshed",
)
def _(spark, folder):
    return C.refresh_references(catalog(spark, folder), plain_files(spark, folder)).drop("ordinal")


@check("adopt_counterparts", "SELECT project_id, document_id, side, relative_path, sha256 FROM v_adopted")
def _(spark, folder):
    sides = cut(C.refresh_references(catalog(spark, folder), plain_files(spark, folder)))
    return C.adopt_counterparts(sides, plain_files(spark, folder), projects(spark, folder)).select(
        "project_id", "document_id", "side", "relative_path", "sha256"
    )


@check(
    "pair_new_files",
    """SELECT coalesce(o.project_id, t.project_id) AS project_id, o.relative_path AS original_path,
              t.relative_path AS translation_path,
              sha256(concat_ws(':', 'first', coalesce(o.project_id, t.project_id), coalesce(o.relative_path, ''), coalesce(o.sha256, ''),
                     coalesce(t.relative_path, ''), coalesce(t.sha256, ''))) AS document_id
       FROM (SELECT *, row_number() OVER (PARTITION BY project_id, k ORDER BY relative_path) AS n FROM (SELECT *, KEY AS k FROM v_files) WHERE side = 'original') o
       FULL JOIN (SELECT *, row_number() OVER (PARTITION BY project_id, k ORDER BY relative_path) AS n FROM (SELECT *, KEY AS k FROM v_files) WHERE side = 'translation') t
       ON o.project_id = t.project_id AND o.k = t.k AND o.n = t.n""".replace("KEY", key("relative_path")),
)
def _(spark, folder):
    return C.pair_new_files(plain_files(spark, folder), projects(spark, folder), "first").select(
        "project_id", "document_id", F.col("original.relative_path").alias("original_path"),
        F.col("translation.relative_path").alias("translation_path"),
    )


@check(
    "reconcile",
    """SELECT project_id, document_id, ordinal, hidden, original_path, translation_path,
              oa AS original_available, ta AS translation_available FROM v_records""",
)
def _(spark, folder):
    return records(spark, folder).select(
        "project_id", "document_id", "ordinal", "hidden", F.col("original.relative_path").alias("original_path"),
        F.col("translation.relative_path").alias("translation_path"), "original_available", "translation_available",
    )


@check("conflict_keys", "SELECT project_id, pair_key FROM v_conflicts")
def _(spark, folder):
    return C.conflict_keys(records(spark, folder), projects(spark, folder))


@check("pair_state", "SELECT project_id, document_id, title, pair_state, hidden FROM v_summaries")
def _(spark, folder):
    return summaries(spark, folder).select("project_id", "document_id", "title", "pair_state", "hidden")


@check(
    "pair_state_counts",
    "SELECT project_id, pair_state, "
    "CASE pair_state " + " ".join(f"WHEN {lit(s)} THEN {lit(i)}" for s, (i, _) in K.PAIR_STATES.items()) + " END AS icon, "
    "CASE pair_state " + " ".join(f"WHEN {lit(s)} THEN {lit(n)}" for s, (_, n) in K.PAIR_STATES.items()) + " END AS label, "
    "count(*) AS documents FROM v_summaries WHERE NOT hidden GROUP BY ALL",
)
def _(spark, folder):
    counted = C.visible_documents(summaries(spark, folder)).groupBy("project_id", "pair_state").agg(
        F.count("*").alias("documents")
    )
    shown = C.present_pair_state(F.col("pair_state"))
    return counted.select("project_id", "pair_state", shown["icon"].alias("icon"), shown["label"].alias("label"), "documents")


@check(
    "visible_documents",
    "SELECT project_id, document_id, title, pair_state FROM v_summaries WHERE NOT hidden",
)
def _(spark, folder):
    return C.visible_documents(summaries(spark, folder)).select("project_id", "document_id", "title", "pair_state")


@check(
    "hidden_documents",
    """SELECT project_id, document_id, 'unavailable' AS pair_state,
              regexp_replace(string_split(coalesce(original_path, translation_path), '/')[-1], '\\.[^.]*$', '') AS title
       FROM v_summaries WHERE hidden""",
)
def _(spark, folder):
    return C.hidden_documents(summaries(spark, folder)).select("project_id", "document_id", "title", "pair_state")


# Events act on the catalogued document of their user.
ACTION = {"view": "hide", "click": "restore", "error": "delete-original", "purchase": "delete-translation", "signup": "archive"}


def actions(spark, folder) -> DataFrame:
    """Events with large values erase both files; the others map by type."""
    chain = None
    for kind, name in ACTION.items():
        is_kind = F.col("event_type") == kind
        chain = F.when(is_kind, name) if chain is None else chain.when(is_kind, name)
    return A.table(spark, folder, "events").select(
        F.concat(F.lit("p"), F.floor(F.col("event_id") / 200).cast("string")).alias("project_id"),
        F.concat(F.lit("doc"), F.col("event_id").cast("string")).alias("document_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("value") > 100, "delete-both").otherwise(chain).alias("action"),
    ).unionByName(
        A.table(spark, folder, "events").select(
            F.concat(F.lit("p"), F.floor(F.col("user_id") / 200).cast("string")).alias("project_id"),
            F.concat(F.lit("doc"), F.col("user_id").cast("string")).alias("document_id"),
            F.col("event_id").alias("seq"),
            F.when(F.col("value") > 480, "delete-both")
            .when(F.col("event_type").isin("view", "click"), chain).otherwise("hide").alias("action"),
        )
    )


MAPPED = "CASE event_type " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in ACTION.items()) + " END"
VIEWS["v_actions"] = f"""
SELECT 'p' || (event_id // 200) AS project_id, 'doc' || event_id AS document_id, event_id AS seq,
       CASE WHEN value > 100 THEN 'delete-both' ELSE {MAPPED} END AS action FROM events
UNION ALL
SELECT 'p' || (user_id // 200), 'doc' || user_id, event_id,
       CASE WHEN value > 480 THEN 'delete-both' WHEN event_type IN ('view', 'click') THEN {MAPPED} ELSE 'hide' END FROM events
"""
VIEWS["v_catalog"] = """
SELECT project_id, document_id, any_value(ordinal) AS ordinal, any_value(hidden) AS hidden,
       max(relative_path) FILTER (side = 'original') AS original_path,
       max(relative_path) FILTER (side = 'translation') AS translation_path
FROM v_sides GROUP BY project_id, document_id
"""


@check(
    "catalog_actions",
    """SELECT project_id, document_id, hidden, original_path, translation_path FROM (
         SELECT c.project_id, c.document_id, coalesce(e.h, c.hidden) AS hidden,
                CASE WHEN coalesce(e.o, false) THEN NULL ELSE original_path END AS original_path,
                CASE WHEN coalesce(e.t, false) THEN NULL ELSE translation_path END AS translation_path
         FROM v_catalog c LEFT JOIN (
           SELECT document_id, bool_or(action IN ('delete-original', 'delete-both')) AS o,
                  bool_or(action IN ('delete-translation', 'delete-both')) AS t,
                  arg_max(action, seq) FILTER (action <> 'delete-both') = 'hide' AS h
           FROM v_actions WHERE action <> 'archive' GROUP BY document_id) e USING (document_id))
       WHERE original_path IS NOT NULL OR translation_path IS NOT NULL""",
)
def _(spark, folder):
    return C.apply_catalog_actions(catalog(spark, folder), actions(spark, folder)).select(
        "project_id", "document_id", "hidden", F.col("original.relative_path").alias("original_path"),
        F.col("translation.relative_path").alias("translation_path"),
    )


@check(
    "rejected_actions",
    """SELECT reason, action, count(*) AS actions FROM (
         SELECT action, CASE WHEN action = 'archive' THEN 'unknown action' WHEN c.document_id IS NULL THEN 'unknown document' END AS reason
         FROM v_actions a LEFT JOIN v_catalog c USING (project_id, document_id)) WHERE reason IS NOT NULL GROUP BY ALL""",
)
def _(spark, folder):
    return C.rejected_actions(catalog(spark, folder), actions(spark, folder)).groupBy("reason", "action").agg(
        F.count("*").alias("actions")
    )


# Every document is imported again, into a folder of its source; English ones under their own name.
VIEWS["v_incoming"] = """
SELECT project_id, doc_id AS seq, CASE WHEN side = 'original' THEN array_to_string(string_split(relative_path, '/')[2:-2], '/')
         ELSE source END AS folder,
       string_split(relative_path, '/')[-1] AS original_name,
       CASE WHEN n_chars > 2000 THEN 'any.' || lang ELSE 'any.md' END AS translation_name
FROM v_files JOIN documents USING (doc_id)
"""


def incoming(spark, folder) -> DataFrame:
    both = files(spark, folder).join(
        A.table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id"
    )
    parts = F.split("relative_path", "/")
    return both.select(
        "project_id", F.col("doc_id").alias("seq"),
        F.when(F.col("side") == "original", F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 2), "/"))
        .otherwise(F.col("source")).alias("folder"),
        F.element_at(parts, -1).alias("original_name"),
        F.when(F.col("n_chars") > 2000, F.concat(F.lit("any."), "lang")).otherwise("any.md").alias("translation_name"),
    )


@check(
    "import_batch",
    """SELECT project_id, seq, original_path, translation_path,
              CASE WHEN first IS NOT NULL THEN first
                   WHEN seq > min(CASE WHEN first IS NULL THEN seq END) OVER (PARTITION BY project_id, original_path)
                     OR seq > min(CASE WHEN first IS NULL THEN seq END) OVER (PARTITION BY project_id, translation_path)
                   THEN 'name exists' END AS rejected
       FROM (SELECT i.*, CASE WHEN regexp_extract(original_name, '\\.([^.]*)$', 1) <> 'pdf'
                             OR regexp_extract(translation_name, '\\.([^.]*)$', 1) NOT IN ('pdf', 'md', 'markdown', 'txt') THEN 'unsupported file'
                           WHEN o.relative_path IS NOT NULL OR t.relative_path IS NOT NULL THEN 'name exists' END AS first
             FROM (SELECT *, 'C_orig/' || folder || '/' || original_name AS original_path,
                     'C_trad/' || folder || '/' || regexp_replace(original_name, '\\.[^.]*$', '') || '.' ||
                       regexp_extract(translation_name, '\\.([^.]*)$', 1) AS translation_path FROM v_incoming) i
             LEFT JOIN v_files o ON o.project_id = i.project_id AND o.side = 'original' AND o.relative_path = i.original_path
             LEFT JOIN v_files t ON t.project_id = i.project_id AND t.side = 'translation' AND t.relative_path = i.translation_path)""",
)
def _(spark, folder):
    return C.import_batch(plain_files(spark, folder), incoming(spark, folder), projects(spark, folder)).select(
        "project_id", "seq", "original_path", "translation_path", "rejected"
    )


# Labelled documents of good quality have artifacts; every document has an output in German.
@check(
    "publishable",
    """SELECT project_id, document_id, output_path,
              CASE WHEN original_path IS NULL AND translation_path IS NULL THEN 'unknown document'
                   WHEN original_path IS NULL THEN 'no original'
                   WHEN translation_path IS NOT NULL AND NOT own THEN 'imported translation'
                   WHEN there AND NOT own THEN 'file exists' END AS rejected
       FROM (SELECT x.project_id, x.document_id, x.output_path, x.original_path, x.translation_path,
                    coalesce(l.quality = 1 AND x.translation_path = x.output_path, false) AS own, f.relative_path IS NOT NULL AS there
             FROM (SELECT 'p' || (d.doc_id // 200) AS project_id, 'doc' || d.doc_id AS document_id, d.doc_id, c.original_path, c.translation_path,
                     'C_trad/' || regexp_replace(regexp_replace(c.original_path, '^C_orig/', ''), '\\.[^./]*$', '') || '.de.md' AS output_path
                   FROM documents d LEFT JOIN v_catalog c ON c.document_id = 'doc' || d.doc_id) x
             LEFT JOIN labels l USING (doc_id)
             LEFT JOIN v_files f ON f.project_id = x.project_id AND f.side = 'translation' AND f.relative_path = x.output_path)""",
)
def _(spark, folder):
    def document_of(df):
        return df.select(
            F.concat(F.lit("p"), F.floor(F.col("doc_id") / 200).cast("string")).alias("project_id"),
            F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("document_id"),
        )

    outputs = document_of(A.table(spark, folder, "documents")).withColumn("target_language", F.lit("de"))
    artifacts = document_of(A.table(spark, folder, "labels").where("quality = 1"))
    return C.publishable(
        outputs, catalog(spark, folder), projects(spark, folder), artifacts, plain_files(spark, folder)
    ).drop("target_language")


@check(
    "validate_runs",
    """SELECT document_id, array_to_string(list_filter([
         CASE WHEN NOT regexp_full_match(document_id, '[A-Za-z0-9-]+') THEN 'document_id' END,
         CASE WHEN trim(markdown) = '' THEN 'markdown' END,
         CASE WHEN segments = 0 THEN 'segments' END,
         CASE WHEN segments <> translations THEN 'translations' END,
         CASE WHEN math_object_count <> math_objects THEN 'math_objects' END,
         CASE WHEN target_language NOT IN ('es', 'en', 'pt', 'fr', 'de') THEN 'target_language' END,
         CASE WHEN review_level NOT IN ('none', 'normal', 'strict') THEN 'review_level' END], lambda v: v IS NOT NULL), '|') AS violations
       FROM (SELECT replace(o_orderpriority, ' ', '_') || o_orderkey AS document_id, 'text' AS source_text,
               CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE 'x' END AS markdown,
               o_orderkey % 5 AS segments, o_custkey % 5 AS translations, 1 AS math_objects, o_orderkey % 2 AS math_object_count,
               lower(left(o_orderpriority, 1)) || 's' AS target_language, 'normal' AS review_level FROM orders)""",
)
def _(spark, folder):
    runs = A.table(spark, folder, "orders").select(
        F.concat(F.translate("o_orderpriority", " ", "_"), F.col("o_orderkey").cast("string")).alias("document_id"),
        F.lit("text").alias("source_text"),
        F.when(F.col("o_orderstatus") == "P", " ").otherwise("x").alias("markdown"),
        (F.col("o_orderkey") % 5).alias("segments"), (F.col("o_custkey") % 5).alias("translations"),
        F.lit(1).alias("math_objects"), (F.col("o_orderkey") % 2).alias("math_object_count"),
        F.concat(F.lower(F.left("o_orderpriority", F.lit(1))), F.lit("s")).alias("target_language"),
        F.lit("normal").alias("review_level"),
    )
    return C.validate_runs(runs).select("document_id", F.array_join("violations", "|").alias("violations"))


@check(
    "safe_path",
    """SELECT page_id, path, trim(path) <> '' AND NOT starts_with(trim(path), '/') AND NOT list_bool_or(list_transform(
         list_prepend('a', list_filter(string_split(trim(path), '/'), lambda c: c <> '')),
         lambda c: c IN ('.', '..') OR regexp_matches(c, '[<>:"|?*\\p{Cc}]|[ .]$'))) AS safe
       FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages
             UNION ALL SELECT page_id, url FROM pages
             UNION ALL SELECT page_id, regexp_replace(regexp_replace(url, '^https?:/', ''), '[?#].*$', '') FROM pages
             UNION ALL SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', 'x/../'), '[?#].*$', '') FROM pages
             UNION ALL SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || ' ' FROM pages)""",
)
def _(spark, folder):
    pages = A.texts(spark, folder, "pages").select("page_id", "url")
    bare = lambda start: F.regexp_replace(F.regexp_replace("url", "^https?://", start), r"[?#].*\z", "")
    forms = F.array(
        F.regexp_replace("url", "^https?://", ""), F.col("url"), bare("/"), bare("x/../"),
        F.concat(bare(""), F.lit(" ")),
    )
    return pages.select("page_id", F.explode(forms).alias("path")).withColumn("safe", PF.safe_path(F.col("path")))


def opened(spark, folder) -> DataFrame:
    return A.table(spark, folder, "events").select(
        F.col("user_id").alias("reader_id"),
        F.concat(F.lit("p"), F.floor("value").cast("string")).alias("project_id"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("name"),
        F.concat(F.when(F.col("value") > 40, "/Home/").otherwise("/home/"), F.floor("value").cast("string"), F.lit("/"), "event_type").alias("root"),
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("#"), F.col("event_id").cast("string")).alias("opened_at"),
    )


VIEWS["v_opened"] = """
SELECT user_id AS reader_id, 'p' || CAST(floor(value) AS BIGINT) AS project_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS name,
       CASE WHEN value > 40 THEN '/Home/' ELSE '/home/' END || CAST(floor(value) AS BIGINT) || '/' || event_type AS root,
       strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '#' || event_id AS opened_at FROM events
"""


@check(
    "recent_projects",
    """SELECT reader_id, project_id, opened_at, name, root, place FROM (
         SELECT *, row_number() OVER (PARTITION BY reader_id ORDER BY opened_at DESC, project_id) AS place FROM (
           SELECT *, row_number() OVER (PARTITION BY reader_id, project_id ORDER BY opened_at DESC) AS n FROM v_opened WHERE name <> '')
         WHERE n = 1) WHERE place <= 8""",
)
def _(spark, folder):
    return C.recent_projects(opened(spark, folder))


@check(
    "recent_locations",
    """SELECT reader_id, location, opened_at, place FROM (
         SELECT *, row_number() OVER (PARTITION BY reader_id ORDER BY opened_at DESC, lower(location)) AS place FROM (
           SELECT *, row_number() OVER (PARTITION BY reader_id, lower(location) ORDER BY opened_at DESC) AS n
           FROM (SELECT *, regexp_replace(root, '/[^/]*$', '') AS location FROM v_opened)) WHERE n = 1) WHERE place <= 24""",
)
def _(spark, folder):
    return C.recent_locations(opened(spark, folder))


@check(
    "distinct_locations",
    """SELECT reader_id, root, event_id FROM (SELECT *, row_number() OVER (PARTITION BY reader_id, lower(root) ORDER BY event_id) AS n
         FROM (SELECT reader_id, root, CAST(string_split(opened_at, '#')[2] AS BIGINT) AS event_id FROM v_opened)) WHERE n = 1""",
)
def _(spark, folder):
    rows = opened(spark, folder).withColumn("event_id", F.element_at(F.split("opened_at", "#"), 2).cast("long"))
    return C.distinct_first(rows, ["reader_id"], "root", "event_id")


@check(
    "not_recent",
    """SELECT project_id FROM (SELECT DISTINCT 'p' || (o_orderkey % 500) AS project_id FROM orders)
       WHERE project_id NOT IN (SELECT project_id FROM (
         SELECT *, row_number() OVER (PARTITION BY reader_id ORDER BY opened_at DESC, project_id) AS place FROM (
           SELECT *, row_number() OVER (PARTITION BY reader_id, project_id ORDER BY opened_at DESC) AS n FROM v_opened WHERE name <> '')
         WHERE n = 1) WHERE place <= 8)""",
)
def _(spark, folder):
    found = A.table(spark, folder, "orders").select(
        F.concat(F.lit("p"), (F.col("o_orderkey") % 500).cast("string")).alias("project_id")).distinct()
    return C.not_recent(found, C.recent_projects(opened(spark, folder)))


# -------------------------------------------------------------------- library
FOLD = ("áàâäãåāéèêëēíìîïīóòôöõōúùûüūçýÿ", "aaaaaaaeeeeeiiiiioooooouuuuucyy")


def sort_name(x):
    base = f"replace(translate(lower({x}), '{FOLD[0]}', '{FOLD[1]}'), 'ñ', 'n~')"
    bare = "regexp_replace(r, '^0+([0-9])', '\\1')"
    return (
        f"array_to_string(list_transform(regexp_extract_all({base}, '[0-9]+|[^0-9]+'), lambda r: "
        f"CASE WHEN regexp_matches(r, '^[0-9]') THEN lpad(CAST(length({bare}) AS VARCHAR), 6, '0') || '.' || {bare} ELSE r END), '')"
    )


VIEWS["v_placed"] = """
SELECT *, CASE WHEN len(p) > 2 THEN array_to_string(p[2:-2], '/') ELSE '' END AS folder,
       greatest(coalesce(original_time, 0), coalesce(translation_time, 0)) AS modified_at
FROM (SELECT *, string_split(coalesce(original_path, translation_path), '/') AS p FROM v_summaries)
"""
VIEWS["v_tree_folders"] = """
SELECT DISTINCT project_id, array_to_string(p[1:n], '/') AS path FROM (
  SELECT project_id, p, unnest(range(1, len(p) + 1)) AS n FROM (
    SELECT project_id, string_split(folder, '/') AS p FROM v_placed WHERE folder <> ''
    UNION ALL SELECT 'p' || (doc_id // 200), ['Vacía', source] FROM documents))
"""


def tree_sql(sort):
    down = sort == "name-desc"
    fk, dk = (1, 0) if down else (0, 1)
    amount = {"modified-desc": "-modified_at", "modified-asc": "modified_at"}.get(sort, "0")
    close = "|2:0:" if down else ""
    steps = (
        "array_to_string(list_transform(list_filter(string_split(FOLDER, '/'), lambda c: c <> ''), "
        f"lambda c: '{fk}:0:' || {sort_name('c')}), '|')"
    )
    folder_key = steps.replace("FOLDER", "path")
    doc_key = f"concat_ws('|', nullif({steps.replace('FOLDER', 'folder')}, ''), '{dk}:' || ({amount}) || ':' || {sort_name('title')})"
    return f"""SELECT project_id, 'folder' AS kind, 'folder:' || path AS key, string_split(path, '/')[-1] AS name, path,
        array_to_string(string_split(path, '/')[:-2], '/') AS parent_path, {folder_key} || '{close}' AS sort_key,
        CAST(len(string_split(path, '/')) - 1 AS INT) AS depth FROM v_tree_folders
      UNION ALL
      SELECT project_id, 'document', 'document:' || document_id, title, NULL, folder, {doc_key} || '{close}',
        CAST(CASE WHEN folder = '' THEN 0 ELSE len(string_split(folder, '/')) END AS INT) FROM v_placed"""


def tree(spark, folder, sort) -> DataFrame:
    explicit = A.table(spark, folder, "documents").select(
        F.concat(F.lit("p"), F.floor(F.col("doc_id") / 200).cast("string")).alias("project_id"),
        F.concat(F.lit("Vacía/"), "source").alias("relative_path"),
    ).distinct()
    return L.library_tree(summaries(spark, folder), explicit, sort)


def _tree(sort):
    def run(spark, folder):
        step = lambda s: F.concat_ws(":", s["kind"].cast("string"), s["amount"].cast("string"), s["name"])
        return tree(spark, folder, sort).orderBy(*L.tree_order(sort)).withColumn(
            "sort_key", F.array_join(F.transform("sort_key", step), "|")
        )

    return run


for _sort in L.SORTS:
    check("library_tree_" + _sort.replace("-", "_"), tree_sql(_sort))(_tree(_sort))


# Folders whose name holds no 1 are open.
@check(
    "visible_nodes",
    f"""SELECT project_id, key FROM (
          SELECT t.project_id, t.key, t.parent_path, string_split(t.parent_path, '/') AS p FROM ({tree_sql('name-asc')}) t)
        WHERE parent_path = '' OR NOT list_bool_or(list_transform(p, lambda c: contains(c, '1')))""",
)
def _(spark, folder):
    nodes = cut(tree(spark, folder, "name-asc"))
    opened_folders = nodes.where("kind = 'folder' AND NOT contains(name, '1')").select("project_id", "path")
    return L.visible_nodes(nodes, opened_folders).select("project_id", "key")


@check(
    "document_folder",
    """SELECT project_id, document_id, folder, modified_at, array_to_string(list_transform(
         CASE WHEN folder = '' THEN [] ELSE range(1, len(string_split(folder, '/')) + 1) END,
         lambda n: array_to_string(string_split(folder, '/')[1:n], '/')), '|') AS ancestors FROM v_placed""",
)
def _(spark, folder):
    return L.with_folder(summaries(spark, folder)).select(
        "project_id", "document_id", "folder", "modified_at",
        F.array_join(PF.ancestors(F.col("folder")), "|").alias("ancestors"),
    )


@check(
    "folder_rollup",
    """SELECT project_id, path, count(*) AS documents, max(modified_at) AS modified_at FROM (
         SELECT project_id, modified_at, array_to_string(string_split(folder, '/')[1:n], '/') AS path FROM (
           SELECT *, unnest(range(1, len(string_split(folder, '/')) + 1)) AS n FROM v_placed WHERE folder <> ''))
       GROUP BY project_id, path""",
)
def _(spark, folder):
    return L.folder_rollup(summaries(spark, folder))
