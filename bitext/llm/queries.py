"""The operators over whole tables: name to query, and the same in DuckDB's SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext.llm import (
    chat, common, ctw, forest, jaccard, licences, merkle, mixing, packing, parsing, periods, shards, token_files, windows,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents labelled good weigh 1, without label 0.5, labelled bad 0.25."""
    docs = common.staged(
        table(spark, folder, "documents").select("doc_id", "source", common.n_words(F.col("text")).alias("size")), "sizes"
    )
    mixed = mixing.mix(with_quality(docs, table(spark, folder, "labels")), F.col("size"), F.col("quality_weight"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "quality_weight")


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with quality_weight, from the labels of their identifiers; of several labels the worst."""
    best = labels.groupBy(F.col("doc_id").alias("_label")).agg(F.min("quality").alias("_quality"))
    weight = F.when(F.col("_quality") > 0, 1.0).when(F.col("_quality") == 0, 0.25).otherwise(0.5)
    return (
        docs.drop("quality_weight").join(best, F.col("doc_id") == F.col("_label"), "left")
        .withColumn("quality_weight", weight).drop("_label", "_quality")
    )


@query
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged = forest.judge(docs, forest.fit_forest(docs, table(spark, folder, "labels")))
    return judged.drop("text")


@query
def op5_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.link_similar(table(spark, folder, "documents"))


SQL["op5_jaccard"] = r"""
WITH RECURSIVE lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' '))) AS s
  FROM lists WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(g.n_links, 0) AS BIGINT) AS n_links, l.component_id
FROM documents d JOIN least l ON l.x = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN degree g ON g.x = d.doc_id
"""

TOKENIZER = "byte_bpe_50k.json"


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query
def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = common.new_folder(spark, "token-files")
    token_files.write_tokens(table(spark, folder, "documents"), path, tokenizer())
    return token_files.read_tokens(spark, path, digest=True)


@query
def op3_shards(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("same_text"),
    )
    found = shards.shard_groups(docs, F.col("same_text"), F.col("size"), shards=24)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, folder, "documents"), tokenizer(), capacity=2048, with_ids=False)
    return packing.pack(common.staged(pieces, "pieces"), capacity=2048)


@query
def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.edited_pairs(table(spark, folder, "documents"))


@query
def op4_scores(spark: SparkSession, folder: str) -> DataFrame:
    return ctw.score_texts(table(spark, folder, "documents"))


@query
def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chats(table(spark, folder, "conversations"))


SQL["op2_chat"] = r"""
WITH numbered AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
         coalesce('r' || length(role) || role, 'n') || coalesce('t' || length(text) || text, 'n') AS said FROM conversations),
prefixes AS (
  SELECT conv_id, pos + 1 AS n, string_agg(said, '|') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix,
         count(*) OVER (PARTITION BY conv_id) AS n_turns FROM numbered),
whole AS (SELECT min(conv_id) AS conv_id, n_turns, prefix, count(*) AS snapshots FROM prefixes WHERE n = n_turns GROUP BY n_turns, prefix),
kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.n < p.n_turns AND p.n = w.n_turns AND p.prefix = w.prefix))
SELECT k.conv_id, CAST(n.pos // 1024 AS INTEGER) AS piece, CAST(k.n_turns AS BIGINT) AS n_turns, k.snapshots,
       string_agg('<|im_start|>' || coalesce(n.role, '') || chr(10) || coalesce(n.text, '') || '<|im_end|>' || chr(10), '' ORDER BY n.pos) AS text
FROM kept k JOIN numbered n ON n.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY k.conv_id, n.pos // 1024, k.n_turns, k.snapshots
"""


@query
def op8_licences(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.scan(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    return found.withColumns({c: F.array_join(c, ",") for c in ("licence_sentences", "licences")})


def _licence_sql() -> str:
    """The scan in SQL, over the same fixed sentences and rules."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table_ = ", ".join(f"({quote(s)}, {quote(n)})" for s, n in licences.known_sentences().items())
    steps, left = [], "said"
    for k, (_, sequence) in enumerate(licences.RULES):
        pattern = quote("".join(f"<{s}>" for s in sequence))
        steps.append(f"r{k} AS (SELECT *, contains(left{k}, {pattern}) AS hit{k}, replace(left{k}, {pattern}, '') AS left{k + 1} FROM {left})")
        left = f"r{k}"
    names = ", ".join(f"CASE WHEN hit{k} THEN {quote(name)} END" for k, (name, _) in enumerate(licences.RULES))
    # RE2 looks at nothing without taking it: line ends are doubled instead, and what was looked at is put back.
    start = licences.LINE_START.replace("(?=[a-z])", "([a-z])")
    pattern = licences.sentence_pattern("(?: |\n\n)")
    text = "chr(10) || lower(coalesce(text, '')) || chr(10)"
    for old, new in (
        (licences.TAG_HEAD, r"\1 "), (licences.SEE_TAIL, " "), (start, "\n\\1"), (r"([.!?;:])(?:[ \t]+|\r?\n)", "\\1\n\n"),
        (r"[^a-z0-9.\n]+", " "), (r"\.+([ \n])", r"\1"), (r" *\n *", "\n"), (r"\n", "\n\n"),
    ):
        text = f"regexp_replace({text}, {quote(old)}, {quote(new)}, 'g')"
    return rf"""
WITH known(sentence, name) AS (VALUES {table_}),
cut AS (SELECT doc_id, unnest(found) AS raw, unnest(range(1, len(found) + 1)) AS place
        FROM (SELECT doc_id, regexp_extract_all({text}, {quote(chr(10) + "(" + pattern + ")" + chr(10))}, 1) AS found FROM documents)),
clean AS (SELECT doc_id, place, replace(raw, chr(10) || chr(10), ' ') AS sentence FROM cut),
told AS (SELECT c.doc_id, string_agg(k.name, ',' ORDER BY c.place) AS names, string_agg('<' || k.name || '>', '' ORDER BY c.place) AS tags
         FROM clean c JOIN known k ON k.sentence = c.sentence GROUP BY c.doc_id),
said AS (SELECT d.doc_id, coalesce(t.names, '') AS names, coalesce(t.tags, '') AS left0 FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id),
{", ".join(steps)},
listed AS (SELECT *, list_filter([{names}], lambda x: x IS NOT NULL) AS hits FROM {left})
SELECT doc_id, names AS licence_sentences,
       coalesce(array_to_string(list_filter(hits, lambda x, i: NOT list_contains(hits[1:i-1], x)), ','), '') AS licences,
       hits[1] AS licence, CAST(length(regexp_replace(left{len(licences.RULES)}, '[^<]', '', 'g')) AS INTEGER) AS unmatched_sentences
FROM listed
"""


SQL["op8_licences"] = _licence_sql()


@query
def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences that hold the sources in the proportions of the whole corpus."""
    pieces = windows.pack_mixture(table(spark, folder, "documents"), tokenizer(), capacity=2048, end_id=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source",
    )


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: texts of documents with h % 10 = 0 repeat a stretch of their own words from some word on.

    h is the CRC-32 of the decimal identifier (without identifier nothing repeats).  Such a text comes out as words joined by blanks.
    """
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({common.WORD})"), F.lit(1)))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n") - 1),
        lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")),
    )
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query
def op12_periods(spark: SparkSession, folder: str) -> DataFrame:
    found = periods.find_runs(planted_periods(table(spark, folder, "documents")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    longest = F.col("longest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        longest["start"].alias("start"), longest["length"].alias("length"), longest["period"].alias("period"),
        F.floor(1000 * longest["length"] / longest["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def lowered_fifth(docs: DataFrame) -> F.Column:
    """The text, lower-cased where 5 divides the CRC-32 of the decimal identifier."""
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(fifth, F.translate("text", common.UPPER, common.LOWER)).otherwise(F.col("text"))


@query
def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return merkle.manifest(docs, changed={"text": lowered_fifth(docs)}).drop("proof", "source")


def _merkle_sql(levels: int = 6) -> str:
    """The manifest in SQL, for groups of up to 16 ** ``levels`` rows."""
    entry = lambda c, v: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({v} AS VARCHAR)) || ':' || {v} END"
    row = lambda text: " || ".join([*[entry(c, c) for c in ("doc_id", "source", "lang", "n_chars")], entry("text", text)])
    steps = []

    def tree(name: str, leaves: str) -> None:
        """Nodes ``name``0, … (g, pos, many, node) and steps ``name``_s0, … (g, pos, before, after) over rows (g, pos, many, node)."""
        steps.append(f"{name}0 AS ({leaves})")
        for k in range(levels):
            steps.append(f"{name}{k + 1} AS (SELECT g, pos // 16 AS pos, (many + 15) // 16 AS many, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM {name}{k} WHERE many > 1 GROUP BY ALL)")
            steps.append(
                f"{name}_s{k} AS (SELECT a.g, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, "
                f"coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after "
                f"FROM {name}{k} a JOIN {name}{k} b ON a.g IS NOT DISTINCT FROM b.g AND a.pos // 16 = b.pos // 16 WHERE a.many > 1 GROUP BY a.g, a.pos)"
            )
        steps.append(f"{name}_end AS (" + " UNION ALL ".join(f"SELECT g, node FROM {name}{k} WHERE many = 1" for k in range(levels + 1)) + ")")

    def fold(name: str, rows: str, g: str, pos: str) -> str:
        """``rows`` with proof and seen led up one tree."""
        for k in range(levels):
            steps.append(
                f"{name}_f{k} AS (SELECT r.* EXCLUDE (proof, seen), proof || coalesce(s.before || s.after, '') AS proof, "
                f"CASE WHEN s.before IS NULL THEN seen ELSE sha256(s.before || seen || s.after) END AS seen "
                f"FROM {rows} r LEFT JOIN {name}_s{k} s ON r.{g} IS NOT DISTINCT FROM s.g AND r.{pos} // {16 ** k} = s.pos)"
            )
            rows = f"{name}_f{k}"
        return rows

    steps.append(f"""hashed AS (
  SELECT *, CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS later
  FROM (SELECT *, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(CAST(doc_id AS VARCHAR)[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) AS crc FROM documents)),
rows_ AS (SELECT doc_id, source, sha256({row("text")}) AS leaf, sha256({row("later")}) AS seen FROM hashed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS many FROM rows_)""")
    tree("n", "SELECT source AS g, pos, many, leaf AS node FROM placed")
    steps.append("tops AS (SELECT g AS name, node, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS many FROM n_end)")
    tree("u", "SELECT 0 AS g, pos, many, node FROM tops")
    begun = "begun"
    steps.append("begun AS (SELECT p.*, t.node AS subroot, t.pos AS place, 0 AS zero, '' AS proof FROM placed p JOIN tops t ON p.source IS NOT DISTINCT FROM t.name)")
    rows = fold("u", fold("n", begun, "source", "pos"), "zero", "place")
    return "WITH " + ",\n".join(steps) + (
        f"\nSELECT doc_id, leaf, subroot, e.node AS root, sha256(proof) AS proof_sha256, seen AS folded_root, seen = e.node AS verified FROM {rows}, u_end e"
    )


SQL["op13_merkle"] = _merkle_sql()
