"""A corpus made ready for training: quality rules, near copies, source mix, packed sequences.

``STAGES`` are applied in turn; each result is written as Parquet and read back before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext.llm import common, forest, jaccard, mixing, packing, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and the isolation forest fitted to the labels.

    A null or empty text has no words and goes; a row is judged by its text alone, so repeated rows stay or go together, whatever
    their other columns are.  Without usable labels only the plain rules judge.  An empty table stays empty.
    """
    labels = queries.table(spark, sf_dir, "labels")
    judged = forest.judge(docs, forest.fit_forest(docs, labels))
    return judged.where("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones, that with the least identifier.

    Rows are known by a 64-bit hash of all their columns, so that different texts under one identifier, or
    under none, are different documents; of rows that are equal in every column one stays, and to be equal two such hashes
    have to agree. A document without identifier stands for a component only where all are without, then the one of least
    hash does. Documents without words link with nothing and stay.
    """
    keyed = docs.withColumn("_key", F.xxhash64(*docs.columns)).withColumn("_second", F.xxhash64(F.lit("second"), *docs.columns))
    linked = jaccard.link_similar(keyed, id="_key").select("_key", "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_key")).alias("first")
    kept = keyed.select("_key", "doc_id").join(linked, "_key").groupBy("component_id").agg(first).select("first._key")
    return keyed.dropDuplicates(["_key", "_second"]).join(kept, "_key", "left_semi").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: a row for each time, none for those it leaves out.

    Null sources are one source, the last; a null text has size 0 and comes along with whole epochs. Rows of one identifier
    draw one key, and tie by their hash; repeated rows are rows each. Documents without label weigh half. An empty table stays empty.
    """
    weighted = queries.with_quality(docs, queries.table(spark, sf_dir, "labels"))
    mixed = mixing.mix(weighted, common.n_words(F.col("text")), F.col("quality_weight"))
    repeated = mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, with these ids, in sequences of at most 2048.

    A row per piece: its document, place there, ids and their CRC-32, its sequence and place there; ``packing.sequences`` puts them
    together. A null or empty text is a document of the end id alone; repeated rows, and rows without identifier, are packed
    each. An empty table gives no piece.
    """
    pieces = packing.token_pieces(docs, queries.tokenizer(), capacity=2048)
    pieces = common.staged(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    # Lengths alone are ranked and placed; the ids meet their place by the number of their row.
    placed = packing.pack(pieces.drop("ids"), capacity=2048).select("_row", "sequence_id", "offset")
    return pieces.join(placed, "_row").drop("_row")


STAGES = [("quality", quality), ("near_copies", near_copies), ("mixture", mixture), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between two of them is written, read back, and deleted after the next."""
    docs = queries.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        path = common.new_folder(spark, name)
        with common.scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            common.delete(spark, before)
        before = path
    return docs


#: The forest and the packing are no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
