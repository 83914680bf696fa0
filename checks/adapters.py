"""The given tables seen as the operators' input tables.

Every adapter reads its whole table.  ``checks.sql`` defines the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext import constants as K
from bitext.plans.rows import with_parallelism


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str, tasks_per_core: int = 1) -> DataFrame:
    """A table whose rows are expensive, in at least as many splits as there are cores."""
    return with_parallelism(table(spark, folder, name), tasks_per_core=tasks_per_core)


def text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def money(column: str) -> Column:
    value = cents(column)
    return text(
        F.floor(value / 100).cast("string"), ".", F.lpad((value % 100).cast("string"), 2, "0")
    )


def doc_pages(spark, folder) -> DataFrame:
    """Documents as pages of five lines; German and Spanish ones count as recognised."""
    lines = F.split("text", "\n")
    count = F.ceil(F.size(lines) / 5).cast("int")
    pages = F.transform(
        F.sequence(F.lit(1), count),
        lambda p: F.array_join(F.slice(lines, (p - 1) * 5 + 1, F.lit(5)), "\n\n"),
    )
    return texts(spark, folder, "documents").select(
        "doc_id",
        F.posexplode(pages).alias("_i", "text"),
        F.when(F.col("lang").isin("de", "es"), "ocr").otherwise("native").alias("method"),
        (F.col("n_chars") % 4).cast("int").alias("image_count"),
        (F.col("n_chars") % 40).cast("int").alias("vector_path_count"),
    ).select(
        "doc_id", (F.col("_i") + 1).alias("page"), "method", "text", "image_count", "vector_path_count"
    )


def order_pages(spark, folder) -> DataFrame:
    """Orders as report pages of a customer: headings, captions, equations, notes."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    year = F.year("o_orderdate")
    middle = (
        F.when(F.col("o_orderpriority") == "1-URGENT",
               text("\n\nFigure ", k, ". Price trend of the order\nwith a second caption line\n"))
        .when(F.col("o_orderpriority") == "2-HIGH", text("\n\nTable ", k, ": Items of the order\n"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", text("\n\nΓr(Y) = ∑ Y_i + ", k, "\n"))
        .when(F.col("o_orderpriority") == "5-LOW",
              text("\n\nWrite to clerk", c, "@shop.example for https://shop.example/o/", k, "\n"))
        .otherwise("")
    )
    foot = (
        F.when(F.col("o_orderstatus") == "F",
               text("\n\n" + K.FOOTNOTE_BOUNDARY + "\n\n1. Smith: Cited work, ", year.cast("string"),
                    ". 2. Jones: Another work, ", (year - 1).cast("string"), "."))
        .when(F.col("o_orderstatus") == "O",
              text("\n\n3. Author: Article title, Journal 12, ", year.cast("string"), "."))
        .otherwise("")
    )
    return texts(spark, folder, "orders", tasks_per_core=4).select(
        (-F.col("o_custkey")).alias("doc_id"),
        F.col("o_orderkey").cast("int").alias("page"),
        F.lit("native").alias("method"),
        text(
            "Order report ", k, "\n\nThe customer ", c, " placed an order for ", money("o_totalprice"),
            " in ", year.cast("string"), " and the clerk com-\npleted the record for the archive.\n",
            "A second line follows.", middle, "\nClosing prose of the page.", foot,
        ).alias("text"),
        (cents("o_totalprice") % 4).cast("int").alias("image_count"),
        (cents("o_totalprice") % 40).cast("int").alias("vector_path_count"),
    )


def corpus_pages(spark, folder) -> DataFrame:
    return doc_pages(spark, folder).unionByName(order_pages(spark, folder))


def order_notes(spark, folder) -> DataFrame:
    """Orders as segments of a customer's document, full of values to protect."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    year = F.year("o_orderdate")
    marks = (
        F.when(F.col("o_orderstatus") == "F", text("; p < 0.05 with β and X_{", c, "} ≤ 7 %"))
        .when(F.col("o_orderstatus") == "O", text("; see https://shop.example/o/", k, ") or doi:10.1234/", k))
        .otherwise(text("; $y_", c, " = ", k, "$ by mail to clerk.", c, "@shop.example, [[NUMBER_00001]] stays"))
    )
    body = F.when(
        F.col("o_orderpriority") == "3-MEDIUM", text("Γr(Y) = ∑ Y_i. (", k, ")")
    ).otherwise(
        text("Order ", k, " of customer no", c, " costs ", money("o_totalprice"), " since ",
             year.cast("string"), marks, ".")
    )
    return texts(spark, folder, "orders", tasks_per_core=4).select(
        F.col("o_custkey").alias("doc_id"),
        F.format_string(K.SEGMENT_ID, "o_orderkey").alias("segment_id"),
        F.col("o_orderkey").cast("int").alias("ordinal"),
        year.alias("page"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "equation-marker").otherwise("paragraph").alias("block_type"),
        body.alias("text"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )
