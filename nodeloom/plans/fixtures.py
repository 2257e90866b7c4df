"""Markdown made of relational rows, so that what the operators find in it is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(rows: DataFrame, key: str, order: str, text) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return rows.groupBy(F.col(key).alias("doc_id")).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("text"))


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a region: its name, then each nation with a line of text, a link, a task and code."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    body = F.format_string(
        "## Nation %d\n\nText of **nation %d** and `code %d`.\n\n- [%s] visit %d\n  - inner %d\n\n[link %d](http://n.example/%d \"T\")\n\n```l%d\nvalue %d\n```",
        *[F.col("n_nationkey")] * 3, F.when(F.col("n_nationkey") % 2 == 0, "x").otherwise(" "), *[F.col("n_nationkey")] * 4, F.col("n_nationkey") % 3, F.col("n_nationkey"),
    )
    docs = _joined(nation, "n_regionkey", "n_nationkey", body)
    return docs.join(region, docs.doc_id == region.r_regionkey).select("doc_id", F.concat(F.lit("# "), "r_name", F.lit("\n\n"), "text").alias("text"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a customer with orders: its name, and an item for each order, done if its status is F."""
    o = table(spark, sf_dir, "orders")
    item = F.concat(F.lit("- ["), F.when(F.col("o_orderstatus") == "F", "x").otherwise(" "), F.lit("] order "), F.col("o_orderkey").cast("string"))
    parts = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("o"), item.alias("t"))))
    return o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat(F.lit("# Customer\n\n"), F.array_join(F.transform(parts, lambda x: x["t"]), "\n")).alias("text"))


def parts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a brand: a table of its parts."""
    p = table(spark, sf_dir, "part")
    line = F.format_string("| %d | %s | %d |", "p_partkey", "p_name", "p_size")
    rows = F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("o"), line.alias("t"))))
    return p.groupBy(F.col("p_brand").alias("doc_id")).agg(F.concat(F.lit("| Key | Name | Size |\n| ---: | --- | :-: |\n"), F.array_join(F.transform(rows, lambda x: x["t"]), "\n")).alias("text"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a nation: a callout if its key is even, else a quote, with code in it, and code behind it."""
    n = table(spark, sf_dir, "nation")
    head = F.when(F.col("n_nationkey") % 2 == 0, F.format_string("> [!NOTE] Title %d\n> body", "n_nationkey")).otherwise(F.lit("> body"))
    code = F.format_string(">\n> ```in\n> inner %d\n> ```\n\n```out\nouter %d\n```", "n_nationkey", "n_nationkey")
    return n.select(F.col("n_nationkey").alias("doc_id"), F.concat(head, F.lit("\n"), code).alias("text"))
