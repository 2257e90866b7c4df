"""Sections, tables of contents and tables: runs of rows in document order, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _order():
    return W.partitionBy("doc_id").orderBy("pos")


def _top(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent IS NULL")


def sections(nodes: DataFrame, nested: bool = False, level: int | None = None) -> DataFrame:
    """(doc_id, section, pos, end_pos, depth, title, n_nodes): a row for each heading, or each of one level.

    A section reaches to the next heading, or with ``nested`` to the next that is not deeper. end_pos is null for the last. What
    stands before the first heading is in no section.
    """
    top = _top(nodes)
    starts = F.col("kind") == "heading" if level is None else (F.col("kind") == "heading") & (F.col("depth") == level)
    ahead = _order().rowsBetween(1, W.unboundedFollowing)
    if nested:
        end = F.lit(None).cast("int")
        for d in range(1, 7):
            end = F.when(F.col("depth") == d, F.min(F.when(starts & (F.col("depth") <= d), F.col("pos"))).over(ahead)).otherwise(end)
    else:
        end = F.min(F.when(starts, F.col("pos"))).over(ahead)
    last = F.max("top").over(W.partitionBy("doc_id"))
    end_top = F.coalesce(F.min(F.when(F.lit(not nested) & starts, F.col("top"))).over(ahead), last + 1)
    if nested:
        end_top = F.lit(None).cast("int")
        for d in range(1, 7):
            end_top = F.when(F.col("depth") == d, F.coalesce(F.min(F.when(starts & (F.col("depth") <= d), F.col("top"))).over(ahead), last + 1)).otherwise(end_top)
    out = top.withColumns({"end_pos": end, "end_top": end_top, "starts": starts}).where("starts")
    number = F.row_number().over(_order()) - 1
    return out.select("doc_id", number.alias("section"), "pos", "end_pos", "depth", F.col("text").alias("title"), (F.col("end_top") - F.col("top") - 1).alias("n_nodes"))


def section_nodes(nodes: DataFrame) -> DataFrame:
    """Top nodes with the number of the section that they stand in: 0 before the first heading."""
    return _top(nodes).withColumn("section", F.sum(F.when(F.col("kind") == "heading", 1).otherwise(0)).over(_order()))


def contents(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, line): a table of contents, an indented item for each heading."""
    heads = _top(nodes).where("kind = 'heading'")
    return heads.select("doc_id", "pos", F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.lit("- "), F.col("text")).alias("line"))


def tables(nodes: DataFrame) -> DataFrame:
    """Table cells with the number of their table in the document: a table begins at a first row's first cell."""
    first = (F.col("kind") == "table_cell") & (F.col("row") == 0) & (F.col("col") == 0)
    top = _top(nodes).withColumn("table", F.sum(F.when(first, 1).otherwise(0)).over(_order()) - 1)
    return top.where("kind = 'table_cell'")


def _headed(nodes: DataFrame) -> DataFrame:
    """Cells with the head of their column: one pass over the nodes, without a join."""
    column = W.partitionBy("doc_id", "table", "col")
    return tables(nodes).withColumn("head", F.max(F.when(F.col("row") == 0, F.col("text"))).over(column)).where("row > 0")


def table_records(nodes: DataFrame) -> DataFrame:
    """(doc_id, table, row, record): each body row as a map from the heads to its cells."""
    pairs = F.array_sort(F.collect_list(F.struct("col", "head", "text")))
    rows = _headed(nodes).groupBy("doc_id", "table", "row")
    return rows.agg(F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["head"], x["text"]))).alias("record"))


def table_column(nodes: DataFrame, head: str) -> DataFrame:
    """(doc_id, table, row, value) of the columns with this head."""
    return _headed(nodes).where(F.col("head") == head).select("doc_id", "table", "row", F.col("text").alias("value"))


def sort_rows(nodes: DataFrame, column: int | None = None) -> DataFrame:
    """(doc_id, table, row, place, cells): each table's body rows by the text of a column, or of all; ties as they stand."""
    cells = tables(nodes).where("row > 0")
    ordered = F.array_sort(F.collect_list(F.struct("col", "text")))
    rows = cells.groupBy("doc_id", "table", "row").agg(F.transform(ordered, lambda x: x["text"]).alias("cells"))
    by = F.col("cells") if column is None else F.col("cells")[column]
    return rows.withColumn("place", F.row_number().over(W.partitionBy("doc_id", "table").orderBy(by, "row")))


def callouts(nodes: DataFrame, *names: str) -> DataFrame:
    found = _top(nodes).where("kind = 'callout'")
    return found.where(F.col("callout").isin([n.upper() for n in names])) if names else found


def shift_depth(nodes: DataFrame, by: int) -> DataFrame:
    """Headings deeper or less deep, from 1 to 6."""
    moved: Column = F.greatest(F.lit(1), F.least(F.lit(6), F.col("depth") + by))
    return nodes.withColumn("depth", F.when(F.col("kind") == "heading", moved).otherwise(F.col("depth"))).withColumn("name", F.when(F.col("kind") == "heading", F.concat(F.lit("h"), "depth")).otherwise(F.col("name")))
