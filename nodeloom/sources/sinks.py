"""Where results go: documents of text in a format, or tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.functions import formats


def documents(nodes: DataFrame, kind: str = "markdown") -> DataFrame:
    """(doc_id, value): each document's top nodes as one text, in order. A document is one group, as large as its text."""
    column = {"markdown": "markdown", "text": "text"}[kind]
    parts = F.array_sort(F.collect_list(F.struct("pos", F.col(column).alias("x"))))
    return nodes.where("parent is null").groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["x"]), "\n").alias("value"))


def write(rows: DataFrame, path: str, kind: str) -> None:
    """Write rows as csv, tsv, psv, json or parquet, or their column ``value`` as text; none runs the query only."""
    if kind in ("csv", "tsv", "psv"):
        rows.write.csv(path, sep={"csv": ",", "tsv": "\t", "psv": "|"}[kind], header=True, quote='"', escape='"')
    elif kind in ("json", "parquet"):
        getattr(rows.write, kind)(path)
    elif kind == "html":
        rows.select(rendered("html")).write.text(path)
    elif kind in ("text", "raw", "markdown"):
        rows.select("value").write.text(path)
    elif kind in ("yaml", "toml", "toon", "xml", "gron", "shell"):
        rows.select(formats.from_json(kind)(F.col("value")).alias("value")).write.text(path)
    elif kind == "none":
        rows.write.format("noop").mode("overwrite").save()
    else:
        raise ValueError(f"no sink of kind {kind}")


def rendered(kind: str, json_col: str = "json", markdown_col: str = "value") -> Column:
    """A value in a format: html from Markdown, table and the data formats from JSON."""
    if kind == "html":
        return F.pandas_udf(_html, "string")(F.col(markdown_col)).alias("value")
    if kind == "table":
        return F.pandas_udf(_table, "string")(F.col(json_col)).alias("value")
    return formats.from_json(kind)(F.col(json_col)).alias("value")


def _html(texts: pd.Series) -> pd.Series:
    from nodeloom.language.builtins import _to_html
    from nodeloom.sources import markdown_parser as M

    return texts.map(lambda t: None if t is None else "".join(map(_to_html, M.parse(t))))


def _table(values: pd.Series) -> pd.Series:
    import json

    from nodeloom.language.library import _markdown_table

    def one(text: str | None) -> str | None:
        v = json.loads(text) if text is not None else None
        return _markdown_table(v if isinstance(v, (list, dict)) else [v])

    return values.map(one)


def separated(documents: DataFrame, separator: str) -> DataFrame:
    """Documents' values with a separator's row between them, by id."""
    numbered = documents.select("doc_id", F.lit(0).alias("part"), "value")
    first = documents.agg(F.min("doc_id").alias("first"))
    marks = documents.join(F.broadcast(first), ~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", F.lit(-1).alias("part"), F.lit(separator).alias("value"))
    return numbered.unionByName(marks).orderBy("doc_id", "part")
