"""The ``nodes`` table: a row for each node of a document, at every depth, in document order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.sources import markdown_parser as M

#: Columns after ``doc_id``. pos counts from 0; parent is the pos of the node above, null at the top; lft and rgt enclose those of
#: all nodes below; top is the place among the nodes without parent. value is the node's own content (a link's is its url), text
#: that of all below it.
FIELDS = (
    "pos int, parent int, lft int, rgt int, top int, kind string, name string, depth int, level int, value string, text string, lang string, meta string, fence boolean, url string, alt string, "
    "title string, ident string, label string, callout string, ordered boolean, checked boolean, idx int, row int, col int, align array<string>, markdown string"
)
_KINDS = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_COLUMNS = [(f.split()[0], _KINDS[f.split()[1]]) for f in FIELDS.split(", ")]
#: So many rows leave the parser at once.
ROWS = 8192
_COPIED = ("depth", "level", "lang", "meta", "fence", "url", "alt", "title", "ident", "label", "callout", "ordered", "checked", "idx", "row", "col", "align")


def rows_of(nodes: Iterable[M.Node], markdown: bool = True, kinds: frozenset[str] | None = None) -> Iterator[dict[str, Any]]:
    """The rows of a document's nodes, those of ``kinds`` if given; what is in one top-level node is held at once."""
    rows: list[dict[str, Any]] = []
    pos = tick = 0

    def visit(node: M.Node, parent: int | None, top: int) -> None:
        nonlocal pos, tick
        own, row = pos, None
        if kinds is None or node.kind in kinds:
            a = node.attributes
            row = {"pos": own, "parent": parent, "lft": tick, "top": top, "kind": node.kind}
            rows.append(row)
            row |= {k: a.get(k) for k in _COPIED}
            row["text"] = node.plain()
            value = a.get("value")
            row["value"] = value if value is not None else a.get("url") if node.kind in ("link", "image", "definition", "embed") else row["text"] if node.children else None
            row["name"] = a.get("name") or M.name_of(node)
            row["markdown"] = M.render(node) if markdown else None
        pos += 1
        tick += 1
        for child in node.children:
            visit(child, own, top)
        if row is not None:
            row["rgt"] = tick
        tick += 1

    for i, node in enumerate(nodes):
        visit(node, None, i)
        yield from rows
        rows.clear()


def _parsed(mdx: bool, kinds: frozenset[str] | None, columns: list[tuple[str, pa.DataType]]):
    def run(batches):
        markdown = any(n == "markdown" for n, _ in columns)
        for batch in batches:
            kept: dict[str, list] = {n: [] for n in ("doc_id", *(n for n, _ in columns))}
            kinds_of = {"doc_id": batch.schema.field(0).type, **dict(columns)}
            out = lambda: pa.RecordBatch.from_arrays([pa.array(v, kinds_of[n]) for n, v in kept.items()], list(kept))  # noqa: E731,B023
            for i in range(batch.num_rows):
                doc, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for row in rows_of((n for some in M.stream(text or "", mdx) for n in some), markdown, kinds):
                    kept["doc_id"].append(doc)
                    for n, _ in columns:
                        kept[n].append(row[n])
                    if len(kept["doc_id"]) >= ROWS:  # a document can have more rows than memory holds
                        yield out()
                        for v in kept.values():
                            v.clear()
            yield out()

    return run


def parse_markdown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mdx: bool = False, kinds: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The nodes of each document; with ``kinds`` or ``columns`` only these leave the parser. A null text has none.

    Catalyst can't see into the parser, so a query says by these what it needs: without ``markdown``, nodes are not rendered.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    some = [(n, t) for n, t in _COLUMNS if columns is None or n in columns]
    fields = ", ".join(f for f in FIELDS.split(", ") if columns is None or f.split()[0] in columns)
    return own.mapInArrow(_parsed(mdx, frozenset(kinds) if kinds else None, some), f"doc_id {own.schema[0].dataType.simpleString()}, {fields}")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): a row a line."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), "value")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): a row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("content").alias("value"))


def read_null(spark: SparkSession) -> DataFrame:
    """One empty value, for queries without input."""
    return spark.range(1).select(F.lit("").alias("value"))


def read_markdown(spark: SparkSession, path: str, mdx: bool = False) -> DataFrame:
    """Nodes of the files; doc_id is the file's name."""
    return parse_markdown(read_raw(spark, path), "file", "value", mdx)


def read_separated(spark: SparkSession, path: str, separator: str = ",", header: bool = True) -> DataFrame:
    """CSV, TSV and PSV; every value is a string."""
    return spark.read.csv(path, sep=separator, header=header, multiLine=True, quote='"', escape='"')


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): a variant a file."""
    return read_raw(spark, path).withColumn("value", F.try_parse_json("value"))


EXTENSIONS = {"md": "markdown", "markdown": "markdown", "mdx": "mdx", "html": "html", "htm": "html", "txt": "text", "csv": "csv", "tsv": "tsv", "psv": "psv", "json": "json", "toml": "toml", "toon": "toon", "xml": "xml", "yaml": "yaml", "yml": "yaml", "cbor": "cbor", "gron": "gron"}


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A source by its kind, else by the path's extension."""
    from nodeloom.functions import formats

    kind = kind or EXTENSIONS.get(path.rsplit(".", 1)[-1].lower(), "raw")
    if kind in ("markdown", "mdx"):
        return read_markdown(spark, path, kind == "mdx")
    if kind in ("csv", "tsv", "psv"):
        return read_separated(spark, path, {"csv": ",", "tsv": "\t", "psv": "|"}[kind])
    if kind in ("text", "raw", "bytes", "json"):
        return {"text": read_text, "raw": read_raw, "bytes": read_bytes, "json": read_json}[kind](spark, path)
    if kind in ("toml", "yaml", "xml", "gron", "toon"):
        return read_raw(spark, path).withColumn("value", F.try_parse_json(formats.to_json(kind)("value")))
    if kind == "cbor":
        return read_bytes(spark, path).withColumn("value", F.try_parse_json(formats.to_json(kind)("value")))
    if kind == "html":
        from nodeloom.sources.html import read_html

        return read_html(spark, path)
    raise ValueError(f"no source of kind {kind}")
