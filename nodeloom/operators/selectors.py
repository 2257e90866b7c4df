"""Selectors over the ``nodes`` table: a spelling becomes a predicate or a column, and Catalyst does the rest."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_KINDS = {
    "blockquote": [">"],
    "footnote": ["^"],
    "mdx_jsx_flow_element": ["<"],
    "emphasis": ["**"],
    "math": ["$$"],
    "hr": ["horizontal_rule", "---", "***", "___"],
    "mdx_text_expression": ["{}"],
    "footnoteref": ["[^]", "footnote_ref"],
    "definition": [],
    "break": ["br"],
    "delete": [],
    "html": ["<>"],
    "image": [],
    "image_ref": [],
    "code_inline": ["inline_code"],
    "math_inline": ["inline_math"],
    "link_ref": [],
    "wikilink": [],
    "callout": [],
    "embed": [],
    "list": ["[]", "li"],
    "toml": [],
    "strong": [],
    "yaml": [],
    "code": ["code_block"],
    "mdx_js_esm": [],
    "mdx_jsx_text_element": [],
    "mdx_flow_expression": [],
    "text": ["p", "paragraph"],
    "table_align": [],
}
_KIND_OF = {name: kind for kind, others in _KINDS.items() for name in (kind, *others)}
#: Attributes that a kind has; of any other they are null.
_HAS = {
    "value": "footnote html text code code_inline math_inline math yaml toml link wikilink callout embed heading list table_cell mdx_flow_expression mdx_text_expression mdx_js_esm strong blockquote delete emphasis",
    "lang": "code",
    "meta": "code",
    "fence": "code",
    "url": "image link wikilink embed definition",
    "alt": "image image_ref",
    "title": "image link callout definition",
    "ident": "footnote image_ref link_ref footnoteref definition",
    "label": "image_ref link_ref footnoteref definition",
    "depth": "heading",
    "index": "list",
    "ordered": "list",
    "checked": "list",
    "column": "table_cell",
    "row": "table_cell",
    "align": "table_align",
    "name": "mdx_jsx_flow_element mdx_jsx_text_element",
    "kind": "callout",
}
_STORED = {"index": "idx", "column": "col", "kind": "callout"}
#: What the arguments of a selector are compared with.
_ARGUMENT = {"heading": "depth", "code": "lang", "link": "url", "image": "url", "link_ref": "ident", "image_ref": "ident", "footnoteref": "ident", "footnote": "ident", "definition": "ident"}


def attribute(name: str) -> Column:
    """An attribute of the node, null where its kind has none. ``level`` is a heading's depth or an item's level."""
    if name == "level":
        return F.when(F.col("kind") == "heading", F.col("depth")).when(F.col("kind") == "list", F.col("level"))
    if name not in _HAS:
        raise ValueError(f"no attribute {name}")
    return F.when(F.col("kind").isin(_HAS[name].split()), F.col(_STORED.get(name, name)))


def predicate(selector: str, *arguments: str | int | range) -> Column:
    """The condition of a selector such as ``.h2``, ``.code``, ``.[1]`` or ``.[0][2]``; arguments narrow it, as in (".h", 1, 2)."""
    if not selector.startswith("."):
        raise ValueError(f"a selector begins with a dot: {selector}")
    name, kind = selector[1:], F.col("kind")
    if m := re.fullmatch(r"\[(\d*)\]\[(\d*)\]", name):
        cell = kind == "table_cell"
        for column, index in (("row", m.group(1)), ("col", m.group(2))):
            if index:
                cell = cell & (F.col(column) == int(index))
        return cell if any(m.groups()) else kind.isin("table_cell", "table_align")
    if m := re.fullmatch(r"\[(\d+)\]", name):
        return (kind == "list") & (F.col("idx") == int(m.group(1)))
    if m := re.fullmatch(r"h([1-6])", name):
        return (kind == "heading") & (F.col("depth") == int(m.group(1)))
    out = {
        "h": kind == "heading",
        "heading": kind == "heading",
        "link": kind.isin("link", "wikilink"),
        "table": kind.isin("table_cell", "table_align"),
        "task": (kind == "list") & F.col("checked").isNotNull(),
        "todo": (kind == "list") & ~F.col("checked"),
        "done": (kind == "list") & F.col("checked"),
    }.get(name)
    if out is None:
        if name not in _KIND_OF:
            raise ValueError(f"no selector {selector}")
        out = kind == _KIND_OF[name]
    if arguments:
        column = _ARGUMENT.get({"h": "heading"}.get(name, _KIND_OF.get(name, name)))
        if column is None:
            raise ValueError(f"{selector} takes no arguments")
        values = [v for a in arguments for v in (a if isinstance(a, range) else [a])]
        out = out & F.col(column).isin(values)
    return out


def select(nodes: DataFrame, selector: str, *arguments: str | int | range) -> DataFrame:
    """Nodes at the top of the document for which the selector holds; a path such as ``.blockquote .code`` looks below the first."""
    first, *rest = selector.split()
    hit = F.col("parent").isNull() & predicate(first, *(() if rest else arguments))
    # Below a hit is what begins before the farthest end of the hits before it: a window over the document, and no join.
    before = W.partitionBy("doc_id").orderBy("lft").rowsBetween(W.unboundedPreceding, -1)
    for i, part in enumerate(rest):
        nodes = nodes.withColumn("__reach", F.max(F.when(hit, F.col("rgt"))).over(before)).withColumn("__below", F.coalesce(F.col("__reach") > F.col("lft"), F.lit(False)))
        hit = F.col("__below") & predicate(part, *(arguments if i == len(rest) - 1 else ()))
    return nodes.where(hit).drop("__reach", "__below")


def within(nodes: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Nodes below one of ``ancestors``: an equi-join on the document, with the interval as a residual condition."""
    a = ancestors.select(F.col("doc_id").alias("a_doc"), F.col("lft").alias("a_lft"), F.col("rgt").alias("a_rgt"))
    return nodes.join(a, (F.col("doc_id") == F.col("a_doc")) & (F.col("lft") > F.col("a_lft")) & (F.col("rgt") < F.col("a_rgt")), "left_semi")


def children(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    p = parents.select(F.col("doc_id").alias("p_doc"), F.col("pos").alias("p_pos"))
    return nodes.join(p, (F.col("doc_id") == F.col("p_doc")) & (F.col("parent") == F.col("p_pos")), "left_semi")


def set_attribute(nodes: DataFrame, selector: str, name: str, value) -> DataFrame:
    """The nodes with one attribute set where the selector holds."""
    column = _STORED.get(name, name)
    return nodes.withColumn(column, F.when(predicate(selector), F.lit(value)).otherwise(F.col(column)))


def grep(rows: DataFrame, condition: Column, before: int = 0, after: int = 0, group: str = "doc_id", order: str = "pos") -> DataFrame:
    """Rows for which the condition holds and those around them, with is_match."""
    near = W.partitionBy(group).orderBy(order).rowsBetween(-after, before)
    return rows.withColumn("is_match", condition).withColumn("__near", F.max("is_match").over(near)).where("__near").drop("__near")
