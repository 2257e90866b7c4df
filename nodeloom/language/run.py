"""Queries over tables of documents.

Pipelines of selectors, ``select`` with conditions on a node's text or attributes, attributes and text functions compile to
filters and projections over the ``nodes`` table, for which the parser gives only the kinds of nodes that they can hit. Any other query is
evaluated document by document in an Arrow function, which needs no shuffle: a document is one row.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nodeloom.functions import text as S
from nodeloom.language.grammar import parse
from nodeloom.operators import selectors
from nodeloom.operators.selectors import _KIND_OF
from nodeloom.sources.nodes import _COLUMNS, parse_markdown

#: Functions of a text without arguments, and with literal ones, as columns.
_TEXT = {
    "downcase": S.downcase, "upcase": S.upcase, "ascii_downcase": S.ascii_downcase, "ascii_upcase": S.ascii_upcase, "trim": S.trim, "ltrim": S.ltrim, "rtrim": S.rtrim, "slugify": S.slugify,
    "md5": F.md5, "sha256": lambda c: F.sha2(c, 256), "to_text": lambda c: c, "to_string": lambda c: c, "identity": lambda c: c,
}
_TEXT_WITH = {"ltrimstr": (S.ltrimstr, (str,)), "rtrimstr": (S.rtrimstr, (str,)), "replace": (S.replace, (str, str)), "repeat": (S.repeat, (int,))}
#: Kinds whose nodes have none of their own kind in them.
_FLAT = frozenset("heading code code_inline text image html hr break math math_inline yaml toml definition list table_align footnoteref image_ref wikilink embed".split())
_TESTS = {"contains": S.contains, "starts_with": S.starts_with, "ends_with": S.ends_with, "test": S.matches, "is_regex_match": S.matches}


def _condition(e) -> Column | None:
    """A condition on the node in the pipe, if columns can express it."""
    if e[0] == "call" and e[1] in _TESTS and len(e[2]) == 1 and e[2][0][0] == "literal":
        return F.coalesce(_TESTS[e[1]]("text", e[2][0][1]), F.lit(False))
    if e[0] == "call" and e[1] == "not":
        inner = _condition(e[2][0])
        return None if inner is None else ~inner
    if e[0] in ("and", "or"):
        a, b = _condition(e[1]), _condition(e[2])
        return None if a is None or b is None else a & b if e[0] == "and" else a | b
    if e[0] == "call" and e[1] in ("eq", "ne") and e[2][0][0] == "selector" and e[2][1][0] == "literal" and not e[2][0][2]:
        try:
            same = selectors.attribute(e[2][0][1][1:]).eqNullSafe(F.lit(e[2][1][1]))
        except ValueError:
            return None
        return same if e[1] == "eq" else ~same
    if e[0] == "selector":
        return _predicate(e)
    return None


def _predicate(e) -> Column | None:
    if any(a[0] != "literal" for a in e[2]):
        return None
    try:
        return F.coalesce(selectors.predicate(e[1], *[a[1] for a in e[2]]), F.lit(False))
    except ValueError:
        return None


def _flat_kind(selector: str) -> str | None:
    """The kind that a selector asks for, if such nodes have none of their kind in them."""
    kind = "heading" if re.fullmatch(r"\.h([1-6]|eading)?", selector) else _KIND_OF.get(selector[1:])
    return kind if kind in _FLAT else None


def _wanted(query: str) -> list[str] | None:
    """The kinds that can be in the result, if the query begins with a selector of one; the parser needs to give no others."""
    first = (parse(query) or [("",)])[0]
    first = first[1] if first[0] == "chain" and first[3] else first
    kind = _flat_kind(first[1]) if first[0] == "selector" else None
    return [kind] if kind else None


def compiled(nodes: DataFrame, query: str) -> DataFrame | None:
    """(doc_id, pos, value) by columns, or None if the query needs the evaluator."""
    found = _compiled(nodes, query)
    return found and found[0]


def _compiled(nodes: DataFrame, query: str) -> tuple[DataFrame, bool] | None:
    """The rows, and whether their values are rendered nodes."""
    hit, value, is_node, nests = F.lit(True), F.col("markdown") if "markdown" in nodes.columns else F.lit(None), True, True
    for step in parse(query):
        attribute = None
        if step[0] == "chain" and step[3] and step[1][0] == "selector" and not step[2][2]:
            step, attribute = step[1], step[2][1][1:]
        elif step[0] == "selector" and is_node and not step[2] and step[1][1:] in selectors._HAS | {"level": ""} and step[1][1:] not in selectors._KIND_OF:
            step, attribute = None, step[1][1:]
        if step is not None:
            if not is_node:
                arguments = step[2] if step[0] == "call" else []
                if step[0] in ("ident", "call") and step[1] in _TEXT and not arguments:
                    value = _TEXT[step[1]](value)
                    continue
                if step[0] == "call" and step[1] in _TEXT_WITH and all(x[0] == "literal" for x in arguments):
                    f, kinds = _TEXT_WITH[step[1]]
                    given = [x[1] for x in arguments]
                    if tuple(map(type, given)) == kinds and "" not in given:
                        value = f(value, *given)
                        continue
                return None
            if step[0] == "selector":
                where = _predicate(step)
            elif step[0] == "call" and step[1] == "select" and len(step[2]) == 1:
                where = _condition(step[2][0])
            elif step[0] in ("ident", "call") and step[1] in ("to_text", "to_string") and not (step[2] if step[0] == "call" else []):
                value, is_node = F.col("text"), False
                continue
            else:
                return None
            if where is None:
                return None
            hit = hit & where
            nests = nests and not (step[0] == "selector" and _flat_kind(step[1]))
        if attribute is not None:
            try:
                value, is_node = selectors.attribute(attribute).cast("string"), False
            except ValueError:
                return None
    rows = nodes.withColumn("__value", value).where(hit & F.col("__value").isNotNull())
    if nests:  # of hits within each other the outermost counts
        before = W.partitionBy("doc_id").orderBy("lft").rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumn("__reach", F.max("rgt").over(before)).where("__reach is null or __reach < lft")
    return rows.select("doc_id", "pos", F.col("__value").alias("value")).where("value <> ''"), is_node


def _evaluated(query: str, mdx: bool, host: dict):
    def run(batches):
        from nodeloom.language.evaluate import Evaluator, compact, plain, show
        from nodeloom.sources import markdown_parser as M

        steps, first = parse(query), None
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    first = first or Evaluator(**host)
                    found = compact(first.again().document(steps, M.parse(text or "", mdx)))
                    rows += [(doc, i, show(v), json.dumps(plain(v), ensure_ascii=False), None) for i, v in enumerate(found)]
                except Exception as error:  # one document's error is its own
                    rows.append((doc, None, None, None, str(error)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "place", "value", "json", "error"])

    return run


def evaluate(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", mdx: bool = False, **host) -> DataFrame:
    """(doc_id, place, value, json, error) of each value that the query gives for a document; an error is a row of its own.

    ``host``: modules (texts by name), files (contents by path, the only ones that the query can read), functions (the host's own by
    name) and seconds (after which a document's query is given up). They travel with the plan, so they should be small.
    """
    parse(query)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_evaluated(query, mdx, host), f"doc_id {own.schema[0].dataType.simpleString()}, place int, value string, json string, error string")


def run(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", mdx: bool = False, **host) -> DataFrame:
    """(doc_id, value): the query's values that are not empty, by columns where that is possible."""
    kinds = _wanted(query)
    by_columns = None if host else _compiled(parse_markdown(docs, id_col, text_col, mdx, kinds), query)
    if by_columns is not None:
        found, rendered = by_columns
        if not rendered:
            unrendered = [n for n, _ in _COLUMNS if n != "markdown"]
            found, _ = _compiled(parse_markdown(docs, id_col, text_col, mdx, kinds, unrendered), query)
        return found.select("doc_id", "value")
    return evaluate(docs, query, id_col, text_col, mdx, **host).select("doc_id", "value")


def _of_rows(query: str, names: list[str], host: dict):
    def run(batches):
        from nodeloom.language.evaluate import Evaluator, Scope, plain

        steps, first = parse(query), Evaluator(**host)
        as_json = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
        for batch in batches:
            values, errors = [], []
            for row in batch.to_pylist():
                row = {k: v.timestamp() if isinstance(v, dt.datetime) else float(v) if isinstance(v, decimal.Decimal) else v for k, v in row.items()}
                ev = first.again()
                ev.top.names |= row
                try:
                    found = ev.over(steps, row, Scope(ev.top))
                    values.append(as_json(plain(found)))
                    errors.append(None)
                except Exception as error:  # one row's error is its own
                    values.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string()), pa.array(errors, pa.string())], [*names, "value", "error"])

    return run


def _spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out evenly to a few tasks a core: a file of few row groups is read by as few tasks, however many cores there are."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))


def over_rows(rows: DataFrame, query: str, **host) -> DataFrame:
    """``rows`` with value, what the query gives for a row as JSON, and error; their order is open.

    A row is a map in the pipe, and its columns are variables of the query. Columns named value or error are replaced.
    """
    parse(query)
    own = _spread(rows.drop("value", "error"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(_of_rows(query, own.columns, host), ", ".join(x for x in (fields, "value string, error string") if x))


def _rewritten(query: str, mdx: bool, host: dict):
    def run(batches):
        from nodeloom.language.evaluate import Evaluator
        from nodeloom.sources import markdown_parser as M

        steps, first = parse(query), None
        for batch in batches:
            texts, errors = [], []
            for text in batch.column(1).to_pylist():
                try:
                    first = first or Evaluator(**host)
                    texts.append(M.document(first.again().rewritten(steps, M.parse(text or "", mdx))))
                    errors.append(None)
                except Exception as error:  # the document stays as it is
                    texts.append(text)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["doc_id", "text", "value", "error"])

    return run


def update(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", mdx: bool = False, **host) -> DataFrame:
    """(doc_id, text, value, error): each document with the query's values in place of the nodes that it has some for."""
    parse(query)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_rewritten(query, mdx, host), f"doc_id {own.schema[0].dataType.simpleString()}, text string, value string, error string")
