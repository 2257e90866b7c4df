"""``python -m nodeloom QUERY PATH...``: run a query over files and print or write what it gives."""

from __future__ import annotations

import argparse
import difflib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.language import run
from nodeloom.sources import html, nodes, sinks

_FORMATS = ["markdown", "text", "raw", "json", "html", "table", "grep", "gron", "csv", "toml", "toon", "xml", "yaml", "shell", "none"]
_DATA = frozenset("csv tsv psv json toml toon xml yaml gron cbor".split())


def documents(spark: SparkSession, paths: list[str], kind: str | None) -> DataFrame:
    """(doc_id, text) of the files: HTML as Markdown, others as they are."""
    out: DataFrame | None = None
    for path in paths:
        one = nodes.read_raw(spark, path).select(F.col("file").alias("doc_id"), F.col("value").alias("text"))
        if _kind(path, kind) == "html":
            one = html.convert(one, "text").select("doc_id", F.col("markdown").alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def _kind(path: str, kind: str | None) -> str:
    return kind or nodes.EXTENSIONS.get(path.rsplit(".", 1)[-1].lower(), "markdown")


def data(spark: SparkSession, paths: list[str], kind: str | None, query: str, host: dict) -> DataFrame:
    """(doc_id, place, value, json, error) of the query over each file of data, parsed by its kind."""
    from nodeloom.functions import formats

    out: DataFrame | None = None
    for path in paths:
        of = _kind(path, kind)
        raw = nodes.read_bytes(spark, path) if of == "cbor" else nodes.read_raw(spark, path)
        parsed = F.col("value") if of == "json" else formats.to_json(of)(F.col("value"))
        one = raw.select(F.col("file").alias("doc_id"), parsed.alias("data"))
        out = one if out is None else out.unionByName(one)
    found = run.over_rows(out, f"json::json_parse(data) | {query}", **host)
    return found.select("doc_id", F.lit(0).alias("place"), F.get_json_object("value", "$").alias("value"), F.col("value").alias("json"), "error")


def given_files(spark: SparkSession, paths: list[str], most: int = 64 << 20) -> dict[str, bytes]:
    """Contents of the files that the query may read, by path; together at most ``most`` bytes, as they travel with the plan."""
    files, size = {}, 0
    for path in paths:
        for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").collect():
            size += r.length
            if size > most:
                raise ValueError(f"the files that the query may read have over {most} bytes")
        for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").collect():
            files[r.path] = files[r.path.removeprefix("file:")] = bytes(r.content)
    return files


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="nodeloom", description=__doc__)
    p.add_argument("query")
    p.add_argument("paths", nargs="+")
    p.add_argument("-A", "--aggregate", action="store_true", help="give the query all nodes of a document at once")
    p.add_argument("--eval-all", action="store_true", help="give the query the nodes of all documents at once")
    p.add_argument("-I", "--input", help="markdown, mdx, html or a format of data; by extension otherwise")
    p.add_argument("-F", "--format", default="markdown", choices=_FORMATS)
    p.add_argument("-U", "--update", action="store_true", help="print the documents, with the query's values in place of the nodes")
    p.add_argument("--diff", action="store_true", help="with -U, print what changes")
    p.add_argument("-S", "--separator", help="a line between the values of different files")
    p.add_argument("-c", "--count", action="store_true", help="the number of values of each file, and of all")
    p.add_argument("-e", "--exit-status", action="store_true", help="1 if there are no values")
    p.add_argument("--limit", type=int)
    p.add_argument("--skip", type=int, default=0)
    p.add_argument("--timeout", type=float, help="seconds after which a document's query is given up")
    p.add_argument("--allow-read", action="append", default=[], help="a file or folder that the query may read")
    p.add_argument("-o", "--output", help="a folder to write to, instead of printing")
    a = p.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("nodeloom").getOrCreate()
    host = {k: v for k, v in (("seconds", a.timeout), ("files", given_files(spark, a.allow_read))) if v}
    if a.update or a.diff:
        return _update(documents(spark, a.paths, a.input), a, host)
    if all(_kind(path, a.input) in _DATA for path in a.paths):
        found = data(spark, a.paths, a.input, a.query, host)
    else:
        docs = documents(spark, a.paths, a.input)
        if a.eval_all:  # one list of all documents is one document
            texts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"])
            docs = docs.agg(F.array_join(texts, "\n\n").alias("text")).select(F.lit("all").alias("doc_id"), "text")
        found = run.evaluate(docs, f"nodes | {a.query}" if a.aggregate or a.eval_all else a.query, mdx=a.input == "mdx", **host)
    found = found.persist()  # errors and values are read from one evaluation
    try:
        return _report(found, a)
    finally:
        found.unpersist()


def _report(found: DataFrame, a: argparse.Namespace) -> int:
    for r in found.where("error is not null").select("doc_id", "error").toLocalIterator():
        print(f"{r.doc_id}: {r.error}", file=sys.stderr)
    values = found.where("error is null")
    if a.count:
        total = 0
        for r in values.rollup("doc_id").agg(F.count("*").alias("n")).orderBy(F.asc_nulls_last("doc_id")).toLocalIterator():
            print(f"{r.doc_id or 'total'}: {r.n}")
            total = r.n
        if not total:
            print("total: 0")
        return int(a.exit_status and not total)
    shown = {"json": F.col("json").alias("value"), "grep": F.concat_ws(":", "doc_id", "place", "value").alias("value")}.get(a.format)
    if shown is None:
        shown = sinks.rendered(a.format) if a.format not in ("markdown", "text", "raw", "none") else F.col("value")
    values = values.orderBy("doc_id", "place").select("doc_id", shown).offset(a.skip)
    values = values.limit(a.limit) if a.limit is not None else values
    if a.format == "none":
        values.write.format("noop").mode("overwrite").save()
    elif a.output:
        values.select("value").write.text(a.output)
    else:
        before = None
        for r in values.toLocalIterator():
            if a.separator is not None and before is not None and r.doc_id != before:
                print(a.separator)
            print(r.value)
            before = r.doc_id
    return int(a.exit_status and values.isEmpty())


def _update(docs: DataFrame, a: argparse.Namespace, host: dict) -> int:
    found = run.update(docs, a.query, mdx=a.input == "mdx", **host)
    if a.output:
        found.select("value").write.text(a.output, lineSep="\n")
        return 0
    changed, before = False, None
    for r in found.orderBy("doc_id").toLocalIterator():
        if r.error is not None:
            print(f"{r.doc_id}: {r.error}", file=sys.stderr)
        if a.diff:
            lines = list(difflib.unified_diff((r.text or "").split("\n"), (r.value or "").split("\n"), r.doc_id, r.doc_id, lineterm=""))
            changed = changed or bool(lines)
            print(*lines, sep="\n", end="\n" if lines else "")
        else:
            if a.separator is not None and before is not None:
                print(a.separator)
            print(r.value)
        before = r.doc_id
    return int(a.exit_status and a.diff and not changed)


if __name__ == "__main__":
    sys.exit(main())
