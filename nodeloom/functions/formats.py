"""Text formats and JSON, which Spark's variants take in. Parsers without a counterpart in Spark are Arrow functions."""

from __future__ import annotations

import csv
import io
import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.kinds import col


def parse_csv(text: str, separator: str = ",", header: bool = True) -> list:
    rows = list(csv.reader(io.StringIO(text), delimiter=separator))
    return [dict(zip(rows[0], r)) for r in rows[1:]] if header and rows else rows


def parse_yaml(text: str) -> Any:
    import yaml

    found = list(yaml.safe_load_all(text))
    return found[0] if len(found) == 1 else found


def parse_xml(text: str) -> Any:
    def of(e: ET.Element) -> dict:
        return {"tag": e.tag, "attributes": dict(e.attrib), "children": [of(c) for c in e], "text": (e.text or "").strip() or None}

    return of(ET.fromstring(text))


_STEP = re.compile(r"\.([A-Za-z_$][\w$]*)|\[(\d+)\]|\[(\"(?:[^\"\\]|\\.)*\")\]")


def parse_gron(text: str) -> Any:
    """Assignments such as ``json.a[0] = 1;`` to the value that they make."""
    root: dict = {}
    for line in text.splitlines():
        left, equals, right = line.rstrip().removesuffix(";").partition(" = ")
        if equals:
            steps = [m.group(1) if m.group(1) is not None else int(m.group(2)) if m.group(2) is not None else json.loads(m.group(3)) for m in _STEP.finditer(left)]
            _put(root, ["", *steps], json.loads(right))
    return root.get("")


def _put(root: Any, steps: list, value: Any) -> None:
    for step in steps[:-1]:
        root = root[step]
    if isinstance(root, list):
        root.extend([None] * (steps[-1] + 1 - len(root)))
    root[steps[-1]] = value


def write_gron(value: Any, name: str = "json") -> str:
    out: list[str] = []

    def visit(v: Any, path: str) -> None:
        if isinstance(v, dict):
            out.append(f"{path} = {{}};")
            for k in sorted(v):
                visit(v[k], path + (f".{k}" if re.fullmatch(r"[A-Za-z_$][\w$]*", k) else f"[{json.dumps(k)}]"))
        elif isinstance(v, list):
            out.append(f"{path} = [];")
            for i, x in enumerate(v):
                visit(x, f"{path}[{i}]")
        else:
            out.append(f"{path} = {json.dumps(v, ensure_ascii=False)};")

    visit(value, name)
    return "\n".join(out)


def write_yaml(value: Any) -> str:
    import yaml

    return yaml.safe_dump(value, sort_keys=True, allow_unicode=True).removesuffix("...\n")


def write_csv(rows: list, separator: str = ",") -> str:
    out = io.StringIO()
    writer = csv.writer(out, delimiter=separator, lineterminator="\n")
    if rows and isinstance(rows[0], dict):
        heads = list(rows[0])
        writer.writerow(heads)
        rows = [[r.get(h) for h in heads] for r in rows]
    writer.writerows(rows)
    return out.getvalue().rstrip("\n")


def write_shell(value: Any) -> str:
    out: list[str] = []

    def visit(v: Any, path: list[str]) -> None:
        if isinstance(v, (dict, list)):
            for k, x in sorted(v.items()) if isinstance(v, dict) else enumerate(v):
                visit(x, [*path, str(k)])
        else:
            shown = "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
            out.append("_".join(path) + "='" + shown.replace("'", "'\\''") + "'")

    visit(value, [])
    return "\n".join(out)


_PARSERS: dict[str, Callable[[str], Any]] = {
    "csv": parse_csv,
    "tsv": lambda t: parse_csv(t, "\t"),
    "psv": lambda t: parse_csv(t, "|"),
    "toml": tomllib.loads,
    "yaml": parse_yaml,
    "xml": parse_xml,
    "gron": parse_gron,
}
_WRITERS: dict[str, Callable[[Any], str]] = {"gron": write_gron, "yaml": write_yaml, "csv": write_csv, "shell": write_shell}


def to_json(kind: str) -> Callable[[Column | str], Column]:
    """From text of this kind to JSON; null for what can't be parsed."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(_PARSERS[kind](text), ensure_ascii=False, sort_keys=True, default=str)
        except Exception:
            return None

    parse = F.pandas_udf(_series(one), "string")
    return lambda c: parse(col(c))


def from_json(kind: str) -> Callable[[Column | str], Column]:
    """From JSON to text of this kind; null for what is no JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else _WRITERS[kind](json.loads(text))
        except ValueError:
            return None

    write = F.pandas_udf(_series(one), "string")
    return lambda c: write(col(c))


def _series(one: Callable[[str | None], str | None]):
    def run(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    return run


def get_path(text, *steps: str | int) -> Column:
    """The text of what JSON has at a path; null where it has nothing."""
    return F.get_json_object(col(text), "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps))


def markdown_table(rows: DataFrame, columns: list[str], group: str, order: str) -> DataFrame:
    """(group, table): each group's rows as a table in Markdown."""
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("l"))))
    head = f"| {' | '.join(columns)} |\n| {' | '.join('---' for _ in columns)} |\n"
    return rows.groupBy(group).agg(F.concat(F.lit(head), F.array_join(F.transform(body, lambda x: x["l"]), "\n")).alias("table"))


def write_toml(value: dict, at: str = "") -> str:
    """Plain values first, then tables and arrays of tables."""

    def one(v: Any) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, str):
            return json.dumps(v, ensure_ascii=False)
        if isinstance(v, list):
            return "[" + ", ".join(one(x) for x in v) + "]"
        if isinstance(v, dict):
            return "{ " + ", ".join(f"{key(k)} = {one(x)}" for k, x in sorted(v.items())) + " }"
        return str(v)

    key = lambda k: k if re.fullmatch(r"[\w-]+", k) else json.dumps(k)
    nested = lambda v: isinstance(v, dict) or (isinstance(v, list) and v and all(isinstance(x, dict) for x in v))
    out = [f"{key(k)} = {one(v)}" for k, v in sorted(value.items()) if not nested(v) and v is not None]
    for k, v in sorted(value.items()):
        name = f"{at}.{key(k)}" if at else key(k)
        if isinstance(v, dict):
            out.append(f"[{name}]\n{write_toml(v, name)}".rstrip())
        elif nested(v):
            out += [f"[[{name}]]\n{write_toml(x, name)}".rstrip() for x in v]
    return "\n".join(out)


def write_xml(value: dict, depth: int = 0) -> str:
    """An element of tag, attributes, children and text."""
    from xml.sax.saxutils import escape, quoteattr

    head = value["tag"] + "".join(f" {k}={quoteattr(str(v))}" for k, v in sorted(value.get("attributes", {}).items()))
    inside = escape(value.get("text") or "") + "".join(write_xml(c, depth + 1) for c in value.get("children", []))
    return f"<{head}>{inside}</{value['tag']}>" if inside else f"<{head}/>"


def write_toon(value: Any, depth: int = 0, name: str = "") -> str:
    """Keys with colons, indented; arrays with their length, those of like records as a head and rows."""

    def one(v: Any) -> str:
        if isinstance(v, str):
            return json.dumps(v, ensure_ascii=False) if v == "" or v != v.strip() or re.search(r'[,:"\\\n\[\]{}]|^(true|false|null|-?\d.*|-)$', v) else v
        return "null" if v is None else "true" if v is True else "false" if v is False else str(v)

    pad = "  " * depth
    if isinstance(value, dict):
        lines = []
        for k, v in value.items():
            if isinstance(v, dict):
                lines.append(f"{pad}{k}:" + ("\n" + write_toon(v, depth + 1) if v else ""))
            elif isinstance(v, list):
                lines.append(write_toon(v, depth, k))
            else:
                lines.append(f"{pad}{k}: {one(v)}")
        return "\n".join(lines)
    if isinstance(value, list):
        flat = lambda v: not isinstance(v, (dict, list))
        if all(map(flat, value)):
            return f"{pad}{name}[{len(value)}]:" + (" " + ",".join(map(one, value)) if value else "")
        if all(isinstance(v, dict) and list(v) == list(value[0]) and all(map(flat, v.values())) for v in value):
            return f"{pad}{name}[{len(value)}]{{{','.join(value[0])}}}:" + "".join(f"\n{pad}  " + ",".join(map(one, v.values())) for v in value)
        return f"{pad}{name}[{len(value)}]:" + "".join(f"\n{pad}  - " + (one(v) if flat(v) else write_toon(v, depth + 2).lstrip()) for v in value)
    return one(value)


def parse_toon(text: str) -> Any:
    """What :func:`write_toon` writes of maps, arrays of plain values and arrays of like records."""
    lines = [x for x in text.split("\n") if x.strip()]

    def one(s: str) -> Any:
        s = s.strip()
        try:
            return json.loads(s)
        except ValueError:
            return s

    def cells(s: str) -> list:
        return [one(c) for c in next(csv.reader([s], escapechar="\\", doublequote=False))] if s.strip() else []

    def block(i: int, depth: int) -> tuple[dict, int]:
        out: dict = {}
        while i < len(lines) and len(lines[i]) - len(lines[i].lstrip()) == 2 * depth:
            line = lines[i].strip()
            if m := re.match(r"([^\[:]*)\[(\d+)\](?:\{([^}]*)\})?:(.*)$", line):
                name, n, heads, rest = m.group(1), int(m.group(2)), m.group(3), m.group(4)
                i += 1
                if heads is None:
                    out[name] = cells(rest)
                else:
                    out[name] = [dict(zip(heads.split(","), cells(lines[j]))) for j in range(i, i + n)]
                    i += n
            else:
                k, _, rest = line.partition(":")
                i += 1
                if rest.strip():
                    out[k] = one(rest)
                else:
                    out[k], i = block(i, depth + 1)
        return out, i

    if not lines:
        return {}
    if lines[0].startswith("["):
        return block(0, 0)[0][""]
    return block(0, 0)[0] if ":" in lines[0] else one(lines[0])


def write_cbor(value: Any) -> bytes:
    """RFC 8949, with shortest heads."""

    def head(major: int, n: int) -> bytes:
        if n < 24:
            return bytes([major << 5 | n])
        size = next(s for s in (1, 2, 4, 8) if n < 1 << 8 * s)
        return bytes([major << 5 | {1: 24, 2: 25, 4: 26, 8: 27}[size]]) + n.to_bytes(size, "big")

    if value is None or isinstance(value, bool):
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[value]
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        value = int(value)
    if isinstance(value, int):
        return head(0, value) if value >= 0 else head(1, -1 - value)
    if isinstance(value, float):
        import struct

        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, bytes):
        return head(2, len(value)) + value
    if isinstance(value, str):
        data = value.encode()
        return head(3, len(data)) + data
    if isinstance(value, list):
        return head(4, len(value)) + b"".join(map(write_cbor, value))
    return head(5, len(value)) + b"".join(write_cbor(str(k)) + write_cbor(v) for k, v in sorted(value.items()))


def parse_cbor(data: bytes) -> Any:
    import struct

    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("the data ends too soon")
        at += n
        return data[at - n : at]

    def item() -> Any:
        first = take(1)[0]
        major, low = first >> 5, first & 31
        if major == 7 and low in (20, 21, 22, 23):
            return {20: False, 21: True, 22: None, 23: None}[low]
        if major == 7 and low in (25, 26, 27):
            return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[low], take({25: 2, 26: 4, 27: 8}[low]))[0]
        n = low if low < 24 else int.from_bytes(take({24: 1, 25: 2, 26: 4, 27: 8}[low]), "big")
        if major < 2:
            return n if major == 0 else -1 - n
        if major < 4:
            return take(n) if major == 2 else take(n).decode()
        if major == 4:
            return [item() for _ in range(n)]
        if major == 5:
            return {str(item()): item() for _ in range(n)}
        return item()

    return item()


def front_matter(value: dict) -> str:
    return f"---\n{write_yaml(value)}---\n"


_PARSERS |= {"toon": parse_toon}
_WRITERS |= {"toml": write_toml, "xml": write_xml, "toon": write_toon}
