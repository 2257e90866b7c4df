"""Modules of the language: tables, versions, fuzzy matches, formats, checks. Importing it registers them."""

from __future__ import annotations

import functools
import json
import random
import re
import time
import uuid
from typing import Any

from nodeloom.functions import formats, fuzzy
from nodeloom.language.builtins import NATIVES, _add, _del_path, _is, _key, _levenshtein, _plain, _same, _show, _text, _true, _type
from nodeloom.language.grammar import QueryError
from nodeloom.sources import html
from nodeloom.sources import markdown_parser as M


def _leaf(kind: str, v: Any, **attributes: Any) -> M.Node:
    inner = v if isinstance(v, list) else [v] if isinstance(v, M.Node) else [M.Node("text", attributes={"value": _text(v)})]
    return M.Node(kind, inner, attributes)


# Tables: {type, align, header, rows}, whose cells are nodes.


def _tables(ev, nodes: list) -> list:
    out: list[dict] = []
    for n in nodes:
        if not isinstance(n, M.Node) or n.kind not in ("table_cell", "table_align"):
            continue
        if n.kind == "table_align":
            out[-1]["align"] = n
        elif n.attributes["row"] == 0:
            if n.attributes["col"] == 0:
                out.append({"type": "table", "align": None, "header": [], "rows": []})
            out[-1]["header"].append(n)
        else:
            if n.attributes["col"] == 0:
                out[-1]["rows"].append([])
            out[-1]["rows"][-1].append(n)
    return out


def _cells(t: dict) -> list[list[str]]:
    return [[_text(c) for c in row] for row in [t["header"], *t["rows"]]]


def _table_of(header: list, rows: list, align: Any = None) -> dict:
    cell = lambda v, r, c: v if isinstance(v, M.Node) and v.kind == "table_cell" and v.attributes == {"row": r, "col": c} else M.Node("table_cell", v.children if isinstance(v, M.Node) and v.children else [M.Node("text", attributes={"value": _text(v)})], {"row": r, "col": c})
    heads = [cell(v, 0, i) for i, v in enumerate(header)]
    body = [[cell(v, r + 1, i) for i, v in enumerate(row)] for r, row in enumerate(rows)]
    names = align.attributes["align"] if isinstance(align, M.Node) else align or []
    return {"type": "table", "align": M.Node("table_align", attributes={"align": (list(map(str, names)) + ["none"] * len(heads))[: len(heads)]}), "header": heads, "rows": body}


def _with_rows(t: dict, rows: list) -> dict:
    return _table_of(t["header"], rows, t["align"])


def _add_row(ev, t: dict, row: list) -> dict:
    if len(row) != len(t["header"]):
        raise QueryError("a row has as many cells as the header")
    return _with_rows(t, [*t["rows"], row])


def _add_column(ev, t: dict, column: list) -> dict:
    if len(column) != len(t["rows"]) + 1:
        raise QueryError("a column has a cell for the header and each row")
    return _table_of([*t["header"], column[0]], [[*r, c] for r, c in zip(t["rows"], column[1:])], t["align"])


def _sort_rows(ev, t: dict, column: int | None = None) -> dict:
    return _with_rows(t, sorted(t["rows"], key=lambda r: [_text(c) for c in r] if column is None else _text(r[int(column)])))


def _longer(ev, t: dict, columns: list, name: str = "name", value: str = "value") -> dict:
    heads = [_text(h) for h in t["header"]]
    keep = [i for i in range(len(heads)) if i not in columns and heads[i] not in columns]
    moved = [i for i in range(len(heads)) if i not in keep]
    return _table_of([heads[i] for i in keep] + [name, value], [[_text(r[i]) for i in keep] + [heads[j], _text(r[j])] for r in t["rows"] for j in moved])


def _wider(ev, t: dict, names: Any, values: Any) -> dict:
    heads = [_text(h) for h in t["header"]]
    at = lambda c: c if isinstance(c, int) else heads.index(c)
    n, v = at(names), at(values)
    keep = [i for i in range(len(heads)) if i not in (n, v)]
    new = list(dict.fromkeys(_text(r[n]) for r in t["rows"]))
    rows: dict[tuple, dict] = {}
    for r in t["rows"]:
        rows.setdefault(tuple(_text(r[i]) for i in keep), {})[_text(r[n])] = _text(r[v])
    return _table_of([heads[i] for i in keep] + new, [[*k, *[x.get(c, "") for c in new]] for k, x in rows.items()])


def _records(t: dict) -> list[dict]:
    head, *rows = _cells(t)
    return [dict(zip(head, r)) for r in rows]


def _markdown_table(records: Any) -> str:
    """Records, or a map, as a table in Markdown."""
    if isinstance(records, dict):
        heads, rows = ["Key", "Value"], [[k, v] for k, v in sorted(records.items())]
    elif records and isinstance(records[0], dict):
        heads = list(records[0])
        rows = [[r.get(h) for h in heads] for r in records]
    else:
        heads, rows = (records[0], records[1:]) if records and isinstance(records[0], list) else (["Value"], [[r] for r in records])
    line = lambda cells: "| " + " | ".join((_show(c) if not isinstance(c, (dict, list)) else json.dumps(_plain(c))).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(heads), line(["---"] * len(heads)), *map(line, rows)])


# Versions.

_VERSION = re.compile(r"v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$")


def _version(v: Any) -> dict:
    if isinstance(v, dict):
        return v
    m = _VERSION.match(_text(v))
    if not m:
        raise QueryError(f"no version: {_text(v)}")
    return {"major": int(m.group(1)), "minor": int(m.group(2)), "patch": int(m.group(3)), "pre": m.group(4), "build": m.group(5)}


def _rank(v: Any) -> tuple:
    p = _version(v)
    pre = tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in (p.get("pre") or "").split("."))
    return p["major"], p["minor"], p["patch"], p.get("pre") is None, pre


def _compare(a: Any, b: Any) -> int:
    x, y = _rank(a), _rank(b)
    return (x > y) - (x < y)


def _bump(i: int):
    def run(ev, v):
        p = _version(v)
        numbers = [p["major"], p["minor"], p["patch"]]
        return ".".join(str(n if j < i else n + 1 if j == i else 0) for j, n in enumerate(numbers))

    return run


def _satisfies(ev, v: Any, wanted: str) -> bool:
    def one(text: str) -> bool:
        m = re.fullmatch(r"(\^|~|>=|<=|>|<|=)?v?(\d+)(?:\.(\d+|x|\*))?(?:\.(\d+|x|\*))?(?:-([\w.]+))?", text)
        if not m:
            raise QueryError(f"no such range of versions: {text}")
        op = m.group(1) or "="
        known = [int(p) for p in m.group(2, 3, 4) if p and p.isdigit()]
        low = ".".join(map(str, known + [0] * (3 - len(known)))) + (f"-{m.group(5)}" if m.group(5) else "")
        if op in "^~" or (op == "=" and len(known) < 3):
            i = next((j for j, p in enumerate(known) if p), len(known) - 1) if op == "^" else min(1, len(known) - 1) if op == "~" else len(known) - 1
            high = ".".join(map(str, [*known[:i], known[i] + 1, *[0] * (2 - i)])) + "-0"
            return _compare(v, low) >= 0 and _compare(v, high) < 0
        c = _compare(v, low)
        return {"=": c == 0, ">": c > 0, "<": c < 0, ">=": c >= 0, "<=": c <= 0}[op]

    return any(all(one(p) for p in part.split()) for part in wanted.split("||"))


# Fuzzy matches.


def _scored(measure, descending: bool):
    def run(ev, candidates: Any, query: str) -> list:
        texts = candidates if isinstance(candidates, list) else [candidates]
        out = [{"text": _text(c), "score": measure(_text(c), query)} for c in texts]
        return sorted(out, key=lambda r: -r["score"] if descending else r["score"])

    return run


_match = _scored(fuzzy.jaro_winkler_of, True)


# Checks.


def _check(test, message: str):
    def run(ev, *args):
        if not test(*args):
            raise QueryError(f"{message}: {', '.join(map(_show, args))}")
        return args[0]

    return run


def _unsafe(ev, s: Any) -> str:
    """HTML without scripts, event handlers and script addresses."""
    t = re.sub(r"(?is)<(script|style|iframe|object|embed)\b.*?(</\1\s*>|$)", "", _text(s))
    return re.sub(r"(?i)\s(on\w+|srcdoc)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|javascript:", "", t)


def _front(ev, v: Any) -> Any:
    nodes = v if isinstance(v, list) else [v]
    for n in nodes:
        if isinstance(n, M.Node) and n.kind in ("yaml", "toml"):
            return formats.parse_yaml(n.attributes["value"]) if n.kind == "yaml" else formats.tomllib.loads(n.attributes["value"])
    return None


def _glob(ev, s: Any, pattern: str) -> bool:
    regex = re.escape(pattern).replace(r"\*\*", "\0").replace(r"\*", "[^/]*").replace(r"\?", "[^/]").replace("\0", ".*")
    return bool(re.fullmatch(regex, _text(s)))


def _indices(ev, v: Any, x: Any) -> list:
    if isinstance(v, list):
        return [i for i, y in enumerate(v) if _same(x, y)]
    s, t = _text(v), _text(x)
    return [i for i in range(len(s) - len(t) + 1) if s.startswith(t, i)]


def _each(ev, v: Any, f: Any) -> Any:
    for x in v or []:
        ev.call(f, [x], x)
    return v


def _del_paths(ev, v: Any, paths: list) -> Any:
    return functools.reduce(lambda a, p: _del_path(a, p), sorted(paths, key=lambda p: (len(p), [_key(k) for k in p]), reverse=True), v)


def _sections(ev, nodes: list, f: Any) -> list:
    return [ev.call(f, [s["header"], s["children"]]) for s in NATIVES["section::sections"][2](ev, nodes)]


for names, low, f in [
    ("table::tables", 1, _tables),
    ("table::set_align", 2, lambda ev, t, a: _table_of(t["header"], t["rows"], a)),
    ("table::add_row", 2, _add_row),
    ("table::add_column", 2, _add_column),
    ("table::remove_row", 2, lambda ev, t, i: _with_rows(t, [r for j, r in enumerate(t["rows"]) if j != int(i)])),
    ("table::remove_column", 2, lambda ev, t, i: t | {"rows": [[c for j, c in enumerate(r) if j != int(i)] for r in t["rows"]]}),
    ("table::map_rows", 2, lambda ev, t, f: _with_rows(t, [ev.call(f, [r], r) for r in t["rows"]])),
    ("table::filter_tables", 2, lambda ev, ts, f: [t for t in ts if _true(ev.call(f, [t["header"], t["rows"]]))]),
    ("table::filter_rows", 2, lambda ev, t, f: _with_rows(t, [r for r in t["rows"] if _true(ev.call(f, [r], r))])),
    ("table::to_markdown", 1, lambda ev, t: [*t["header"], t["align"], *[c for r in t["rows"] for c in r]]),
    ("table::to_array", 1, lambda ev, t: _records(t)),
    ("section::map_sections", 2, _sections),
    ("semver::semver_parse", 1, lambda ev, v: _version(v)),
    ("semver::semver_to_string", 1, lambda ev, v: f"{v['major']}.{v['minor']}.{v['patch']}" + (f"-{v['pre']}" if v.get("pre") else "") + (f"+{v['build']}" if v.get("build") else "")),
    ("semver::semver_compare", 2, lambda ev, a, b: _compare(a, b)),
    ("semver::semver_gt", 2, lambda ev, a, b: _compare(a, b) > 0),
    ("semver::semver_lt", 2, lambda ev, a, b: _compare(a, b) < 0),
    ("semver::semver_eq", 2, lambda ev, a, b: _compare(a, b) == 0),
    ("semver::semver_gte", 2, lambda ev, a, b: _compare(a, b) >= 0),
    ("semver::semver_lte", 2, lambda ev, a, b: _compare(a, b) <= 0),
    ("semver::semver_bump_major", 1, _bump(0)),
    ("semver::semver_bump_minor", 1, _bump(1)),
    ("semver::semver_bump_patch", 1, _bump(2)),
    ("semver::semver_sort", 1, lambda ev, v: sorted(v, key=_rank)),
    ("semver::semver_max", 1, lambda ev, v: max(v, key=_rank) if v else None),
    ("semver::semver_min", 1, lambda ev, v: min(v, key=_rank) if v else None),
    ("semver::semver_satisfies", 2, _satisfies),
    ("fuzzy::fuzzy_match", 2, _match),
    ("fuzzy::fuzzy_match_jaro", 2, _scored(fuzzy.jaro_of, True)),
    ("fuzzy::fuzzy_match_levenshtein", 2, _scored(_levenshtein, False)),
    ("fuzzy::fuzzy_filter", 3, lambda ev, c, q, t: [r for r in _match(ev, c, q) if r["score"] >= t]),
    ("fuzzy::fuzzy_best_match", 2, lambda ev, c, q: next(iter(_match(ev, c, q)), None)),
    ("csv::csv_needs_quote", 2, lambda ev, s, d: bool(re.search(r'["\r\n]|' + re.escape(d), _text(s)))),
    ("csv::csv_parse_with_delimiter", 3, lambda ev, s, d, h: formats.parse_csv(_text(s), d, h)),
    ("csv::csv_to_markdown_table json::json_to_markdown_table yaml::yaml_to_markdown_table toml::toml_to_markdown_table xml::xml_to_markdown_table", 1, lambda ev, v: _markdown_table(v)),
    ("csv::csv_to_json yaml::yaml_to_json toml::toml_to_json", 1, lambda ev, v: json.dumps(_plain(v), ensure_ascii=False)),
    ("toml_stringify toml::toml_stringify", 1, lambda ev, v: formats.write_toml(_plain(v))),
    ("xml_stringify xml::xml_stringify", 1, lambda ev, v: formats.write_xml(v)),
    ("toon_parse toon::toon_parse", 1, lambda ev, s: formats.parse_toon(_text(s))),
    ("toon_stringify toon::toon_stringify", 1, lambda ev, v: formats.write_toon(_plain(v))),
    ("cbor_parse cbor::cbor_parse", 1, lambda ev, b: formats.parse_cbor(b if isinstance(b, bytes) else __import__("base64").b64decode(b))),
    ("cbor_stringify cbor::cbor_stringify", 1, lambda ev, v: formats.write_cbor(_plain(v))),
    ("yaml::to_front_matter yaml::to_frontmatter", 1, lambda ev, v: formats.front_matter(_plain(v))),
    ("frontmatter", 1, _front),
    ("glob_match", 2, _glob),
    ("indices", 2, _indices),
    ("each", 2, _each),
    ("tap", 2, lambda ev, v, x: v),
    ("del_paths", 2, _del_paths),
    ("path_join", 2, lambda ev, a, b: b if _text(b).startswith("/") else f"{_text(a).rstrip('/')}/{_text(b)}"),
    ("sanitize_html", 1, _unsafe),
    ("from_html", 1, lambda ev, s: M.parse(html.to_markdown(_text(s)))),
    ("bytes", 1, lambda ev, v: v if isinstance(v, bytes) else None),
    ("encode", 1, lambda ev, s: _text(s).encode()),
    ("decode", 1, lambda ev, b: b.decode()),
    ("print debug stderr", 1, lambda ev, v: v),
    ("intern", 1, lambda ev, v: v),
    ("is_debug_mode", 0, lambda ev: False),
    ("now", 0, lambda ev: int(time.time())),
    ("rand", 0, lambda ev: random.random()),
    ("rand_int", 2, lambda ev, a, b: random.randint(int(a), int(b))),
    ("shuffle", 1, lambda ev, v: random.sample(v, len(v))),
    ("sample", 2, lambda ev, v, n: random.sample(v, min(int(n), len(v)))),
    ("random_string", 1, lambda ev, n: "".join(random.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=int(n)))),
    ("uuid uuid_v4", 0, lambda ev: str(uuid.uuid4())),
    ("assert test::assert test::assert_true", 1, _check(_true, "not true")),
    ("test::assert_false", 1, _check(lambda v: not _true(v), "not false")),
    ("test::assert_eq", 2, _check(_same, "not equal")),
    ("test::assert_ne", 2, _check(lambda a, b: not _same(a, b), "equal")),
    ("test::assert_none", 1, _check(lambda v: v is None, "not None")),
    ("test::assert_not_none", 1, _check(lambda v: v is not None, "None")),
    ("test::assert_contains", 2, _check(lambda v, x: any(_same(x, y) for y in v), "not contained")),
    ("test::assert_len", 2, _check(lambda v, n: len(v) == n, "another length")),
    ("test::assert_empty", 1, _check(lambda v: len(v) == 0, "not empty")),
    ("test::assert_not_empty", 1, _check(lambda v: len(v) > 0, "empty")),
    ("test::assert_type", 2, _check(lambda v, t: _type(v) == t, "another type")),
    ("test::assert_field", 2, _check(lambda v, k: v.get(k) is not None, "no such field")),
    ("test::assert_matches", 2, _check(lambda v, p: bool(re.search(p, _text(v))), "no match")),
    ("is_mdx_flow_expression", 1, _is("mdx_flow_expression")),
    ("is_mdx_js_esm", 1, _is("mdx_js_esm")),
    ("is_mdx_jsx_flow_element", 1, _is("mdx_jsx_flow_element")),
    ("is_mdx_jsx_text_element", 1, _is("mdx_jsx_text_element")),
    ("is_mdx_text_expression", 1, _is("mdx_text_expression")),
    ("is_table_row is_softbreak", 1, lambda ev, v: False),
    ("to_definition md::definition", 2, lambda ev, url, ident: M.Node("definition", [], {"url": url, "ident": ident.lower(), "label": ident, "title": None})),
    ("to_footnote_ref md::footnote_ref", 1, lambda ev, i: M.Node("footnoteref", [], {"ident": i, "label": i})),
    ("to_md_table_cell md::table_cell", 3, lambda ev, v, r, c: _leaf("table_cell", v, row=r, col=c)),
    ("to_md_table_row md::table_row", 1, lambda ev, cells: [_leaf("table_cell", c, row=1, col=i) for i, c in enumerate(cells)]),
    ("to_md_table_align md::table_align", 1, lambda ev, a: M.Node("table_align", [], {"align": list(map(str, a))})),
    ("md::br", 0, lambda ev: M.Node("text", [], {"value": ""})),
    ("set_children", 2, lambda ev, v, c: M.Node(v.kind, c, v.attributes)),
    ("set_ref", 2, lambda ev, v, i: M.Node(v.kind, v.children, v.attributes | {"ident": i.lower(), "label": i})),
]:
    _add(names, low, f)
_add("table::sort_rows", 1, _sort_rows, 2)
_add("table::to_csv", 1, lambda ev, t, d=",": formats.write_csv(_cells(t), d), 2)
_add("table::pivot_longer", 2, _longer, 4)
_add("table::pivot_wider", 3, _wider)
_add("md::table", 2, lambda ev, head, rows, align=None: NATIVES["table::to_markdown"][2](ev, _table_of(head, rows, align)), 3)
_add("md::doc to_md_fragment", 0, lambda ev, *vs: [x for v in vs if v is not None for x in (v if isinstance(v, list) else [v])], 99)
