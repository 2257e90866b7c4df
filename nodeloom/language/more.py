"""Functions of the language: budgets, packed numbers, relative dates, CSS, files that the query was given, test runs. Importing it registers them."""

from __future__ import annotations

import base64
import calendar
import datetime as dt
import difflib
import mimetypes
import os
import re
import struct
import time
import uuid
from collections.abc import Callable
from html.parser import HTMLParser
from itertools import groupby
from typing import Any

from nodeloom.functions import formats
from nodeloom.language.builtins import LAZY, NATIVES, _add, _show, _text
from nodeloom.language.grammar import QueryError
from nodeloom.sources import markdown_parser as M

# A budget of tokens.

_SENTENCE = re.compile(r".*?(?:[。！？]|[.!?](?=\s|$))", re.S)
_MARKERS = frozenset("heading list code table_cell table_align blockquote callout hr".split())


def _note(text: str) -> M.Node:
    return M.Node("text", attributes={"value": text})


def _compress(ev, nodes: list, budget: float, count: Any = None) -> list:
    """Nodes within a budget of tokens: first sentences for paragraphs, the longest first; then shorter lists, tables and code; then the middle goes."""
    counter: Callable[[Any], int] = lambda v: NATIVES["token_count"][2](ev, v)
    total = lambda some: sum(counter(_text(n)) for n in some)
    nodes, budget = list(nodes), int(budget)
    if total(nodes) <= budget:
        return nodes
    runs = [list(g) for _, g in groupby(nodes, key=lambda n: "block" if n.kind in _MARKERS else "run")]
    order = sorted((i for i, r in enumerate(runs) if r[0].kind not in _MARKERS), key=lambda i: -total(runs[i]))
    left = total(nodes)
    for i in order:
        if left <= budget:
            break
        text = "".join(map(_show, runs[i])).strip()
        first = _SENTENCE.match(text)
        if first and len(first.group()) < len(text) and (saved := total(runs[i]) - counter(first.group())) > 0:
            runs[i], left = [_note(first.group())], left - saved
    nodes = [n for r in runs for n in r]
    for kinds, what in ((("list",), "list items"), (("table_cell", "table_align"), "table rows")):
        if total(nodes) > budget:
            nodes = _capped(nodes, kinds, what, budget, total)
    if total(nodes) > budget:
        nodes = [M.Node("code", attributes=n.attributes | {"value": f"... ({n.attributes['value'].count(chr(10)) + 1} lines)"}) if n.kind == "code" else n for n in nodes]
    if total(nodes) > budget:
        nodes = [_note(_ends_of(M.document(nodes), budget, counter))]
    return nodes


def _capped(nodes: list, kinds: tuple[str, ...], what: str, budget: int, total: Callable) -> list:
    """Each run of these kinds cut to what fits after the nodes before it, with a note of how much is left out."""
    out: list = []
    for hit, group in groupby(nodes, key=lambda n: n.kind in kinds):
        some = list(group)
        if not hit:
            out += some
            continue
        units = [list(g) for _, g in groupby(some, key=lambda n: n.attributes.get("row", -1) if n.kind == "table_cell" else 0 if n.kind == "table_align" else id(n))]
        keep = next((k for k in range(len(units), 0, -1) if total(out) + sum(map(total, units[:k])) + (4 if k < len(units) else 0) <= budget), 1 if what == "table rows" else 0)
        out += [n for u in units[:keep] for n in u]
        if keep < len(units):
            out.append(_note(f"... ({len(units) - keep} more {what})"))
    return out


def _ends_of(text: str, budget: int, counter: Callable) -> str:
    """Beginning and end of a text, three parts to one."""
    words = text.split(" ")
    low, high = 0, len(words)
    shown = lambda n: " ".join(words[: n - n // 4]) + "\n\n...\n\n" + " ".join(words[len(words) - n // 4 :])
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if counter(shown(mid)) <= budget else (low, mid - 1)
    return shown(low)


# Packed numbers. The formats' names.

_PACKED = {"i8": "b", "u8": "B", **{f"{kind}{bits}{order}": mark + code for bits, codes in ((16, "hH"), (32, "iIf"), (64, "qQd")) for kind, code in zip("iuf", codes) for order, mark in (("le", "<"), ("be", ">"))}}


def _pack(ev, kind: str, v: Any) -> Any:
    if v is None:
        return None
    code = _packing(kind)
    if code[-1] in "fd":
        return struct.pack(code, float(v))
    bits = 8 * struct.calcsize(code)
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if code[-1].islower() else (0, (1 << bits) - 1)
    return struct.pack(code, min(max(int(v), low), high))


def _unpack(ev, kind: str, v: Any) -> Any:
    if v is None:
        return None
    code = _packing(kind)
    if len(v) < struct.calcsize(code):
        raise QueryError(f"{kind} takes {struct.calcsize(code)} bytes, not {len(v)}")
    return struct.unpack_from(code, v)[0]


def _packing(kind: str) -> str:
    if kind not in _PACKED:
        raise QueryError(f"no format {kind}")
    return _PACKED[kind]


# Dates.

_DAYS = [d.lower() for d in calendar.day_name]


def _moved(t: dt.datetime, n: int, unit: str) -> dt.datetime:
    unit = unit.removesuffix("s")
    if unit in ("month", "year"):
        months = t.year * 12 + t.month - 1 + n * (12 if unit == "year" else 1)
        year, month = divmod(months, 12)
        return t.replace(year=year, month=month + 1, day=min(t.day, calendar.monthrange(year, month + 1)[1]))
    if unit not in ("second", "minute", "hour", "day", "week"):
        raise QueryError(f"no unit {unit}")
    return t + dt.timedelta(**{unit + "s": n})


def _relative(ev, text: str, base: float | None = None) -> int:
    """Seconds of a date told from another one: now, yesterday, ``3 days ago``, ``in 2 weeks``, ``next monday``, ``last friday``."""
    t, words = dt.datetime.fromtimestamp(time.time() if base is None else base, dt.UTC), text.strip().lower().split()
    if words in (["now"], ["today"]):
        out = t
    elif words in (["yesterday"], ["tomorrow"]):
        out = t + dt.timedelta(days=1 if words == ["tomorrow"] else -1)
    elif len(words) == 3 and words[2] == "ago" and re.fullmatch(r"-?\d+", words[0]):
        out = _moved(t, -int(words[0]), words[1])
    elif len(words) == 3 and words[0] == "in" and re.fullmatch(r"-?\d+", words[1]):
        out = _moved(t, int(words[1]), words[2])
    elif len(words) == 2 and words[0] in ("next", "last") and words[1] in _DAYS:
        ahead = (_DAYS.index(words[1]) - t.weekday()) % 7 or 7
        out = t + dt.timedelta(days=ahead if words[0] == "next" else ahead - 7 if ahead < 7 else -7)
    else:
        raise QueryError(f"no date: {text}")
    return int(out.timestamp())


def _uuid_v7(ev) -> str:
    number = int(time.time() * 1000) << 80 | int.from_bytes(os.urandom(10), "big")
    return str(uuid.UUID(int=number & ~(0xF << 76) & ~(0x3 << 62) | 7 << 76 | 2 << 62))


# CSS.

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Element:
    def __init__(self, tag: str, attributes: dict[str, str | None], above: _Element | None):
        self.tag, self.attributes, self.above = tag, attributes, above
        self.children: list[_Element | str] = []


class _Page(HTMLParser):
    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.all: list[_Element] = []
        self.stack = [_Element("", {}, None)]
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        e = _Element(tag, dict(attrs), self.stack[-1])
        self.stack[-1].children.append(e)
        self.all.append(e)
        if tag not in _VOID:
            self.stack.append(e)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].tag == tag), None)
        if at:
            del self.stack[at:]

    def handle_data(self, data):
        self.stack[-1].children.append(data)


_SIMPLE = re.compile(r"(?P<tag>[a-zA-Z][\w-]*|\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<name>[\w:-]+)(?:(?P<op>[~|^$*]?=)[\"']?(?P<value>[^\"'\]]*)[\"']?)?\]|:(?P<pseudo>first-child|last-child|nth-child\((?P<n>\d+)\))")


def _is_one(e: _Element, simple: str) -> bool:
    at = 0
    while at < len(simple):
        m = _SIMPLE.match(simple, at)
        if not m:
            raise QueryError(f"no CSS selector: {simple}")
        at = m.end()
        own = e.attributes.get(m.group("name")) if m.group("name") else None
        if m.group("tag"):
            ok = m.group("tag") in ("*", e.tag)
        elif m.group("id"):
            ok = e.attributes.get("id") == m.group("id")
        elif m.group("cls"):
            ok = m.group("cls") in (e.attributes.get("class") or "").split()
        elif m.group("name"):
            own, value = own or "", m.group("value") or ""
            tests = {None: True, "=": own == value, "~=": value in own.split(), "|=": own == value or own.startswith(value + "-"), "^=": own.startswith(value), "$=": own.endswith(value), "*=": value in own}
            ok = m.group("name") in e.attributes and tests[m.group("op")]
        else:
            beside = [c for c in e.above.children if isinstance(c, _Element)] if e.above else [e]
            place = beside.index(e)
            ok = place == {"first-child": 0, "last-child": len(beside) - 1}.get(m.group("pseudo"), int(m.group("n") or 0) - 1)
        if not ok:
            return False
    return True


def _hits(e: _Element, steps: list[str]) -> bool:
    """Whether an element ends a path of simple selectors with the combinators space, >, + and ~ between them."""
    if not _is_one(e, steps[-1]):
        return False
    if len(steps) == 1:
        return True
    rest, how = steps[:-2], steps[-2]
    if how in ("+", "~"):
        beside = [c for c in e.above.children if isinstance(c, _Element)] if e.above else []
        before = beside[: beside.index(e)] if e in beside else []
        return any(_hits(x, rest) for x in (before[-1:] if how == "+" else before))
    above = e.above
    while above is not None and above.tag:
        if _hits(above, rest):
            return True
        above = above.above if how == " " else None
    return False


def _css(text: Any, selector: str) -> list[_Element]:
    paths = []
    for one in selector.split(","):
        parts = re.findall(r"[>+~]|(?:\[[^\]]*\]|[^\s>+~\[])+", one)
        steps: list[str] = []
        for p in parts:
            if p in (">", "+", "~"):
                steps.append(p)
            else:
                steps += [" ", p] if steps and steps[-1] not in (">", "+", "~") else [p]
        if not steps or steps[-1] in (">", "+", "~") or len(steps) % 2 == 0:
            raise QueryError(f"no CSS selector: {selector}")
        paths.append(steps)
    return [e for e in _Page(_text(text)).all if any(_hits(e, p) for p in paths)]


def _inner(e: _Element) -> str:
    out, stack = [], [e]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack += reversed(x.children)
    return "".join(out)


def _outer(e: _Element) -> str:
    import html

    out: list[str] = []
    stack: list[_Element | str] = [e]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        attributes = "".join(f' {k}="{html.escape(v or "")}"' for k, v in x.attributes.items())
        out.append(f"<{x.tag}{attributes}>")
        if x.tag not in _VOID:
            stack.append(f"</{x.tag}>")
            stack += [html.escape(c, quote=False) if isinstance(c, str) else c for c in reversed(x.children)]
    return "".join(out)


# Files: only those that the query was given.


def _file(ev, path: str) -> bytes:
    if path not in ev.files:
        raise QueryError(f"no file {path} was given")
    return ev.files[path]


def _collection(ev, folder: str, hidden: bool = False) -> list:
    """Path, title, front matter and content of each Markdown file of a folder, by path."""
    out = []
    for path in sorted(p for p in ev.files if p.startswith(folder.rstrip("/") + "/") or folder in ("", ".")):
        if not path.endswith((".md", ".markdown", ".mdx")) or (not hidden and any(x.startswith(".") for x in path.split("/"))):
            continue
        nodes = M.parse(ev.files[path].decode("utf-8", "replace"))
        head = next((n for n in nodes if n.kind in ("yaml", "toml")), None)
        matter = None if head is None else formats.parse_yaml(head.attributes["value"]) if head.kind == "yaml" else formats.tomllib.loads(head.attributes["value"])
        title = next((n.plain() for n in nodes if n.kind == "heading"), None)
        out.append({"path": path, "title": title, "frontmatter": matter, "content": ev.files[path].decode("utf-8", "replace")})
    return out


def _images(ev, v: Any, change: Callable) -> Any:
    if isinstance(v, list):
        return [_images(ev, x, change) for x in v]
    if not isinstance(v, M.Node):
        return v
    if v.kind == "image":
        return M.Node("image", [], v.attributes | {"url": change(v.attributes["url"])}, v.lines)
    return M.Node(v.kind, [_images(ev, c, change) for c in v.children], v.attributes, v.lines) if v.children else v


def _embedded(ev, v: Any) -> Any:
    """Images whose files were given hold them as data addresses."""

    def change(url: str) -> str:
        data = ev.files.get(url)
        return url if data is None else f"data:{mimetypes.guess_type(url)[0] or 'application/octet-stream'};base64,{base64.b64encode(data).decode()}"

    return _images(ev, v, change)


def _extracted(ev, v: Any) -> list:
    """Name, type and bytes of each image that a data address holds."""
    from nodeloom.language.evaluate import descendants

    out = []
    for n in descendants(v):
        m = re.match(r"data:([^;,]*);base64,(.*)", n.attributes["url"], re.S) if isinstance(n, M.Node) and n.kind == "image" else None
        if m:
            kind = mimetypes.guess_extension(m.group(1)) or ".bin"
            out.append({"name": f"image{len(out) + 1}{kind}", "type": m.group(1), "bytes": base64.b64decode(m.group(2))})
    return out


# Test runs.


def _run_one(ev, name: str, f: Any) -> dict:
    began = time.monotonic()
    try:
        ev.call(f, [])
        error = None
    except (QueryError, ArithmeticError, TypeError, ValueError, LookupError) as failed:
        error = str(failed)
    return {"name": name, "status": "failed" if error else "passed", "duration": (time.monotonic() - began) * 1000, "error": error}


def _run_tests(ev, tests: list) -> bool:
    if not all(isinstance(t, dict) and "name" in t and "func" in t for t in tests):
        raise QueryError("a test is a map with name and func")
    return all([_run_one(ev, t["name"], t["func"])["status"] == "passed" for t in tests])


def _duration(ev, ms: float) -> str:
    return f"{ms / 1000:.2f}s" if ms >= 1000 else f"{ms:.0f}ms" if ms >= 1 else f"{ms * 1000:.0f}us"


def _difference(ev, a: Any, b: Any) -> list:
    """Lines that only one of two values has, in order."""
    marks = {"- ": "delete", "+ ": "insert", "  ": "equal"}
    return [{"tag": marks[x[:2]], "value": x[2:]} for x in difflib.ndiff(_show(a).split("\n"), _show(b).split("\n")) if x[:2] in marks]


def _location(ev, v: Any) -> Any:
    if not isinstance(v, M.Node) or not v.lines:
        return None
    return {"start_line": v.lines[0], "start_column": 1, "end_line": v.lines[1], "end_column": len(M.render(v).split("\n")[-1]) + 1}


def _halt(ev, *args: Any) -> None:
    from nodeloom.language.evaluate import Halt

    raise Halt


def _halt_error(ev, v: Any = None) -> None:
    raise QueryError(f"halted: {_show(v)}")


def _get_variable(ev, args, value, scope):
    from nodeloom.language.evaluate import _MISSING

    name = _text(ev.eval(args[0], value, scope))
    found = scope.find(name)
    if found is _MISSING:
        raise QueryError(f"no variable {name}")
    return found


def _set_variable(ev, args, value, scope):
    """Sets a variable of the query, and gives what is in the pipe."""
    name, new = (ev.eval(a, value, scope) for a in args)
    try:
        scope.put(_text(name), new)
    except QueryError:
        ev.top.names[_text(name)] = new
    return value


def _all_symbols(ev, args, value, scope):
    from nodeloom.language.evaluate import Symbol

    names, here = set(ev.natives) | set(ev.lazy), scope
    while here:
        names |= set(here.names)
        here = here.above
    return [Symbol(n) for n in sorted(names)]


for names, low, f, high in [
    ("token_compress", 2, _compress, 3),
    ("pack", 2, _pack, 2),
    ("unpack", 2, _unpack, 2),
    ("date_relative", 1, _relative, 2),
    ("uuid_v7", 0, _uuid_v7, 0),
    ("css", 2, lambda ev, s, q: [_outer(e) for e in _css(s, q)], 2),
    ("css_text", 2, lambda ev, s, q: [_inner(e) for e in _css(s, q)], 2),
    ("css_attr", 3, lambda ev, s, q, a: [e.attributes.get(a) for e in _css(s, q)], 3),
    ("read_file", 1, lambda ev, p: _file(ev, p).decode("utf-8", "replace"), 1),
    ("read_file_bytes", 1, _file, 1),
    ("file_exists", 1, lambda ev, p: p in ev.files, 1),
    ("file_size", 1, lambda ev, p: len(_file(ev, p)), 1),
    ("load_markdown", 1, lambda ev, p: M.parse(_file(ev, p).decode("utf-8", "replace")), 1),
    ("collection", 1, _collection, 2),
    ("embed_images", 1, _embedded, 1),
    ("extract_images", 1, _extracted, 1),
    ("get_location _get_markdown_position", 1, _location, 1),
    ("halt", 0, _halt, 1),
    ("halt_error", 0, _halt_error, 1),
    ("input", 0, lambda ev: None, 0),
    ("breakpoint", 0, lambda ev: None, 0),
    ("_diff", 2, _difference, 2),
    ("test::test_case", 2, lambda ev, name, f: {"name": name, "func": f}, 2),
    ("test::run_tests", 1, _run_tests, 1),
    ("test::_run_test", 2, _run_one, 2),
    ("test::_format_duration", 1, _duration, 1),
]:
    _add(names, low, f, high)
LAZY |= {"get_variable": _get_variable, "set_variable": _set_variable, "all_symbols": _all_symbols}
