"""Functions of the language. Each entry: fewest and most arguments, and what it does with the evaluator and the arguments."""

from __future__ import annotations

import base64
import datetime as dt
import functools
import hashlib
import html
import json
import math
import re
import urllib.parse
from collections.abc import Callable
from itertools import groupby
from typing import Any

from nodeloom.functions import dates, formats, fuzzy
from nodeloom.language.grammar import QueryError
from nodeloom.sources import markdown_parser as M

NATIVES: dict[str, tuple[int, int, Callable]] = {}
LAZY: dict[str, Callable] = {}


def _add(names: str, low: int, f: Callable, high: int | None = None) -> None:
    for name in names.split():
        NATIVES[name] = (low, low if high is None else high, f)


def _text(v: Any) -> str:
    from nodeloom.language.evaluate import text

    return text(v)


def _show(v: Any) -> str:
    from nodeloom.language.evaluate import show

    return show(v)


def _true(v: Any) -> bool:
    from nodeloom.language.evaluate import truthy

    return truthy(v)


def _on_text(f: Callable) -> Callable:
    """On texts; a node keeps its kind with a new text, null stays null."""

    def run(ev, v, *args):
        if v is None:
            return None
        if isinstance(v, M.Node):
            new = f(v.plain(), *args)
            return M.Node(v.kind, [M.Node("text", attributes={"value": new})] if v.children else [], v.attributes | ({} if v.children else {"value": new})) if isinstance(new, str) else new
        if not isinstance(v, str):
            raise QueryError(f"not a text: {_show(v)}")
        return f(v, *args)

    return run


def _number(f: Callable) -> Callable:
    def run(ev, *args):
        if all(a is None for a in args):
            return None
        if any(isinstance(a, bool) or not isinstance(a, (int, float)) for a in args):
            raise QueryError("not a number")
        return f(*args)

    return run


def cut(v: Any, begin: int | None, end: int | None) -> Any:
    if v is None:
        return None
    v = v.plain() if isinstance(v, M.Node) else v
    return v[slice(begin, end)]


def _plus(ev, a: Any, b: Any) -> Any:
    if isinstance(a, list):
        return a + (b if isinstance(b, list) else [b])
    if isinstance(a, dict) and isinstance(b, dict):
        return a | b
    if isinstance(a, bytes) and isinstance(b, bytes):
        return a + b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a + b
    if a is None or b is None:
        return b if a is None else a
    return _text(a) + _text(b)


def _times(ev, a: Any, b: Any) -> Any:
    if isinstance(a, (str, list)) and isinstance(b, (int, float)):
        return a * int(b)
    if isinstance(a, list):
        return [x for x in a for _ in range(1)] + [b]
    return None if a is None and b is None else a * b


def _divide(a: float, b: float) -> float:
    if b == 0:
        raise QueryError("division by zero")
    out = a / b
    return int(out) if isinstance(a, int) and isinstance(b, int) and out.is_integer() else out


def _rest(a: float, b: float) -> float:
    """The rest of a division toward zero; a whole one of whole numbers."""
    if b == 0:
        raise QueryError("division by zero")
    out = math.fmod(abs(a), abs(b)) if isinstance(a, float) or isinstance(b, float) else abs(a) % abs(b)
    return -out if a < 0 else out


def _depth(node: M.Node, by: int) -> M.Node:
    if node.kind != "heading":
        return node
    return M.Node(node.kind, node.children, node.attributes | {"depth": min(6, max(1, node.attributes["depth"] + by))}, node.lines)


def _shift_left(ev, a: Any, n: Any) -> Any:
    """Numbers by bits; an array gets a last element, a text loses its first letters, a heading goes up."""
    if isinstance(a, list):
        return [*a, n]
    if a is None or n is None:
        return None
    if isinstance(a, M.Node):
        return _depth(a, -int(n))
    return a[int(n) :] if isinstance(a, str) else _whole(a) << _whole(n)


def _shift_right(ev, a: Any, n: Any) -> Any:
    """Numbers by bits; an array on the right gets a first element, a text loses its last letters, a heading goes down."""
    if isinstance(n, list):
        return [a, *n]
    if a is None or n is None:
        return None
    if isinstance(a, M.Node):
        return _depth(a, int(n))
    return a[: max(0, len(a) - int(n))] if isinstance(a, str) else _whole(a) >> _whole(n)


def _whole(v: Any) -> int:
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise QueryError(f"not a number: {_show(v)}")
    return int(v)


def _same(a: Any, b: Any) -> bool:
    if isinstance(a, bool) is not isinstance(b, bool):
        return False
    if isinstance(a, M.Node) or isinstance(b, M.Node):
        return _text(a) == _text(b) if a is not None and b is not None else False
    return a == b


def _order(f: Callable) -> Callable:
    def run(ev, a, b):
        if isinstance(a, M.Node) or isinstance(b, M.Node):
            a, b = _text(a), _text(b)
        return f(a, b) if type(a) is type(b) or all(isinstance(x, (int, float)) for x in (a, b)) else False

    return run


def _key(v: Any) -> Any:
    return (isinstance(v, str), v) if isinstance(v, (int, float, str)) else (True, _show(v))


def _index(ev, v: Any, x: Any) -> int:
    if v is None:
        return -1
    if isinstance(v, list):
        return next((i for i, y in enumerate(v) if _same(x, y)), -1)
    return _text(v).find(_text(x))


def _contains(ev, v: Any, x: Any) -> bool:
    if isinstance(v, dict):
        return v.get(x) is not None
    return _index(ev, v, x) != -1


def _in(ev, v: Any, x: Any) -> bool:
    if isinstance(v, list):
        return all(any(_same(y, z) for z in v) for y in x) if isinstance(x, list) else any(_same(x, y) for y in v)
    return _contains(ev, v, x)


def _get(ev, v: Any, k: Any) -> Any:
    if isinstance(v, dict):
        return v.get(str(k))
    if isinstance(v, (list, str)):
        k = int(k)
        return v[k] if -len(v) <= k < len(v) else None
    return None


def _set(ev, v: Any, k: Any, new: Any) -> Any:
    if isinstance(v, list):
        out = list(v) + [None] * (int(k) + 1 - len(v))
        out[int(k)] = new
        return out
    return (v or {}) | {str(k): new}


def _del(ev, v: Any, k: Any) -> Any:
    if isinstance(v, dict):
        return {a: b for a, b in v.items() if a != str(k)}
    return [x for i, x in enumerate(v) if i != int(k)] if isinstance(v, list) else v[: int(k)] + v[int(k) + 1 :]


def _size(ev, v: Any) -> int:
    return 0 if v is None else len(v.plain()) if isinstance(v, M.Node) else len(v) if isinstance(v, (str, list, dict, bytes)) else int(v)


def _map(ev, v: Any, f: Any) -> Any:
    if isinstance(v, dict):
        return {str(k): x for k, x in (ev.call(f, [[k, y]]) for k, y in sorted(v.items()))}
    return None if v is None else [ev.call(f, [x], x) for x in v] if isinstance(v, list) else ev.call(f, [v], v)


def _filter(keep: bool) -> Callable:
    def run(ev, v, f):
        if isinstance(v, dict):
            return {k: x for k, x in v.items() if _true(ev.call(f, [[k, x]])) is keep}
        return None if v is None else [x for x in v if x is not None and _true(ev.call(f, [x], x)) is keep]

    return run


def _while(taking: bool) -> Callable:
    def run(ev, v, f):
        stop = next((i for i, x in enumerate(v) if not _true(ev.call(f, [x], x))), len(v))
        return v[:stop] if taking else v[stop:]

    return run


def _groups(ev, v: list, f: Any) -> dict:
    out: dict = {}
    for x in v:
        out.setdefault(_show(ev.call(f, [x], x)), []).append(x)
    return dict(sorted(out.items()))


def _unique(ev, v: list, f: Any = None) -> list:
    seen, out = set(), []
    for x in v:
        k = _show(ev.call(f, [x], x) if f else x) + ("" if f else _type(x))
        if k not in seen:
            seen.add(k)
            out.append(x)
    return out


def _best(largest: bool) -> Callable:
    def run(ev, v, f):
        out = None
        for x in v or []:
            k = ev.call(f, [x], x)
            if out is None or (k > out[0] if largest else k < out[0]):
                out = (k, x)
        return out[1] if out else None

    return run


def _join_by(ev, left, right, lk, rk, kind="inner") -> list:
    if not isinstance(left, list) or not isinstance(right, list):
        raise QueryError("join_by takes two arrays")
    if kind not in ("inner", "left", "right", "full"):
        raise QueryError(f"no kind of join: {kind}")
    by: dict = {}
    for i, r in enumerate(right):
        if r.get(rk) is not None:
            by.setdefault(_show(r[rk]), []).append(i)
    blank_r, blank_l = {k: None for r in right for k in r}, {k: None for x in left for k in x}
    out, used = [], set()
    for x in left:
        found = by.get(_show(x[lk]), []) if x.get(lk) is not None else []
        used.update(found)
        out += [x | right[i] for i in found]
        if not found and kind in ("left", "full"):
            out.append(blank_r | x)
    if kind in ("right", "full"):
        out += [blank_l | r for i, r in enumerate(right) if i not in used]
    return out


def _percentile(ev, v: list, p: float) -> Any:
    if not v:
        return None
    s, rank = sorted(v), p * (len(v) - 1)
    low = math.floor(rank)
    return s[low] + (rank - low) * (s[min(low + 1, len(s) - 1)] - s[low])


def _mean(v: list) -> Any:
    return sum(v) / len(v) if v else None


def _variance(v: list) -> Any:
    return sum((x - _mean(v)) ** 2 for x in v) / len(v) if v else None


def _mode(ev, v: list) -> list:
    n = {_show(x): sum(_same(x, y) for y in v) for x in v}
    return sorted(_unique(ev, [x for x in v if n[_show(x)] == max(n.values())]), key=_key)


def _describe(ev, v: list) -> Any:
    return {"min": min(v), "max": max(v), "mean": _mean(v), "median": _percentile(ev, v, 0.5), "stddev": math.sqrt(_variance(v)), "variance": _variance(v), "count": len(v)} if v else None


def _flatten(v: Any) -> Any:
    """Arrays in an array give their elements; anything else stays."""
    return [y for x in v for y in (x if isinstance(x, list) else [x])] if isinstance(v, list) else v


def _range(ev, a: int, b: int | None = None, step: int | None = None) -> list:
    a, b = (0, a) if b is None else (a, b)
    if isinstance(a, str):
        return [chr(c) for c in range(ord(a), ord(b) + 1)]
    step = step or (1 if b >= a else -1)
    return list(range(int(a), int(b) + (1 if step > 0 else -1), int(step)))


def _path(v: Any, path: list) -> Any:
    for k in path:
        v = _get(None, v, k)
    return v


def _set_path(v: Any, path: list, new: Any) -> Any:
    if not path:
        return new
    v = v if v is not None else [] if isinstance(path[0], int) else {}
    return _set(None, v, path[0], _set_path(_get(None, v, path[0]), path[1:], new))


def _del_path(v: Any, path: list) -> Any:
    if not path:
        return None
    return _del(None, v, path[0]) if len(path) == 1 else _set(None, v, path[0], _del_path(_get(None, v, path[0]), path[1:]))


def _paths(v: Any, at: tuple = ()) -> list:
    if isinstance(v, dict) and v:
        return [p for k, x in sorted(v.items()) for p in _paths(x, (*at, k))]
    if isinstance(v, list) and v:
        return [p for i, x in enumerate(v) for p in _paths(x, (*at, i))]
    return [list(at)]


def _merge(a: Any, b: Any, policy: str = "replace") -> Any:
    out = dict(a)
    for k, x in b.items():
        if k in out and isinstance(out[k], dict) and isinstance(x, dict):
            out[k] = _merge(out[k], x, policy)
        elif k in out and policy == "append":
            out[k] = (out[k] if isinstance(out[k], list) else [out[k]]) + (x if isinstance(x, list) else [x])
        elif k in out and policy == "error":
            raise QueryError(f"both have {k}")
        else:
            out[k] = x
    return out


def _replace_groups(pattern: str, s: str, new: str) -> str:
    return re.sub(pattern, lambda m: re.sub(r"\$(\d+)", lambda g: m.group(int(g.group(1))) or "", new), s)


def _scan(s: str, pattern: str) -> list:
    return [list(m.groups()) if m.groups() else m.group() for m in re.finditer(pattern, s)]


def _capture(s: str, pattern: str) -> dict:
    m = re.search(pattern.replace("(?<", "(?P<"), s)
    return {k: x for k, x in m.groupdict().items()} if m else {}


def _width(c: str) -> int:
    import unicodedata

    return 2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1


def _truncate(s: str, width: int, mark: str = "…") -> str:
    if sum(map(_width, s)) <= width:
        return s
    out, room = "", width - sum(map(_width, mark))
    for c in s:
        room -= _width(c)
        if room < 0:
            break
        out += c
    return out + mark


def _word_wrap(s: str, width: int) -> str:
    lines, line = [], ""
    for word in s.split():
        if line and sum(map(_width, line + " " + word)) > width:
            lines.append(line)
            line = word
        else:
            line = f"{line} {word}" if line else word
    return "\n".join([*lines, line])


def _sized(base: int, units: list[str]) -> Callable:
    def run(ev, n):
        i = 0
        while abs(n) >= base and i < len(units) - 1:
            n, i = n / base, i + 1
        return f"{n:.1f}".removesuffix(".0") + units[i]

    return run


def _convert(ev, v: Any, to: str) -> Any:
    if v is None:
        return None
    t, to = _text(v), str(to)
    leaf = lambda kind, **a: M.Node(kind, [M.Node("text", attributes={"value": t})], a)
    if m := re.fullmatch(r"h([1-6])|(#{1,6})", to):
        return leaf("heading", depth=int(m.group(1)) if m.group(1) else len(m.group(2)))
    if to in (">", "-", "~~", "**", "--"):
        return {">": lambda: leaf("blockquote"), "-": lambda: leaf("list", level=0, ordered=False, checked=None, idx=0), "~~": lambda: leaf("delete"), "**": lambda: leaf("strong"), "--": lambda: M.Node("hr")}[to]()
    if re.match(r"https?://|\.{0,2}/", to):
        return leaf("link", url=to, title=None)
    simple = {"html": lambda: _to_html(v), "text": lambda: t, "sh": lambda: "'" + t.replace("'", "'\\''") + "'", "base64": lambda: base64.b64encode(t.encode()).decode(), "uri": lambda: urllib.parse.quote(t, safe="~"), "urid": lambda: urllib.parse.unquote(t), "md5": lambda: hashlib.md5(t.encode()).hexdigest(), "sha256": lambda: hashlib.sha256(t.encode()).hexdigest()}
    if to not in simple:
        raise QueryError(f"Invalid convert: {to}")
    return simple[to]()


_HTML = {"strong": "strong", "emphasis": "em", "delete": "del", "blockquote": "blockquote", "callout": "blockquote", "list": "li"}


def _to_html(v: Any) -> str:
    """A node as HTML."""
    if not isinstance(v, M.Node):
        return html.escape(_text(v))
    a, inner = v.attributes, "".join(map(_to_html, v.children))
    if v.kind == "heading":
        return f"<h{a['depth']}>{inner}</h{a['depth']}>"
    if v.kind in _HTML:
        return f"<{_HTML[v.kind]}>{inner}</{_HTML[v.kind]}>"
    if v.kind == "link":
        return f'<a href="{html.escape(a["url"])}">{inner}</a>'
    if v.kind == "image":
        return f'<img src="{html.escape(a["url"])}" alt="{html.escape(a["alt"])}" />'
    if v.kind in ("code", "code_inline"):
        code = f"<code{f' class=\"language-{a["lang"]}\"' if a.get('lang') else ''}>{html.escape(a['value'])}</code>"
        return f"<pre>{code}</pre>" if v.kind == "code" else code
    if v.kind in ("hr", "break"):
        return "<hr />" if v.kind == "hr" else "<br />"
    return a["value"] if v.kind == "html" else inner or html.escape(v.plain())


def _node(kind: str, *names: str, child: bool = True) -> Callable:
    def run(ev, v, *args):
        if v is None:
            return None
        given = dict(zip(names, args))
        return M.Node(kind, [M.Node("text", attributes={"value": _text(v)})], given) if child else M.Node(kind, [], {"value": _text(v), **given})

    return run


def _is(*kinds: str) -> Callable:
    return lambda ev, v: isinstance(v, M.Node) and v.kind in kinds


def _level(ev, v: Any, n: int) -> bool:
    if not 1 <= n <= 6:
        raise QueryError("a level is from 1 to 6")
    return isinstance(v, M.Node) and v.kind == "heading" and v.attributes["depth"] == n


def _attr(ev, v: Any, name: str) -> Any:
    from nodeloom.language.nodes import attribute

    return attribute(v, name) if isinstance(v, M.Node) else None


def _set_attr(ev, v: Any, name: str, new: Any) -> Any:
    from nodeloom.language.nodes import with_attribute

    return with_attribute(v, name, new) if isinstance(v, M.Node) else v


def _walk(ev, v: Any, f: Any) -> Any:
    if isinstance(v, list):
        v = [_walk(ev, x, f) for x in v]
    elif isinstance(v, dict):
        v = {k: _walk(ev, x, f) for k, x in v.items()}
    elif isinstance(v, M.Node) and v.children:
        v = M.Node(v.kind, [_walk(ev, c, f) for c in v.children], v.attributes)
    return ev.call(f, [v], v)


def _entries(v: list) -> dict:
    return {str(k): x for k, x in v}


def _time(v: float) -> dt.datetime:
    return dt.datetime.fromtimestamp(v, dt.UTC)


def _from_date(ev, s: str) -> float:
    return int(dt.datetime.fromisoformat(s.replace("Z", "+00:00")).timestamp())


def _gmtime(ev, v: float) -> dict:
    t = _time(v)
    return {"year": t.year, "month": t.month, "day": t.day, "hours": t.hour, "minutes": t.minute, "seconds": t.second, "wday": t.isoweekday() % 7, "yday": t.timetuple().tm_yday}


def _error(ev, message: Any = "") -> None:
    raise QueryError(_show(message))


def _sections(ev, nodes: list, nested: bool = False) -> list:
    heads = [i for i, n in enumerate(nodes) if isinstance(n, M.Node) and n.kind == "heading"]
    out = []
    for i in heads:
        depth = nodes[i].attributes["depth"]
        end = next((j for j in heads if j > i and (not nested or nodes[j].attributes["depth"] <= depth)), len(nodes))
        out.append({"type": "section", "header": nodes[i], "children": nodes[i + 1 : end]})
    return out


def _strict(v: Any, what: str) -> Any:
    if not isinstance(v, list):
        raise QueryError(f"{what} takes an array")
    return v


for names, low, f in [
    ("add", 2, _plus),
    ("sub", 2, _number(lambda a, b: a - b)),
    ("mul", 2, _times),
    ("div", 2, _number(_divide)),
    ("mod", 2, _number(_rest)),
    ("pow", 2, _number(lambda a, b: a**b)),
    ("floordiv", 2, _number(lambda a, b: a // b)),
    ("shift_left", 2, _shift_left),
    ("shift_right", 2, _shift_right),
    ("eq", 2, lambda ev, a, b: _same(a, b)),
    ("ne", 2, lambda ev, a, b: not _same(a, b)),
    ("lt", 2, _order(lambda a, b: a < b)),
    ("lte", 2, _order(lambda a, b: a <= b)),
    ("gt", 2, _order(lambda a, b: a > b)),
    ("gte", 2, _order(lambda a, b: a >= b)),
    ("and", 2, lambda ev, a, b: b if _true(a) and _true(b) else False),
    ("or", 2, lambda ev, a, b: a if _true(a) else b if _true(b) else False),
    ("not", 1, lambda ev, a: not _true(a)),
    ("negate", 1, _number(lambda a: -a)),
    ("default coalesce", 2, lambda ev, a, b: b if a is None else a),
    ("convert", 2, _convert),
    ("abs", 1, _number(abs)),
    ("ceil", 1, _number(math.ceil)),
    ("floor", 1, _number(math.floor)),
    ("round", 1, _number(lambda a: math.floor(abs(a) + 0.5) * (1 if a >= 0 else -1))),
    ("trunc", 1, _number(math.trunc)),
    ("ln", 1, _number(math.log)),
    ("log10", 1, _number(math.log10)),
    ("sqrt", 1, _number(math.sqrt)),
    ("exp", 1, _number(math.exp)),
    ("min", 2, lambda ev, a, b: min(a, b)),
    ("max", 2, lambda ev, a, b: max(a, b)),
    ("nan", 0, lambda ev: math.nan),
    ("infinite", 0, lambda ev: math.inf),
    ("is_nan", 1, lambda ev, a: isinstance(a, float) and math.isnan(a)),
    ("band", 2, _number(lambda a, b: int(a) & int(b))),
    ("bor", 2, _number(lambda a, b: int(a) | int(b))),
    ("xor", 2, _number(lambda a, b: int(a) ^ int(b))),
    ("bnot", 1, _number(lambda a: ~int(a))),
    ("between", 3, lambda ev, v, a, b: a <= v <= b),
    ("downcase ascii_downcase", 1, _on_text(str.lower)),
    ("upcase ascii_upcase", 1, _on_text(str.upper)),
    ("trim", 1, _on_text(str.strip)),
    ("ltrim", 1, _on_text(str.lstrip)),
    ("rtrim", 1, _on_text(str.rstrip)),
    ("ltrimstr", 2, _on_text(lambda s, x: s.removeprefix(x))),
    ("rtrimstr", 2, _on_text(lambda s, x: s.removesuffix(x))),
    ("starts_with", 2, lambda ev, s, x: _text(s).startswith(x) if s is not None else False),
    ("ends_with", 2, lambda ev, s, x: _text(s).endswith(x) if s is not None else False),
    ("index", 2, _index),
    ("rindex", 2, lambda ev, s, x: _text(s).rfind(x) if not isinstance(s, list) else next((i for i in reversed(range(len(s))) if _same(s[i], x)), -1)),
    ("contains", 2, _contains),
    ("replace", 3, _on_text(lambda s, a, b: s.replace(a, b))),
    ("gsub", 3, _on_text(lambda s, p, b: _replace_groups(p, s, b))),
    ("split", 2, _on_text(lambda s, x: s.split(x) if x else list(s))),
    ("join", 2, lambda ev, a, x: x.join(map(_text, a)) if a is not None else None),
    ("explode", 1, _on_text(lambda s: [ord(c) for c in s])),
    ("implode", 1, lambda ev, a: "".join(chr(int(c)) for c in a)),
    ("utf8bytelen", 1, lambda ev, s: len(_text(s).encode())),
    ("len", 1, _size),
    ("slice", 3, lambda ev, v, a, b: cut(v, a, b)),
    ("regex_match", 2, _on_text(lambda s, p: [m.group() for m in re.finditer(p, s)])),
    ("is_regex_match test", 2, lambda ev, s, p: s is not None and bool(re.search(p, _text(s)))),
    ("is_not_regex_match", 2, lambda ev, s, p: s is None or not re.search(p, _text(s))),
    ("capture", 2, _on_text(_capture)),
    ("scan", 2, _on_text(_scan)),
    ("repeat", 2, lambda ev, v, n: v * int(n) if v is not None else None),
    ("word_wrap", 2, _on_text(_word_wrap)),
    ("insert", 3, lambda ev, v, i, x: v[: int(i)] + ([x] if isinstance(v, list) else x) + v[int(i) :]),
    ("slugify", 1, _on_text(lambda s: re.sub("[^a-z0-9]+", "-", s.lower()).strip("-"))),
    ("lines", 1, _on_text(lambda s: s.split("\n"))),
    ("unlines", 1, lambda ev, a: "\n".join(map(_text, a)) if a is not None else None),
    ("token_count", 1, lambda ev, s: len(re.findall(r"\w+|[^\w\s]", _text(s)))),
    ("base64", 1, _on_text(lambda s: base64.b64encode(s.encode()).decode())),
    ("base64d", 1, _on_text(lambda s: base64.b64decode(s).decode())),
    ("base64url", 1, _on_text(lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="))),
    ("base64urld", 1, _on_text(lambda s: base64.urlsafe_b64decode(s + "=" * (-len(s) % 4)).decode())),
    ("url_encode", 1, _on_text(lambda s: urllib.parse.quote(s, safe="~"))),
    ("url_decode", 1, _on_text(urllib.parse.unquote)),
    ("html_escape", 1, _on_text(lambda s: html.escape(s).replace("&#x27;", "&#39;"))),
    ("html_unescape", 1, _on_text(html.unescape)),
    ("strip_tags", 1, _on_text(lambda s: re.sub("<[^>]*>", "", s))),
    ("md5", 1, _on_text(lambda s: hashlib.md5(s.encode()).hexdigest())),
    ("sha256", 1, _on_text(lambda s: hashlib.sha256(s.encode()).hexdigest())),
    ("sha512", 1, _on_text(lambda s: hashlib.sha512(s.encode()).hexdigest())),
    ("to_hex", 1, _on_text(lambda s: s.encode().hex())),
    ("from_hex", 1, _on_text(lambda s: bytes.fromhex(s).decode())),
    ("to_bytes", 1, lambda ev, s: _text(s).encode()),
    ("utf8", 1, lambda ev, b: b.decode()),
    ("reverse", 1, lambda ev, v: v[::-1] if v is not None else None),
    ("sort", 1, lambda ev, v: sorted(_strict(v, "sort"), key=_key)),
    ("sort_by", 2, lambda ev, v, f: sorted(v, key=lambda x: _key(ev.call(f, [x], x)))),
    ("sort_natural", 1, lambda ev, v: sorted(v, key=lambda s: re.sub(r"\d+", lambda m: m.group().rjust(20, "0"), s))),
    ("uniq", 1, _unique),
    ("unique_by", 2, _unique),
    ("compact", 1, lambda ev, v: [x for x in v if x is not None] if v is not None else None),
    ("flatten", 1, lambda ev, v: _flatten(v)),
    ("keys", 1, lambda ev, v: sorted(v) if v is not None else None),
    ("values", 1, lambda ev, v: [v[k] for k in sorted(v)] if v is not None else None),
    ("entries", 1, lambda ev, v: [[k, x] for k, x in sorted(v.items())]),
    ("from_entries", 1, lambda ev, v: _entries(v)),
    ("with_entries", 2, lambda ev, v, f: _entries([ev.call(f, [[k, x]]) for k, x in sorted(v.items())])),
    ("get", 2, _get),
    ("set", 3, _set),
    ("del", 2, _del),
    ("update", 2, lambda ev, a, b: b),
    ("map", 2, _map),
    ("filter", 2, _filter(True)),
    ("reject", 2, _filter(False)),
    ("flat_map", 2, lambda ev, v, f: [y for x in _map(ev, v, f) for y in (x if isinstance(x, list) else [x])] if v is not None else None),
    ("compact_map", 2, lambda ev, v, f: [x for x in _map(ev, v, f) if x is not None]),
    ("first", 1, lambda ev, v: v[0] if v else None),
    ("last", 1, lambda ev, v: v[-1] if v else None),
    ("second", 1, lambda ev, v: v[1] if len(v) > 1 else None),
    ("take", 2, lambda ev, v, n: v[: int(n)]),
    ("skip", 2, lambda ev, v, n: v[int(n) :]),
    ("take_while", 2, _while(True)),
    ("skip_while", 2, _while(False)),
    ("find_index", 2, lambda ev, v, f: next((i for i, x in enumerate(v) if _true(ev.call(f, [x], x))), -1)),
    ("any", 2, lambda ev, v, f: any(_true(ev.call(f, [x], x)) for x in v)),
    ("all", 2, lambda ev, v, f: all(_true(ev.call(f, [x], x)) for x in v)),
    ("in", 2, _in),
    ("count_by", 2, lambda ev, v, f: sum(_true(ev.call(f, [x], x)) for x in v) if isinstance(v, list) else 0),
    ("fold", 3, lambda ev, v, a, f: functools.reduce(lambda x, y: ev.call(f, [x, y]), v, a)),
    ("partition", 2, lambda ev, v, f: [_filter(True)(ev, v, f), _filter(False)(ev, v, f)]),
    ("group_by", 2, _groups),
    ("frequencies_by", 2, lambda ev, v, f: {k: len(x) for k, x in _groups(ev, v, f).items()}),
    ("tally", 1, lambda ev, v: {k: len(x) for k, x in _groups(ev, v, lambda x: x).items()}),
    ("index_by", 2, lambda ev, v, f: {k: functools.reduce(lambda a, b: _plus(ev, a, b), x) for k, x in _groups(ev, v, f).items()}),
    ("chunk_by", 2, lambda ev, v, f: [list(g) for _, g in groupby(v, key=lambda x: _show(ev.call(f, [x], x)))]),
    ("chunks", 2, lambda ev, v, n: [v[i : i + int(n)] for i in range(0, len(v), int(n))]),
    ("ngram", 2, lambda ev, v, n: [v[i : i + int(n)] for i in range(len(v) - int(n) + 1)]),
    ("zip", 2, lambda ev, a, b: [list(x) for x in zip(a, b)]),
    ("transpose", 1, lambda ev, v: [list(x) for x in zip(*v)]),
    ("fill times", 2, lambda ev, v, n: [v] * int(n)),
    ("bsearch", 2, lambda ev, v, x: _index(ev, v, x)),
    ("min_by", 2, _best(False)),
    ("max_by", 2, _best(True)),
    ("pluck", 2, lambda ev, v, k: [x[k] for x in v if x.get(k) is not None]),
    ("get_or", 3, lambda ev, v, k, d: d if v.get(k) is None else v[k]),
    ("pick", 2, lambda ev, v, ks: {k: v[k] for k in sorted(v) if k in ks and v[k] is not None}),
    ("omit", 2, lambda ev, v, ks: {k: x for k, x in v.items() if k not in ks}),
    ("has", 2, lambda ev, v, k: k in v if isinstance(v, dict) else 0 <= k < len(v)),
    ("get_path", 2, lambda ev, v, p: _path(v, p)),
    ("set_path", 3, lambda ev, v, p, x: _set_path(v, p, x)),
    ("del_path", 2, lambda ev, v, p: _del_path(v, p)),
    ("paths", 1, lambda ev, v: _paths(v)),
    ("merge_with", 3, lambda ev, a, b, p: _merge(a, b, p)),
    ("merge_defaults", 2, lambda ev, a, b: _merge(b, a)),
    ("walk", 2, _walk),
    ("sum", 1, lambda ev, v: functools.reduce(lambda a, b: _plus(ev, a, b), v, 0) if not v or not isinstance(v[0], str) else "".join(v)),
    ("sum_by", 2, lambda ev, v, f: sum(ev.call(f, [x], x) for x in v)),
    ("mean", 1, lambda ev, v: _mean(v)),
    ("geomean", 1, lambda ev, v: math.prod(v) ** (1 / len(v)) if v else None),
    ("variance", 1, lambda ev, v: _variance(v)),
    ("stddev", 1, lambda ev, v: math.sqrt(_variance(v)) if v else None),
    ("percentile", 2, _percentile),
    ("mode", 1, _mode),
    ("describe", 1, _describe),
    ("human_bytes", 1, _sized(1000, ["B", "KB", "MB", "GB", "TB", "PB"])),
    ("human_size", 1, _sized(1024, ["B", "KiB", "MiB", "GiB", "TiB", "PiB"])),
    ("to_number", 1, lambda ev, v: float(_text(v)) if v is not None else None),
    ("to_string to_text", 1, lambda ev, v: _text(v)),
    ("to_array", 1, lambda ev, v: v if isinstance(v, list) else list(v) if isinstance(v, str) else [v]),
    ("to_boolean", 1, lambda ev, v: v if isinstance(v, bool) else {"true": True, "false": False}[_text(v)]),
    ("identity", 1, lambda ev, v: v),
    ("inspect", 1, lambda ev, v: v),
    ("is_empty", 1, lambda ev, v: v is None or (len(v) == 0 if isinstance(v, (str, list, dict, bytes)) else False)),
    ("complement", 1, lambda ev, f: lambda *a: not _true(ev.call(f, list(a), a[0] if a else None))),
    ("flip", 3, lambda ev, f, a, b: ev.call(f, [b, a])),
    ("error", 1, _error),
    ("join_by", 4, _join_by),
    ("from_date", 1, _from_date),
    ("to_date", 2, lambda ev, v, p: _time(v).strftime(p)),
    ("strftime", 2, lambda ev, v, p: (_time(v) if not isinstance(v, dict) else _time(_mktime(v))).strftime(p)),
    ("to_date_iso8601", 1, lambda ev, v: _time(v).strftime("%Y-%m-%dT%H:%M:%SZ")),
    ("gmtime localtime", 1, _gmtime),
    ("mktime", 1, lambda ev, v: _mktime(v)),
    ("date_diff", 3, lambda ev, a, b, u: int(((_mktime(b) if isinstance(b, dict) else b) - (_mktime(a) if isinstance(a, dict) else a)) / dates._SECONDS[u])),
    ("basename", 1, _on_text(lambda s: s.rsplit("/", 1)[-1])),
    ("dirname", 1, _on_text(lambda s: s.rpartition("/")[0])),
    ("extname", 1, _on_text(lambda s: "." + s.rsplit("/", 1)[-1].rpartition(".")[2] if "." in s.rsplit("/", 1)[-1][1:] else "")),
    ("stem", 1, _on_text(lambda s: s.rsplit("/", 1)[-1].rsplit(".", 1)[0])),
    ("json_parse json::json_parse", 1, lambda ev, s: json.loads(_text(s))),
    ("json_stringify json::json_stringify", 1, lambda ev, v: json.dumps(_plain(v), ensure_ascii=False)),
    ("yaml_parse yaml::yaml_parse", 1, lambda ev, s: formats.parse_yaml(_text(s))),
    ("yaml_stringify yaml::yaml_stringify", 1, lambda ev, v: formats.write_yaml(_plain(v))),
    ("toml_parse toml::toml_parse", 1, lambda ev, s: formats.tomllib.loads(_text(s))),
    ("xml_parse xml::xml_parse", 1, lambda ev, s: formats.parse_xml(_text(s))),
    ("gron_parse gron::gron_parse", 1, lambda ev, s: formats.parse_gron(_text(s))),
    ("csv_parse csv::csv_parse", 2, lambda ev, s, h: formats.parse_csv(_text(s), ",", h)),
    ("tsv_parse csv::tsv_parse", 2, lambda ev, s, h: formats.parse_csv(_text(s), "\t", h)),
    ("psv_parse csv::psv_parse", 2, lambda ev, s, h: formats.parse_csv(_text(s), "|", h)),
    ("csv_stringify csv::csv_stringify", 2, lambda ev, v, d: formats.write_csv(v, d)),
    ("levenshtein fuzzy::levenshtein", 2, lambda ev, a, b: _levenshtein(a, b)),
    ("jaro fuzzy::jaro", 2, lambda ev, a, b: fuzzy.jaro_of(a, b)),
    ("jaro_winkler fuzzy::jaro_winkler", 2, lambda ev, a, b: fuzzy.jaro_winkler_of(a, b)),
    ("is_h heading::is_h", 1, _is("heading")),
    ("is_h_level", 2, _level),
    ("is_em", 1, _is("emphasis")),
    ("is_strong", 1, _is("strong")),
    ("is_html", 1, _is("html")),
    ("is_yaml", 1, _is("yaml")),
    ("is_toml", 1, _is("toml")),
    ("is_code is_code_block", 1, _is("code")),
    ("is_text is_p", 1, _is("text")),
    ("is_list is_list_item", 1, _is("list")),
    ("is_table_cell", 1, _is("table_cell")),
    ("is_table_align", 1, _is("table_align")),
    ("is_table", 1, _is("table_cell", "table_align")),
    ("is_callout", 1, _is("callout")),
    ("is_link", 1, _is("link", "wikilink")),
    ("is_image", 1, _is("image")),
    ("is_blockquote", 1, _is("blockquote")),
    ("is_hr", 1, _is("hr")),
    ("is_footnote", 1, _is("footnote")),
    ("is_footnote_ref", 1, _is("footnoteref")),
    ("is_math", 1, _is("math")),
    ("is_math_inline", 1, _is("math_inline")),
    ("is_code_inline", 1, _is("code_inline")),
    ("is_strikethrough", 1, _is("delete")),
    ("is_hardbreak", 1, _is("break")),
    ("is_mdx", 1, _is("mdx_flow_expression", "mdx_jsx_flow_element", "mdx_jsx_text_element", "mdx_text_expression", "mdx_js_esm")),
    ("is_task_list_item", 1, lambda ev, v: isinstance(v, M.Node) and v.kind == "list" and v.attributes["checked"] is not None),
    ("attr", 2, _attr),
    ("set_attr", 3, _set_attr),
    ("get_url", 1, lambda ev, v: _attr(ev, v, "url")),
    ("get_title", 1, lambda ev, v: _attr(ev, v, "title")),
    ("matches_url", 2, lambda ev, v, u: _attr(ev, v, "url") == u),
    ("set_check", 2, lambda ev, v, c: _set_attr(ev, v, "checked", c)),
    ("set_list_ordered", 2, lambda ev, v, c: _set_attr(ev, v, "ordered", c)),
    ("set_code_block_lang", 2, lambda ev, v, c: _set_attr(ev, v, "lang", c)),
    ("increase_header_depth demote_heading increase_header_level", 1, lambda ev, v: _depth(v, 1) if isinstance(v, M.Node) else v),
    ("decrease_header_depth promote_heading decrease_header_level", 1, lambda ev, v: _depth(v, -1) if isinstance(v, M.Node) else v),
    ("to_markdown", 1, lambda ev, s: M.parse(_text(s))),
    ("to_mdx", 1, lambda ev, s: M.parse(_text(s), True)),
    ("to_markdown_string", 1, lambda ev, v: M.document(v if isinstance(v, list) else [v])),
    ("to_html", 1, lambda ev, v: "".join(map(_to_html, v)) if isinstance(v, list) else _to_html(v)),
    ("to_md_name", 1, lambda ev, v: M.name_of(v) if isinstance(v, M.Node) else None),
    ("to_h md::h", 2, _node("heading", "depth")),
    ("to_code md::code", 2, lambda ev, v, lang: None if v is None else M.Node("code", [], {"value": _text(v), "lang": lang, "meta": None, "fence": True})),
    ("to_code_inline md::code_inline", 1, _node("code_inline", child=False)),
    ("to_strong md::strong", 1, _node("strong")),
    ("to_em md::em", 1, _node("emphasis")),
    ("to_delete md::delete", 1, _node("delete")),
    ("to_blockquote md::blockquote", 1, _node("blockquote")),
    ("to_math md::math", 1, _node("math", child=False)),
    ("to_math_inline md::math_inline", 1, _node("math_inline", child=False)),
    ("to_md_text md::text", 1, _node("text", child=False)),
    ("to_md_html md::html", 1, _node("html", child=False)),
    ("to_hr md::hr", 0, lambda ev: M.Node("hr")),
    ("to_break md::linebreak", 0, lambda ev: M.Node("break")),
    ("to_link md::link", 3, lambda ev, url, v, t: M.Node("link", [M.Node("text", attributes={"value": _text(v)})], {"url": url, "title": t or None})),
    ("to_image md::image", 3, lambda ev, url, alt, t: M.Node("image", [], {"url": url, "alt": alt, "title": t or None})),
    ("to_footnote md::footnote", 2, _node("footnote", "ident")),
    ("to_callout md::callout", 2, lambda ev, v, k: M.Node("callout", [M.Node("text", attributes={"value": _text(v)})], {"callout": k.upper(), "title": None})),
    ("to_md_list md::list", 2, lambda ev, v, level: M.Node("list", [M.Node("text", attributes={"value": _text(v)})], {"level": level, "ordered": False, "checked": None, "idx": 0})),
    ("section::title", 1, lambda ev, s: s["header"].plain()),
    ("section::level", 1, lambda ev, s: s["header"].attributes["depth"]),
    ("section::body section::content", 1, lambda ev, s: s["children"] if isinstance(s, dict) else []),
    ("section::all_nodes", 1, lambda ev, s: [s["header"], *s["children"]]),
    ("section::titles", 1, lambda ev, v: [s["header"].plain() for s in v]),
    ("section::bodies", 1, lambda ev, v: [s["children"] for s in v]),
    ("section::collect", 1, lambda ev, v: [n for s in v for n in [s["header"], *s["children"]]]),
    ("section::has_content", 1, lambda ev, s: bool(s["children"])),
    ("section::nth", 2, lambda ev, v, n: _get(ev, v, n)),
    ("section::title_contains", 2, lambda ev, v, t: [s for s in v if t in s["header"].plain()]),
    ("section::title_match", 2, lambda ev, v, p: [s for s in v if re.search(p, s["header"].plain())]),
    ("section::by_level", 2, lambda ev, v, n: [s for s in v if s["header"].attributes["depth"] in (n if isinstance(n, list) else [n])]),
    ("section::split", 2, lambda ev, v, n: [s for s in _sections(ev, v, True) if s["header"].attributes["depth"] == n]),
    ("section::filter_sections", 2, lambda ev, v, f: [s for s in _sections(ev, v) if _true(ev.call(f, [s], s))]),
    ("section::toc", 1, lambda ev, v: ["  " * s["header"].attributes["depth"] + "- " + s["header"].plain() for s in v]),
]:
    _add(names, low, f)
_add("range", 1, _range, 3)
_add("truncate", 2, _on_text(_truncate), 3)
_add("lpad", 2, _on_text(lambda s, n, p=" ": p * (n - len(s)) + s), 3)
_add("rpad", 2, _on_text(lambda s, n, p=" ": s + p * (n - len(s))), 3)
_add("join_by", 4, _join_by, 5)
_add("section::sections", 1, _sections, 2)
_add("section::section", 2, lambda ev, v, t, nested=False: [s for s in _sections(ev, v, nested) if t in s["header"].plain()], 3)
_add("date_add", 3, lambda ev, v, n, u: (_mktime(v) if isinstance(v, dict) else v) + n * dates._SECONDS[u])
_add("strptime", 2, lambda ev, s, p: int(dt.datetime.strptime(s, p).replace(tzinfo=dt.UTC).timestamp()))
_add("array", 0, lambda ev, *a: list(a), 99)
_add("dict", 0, lambda ev, *a: _entries(a[0]) if a and isinstance(a[0], list) and a[0] and isinstance(a[0][0], list) else _entries(list(a)), 99)
_add("comp", 1, lambda ev, *fs: lambda x: functools.reduce(lambda v, f: ev.call(f, [v], v), reversed(fs), x), 20)
_add("juxt", 1, lambda ev, *fs: lambda x: [ev.call(f, [x], x) for f in fs], 20)
for i in range(1, 7):
    _add(f"is_h{i}", 1, (lambda n: lambda ev, v: _level(ev, v, n))(i))
for _name, _types in {"is_array": "array", "is_markdown": "markdown", "is_bool": "bool", "is_number": "number", "is_string": "string", "is_none": "None", "is_dict": "dict", "is_bytes": "bytes"}.items():
    _add(_name, 1, (lambda t: lambda ev, v: _type(v) == t)(_types))
for _name, _types in {"arrays": "array", "markdowns": "markdown", "booleans": "bool", "numbers": "number", "strings": "string", "dicts": "dict", "nones": "None", "iterables": "array dict", "scalars": "bool number string None symbol bytes markdown"}.items():
    _add(_name, 1, (lambda t: lambda ev, v: v if _type(v) in t.split() else None)(_types))
_add("type", 1, lambda ev, v: _type(v))


def _type(v: Any) -> str:
    from nodeloom.language.evaluate import kind_of

    return kind_of(v)


def _plain(v: Any) -> Any:
    from nodeloom.language.evaluate import plain

    return plain(v)


def _mktime(v: dict) -> float:
    return int(dt.datetime(v["year"], v["month"], v["day"], v["hours"], v["minutes"], v["seconds"], tzinfo=dt.UTC).timestamp())


def _levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def _select(ev, args, value, scope):
    """Keeps a value for which the condition is true, which is evaluated with the value in the pipe."""
    v = value if len(args) == 1 else ev.eval(args[0], value, scope)
    return v if _true(ev.eval(args[-1], v, scope, piped=True)) else None


def _partial(ev, args, value, scope):
    from nodeloom.language.evaluate import Partial

    f, *given = ev.arguments(args, value, scope)
    return Partial(f, given)


LAZY["select"] = _select
LAZY["partial"] = _partial
