"""Markdown to nodes, without Spark: blocks first, then what is inline in them.

The dialect is GitHub's, with front matter, math, footnotes, callouts, wiki links and embeds, and MDX on demand. Paragraphs are
no nodes of their own: what is inline in them stands in the list of blocks. Each list item is a node, those of inner lists
follow it one level deeper; each table cell is a node, and the row of alignments follows the first row.

Nodes lie at most NEST deep in quotes, items and footnotes, and inline ones NEST deep in each other: what a text opens beyond that
is plain text, so that no text can exhaust the stack.
"""

from __future__ import annotations

import html
import re
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from typing import Any


#: How deep nodes can lie in each other.
NEST = 48
#: So many nodes at the top, or a few more, are held at once by what reads a document bit by bit.
HELD = 1024


@dataclass
class Node:
    kind: str
    children: list[Node] = field(default_factory=list)
    attributes: dict[str, Any] = field(default_factory=dict)
    #: First and last line of a top-level block, from 1.
    lines: tuple[int, int] | None = field(default=None, compare=False)
    height: int = field(default=0, compare=False)

    def plain(self) -> str:
        """The text of the node and all in it."""
        if self.children:
            return "".join(c.plain() for c in self.children)
        return self.attributes.get("value") or self.attributes.get("alt") or ""


_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^`]*?)[ \t]*$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*)|[ \t]*)$")
_TASK = re.compile(r"\[([ xX])\][ \t]+")
_DEFINITION = re.compile(r" {0,3}\[([^\]^][^\]]*)\]:[ \t]*<?(\S+?)>?(?:[ \t]+(?:\"([^\"]*)\"|'([^']*)'|\(([^)]*)\)))?[ \t]*$")
_FOOTNOTE = re.compile(r" {0,3}\[\^([^\]]+)\]:[ \t]*(.*)$")
_CALLOUT = re.compile(r"\[!(\w+)\][ \t]*(.*)$")
_DELIMITER = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML_BLOCK = re.compile(r" {0,3}<(?:/?(?:address|article|aside|base|blockquote|body|caption|center|col|details|dialog|dd|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|optgroup|option|p|param|script|pre|style|section|summary|table|tbody|td|textarea|tfoot|th|thead|title|tr|track|ul)(?:[\s/>]|$)|!--|\?|![A-Z])", re.I)
_ESM = re.compile(r"(?:import|export)\s")
_JSX = re.compile(r"<([A-Z][\w.]*)((?:[^>\"'{}]|\"[^\"]*\"|'[^']*'|\{[^}]*\})*?)(/?)>")


def parse(text: str, mdx: bool = False) -> list[Node]:
    """The top-level nodes of a document."""
    out, lines, first = _front(text)
    return out + _blocks(lines, mdx, 0, first=first)


def stream(text: str, mdx: bool = False) -> Iterator[list[Node]]:
    """The top-level nodes of a document a few at a time, without their lines: no table or list is held as a whole."""
    out, lines, _ = _front(text)
    for _ in _steps(lines, out, mdx, 0):
        if len(out) >= HELD:
            yield out[:]
            out.clear()
    yield out


def _front(text: str) -> tuple[list[Node], list[str], int]:
    """Front matter, the lines behind it and the number of the first of them."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    for mark, kind in (("---", "yaml"), ("+++", "toml")):
        if lines[0].rstrip() == mark and (end := next((i for i in range(1, len(lines)) if lines[i].rstrip() == mark), 0)):
            return [Node(kind, attributes={"value": "\n".join(lines[1:end])}, lines=(1, end + 1))], lines[end + 1 :], end + 2
    return [], lines, 1


def _blocks(lines: list[str], mdx: bool, nest: int, level: int = 0, first: int = 0) -> list[Node]:
    """The nodes of some lines; with ``first``, the number of the first of them, nodes know their lines."""
    out: list[Node] = []
    for _ in _steps(lines, out, mdx, nest, level, first):
        pass
    return out


def _steps(lines: list[str], out: list[Node], mdx: bool, nest: int, level: int = 0, first: int = 0) -> Iterator[None]:
    """Adds the nodes of some lines to ``out``; at each step its reader may take away what is there, without ``first``."""
    held: list[str] = []
    deep = nest >= NEST

    def paragraph() -> None:
        if held:
            some = inline("\n".join(x.lstrip() for x in held).rstrip(), mdx)
            for node in some if first else []:
                node.lines = (first + i - len(held), first + i - 1)
            out.extend(some)
            held.clear()

    i = began = 0
    while i < len(lines):
        yield
        for node in reversed(out if first else []):
            if node.lines:
                break
            node.lines = (first + began, first + i - 1)
        began = i
        line = lines[i]
        if not line.strip():
            paragraph()
            i += 1
            continue
        if held and (m := re.match(r" {0,3}(=+|-+)[ \t]*$", line)):
            node = Node("heading", inline("\n".join(x.strip() for x in held), mdx), {"depth": 1 if m.group(1)[0] == "=" else 2})
            began -= len(held)
            held.clear()
            out.append(node)
            i += 1
        elif m := _FENCE.match(line):
            paragraph()
            indent, mark, info = m.groups()
            end = i + 1
            while end < len(lines) and not re.match(rf" {{0,3}}{mark[0]}{{{len(mark)},}}[ \t]*$", lines[end]):
                end += 1
            body = [re.sub(rf"^ {{0,{len(indent)}}}", "", x) for x in lines[i + 1 : end]]
            lang, _, meta = info.partition(" ")
            out.append(Node("code", attributes={"value": "\n".join(body), "lang": lang or None, "meta": meta.strip() or None, "fence": True}))
            i = end + 1
        elif line.strip() == "$$":
            paragraph()
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip() == "$$"), len(lines))
            out.append(Node("math", attributes={"value": "\n".join(lines[i + 1 : end])}))
            i = end + 1
        elif m := _HEADING.match(line):
            paragraph()
            out.append(Node("heading", inline(m.group(2) or "", mdx), {"depth": len(m.group(1))}))
            i += 1
        elif _RULE.match(line):
            paragraph()
            out.append(Node("hr"))
            i += 1
        elif not deep and re.match(r" {0,3}>", line):
            paragraph()
            end, inner = i, []
            while end < len(lines) and lines[end].strip() and (re.match(r" {0,3}>", lines[end]) or not _starts(lines[end], mdx)):
                inner.append(re.sub(r"^ {0,3}> ?", "", lines[end]))
                end += 1
            if inner and (m := _CALLOUT.match(inner[0])):
                out.append(Node("callout", _blocks(inner[1:], mdx, nest + 1), {"callout": m.group(1).upper(), "title": m.group(2).strip() or None}))
            else:
                out.append(Node("blockquote", _blocks(inner, mdx, nest + 1)))
            i = end
        elif not deep and (m := _ITEM.match(line)) and not (held and (not m.group(4) or m.group(2)[0].isdigit() and m.group(2)[:-1] != "1")):
            paragraph()
            i = yield from _list(lines, i, out, mdx, level, nest, first)
        elif not deep and (m := _FOOTNOTE.match(line)):
            paragraph()
            end = i + 1
            while end < len(lines) and (re.match(r"(?: {4}|\t)\S", lines[end]) or not lines[end].strip() and end + 1 < len(lines) and re.match(r" {4}|\t", lines[end + 1])):
                end += 1
            out.append(Node("footnote", _blocks([m.group(2), *(x.strip() for x in lines[i + 1 : end])], mdx, nest + 1), {"ident": m.group(1)}))
            i = end
        elif not held and (m := _DEFINITION.match(line)):
            out.append(Node("definition", attributes={"ident": m.group(1).lower(), "label": m.group(1), "url": m.group(2), "title": m.group(3) or m.group(4) or m.group(5)}))
            i += 1
        elif not held and re.match(r"(?: {4}|\t)", line):
            end = i
            while end < len(lines) and (not lines[end].strip() or re.match(r"(?: {4}|\t)", lines[end])):
                end += 1
            body = "\n".join(re.sub(r"^(?: {4}|\t)", "", x) for x in lines[i:end]).rstrip()
            out.append(Node("code", attributes={"value": body, "lang": None, "meta": None, "fence": False}))
            i = end
        elif mdx and not held and _ESM.match(line):
            end = i
            while end < len(lines) and lines[end].strip():
                end += 1
            out.append(Node("mdx_js_esm", attributes={"value": "\n".join(lines[i:end])}))
            i = end
        elif mdx and not held and re.match(r"\{.*\}[ \t]*$", line):
            out.append(Node("mdx_flow_expression", attributes={"value": line.strip()[1:-1]}))
            i += 1
        elif mdx and not held and not deep and (m := _JSX.match(line)):
            name, close = m.group(1), f"</{m.group(1)}>"
            if m.group(3):
                out.append(Node("mdx_jsx_flow_element", attributes={"name": name}))
                i += 1
            else:
                end = next((j for j in range(i, len(lines)) if close in lines[j]), len(lines) - 1)
                body = "\n".join(lines[i : end + 1])[m.end() :].split(close)[0]
                out.append(Node("mdx_jsx_flow_element", _blocks(body.split("\n"), mdx, nest + 1), {"name": name}))
                i = end + 1
        elif not held and not mdx and _HTML_BLOCK.match(line):
            end = i
            while end < len(lines) and lines[end].strip():
                end += 1
            out.append(Node("html", attributes={"value": "\n".join(lines[i:end])}))
            i = end
        elif not held and "|" in line and i + 1 < len(lines) and _DELIMITER.match(lines[i + 1]) and "-" in lines[i + 1] and len(_cells(line)) == len(_cells(lines[i + 1])):
            i = yield from _table(lines, i, out, mdx)
        else:
            held.append(line)
            i += 1
    paragraph()
    for node in out if first else []:
        node.lines = node.lines or (first + began, first + i - 1)


def _starts(line: str, mdx: bool) -> bool:
    """Whether a line ends a paragraph by what it begins."""
    return bool(_HEADING.match(line) or _FENCE.match(line) or _RULE.match(line) or _ITEM.match(line))


def _list(lines: list[str], i: int, out: list[Node], mdx: bool, level: int, nest: int, first: int) -> Generator[None, None, int]:
    """Items of one list, and after each the items of the lists in it; returns the line behind it."""
    ordered, mark = None, ""
    index = 0
    while i < len(lines):
        yield
        m = _ITEM.match(lines[i])
        if not m or _RULE.match(lines[i]):
            break
        if ordered is None:
            ordered, mark = m.group(2)[0].isdigit(), m.group(2)[-1]
        elif (m.group(2)[0].isdigit(), m.group(2)[-1]) != (ordered, mark):
            break
        width = len(m.group(1)) + len(m.group(2)) + min(len(m.group(3) or " "), 4)
        start, body, i = i, [m.group(4) or ""], i + 1
        while i < len(lines):
            if not lines[i].strip():
                ahead = next((lines[j] for j in range(i + 1, len(lines)) if lines[j].strip()), "")
                if len(ahead) - len(ahead.lstrip()) < width:
                    break
                body.append("")
            elif len(lines[i]) - len(lines[i].lstrip(" ")) >= width:
                body.append(lines[i][width:])
            elif _starts(lines[i], mdx) or re.match(r" {0,3}>", lines[i]):
                break
            else:
                body.append(lines[i].strip())
            i += 1
        checked = None
        if t := _TASK.match(body[0]):
            checked, body[0] = t.group(1) != " ", body[0][t.end() :]
        inner = _blocks(body, mdx, nest + 1, level + 1)
        own = [n for n in inner if n.kind != "list"]
        out.append(Node("list", own, {"level": level, "ordered": ordered, "checked": checked, "idx": index}, (first + start, first + i - 1) if first else None))
        out.extend(n for n in inner if n.kind == "list")
        index += 1
        while i < len(lines) and not lines[i].strip():
            ahead = next((j for j in range(i, len(lines)) if lines[j].strip()), len(lines))
            if ahead < len(lines) and _ITEM.match(lines[ahead]):
                i = ahead
            else:
                return i
    return i


def _cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", line)]


def _table(lines: list[str], i: int, out: list[Node], mdx: bool) -> Generator[None, None, int]:
    head, marks = _cells(lines[i]), _cells(lines[i + 1])
    align = [{(True, True): "center", (True, False): "left", (False, True): "right"}.get((m.startswith(":"), m.endswith(":")), "none") for m in marks]
    out.extend(Node("table_cell", inline(c, mdx), {"row": 0, "col": k}) for k, c in enumerate(head))
    out.append(Node("table_align", attributes={"align": align}))
    end = i + 2
    while end < len(lines) and lines[end].strip() and not (_HEADING.match(lines[end]) or _FENCE.match(lines[end]) or _RULE.match(lines[end]) or re.match(r" {0,3}>", lines[end])):
        yield
        cells = _cells(lines[end])
        out.extend(Node("table_cell", inline(c, mdx), {"row": end - i - 1, "col": k}) for k, c in enumerate((cells + [""] * len(head))[: len(head)]))
        end += 1
    return end


_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_INLINE = re.compile(
    r"(?P<escape>\\[!-/:-@\[-`{-~])|(?P<code>(?<!`)(?P<ticks>`+)(?!`)(?P<body>.+?)(?<!`)(?P=ticks)(?!`))|(?P<embed>!\[\[(?P<etarget>[^\[\]|]+)(?:\|(?P<edisplay>[^\]]*))?\]\])"
    r"|(?P<wiki>\[\[(?P<wtarget>[^\[\]|]+)(?:\|(?P<wtext>[^\]]*))?\]\])|(?P<fref>\[\^(?P<fident>[^\[\]]+)\])"
    r"|(?P<math>(?<!\$)\$(?P<mbody>[^$\n]+?)\$(?!\$))|(?P<auto><(?P<aurl>[a-zA-Z][a-zA-Z0-9+.-]+:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>)"
    r"|(?P<bare>(?<![\w/])(?:https?://|www\.)[^\s<>]*[^\s<>?!.,:*_~'\")\]])|(?P<tag></?[a-zA-Z][^<>]*>|<!--.*?-->)"
    r"|(?P<open>!?\[)|(?P<hard>(?: {2,}|\\)\n)|(?P<soft>\n)|(?P<marks>\*+|_+|~{1,2})|(?P<brace>\{[^{}]*\})",
    re.S,
)


def _brackets(text: str) -> dict[int, int]:
    """Place of the bracket that closes each opening one."""
    out: dict[int, int] = {}
    open_at: list[int] = []
    for m in re.finditer(r"\\.|[\[\]]", text, re.S):
        if m.group() == "[":
            open_at.append(m.start())
        elif m.group() == "]" and open_at:
            out[open_at.pop()] = m.start()
    return out


_TARGET = re.compile(r"\(\s*(?:<([^>]*)>|((?:[^\s()\\]|\\.|\([^\s()]*\))*))(?:\s+(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(([^)]*)\)))?\s*\)")


def inline(text: str, mdx: bool = False, nest: int = 0) -> list[Node]:
    """The inline nodes of a text: code, links and the like first, then emphasis around them."""
    parts: list[Node | tuple[str, bool, bool]] = []
    at, n = 0, len(text)
    closing: dict[int, int] | None = None

    def plain(piece: str) -> None:
        if piece:
            parts.append(Node("text", attributes={"value": html.unescape(piece)}))

    while at < n:
        m = _INLINE.search(text, at)
        if not m:
            plain(text[at:])
            break
        plain(text[at : m.start()])
        at = m.end()
        kind = m.lastgroup if m.lastgroup in ("escape", "hard", "soft", "marks", "open", "tag", "bare", "brace") else next(k for k in ("code", "embed", "wiki", "fref", "math", "auto", "escape", "hard", "soft", "marks", "open", "tag", "bare", "brace") if m.group(k) is not None)
        if kind == "escape":
            parts.append(Node("text", attributes={"value": m.group()[1]}))
        elif kind == "code":
            body = m.group("body").replace("\n", " ")
            parts.append(Node("code_inline", attributes={"value": body[1:-1] if len(body) > 2 and body[0] == body[-1] == " " and body.strip() else body}))
        elif kind == "embed":
            parts.append(Node("embed", attributes={"url": m.group("etarget").strip(), "value": m.group("edisplay")}))
        elif kind == "wiki":
            parts.append(Node("wikilink", attributes={"url": m.group("wtarget").strip(), "value": m.group("wtext") or m.group("wtarget").strip()}))
        elif kind == "fref":
            parts.append(Node("footnoteref", attributes={"ident": m.group("fident"), "label": m.group("fident")}))
        elif kind == "math":
            parts.append(Node("math_inline", attributes={"value": m.group("mbody")}))
        elif kind in ("auto", "bare"):
            shown = m.group("aurl") if kind == "auto" else m.group()
            url = f"mailto:{shown}" if "@" in shown and ":" not in shown else f"http://{shown}" if shown.startswith("www.") else shown
            parts.append(Node("link", [Node("text", attributes={"value": shown})], {"url": url, "title": None}))
        elif kind == "tag":
            if mdx and re.match(r"</?[A-Z]", m.group()):
                parts.append(Node("mdx_jsx_text_element", attributes={"name": re.match(r"</?([\w.]+)", m.group()).group(1)}))
            else:
                parts.append(Node("html", attributes={"value": m.group()}))
        elif kind == "hard":
            parts.append(Node("break"))
        elif kind == "soft":
            plain("\n")
        elif kind == "brace":
            if mdx:
                parts.append(Node("mdx_text_expression", attributes={"value": m.group()[1:-1]}))
            else:
                plain(m.group())
        elif kind == "open":
            if closing is None:
                closing = _brackets(text)
            image, end = m.group()[0] == "!", closing.get(at - 1, -1) if nest < NEST else -1
            target = _TARGET.match(text, end + 1) if end >= 0 else None
            reference = re.compile(r"\[([^\]]*)\]").match(text, end + 1) if end >= 0 else None
            label = text[at:end]
            if target:
                url, title = target.group(1) if target.group(1) is not None else _ESCAPE.sub(r"\1", target.group(2)), target.group(3) or target.group(4) or target.group(5)
                if image:
                    parts.append(Node("image", attributes={"url": url, "alt": "".join(c.plain() for c in inline(label, nest=nest + 1)), "title": title}))
                else:
                    parts.append(_over("link", [c for x in inline(label, mdx, nest + 1) for c in (x.children if x.kind == "link" else [x])], {"url": url, "title": title}))
                at = target.end()
            elif reference:
                ident = (reference.group(1) or label).lower()
                shared = {"ident": ident, "label": reference.group(1) or label}
                parts.append(Node("image_ref", attributes=shared | {"alt": label}) if image else _over("link_ref", inline(label, mdx, nest + 1), shared))
                at = reference.end()
            else:
                plain(m.group())
        else:
            run = m.group()
            before, after = text[m.start() - 1] if m.start() else " ", text[at] if at < n else " "
            left = not after.isspace() and (after.isalnum() or before.isspace() or not before.isalnum())
            right = not before.isspace() and (before.isalnum() or after.isspace() or not after.isalnum())
            if run[0] == "_":
                left, right = left and not before.isalnum(), right and not after.isalnum()
            parts.append((run, left, right))
    return _emphasis(parts)


def _over(kind: str, inner: list[Node], attributes: dict[str, Any] | None = None) -> Node:
    """A node over others; over those that lie too deep it holds their text."""
    height = 1 + max((c.height for c in inner), default=0)
    if height > NEST:
        inner, height = [Node("text", attributes={"value": "".join(c.plain() for c in inner)})], 1
    return Node(kind, inner, attributes or {}, height=height)


def _emphasis(parts: list) -> list[Node]:
    """Pair the runs of marks, nearest first: two marks are strong, one is emphasis, tildes are deletion."""
    i = 0
    parts = list(parts)
    floor: dict[str, int] = {}  # by mark: no part up to here opens
    while i < len(parts):
        closer = parts[i]
        if isinstance(closer, Node) or not closer[2]:
            i += 1
            continue
        mark = closer[0] if closer[0][0] == "~" else closer[0][0]
        j, low = i - 1, floor.get(mark, -1)
        while j > low and (isinstance(parts[j], Node) or parts[j][0][0] != closer[0][0] or not parts[j][1] or (closer[0][0] == "~" and parts[j][0] != closer[0])):
            j -= 1
        if j <= low:
            floor[mark] = i - 1
            i += 1
            continue
        opener = parts[j]
        size = len(closer[0]) if closer[0][0] == "~" else 2 if len(opener[0]) >= 2 and len(closer[0]) >= 2 else 1
        kind = "delete" if closer[0][0] == "~" else "strong" if size == 2 else "emphasis"
        inner = [p if isinstance(p, Node) else Node("text", attributes={"value": p[0]}) for p in parts[j + 1 : i]]
        new: list = [_over(kind, _joined(inner))]
        if len(opener[0]) > size:
            new.insert(0, (opener[0][size:], opener[1], opener[2]))
        if len(closer[0]) > size:
            new.append((closer[0][size:], closer[1], closer[2]))
        parts[j : i + 1] = new
        floor = {k: min(v, j - 1) for k, v in floor.items()}
        i = j + len(new) - 1 if len(closer[0]) > size else j + len(new)
    return _joined([p if isinstance(p, Node) else Node("text", attributes={"value": p[0]}) for p in parts])


def _joined(nodes: list[Node]) -> list[Node]:
    """Neighbouring texts as one."""
    out: list[Node] = []
    for node in nodes:
        if node.kind == "text" and out and out[-1].kind == "text":
            out[-1] = Node("text", attributes={"value": out[-1].attributes["value"] + node.attributes["value"]})
        else:
            out.append(node)
    return out


def name_of(node: Node) -> str:
    return f"h{node.attributes['depth']}" if node.kind == "heading" else node.kind


def render(node: Node) -> str:
    """The node as Markdown."""
    a, inside = node.attributes, lambda sep="": sep.join(render(c) for c in node.children)
    kind = node.kind
    if kind == "heading":
        return "#" * a["depth"] + " " + inside()
    if kind == "text":
        return a["value"]
    if kind == "list":
        mark = f"{a['idx'] + 1}." if a["ordered"] else "-"
        return "  " * a["level"] + mark + " " + ("" if a["checked"] is None else "[x] " if a["checked"] else "[ ] ") + inside()
    if kind == "code":
        return f"```{' '.join(x for x in (a['lang'], a['meta']) if x)}\n{a['value']}\n```" if a["fence"] else "\n".join("    " + x for x in a["value"].split("\n"))
    if kind in ("strong", "emphasis", "delete"):
        mark = {"strong": "**", "emphasis": "*", "delete": "~~"}[kind]
        return mark + inside() + mark
    if kind in ("code_inline", "math_inline"):
        mark = "`" if kind == "code_inline" else "$"
        return mark + a["value"] + mark
    if kind == "math":
        return f"$$\n{a['value']}\n$$"
    if kind in ("link", "image"):
        title = f' "{a["title"]}"' if a.get("title") else ""
        return ("!" if kind == "image" else "") + f"[{a['alt'] if kind == 'image' else inside()}]({a['url']}{title})"
    if kind in ("link_ref", "image_ref"):
        return ("!" if kind == "image_ref" else "") + f"[{a['alt'] if kind == 'image_ref' else inside()}][{a['label']}]"
    if kind in ("wikilink", "embed"):
        shown = a["value"] if a.get("value") and a["value"] != a["url"] else None
        return ("!" if kind == "embed" else "") + f"[[{a['url']}{'|' + shown if shown else ''}]]"
    if kind in ("blockquote", "callout"):
        head = [f"[!{a['callout']}]" + (f" {a['title']}" if a["title"] else "")] if kind == "callout" else []
        return "\n".join("> " + x for x in [*head, *document(node.children).split("\n")] if x or not head)
    if kind == "footnote":
        return f"[^{a['ident']}]: {inside()}"
    if kind == "footnoteref":
        return f"[^{a['ident']}]"
    if kind == "definition":
        return f"[{a['label']}]: {a['url']}" + (f' "{a["title"]}"' if a["title"] else "")
    if kind == "hr":
        return "---"
    if kind == "break":
        return "  \n"
    if kind in ("yaml", "toml"):
        mark = "---" if kind == "yaml" else "+++"
        return f"{mark}\n{a['value']}\n{mark}"
    if kind == "table_cell":
        return inside().replace("|", "\\|")
    if kind in ("mdx_flow_expression", "mdx_text_expression"):
        return "{" + a["value"] + "}"
    if kind.startswith("mdx_jsx"):
        return f"<{a['name']}>{inside()}</{a['name']}>" if node.children else f"<{a['name']} />"
    return a.get("value") or inside()


_INLINE_KINDS = frozenset("text strong emphasis delete code_inline math_inline link image link_ref image_ref wikilink embed footnoteref break mdx_text_expression mdx_jsx_text_element".split())


def document(nodes: list[Node]) -> str:
    """Nodes as one Markdown text: inline nodes run on, blocks are parted by an empty line, items and rows by a line end."""
    out, before, row = [], "", []
    marks = {"none": "---", "left": ":---", "right": "---:", "center": ":---:"}

    def flush_row() -> None:
        if row:
            out.append("| " + " | ".join(row) + " |\n")
            row.clear()

    for i, node in enumerate(nodes):
        kind = "inline" if node.kind in _INLINE_KINDS else node.kind
        if node.kind == "table_cell":
            if node.attributes["col"] == 0:
                flush_row()
                if before not in ("table_cell", "table_align", ""):
                    out.append("\n\n" if before else "")
            row.append(render(node))
        elif node.kind == "table_align":
            flush_row()
            out.append("| " + " | ".join(marks[a] for a in node.attributes["align"]) + " |\n")
        else:
            flush_row()
            if before:
                out.append("" if before == kind == "inline" else "\n" if before == kind == "list" or before in ("table_cell", "table_align") else "\n\n")
            out.append(render(node))
        before = kind
    flush_row()
    return "".join(out).rstrip("\n")
