"""HTML to Markdown: what a page shows, without scripts, navigation and hidden parts."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SKIPPED = frozenset("script style noscript template iframe object svg head nav aside footer form button select textarea".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html li main menu ol p pre section summary table tbody td tfoot th thead tr ul".split())


#: How deep elements can lie in each other.
NEST = 100


class _Element:
    def __init__(self, tag: str, attributes: dict[str, str | None]):
        self.tag, self.attributes, self.children = tag, attributes, []


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Element("root", {})
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        closes = {"li": ("li",), "p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",)}.get(tag, ("p",) if tag in _BLOCK else ())
        while self.stack[-1].tag in closes:
            self.stack.pop()
        element = _Element(tag, dict(attrs))
        self.stack[-1].children.append(element)
        if tag not in _VOID and len(self.stack) < NEST:  # what lies deeper is beside, not inside
            self.stack.append(element)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def _find(e: _Element, test: Callable[[_Element], bool]) -> list[_Element]:
    out = [e] if test(e) else []
    return out + [x for c in e.children if isinstance(c, _Element) for x in _find(c, test)]


def _text(e: _Element) -> str:
    return "".join(c if isinstance(c, str) else _text(c) for c in e.children)


def _hidden(e: _Element) -> bool:
    a = e.attributes
    return e.tag in _SKIPPED or "hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style") or "")) or bool(re.search(r"(^|[\s_-])(ad|ads|advert|sidebar|cookie|banner|breadcrumbs?)($|[\s_-])", a.get("class") or ""))


def to_markdown(page: str, base_url: str | None = None, title_as_h1: bool = False, front_matter: bool = False, scripts_as_code: bool = False) -> str:
    """A page's main part as Markdown: the element main, article, of role main or of a Markdown body, else the body."""
    tree = _Tree()
    tree.feed(page)
    tree.close()
    entries = [lambda e: e.tag == "main", lambda e: e.tag == "article", lambda e: e.attributes.get("role") == "main", lambda e: "markdown-body" in (e.attributes.get("class") or "").split(), lambda e: e.tag == "body"]
    top = next((found[0] for test in entries if (found := _find(tree.root, test))), tree.root)
    link = lambda url: urljoin(base_url, url) if base_url and url else url or ""

    def inline(e: _Element) -> str:
        out = []
        for c in e.children:
            if isinstance(c, str):
                out.append(re.sub(r"\s+", " ", c))
            elif not _hidden(c):
                inside = inline(c)
                if c.tag == "br":
                    out.append("  \n")
                elif c.tag == "img":
                    out.append(f"![{c.attributes.get('alt') or ''}]({link(c.attributes.get('src'))})")
                elif not inside.strip():
                    out.append(inside)
                elif c.tag in ("b", "strong", "i", "em", "del", "s", "strike"):
                    mark = "**" if c.tag in ("b", "strong") else "*" if c.tag in ("i", "em") else "~~"
                    lead, tail = inside[: len(inside) - len(inside.lstrip())], inside[len(inside.rstrip()) :]
                    out.append(lead + mark + inside.strip() + mark + tail)
                elif c.tag == "code":
                    out.append(f"`{_text(c)}`")
                elif c.tag == "a" and c.attributes.get("href"):
                    out.append(f"[{inside.strip()}]({link(c.attributes['href'])})")
                else:
                    out.append(inside)
        return "".join(out)

    def blocks(e: _Element, depth: int = 0) -> list[str]:
        out: list[str] = []
        held = _Element("span", {})

        def flush() -> None:
            if shown := re.sub(r"[ \t]*\n[ \t]*", "\n", inline(held)).strip():
                out.append(shown)
            held.children = []

        for c in e.children:
            if isinstance(c, str) or (c.tag not in _BLOCK and not _find(c, lambda x: x.tag in _BLOCK and x is not c)):
                if isinstance(c, _Element) and c.tag == "script" and scripts_as_code:
                    flush()
                    out.append(f"```javascript\n{_text(c).strip()}\n```")
                else:
                    held.children.append(c)
                continue
            flush()
            if _hidden(c):
                continue
            if re.fullmatch("h[1-6]", c.tag):
                if shown := inline(c).strip():
                    out.append("#" * int(c.tag[1]) + " " + shown)
            elif c.tag == "pre":
                code = next(iter(_find(c, lambda x: x.tag == "code")), c)
                lang = re.search(r"language-(\S+)", code.attributes.get("class") or "")
                out.append(f"```{lang.group(1) if lang else ''}\n{_text(code).strip(chr(10))}\n```")
            elif c.tag == "hr":
                out.append("---")
            elif c.tag == "blockquote":
                out.append("\n".join("> " + x if x else ">" for x in "\n\n".join(blocks(c, depth)).split("\n")))
            elif c.tag in ("ul", "ol", "menu"):
                items, n = [], int(c.attributes.get("start") or 1) if (c.attributes.get("start") or "1").isdigit() else 1
                for item in [x for x in c.children if isinstance(x, _Element) and x.tag == "li"]:
                    inner = blocks(item, depth + 1)
                    mark = f"{n}. " if c.tag == "ol" else "- "
                    n += 1
                    items.append(mark + "\n".join(inner).replace("\n", "\n" + " " * len(mark)) if inner else mark.strip())
                out.append("\n".join(items))
            elif c.tag == "table":
                rows = [[inline(x).strip().replace("|", "\\|").replace("\n", " ") for x in r.children if isinstance(x, _Element) and x.tag in ("td", "th")] for r in _find(c, lambda x: x.tag == "tr")]
                rows = [r for r in rows if r]
                if rows:
                    width = max(map(len, rows))
                    rows = [r + [""] * (width - len(r)) for r in rows]
                    out.append("\n".join(["| " + " | ".join(rows[0]) + " |", "| " + " | ".join(["---"] * width) + " |", *("| " + " | ".join(r) + " |" for r in rows[1:])]))
            else:
                out += blocks(c, depth)
        flush()
        return out

    found = blocks(top)
    title = next((_text(t).strip() for t in _find(tree.root, lambda e: e.tag == "title")), "")
    if title_as_h1 and title and not any(b.startswith("# ") for b in found):
        found.insert(0, f"# {title}")
    if front_matter and title:
        found.insert(0, f"---\ntitle: {title}\n---")
    return "\n\n".join(found)


def convert(pages: DataFrame, html_col: str = "html", url_col: str | None = None, **options: bool) -> DataFrame:
    """``pages`` with markdown; links are made whole by the page's address, if there is one."""

    def run(batches):
        for batch in batches:
            urls = batch.column(batch.schema.get_field_index(url_col)).to_pylist() if url_col else [None] * batch.num_rows
            texts = [to_markdown(h, u, **options) if h is not None else None for h, u in zip(batch.column(batch.schema.get_field_index(html_col)).to_pylist(), urls)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "markdown"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(run, f"{fields}, markdown string")


def read_html(spark, path: str, **options: bool) -> DataFrame:
    """Nodes of HTML files; doc_id is the file's name."""
    from nodeloom.sources.nodes import parse_markdown, read_raw

    pages = convert(read_raw(spark, path), "value", **options)
    return parse_markdown(pages.select(F.col("file").alias("doc_id"), F.col("markdown").alias("text")))
