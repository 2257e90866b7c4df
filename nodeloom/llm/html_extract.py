"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page becomes a sequence of leaf blocks: runs of text that no block element parts. Each has features of its ancestors (tags,
words of class and id), of its text (length, share of links, marks) and of its place. The field has two labels, main text
and the rest. It is trained by the gradient of the log-likelihood on pages which :func:`labelled_pages` makes, with the
label of each block known; Viterbi decoding finds a page's best labels.
"""

from __future__ import annotations

import functools
import html
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.scratch import light_batches

#: Pages that training makes, its steps, and the strength of the prior.
PAGES, STEPS, PRIOR = 900, 300, 5e-5

_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements without text for readers; those of the first kind run to the end of the page if nothing closes them.
_TO_END, _RAW = frozenset("script style textarea".split()), frozenset("script style textarea template iframe svg canvas".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Words of class, id and role, by what they tell.
_HINTS = {
    "ad": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner dfp adsense",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pagination pager tabs",
    "side": "sidebar aside side rail widget widgets related recommended trending popular teaser teasers complementary",
    "comment": "comment comments commentlist reply replies respond discussion disqus responses",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe signup paywall privacy disclaimer",
    "foot": "footer foot copyright legal bottom colophon contentinfo",
    "head": "header masthead top logo branding site",
    "share": "share sharing social follow tags meta byline",
    "main": "article content main post entry story text body page",
}
_HINT_OF = {w: k for k, words in _HINTS.items() for w in words.split()}
_ANCESTORS = ["article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "blockquote", "pre", "figure", "p", "div", "h1", "h2", "dl", "dialog"]
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


@dataclass
class Block:
    text: str
    tag: str
    ancestors: frozenset[str]
    link_share: float
    own: frozenset[str] = frozenset()


@functools.lru_cache(1 << 14)
def _hints(tag: str, attributes: str) -> frozenset[str]:
    """Of one element: its tag, what its class, id and role tell, and whether it is hidden.

    Words of html and body name themes and layouts, and tell nothing of a block; those of article and main are marked as such.
    """
    out = {tag, "?notice"} if tag == "noscript" else {tag}
    if tag in ("html", "body"):
        return frozenset(out)
    mark = "!" if tag in ("article", "main") else "?"
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            out.add("?hidden")
        elif name in ("class", "id", "role"):
            out.update(mark + _HINT_OF[w] for w in map(str.lower, _WORD.findall(value)) if w in _HINT_OF)
    return frozenset(out)


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order; scripts, styles, comments and what stands in the head are not among them."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str], frozenset[str]]] = []  # tag, its and its ancestors' hints, its own
    held: list[str] = []
    state = {"link": 0, "all": 0, "in_link": 0, "head": False}

    def text(piece: str) -> None:
        if piece and not state["head"]:
            piece = html.unescape(piece) if "&" in piece else piece
            held.append(piece)
            size = len(piece.strip())
            state["all"] += size
            state["link"] += size if state["in_link"] else 0

    def close() -> None:
        joined = " ".join("".join(held).split())
        if joined:
            tag, above, own = stack[-1] if stack else ("", frozenset(), frozenset())
            out.append(Block(joined, tag, above, state["link"] / max(1, state["all"]), own))
        held.clear()
        state["link"] = state["all"] = 0

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            if m.group().startswith("<![CDATA["):
                text(html.escape(m.group()[9:].removesuffix("]]>")))
            continue
        if m.group(1):
            if tag == "a":
                state["in_link"] = max(0, state["in_link"] - 1)
            elif tag == "head":
                state["head"] = False
            elif tag in _BLOCKS:
                close()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            continue
        if tag in _RAW:
            if not m.group(3).endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else n if tag in _TO_END else at
            held.append(" ")
        elif tag == "title":
            end = re.compile(r"</title\s*>", re.I).search(page, at)
            at = end.end() if end else at
        elif tag == "head":
            state["head"] = True
        elif tag == "br":
            held.append(" ")
        elif tag == "a":
            state["in_link"] = 1
        elif tag in _BLOCKS:
            if tag == "body":
                state["head"] = False
            close()
            if stack and stack[-1][0] in ("p", *_HEADINGS) and tag != "option":
                stack.pop()
            if tag in _CLOSES:
                same, up_to = _CLOSES[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in same.split():
                        del stack[i:]
                        break
                    if stack[i][0] in up_to.split():
                        break
            if tag not in _VOID:
                own = _hints(tag, m.group(3))
                stack.append((tag, (stack[-1][1] | own) if stack else own, own))
    close()
    return out


FEATURES = [*_ANCESTORS, *("?" + k for k in _HINTS), *("!" + k for k in _HINTS), *("own?" + k for k in _HINTS), "?hidden", "heading", "in_article_or_main", "links_some", "links_most", "len20", "len60", "len150", "len400", "ends", "comma", "copyright", "first", "last", "no_container", "bias"]
_AT = {f: i for i, f in enumerate(FEATURES)}


def features(page: list[Block]) -> np.ndarray:
    """A row of 0 and 1 for each block."""
    x = np.zeros((len(page), len(FEATURES)))
    has_container = any("article" in b.ancestors or "main" in b.ancestors for b in page)
    for i, b in enumerate(page):
        on = [f for f in (*b.ancestors, *("own" + h for h in b.own)) if f in _AT]
        size = len(b.text)
        on += [f"len{k}" for k in (20, 60, 150, 400) if size >= k]
        if b.tag in _HEADINGS:
            on.append("heading")
        if "article" in b.ancestors or "main" in b.ancestors:
            on.append("in_article_or_main")
        if b.link_share > 0.3:
            on.append("links_some")
        if b.link_share > 0.8:
            on.append("links_most")
        if b.text[-1] in ".!?…:\"”»":
            on.append("ends")
        if ", " in b.text:
            on.append("comma")
        if "©" in b.text or "All rights" in b.text:
            on.append("copyright")
        if i == 0:
            on.append("first")
        if i == len(page) - 1:
            on.append("last")
        if not has_container:
            on.append("no_container")
        x[i, [_AT[f] for f in on]] = 1
        x[i, _AT["bias"]] = 1
    return x


@dataclass
class Field:
    """Weights of the label main text, and of the steps between labels (from, to)."""

    weights: np.ndarray
    steps: np.ndarray

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best labels, by Viterbi."""
        score = x @ self.weights
        best, back = np.array([0.0, score[0]]), np.zeros((len(x), 2), np.int64)
        (s00, s01), (s10, s11) = self.steps.tolist()
        a, b = 0.0, float(score[0])
        for i in range(1, len(x)):
            back[i] = (b + s10 > a + s00, b + s11 > a + s01)
            a, b = max(a + s00, b + s10), max(a + s01, b + s11) + float(score[i])
        best = int(b > a)
        out = np.zeros(len(x), np.int64)
        for i in range(len(x) - 1, -1, -1):
            out[i] = best
            best = int(back[i, best])
        return out


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def train(pages: list[tuple[list[Block], list[int]]], steps: int = STEPS) -> Field:
    """The field of greatest penalised likelihood, by gradient ascent with Adam, over all pages at once."""
    pages = [p for p in pages if p[0]]
    longest = max(len(b) for b, _ in pages)
    x = np.zeros((len(pages), longest, len(FEATURES)))
    y, there = np.zeros((len(pages), longest), np.int64), np.zeros((len(pages), longest), bool)
    for i, (b, labels) in enumerate(pages):
        x[i, : len(b)], y[i, : len(b)], there[i, : len(b)] = features(b), labels, True
    theta = np.zeros(len(FEATURES) + 4)
    moment, square, total = np.zeros_like(theta), np.zeros_like(theta), there.sum()
    pair = there[:, 1:]
    seen_steps = np.array([[(pair & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    seen = np.einsum("ptf,pt->f", x, (y * there).astype(float))
    for step in range(1, steps + 1):
        w, t = theta[:-4], theta[-4:].reshape(2, 2)
        score = x @ w
        ahead, behind = np.zeros((longest, len(pages), 2)), np.zeros((longest, len(pages), 2))
        ahead[0, :, 1] = score[:, 0]
        for i in range(1, longest):
            new = np.stack([_log_sum(ahead[i - 1, :, 0] + t[0, k], ahead[i - 1, :, 1] + t[1, k]) + (score[:, i] if k else 0) for k in (0, 1)], axis=1)
            ahead[i] = np.where(there[:, i, None], new, ahead[i - 1])
        for i in range(longest - 2, -1, -1):
            new = np.stack([_log_sum(behind[i + 1, :, 0] + t[k, 0], behind[i + 1, :, 1] + t[k, 1] + score[:, i + 1]) for k in (0, 1)], axis=1)
            behind[i] = np.where(there[:, i + 1, None], new, 0)
        z = _log_sum(ahead[-1, :, 0], ahead[-1, :, 1])
        one = np.exp(ahead[:, :, 1] + behind[:, :, 1] - z).T * there
        grad_w = seen - np.einsum("ptf,pt->f", x, one)
        grad_t = seen_steps.astype(float)
        for a in (0, 1):
            for b in (0, 1):
                both = np.exp(ahead[:-1, :, a] + t[a, b] + (score[:, 1:].T if b else 0) + behind[1:, :, b] - z).T
                grad_t[a, b] -= (both * pair).sum()
        grad = np.concatenate([grad_w, grad_t.ravel()]) / total - PRIOR * theta
        moment, square = 0.9 * moment + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta += 0.15 * moment / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:-4].copy(), theta[-4:].reshape(2, 2).copy())


def labelled_pages(n: int, seed: int = 5) -> list[tuple[str, list[str]]]:
    """Made-up pages with the blocks of their main text: articles in several mark-ups, with what surrounds and interrupts them."""
    rnd = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(low, high)))

    def sentence(low=4, high=18) -> str:
        s = words(low, high).capitalize()
        return s.replace(" ", ", ", 1) + rnd.choice("..!?") if rnd.random() < 0.4 else s + rnd.choice([".", ".", ".", "", "!"])

    def prose(low=1, high=6) -> str:
        return " ".join(sentence(1, 20) for _ in range(rnd.randint(low, high)))

    def links(low: int, high: int, tag="li") -> str:
        return "".join(f'<{tag}><a href="/{words(1, 1)}">{words(1, 3)}</a></{tag}>' for _ in range(rnd.randint(low, high)))

    def named(kind: str) -> str:
        return rnd.choice(["class", "class", "id"]) + f'="{rnd.choice(_HINTS[kind].split())}{rnd.choice(["", "-box", " wrap", "_1"])}"'

    def rest(kind: str) -> str:
        if kind == "menu":
            return rnd.choice([f"<nav><ul>{links(2, 9)}</ul></nav>", f"<div {named('menu')}><ul>{links(2, 9)}</ul></div>", f"<ul {named('menu')}>{links(2, 9)}</ul>", f"<nav>{links(2, 6, 'span')}</nav>"])
        if kind == "head":
            inner = rnd.choice([f"<h1>{words(1, 3)}</h1>", f"<div>{words(1, 4)}</div>", f"<a href='/'>{words(1, 2)}</a><p>{sentence()}</p>", f"{words(1, 4)}"])
            return rnd.choice([f"<header>{inner}</header>", f"<div {named('head')}>{inner}</div>"])
        if kind == "foot":
            inner = rnd.choice([f"&copy; {words(1, 2)}.example &middot; {prose(1, 2)}", f"<p>{prose(1, 3)}</p><ul>{links(1, 4)}</ul>", f"<p>© 2020 {words(1, 3)}. All rights reserved.</p>", prose(1, 2)])
            return rnd.choice([f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<div {named('foot')}>{inner}</div>"])
        if kind == "side":
            inner = rnd.choice([f"<h3>{words(1, 3)}</h3><ul>{links(2, 6)}</ul>", f"<p>{prose(1, 3)}</p>", f"<h2>{words(1, 3)}</h2><p>{prose(1, 2)}</p>"])
            return rnd.choice([f"<aside>{inner}</aside>", f"<div {named('side')}>{inner}</div>", f"<section {named('side')}>{inner}</section>"])
        if kind == "ad":
            return f"<{(t := rnd.choice(['div', 'div', 'p', 'section', 'aside']))} {named('ad')}>{prose(1, 3)}</{t}>"
        if kind == "notice":
            inner = f"<p>{prose(1, 3)}</p>" + rnd.choice(["", f"<button>{words(1, 2)}</button>"])
            return rnd.choice([f"<div {named('notice')}>{inner}</div>", f"<dialog>{inner}</dialog>", f"<div {named('notice')}>{prose(1, 3)}</div>", f"<p {named('notice')}>{prose(1, 2)}</p>"])
        if kind == "form":
            return f"<form action='/x'>{rnd.choice(['', f'<p>{prose(1, 2)}</p>'])}<label>{words(1, 3)}</label><input name='q'><select><option>{words(1, 1)}<option>{words(1, 1)}</select><textarea>x</textarea><button>{words(1, 2)}</button></form>"
        if kind == "comment":
            one = lambda: rnd.choice([f"<div class='comment'><b>{words(1, 2)}</b><p>{prose(1, 4)}</p></div>", f"<li>{prose(1, 4)}</li>", f"<p>{prose(1, 4)}</p>"])
            inner = rnd.choice(["", f"<h2>{words(1, 2)}</h2>", f"<h3>{words(1, 2)}</h3>"]) + "".join(one() for _ in range(rnd.randint(1, 5)))
            return f"<{(t := rnd.choice(['div', 'section', 'ol', 'ul', 'div']))} {named('comment')}>{inner}</{t}>"
        return rnd.choice([f"<script>var a = '<p>{words(2, 5)}</p>';</script>", f"<style>p{{margin:0}}</style>", f"<!-- {words(1, 4)} -->", f"<div hidden>{prose(1, 2)}</div>", f"<div style='display:none'><p>{prose(1, 2)}</p></div>", f"<div {named('share')}><a href='#'>{words(1, 2)}</a><a href='#'>{words(1, 1)}</a></div>"])

    def body() -> tuple[str, list[str]]:
        out, main = [], []

        def add(tag: str, text: str, inner: str | None = None, closed=True) -> None:
            out.append(f"<{tag}>{inner or text}" + (f"</{tag}>" if closed else ""))
            main.append(" ".join(text.split()))

        if rnd.random() < 0.75:
            add("h1", words(1, 10))
            if rnd.random() < 0.2:
                out[-1] = f"<header>{out[-1]}</header>"
        for _ in range(rnd.choice([0, 1, 2, 3, 5, 8, 14])):
            kind = rnd.random()
            if kind < 0.62:
                t = prose(1, 8)
                add("p", t, rnd.choice([None, None, f"<b>{t}<br>", f"<em>{t}</em>", t.replace(" ", " <a href='/y'>", 1) + "</a>" if " " in t and len(t) < 60 else None]), rnd.random() < 0.8)
            elif kind < 0.7:
                add(rnd.choice(["h2", "h3"]), words(1, 6))
            elif kind < 0.78:
                out.append("<ul>")
                for _ in range(rnd.randint(1, 4)):
                    add("li", sentence())
                out.append("</ul>")
            elif kind < 0.83:
                add("blockquote", prose(1, 3))
            elif kind < 0.86:
                out.append("<table><tr>")
                for _ in range(rnd.randint(2, 6)):
                    add("td", words(1, 3))
                out.append("</tr></table>")
            elif kind < 0.89:
                add("pre", words(3, 12))
            else:
                out.append(rest(rnd.choice(["ad", "ad", "side", "share", "notice", "form"])))
        if rnd.random() < 0.2:
            out.append(rest("comment"))
        return "".join(out), main

    pages = []
    for _ in range(n):
        before = [rest(k) for k in ("notice", "head", "menu", "side", "ad", "form", "other") if rnd.random() < 0.45]
        after = [rest(k) for k in ("comment", "side", "ad", "form", "notice", "foot", "other") if rnd.random() < 0.4]
        rnd.shuffle(before)
        if rnd.random() < 0.15:  # little or nothing around the text
            before, after = before[: rnd.randint(0, 1)], after[: rnd.randint(0, 1)]
        inner, main = body()
        if rnd.random() < 0.25:
            inner = f"<section>{inner}</section>"
        kind = rnd.random()
        # Names of what holds an article may have words in them that tell of something else.
        noise = lambda: f' class="{" ".join(rnd.choice(_HINTS[rnd.choice(list(_HINTS))].split()) + rnd.choice(["", "-free", "-on", "able"]) for _ in range(rnd.randint(1, 3)))}"' if rnd.random() < 0.35 else ""
        if kind < 0.37:
            inner = f"<article{noise()}>{inner}</article>"
        elif kind < 0.45:
            inner = f"<main{noise()}>{inner}</main>"
        elif kind < 0.52:
            inner = f"<main{noise()}><article{noise()}>{inner}</article></main>"
        elif kind < 0.87:
            inner = f"<div {named('main')}>{inner}</div>"
        elif kind < 0.94:
            inner = f"<div>{inner}</div>"
        page = f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body{noise()}>{''.join(before)}{inner}{''.join(after)}"
        pages.append((page + rnd.choice(["</body></html>", ""]), main))
    return pages


def labels_of(page: list[Block], main: list[str]) -> list[int]:
    """1 for the blocks that are, in order, the main text's."""
    out, at = [], 0
    for b in page:
        hit = at < len(main) and b.text == main[at]
        at += hit
        out.append(int(hit))
    return out


@functools.lru_cache(1)
def trained() -> Field:
    """The field of the made-up pages; the same in each process."""
    return train([(b, labels_of(b, main)) for p, main in labelled_pages(PAGES) if (b := blocks(p))])


def extract(page: str, model: Field) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n\n".join(b.text for b, main in zip(found, model.decode(features(found))) if main)


def _texts(model: Field):
    def run(batches):
        for batch in batches:
            texts = [extract(h or "", model) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page.

    text joins the blocks of the main text by an empty line; white space inside a block is one space. Null and empty pages,
    and those without such blocks, have an empty text. Null ids and urls and repeated rows pass through, other columns don't.
    """
    light_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_texts(trained()), "page_id long, url string, text string, n_chars long")
