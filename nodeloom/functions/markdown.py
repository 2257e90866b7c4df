"""Markdown text made of columns: one expression a construct, so that whole documents are rendered in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nodeloom.functions.kinds import col, lit


def _s(x) -> Column:
    return F.coalesce((x if isinstance(x, Column) else F.col(x)).cast("string"), F.lit(""))


def h(value, depth=1) -> Column:
    return F.concat(F.repeat(F.lit("#"), lit(depth).cast("int")), F.lit(" "), _s(value))


def code(value, lang="") -> Column:
    return F.concat(F.lit("```"), lit(lang), F.lit("\n"), _s(value), F.lit("\n```"))


def code_inline(value) -> Column:
    return F.concat(F.lit("`"), _s(value), F.lit("`"))


def strong(value) -> Column:
    return F.concat(F.lit("**"), _s(value), F.lit("**"))


def em(value) -> Column:
    return F.concat(F.lit("*"), _s(value), F.lit("*"))


def delete(value) -> Column:
    return F.concat(F.lit("~~"), _s(value), F.lit("~~"))


def blockquote(value) -> Column:
    return F.concat(F.lit("> "), F.replace(_s(value), F.lit("\n"), F.lit("\n> ")))


def callout(value, kind: str, title: str = "") -> Column:
    return F.concat(F.lit(f"> [!{kind.upper()}]{' ' + title if title else ''}\n"), blockquote(value))


def math(value) -> Column:
    return F.concat(F.lit("$$\n"), _s(value), F.lit("\n$$"))


def math_inline(value) -> Column:
    return F.concat(F.lit("$"), _s(value), F.lit("$"))


def link(url, value, title: str = "") -> Column:
    return F.concat(F.lit("["), _s(value), F.lit("]("), _s(url), F.lit(f' "{title}")' if title else ")"))


def image(url, alt, title: str = "") -> Column:
    return F.concat(F.lit("!"), link(url, alt, title))


def footnote(value, ident) -> Column:
    return F.concat(F.lit("[^"), _s(ident), F.lit("]: "), _s(value))


def footnote_ref(ident) -> Column:
    return F.concat(F.lit("[^"), _s(ident), F.lit("]"))


def definition(url, ident, title: str = "") -> Column:
    return F.concat(F.lit("["), _s(ident), F.lit("]: "), _s(url), F.lit(f' "{title}"' if title else ""))


def list_item(value, level=0, ordered: bool = False, checked=None) -> Column:
    """``checked`` is a condition, or None for an item that is no task."""
    mark = F.lit("1. " if ordered else "- ")
    box = F.lit("") if checked is None else F.when(col(checked) if not isinstance(checked, bool) else F.lit(checked), "[x] ").otherwise("[ ] ")
    return F.concat(F.repeat(F.lit("  "), lit(level).cast("int")), mark, box, _s(value))


def table_row(*cells) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(_s(c), F.lit("|"), F.lit("\\|")) for c in cells]), F.lit(" |"))


def table_align(*aligns: str) -> Column:
    return F.lit("| " + " | ".join({"left": ":---", "right": "---:", "center": ":---:"}.get(a, "---") for a in aligns) + " |")


def doc(*blocks) -> Column:
    """Blocks with an empty line between them; nulls are left out."""
    return F.concat_ws("\n\n", *[b if isinstance(b, Column) else F.col(b) for b in blocks])
