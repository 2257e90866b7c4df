"""Selectors and attributes of one node."""

from __future__ import annotations

import re
from typing import Any

from nodeloom.operators.selectors import _ARGUMENT, _HAS, _KIND_OF
from nodeloom.sources.markdown_parser import Node

ATTRIBUTES = frozenset([*_HAS, "level", "values", "children", "cn"])
_STORED = {"index": "idx", "column": "col", "kind": "callout"}


def attribute(node: Node, name: str) -> Any:
    if name in ("values", "children", "cn"):
        return node.children or None
    if name == "level":
        return node.attributes.get("depth" if node.kind == "heading" else "level")
    if node.kind not in _HAS.get(name, "").split():
        return None
    if name == "value" and node.kind not in ("link", "wikilink", "embed"):
        return node.plain()
    return node.plain() if name == "value" and node.children else node.attributes.get(_STORED.get(name, name))


def with_attribute(node: Node, name: str, new: Any) -> Node:
    if name == "value" and node.children:
        return Node(node.kind, [Node("text", attributes={"value": new})], dict(node.attributes))
    key = "depth" if name == "level" and node.kind == "heading" else _STORED.get(name, name)
    if name != "level" and node.kind not in _HAS.get(name, "").split():
        return node
    return Node(node.kind, node.children, node.attributes | {key: new})


def matches(node: Node, name: str, args: list) -> bool:
    a, kind = node.attributes, node.kind
    if m := re.fullmatch(r"\[(\d*)\]\[(\d*)\]", name):
        if not any(m.groups()):
            return kind in ("table_cell", "table_align")
        return kind == "table_cell" and all(not g or a[k] == int(g) for g, k in zip(m.groups(), ("row", "col")))
    if m := re.fullmatch(r"\[(\d+)\]", name):
        return kind == "list" and a["idx"] == int(m.group(1))
    if m := re.fullmatch(r"h([1-6])", name):
        return kind == "heading" and a["depth"] == int(m.group(1))
    if name in ("h", "heading"):
        found = kind == "heading"
    elif name == "link":
        found = kind in ("link", "wikilink")
    elif name == "table":
        found = kind in ("table_cell", "table_align")
    elif name in ("task", "todo", "done"):
        found = kind == "list" and a["checked"] in {"task": (True, False), "todo": (False,), "done": (True,)}[name]
    else:
        found = kind == _KIND_OF.get(name)
    if found and args:
        key = _ARGUMENT.get({"h": "heading"}.get(name, _KIND_OF.get(name, name)))
        given = [x for v in args for x in (v if isinstance(v, list) else [v])]
        return a.get(key) in given
    return found
