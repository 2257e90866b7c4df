"""Evaluation of a query over the values of one document.

Numbers are Python's, None is null, symbols are strings of their own class, nodes are the parser's. Nothing here reaches files,
the network or the clock of another machine.
"""

from __future__ import annotations

import copy
import inspect
import math
import time
from collections.abc import Callable
from typing import Any

from nodeloom.language.grammar import QueryError, parse
from nodeloom.sources import markdown_parser as M

#: Calls within calls, and steps of loops, before a query is given up.
DEPTH, STEPS = 150, 1_000_000


class Symbol(str):
    __slots__ = ()


class _Break(Exception):
    def __init__(self, value: Any, given: bool):
        self.value, self.given = value, given


class _Continue(Exception):
    pass


class Halt(Exception):
    """Ends the query for its document, whose values up to here count."""

    def __init__(self, value: Any = None):
        self.value = value


class Scope:
    def __init__(self, above: Scope | None = None):
        self.names: dict[str, Any] = {}
        self.above = above

    def find(self, name: str) -> Any:
        here: Scope | None = self
        while here:
            if name in here.names:
                return here.names[name]
            here = here.above
        return _MISSING

    def put(self, name: str, value: Any) -> None:
        here: Scope | None = self
        while here:
            if name in here.names:
                here.names[name] = value
                return
            here = here.above
        raise QueryError(f"no variable {name}")


_MISSING = object()


def _arity(f: Callable) -> tuple[int, int]:
    """Fewest and most arguments of a host's function."""
    params = inspect.signature(f).parameters.values()
    most = 99 if any(p.kind is p.VAR_POSITIONAL for p in params) else len(params)
    return sum(p.default is p.empty and p.kind is not p.VAR_POSITIONAL for p in params), most


def _hosted(f: Callable) -> Callable:
    return lambda ev, *args: f(*args)


class Function:
    def __init__(self, params: list, body: list, scope: Scope, name: str = "fn"):
        self.params, self.body, self.scope, self.name = params, body, scope, name


class Partial:
    def __init__(self, function: Any, given: list):
        self.function, self.given = function, given


def truthy(v: Any) -> bool:
    """False, 0, empty texts, arrays and bytes and null are not true; a map always is."""
    return isinstance(v, dict) or isinstance(v, (M.Node, Function, Partial)) or callable(v) or bool(v)


def show(v: Any) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() and abs(v) < 1e15 else repr(v)
    if isinstance(v, M.Node):
        return M.render(v)
    if isinstance(v, bytes):
        return v.hex()
    if isinstance(v, list):
        return "[" + ", ".join(f'"{x}"' if isinstance(x, str) else show(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f'"{k}": ' + (f'"{x}"' if isinstance(x, str) else show(x)) for k, x in sorted(v.items())) + "}"
    return str(v)


def plain(v: Any) -> Any:
    """A value as JSON has it."""
    if isinstance(v, M.Node):
        return M.render(v)
    if isinstance(v, float) and v.is_integer():
        return int(v)
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in sorted(v.items())}
    return v.hex() if isinstance(v, bytes) else str(v) if isinstance(v, Symbol) else v


def text(v: Any) -> str:
    """A node's text, or the value as it is shown."""
    return v.plain() if isinstance(v, M.Node) else show(v)


def kind_of(v: Any) -> str:
    for types, name in ((bool, "bool"), (Symbol, "symbol"), (str, "string"), ((int, float), "number"), (list, "array"), (dict, "dict"), (bytes, "bytes"), (M.Node, "markdown")):
        if isinstance(v, types):
            return name
    return "None" if v is None else "function"


class Evaluator:
    """``modules`` are texts by name, ``files`` contents by path, ``functions`` the host's own by name; nothing else is within reach.

    A query is given up after ``seconds``, if they are given.
    """

    def __init__(self, modules: dict[str, str] | None = None, files: dict[str, bytes] | None = None, functions: dict[str, Callable] | None = None, seconds: float | None = None):
        from nodeloom.language import builtins, library, more  # noqa: F401  (they register themselves)

        self.natives: dict[str, tuple] = builtins.NATIVES
        if functions:
            self.natives = builtins.NATIVES | {name: (*_arity(f), _hosted(f)) for name, f in functions.items()}
        self.lazy: dict[str, Callable] = builtins.LAZY
        self.modules, self.files, self.seconds = modules or {}, files or {}, seconds
        self._begin()

    def _begin(self) -> None:
        self.depth = self.steps = 0
        self.until = time.monotonic() + self.seconds if self.seconds else None
        self.top = Scope()
        for name, value in (("NAN", math.nan), ("INFINITE", math.inf)):
            self.top.names[name] = value

    def again(self) -> Evaluator:
        """One that reaches the same and has run nothing yet."""
        out = copy.copy(self)
        out._begin()
        return out

    def run(self, steps: list, value: Any, scope: Scope) -> Any:
        for step in steps:
            value = self.eval(step, value, scope, piped=True)
        return value

    def document(self, steps: list, values: list) -> list:
        """The query's values for a document's nodes: each by itself up to ``nodes``, and all at once after it."""
        for i, step in enumerate(steps):
            if step == ("nodes",):
                values = [v for v in self.each(steps[:i], values) if v is not None]
                rest, out = steps[i + 1 :], values
                return self.all_at_once(rest, out)
        return self.each(steps, values)

    def rewritten(self, steps: list, nodes: list) -> list:
        """Nodes with the query's value in place of each that it has one for, and else with what is in it rewritten."""

        def one(node: M.Node) -> list:
            out, scope = node, Scope(self.top)
            for step in steps:
                out = self.eval(step, out, scope, piped=True)
                if out is None:  # the node is none of those that the query is about
                    break
            if out is None:
                return [M.Node(node.kind, [x for c in node.children for x in one(c)], node.attributes) if node.children else node]
            return [x if isinstance(x, M.Node) else M.Node("text", attributes={"value": show(x)}) for x in (out if isinstance(out, list) else [out])]

        return [x for n in nodes for x in one(n)]

    def over(self, steps: list, value: Any, scope: Scope) -> Any:
        """The query's value for one value."""
        try:
            return self.run(steps, value, scope)
        except Halt as halt:
            return halt.value

    def all_at_once(self, steps: list, values: list) -> list:
        try:
            value = self.run(steps, values, self.top)
        except Halt as halt:
            return [] if halt.value is None else [halt.value]
        return value if isinstance(value, list) else [value]

    def each(self, steps: list, values: list) -> list:
        defined = [s for s in steps if s[0] in ("def", "module", "include")]
        for s in defined:
            self.eval(s, None, self.top)
        rest = [s for s in steps if s[0] not in ("def", "module", "include")]
        if not rest:
            return list(values)
        out: list = []
        try:
            for v in values:
                out += self.in_place(rest, v) if isinstance(v, M.Node) else [self.run(rest, v, Scope(self.top))]
        except Halt as halt:
            out += [] if halt.value is None else [halt.value]
        return out

    def in_place(self, steps: list, node: M.Node) -> list:
        """The query's value for a node; where it is None, those for the nodes in it. An array's elements are lines of a text."""
        out = self.run(steps, node, Scope(self.top))
        if out is None and node.children:
            return [r for c in node.children for r in self.in_place(steps, c)]
        return ["\n".join(show(x) for x in out if x is not None)] if isinstance(out, list) else [out]

    def call(self, f: Any, args: list, value: Any = None) -> Any:
        if isinstance(f, Partial):
            return self.call(f.function, [*f.given, *args], value)
        if isinstance(f, Function):
            return self.call_own(f, args, value)
        return f(*args)

    def call_own(self, f: Function, args: list, value: Any) -> Any:
        needed = [p for p in f.params if p[1] is None and not p[2]]
        if len(args) == len(needed) - 1:
            args = [value, *args]
        if len(args) < len(needed) or (len(args) > len(f.params) and not any(p[2] for p in f.params)):
            raise QueryError(f"{f.name} takes {len(needed)} arguments, not {len(args)}")
        self.step()
        self.depth += 1
        if self.depth > DEPTH:
            raise QueryError("too many calls within calls")
        scope = Scope(f.scope)
        given = list(args)
        for name, default, many in f.params:
            if many:
                scope.names[name], given = given, []
            elif given:
                scope.names[name] = given.pop(0)
            else:
                scope.names[name] = self.eval(default, value, scope)
        try:
            return self.run(f.body, args[0] if args else value, scope)
        finally:
            self.depth -= 1

    def apply(self, name: str, args: list, value: Any, scope: Scope) -> Any:
        f = scope.find(name)
        if f is not _MISSING:
            if not isinstance(f, (Function, Partial)) and not callable(f):
                raise QueryError(f"{name} is no function")
            return self.call(f, args, value)
        native = self.natives.get(name)
        if native is None:
            raise QueryError(f"no function {name}")
        low, high, run = native
        if len(args) == low - 1:
            args = [value, *args]
        if not low <= len(args) <= high:
            raise QueryError(f"{name} takes {low} arguments, not {len(args)}")
        return run(self, *args)

    def eval(self, e: Any, value: Any, scope: Scope, piped: bool = False) -> Any:
        kind = e[0]
        if kind == "literal":
            return e[1]
        if kind == "symbol":
            return Symbol(e[1])
        if kind == "ident":
            found = scope.find(e[1])
            if found is not _MISSING:
                return self.call(found, [], value) if piped and isinstance(found, Function) and self._takes_one(found) else found
            if e[1] in self.natives:
                low, _, run = self.natives[e[1]]
                if piped and low <= 1:
                    return self.apply(e[1], [], value, scope)
                return lambda *args: self.apply(e[1], list(args), None, scope)
            raise QueryError(f"no variable {e[1]}")
        if kind == "self" or kind == "nodes":
            return value
        if kind == "call":
            if e[1] in self.lazy and scope.find(e[1]) is _MISSING:
                return self.lazy[e[1]](self, e[2], value, scope)
            return self.apply(e[1], self.arguments(e[2], value, scope), value, scope)
        if kind == "selector":
            return self.select(e[1], self.arguments(e[2], value, scope), value)
        if kind == "chain":
            first = self.eval(e[1], value, scope)
            if e[3] or not isinstance(first, M.Node):
                return self.select(e[2][1], self.arguments(e[2][2], value, scope), first)
            below = [x for x in descendants(first)[1:] if self.select(e[2][1], self.arguments(e[2][2], value, scope), x) is not None]
            return below or None
        if kind == "and":
            right = self.eval(e[2], value, scope) if truthy(self.eval(e[1], value, scope)) else False
            return right if truthy(right) else False
        if kind == "or":
            left = self.eval(e[1], value, scope)
            right = left if truthy(left) else self.eval(e[2], value, scope)
            return right if truthy(right) else False
        if kind == "coalesce":
            left = self.eval(e[1], value, scope)
            return self.eval(e[2], value, scope) if left is None else left
        if kind == "array":
            return self.arguments(e[1], value, scope)
        if kind == "dict":
            out: dict = {}
            for key, entry in e[1]:
                v = self.eval(entry, value, scope)
                if key is None:
                    out |= v or {}
                else:
                    out[self.eval(key, value, scope)] = v
            return out
        if kind == "slice":
            from nodeloom.language.builtins import cut

            return cut(self.eval(e[1], value, scope), *[self.eval(x, value, scope) if x else None for x in e[2:]])
        if kind in ("paren", "block"):
            return self.run(e[1], value, Scope(scope))
        if kind == "interpolated":
            return "".join(show(self.eval(p, value, scope)) for p in e[1])
        if kind == "if":
            for condition, then in e[1]:
                if truthy(self.eval(condition, value, scope)):
                    return self.eval(then, value, scope, piped)
            return self.eval(e[2], value, scope, piped)
        if kind == "fn":
            return Function(e[1], e[2], scope)
        if kind == "dynamic":
            return self.call(self.eval(e[1], value, scope), self.arguments(e[2], value, scope), value)
        if kind == "def":
            scope.names[e[1]] = Function(e[2], e[3], scope, e[1])
            return value
        if kind in ("let", "as"):
            pattern, given = (e[1], e[2]) if kind == "let" else (e[2], e[1])
            if not self.bind(pattern, self.eval(given, value, scope), scope):
                raise QueryError("the pattern does not match")
            return value
        if kind == "assign":
            scope.put(e[1], self.eval(e[2], value, scope))
            return value
        if kind == "while":
            out, inner = None, Scope(scope)
            while truthy(self.eval(e[1], value, inner)):
                self.step()
                try:
                    out = value = self.run(e[2], value, inner)
                except _Break as b:
                    return b.value if b.given else out
                except _Continue:
                    continue
            return out
        if kind == "foreach":
            results = []
            over = self.eval(e[2], value, scope)
            for item in list(over) if isinstance(over, (list, str)) else [[k, v] for k, v in sorted(over.items())] if isinstance(over, dict) else []:
                self.step()
                inner = Scope(scope)
                self.bind(e[1], item, inner)
                try:
                    results.append(self.run(e[3], value, inner))
                except _Break as b:
                    return b.value if b.given else results
                except _Continue:
                    continue
            return results
        if kind == "break":
            raise _Break(self.eval(e[1], value, scope) if e[1] else None, e[1] is not None)
        if kind == "continue":
            raise _Continue
        if kind == "try":
            try:
                return self.eval(e[1], value, scope, piped)
            except (QueryError, ArithmeticError, TypeError, ValueError, LookupError) as error:
                inner = Scope(scope)
                if e[2]:
                    inner.names[e[2]] = {"message": str(error)}
                return self.eval(e[3], value, inner, piped)
        if kind == "match":
            v = self.eval(e[1], value, scope)
            for pattern, guard, then in e[2]:
                inner = Scope(scope)
                if self.bind(pattern, v, inner) and (guard is None or truthy(self.eval(guard, value, inner))):
                    return self.eval(then, value, inner, piped)
            return None
        if kind == "update":
            return self.update(e[1], self.eval(e[2], value, scope), value, scope)
        if kind == "module":
            inner = Scope(scope)
            for s in e[2]:
                self.eval(s, value, inner)
            scope.names.update({f"{e[1]}::{k}": v for k, v in inner.names.items()})
            return value
        if kind == "include":
            return self.include(e[1], e[2], value, scope)
        raise QueryError(f"no form {kind}")

    def step(self) -> None:
        self.steps += 1
        if self.steps > STEPS:
            raise QueryError("too many steps")
        if self.until and self.steps % 64 == 0 and time.monotonic() > self.until:
            raise QueryError("the query took too long")

    def include(self, name: str, alias: str | None, value: Any, scope: Scope) -> Any:
        text = self.modules.get(name)
        if text is None:
            found = next((p for p in (name, f"{name}.mq") if p in self.files), None)
            if found is None:
                raise QueryError(f"no module {name}")
            text, name = self.files[found].decode(), name.rsplit("/", 1)[-1].removesuffix(".mq")
        inner = Scope(self.top)
        for s in parse(text):
            self.eval(s, None, inner)
        prefix = f"{alias or name}::"
        scope.names.update({prefix + k: v for k, v in inner.names.items()} | ({} if alias else inner.names))
        return value

    @staticmethod
    def _takes_one(f: Function) -> bool:
        return len([p for p in f.params if p[1] is None and not p[2]]) <= 1

    def arguments(self, some: list, value: Any, scope: Scope) -> list:
        out = []
        for a in some:
            if a[0] == "spread":
                out += self.eval(a[1], value, scope) or []
            else:
                out.append(self.eval(a, value, scope))
        return out

    def bind(self, pattern: Any, v: Any, scope: Scope) -> bool:
        kind = pattern[0]
        if kind == "any":
            return True
        if kind == "name":
            scope.names[pattern[1]] = v
            return True
        if kind == "equal":
            return type(v) is type(pattern[1]) and v == pattern[1] or isinstance(v, (int, float)) and not isinstance(v, bool) and not isinstance(pattern[1], bool) and v == pattern[1]
        if kind == "type":
            return kind_of(v) == pattern[1] or (pattern[1] == "none" and v is None) or v == pattern[1] and isinstance(v, Symbol)
        if kind == "either":
            return self.bind(pattern[1], v, scope) or self.bind(pattern[2], v, scope)
        if kind == "list":
            if not isinstance(v, list) or len(v) < len(pattern[1]) or (len(v) > len(pattern[1]) and pattern[2] is None):
                return False
            if pattern[2]:
                scope.names[pattern[2]] = v[len(pattern[1]) :]
            return all(self.bind(p, x, scope) for p, x in zip(pattern[1], v))
        return isinstance(v, dict) and all(k in v and self.bind(p, v[k], scope) for k, p in pattern[1])

    def select(self, selector: str, args: list, v: Any) -> Any:
        """What a selector takes from a value: the node itself, one of its attributes, or None."""
        from nodeloom.language import nodes as N

        name = selector[1:]
        if selector == "..":
            return descendants(v)
        if isinstance(v, (list, dict)) and name.startswith('"'):
            key = name.strip('"')
            return v.get(key) if isinstance(v, dict) else [x.get(key) if isinstance(x, dict) else None for x in v]
        if isinstance(v, list):
            if name.startswith("[") and name != "[]" and name.count("[") == 1:
                i = int(name[1:-1])
                return v[i] if i < len(v) else None
            return v if name == "[]" else [self.select(selector, args, x) for x in v]
        if isinstance(v, dict):
            return list(v.values()) if name == "[]" else v.get(name)
        if not isinstance(v, M.Node):
            return None
        if name in N.ATTRIBUTES:
            return N.attribute(v, name)
        return v if N.matches(v, name, args) else None

    def update(self, target: Any, new: Any, value: Any, scope: Scope) -> Any:
        from nodeloom.language import nodes as N

        if target[0] == "chain" and target[2][1][1:] in N.ATTRIBUTES:
            node = self.eval(target[1], value, scope)
            return value if node is None else N.with_attribute(node, target[2][1][1:], new)
        if target[0] == "selector" and target[1][1:] in N.ATTRIBUTES and isinstance(value, M.Node):
            return N.with_attribute(value, target[1][1:], new)
        raise QueryError("only an attribute can be set")


def descendants(v: Any) -> list:
    """The value and all in it, from the top."""
    if isinstance(v, list):
        return [y for x in v for y in descendants(x)]
    if isinstance(v, M.Node):
        return [v, *[y for c in v.children for y in descendants(c)]]
    if isinstance(v, dict):
        return [v, *[y for x in v.values() for y in descendants(x)]]
    return [v]


def compact(values: list) -> list:
    return [v for v in values if v is not None and v != "" and v != [] and not (isinstance(v, M.Node) and v.kind == "text" and not v.plain())]


def evaluate(query: str, values: list, modules: dict[str, str] | None = None, **host: Any) -> list:
    """The query's values for a list of values; None and empty ones stay."""
    return Evaluator(modules, **host).document(parse(query), values)
