"""Text of a query to its tree: tuples whose first element names the form."""

from __future__ import annotations

import re
from typing import Any

KEYWORDS = frozenset("def fn let var if elif else unless while until loop foreach match do end try catch break continue and or not include import module nodes self as true false None".split())
_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<istring>s"(?:[^"\\]|\\.)*")|(?P<string>"(?:[^"\\]|\\.)*")
    |(?P<symbol>:[A-Za-z_]\w*|:"[^"]*")
    |(?P<selector>\.(?:---|\*\*\*|___|\*\*|\$\$|<>|\{\}|\[\^\]|\[\d*\]\[\d*\]|\[\d*\]|[>^<]|[A-Za-z_]\w*|"[^"]*"))
    |(?P<ident>[A-Za-z_]\w*(?:::[A-Za-z_]\w*)*)
    |(?P<op>\.\.\.|\.\.|\?\?|\|\||&&|\|=|==|!=|<=|>=|=~|!~|<<|>>|->|\+=|-=|\*=|//=|/=|%=|[-+*/%@=<>!|:;,()\[\]{}])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "0": "\0", "e": "\x1b", "$": "$"}
#: Operators by how tightly they bind, with the function that each stands for.
_BINARY = {"||": (1, "or"), "&&": (2, "and"), "==": (3, "eq"), "!=": (3, "ne"), "<": (3, "lt"), "<=": (3, "lte"), ">": (3, "gt"), ">=": (3, "gte"), "=~": (3, "is_regex_match"), "!~": (3, "is_not_regex_match"), "+": (4, "add"), "-": (4, "sub"), "<<": (4, "shift_left"), ">>": (4, "shift_right"), "*": (5, "mul"), "/": (5, "div"), "%": (5, "mod"), "@": (5, "convert"), "..": (6, "range"), "??": (6, "coalesce")}
_ASSIGN = {"=": None, "+=": "add", "-=": "sub", "*=": "mul", "/=": "div", "%=": "mod", "//=": "floordiv"}


class QueryError(ValueError):
    """A query that can't be read or evaluated."""


def unescape(text: str) -> str:
    return re.sub(r"\\(u\{[0-9a-fA-F]+\}|x[0-9a-fA-F]{2}|.)", lambda m: chr(int(m.group(1).strip("ux{}"), 16)) if m.group(1)[0] in "ux" and len(m.group(1)) > 1 else _ESCAPES.get(m.group(1), m.group(1)), text)


def tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at]!r} at {at}")
        at, kind = m.end(), m.lastgroup
        # A dot after a value is an attribute or a range, never the start of a number.
        if kind != "space":
            out.append((kind, m.group(), m.start()))
    out.append(("end", "", len(text)))
    return out


class Parser:
    def __init__(self, text: str):
        self.tokens, self.i = tokens(text), 0

    def peek(self, *values: str) -> bool:
        kind, text, _ = self.tokens[self.i]
        return text in values and kind in ("op", "ident")

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            kind, text, at = self.tokens[self.i]
            raise QueryError(f"expected {value} at {at}, found {text or 'the end'}")

    def name(self) -> str:
        kind, text, at = self.tokens[self.i]
        if kind != "ident":
            raise QueryError(f"expected a name at {at}")
        self.i += 1
        return text

    def program(self, *ends: str) -> list:
        """Steps of a pipeline up to one of ``ends``, which stays."""
        out = []
        while not self.peek(*ends) and self.tokens[self.i][0] != "end":
            if self.take("|"):
                continue
            if not ends and self.take(";"):
                continue
            out.append(self.statement())
        return out

    def body(self) -> list:
        """What follows a colon, up to a semicolon or ``end``; or a block of ``do``."""
        if self.take("do"):
            out = self.program("end", ";")
        else:
            self.need(":")
            out = self.program(";", "end")
        if not self.take(";", "end") and self.tokens[self.i][0] != "end":
            raise QueryError("a body has no end")
        return out

    def single(self) -> Any:
        self.need(":")
        return self.statement()

    def parameters(self) -> list[tuple[str, Any, bool]]:
        out = []
        if self.take("("):
            while not self.take(")"):
                many = self.take("*")
                name = self.name()
                out.append((name, self.expression() if self.take("=") else None, many))
                self.take(",")
        return out

    def statement(self) -> Any:
        if self.take("def"):
            name, params = self.name(), self.parameters()
            return ("def", name, params, self.body())
        if self.take("module"):
            name = self.name()
            return ("module", name, self.body())
        if self.take("include", "import"):
            kind, text, _ = self.tokens[self.i]
            self.i += 1
            alias = self.name() if self.take("as") else None
            return ("include", unescape(text[1:-1]), alias)
        if self.peek("let", "var"):
            mutable = self.tokens[self.i][1] == "var"
            self.i += 1
            pattern = self.pattern()
            self.need("=")
            return ("let", pattern, self.expression(), mutable)
        out = self.expression()
        if out[0] == "ident" and self.tokens[self.i][1] in _ASSIGN and self.tokens[self.i][0] == "op":
            op = _ASSIGN[self.tokens[self.i][1]]
            self.i += 1
            value = self.expression()
            return ("assign", out[1], ("call", op, [out, value]) if op else value)
        if self.take("|="):
            return ("update", out, self.expression())
        if self.take("as"):
            return ("as", out, self.pattern())
        return out

    def expression(self, least: int = 0) -> Any:
        left = self.unary()
        while True:
            kind, text, _ = self.tokens[self.i]
            if kind != "op" or text not in _BINARY or _BINARY[text][0] < max(least, 1):
                return left
            binds, function = _BINARY[text]
            self.i += 1
            right = self.expression(binds + 1)
            left = (function, left, right) if function in ("and", "or", "coalesce") else ("call", function, [left, right])

    def unary(self) -> Any:
        if self.take("!"):
            return ("call", "not", [self.unary()])
        if self.take("-"):
            return ("call", "negate", [self.unary()])
        return self.postfix(self.primary())

    def postfix(self, out: Any) -> Any:
        while True:
            kind, text, at = self.tokens[self.i]
            glued = at == self.tokens[self.i - 1][2] + len(self.tokens[self.i - 1][1])
            if kind == "op" and text == "[" and glued:
                self.i += 1
                first = None if self.peek(":") else self.expression()
                if self.take(":"):
                    last = None if self.peek("]") else self.expression()
                    out = ("slice", out, first, last)
                else:
                    out = ("call", "get", [out, first])
                self.need("]")
            elif kind == "op" and text == "(" and glued and out[0] in ("fn", "dynamic", "paren"):
                out = ("dynamic", out, self.arguments())
            elif kind == "selector" and (glued or out[0] == "selector"):
                self.i += 1
                out = ("chain", out, ("selector", text, self.arguments() if self._glued("(") else []), glued)
            else:
                return out

    def _glued(self, value: str) -> bool:
        kind, text, at = self.tokens[self.i]
        return text == value and at == self.tokens[self.i - 1][2] + len(self.tokens[self.i - 1][1])

    def arguments(self) -> list:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(("spread", self.expression()) if self.take("...") else self.expression())
            self.take(",")
        return out

    def primary(self) -> Any:
        kind, text, at = self.tokens[self.i]
        self.i += 1
        if kind == "number":
            return ("literal", float(text) if "." in text or "e" in text.lower() else int(text))
        if kind == "string":
            return ("literal", unescape(text[1:-1]))
        if kind == "symbol":
            return ("symbol", text[1:].strip('"'))
        if kind == "istring":
            parts: list = []
            for i, piece in enumerate(re.split(r"\$\{([^}]*)\}", text[2:-1])):
                parts.append(("literal", unescape(piece)) if i % 2 == 0 else Parser(piece).expression())
            return ("interpolated", parts)
        if kind == "selector":
            return ("selector", text, self.arguments() if self._glued("(") else [])
        if kind == "op":
            if text == "(":
                inner = self.program(")")
                self.need(")")
                return ("paren", inner)
            if text == "[":
                out = []
                while not self.take("]"):
                    out.append(("spread", self.expression()) if self.take("...") else self.expression())
                    self.take(",")
                return ("array", out)
            if text == "{":
                entries = []
                while not self.take("}"):
                    if self.take("..."):
                        entries.append((None, self.expression()))
                    else:
                        kind, key, _ = self.tokens[self.i]
                        self.i += 1
                        colon = self.take(":")
                        if not colon and self.tokens[self.i][0] == "symbol":
                            value = self._after_colon()
                        else:
                            value = self.expression() if colon else ("ident", key)
                        entries.append((("literal", unescape(key[1:-1]) if kind == "string" else key), value))
                    self.take(",")
                return ("dict", entries)
            if text == "..":
                return ("selector", "..", [])
            if text == "->":
                return ("fn", self.parameters(), self.body())
        if kind == "ident":
            return self.word(text, at)
        raise QueryError(f"unexpected {text or 'end'} at {at}")

    def _after_colon(self) -> Any:
        """``{a:b}`` without a space: the colon and what follows look like a symbol."""
        kind, text, at = self.tokens[self.i]
        self.tokens[self.i : self.i + 1] = tokens(text[1:])[:-1]
        return self.expression()

    def word(self, text: str, at: int) -> Any:
        if text in ("true", "false"):
            return ("literal", text == "true")
        if text == "None":
            return ("literal", None)
        if text in ("self", "nodes", "break", "continue"):
            if text == "break" and self.take(":"):
                return ("break", self.expression())
            return (text,) if text != "break" else ("break", None)
        if text == "fn":
            return ("fn", self.parameters(), self.body())
        if text == "do":
            out = self.program("end", ";")
            self.take("end", ";")
            return ("block", out)
        if text in ("if", "unless"):
            self.need("(")
            arms = [(self.expression(), None)]
            self.need(")")
            arms[0] = (arms[0][0] if text == "if" else ("call", "not", [arms[0][0]]), self.single())
            while self.take("elif"):
                self.need("(")
                condition = self.expression()
                self.need(")")
                arms.append((condition, self.single()))
            return ("if", arms, self.single() if self.take("else") else ("literal", None))
        if text in ("while", "until"):
            self.need("(")
            condition = self.expression()
            self.need(")")
            return ("while", condition if text == "while" else ("call", "not", [condition]), self.body())
        if text == "loop":
            return ("while", ("literal", True), self.body())
        if text == "foreach":
            self.need("(")
            pattern = self.pattern()
            self.need(",")
            over = self.expression()
            self.need(")")
            return ("foreach", pattern, over, self.body())
        if text == "try":
            attempt = self.single()
            name, handler = None, ("literal", None)
            if self.take("catch"):
                if self.take("("):
                    name = self.name()
                    self.need(")")
                handler = self.single()
            return ("try", attempt, name, handler)
        if text == "match":
            self.need("(")
            value = self.expression()
            self.need(")")
            self.need("do")
            arms = []
            while not self.take("end"):
                self.take("|")
                pattern, guard = self.pattern(), None
                if self.take("if"):
                    self.need("(")
                    guard = self.expression()
                    self.need(")")
                arms.append((pattern, guard, self.single()))
            return ("match", value, arms)
        if self._glued("("):
            return ("call", text, self.arguments())
        return ("ident", text)

    def pattern(self) -> Any:
        out = self._pattern()
        while self.take("||"):
            out = ("either", out, self._pattern())
        return out

    def _pattern(self) -> Any:
        kind, text, at = self.tokens[self.i]
        self.i += 1
        if kind == "symbol":
            return ("type", text[1:])
        if kind in ("number", "string"):
            self.i -= 1
            return ("equal", self.primary()[1])
        if text == "-":
            return ("equal", -self.primary()[1])
        if text in ("true", "false", "None"):
            return ("equal", {"true": True, "false": False, "None": None}[text])
        if text == "[":
            parts: list = []
            rest = None
            while not self.take("]"):
                if self.take(".."):
                    rest = self.name()
                else:
                    parts.append(self.pattern())
                self.take(",")
            return ("list", parts, rest)
        if text == "{":
            fields = []
            while not self.take("}"):
                key = self.name()
                fields.append((key, self.pattern() if self.take(":") else ("name", key)))
                self.take(",")
            return ("fields", fields)
        if kind == "ident":
            return ("any",) if text == "_" else ("name", text)
        raise QueryError(f"no pattern at {at}")


def parse(text: str) -> list:
    """The steps of a query."""
    p = Parser(text)
    try:
        out = p.program()
    except IndexError:
        raise QueryError("the query ends too soon") from None
    if p.tokens[p.i][0] != "end":
        raise QueryError(f"unexpected {p.tokens[p.i][1]} at {p.tokens[p.i][2]}")
    return out
