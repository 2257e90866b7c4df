"""Hashes, encodings, escapes, bits and versions, as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nodeloom.functions.kinds import col


def _bytes(s) -> Column:
    return F.encode(col(s), "UTF-8")


def md5(s) -> Column:
    return F.md5(_bytes(s))


def sha256(s) -> Column:
    return F.sha2(_bytes(s), 256)


def sha512(s) -> Column:
    return F.sha2(_bytes(s), 512)


def base64(s) -> Column:
    return F.regexp_replace(F.base64(_bytes(s)), "[\r\n]", "")


def base64d(s) -> Column:
    return F.decode(F.unbase64(col(s)), "UTF-8")


def base64url(s) -> Column:
    return F.regexp_replace(F.translate(base64(s), "+/", "-_"), "=+$", "")


def base64urld(s) -> Column:
    return base64d(F.translate(col(s), "-_", "+/"))


def to_hex(s) -> Column:
    return F.lower(F.hex(_bytes(s)))


def from_hex(s) -> Column:
    return F.decode(F.unhex(col(s)), "UTF-8")


def url_encode(s) -> Column:
    """All but letters, digits and ``-_.~`` as per cent codes."""
    return F.replace(F.replace(F.replace(F.url_encode(col(s)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_decode(s) -> Column:
    return F.url_decode(F.replace(col(s), F.lit("+"), F.lit("%2B")))


_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]


def html_escape(s) -> Column:
    out = col(s)
    for raw, escaped in _ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def html_unescape(s) -> Column:
    out = col(s)
    for raw, escaped in reversed(_ESCAPES):
        out = F.replace(out, F.lit(escaped), F.lit(raw))
    return out


def strip_tags(s) -> Column:
    return F.regexp_replace(col(s), "<[^>]*>", "")


def band(a, b: int) -> Column:
    return col(a).bitwiseAND(F.lit(b))


def bor(a, b: int) -> Column:
    return col(a).bitwiseOR(F.lit(b))


def xor(a, b: int) -> Column:
    return col(a).bitwiseXOR(F.lit(b))


def shift_left(a, n: int) -> Column:
    return F.shiftleft(col(a), n)


def shift_right(a, n: int) -> Column:
    return F.shiftright(col(a), n)


_VERSION = r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"


def semver(s) -> Column:
    """(major, minor, patch, pre, build); null for what is no version."""
    part = lambda i: F.regexp_extract(col(s), _VERSION, i)
    fields = F.struct(*[part(i + 1).try_cast("long").alias(n) for i, n in enumerate(("major", "minor", "patch"))], F.nullif(part(4), F.lit("")).alias("pre"), F.nullif(part(5), F.lit("")).alias("build"))
    return F.when(F.rlike(col(s), F.lit(_VERSION)), fields)


def semver_key(s) -> Column:
    """A key in the order of versions: a release comes after what precedes it, a number before a word, builds don't count."""
    v = semver(s)
    parts = F.transform(F.split(v["pre"], "\\."), lambda p: F.struct((~F.rlike(p, F.lit(r"^\d+$"))).alias("word"), p.try_cast("long").alias("number"), p.alias("text")))
    return F.struct(v["major"].alias("major"), v["minor"].alias("minor"), v["patch"].alias("patch"), v["pre"].isNull().alias("release"), parts.alias("pre"))


def levenshtein(a, b) -> Column:
    return F.levenshtein(col(a), col(b))


def semver_compare(a, b) -> Column:
    """-1, 0 or 1."""
    x, y = semver_key(a), semver_key(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def semver_bump(s, part: str) -> Column:
    """The next major, minor or patch version; what is less than it becomes 0, and pre-release and build go."""
    v, n = semver(s), ("major", "minor", "patch").index(part)
    fields = [v[k] if i < n else v[k] + 1 if i == n else F.lit(0) for i, k in enumerate(("major", "minor", "patch"))]
    return F.when(v.isNotNull(), F.concat_ws(".", *[f.cast("string") for f in fields]))


def semver_satisfies(s, wanted: str) -> Column:
    """Comparators such as ``>=1.2.0 <2``, ``^1.2``, ``~1.2.3``, with ``||`` between alternatives; releases only, unless named."""
    import re

    def bounds(text: str) -> Column:
        m = re.fullmatch(r"(\^|~|>=|<=|>|<|=)?v?(\d+)(?:\.(\d+|x|\*))?(?:\.(\d+|x|\*))?(?:-([\w.]+))?", text)
        if not m:
            raise ValueError(f"no such range of versions: {text}")
        op, numbers = m.group(1) or "=", [int(p) if p and p.isdigit() else None for p in m.group(2, 3, 4)]
        known = [p for p in numbers if p is not None]
        low = ".".join(map(str, known + [0] * (3 - len(known)))) + (f"-{m.group(5)}" if m.group(5) else "")
        key, version = semver_key(s), lambda v: semver_key(F.lit(v))
        if op in ("^", "~") or (op == "=" and len(known) < 3):
            i = next((j for j, p in enumerate(known) if p), len(known) - 1) if op == "^" else min(1, len(known) - 1) if op == "~" else len(known) - 1
            high = ".".join(str(p) for p in [*known[:i], known[i] + 1, *[0] * (2 - i)])
            return (key >= version(low)) & (key < version(high + "-0"))
        return {"=": key == version(low), ">": key > version(low), "<": key < version(low), ">=": key >= version(low), "<=": key <= version(low)}[op]

    out: Column | None = None
    for alternative in wanted.split("||"):
        every = F.lit(True)
        for part in alternative.split():
            every = every & bounds(part)
        out = every if out is None else out | every
    return F.coalesce(out, F.lit(False))
