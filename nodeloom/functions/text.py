"""Functions on strings, as expressions over columns. A null argument gives null unless a docstring says otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from nodeloom.functions.kinds import col

downcase, upcase = F.lower, F.upper
#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trim(s) -> Column:
    """Without white space at the ends."""
    return F.trim(col(s), F.lit(WHITE))


def ltrim(s) -> Column:
    return F.ltrim(col(s), F.lit(WHITE))


def rtrim(s) -> Column:
    return F.rtrim(col(s), F.lit(WHITE))


def ascii_downcase(s) -> Column:
    return F.translate(col(s), _UPPER, _LOWER)


def ascii_upcase(s) -> Column:
    return F.translate(col(s), _LOWER, _UPPER)


def ltrimstr(s, left: str) -> Column:
    """Without the prefix, once."""
    return F.when(F.startswith(col(s), F.lit(left)), F.substring(col(s), len(left) + 1, 2**31 - 1)).otherwise(col(s))


def rtrimstr(s, right: str) -> Column:
    return F.when(F.endswith(col(s), F.lit(right)), F.substring(col(s), F.lit(1), F.length(col(s)) - len(right))).otherwise(col(s))


def contains(s, needle: str) -> Column:
    return F.contains(col(s), F.lit(needle))


def starts_with(s, prefix: str) -> Column:
    return F.startswith(col(s), F.lit(prefix))


def ends_with(s, suffix: str) -> Column:
    return F.endswith(col(s), F.lit(suffix))


def index(s, needle: str) -> Column:
    """Place of the first occurrence from 0, -1 if there is none."""
    return F.instr(col(s), needle) - 1


def rindex(s, needle: str) -> Column:
    """Place of the last occurrence from 0, -1 if there is none."""
    back = F.instr(F.reverse(col(s)), needle[::-1])
    return F.when(back == 0, -1).otherwise(F.length(col(s)) - back - len(needle) + 1)


def indices(s, needle: str) -> Column:
    """Places of all occurrences, those that overlap too."""
    places = F.sequence(F.lit(0), F.greatest(F.length(col(s)) - len(needle), F.lit(0)))
    return F.filter(places, lambda i: F.substring(col(s), i + 1, F.lit(len(needle))) == needle)


def replace(s, old: str, new: str) -> Column:
    return F.replace(col(s), F.lit(old), F.lit(new))


def gsub(s, pattern: str, new: str) -> Column:
    """All matches of a regular expression replaced; ``$1`` stands for a group."""
    return F.regexp_replace(col(s), pattern, new)


def split(s, separator: str) -> Column:
    """Parts between the separator, taken literally; an empty separator parts all characters."""
    return F.split(col(s), "") if not separator else F.split(col(s), "\\Q" + separator + "\\E", -1)


def join(a, separator: str) -> Column:
    return F.array_join(col(a), separator)


def explode(s) -> Column:
    """The code points."""
    return F.transform(F.split(col(s), ""), lambda c: F.ascii(c))


def implode(codes) -> Column:
    return F.array_join(F.transform(col(codes), lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")), "")


def utf8bytelen(s) -> Column:
    return F.octet_length(col(s))


def length(s) -> Column:
    return F.length(col(s))


def slice_string(s, begin: int, end: int) -> Column:
    """Characters from begin to before end; negative places count from the end, places outside are cut to the string."""
    n = F.length(col(s))
    place = lambda i: F.greatest(F.lit(0), F.least(n, (n + i) if i < 0 else F.lit(i)))
    return F.substring(col(s), place(begin) + 1, F.greatest(F.lit(0), place(end) - place(begin)))


def matches(s, pattern: str) -> Column:
    return F.rlike(col(s), F.lit(pattern))


def scan(s, pattern: str) -> Column:
    """All matches of a pattern without groups."""
    return F.regexp_extract_all(col(s), F.lit(pattern), 0)


def scan_groups(s, pattern: str, groups: int) -> Column:
    """For each match, the array of its groups."""
    return F.arrays_zip(*[F.regexp_extract_all(col(s), F.lit(pattern), g).alias(f"g{g}") for g in range(1, groups + 1)])


def capture(s, pattern: str, *names: str) -> Column:
    """A struct of the first match's groups; null where nothing matches."""
    fields = F.struct(*[F.regexp_extract(col(s), pattern, i + 1).alias(n) for i, n in enumerate(names)])
    return F.when(F.rlike(col(s), F.lit(pattern)), fields)


def repeat(s, n: int) -> Column:
    return F.repeat(col(s), n)


def lpad(s, width: int, pad: str = " ") -> Column:
    """At least ``width`` characters; longer strings stay."""
    return F.when(F.length(col(s)) >= width, col(s)).otherwise(F.lpad(col(s), width, pad))


def rpad(s, width: int, pad: str = " ") -> Column:
    return F.when(F.length(col(s)) >= width, col(s)).otherwise(F.rpad(col(s), width, pad))


def slugify(s, separator: str = "-") -> Column:
    """Lower case, with each run of other characters than a-z and 0-9 as one separator; hyphens at the ends go."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(s)), "[^a-z0-9]+", separator), "^-+|-+$", "")


def lines(s) -> Column:
    return F.split(col(s), "\n", -1)


def unlines(a) -> Column:
    return F.array_join(col(a), "\n")


def chunks(s, size: int) -> Column:
    """Parts of ``size`` characters, the last one maybe shorter."""
    if size <= 0:
        raise ValueError("size is over 0")
    count = F.ceil(F.length(col(s)) / size).cast("int")
    whole = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.substring(col(s), i * size + 1, F.lit(size)))
    return F.when(F.length(col(s)) == 0, F.array().cast("array<string>")).otherwise(whole)


def ngrams(s, n: int) -> Column:
    """All runs of n characters."""
    last = F.length(col(s)) - n
    some = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(col(s), i + 1, F.lit(n)))
    return F.when(last < 0, F.array().cast("array<string>")).otherwise(some)


def natural_key(s) -> Column:
    """A key that sorts runs of digits by their number."""
    parts = F.regexp_extract_all(col(s), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit(r"^\d")), F.lpad(p, 20, "0")).otherwise(p)), "")


def insert(s, place: int, new: str) -> Column:
    return F.concat(F.substring(col(s), 1, place), F.lit(new), F.substring(col(s), place + 1, 2**31 - 1))


def human_bytes(n, largest: str = "PB") -> Column:
    """Sizes by thousands, with one digit after the point unless it is 0; ``largest`` is the last unit that is taken."""
    return _ladder(n, 1000, ["B", "KB", "MB", "GB", "TB", "PB"], largest)


def human_size(n, largest: str = "PiB") -> Column:
    """Sizes by 1024."""
    return _ladder(n, 1024, ["B", "KiB", "MiB", "GiB", "TiB", "PiB"], largest)


def _ladder(n, base: int, units: list[str], largest: str) -> Column:
    out: Column | None = None
    for i, unit in reversed(list(enumerate(units[: units.index(largest) + 1]))):
        shown = F.concat(F.regexp_replace(F.format_string("%.1f", F.round(col(n).cast("double") / F.lit(float(base**i)), 1)), r"\.0$", ""), F.lit(unit))
        out = shown if out is None else F.when(F.abs(col(n)) < base ** (i + 1), shown).otherwise(out)
    return out


def glob_match(s, pattern: str) -> Column:
    """``*`` and ``?`` match within a path's part, ``**`` across parts."""
    import re

    regex = re.escape(pattern).replace(r"\*\*", "\0").replace(r"\*", "[^/]*").replace(r"\?", "[^/]").replace("\0", ".*")
    return F.rlike(col(s), F.lit(f"^{regex}$"))


def basename(path) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def dirname(path) -> Column:
    return F.regexp_replace(col(path), "/?[^/]*$", "")


def extname(path) -> Column:
    return F.regexp_extract(basename(path), r".(\.[^.]+)$", 1)


def stem(path) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def token_count(s) -> Column:
    """A rough count of a language model's tokens: words and single marks."""
    return F.size(F.regexp_extract_all(col(s), F.lit(r"(\w+|[^\w\s])"), 1))



def _width(c: str) -> int:
    import unicodedata

    return 2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1


def _display(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return F.pandas_udf(run, "string")


def truncate(s, width: int, mark: str = "…") -> Column:
    """At most ``width`` columns of a terminal, with a mark where something was cut; wide characters take two."""

    def one(t: str) -> str:
        if sum(map(_width, t)) <= width:
            return t
        out, room = "", width - sum(map(_width, mark))
        for c in t:
            room -= _width(c)
            if room < 0:
                break
            out += c
        return out + mark

    return _display(one)(col(s))


def word_wrap(s, width: int) -> Column:
    """Lines of at most ``width`` columns, broken between words."""

    def one(t: str) -> str:
        out, line = [], ""
        for word in t.split():
            if line and sum(map(_width, line)) + 1 + sum(map(_width, word)) > width:
                out.append(line)
                line = word
            else:
                line = f"{line} {word}" if line else word
        return "\n".join([*out, line])

    return _display(one)(col(s))
