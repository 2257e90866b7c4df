"""Values and how they count: truth, equality, the text of a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    """A column by name, or the column itself."""
    return x if isinstance(x, Column) else F.col(x)


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def truthy(x: Column | str, kind: str) -> Column:
    """Whether a value counts as true: not false, 0, empty text, array or bytes, nor null. A map always does."""
    x = col(x)
    out = {
        "boolean": lambda: x,
        "string": lambda: x != "",
        "binary": lambda: F.octet_length(x) > 0,
        "array": lambda: F.size(x) > 0,
        "map": lambda: x.isNotNull(),
        "struct": lambda: x.isNotNull(),
    }.get(kind.split("<")[0], lambda: x != 0)()
    return F.coalesce(out, F.lit(False))


def equal(a: Column | str, b: Column | str) -> Column:
    return col(a).eqNullSafe(col(b))


def text_of(x: Column | str) -> Column:
    """A number's text: whole numbers without a point."""
    n = col(x).cast("double")
    whole = (n == F.floor(n)) & (F.abs(n) < 1e15)
    return F.when(whole, n.cast("long").cast("string")).otherwise(n.cast("string"))


def is_empty(x: Column | str, kind: str) -> Column:
    """Null counts as empty; numbers never do."""
    x = col(x)
    size = {"string": F.length, "array": F.size, "map": F.size, "binary": F.octet_length}.get(kind.split("<")[0])
    return F.coalesce(size(x) == 0, F.lit(True)) if size else x.isNull()


def to_number(x: Column | str) -> Column:
    return col(x).try_cast("double")


def to_boolean(x: Column | str) -> Column:
    return col(x).try_cast("boolean")


def between(x: Column | str, low, high) -> Column:
    return col(x).between(lit(low), lit(high))
