"""Dates as seconds since 1970, as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nodeloom.functions.kinds import col

#: What each letter of a format stands for, in Spark's words.
_LETTERS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "I": "hh", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "e": "d", "%": "%"}


def pattern(format_: str) -> str:
    """A format with per cent letters as a pattern of Spark."""
    out, i = [], 0
    while i < len(format_):
        if format_[i] == "%" and i + 1 < len(format_):
            if format_[i + 1] not in _LETTERS:
                raise ValueError(f"no such part of a date: %{format_[i + 1]}")
            out.append(_LETTERS[format_[i + 1]])
            i += 2
        else:
            out.append(f"'{format_[i]}'" if format_[i].isalpha() else format_[i])
            i += 1
    return "".join(out)


def from_date(s) -> Column:
    """Seconds of a timestamp or its text."""
    return F.unix_timestamp(col(s).cast("timestamp"))


def to_date(seconds, format_: str = "%Y-%m-%d") -> Column:
    return F.date_format(F.timestamp_seconds(col(seconds)), pattern(format_))


strftime = to_date


def to_date_iso8601(seconds) -> Column:
    return to_date(seconds, "%Y-%m-%dT%H:%M:%SZ")


def strptime(s, format_: str) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(col(s), F.lit(pattern(format_))))


_SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400, "weeks": 604800}


def date_add(seconds, n: int, unit: str) -> Column:
    """Months and years keep the day, or take the month's last."""
    if unit in _SECONDS:
        return col(seconds) + n * _SECONDS[unit]
    if unit not in ("months", "years"):
        raise ValueError(f"no such unit: {unit}")
    moved = F.timestamp_seconds(col(seconds)) + F.make_ym_interval(F.lit(n if unit == "years" else 0), F.lit(n if unit == "months" else 0))
    return F.unix_timestamp(moved)


def date_diff(a, b, unit: str) -> Column:
    """From a to b, in whole units towards 0."""
    return ((col(b) - col(a)) / _SECONDS[unit]).cast("long")


def gmtime(seconds) -> Column:
    t = F.timestamp_seconds(col(seconds))
    return F.struct(F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.hour(t).alias("hour"), F.minute(t).alias("minute"), F.second(t).alias("second"), (F.dayofweek(t) - 1).alias("weekday"), F.dayofyear(t).alias("yearday"))


def mktime(parts) -> Column:
    p = col(parts)
    return F.unix_timestamp(F.make_timestamp(p["year"], p["month"], p["day"], p["hour"], p["minute"], p["second"].cast("decimal(8,6)")))
