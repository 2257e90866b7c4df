"""Likeness of strings. Edit distance is Spark's own; Jaro's measure is an Arrow function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.kinds import col


def jaro_of(a: str, b: str) -> float:
    """1 for equal strings, 0 for those without a common character within reach."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    if not first:
        return 0.0
    second = [c for c, u in zip(b, used) if u]
    swapped = sum(x != y for x, y in zip(first, second)) // 2
    m = len(first)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro's measure with a bonus for up to four common first characters."""
    score, same = jaro_of(a, b), 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return score + same * 0.1 * (1 - score) if score > 0.7 else score


def _measured(f):
    def measure(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(measure, "double")


def jaro(a, b) -> Column:
    return _measured(jaro_of)(col(a), col(b))


def jaro_winkler(a, b) -> Column:
    return _measured(jaro_winkler_of)(col(a), col(b))


def match(rows: DataFrame, text: str, query: str, by: str = "jaro_winkler") -> DataFrame:
    """Rows with their score against the query, best first."""
    q = F.lit(query)
    if by == "levenshtein":
        return rows.withColumn("score", F.levenshtein(F.col(text), q)).orderBy("score", text)
    return rows.withColumn("score", {"jaro": jaro, "jaro_winkler": jaro_winkler}[by](text, q)).orderBy(F.desc("score"), text)


def best_match(rows: DataFrame, text: str, query: str) -> DataFrame:
    return match(rows, text, query).limit(1)


def filter_matches(rows: DataFrame, text: str, query: str, threshold: float) -> DataFrame:
    return rows.withColumn("score", jaro_winkler(text, F.lit(query))).where(F.col("score") >= threshold)
