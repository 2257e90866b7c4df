"""Functions on arrays and maps, as expressions over columns; no row leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from nodeloom.functions.kinds import col, lit

Lambda = Callable[[Column], Column]


def at(a, i: int) -> Column:
    """Element i from 0, from the end if negative; null outside."""
    return F.try_element_at(col(a), F.lit(i + 1 if i >= 0 else i))


def first(a) -> Column:
    return at(a, 0)


def second(a) -> Column:
    return at(a, 1)


def last(a) -> Column:
    return at(a, -1)


def map_(a, f: Lambda) -> Column:
    return F.transform(col(a), f)


def filter_(a, f: Lambda) -> Column:
    """Elements for which f is true; nulls go."""
    return F.filter(col(a), lambda x: x.isNotNull() & f(x))


def reject(a, f: Lambda) -> Column:
    return F.filter(col(a), lambda x: x.isNotNull() & ~F.coalesce(f(x), F.lit(False)))


def compact(a) -> Column:
    return F.array_compact(col(a))


def compact_map(a, f: Lambda) -> Column:
    return F.array_compact(F.transform(col(a), f))


def flat_map(a, f: Lambda) -> Column:
    return F.flatten(F.transform(col(a), f))


def partition(a, f: Lambda) -> Column:
    return F.array(filter_(a, f), reject(a, f))


def any_(a, f: Lambda) -> Column:
    return F.coalesce(F.exists(col(a), f), F.lit(False))


def all_(a, f: Lambda) -> Column:
    return F.coalesce(F.forall(col(a), f), F.lit(True))


def in_(a, x) -> Column:
    return F.coalesce(F.array_contains(col(a), lit(x)), F.lit(False))


def count_by(a, f: Lambda) -> Column:
    return F.size(F.filter(col(a), f))


def find_index(a, f: Lambda) -> Column:
    """First place for which f holds, -1 if there is none."""
    return F.coalesce(F.array_position(F.transform(col(a), lambda x: F.coalesce(f(x), F.lit(False))), True), F.lit(0)) - 1


def take(a, n: int) -> Column:
    if n < 0:
        raise ValueError("n is 0 or more")
    return F.slice(col(a), 1, n)


def skip(a, n: int) -> Column:
    if n < 0:
        raise ValueError("n is 0 or more")
    return F.slice(col(a), F.lit(n + 1), F.greatest(F.size(col(a)), F.lit(0)))


def take_while(a, f: Lambda) -> Column:
    stop = find_index(a, lambda x: ~f(x))
    return F.when(stop < 0, col(a)).otherwise(F.slice(col(a), F.lit(1), stop))


def skip_while(a, f: Lambda) -> Column:
    stop = find_index(a, lambda x: ~f(x))
    return F.when(stop < 0, F.slice(col(a), 1, 0)).otherwise(F.slice(col(a), stop + 1, F.size(col(a))))


def fold(a, start, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(col(a), lit(start), f)


def sum_(a) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda x, y: x + y)


def sum_by(a, f: Lambda) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda x, y: x + f(y))


def product(a) -> Column:
    return F.aggregate(col(a), F.lit(1.0), lambda x, y: x * y)


def _guard(a, x: Column) -> Column:
    return F.when(F.size(col(a)) > 0, x)


def mean(a) -> Column:
    return _guard(a, sum_(a) / F.size(col(a)))


def geomean(a) -> Column:
    return _guard(a, F.pow(product(a), 1 / F.size(col(a))))


def variance(a) -> Column:
    """Of the whole population."""
    m = mean(a)
    return _guard(a, F.aggregate(F.transform(col(a), lambda x: (x - m) * (x - m)), F.lit(0.0), lambda x, y: x + y) / F.size(col(a)))


def stddev(a) -> Column:
    return F.sqrt(variance(a))


def percentile(a, p: float) -> Column:
    """Linear between the closest ranks, p from 0 to 1; null for an empty array."""
    s, n = F.array_sort(col(a)), F.size(col(a))
    rank = F.lit(float(p)) * (n - 1)
    low, high = F.floor(rank).cast("int"), F.ceil(rank).cast("int")
    return _guard(a, F.get(s, low) + (rank - low) * (F.get(s, high) - F.get(s, low)))


def mode(a) -> Column:
    """All most frequent elements, ascending."""
    distinct = F.array_sort(F.array_distinct(col(a)))
    counted = F.transform(distinct, lambda x: F.struct(F.size(F.filter(col(a), lambda y: y == x)).alias("n"), x.alias("x")))
    most = F.array_max(F.transform(counted, lambda x: x["n"]))
    return F.transform(F.filter(counted, lambda x: x["n"] == most), lambda x: x["x"])


def describe(a) -> Column:
    parts = {"min": F.array_min(col(a)), "max": F.array_max(col(a)), "mean": mean(a), "median": percentile(a, 0.5), "stddev": stddev(a), "variance": variance(a), "count": F.size(col(a))}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def sort(a) -> Column:
    return F.array_sort(col(a))


def sort_by(a, f: Lambda) -> Column:
    """Ascending by f; elements of equal keys stay in order."""
    keyed = F.transform(col(a), lambda x, i: F.struct(f(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def reverse(a) -> Column:
    return F.reverse(col(a))


def uniq(a) -> Column:
    return F.array_distinct(col(a))


def unique_by(a, f: Lambda) -> Column:
    """The first element of each key, in order."""
    keys = F.transform(col(a), lambda x: f(x).cast("string"))
    return F.filter(col(a), lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def min_by(a, f: Lambda) -> Column:
    """The first element of the smallest key."""
    return first(sort_by(a, f))


def max_by(a, f: Lambda) -> Column:
    """The first element of the largest key."""
    top = F.array_max(F.transform(col(a), f))
    return first(F.filter(col(a), lambda x: f(x) == top))


def chunks(a, size: int) -> Column:
    if size <= 0:
        raise ValueError("size is over 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size(col(a)) - 1, F.lit(0)), F.lit(size))
    return F.filter(F.transform(starts, lambda i: F.slice(col(a), i + 1, F.lit(size))), lambda c: F.size(c) > 0)


def ngrams(a, n: int) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.size(col(a)) - n, F.lit(0)))
    return F.filter(F.transform(starts, lambda i: F.slice(col(a), i + 1, F.lit(n))), lambda c: F.size(c) == n)


def zip_(a, b) -> Column:
    """Pairs, as many as the shorter array has."""
    n = F.least(F.size(col(a)), F.size(col(b)))
    return F.arrays_zip(F.slice(col(a), F.lit(1), n).alias("a"), F.slice(col(b), F.lit(1), n).alias("b"))


def transpose(m) -> Column:
    width = F.array_max(F.transform(col(m), F.size))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.transform(col(m), lambda r: F.get(r, i)))


def flatten(a) -> Column:
    return F.flatten(col(a))


def fill(value, n: int) -> Column:
    if n < 0:
        raise ValueError("n is 0 or more")
    return F.array_repeat(lit(value), n)


def range_(begin: int, end, step: int = 1) -> Column:
    return F.sequence(lit(begin), lit(end), F.lit(step))


def bsearch(a, target) -> Column:
    """Place in a sorted array, -1 if it is not there."""
    return F.coalesce(F.array_position(col(a), lit(target)), F.lit(0)) - 1


def union(a, b) -> Column:
    return F.array_union(col(a), col(b))


def intersect(a, b) -> Column:
    return F.array_intersect(col(a), col(b))


def except_(a, b) -> Column:
    return F.array_except(col(a), col(b))


def slice_array(a, begin: int, end: int) -> Column:
    """Elements from begin to before end; negative places count from the end, places outside are cut to the array."""
    n = F.size(col(a))
    place = lambda i: F.greatest(F.lit(0), F.least(n, (n + i) if i < 0 else F.lit(i)))
    return F.slice(col(a), place(begin) + 1, F.greatest(F.lit(0), place(end) - place(begin)))


def has_index(a, i: int) -> Column:
    return (F.size(col(a)) > i) & F.lit(i >= 0)


# Maps, with their keys in order.


def keys(m) -> Column:
    return F.array_sort(F.map_keys(col(m)))


def values(m) -> Column:
    return F.transform(keys(m), lambda k: F.element_at(col(m), k))


def entries(m) -> Column:
    return F.array_sort(F.map_entries(col(m)))


def from_entries(pairs) -> Column:
    """From structs of key and value; the last value of a key counts."""
    p = col(pairs)
    kept = F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(kept)


def has(m, key: str) -> Column:
    return F.map_contains_key(col(m), key)


def get_or(m, key: str, default) -> Column:
    return F.coalesce(F.try_element_at(col(m), F.lit(key)), lit(default))


def pick(m, names: list[str]) -> Column:
    return F.map_filter(col(m), lambda k, v: k.isin(names) & v.isNotNull())


def omit(m, names: list[str]) -> Column:
    return F.map_filter(col(m), lambda k, v: ~k.isin(names))


def with_values(m, f: Lambda) -> Column:
    return F.transform_values(col(m), lambda k, v: f(v))


def merge(a, b) -> Column:
    """Both maps' keys; the second's value counts."""
    return F.map_zip_with(col(a), col(b), lambda k, x, y: F.coalesce(y, x))


def merge_defaults(m, defaults) -> Column:
    return merge(defaults, m)


def set_(m, key: str, value) -> Column:
    return merge(m, F.create_map(F.lit(key), lit(value)))


def del_(m, key: str) -> Column:
    return F.map_filter(col(m), lambda k, v: k != key)
