"""Operators over rows: joins by a key's text, groups, runs, ranks and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nodeloom.functions.kinds import col, text_of

_NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")


def key_text(df: DataFrame, name: str) -> Column:
    """A key as text, so that 1 and "1" are equal; numbers without a needless point."""
    kind = dict(df.dtypes)[name]
    return text_of(F.col(name)) if kind.startswith(_NUMBERS) and kind not in ("int", "bigint", "smallint", "tinyint") else F.col(name).cast("string")


def join_by(left: DataFrame, right: DataFrame, left_key: str, right_key: str, kind: str = "inner") -> DataFrame:
    """Rows of both sides whose keys have the same text. Null keys match nothing; of columns with the same name the right one counts.

    kind is inner, left, right or full; a side without a match keeps its own values.
    """
    if kind not in ("inner", "left", "right", "full"):
        raise ValueError(f"no kind of join: {kind}")
    a = left.select(key_text(left, left_key).alias("__key"), *[F.col(c).alias(f"l_{c}") for c in left.columns])
    b = right.select(key_text(right, right_key).alias("__right"), F.lit(True).alias("__matched"), *[F.col(c).alias(f"r_{c}") for c in right.columns])
    both = a.join(b, F.col("__key") == F.col("__right"), kind)
    own = [(F.when(F.col("__matched"), F.col(f"r_{c}")).otherwise(F.col(f"l_{c}")) if c in right.columns else F.col(f"l_{c}")).alias(c) for c in left.columns]
    return both.select(*own, *[F.col(f"r_{c}").alias(c) for c in right.columns if c not in left.columns])


def semi(rows: DataFrame, members: DataFrame, key: str, member: str) -> DataFrame:
    """Rows whose key is a member."""
    return rows.join(members.select(F.col(member).alias("__m")).distinct(), F.col(key) == F.col("__m"), "left_semi")


def anti(rows: DataFrame, members: DataFrame, key: str, member: str) -> DataFrame:
    return rows.join(members.select(F.col(member).alias("__m")).distinct(), F.col(key) == F.col("__m"), "left_anti")


def tally(rows: DataFrame, key: str) -> DataFrame:
    """(key, n): how often each value is there; partial counts come before the shuffle."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))


def group_by(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, members): each key's values in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return rows.groupBy(F.col(key).alias("key")).agg(F.transform(pairs, lambda x: x["v"]).alias("members"))


def unique_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key: a minimum over structs, which map tasks combine."""
    return rows.groupBy(key).agg(F.min(F.struct(F.col(order), *[F.col(c) for c in rows.columns if c not in (key, order)])).alias("x")).select(key, "x.*")


def index_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): values of the same key added up."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.sum(value).alias("value"))


def first_by(rows: DataFrame, value: str, order: str, largest: bool = False) -> DataFrame:
    """The first row of the smallest or largest value."""
    return rows.orderBy(F.desc(value) if largest else F.asc(value), order).limit(1)


def mode(rows: DataFrame, value: str) -> DataFrame:
    """All most frequent values."""
    counts = tally(rows.where(F.col(value).isNotNull()), value)
    most = counts.agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), F.col("n") == F.col("most")).select(F.col("key").alias("value"), "n")


#: Rank error of the sketch that narrows a percentile down, as a share of the rows.
SKETCH = 10_000


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``keys`` and a column for each share: exact percentiles, between two values in proportion; null values don't count.

    A sketch gives, for each share, two values between which the wanted ranks lie for certain. A second pass counts what is below
    them and keeps, by value, the few rows between: no task holds a group's values.
    """
    v = F.col(value)
    own = rows.where(v.isNotNull()).select(*keys, v.cast("double").alias("__v"))
    asked = [min(1.0, max(0.0, p + side * 4 / SKETCH)) for p in shares.values() for side in (-1, 1)]
    bounds = own.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), F.percentile_approx("__v", asked, SKETCH).alias("__b"))
    joined = own.join(bounds, keys) if keys else own.crossJoin(F.broadcast(bounds))  # without keys bounds is one row
    # A small group is kept as a whole: there the sketch's margin is under a row.
    bound = lambda i, edge: F.when(F.col("__n") <= SKETCH, F.col(edge)).otherwise(F.col("__b")[i])
    low, high = (lambda i: bound(2 * i, "__min")), (lambda i: bound(2 * i + 1, "__max"))
    inside = [F.col("__v").between(low(i), high(i)) for i in range(len(shares))]
    anywhere = inside[0]
    for x in inside[1:]:
        anywhere = anywhere | x
    below = joined.groupBy(*keys).agg(F.first("__n").alias("__n"), *[F.count_if(F.col("__v") < low(i)).alias(f"__below{i}") for i in range(len(shares))])
    few = joined.where(anywhere).groupBy(*keys, "__v").agg(F.count("*").alias("__c"), *[F.first(x).alias(f"__in{i}") for i, x in enumerate(inside)])
    few = few.join(below, keys) if keys else few.crossJoin(F.broadcast(below))
    so_far = W.partitionBy(*keys).orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = []
    for i, (name, p) in enumerate(shares.items()):
        end = F.col(f"__below{i}") + F.sum(F.when(F.col(f"__in{i}"), F.col("__c")).otherwise(0)).over(so_far)
        few = few.withColumn(f"__end{i}", end)
        rank = F.lit(p) * (F.col("__n") - 1)
        at = lambda r, i=i: F.max(F.when(F.col(f"__in{i}") & (r >= F.col(f"__end{i}") - F.col("__c")) & (r < F.col(f"__end{i}")), F.col("__v")))
        first, second = at(F.floor(rank)), at(F.ceil(rank))
        out.append((first + F.max(rank - F.floor(rank)) * (second - first)).alias(name))
    return few.groupBy(*keys).agg(*out)


def describe(rows: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    own = rows.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), F.var_pop(v).alias("variance"), F.count(v).alias("count"))
    median = percentiles(rows, [], value, {"median": 0.5})
    return own.crossJoin(F.broadcast(median)).select("min", "max", "mean", "median", "stddev", "variance", "count")  # one row each


def geomean(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.exp(F.avg(F.ln(value))).alias("geomean"))


def chunk_by(rows: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """(group, chunk, key, n, first): runs of rows with equal keys."""
    w = W.partitionBy(group).orderBy(order)
    new = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    runs = rows.withColumn("__new", new).withColumn("chunk", F.sum("__new").over(w))
    return runs.groupBy(group, "chunk", key).agg(F.count("*").alias("n"), F.min(order).alias("first"))


def _leading(rows: DataFrame, group: str, order: str, holds: Column) -> DataFrame:
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("__lead", F.min(F.coalesce(holds, F.lit(False)).cast("int")).over(w))


def take_while(rows: DataFrame, group: str, order: str, holds: Column) -> DataFrame:
    return _leading(rows, group, order, holds).where("__lead = 1").drop("__lead")


def skip_while(rows: DataFrame, group: str, order: str, holds: Column) -> DataFrame:
    return _leading(rows, group, order, holds).where("__lead = 0").drop("__lead")


def ngrams(rows: DataFrame, group: str, order: str, value: str, n: int) -> DataFrame:
    """(group, order, gram): each row's value with the n-1 that follow it."""
    w = W.partitionBy(group).orderBy(order)
    parts = [F.lead(value, i).over(w) for i in range(n)]
    some = rows.select(group, order, F.array(*parts).alias("gram"), F.lead(order, n - 1).over(w).alias("__last"))
    return some.where("__last is not null").drop("__last")


def zip_rows(left: DataFrame, right: DataFrame, group: str, left_order: str, right_order: str) -> DataFrame:
    """Rows of both sides by their places within a group; the longer side's rest goes."""
    number = lambda df, order: df.withColumn("__place", F.row_number().over(W.partitionBy(group).orderBy(order)))
    return number(left, left_order).join(number(right, right_order), [group, "__place"]).drop("__place")


def pivot_longer(rows: DataFrame, ids: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return rows.unpivot(ids, columns, name, value)


def pivot_wider(rows: DataFrame, ids: list[str], name: str, value: str, names: list) -> DataFrame:
    """Given names save a pass over the rows."""
    return rows.groupBy(*ids).pivot(name, names).agg(F.first(value))


def top(rows: DataFrame, group: str, by: str, tie: str, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc(by), tie))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def count_with_total(rows: DataFrame, key: str) -> DataFrame:
    """Counts by key, and of all rows with a null key."""
    return rows.rollup(key).agg(F.count("*").alias("n"))


def update(nodes: DataFrame, results: DataFrame, column: str) -> DataFrame:
    """The nodes with the results' values of a column put in by place; where there is none the old one stays."""
    new = results.select("doc_id", "pos", F.col(column).alias("__new"))
    return nodes.join(new, ["doc_id", "pos"], "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def compact(rows: DataFrame, value: str) -> DataFrame:
    """Without null and empty values."""
    return rows.where(col(value).isNotNull() & (col(value).cast("string") != ""))


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both, the left ones' columns first; a column that one side lacks is null there."""
    return left.unionByName(right, allowMissingColumns=True)


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both, each once."""
    return union_all(left, right).distinct()


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right.select(left.columns))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of the left side that the right one has not, each once."""
    return left.subtract(right.select(left.columns))


def page(rows: DataFrame, order: list[str], skip: int = 0, take: int | None = None) -> DataFrame:
    """Rows in order after the first ``skip``, at most ``take`` of them."""
    out = rows.orderBy(*order).offset(skip)
    return out if take is None else out.limit(take)


def tests(rows: DataFrame, any_of: dict[str, Column] | None = None, all_of: dict[str, Column] | None = None, counts: dict[str, Column] | None = None) -> DataFrame:
    """One row: whether a condition holds for any row, for all, and for how many; unknown counts as false."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    return rows.agg(*[F.bool_or(sure(c)).alias(n) for n, c in (any_of or {}).items()], *[F.bool_and(sure(c)).alias(n) for n, c in (all_of or {}).items()], *[F.count_if(sure(c)).alias(n) for n, c in (counts or {}).items()])
