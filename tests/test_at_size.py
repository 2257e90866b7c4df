"""What only larger tables show."""

import tracemalloc

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nodeloom.functions import text as S
from nodeloom.language import run
from nodeloom.language.evaluate import Evaluator, Scope
from nodeloom.language.grammar import parse
from nodeloom.plans import expressions
from nodeloom.sources import markdown_parser, nodes


def _of_part(spark, name, key):
    part = spark.range(1).select(F.lit(key).alias("p_partkey"))
    return part.select(expressions.PART[name][0]().alias("value")).first().value


def test_bytes_stop_at_the_largest_unit_asked_for(spark):
    n = spark.range(1).select(F.lit(1_250_000_000).alias("n"))
    assert tuple(n.select(S.human_bytes("n"), S.human_bytes("n", "MB"), S.human_bytes("n", "B")).first()) == ("1.3GB", "1250MB", "1250000000B")
    assert _of_part(spark, "human_bytes", 1_200_000) == "1200MB"


def test_sizes_stop_at_the_largest_unit_asked_for(spark):
    n = spark.range(1).select(F.lit(3 * 2**29).alias("n"))
    assert tuple(n.select(S.human_size("n"), S.human_size("n", "MiB")).first()) == ("1.5GiB", "1536MiB")
    assert _of_part(spark, "human_size", 2**20) == "1024MiB"


def _peak_of_parsing(rows):
    """MB that the parser takes for one table of so many rows, besides its text, and the rows that leave it."""
    text = "| A | B | C |\n| --- | --- | --- |\n" + "\n".join(f"| {i} | *b* {i} | c |" for i in range(rows))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([7]), "text": pa.array([text])})
    tracemalloc.start()
    n = sum(x.num_rows for x in nodes._parsed(False, None, nodes._COLUMNS)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 2**20, n


def test_a_table_is_not_held_as_nodes_and_rows():
    small, n = _peak_of_parsing(1500)
    large, m = _peak_of_parsing(6000)
    assert (n, m) == (1500 * 8 + 7, 6000 * 8 + 7)
    assert large - small < 6  # the lines grow with the document, nodes and rows don't


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab#*|-1. \n>[x]`:$", max_size=80))
def test_bit_by_bit_as_at_once(text):
    long = text + "\n\n- a\n- b\n  - c\n\n| a | b |\n| - | - |\n" + "| 1 | 2 |\n" * 5 + text
    before, markdown_parser.HELD = markdown_parser.HELD, 2
    try:
        bit_by_bit = [n for some in markdown_parser.stream(long) for n in some]
    finally:
        markdown_parser.HELD = before
    assert bit_by_bit == markdown_parser.parse(long)


def test_rows_of_one_file_are_dealt_to_all_cores(spark):
    rows = spark.range(0, 1000, numPartitions=1)
    got = run.over_rows(rows, "id * 2").select("id", "value", F.spark_partition_id().alias("part")).collect()
    assert sorted((r.id, r.value) for r in got) == [(i, str(2 * i)) for i in range(1000)]
    each = [sum(r.part == p for r in got) for p in {r.part for r in got}]
    assert len(each) >= 3 * spark.sparkContext.defaultParallelism and max(each) < 200


def test_an_evaluator_begins_again_without_what_it_ran():
    first = Evaluator(functions={"thrice": lambda x: 3 * x}, seconds=60)
    ran = first.again()
    ran.top.names["k"] = 5
    assert ran.over(parse("def f(x): thrice(x) + k; | f(1)"), None, ran.top) == 8
    later = first.again()
    assert later.natives is first.natives and set(later.top.names) == {"NAN", "INFINITE"} and (later.steps, later.depth) == (0, 0)
    assert later.over(parse("thrice(2)"), None, Scope(later.top)) == 6
