"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.language import run as language
from nodeloom.operators import outline as O
from nodeloom.operators import relational as R
from nodeloom.operators import selectors as S
from nodeloom.plans import expressions, fixtures, language_queries
from nodeloom.sources.nodes import parse_markdown

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "sel_headings"


def query(sql: str | None = None):
    """Register a function under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _nodes(spark: SparkSession, sf_dir: str, fixture: str = "outline", **only: list[str]) -> DataFrame:
    return parse_markdown(getattr(fixtures, fixture)(spark, sf_dir), **only)


_t = fixtures.table
#: What operators on tables need of the parser: cells, without what is in them.
_CELLS = {"kinds": ["table_cell"], "columns": ["pos", "parent", "kind", "row", "col", "text"]}


# Selectors.


@query("SELECT r_regionkey AS doc_id, 1 AS depth, r_name AS title FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT n_regionkey, 2, 'Nation ' || n_nationkey FROM nation")
def sel_headings(spark, sf_dir):
    return S.select(_nodes(spark, sf_dir), ".h", range(1, 3)).select("doc_id", "depth", F.col("text").alias("title"))


@query("SELECT n_regionkey AS doc_id, 'Nation ' || n_nationkey AS title FROM nation")
def sel_h2(spark, sf_dir):
    return S.select(_nodes(spark, sf_dir), ".h2").select("doc_id", F.col("text").alias("title"))


@query("SELECT n_regionkey AS doc_id, 'l' || (n_nationkey % 3) AS lang, 'value ' || n_nationkey AS value FROM nation WHERE n_nationkey % 3 <> 2")
def sel_code_lang(spark, sf_dir):
    return S.select(_nodes(spark, sf_dir), ".code", "l0", "l1").select("doc_id", S.attribute("lang").alias("lang"), S.attribute("value").alias("value"))


@query("SELECT n_regionkey AS doc_id, 'http://n.example/' || n_nationkey AS url, 'T' AS title FROM nation")
def sel_link_url(spark, sf_dir):
    return S.select(_nodes(spark, sf_dir), ".link").select("doc_id", S.attribute("url").alias("url"), S.attribute("title").alias("title"))


@query("SELECT n_regionkey AS doc_id, 'nation ' || n_nationkey AS text FROM nation")
def sel_strong(spark, sf_dir):
    return S.select(_nodes(spark, sf_dir), ".strong").select("doc_id", "text")


@query("SELECT n_regionkey AS doc_id, 'code ' || n_nationkey AS value FROM nation")
def sel_code_inline(spark, sf_dir):
    return S.select(_nodes(spark, sf_dir), ".code_inline").select("doc_id", "value")


@query("SELECT n_regionkey AS doc_id, 1 AS level, 'inner ' || n_nationkey AS text FROM nation")
def sel_nested_items(spark, sf_dir):
    return S.select(_nodes(spark, sf_dir), ".list").where(S.attribute("level") == 1).select("doc_id", "level", "text")


@query("SELECT o_custkey AS doc_id, count(*) FILTER (o_orderstatus <> 'F') AS todo, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS task FROM orders GROUP BY 1")
def sel_tasks(spark, sf_dir):
    nodes = _nodes(spark, sf_dir, "orders", kinds=["list"], columns=["kind", "checked"])
    count = lambda s: F.count_if(F.coalesce(S.predicate(s), F.lit(False)))
    return nodes.groupBy("doc_id").agg(count(".todo").alias("todo"), count(".done").alias("done"), count(".task").alias("task"))


@query("SELECT p_brand AS doc_id, 'Name' AS text FROM part GROUP BY 1")
def sel_table_cell(spark, sf_dir):
    return S.select(_nodes(spark, sf_dir, "parts_table", **_CELLS), ".[0][1]").select("doc_id", "text")


@query("SELECT p_brand AS doc_id, 'right,none,center' AS align FROM part GROUP BY 1")
def sel_table_align(spark, sf_dir):
    return S.select(_nodes(spark, sf_dir, "parts_table", kinds=["table_align"], columns=["parent", "kind", "align"]), ".table_align").select("doc_id", F.array_join("align", ",").alias("align"))


@query("SELECT o_custkey AS doc_id, 'order ' || min(o_orderkey) AS text FROM orders GROUP BY 1")
def sel_first_item(spark, sf_dir):
    return S.select(_nodes(spark, sf_dir, "orders"), ".[0]").select("doc_id", "text")


@query("SELECT n_nationkey AS doc_id, 'inner ' || n_nationkey AS value FROM nation WHERE n_nationkey % 2 = 1")
def sel_descendant_code(spark, sf_dir):
    return S.select(_nodes(spark, sf_dir, "quotes", columns=["parent", "lft", "rgt", "kind", "lang", "value"]), ".blockquote .code").select("doc_id", "value")


@query("SELECT n_nationkey AS doc_id, 'NOTE' AS callout, 'Title ' || n_nationkey AS title FROM nation WHERE n_nationkey % 2 = 0")
def sel_callout(spark, sf_dir):
    return O.callouts(_nodes(spark, sf_dir, "quotes"), "note").select("doc_id", "callout", "title")


@query("SELECT n_nationkey AS doc_id, CAST(2 AS BIGINT) AS n FROM nation WHERE n_nationkey % 2 = 1")
def sel_children(spark, sf_dir):
    nodes = _nodes(spark, sf_dir, "quotes")
    return S.children(nodes, S.select(nodes, ".blockquote")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey AS doc_id, 'x' AS lang, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1")
def update_attribute(spark, sf_dir):
    nodes = S.set_attribute(_nodes(spark, sf_dir), ".code", "lang", "x")
    return S.select(nodes, ".code").groupBy("doc_id", "lang").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey AS doc_id, kind, n FROM (SELECT n_regionkey, count(*) AS c FROM nation GROUP BY 1), LATERAL (SELECT unnest(['heading', 'list', 'code', 'link']) AS kind, unnest([c + 1, 2 * c, c, c]) AS n)")
def count_kinds(spark, sf_dir):
    return _nodes(spark, sf_dir).where("parent is null and kind in ('heading', 'list', 'code', 'link')").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey AS doc_id, count(*) * 3 AS n FROM nation GROUP BY 1")
def grep_context(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).where("parent is null")
    return S.grep(nodes, F.col("kind") == "code", before=2).groupBy("doc_id").agg(F.count("*").alias("n"))


# Sections and tables.


@query("SELECT n_regionkey AS doc_id, 'Nation ' || n_nationkey AS title, 9 AS n_nodes FROM nation UNION ALL SELECT r_regionkey, r_name, 0 FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def sections_flat(spark, sf_dir):
    return O.sections(_nodes(spark, sf_dir)).select("doc_id", "title", F.col("n_nodes"))


@query("SELECT n_regionkey AS doc_id, 'Nation ' || n_nationkey AS title, 9 AS n_nodes FROM nation UNION ALL SELECT r_regionkey, r_name, CAST(count(*) * 10 AS INT) FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1, 2")
def sections_nested(spark, sf_dir):
    return O.sections(_nodes(spark, sf_dir), nested=True).select("doc_id", "title", F.col("n_nodes"))


@query("SELECT n_regionkey AS doc_id, '  - Nation ' || n_nationkey AS line FROM nation UNION ALL SELECT r_regionkey, '- ' || r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def toc(spark, sf_dir):
    return O.contents(_nodes(spark, sf_dir)).select("doc_id", "line")


@query("SELECT p_brand AS doc_id, CAST(p_partkey AS VARCHAR) AS key, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part")
def table_records(spark, sf_dir):
    r = O.table_records(_nodes(spark, sf_dir, "parts_table", **_CELLS))
    return r.select("doc_id", F.col("record")["Key"].alias("key"), F.col("record")["Name"].alias("name"), F.col("record")["Size"].alias("size"))


@query("SELECT p_brand AS doc_id, p_name AS value FROM part")
def table_column(spark, sf_dir):
    return O.table_column(_nodes(spark, sf_dir, "parts_table", **_CELLS), "Name").select("doc_id", "value")


@query("SELECT n_regionkey AS doc_id, 3 AS depth, 'h3' AS name, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1 UNION ALL SELECT r_regionkey, 2, 'h2', 1 FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def demote_heading(spark, sf_dir):
    return O.shift_depth(_nodes(spark, sf_dir), 1).where("kind = 'heading'").groupBy("doc_id", "depth", "name").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey AS doc_id, 'Nation ' || n_nationkey AS title FROM nation WHERE CAST(n_nationkey AS VARCHAR) LIKE '%1%'")
def section_title_contains(spark, sf_dir):
    return O.sections(_nodes(spark, sf_dir)).where(F.contains("title", F.lit("1"))).select("doc_id", "title")


@query("SELECT n_regionkey AS doc_id, 'Nation ' || n_nationkey AS title FROM nation")
def section_by_level(spark, sf_dir):
    return O.sections(_nodes(spark, sf_dir), level=2).select("doc_id", "title")


@query("SELECT n_regionkey AS doc_id, 'Nation ' || min(n_nationkey) AS title FROM nation GROUP BY 1")
def section_nth(spark, sf_dir):
    return O.sections(_nodes(spark, sf_dir)).where("section = 1").select("doc_id", "title")


@query("SELECT n_regionkey AS doc_id, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1")
def section_has_content(spark, sf_dir):
    return O.sections(_nodes(spark, sf_dir)).where("n_nodes > 0").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey AS doc_id, CAST(i AS BIGINT) AS section, CAST(CASE WHEN i = 1 THEN 1 ELSE 10 END AS BIGINT) AS n FROM (SELECT n_regionkey, unnest(range(1, count(*) + 2)) AS i FROM nation GROUP BY 1)")
def section_nodes(spark, sf_dir):
    return O.section_nodes(_nodes(spark, sf_dir)).groupBy("doc_id", "section").agg(F.count("*").alias("n"))


@query("SELECT p_brand AS doc_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS INT) AS place, p_name AS name FROM part")
def table_sort_rows(spark, sf_dir):
    rows = O.sort_rows(_nodes(spark, sf_dir, "parts_table", **_CELLS), 1)
    return rows.select("doc_id", "place", F.col("cells")[1].alias("name"))


@query("SELECT p_brand AS doc_id, p_size AS size, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1, 2")
def table_filter_rows(spark, sf_dir):
    rows = O.table_records(_nodes(spark, sf_dir, "parts_table", **_CELLS)).select("doc_id", F.col("record")["Size"].cast("int").alias("size"))
    return rows.where("size > 25").groupBy("doc_id", "size").agg(F.count("*").alias("n"))


@query("SELECT p_brand AS doc_id, CAST(p_partkey AS VARCHAR) AS key, name, value FROM (SELECT p_brand, p_partkey, p_name AS \"Name\", CAST(p_size AS VARCHAR) AS \"Size\" FROM part) UNPIVOT (value FOR name IN (\"Name\", \"Size\"))")
def table_pivot_longer(spark, sf_dir):
    r = O.table_records(_nodes(spark, sf_dir, "parts_table", **_CELLS))
    wide = r.select("doc_id", F.col("record")["Key"].alias("key"), F.col("record")["Name"].alias("Name"), F.col("record")["Size"].alias("Size"))
    return R.pivot_longer(wide, ["doc_id", "key"], ["Name", "Size"])


@query("SELECT page_id, trim(replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title FROM pages")
def html_heading(spark, sf_dir):
    """The main part's first heading, from HTML by way of Markdown."""
    from nodeloom.sources import html

    pages = html.convert(_t(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", F.regexp_extract("markdown", "^# (.*)", 1).alias("title"))


@query("SELECT page_id, CAST(len(regexp_extract_all(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<p>')) AS BIGINT) AS n FROM pages")
def html_paragraphs(spark, sf_dir):
    """Paragraphs of the main part: blocks after the heading."""
    from nodeloom.sources import html

    pages = html.convert(_t(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", (F.size(F.split("markdown", "\n\n")) - 1).cast("long").alias("n"))


@query("SELECT n_regionkey AS doc_id, CAST(count(*) * 10 + 1 AS BIGINT) AS blocks FROM nation GROUP BY 1")
def write_documents(spark, sf_dir):
    from nodeloom.sources import sinks

    texts = sinks.documents(_nodes(spark, sf_dir).withColumn("markdown", F.regexp_replace("markdown", "\n", " ")))
    return texts.select("doc_id", F.size(F.split("value", "\n")).cast("long").alias("blocks"))


# Joins.



def _sides(spark, sf_dir):
    """All orders and all customers. Keys of orders are moved by 20, and one is null, so both sides have rows without a match."""
    key = F.nullif(F.col("o_custkey"), F.lit(7)) + 20
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", key.alias("o_custkey"), F.col("o_orderstatus").alias("tag"))
    customers = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("double").alias("c_custkey"), "c_name", F.col("c_mktsegment").alias("tag"))
    return orders, customers


def _join_sql(kind: str) -> str:
    return f"SELECT o_orderkey, o_custkey, c_custkey, c_name, CASE WHEN c_custkey IS NULL THEN o.tag ELSE c.tag END AS tag FROM (SELECT o_orderkey, nullif(o_custkey, 7) + 20 AS o_custkey, o_orderstatus AS tag FROM orders) o {kind} JOIN (SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, c_mktsegment AS tag FROM customer) c ON o_custkey = c_custkey"


def _join(kind: str):
    def run(spark, sf_dir):
        orders, customers = _sides(spark, sf_dir)
        return R.join_by(orders, customers, "o_custkey", "c_custkey", kind)

    return run


for _kind in ("inner", "left", "right", "full"):
    QUERIES[f"join_by_{_kind}"], SQL[f"join_by_{_kind}"] = _join(_kind), _join_sql(_kind)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark, sf_dir):
    return R.semi(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark, sf_dir):
    return R.anti(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT k, a, b FROM (SELECT c_nationkey AS k, c_custkey AS a, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer) JOIN (SELECT s_nationkey AS k, s_suppkey AS b, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier) USING (k, i)")
def zip_join(spark, sf_dir):
    a = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("a"))
    b = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("b"))
    return R.zip_rows(a, b, "k", "a", "b")


# Aggregations.


@query("SELECT o_orderpriority AS key, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS members FROM orders GROUP BY 1")
def group_by_members(spark, sf_dir):
    return R.group_by(_t(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", "o_orderkey").select("key", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("SELECT o_orderstatus AS key, count(*) AS n FROM orders GROUP BY 1")
def tally(spark, sf_dir):
    return R.tally(_t(spark, sf_dir, "orders"), "o_orderstatus")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def unique_by_first(spark, sf_dir):
    return R.unique_by(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query("SELECT l_returnflag AS key, sum(l_quantity) AS value FROM lineitem GROUP BY 1")
def index_by_sum(spark, sf_dir):
    return R.index_by(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


@query("SELECT min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) AS mean, quantile_cont(l_quantity, 0.5) AS median, round(stddev_pop(l_quantity), 6) AS stddev, round(var_pop(l_quantity), 6) AS variance, count(l_quantity) AS count FROM lineitem")
def describe_quantity(spark, sf_dir):
    d = R.describe(_t(spark, sf_dir, "lineitem"), "l_quantity")
    return d.select("min", "max", F.round("mean", 6).alias("mean"), "median", F.round("stddev", 6).alias("stddev"), F.round("variance", 6).alias("variance"), "count")


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1")
def percentile_price(spark, sf_dir):
    found = R.percentiles(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p25": 0.25, "p90": 0.9})
    return found.select("l_returnflag", F.round("p25", 4).alias("p25"), F.round("p90", 4).alias("p90"))


@query("WITH c AS (SELECT p_size AS value, count(*) AS n FROM part GROUP BY 1) SELECT value, n FROM c WHERE n = (SELECT max(n) FROM c)")
def mode_ties(spark, sf_dir):
    return R.mode(_t(spark, sf_dir, "part"), "p_size")


@query("SELECT l_linestatus, round(exp(avg(ln(l_quantity))), 6) AS geomean FROM lineitem GROUP BY 1")
def geomean_quantity(spark, sf_dir):
    return R.geomean(_t(spark, sf_dir, "lineitem"), "l_linestatus", "l_quantity").select("l_linestatus", F.round("geomean", 6).alias("geomean"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
def count_with_total(spark, sf_dir):
    return R.count_with_total(_t(spark, sf_dir, "orders"), "o_orderstatus")


@query("SELECT bool_or(l_quantity > 49) AS any_large, bool_and(l_quantity > 0) AS all_positive, count_if(l_discount = 0) AS undiscounted FROM lineitem")
def any_all_count(spark, sf_dir):
    return R.tests(_t(spark, sf_dir, "lineitem"), {"any_large": F.col("l_quantity") > 49}, {"all_positive": F.col("l_quantity") > 0}, {"undiscounted": F.col("l_discount") == 0})


@query("SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)")
def max_by_price(spark, sf_dir):
    return R.first_by(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", largest=True)


# Runs, ranks and shapes.

_RUNS = "SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS chunk FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS new FROM events)"


@query(f"SELECT user_id, CAST(chunk AS BIGINT) AS chunk, event_type, count(*) AS n, min(event_id) AS first FROM ({_RUNS}) GROUP BY 1, 2, 3")
def chunk_by_type(spark, sf_dir):
    return R.chunk_by(_t(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("SELECT e.event_id FROM events e JOIN (SELECT user_id, coalesce(min(event_id) FILTER (event_type = 'error'), 1000000000) AS stop FROM events GROUP BY 1) s USING (user_id) WHERE e.event_id < stop")
def take_while_fine(spark, sf_dir):
    return R.take_while(_t(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") != "error").select("event_id")


@query("SELECT e.event_id FROM events e JOIN (SELECT user_id, coalesce(min(event_id) FILTER (event_type = 'error'), 1000000000) AS stop FROM events GROUP BY 1) s USING (user_id) WHERE e.event_id >= stop")
def skip_while_fine(spark, sf_dir):
    return R.skip_while(_t(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") != "error").select("event_id")


@query("SELECT user_id, event_id, a || '>' || b || '>' || c AS gram FROM (SELECT user_id, event_id, event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE c IS NOT NULL")
def ngram_events(spark, sf_dir):
    return R.ngrams(_t(spark, sf_dir, "events"), "user_id", "event_id", "event_type", 3).select("user_id", "event_id", F.array_join("gram", ">").alias("gram"))


@query("SELECT c_mktsegment, c_custkey, CAST(rank AS INT) AS rank FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def top_customers(spark, sf_dir):
    return R.top(_t(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", "c_custkey", 3).select("c_mktsegment", "c_custkey", "rank")


@query("SELECT p_partkey, name, value FROM (SELECT p_partkey, p_brand, p_type FROM part) UNPIVOT (value FOR name IN (p_brand, p_type))")
def pivot_longer(spark, sf_dir):
    return R.pivot_longer(_t(spark, sf_dir, "part"), ["p_partkey"], ["p_brand", "p_type"])


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\" FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def pivot_wider(spark, sf_dir):
    counts = _t(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return R.pivot_wider(counts, ["o_custkey"], "o_orderstatus", "n", ["F", "O"]).na.fill(0)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    return R.union(_t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, sf_dir):
    return R.intersect(_t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
def except_(spark, sf_dir):
    return R.difference(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k, 'customer' AS side FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def union_all(spark, sf_dir):
    return R.union_all(_t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("side")), _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("side")))


@query("SELECT * FROM (SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20 OFFSET 10)")
def skip_and_limit(spark, sf_dir):
    return R.page(_t(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_partkey"], 10, 20)


@query("SELECT c_custkey, coalesce(s, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey AS k, max('x') AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = k")
def update_rows(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.lit(0).alias("doc_id"), F.col("c_custkey").alias("pos"), "c_mktsegment")
    o = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.lit(0).alias("doc_id"), F.col("o_custkey").alias("pos"), F.lit("x").alias("c_mktsegment")).distinct()
    return R.update(c, o, "c_mktsegment").select(F.col("pos").alias("c_custkey"), "c_mktsegment")


@query("SELECT p_brand AS doc_id, '| p_partkey | p_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || p_partkey || ' | ' || p_name || ' |', chr(10) ORDER BY p_partkey) AS \"table\" FROM part GROUP BY 1")
def markdown_table(spark, sf_dir):
    from nodeloom.functions.formats import markdown_table as write

    return write(_t(spark, sf_dir, "part"), ["p_partkey", "p_name"], "p_brand", "p_partkey").withColumnRenamed("p_brand", "doc_id")


@query("SELECT p_partkey, p_name, round(jaro_winkler_similarity(p_name, 'blue bolt'), 6) AS score FROM part WHERE jaro_winkler_similarity(p_name, 'blue bolt') >= 0.8")
def fuzzy_filter(spark, sf_dir):
    from nodeloom.functions import fuzzy

    return fuzzy.filter_matches(_t(spark, sf_dir, "part"), "p_name", "blue bolt", 0.8).select("p_partkey", "p_name", F.round("score", 6).alias("score"))


@query("SELECT * FROM (SELECT p_partkey, levenshtein(p_name, 'blue bolt') AS score FROM part) WHERE score <= 3")
def fuzzy_levenshtein(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", F.lit("blue bolt")).cast("long").alias("score")).where("score <= 3")


@query("SELECT o_orderstatus, count(*) AS members FROM orders GROUP BY 1")
def aggregate_documents(spark, sf_dir):
    return R.tally(_t(spark, sf_dir, "orders"), "o_orderstatus").select(F.col("key").alias("o_orderstatus"), F.col("n").alias("members"))


@query("SELECT p_brand AS doc_id, p_brand || ': ' || min(p_name) AS text FROM part GROUP BY 1")
def interpolated(spark, sf_dir):
    return _t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("doc_id")).agg(F.min("p_name").alias("n")).select("doc_id", F.concat("doc_id", F.lit(": "), "n").alias("text"))


# The language.


def _language(name: str, fixture: str, text: str, sql: str) -> None:
    def run(spark, sf_dir):
        return language.run(getattr(fixtures, fixture)(spark, sf_dir), text)

    QUERIES[name], SQL[name] = run, sql


for _name, _fixture, _text, _sql in [
    ("ql_headings", "outline", ".h2 | to_text", "SELECT n_regionkey AS doc_id, 'Nation ' || n_nationkey AS value FROM nation"),
    ("ql_select_contains", "outline", '.h | select(contains("Nation 1")) | to_text | upcase', "SELECT n_regionkey AS doc_id, 'NATION ' || n_nationkey AS value FROM nation WHERE n_nationkey = 1 OR n_nationkey BETWEEN 10 AND 19"),
    ("ql_code_value", "outline", '.code("l1").value', "SELECT n_regionkey AS doc_id, 'value ' || n_nationkey AS value FROM nation WHERE n_nationkey % 3 = 1"),
    ("ql_link_url", "outline", ".link.url", "SELECT n_regionkey AS doc_id, 'http://n.example/' || n_nationkey AS value FROM nation"),
    ("ql_update", "outline", '.code | .code.lang |= "x" | .code.lang', "SELECT n_regionkey AS doc_id, 'x' AS value FROM nation"),
    ("ql_nodes_len", "outline", "nodes | len", "SELECT n_regionkey AS doc_id, CAST(1 + count(*) * 10 AS VARCHAR) AS value FROM nation GROUP BY 1"),
    ("ql_section_titles", "outline", 'nodes | section::sections | section::titles | filter(fn(t): starts_with(t, "Nation");) | len', "SELECT n_regionkey AS doc_id, CAST(count(*) AS VARCHAR) AS value FROM nation GROUP BY 1"),
    ("ql_tasks_done", "orders", "nodes | filter(fn(n): n.done;) | len | if (self > 0): self else: None", "SELECT o_custkey AS doc_id, CAST(count(*) AS VARCHAR) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1"),
    ("ql_function", "orders", 'def twice(s): to_number(ltrimstr(s, "order ")) * 2; | .list | if (is_none(self)): None else: to_string(twice(to_text(self)))', "SELECT o_custkey AS doc_id, CAST(o_orderkey * 2 AS VARCHAR) AS value FROM orders"),
    ("ql_fold", "orders", 'nodes | filter(fn(n): n.list;) | map(to_text) | map(fn(s): to_number(ltrimstr(s, "order "));) | sum | to_string', "SELECT o_custkey AS doc_id, CAST(sum(o_orderkey) AS VARCHAR) AS value FROM orders GROUP BY 1"),
    ("ql_match", "quotes", '.callout | .kind | match(self) do | "NOTE": "note" | _: None end', "SELECT n_nationkey AS doc_id, 'note' AS value FROM nation WHERE n_nationkey % 2 = 0"),
    ("ql_descendant", "quotes", "nodes | .. | filter(fn(n): n.code;) | map(to_text) | join(\",\")", "SELECT n_nationkey AS doc_id, 'inner ' || n_nationkey || ',outer ' || n_nationkey AS value FROM nation"),
    ("ql_table_sum", "parts_table", "nodes | filter(fn(n): n.[][2];) | skip(1) | map(fn(c): to_number(to_text(c));) | sum | to_string", "SELECT p_brand AS doc_id, CAST(sum(p_size) AS VARCHAR) AS value FROM part GROUP BY 1"),
]:
    _language(_name, _fixture, _text, _sql)


@query("SELECT p_name AS value FROM part WHERE contains(p_name, 'bolt')")
def stream_lines(spark, sf_dir):
    """Lines of a file source, each by itself; what one trigger over the files gives."""
    from nodeloom.streaming.lines import grep_once

    return grep_once(spark, _t(spark, sf_dir, "part").select("p_name"), "p_name", "bolt")


expressions.register(QUERIES, SQL)
language_queries.register(QUERIES, SQL)
