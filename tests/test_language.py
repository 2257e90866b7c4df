import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nodeloom.language import run as R
from nodeloom.language.evaluate import compact, evaluate, show
from nodeloom.language.grammar import QueryError, parse
from nodeloom.plans import fixtures
from nodeloom.plans import language_queries as L
from nodeloom.sources.markdown_parser import parse as markdown
from nodeloom.sources.nodes import parse_markdown

#: Programs of several steps; single functions, selectors and forms are the ql_* queries of the catalog.
VALUES = [
    # Falling back, and what counts as true.
    ("let n = None | n ?? len(\"four\")", 4),
    ('"" || 0', False),
    ('[] || "left"', "left"),
    ('"a" && [] && 1', False),
    ("{} && 7", 7),
    # Shifts of each kind.
    ("foreach(k, [0, 3, 5]): 3 << k;", [3, 24, 96]),
    ('["x"] << ["y"]', ["x", ["y"]]),
    ('"front" >> ["back"]', ["front", "back"]),
    ('"spark" << 2 | self >> 1', "ar"),
    ('"ab" >> 9', ""),
    ('foreach(d, [1, 3]): to_md_name(first(to_markdown(repeat("#", d) + " t")) << 1);', ["h1", "h2"]),
    # One level of flattening.
    ("flatten([[[1]], [2], 3])", [[1], 2, 3]),
    ('flatten("word")', "word"),
    # Functions, defaults, rest, recursion, closures.
    ("def fact(n): if (n <= 1): 1 else: n * fact(n - 1); | fact(6)", 720),
    ("def tagged(name, mark=\"#\"): mark + name; | [tagged(\"a\"), tagged(\"b\", \"@\")]", ["#a", "@b"]),
    ("def spread(head, *rest): [head, len(rest)]; | spread(9, 8, 7, 6)", [9, 3]),
    ("let k = 7 | let add_k = fn(v): v + k; | map([10, 20], add_k)", [17, 27]),
    ("def over(f, v): f(f(v)); | over(fn(v): v * v;, 3)", 81),
    ("let half = partial(fn(d, v): v / d;, 2) | map([8, 6], half)", [4, 3]),
    # Loops.
    ("var total = 0 | foreach(v, 2..5): total += v; | total", 14),
    ("var n = 27 | var steps = 0 | while (n != 1): steps += 1 | n = if (n % 2 == 0): n / 2 else: 3 * n + 1; | steps", 111),
    ('foreach(pair, {b: 2, a: 1}): s"${first(pair)}=${last(pair)}";', ["a=1", "b=2"]),
    # Matching.
    ('foreach(v, [5, "t", [1, 2], None]): match(v) do | 5: "five" | [h, ..t]: t | None: "gone" | _: "else" end;', ["five", "else", [2], "gone"]),
    ('match({kind: "ok", rows: 3}) do | {kind: "ok", rows}: rows * 2 | _: 0 end', 6),
    ("match(12) do | n if (n > 20): \"big\" | n if (n > 10): \"middle\" end", "middle"),
    # Errors.
    ('try: to_number("x1") catch: -1', -1),
    ('try: 4 / (2 - 2) catch(e): contains(e["message"], "zero")', True),
    ('foreach(v, ["3", "z"]): try: to_number(v) catch: 0;', [3, 0]),
    # Modules.
    ("module area: def square(s): s * s; def box(a, b): a * b; end | area::square(3) + area::box(2, 5)", 19),
    # Data.
    ('join_by([{k: 1, a: "x"}, {k: 2, a: "y"}], [{id: "2", b: 5}], "k", "id", "left") | map(fn(r): r["b"];)', [None, 5]),
    ('join_by([{k: None}], [{k: None}, {k: 3}], "k", "k", "full") | len', 3),
    ('{rows: [{v: 4}, {v: 9}]} | get_path(["rows", 1, "v"])', 9),
    ('set_path({}, ["a", "b"], 1) | merge_defaults(self, {a: {c: 2}, d: 3})', {"a": {"b": 1, "c": 2}, "d": 3}),
    ("describe([4, 8]) | get(\"stddev\")", 2),
    ("mode([7, 5, 7, 5, 1])", [5, 7]),
    ("uniq([1, 2 / 2, \"1\"]) | len", 2),
    ("[5 % 3, -5 % 3, 5.5 % 2]", [2, -2, 1.5]),
    ('semver::semver_satisfies("0.3.7", "~0.3.2")', True),
    ('semver::semver_sort(["2.0.0", "2.0.0-beta.2", "2.0.0-beta.11"])', ["2.0.0-beta.2", "2.0.0-beta.11", "2.0.0"]),
    ('toon::toon_stringify({n: 4}) | toon::toon_parse | toml::toml_stringify', "n = 4"),
    ('truncate("abかなcd", 5)', "abか…"),
    ('css_text("<ul><li>a<li class=x>b</ul><p class=x>c", "li.x, p")', ["b", "c"]),
    ('css("<div><p>1</p><p>2</p></div>", "div > p:last-child")', ["<p>2</p>"]),
    ('foreach(f, ["i8", "u16le", "f64be"]): unpack(f, pack(f, 5));', [5, 5, 5]),
    ('unpack("i32le", pack("i32be", 1))', 16777216),
    ('map(["yesterday", "in 2 weeks", "next monday", "last monday"], fn(t): date_relative(t, 86400 * 4) / 86400;)', [3, 18, 11, -3]),
]


@pytest.mark.parametrize("query, want", VALUES)
def test_values(query, want):
    assert evaluate(query, [None]) == [want]


DOC = "# One\n\ntext\n\n## Two\n\n- [x] a\n- b\n\n```rust\nfn\n```\n\n[l](http://x)\n\n> q\n> ```py\n> p\n> ```\n\n### T3\n"
NODES = [
    (".h", ["# One", "## Two", "### T3"]),
    (".h(1, 2)", ["# One", "## Two"]),
    ('.h | select(contains("Two"))', ["## Two"]),
    ('.code("rust").value', ["fn"]),
    (".code.lang", ["rust", "py"]),
    (".link.url", ["http://x"]),
    (".done", ["- [x] a"]),
    (".blockquote .code", ["```py\np\n```"]),
    ("nodes | len", ["9"]),
    ("nodes | section::sections | section::titles", ["One", "Two", "T3"]),
    ('.code.lang |= "go" | .code.lang', ["go", "go"]),
    (".h | increase_header_depth", ["## One", "### Two", "#### T3"]),
    (".h | to_html", ["<h1>One</h1>", "<h2>Two</h2>", "<h3>T3</h3>"]),
]


@pytest.mark.parametrize("query, want", NODES)
def test_nodes(query, want):
    assert [show(v) for v in compact(evaluate(query, markdown(DOC)))] == want


TABLE = "| K | A | B |\n| --- | --- | --- |\n| x | 2 | 3 |\n| w | 4 | 5 |\n\npara\n\n| Z |\n| --- |\n| z |\n"
TABLES = [
    ("nodes | table::tables | len", 2),
    ("nodes | table::tables | first | table::to_array | first", {"K": "x", "A": "2", "B": "3"}),
    ("nodes | table::tables | first | table::sort_rows(self, 0) | table::to_csv", "K,A,B\nw,4,5\nx,2,3"),
    ("nodes | table::tables | first | table::pivot_longer([1, 2]) | table::to_csv", "K,name,value\nx,A,2\nx,B,3\nw,A,4\nw,B,5"),
    ('nodes | table::tables | first | table::pivot_longer([1, 2]) | table::pivot_wider("name", "value") | table::to_csv', "K,A,B\nx,2,3\nw,4,5"),
    ('nodes | table::tables | first | table::add_row(["u", "6", "7"]) | table::filter_rows(fn(r): to_text(first(r)) != "x";) | table::to_csv', "K,A,B\nw,4,5\nu,6,7"),
]


@pytest.mark.parametrize("query, want", TABLES)
def test_tables(query, want):
    got = evaluate(query, markdown(TABLE))
    assert got == [want]


@pytest.mark.parametrize("query", ["f(", "no_such(1)", "1 +", "let = 1", '"a', "1 / 0", "map(1, 2, 3, 4)"])
def test_errors(query):
    with pytest.raises(QueryError):
        evaluate(query, [None])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab1 |.:;(),[]{}"+-*=<>!?#hdefn', max_size=25))
def test_parser_fails_only_as_it_says(text):
    try:
        parse(text)
    except (QueryError, RecursionError):
        pass


@pytest.mark.parametrize("query", [".h2 | to_text", '.h | select(contains("Nation 1")) | to_text | upcase', '.code("l1").value', ".link.url", ".strong", ".list", '.code | select(.lang == "l0")', 'select(contains("nation") && !contains("3")) | to_text', ".h | .depth", '.h2 | to_text | ltrimstr("Nation ") | repeat(2)', '.link.url | replace("http", "ftp") | upcase | md5', ".code.value | trim | rtrimstr(\"1\") | sha256", ".strong | to_text | ascii_upcase | slugify"])
def test_columns_give_what_the_evaluator_gives(spark, sf, query):
    docs = fixtures.outline(spark, sf)
    by_columns = R.compiled(parse_markdown(docs), query)
    assert by_columns is not None
    rows = lambda df: sorted((r.doc_id, r.value) for r in df.collect())
    assert rows(by_columns) == rows(R.evaluate(docs, query))


def test_files_modules_functions_and_time_of_the_host():
    files = {"lib/shapes.mq": b"def twice(x): x * 2;", "notes/one.md": b"---\nk: 1\n---\n# One\n", "pic.png": b"ABC"}
    assert evaluate('include "lib/shapes" | twice(4)', [None], files=files) == [8]
    assert evaluate('collection("notes") | first | get("frontmatter")', [None], files=files) == [{"k": 1}]
    assert evaluate('embed_images(first(to_markdown("![p](pic.png)"))) | extract_images | first | get("bytes") | utf8', [None], files=files) == ["ABC"]
    assert evaluate("thrice(2) + plus(1)", [None], functions={"thrice": lambda x: 3 * x, "plus": lambda a, b=10: a + b}) == [17]
    with pytest.raises(QueryError):
        evaluate('read_file("/etc/passwd")', [None], files=files)
    with pytest.raises(QueryError):
        evaluate("loop: 1;", [None], seconds=0.05)


@pytest.mark.parametrize("name", sorted(L.SELECTORS))
def test_columns_and_evaluator_agree_on_every_selector(name):
    document, query, _ = L.SELECTORS[name]
    values = compact(evaluate(query.replace("§", "3"), markdown(document.replace("§", "3"), document is L.MDX)))
    assert values


@pytest.mark.parametrize("text", [">" * 2000 + " x", "- " * 2000 + "x", "[" * 4000, "*a " * 2000 + "b*" * 2000, "[a" * 2000 + "](u)" * 2000, "![[" * 2000, "a* " * 9000])
def test_no_text_exhausts_the_parser(spark, text):
    docs = spark.createDataFrame([(1, text), (2, "# fine")], "doc_id int, text string")
    rows = parse_markdown(docs).select("doc_id", "kind", "text").collect()
    assert [(r.kind, r.text) for r in rows if r.doc_id == 2] == [("heading", "fine"), ("text", "fine")]
    assert any(r.doc_id == 1 for r in rows)


def test_an_error_stays_with_its_document(spark):
    docs = spark.createDataFrame([(1, "# 5"), (2, "# x"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: (r.value, r.error is not None) for r in R.evaluate(docs, "nodes | first | to_text | to_number | to_string").collect()}
    assert got[1] == ("5", False) and got[2][1]
