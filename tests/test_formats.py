import json
import tomllib

from hypothesis import given, settings
from hypothesis import strategies as st

from nodeloom.functions import formats as X
from nodeloom.sources import html, nodes, sinks

PLAIN = st.none() | st.booleans() | st.integers(-(2**40), 2**40) | st.text("ab ,:\"é-", max_size=5)
TREE = st.recursive(PLAIN, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abc", min_size=1, max_size=3), x, max_size=3), max_leaves=8)


@settings(max_examples=100, deadline=None)
@given(TREE)
def test_cbor_round_trip(value):
    assert X.parse_cbor(X.write_cbor(value)) == value


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.integers(0, 9) | st.text("ab ", max_size=4) | st.lists(st.integers(0, 9), max_size=3) | st.dictionaries(st.text("xy", min_size=1, max_size=2), st.integers(0, 9), max_size=2), max_size=4))
def test_toml_round_trip(value):
    assert tomllib.loads(X.write_toml(value)) == value


def test_toon():
    value = {"a": 1, "b": {"c": "x y"}, "l": [1, 2], "r": [{"i": 1, "n": "u"}, {"i": 2, "n": "v,w"}]}
    text = X.write_toon(value)
    assert text == 'a: 1\nb:\n  c: x y\nl[2]: 1,2\nr[2]{i,n}:\n  1,u\n  2,"v,w"'
    assert X.parse_toon(text) == value


def test_xml_and_yaml():
    source = '<u a="1"><n>x</n><m/></u>'
    assert X.write_xml(X.parse_xml(source)) == source
    assert X.front_matter({"a": 1}) == "---\na: 1\n---\n"


def test_html_to_markdown():
    page = '<html><head><title>T</title></head><body><nav>menu</nav><main><h1>A</h1><p>x <b>b</b> <a href="/y">l</a><br>z</p><ul><li>i<ul><li>j</li></ul></li></ul><pre><code class="language-py">1\n2</code></pre><table><tr><th>h<th>k<tr><td>1<td>2|3</table><blockquote><p>q</p></blockquote><script>no</script><p hidden>no</p></main></body>'
    got = html.to_markdown(page, "http://s.example/a/")
    assert got == "# A\n\nx **b** [l](http://s.example/y)\nz\n\n- i\n  - j\n\n```py\n1\n2\n```\n\n| h | k |\n| --- | --- |\n| 1 | 2\\|3 |\n\n> q"
    assert html.to_markdown("<body><p>x", title_as_h1=True) == "x"


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/abp \"'=!-hulitdr&;", max_size=60))
def test_html_never_fails(page):
    html.to_markdown(page)


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,b"), (2, 'q"x')], "i int, s string")
    for kind, sep in (("csv", ","), ("tsv", "\t"), ("psv", "|")):
        sinks.write(rows, f"{tmp_path}/{kind}", kind)
        assert sorted(map(tuple, nodes.read_separated(spark, f"{tmp_path}/{kind}", sep).collect())) == [("1", "a,b"), ("2", 'q"x')]
    (tmp_path / "d.md").write_text("# A\n\n- x\n")
    (tmp_path / "d.html").write_text("<main><h2>B</h2><p>y")
    (tmp_path / "d.yaml").write_text("a: [1, 2]")
    (tmp_path / "d.toml").write_text("[t]\nk = 'v'")
    (tmp_path / "d.json").write_text('{"k": 5}')
    assert [r.kind for r in nodes.read(spark, str(tmp_path / "d.md")).where("parent is null").orderBy("pos").collect()] == ["heading", "list"]
    assert [r.text for r in html.read_html(spark, str(tmp_path / "d.html")).where("parent is null").orderBy("pos").collect()] == ["B", "y"]
    for name, path, want in (("d.yaml", "$.a[1]", "2"), ("d.toml", "$.t.k", "v"), ("d.json", "$.k", "5")):
        assert nodes.read(spark, str(tmp_path / name)).selectExpr(f"variant_get(value, '{path}', 'string') as v").first().v == want
    found = sinks.documents(nodes.read(spark, str(tmp_path / "d.md"))).first().value
    assert found == "# A\n- x"
    values = spark.createDataFrame([(json.dumps({"a": 1}),)], "value string")
    sinks.write(values, f"{tmp_path}/yaml", "yaml")
    assert spark.read.text(f"{tmp_path}/yaml").first().value.strip() == "a: 1"
    sinks.write(values, "", "none")
