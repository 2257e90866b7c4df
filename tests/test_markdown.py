from hypothesis import given, settings
from hypothesis import strategies as st

from nodeloom.functions import formats, fuzzy
from nodeloom.sources.markdown_parser import document, inline, parse

KINDS = lambda text, **k: [n.kind for n in parse(text, **k)]


def test_blocks():
    text = "---\na: 1\n---\n# T\n\npara *em* **st**\n\n- a\n- [x] b\n  - c\n\n1. o\n\n| A | B |\n|:-|-:|\n| 1 | 2 |\n\n> [!NOTE] Hey\n> body\n\n> q\n\n```py m\nx\n```\n\n$$\ny\n$$\n\n---\n\n[^1]: foot\n[id]: http://d \"T\"\n"
    kinds = KINDS(text)
    assert kinds == ["yaml", "heading", "text", "emphasis", "text", "strong", "list", "list", "list", "list", "table_cell", "table_cell", "table_align", "table_cell", "table_cell", "callout", "blockquote", "code", "math", "hr", "footnote", "definition"]


def test_attributes():
    code = parse("```py title=x\n1\n```")[0].attributes
    assert (code["lang"], code["meta"], code["value"], code["fence"]) == ("py", "title=x", "1", True)
    items = [n.attributes for n in parse("- [ ] a\n- [x] b\n  - c\n- d")]
    assert [(i["checked"], i["level"], i["idx"]) for i in items] == [(False, 0, 0), (True, 0, 1), (None, 1, 0), (None, 0, 2)]
    assert [c.attributes["align"] for c in parse("| a | b |\n| :-: | - |\n") if c.kind == "table_align"] == [["center", "none"]]


def test_inline():
    assert [n.kind for n in inline('[l](http://x "t") ![i](u) `c` ~~d~~ [[w]] ![[e]] $m$ [^1] <b> https://a.b')][::2] == ["link", "image", "code_inline", "delete", "wikilink", "embed", "math_inline", "footnoteref", "html", "link"]
    assert [n.kind for n in inline("**a *b* c**")] == ["strong"]
    assert [n.kind for n in inline("snake_case_word")] == ["text"]
    assert [n.kind for n in inline("a  \nb")] == ["text", "break", "text"]


def test_setext_and_indented_code():
    assert KINDS("T\n===\n\n    code\n\npara\n---") == ["heading", "code", "heading"]


def test_mdx():
    assert KINDS("import a from 'b'\n\n<Box>\n\n# h\n\n</Box>\n\n{1 + 1}", mdx=True) == ["mdx_js_esm", "mdx_jsx_flow_element", "mdx_flow_expression"]


def test_renders_what_it_parses():
    text = "# T\n\n- a\n- [x] b\n\n| A | B |\n| --- | ---: |\n| 1 | 2 |\n\n> q\n\n```py\nx\n```"
    assert document(parse(text)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab#*_`[]()!>|-1. \n\t$~\\<&\"'{}:^", max_size=60))
def test_never_fails(text):
    for mdx in (False, True):
        document(parse(text, mdx))


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab .\"", max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab-", min_size=1, max_size=3), x, max_size=3), max_leaves=8))
def test_gron_round_trip(value):
    assert formats.parse_gron(formats.write_gron(value)) == value


def test_formats():
    assert formats.parse_csv('a,b\n1,"x,\ny"\n') == [{"a": "1", "b": "x,\ny"}]
    assert formats.parse_yaml("a: 1\n---\nb: 2\n") == [{"a": 1}, {"b": 2}]
    assert formats.parse_xml("<u><n i='1'>x</n></u>")["children"][0] == {"tag": "n", "attributes": {"i": "1"}, "children": [], "text": "x"}
    assert formats.write_csv([{"a": 1, "b": "x,y"}]) == 'a,b\n1,"x,y"'


def test_fuzzy_ends():
    assert fuzzy.jaro_winkler_of("", "") == 1 and fuzzy.jaro_winkler_of("a", "") == 0
    assert round(fuzzy.jaro_winkler_of("martha", "marhta"), 4) == 0.9611
