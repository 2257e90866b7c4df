"""Queries in the language, one for each function, selector and form, with SQL for the same values.

Function queries run over the rows of a table: its columns are variables of the query, and the value leaves as JSON. Selector
queries run over one document a nation, in which nodes of every kind stand.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.language import run
from nodeloom.plans.fixtures import table

#: By name: the query, and the SQL of its value for a row of part.
PART = {
    # Types and conditions.
    "is_array": ("is_array(if (p_size > 20): [p_size] else: p_size)", "p_size > 20"),
    "is_markdown": ("is_markdown(if (p_size > 20): to_md_text(p_name) else: p_name)", "p_size > 20"),
    "is_bool": ("is_bool(if (p_size > 20): true else: 1)", "p_size > 20"),
    "is_number": ("is_number(if (p_size > 20): p_size else: p_name)", "p_size > 20"),
    "is_string": ("is_string(if (p_size > 20): p_name else: p_size)", "p_size > 20"),
    "is_none": ("is_none(if (p_size > 20): None else: p_size)", "p_size > 20"),
    "is_dict": ("is_dict(if (p_size > 20): {a: 1} else: p_size)", "p_size > 20"),
    "is_bytes": ("is_bytes(if (p_size > 20): to_bytes(p_name) else: p_name)", "p_size > 20"),
    "is_empty": ('is_empty(if (p_size > 20): "" else: p_name)', "p_size > 20"),
    "is_nan": ("is_nan(if (p_size > 20): nan() else: p_size)", "p_size > 20"),
    "infinite": ("p_size < infinite()", "true"),
    "nan": ("is_nan(nan())", "true"),
    "arrays": ("map([p_size, [p_size]], arrays) | compact", "[[p_size]]"),
    "markdowns": ("map([p_size, to_strong(p_name)], markdowns) | compact", "['**' || p_name || '**']"),
    "booleans": ("map([p_size, true], booleans) | compact", "[true]"),
    "numbers": ("map([p_size, p_name], numbers) | compact", "[p_size]"),
    "strings": ("map([p_size, p_name], strings) | compact", "[p_name]"),
    "dicts": ("map([p_size, {a: p_size}], dicts) | compact", "[{'a': p_size}]"),
    "nones": ("map([p_size, None], nones) | compact | len", "0"),
    "bytes": ("bytes(to_bytes(p_name)) | utf8", "p_name"),
    "iterables": ("map([p_size, [1]], iterables) | compact", "[[1]]"),
    "scalars": ("map([p_size, [1]], scalars) | compact", "[p_size]"),
    "type": ("type(if (p_size > 20): p_name else: [p_size])", "CASE WHEN p_size > 20 THEN 'string' ELSE 'array' END"),
    "select": ("select(p_name, p_size > 20)", "CASE WHEN p_size > 20 THEN p_name END"),
    "default": ("default(if (p_size > 20): None else: p_size, 0)", "CASE WHEN p_size > 20 THEN 0 ELSE p_size END"),
    "coalesce": ("coalesce(if (p_size > 20): None else: p_size, -1)", "CASE WHEN p_size > 20 THEN -1 ELSE p_size END"),
    "convert": ('convert(p_name, "md5")', "md5(p_name)"),
    "to_boolean": ('to_boolean(if (p_size > 20): "true" else: "false")', "p_size > 20"),
    "to_number": ('to_number(to_string(p_size) + "5")', "p_size * 10 + 5"),
    "to_string": ("to_string([p_size, p_name])", "'[' || p_size || ', \"' || p_name || '\"]'"),
    "to_array": ("to_array(p_size)", "[p_size]"),
    "to_text": ("to_text(to_strong(p_name))", "p_name"),
    # Numbers.
    "add": ("add(p_size, p_partkey)", "p_size + p_partkey"),
    "add_strings": ("p_name + p_size", "p_name || p_size"),
    "add_arrays": ("[p_size] + [1, 2]", "[p_size, 1, 2]"),
    "add_dicts": ("{a: p_size, b: 1} + {b: 2}", "{'a': p_size, 'b': 2}"),
    "sub": ("sub(p_size, p_partkey)", "p_size - p_partkey"),
    "mul": ("mul(p_size, 3)", "p_size * 3"),
    "mul_string": ('"ab" * (p_size % 3)', "repeat('ab', p_size % 3)"),
    "div": ("div(p_size * 4, 2)", "p_size * 2"),
    "mod": ("mod(p_partkey, 7)", "p_partkey % 7"),
    "pow": ("pow(p_size, 2)", "p_size * p_size"),
    "floordiv": ("var x = p_partkey | x //= 4 | x", "p_partkey // 4"),
    "negate": ("negate(p_size)", "-p_size"),
    "abs": ("abs(p_size - 25)", "abs(p_size - 25)"),
    "ceil": ("ceil(p_size / 4)", "CAST(ceil(p_size / 4.0) AS BIGINT)"),
    "floor": ("floor(p_size / 4)", "CAST(floor(p_size / 4.0) AS BIGINT)"),
    "round": ("round(p_size / 4)", "CAST(round(p_size / 4.0) AS BIGINT)"),
    "trunc": ("trunc(0 - p_size / 4)", "CAST(trunc(-p_size / 4.0) AS BIGINT)"),
    "ln": ("round(ln(p_size + 1) * 1000)", "CAST(round(ln(p_size + 1) * 1000) AS BIGINT)"),
    "log10": ("round(log10(p_size + 1) * 1000)", "CAST(round(log10(p_size + 1) * 1000) AS BIGINT)"),
    "sqrt": ("round(sqrt(p_size) * 1000)", "CAST(round(sqrt(p_size) * 1000) AS BIGINT)"),
    "exp": ("round(exp(p_size / 10) * 100)", "CAST(round(exp(p_size / 10.0) * 100) AS BIGINT)"),
    "min": ("min(p_size, 20)", "least(p_size, 20)"),
    "max": ("max(p_size, 20)", "greatest(p_size, 20)"),
    "band": ("band(p_size, 12)", "p_size & 12"),
    "bor": ("bor(p_size, 12)", "p_size | 12"),
    "xor": ("xor(p_size, 12)", "xor(p_size, 12)"),
    "bnot": ("bnot(p_size)", "~p_size"),
    "shift_left": ("shift_left(p_size, 2)", "p_size << 2"),
    "shift_left_array": ("[p_size] << 2", "[p_size, 2]"),
    "shift_left_string": ("p_name << 3", "substr(p_name, 4)"),
    "shift_left_heading": ("(to_h(p_name, 3) << 1) | to_md_name", "'h2'"),
    "shift_right": ("shift_right(p_size, 1)", "p_size >> 1"),
    "shift_right_array": ("2 >> [p_size]", "[2, p_size]"),
    "shift_right_string": ("p_name >> 3", "left(p_name, greatest(length(p_name) - 3, 0))"),
    "shift_right_heading": ("(to_h(p_name, 6) >> 1) | to_md_name", "'h6'"),
    "eq": ("eq(p_size, 20)", "p_size = 20"),
    "ne": ("ne(p_size, 20)", "p_size <> 20"),
    "lt": ("lt(p_size, 20)", "p_size < 20"),
    "lte": ("lte(p_size, 20)", "p_size <= 20"),
    "gt": ("gt(p_size, 20)", "p_size > 20"),
    "gte": ("gte(p_size, 20)", "p_size >= 20"),
    "not": ("not(p_size > 20)", "NOT p_size > 20"),
    "and": ("and(p_size > 10, p_size < 30)", "p_size > 10 AND p_size < 30"),
    "or": ("or(p_size < 10, p_size > 30)", "p_size < 10 OR p_size > 30"),
    "and_value": ("p_size && p_name", "CASE WHEN p_size <> 0 THEN p_name END"),
    "or_value": ("None || p_name", "p_name"),
    "or_nothing": ("0 || None", "false"),
    "between": ("between(p_size, 10, 20)", "p_size BETWEEN 10 AND 20"),
    # Texts.
    "downcase": ("downcase(p_type)", "lower(p_type)"),
    "upcase": ("upcase(p_name)", "upper(p_name)"),
    "ascii_downcase": ("ascii_downcase(p_type)", "lower(p_type)"),
    "ascii_upcase": ("ascii_upcase(p_name)", "upper(p_name)"),
    "trim": ('trim("  " + p_name + " ")', "p_name"),
    "ltrim": ('ltrim("  " + p_name + " ")', "p_name || ' '"),
    "rtrim": ('rtrim("  " + p_name + " ")', "'  ' || p_name"),
    "ltrimstr": ('ltrimstr(p_name, "red ")', "CASE WHEN starts_with(p_name, 'red ') THEN substr(p_name, 5) ELSE p_name END"),
    "rtrimstr": ('rtrimstr(p_name, " bolt")', "CASE WHEN ends_with(p_name, ' bolt') THEN left(p_name, length(p_name) - 5) ELSE p_name END"),
    "contains": ('contains(p_name, "ring")', "contains(p_name, 'ring')"),
    "starts_with": ('starts_with(p_name, "blue")', "starts_with(p_name, 'blue')"),
    "ends_with": ('ends_with(p_name, "bolt")', "ends_with(p_name, 'bolt')"),
    "index": ('index(p_name, " ")', "strpos(p_name, ' ') - 1"),
    "rindex": ('rindex(p_name, "e")', "CASE WHEN contains(p_name, 'e') THEN length(p_name) - strpos(reverse(p_name), 'e') ELSE -1 END"),
    "indices": ('indices(p_name, " ")', "[strpos(p_name, ' ') - 1]"),
    "replace": ('replace(p_name, " ", "_")', "replace(p_name, ' ', '_')"),
    "gsub": ('gsub(p_name, "[aeiou]", "*")', "regexp_replace(p_name, '[aeiou]', '*', 'g')"),
    "split": ('split(p_name, " ")', "string_split(p_name, ' ')"),
    "join": ('join([p_name, p_type], "-")', "p_name || '-' || p_type"),
    "explode": ('explode("a" + p_size)', "list_transform(string_split('a' || p_size, ''), lambda x: ascii(x))"),
    "implode": ("implode(explode(p_name))", "p_name"),
    "utf8bytelen": ('utf8bytelen("é" + p_name)', "length(p_name) + 2"),
    "len": ("len(p_name)", "length(p_name)"),
    "slice": ("slice(p_name, 1, 4)", "p_name[2:4]"),
    "slice_brackets": ("p_name[-3:]", "right(p_name, 3)"),
    "regex_match": ('regex_match(p_name, "[a-z]+")', "regexp_extract_all(p_name, '[a-z]+')"),
    "is_regex_match": ('is_regex_match(p_name, "^b")', "starts_with(p_name, 'b')"),
    "is_not_regex_match": ('is_not_regex_match(p_name, "^b")', "NOT starts_with(p_name, 'b')"),
    "test": ('test(p_name, "t$")', "ends_with(p_name, 't')"),
    "match_operator": ('p_name =~ "^b"', "starts_with(p_name, 'b')"),
    "no_match_operator": ('p_name !~ "^b"', "NOT starts_with(p_name, 'b')"),
    "capture": ('capture(p_name, "(?<a>[a-z]+) (?<b>[a-z]+)")', "{'a': split_part(p_name, ' ', 1), 'b': split_part(p_name, ' ', 2)}"),
    "scan": ('scan(p_name, "[a-z]+")', "regexp_extract_all(p_name, '[a-z]+')"),
    "repeat": ('repeat("ab", p_size % 4)', "repeat('ab', p_size % 4)"),
    "word_wrap": ("word_wrap(p_name, 3)", "replace(p_name, ' ', chr(10))"),
    "truncate": ("truncate(p_name, 6)", "CASE WHEN length(p_name) > 6 THEN left(p_name, 5) || '…' ELSE p_name END"),
    "token_count": ("token_count(p_name) > 0", "true"),
    "insert": ('insert(p_name, 1, "-")', "left(p_name, 1) || '-' || substr(p_name, 2)"),
    "slugify": ('slugify("A " + p_name + "!")', "'a-' || replace(p_name, ' ', '-')"),
    "lines": ('lines(p_name + "\\n" + p_type)', "[p_name, p_type]"),
    "unlines": ("unlines([p_name, p_type])", "p_name || chr(10) || p_type"),
    "lpad": ('lpad(to_string(p_size), 5, "0")', "lpad(CAST(p_size AS VARCHAR), 5, '0')"),
    "rpad": ('rpad(to_string(p_size), 5, "0")', "rpad(CAST(p_size AS VARCHAR), 5, '0')"),
    "base64": ("base64(p_name)", "base64(encode(p_name))"),
    "base64d": ("base64d(base64(p_name))", "p_name"),
    "base64url": ("base64url(p_name)", "rtrim(replace(replace(base64(encode(p_name)), '+', '-'), '/', '_'), '=')"),
    "base64urld": ("base64urld(base64url(p_name))", "p_name"),
    "url_encode": ("url_encode(p_name)", "replace(p_name, ' ', '%20')"),
    "url_decode": ('url_decode("%41" + p_size)', "'A' || p_size"),
    "html_escape": ('html_escape("<" + p_name + "&")', "'&lt;' || p_name || '&amp;'"),
    "html_unescape": ('html_unescape("&lt;" + p_name)', "'<' || p_name"),
    "strip_tags": ('strip_tags("<b>" + p_name + "</b>")', "p_name"),
    "sanitize_html": ('sanitize_html("<b>" + p_name + "</b><script>x</script>")', "'<b>' || p_name || '</b>'"),
    "md5": ("md5(p_name)", "md5(p_name)"),
    "sha256": ("sha256(p_name)", "sha256(p_name)"),
    "sha512": ("len(sha512(p_name))", "128"),
    "to_hex": ("to_hex(p_name)", "lower(hex(p_name))"),
    "from_hex": ("from_hex(to_hex(p_name))", "p_name"),
    "to_bytes": ("len(to_bytes(p_name))", "length(p_name)"),
    "utf8": ("utf8(to_bytes(p_name))", "p_name"),
    "encode": ("encode(p_name) | len", "length(p_name)"),
    "decode": ("decode(encode(p_name))", "p_name"),
    "pack": ('pack("u16be", p_partkey) | len', "2"),
    "unpack": ('unpack("u16le", pack("u16le", p_size))', "p_size"),
    "uuid": ("len(uuid())", "36"),
    "uuid_v4": ("slice(uuid_v4(), 14, 15)", "'4'"),
    "uuid_v7": ("slice(uuid_v7(), 14, 15)", "'7'"),
    "random_string": ("len(random_string(p_size % 9))", "p_size % 9"),
    "rand": ("rand() < 1", "true"),
    "rand_int": ("between(rand_int(1, 6), 1, 6)", "true"),
    "human_bytes": ("human_bytes(1000 * (1 + p_size % 9))", "(1 + p_size % 9) || 'KB'"),
    "human_size": ("human_size(1024 * (1 + p_size % 9))", "(1 + p_size % 9) || 'KiB'"),
    "basename": ('basename("a/b/" + p_size)', "CAST(p_size AS VARCHAR)"),
    "dirname": ('dirname("a/b/" + p_size)', "'a/b'"),
    "extname": ('extname("a/b." + p_size)', "'.' || p_size"),
    "stem": ('stem("a/b" + p_size + ".x")', "'b' || p_size"),
    "path_join": ('path_join("a/b", p_name)', "'a/b/' || p_name"),
    "glob_match": ('glob_match(p_name, "b*")', "starts_with(p_name, 'b')"),
    "interpolated": ('s"${p_name}: ${p_size + 1}"', "p_name || ': ' || (p_size + 1)"),
    "intern": ("intern(p_name)", "p_name"),
    # Arrays.
    "array": ("array(p_size, p_name)", "json_array(p_size, p_name)"),
    "range": ("range(1, p_size % 5 + 1)", "range(1, p_size % 5 + 2)"),
    "range_operator": ("1..3", "[1, 2, 3]"),
    "reverse": ("reverse([1, p_size])", "[p_size, 1]"),
    "sort": ("sort([p_size, 20, p_partkey % 7])", "list_sort([p_size, 20, p_partkey % 7])"),
    "sort_by": ("sort_by([p_size, 20, p_partkey % 7], fn(x): 0 - x;)", "list_reverse_sort([p_size, 20, p_partkey % 7])"),
    "sort_natural": ('sort_natural(["a10", "a9", "a" + p_size])', "list_transform(list_sort([10, 9, p_size]), lambda x: 'a' || x)"),
    "uniq": ("uniq([1, 2, 1, p_size % 2 + 1])", "[1, 2]"),
    "unique_by": ("unique_by([1, 2, 3, 4], fn(x): x % 2;)", "[1, 2]"),
    "compact": ("compact([p_size, None, 1])", "[p_size, 1]"),
    "flatten": ("flatten([1, [p_size, [2]]])", "json('[1,' || p_size || ',[2]]')"),
    "shuffle": ("sort(shuffle([3, 1, p_size]))", "list_sort([3, 1, p_size])"),
    "sample": ("len(sample([1, 2, 3], 2))", "2"),
    "map": ("map([1, 2, p_size], fn(x): x * 2;)", "[2, 4, p_size * 2]"),
    "filter": ("filter([1, 20, p_size], fn(x): x > 10;)", "list_filter([1, 20, p_size], lambda x: x > 10)"),
    "reject": ("reject([1, 20, p_size], fn(x): x > 10;)", "list_filter([1, 20, p_size], lambda x: x <= 10)"),
    "flat_map": ("flat_map([1, p_size], fn(x): [x, x];)", "[1, 1, p_size, p_size]"),
    "compact_map": ("compact_map([1, p_size], fn(x): if (x > 10): x else: None;)", "list_filter([1, p_size], lambda x: x > 10)"),
    "each": ("each([1, p_size], fn(x): x + 1;)", "[1, p_size]"),
    "tap": ("tap(p_size, 1)", "p_size"),
    "first": ("first([p_size, 1])", "p_size"),
    "last": ("last([1, p_size])", "p_size"),
    "second": ("second([1, p_size])", "p_size"),
    "take": ("take([1, 2, p_size], 2)", "[1, 2]"),
    "skip": ("skip([1, 2, p_size], 2)", "[p_size]"),
    "take_while": ("take_while([1, p_size, 2], fn(x): x < 10;)", "CASE WHEN p_size < 10 THEN [1, p_size, 2] ELSE [1] END"),
    "skip_while": ("skip_while([1, p_size, 2], fn(x): x < 10;)", "CASE WHEN p_size < 10 THEN [] ELSE [p_size, 2] END"),
    "find_index": ("find_index([1, p_size], fn(x): x > 10;)", "CASE WHEN p_size > 10 THEN 1 ELSE -1 END"),
    "any": ("any([1, p_size], fn(x): x > 10;)", "p_size > 10"),
    "all": ("all([11, p_size], fn(x): x > 10;)", "p_size > 10"),
    "in": ("in([1, 20, 30], p_size)", "p_size IN (1, 20, 30)"),
    "count_by": ("count_by([1, 20, p_size], fn(x): x > 10;)", "len(list_filter([1, 20, p_size], lambda x: x > 10))"),
    "fold": ("fold([1, 2, p_size], 10, fn(a, x): a + x;)", "p_size + 13"),
    "partition": ("partition([1, 20, p_size], fn(x): x > 10;)", "[list_filter([1, 20, p_size], lambda x: x > 10), list_filter([1, 20, p_size], lambda x: x <= 10)]"),
    "group_by": ("group_by([1, 2, 3], fn(x): x % 2 == 0;)", "{'false': [1, 3], 'true': [2]}"),
    "frequencies_by": ("frequencies_by([1, 2, 3], fn(x): x % 2 == 0;)", "{'false': 2, 'true': 1}"),
    "tally": ('tally(["a", "b", "a"])', "{'a': 2, 'b': 1}"),
    "index_by": ("index_by([1, 2, p_size], fn(x): \"k\";)", "{'k': p_size + 3}"),
    "chunk_by": ("chunk_by([1, 3, 2, p_size * 2], fn(x): x % 2;)", "[[1, 3], [2, p_size * 2]]"),
    "chunks": ("chunks([1, 2, p_size], 2)", "[[1, 2], [p_size]]"),
    "ngram": ("ngram([1, 2, p_size], 2)", "[[1, 2], [2, p_size]]"),
    "zip": ("zip([1, 2], [p_size, 4])", "[[1, p_size], [2, 4]]"),
    "transpose": ("transpose([[1, 2], [p_size, 4]])", "[[1, p_size], [2, 4]]"),
    "fill": ("fill(p_size, 2)", "[p_size, p_size]"),
    "times": ("times(p_size, 3)", "[p_size, p_size, p_size]"),
    "bsearch": ("bsearch([1, 2, 3], 2)", "1"),
    "min_by": ("min_by([5, p_size, 20], fn(x): x;)", "least(5, p_size, 20)"),
    "max_by": ("max_by([5, p_size, 20], fn(x): x;)", "greatest(5, p_size, 20)"),
    "pluck": ('pluck([{a: 1}, {a: p_size}], "a")', "[1, p_size]"),
    "identity": ("identity(p_size)", "p_size"),
    "inspect": ("inspect(p_size)", "p_size"),
    "spread": ("[1, ...[2, p_size]]", "[1, 2, p_size]"),
    "get": ("get([1, p_size], 1)", "p_size"),
    "set": ("set([1, 2], 1, p_size)", "[1, p_size]"),
    "del": ("del([1, p_size], 0)", "[p_size]"),
    "join_by": ('join_by([{id: p_size, n: 1}], [{k: 20, g: 2}], "id", "k") | len', "CASE WHEN p_size = 20 THEN 1 ELSE 0 END"),
    "nth": ("[1, 2, p_size] | .[2]", "p_size"),
    "union_all": ("[1, p_size] + [1]", "[1, p_size, 1]"),
    # Maps.
    "dict": ('dict([["a", p_size]])', "{'a': p_size}"),
    "keys": ("keys({b: 1, a: 2})", "['a', 'b']"),
    "values": ("values({b: 1, a: p_size})", "[p_size, 1]"),
    "entries": ("entries({a: p_size})", "json_array(json_array('a', p_size))"),
    "from_entries": ('from_entries([["a", p_size]])', "{'a': p_size}"),
    "with_entries": ("with_entries({a: p_size}, fn(e): [first(e) + \"x\", last(e) + 1];)", "{'ax': p_size + 1}"),
    "update": ("update(p_size, 5)", "5"),
    "get_or": ('get_or({a: p_size}, "b", 7)', "7"),
    "pick": ('pick({a: p_size, b: 1}, ["a"])', "{'a': p_size}"),
    "omit": ('omit({a: p_size, b: 1}, ["b"])', "{'a': p_size}"),
    "has": ('has({a: 1}, "a")', "true"),
    "get_path": ('get_path({a: {b: p_size}}, ["a", "b"])', "p_size"),
    "set_path": ('set_path({a: {b: 1}}, ["a", "b"], p_size)', "{'a': {'b': p_size}}"),
    "del_path": ('del_path({a: {b: 1, c: p_size}}, ["a", "b"])', "{'a': {'c': p_size}}"),
    "del_paths": ('del_paths({a: 1, b: {c: 2, d: p_size}}, [["a"], ["b", "c"]])', "{'b': {'d': p_size}}"),
    "paths": ("paths({a: {b: p_size}})", "[['a', 'b']]"),
    "merge_with": ('merge_with({a: 1}, {a: p_size, b: 2}, "replace")', "{'a': p_size, 'b': 2}"),
    "merge_defaults": ("merge_defaults({a: p_size}, {a: 1, b: 2})", "{'a': p_size, 'b': 2}"),
    "walk": ("walk([1, [p_size]], fn(x): if (is_number(x)): x + 1 else: x;)", "json('[2,[' || (p_size + 1) || ']]')"),
    "property": ('{a: p_size} | ."a"', "p_size"),
    "property_of_array": ('[{a: p_size}, {a: 1}] | ."a"', "[p_size, 1]"),
    "recursive": ("[[p_size], 1] | .. | len", "2"),
    "dict_spread": ("{...{a: 1}, b: p_size}", "{'a': 1, 'b': p_size}"),
    "in_dict": ('{a: p_size} | contains(self, "a")', "true"),
    # Statistics.
    "sum": ("sum([1, 2, p_size])", "p_size + 3"),
    "sum_by": ("sum_by([1, p_size], fn(x): x * 2;)", "2 + p_size * 2"),
    "mean": ("mean([p_size, p_size + 2])", "p_size + 1"),
    "geomean": ("round(geomean([p_size, p_size]) * 100)", "p_size * 100"),
    "variance": ("variance([p_size, p_size + 2])", "1"),
    "stddev": ("stddev([p_size, p_size + 4])", "2"),
    "percentile": ("percentile([p_size, p_size + 2], 0.5)", "p_size + 1"),
    "mode": ("mode([1, p_size + 1, p_size + 1])", "[p_size + 1]"),
    "describe": ('describe([p_size, p_size + 2]) | get("median")', "p_size + 1"),
    # Functions of functions.
    "partial": ("def f(a, b): a * 10 + b; | let g = partial(f, p_size) | g(3)", "p_size * 10 + 3"),
    "comp": ("let f = comp(fn(x): x + 1;, fn(x): x * 2;) | f(p_size)", "p_size * 2 + 1"),
    "juxt": ("let f = juxt(fn(x): x + 1;, fn(x): x * 2;) | f(p_size)", "[p_size + 1, p_size * 2]"),
    "flip": ("flip(fn(a, b): a - b;, 1, p_size)", "p_size - 1"),
    "complement": ("let f = complement(fn(x): x > 20;) | f(p_size)", "NOT p_size > 20"),
    "dynamic_call": ("let f = fn(x): x + 1; | f(p_size)", "p_size + 1"),
    # Forms.
    "let": ("let x = p_size | x + 1", "p_size + 1"),
    "var": ("var x = 1 | x = p_size | x", "p_size"),
    "assign_ops": ("var x = p_size | x += 4 | x -= 1 | x *= 2 | x", "(p_size + 3) * 2"),
    "as": ("p_size as x | x * 2", "p_size * 2"),
    "block": ("do p_size | self + 1 end", "p_size + 1"),
    "paren": ("(p_size + 1) * 2", "(p_size + 1) * 2"),
    "if": ('if (p_size > 20): "a" elif (p_size > 10): "b" else: "c"', "CASE WHEN p_size > 20 THEN 'a' WHEN p_size > 10 THEN 'b' ELSE 'c' END"),
    "unless": ("unless (p_size > 20): p_size", "CASE WHEN p_size > 20 THEN NULL ELSE p_size END"),
    "while": ("var i = 0 | while (i < p_size): i += 1 | i; | i", "p_size"),
    "until": ("var i = 0 | until (i >= p_size): i += 1 | i; | i", "p_size"),
    "loop": ("var i = 0 | loop: i += 1 | if (i > 5): break else: i; | i", "6"),
    "foreach": ("foreach(x, [1, p_size]): x * 2;", "[2, p_size * 2]"),
    "break": ("foreach(x, [1, 2, 3]): if (x == 2): break else: x;", "[1]"),
    "continue": ("foreach(x, [1, 2, 3]): if (x == 2): continue else: x;", "[1, 3]"),
    "match": ('match(p_size % 3) do | 0: "zero" | 1: "one" | _: "two" end', "CASE p_size % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'two' END"),
    "match_array": ("match([1, p_size]) do | [a, b]: b end", "p_size"),
    "try": ("try: error(\"x\") catch: p_size", "p_size"),
    "error": ('try: error("e" + p_size) catch(e): e["message"]', "'e' || p_size"),
    "coalesce_operator": ("None ?? p_size", "p_size"),
    "not_operator": ("!(p_size > 20)", "NOT p_size > 20"),
    "minus": ("-p_size", "-p_size"),
    "def_defaults": ("def f(a, b=2): a + b; | f(p_size)", "p_size + 2"),
    "def_rest": ("def f(a, *r): len(r); | f(1, p_size, 3)", "2"),
    "module": ("module m: def f(x): x + 1; end | m::f(p_size)", "p_size + 1"),
    "nodes": ("p_size | nodes", "p_size"),
    "self": ("p_size | self + 1", "p_size + 1"),
    "pipe": ("p_size | add(1) | mul(2)", "(p_size + 1) * 2"),
    "get_variable": ('let x = p_size | get_variable("x")', "p_size"),
    "set_variable": ('set_variable("x", p_size) | get_variable("x")', "p_size"),
    "all_symbols": ("len(all_symbols()) > 300", "true"),
    "is_debug_mode": ("is_debug_mode()", "false"),
    "assert": ("assert(p_size >= 0)", "true"),
    "halt": ("if (p_size > 20): halt() else: p_size", "CASE WHEN p_size > 20 THEN NULL ELSE p_size END"),
    "halt_error": ('try: halt_error("x") catch: p_size', "p_size"),
    "print": ("print(p_size)", "p_size"),
    "debug": ("debug(p_size)", "p_size"),
    "stderr": ("stderr(p_size)", "p_size"),
    "breakpoint": ("breakpoint() | p_size", "p_size"),
    # Dates, as seconds since 1970.
    "now": ("now() > 1700000000", "true"),
    "from_date": ('from_date("1970-01-02T00:00:00Z") + p_size', "86400 + p_size"),
    "to_date": ('to_date(86400 * p_size, "%d")', "strftime(make_timestamp(CAST(86400000000 * CAST(p_size AS BIGINT) AS BIGINT)), '%d')"),
    "to_date_iso8601": ("to_date_iso8601(86400 * p_size)", "strftime(make_timestamp(CAST(86400000000 * CAST(p_size AS BIGINT) AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ')"),
    "gmtime": ('gmtime(86400 * p_size) | get("month")', "month(make_timestamp(CAST(86400000000 * CAST(p_size AS BIGINT) AS BIGINT)))"),
    "localtime": ('localtime(86400 * p_size) | get("year")', "1970"),
    "mktime": ("mktime(gmtime(86400 * p_size))", "86400 * p_size"),
    "strftime": ('strftime(86400 * p_size, "%Y-%m")', "strftime(make_timestamp(CAST(86400000000 * CAST(p_size AS BIGINT) AS BIGINT)), '%Y-%m')"),
    "strptime": ('strptime("1970-01-02", "%Y-%m-%d") + p_size', "86400 + p_size"),
    "date_add": ('date_add(0, p_size, "days")', "86400 * p_size"),
    "date_diff": ('date_diff(0, 86400 * p_size, "days")', "p_size"),
    "date_relative": ('date_relative(to_string(p_size) + " days ago", 8640000)', "8640000 - 86400 * p_size"),
    # Formats.
    "json_parse": ('json::json_parse("{\\"a\\": " + p_size + "}")', "{'a': p_size}"),
    "json_stringify": ("json::json_stringify([p_size, 1])", "'[' || p_size || ', 1]'"),
    "json_to_markdown_table": ("json::json_to_markdown_table([{a: p_size}])", "'| a |' || chr(10) || '| --- |' || chr(10) || '| ' || p_size || ' |'"),
    "yaml_parse": ('yaml::yaml_parse("a: " + p_size)', "{'a': p_size}"),
    "yaml_stringify": ("yaml::yaml_parse(yaml::yaml_stringify({a: p_size}))", "{'a': p_size}"),
    "yaml_to_json": ("yaml::yaml_to_json({a: p_size})", "'{\"a\": ' || p_size || '}'"),
    "yaml_to_markdown_table": ("yaml::yaml_to_markdown_table({a: p_size})", "'| Key | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| a | ' || p_size || ' |'"),
    "to_front_matter": ("yaml::to_front_matter({a: p_size}) | frontmatter(to_markdown(self))", "{'a': p_size}"),
    "to_frontmatter": ("yaml::to_frontmatter({a: p_size}) | frontmatter(to_markdown(self))", "{'a': p_size}"),
    "frontmatter": ('frontmatter(to_markdown("---\\na: " + p_size + "\\n---\\n"))', "{'a': p_size}"),
    "toml_parse": ('toml::toml_parse("a = " + p_size)', "{'a': p_size}"),
    "toml_stringify": ("toml::toml_stringify({a: p_size}) | trim", "'a = ' || p_size"),
    "toml_to_json": ("toml::toml_to_json({a: p_size})", "'{\"a\": ' || p_size || '}'"),
    "toml_to_markdown_table": ("toml::toml_to_markdown_table({a: p_size})", "'| Key | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| a | ' || p_size || ' |'"),
    "toon_parse": ('toon::toon_parse("a: " + p_size)', "{'a': p_size}"),
    "toon_stringify": ("toon::toon_stringify({a: p_size})", "'a: ' || p_size"),
    "xml_parse": ('xml::xml_parse("<a>" + p_size + "</a>") | get("text")', "CAST(p_size AS VARCHAR)"),
    "xml_stringify": ('xml::xml_stringify(xml::xml_parse("<a>" + p_size + "</a>"))', "'<a>' || p_size || '</a>'"),
    "xml_to_markdown_table": ("xml::xml_to_markdown_table([{a: p_size}])", "'| a |' || chr(10) || '| --- |' || chr(10) || '| ' || p_size || ' |'"),
    "gron_parse": ('gron::gron_parse("json = {};\\njson.a = " + p_size + ";")', "{'a': p_size}"),
    "cbor_parse": ("cbor::cbor_parse(cbor::cbor_stringify({a: p_size}))", "{'a': p_size}"),
    "cbor_stringify": ("is_bytes(cbor::cbor_stringify([p_size]))", "true"),
    "csv_parse": ('csv::csv_parse("a,b\\n" + p_size + ",2", true)', "[{'a': CAST(p_size AS VARCHAR), 'b': '2'}]"),
    "tsv_parse": ('csv::tsv_parse("a\\tb\\n" + p_size + "\\t2", true)', "[{'a': CAST(p_size AS VARCHAR), 'b': '2'}]"),
    "psv_parse": ('csv::psv_parse("a|b\\n" + p_size + "|2", true)', "[{'a': CAST(p_size AS VARCHAR), 'b': '2'}]"),
    "csv_parse_with_delimiter": ('csv::csv_parse_with_delimiter("a;b\\n" + p_size + ";2", ";", true)', "[{'a': CAST(p_size AS VARCHAR), 'b': '2'}]"),
    "csv_needs_quote": ('csv::csv_needs_quote(p_name + ",", ",")', "true"),
    "csv_stringify": ('csv::csv_stringify([{a: p_size, b: "x"}], ",")', "'a,b' || chr(10) || p_size || ',x'"),
    "csv_to_json": ("csv::csv_to_json([{a: p_size}])", "'[{\"a\": ' || p_size || '}]'"),
    "csv_to_markdown_table": ("csv::csv_to_markdown_table([{a: p_size}])", "'| a |' || chr(10) || '| --- |' || chr(10) || '| ' || p_size || ' |'"),
    # Fuzzy matches and versions.
    "levenshtein": ('fuzzy::levenshtein(p_name, "blue bolt")', "levenshtein(p_name, 'blue bolt')"),
    "jaro": ('round(fuzzy::jaro(p_name, "blue bolt") * 1000)', "CAST(round(jaro_similarity(p_name, 'blue bolt') * 1000) AS BIGINT)"),
    "jaro_winkler": ('round(fuzzy::jaro_winkler(p_name, "blue bolt") * 1000)', "CAST(round(jaro_winkler_similarity(p_name, 'blue bolt') * 1000) AS BIGINT)"),
    "fuzzy_match": ('fuzzy::fuzzy_match([p_name, "blue bolt"], "blue bolt") | first | get("text")', "'blue bolt'"),
    "fuzzy_match_levenshtein": ('fuzzy::fuzzy_match_levenshtein([p_name], "blue bolt") | first | get("score")', "levenshtein(p_name, 'blue bolt')"),
    "fuzzy_match_jaro": ('fuzzy::fuzzy_match_jaro([p_name], p_name) | first | get("score")', "1"),
    "fuzzy_filter": ('fuzzy::fuzzy_filter([p_name, "blue bolt"], "blue bolt", 1) | last | get("text")', "'blue bolt'"),
    "fuzzy_best_match": ('fuzzy::fuzzy_best_match([p_name, "blue bolt"], "blue bolt") | get("text")', "'blue bolt'"),
    "semver_parse": ('semver::semver_parse("1." + p_size + ".3") | get("minor")', "p_size"),
    "semver_to_string": ('semver::semver_to_string(semver::semver_parse("1." + p_size + ".3"))', "'1.' || p_size || '.3'"),
    "semver_compare": ('semver::semver_compare("1." + p_size + ".0", "1.20.0")', "sign(p_size - 20)"),
    "semver_gt": ('semver::semver_gt("1." + p_size + ".0", "1.20.0")', "p_size > 20"),
    "semver_lt": ('semver::semver_lt("1." + p_size + ".0", "1.20.0")', "p_size < 20"),
    "semver_eq": ('semver::semver_eq("1." + p_size + ".0", "1.20.0")', "p_size = 20"),
    "semver_gte": ('semver::semver_gte("1." + p_size + ".0", "1.20.0")', "p_size >= 20"),
    "semver_lte": ('semver::semver_lte("1." + p_size + ".0", "1.20.0")', "p_size <= 20"),
    "semver_bump_major": ('semver::semver_bump_major(to_string(p_size) + ".2.3")', "(p_size + 1) || '.0.0'"),
    "semver_bump_minor": ('semver::semver_bump_minor("1." + p_size + ".3")', "'1.' || (p_size + 1) || '.0'"),
    "semver_bump_patch": ('semver::semver_bump_patch("1.2." + p_size)', "'1.2.' || (p_size + 1)"),
    "semver_sort": ('semver::semver_sort(["1.10.0", "1." + p_size + ".0", "1.9.0"])', "list_transform(list_sort([10, p_size, 9]), lambda x: '1.' || x || '.0')"),
    "semver_max": ('semver::semver_max(["1.10.0", "1." + p_size + ".0"])', "'1.' || greatest(10, p_size) || '.0'"),
    "semver_min": ('semver::semver_min(["1.10.0", "1." + p_size + ".0"])', "'1.' || least(10, p_size) || '.0'"),
    "semver_satisfies": ('semver::semver_satisfies("1." + p_size + ".0", ">=1.20.0")', "p_size >= 20"),
    # Building nodes, and what they are.
    "is_h": ("is_h(if (p_size > 20): to_h(p_name, 2) else: to_strong(p_name))", "p_size > 20"),
    **{f"is_h{i}": (f"is_h{i}(to_h(p_name, 1 + p_size % 6))", f"p_size % 6 = {i - 1}") for i in range(1, 7)},
    "is_h_level": ("is_h_level(to_h(p_name, 1 + p_size % 6), 3)", "p_size % 6 = 2"),
    **{
        f"is_{name}": (f"is_{name}(if (p_size > 20): {yes} else: to_hr())" if name != "hr" else f"is_{name}(if (p_size > 20): {yes} else: to_strong(p_name))", "p_size > 20")
        for name, yes in {
            "em": "to_em(p_name)", "strong": "to_strong(p_name)", "html": 'to_md_html("<b>")', "code": 'to_code(p_name, "x")', "code_block": 'to_code(p_name, "x")', "text": "to_md_text(p_name)", "p": "to_md_text(p_name)",
            "list": "to_md_list(p_name, 0)", "list_item": "to_md_list(p_name, 0)", "callout": 'to_callout(p_name, "note")', "link": 'to_link("u", p_name, "t")', "image": 'to_image("u", p_name, "t")',
            "blockquote": "to_blockquote(p_name)", "hr": "to_hr()", "footnote": 'to_footnote(p_name, "f")', "footnote_ref": 'to_footnote_ref("f")', "math": "to_math(p_name)", "math_inline": "to_math_inline(p_name)",
            "code_inline": "to_code_inline(p_name)", "strikethrough": "to_delete(p_name)", "hardbreak": "to_break()", "table_cell": "to_md_table_cell(p_name, 0, 0)", "table_align": 'to_md_table_align(["left"])',
            "table": 'to_md_table_align(["left"])', "task_list_item": 'first(to_markdown("- [x] a"))', "yaml": 'first(to_markdown("---\\na: 1\\n---\\n"))', "toml": 'first(to_markdown("+++\\na = 1\\n+++\\n"))',
            "mdx": 'first(to_mdx("{x}"))', "mdx_flow_expression": 'first(to_mdx("{x}"))', "mdx_jsx_flow_element": 'first(to_mdx("<A />"))', "mdx_js_esm": 'first(to_mdx("import a from 1"))',
            "mdx_text_expression": 'last(to_mdx("a {x}"))', "mdx_jsx_text_element": 'last(to_mdx("a <B />"))',
        }.items()
    },
    "is_table_row": ("is_table_row(to_strong(p_name))", "false"),
    "is_softbreak": ("is_softbreak(to_strong(p_name))", "false"),
    "to_h": ("to_h(p_name, 2)", "'## ' || p_name"),
    "md_h": ("md::h(p_name, 3)", "'### ' || p_name"),
    "to_code": ('to_code(p_name, "x")', "'```x' || chr(10) || p_name || chr(10) || '```'"),
    "md_code": ('md::code(p_name, "y")', "'```y' || chr(10) || p_name || chr(10) || '```'"),
    "to_code_inline": ("to_code_inline(p_name)", "'`' || p_name || '`'"),
    "md_code_inline": ("md::code_inline(p_name)", "'`' || p_name || '`'"),
    "to_md_text": ("to_md_text(p_name)", "p_name"),
    "md_text": ("md::text(p_name)", "p_name"),
    "to_strong": ("to_strong(p_name)", "'**' || p_name || '**'"),
    "md_strong": ("md::strong(p_name)", "'**' || p_name || '**'"),
    "to_em": ("to_em(p_name)", "'*' || p_name || '*'"),
    "md_em": ("md::em(p_name)", "'*' || p_name || '*'"),
    "to_delete": ("to_delete(p_name)", "'~~' || p_name || '~~'"),
    "md_delete": ("md::delete(p_name)", "'~~' || p_name || '~~'"),
    "to_blockquote": ("to_blockquote(p_name)", "'> ' || p_name"),
    "md_blockquote": ("md::blockquote(p_name)", "'> ' || p_name"),
    "to_callout": ('to_callout(p_name, "note")', "'> [!NOTE]' || chr(10) || '> ' || p_name"),
    "md_callout": ('md::callout(p_name, "tip")', "'> [!TIP]' || chr(10) || '> ' || p_name"),
    "to_hr": ("to_hr()", "'---'"),
    "md_hr": ("md::hr()", "'---'"),
    "to_break": ("to_md_name(to_break())", "'break'"),
    "md_linebreak": ("to_md_name(md::linebreak())", "'break'"),
    "md_br": ("to_md_name(md::br())", "'text'"),
    "to_math": ("to_math(p_name)", "'$$' || chr(10) || p_name || chr(10) || '$$'"),
    "md_math": ("md::math(p_name)", "'$$' || chr(10) || p_name || chr(10) || '$$'"),
    "to_math_inline": ("to_math_inline(p_name)", "'$' || p_name || '$'"),
    "md_math_inline": ("md::math_inline(p_name)", "'$' || p_name || '$'"),
    "to_link": ('to_link("u", p_name, "t")', "'[' || p_name || '](u \"t\")'"),
    "md_link": ('md::link("u", p_name, "")', "'[' || p_name || '](u)'"),
    "to_image": ('to_image("u", p_name, "t")', "'![' || p_name || '](u \"t\")'"),
    "md_image": ('md::image("u", p_name, "")', "'![' || p_name || '](u)'"),
    "to_footnote": ('to_footnote(p_name, "f")', "'[^f]: ' || p_name"),
    "md_footnote": ('md::footnote(p_name, "f")', "'[^f]: ' || p_name"),
    "to_footnote_ref": ('to_footnote_ref("f" + p_size)', "'[^f' || p_size || ']'"),
    "md_footnote_ref": ('md::footnote_ref("f" + p_size)', "'[^f' || p_size || ']'"),
    "to_definition": ('to_definition("u", "d" + p_size)', "'[d' || p_size || ']: u'"),
    "md_definition": ('md::definition("u", "d" + p_size)', "'[d' || p_size || ']: u'"),
    "to_md_html": ('to_md_html("<b>")', "'<b>'"),
    "md_html": ('md::html("<b>")', "'<b>'"),
    "to_md_list": ("to_md_list(p_name, 1)", "'  - ' || p_name"),
    "md_list": ("md::list(p_name, 0)", "'- ' || p_name"),
    "to_md_table_row": ("to_md_table_row([p_name, p_type]) | len", "2"),
    "md_table_row": ("md::table_row([p_name]) | first | to_text", "p_name"),
    "to_md_table_cell": ("to_md_table_cell(p_name, 1, 2) | .column", "2"),
    "md_table_cell": ("md::table_cell(p_name, 1, 2) | .row", "1"),
    "to_md_table_align": ('to_md_table_align(["left"]) | .align', "['left']"),
    "md_table_align": ('md::table_align(["right"]) | .align', "['right']"),
    "md_table": ('md::table(["a"], [[p_name]]) | to_markdown_string', "'| a |' || chr(10) || '| --- |' || chr(10) || '| ' || p_name || ' |'"),
    "md_doc": ("md::doc(to_h(p_name, 1), to_md_text(p_type)) | to_markdown_string", "'# ' || p_name || chr(10) || chr(10) || p_type"),
    "to_md_fragment": ("to_md_fragment(to_h(p_name, 1)) | to_markdown_string", "'# ' || p_name"),
    "to_md_name": ("to_md_name(to_h(p_name, 1 + p_size % 6))", "'h' || (1 + p_size % 6)"),
    "to_markdown": ('to_markdown("# " + p_name) | first | to_text', "p_name"),
    "to_mdx": ('to_mdx("# " + p_name) | first | to_text', "p_name"),
    "from_html": ('from_html("<h2>" + p_name + "</h2>") | first', "'## ' || p_name"),
    "to_markdown_string": ("to_markdown_string([to_h(p_name, 2)])", "'## ' || p_name"),
    "to_html": ("to_html(to_strong(p_name))", "'<strong>' || p_name || '</strong>'"),
    "attr": ('attr(to_h(p_name, 2), "depth")', "2"),
    "set_attr": ('set_attr(to_h(p_name, 2), "depth", 4)', "'#### ' || p_name"),
    "set_children": ("set_children(to_strong(p_name), [to_md_text(p_type)])", "'**' || p_type || '**'"),
    "get_title": ('get_title(to_link("u", p_name, "t" + p_size))', "'t' || p_size"),
    "get_url": ('get_url(to_link("u" + p_size, p_name, "t"))', "'u' || p_size"),
    "matches_url": ('matches_url(to_link("u" + p_size, p_name, "t"), "u20")', "p_size = 20"),
    "set_check": ('set_check(first(to_markdown("- [ ] " + p_name)), true)', "'- [x] ' || p_name"),
    "set_list_ordered": ('set_list_ordered(first(to_markdown("- " + p_name)), true)', "'1. ' || p_name"),
    "set_code_block_lang": ('set_code_block_lang(to_code(p_name, "x"), "z") | .lang', "'z'"),
    "set_ref": ('set_ref(to_footnote_ref("f"), "g" + p_size)', "'[^g' || p_size || ']'"),
    "get_location": ('to_markdown("\\n# " + p_name) | first | get_location | get("start_line")', "2"),
    "increase_header_depth": ("increase_header_depth(to_h(p_name, 2))", "'### ' || p_name"),
    "decrease_header_depth": ("decrease_header_depth(to_h(p_name, 2))", "'# ' || p_name"),
    "demote_heading": ("demote_heading(to_h(p_name, 6))", "'###### ' || p_name"),
    "promote_heading": ("promote_heading(to_h(p_name, 1))", "'# ' || p_name"),
    "increase_header_level": ("increase_header_level(to_h(p_name, 2))", "'### ' || p_name"),
    "decrease_header_level": ("decrease_header_level(to_h(p_name, 2))", "'# ' || p_name"),
    "token_compress": ('to_markdown("One " + p_name + ". Two more words here.") | token_compress(5) | to_markdown_string', "'One ' || p_name || '.'"),
    "css": ('css("<p><b>" + p_name + "</b></p>", "p > b")', "['<b>' || p_name || '</b>']"),
    "css_text": ('css_text("<p class=a>" + p_name + "</p>", "p.a")', "[p_name]"),
    "css_attr": ('css_attr("<a href=u" + p_size + ">x</a>", "a", "href")', "['u' || p_size]"),
    "embed_images": ('embed_images(to_image("u" + p_size, "a", ""))', "'![a](u' || p_size || ')'"),
    "extract_images": ('extract_images(to_image("data:image/png;base64,QUJD", "a", "")) | first | get("type")', "'image/png'"),
    "read_file": ('read_file("notes/a.md") | len', "15"),
    "read_file_bytes": ('read_file_bytes("notes/a.md") | len', "15"),
    "file_exists": ('file_exists("notes/" + p_size)', "false"),
    "file_size": ('file_size("notes/a.md") + p_size', "15 + p_size"),
    "load_markdown": ('load_markdown("notes/a.md") | first | to_text', "'Note'"),
    "collection": ('collection("notes") | map(fn(d): d["title"];)', "['Note']"),
    "import_file": ('import "tools" | tools::plus(p_size)', "p_size + 1"),
    "host_function": ("thrice(p_size)", "p_size * 3"),
    # Sections and tables, of documents made of the row.
    **{
        f"section_{name}": (f'to_markdown("# A\\n\\n" + p_name + "\\n\\n## B" + p_size + "\\n\\nx\\n\\n# C\\n") | {query}', sql)
        for name, (query, sql) in {
            "sections": ("section::sections | len", "3"),
            "section": ('section::section("B") | len', "1"),
            "title": ("section::sections | second | section::title", "'B' || p_size"),
            "titles": ("section::sections | section::titles", "['A', 'B' || p_size, 'C']"),
            "content": ("section::sections | first | section::content | map(to_text)", "[p_name]"),
            "body": ("section::sections | first | section::body | map(to_text)", "[p_name]"),
            "bodies": ("section::sections | section::bodies | map(len)", "[1, 1, 0]"),
            "all_nodes": ("section::sections | first | section::all_nodes | len", "2"),
            "level": ("section::sections | map(section::level)", "[1, 2, 1]"),
            "by_level": ("section::sections | section::by_level(2) | section::titles", "['B' || p_size]"),
            "nth": ("section::sections | section::nth(2) | section::title", "'C'"),
            "toc": ("section::sections | section::toc | len", "3"),
            "has_content": ("section::sections | map(section::has_content)", "[true, true, false]"),
            "collect": ("section::sections | section::collect | len", "5"),
            "split": ("section::split(1) | len", "2"),
            "title_contains": ('section::sections | section::title_contains("B") | len', "1"),
            "title_match": ('section::sections | section::title_match("^B\\\\d+$") | len', "1"),
            "filter_sections": ("section::filter_sections(fn(s): section::has_content(s);) | len", "2"),
            "map_sections": ("section::map_sections(fn(h, c): to_text(h);)", "['A', 'B' || p_size, 'C']"),
        }.items()
    },
    **{
        f"table_{name}": (f'to_markdown("| K | V |\\n| --- | --- |\\n| b | " + p_size + " |\\n| a | 2 |\\n") | table::tables | {query}', sql)
        for name, (query, sql) in {
            "tables": ("len", "1"),
            "to_array": ("first | table::to_array | first", "{'K': 'b', 'V': CAST(p_size AS VARCHAR)}"),
            "to_csv": ("first | table::to_csv", "'K,V' || chr(10) || 'b,' || p_size || chr(10) || 'a,2'"),
            "to_markdown": ("first | table::to_markdown | to_markdown_string", "'| K | V |' || chr(10) || '| --- | --- |' || chr(10) || '| b | ' || p_size || ' |' || chr(10) || '| a | 2 |'"),
            "add_row": ('first | table::add_row(["c", "3"]) | table::to_csv', "'K,V' || chr(10) || 'b,' || p_size || chr(10) || 'a,2' || chr(10) || 'c,3'"),
            "add_column": ('first | table::add_column(["W", "x", "y"]) | table::to_csv', "'K,V,W' || chr(10) || 'b,' || p_size || ',x' || chr(10) || 'a,2,y'"),
            "remove_row": ("first | table::remove_row(1) | table::to_csv", "'K,V' || chr(10) || 'b,' || p_size"),
            "remove_column": ("first | table::remove_column(0) | get(\"rows\") | first | len", "1"),
            "map_rows": ("first | table::map_rows(fn(r): reverse(r);) | table::to_csv", "'K,V' || chr(10) || p_size || ',b' || chr(10) || '2,a'"),
            "filter_rows": ('first | table::filter_rows(fn(r): to_text(first(r)) == "b";) | table::to_csv', "'K,V' || chr(10) || 'b,' || p_size"),
            "filter_tables": ("table::filter_tables(fn(h, r): len(r) > 1;) | len", "1"),
            "sort_rows": ("first | table::sort_rows(self, 0) | table::to_csv", "'K,V' || chr(10) || 'a,2' || chr(10) || 'b,' || p_size"),
            "set_align": ('first | table::set_align(["left", "right"]) | table::to_markdown | to_markdown_string | contains(":---")', "true"),
            "pivot_longer": ("first | table::pivot_longer([1]) | table::to_csv", "'K,name,value' || chr(10) || 'b,V,' || p_size || chr(10) || 'a,V,2'"),
            "pivot_wider": ('first | table::pivot_wider("K", "V") | table::to_csv | contains("b,a")', "true"),
        }.items()
    },
    # Checks.
    **{
        f"test_{name}": (f"try: do test::{name}({given}) | true end catch: false", sql)
        for name, (given, sql) in {
            "assert": ("p_size > 20", "p_size > 20"), "assert_true": ("p_size > 20", "p_size > 20"), "assert_false": ("p_size > 20", "p_size <= 20"), "assert_eq": ("p_size, 20", "p_size = 20"), "assert_ne": ("p_size, 20", "p_size <> 20"),
            "assert_none": ("if (p_size > 20): None else: 1", "p_size > 20"), "assert_not_none": ("if (p_size > 20): None else: 1", "p_size <= 20"), "assert_contains": ("[20, 30], p_size", "p_size IN (20, 30)"),
            "assert_len": ("p_name, 9", "length(p_name) = 9"), "assert_empty": ('if (p_size > 20): "" else: p_name', "p_size > 20"), "assert_not_empty": ('if (p_size > 20): "" else: p_name', "p_size <= 20"),
            "assert_type": ('if (p_size > 20): p_name else: 1, "string"', "p_size > 20"), "assert_field": ('if (p_size > 20): {a: 1} else: {b: 1}, "a"', "p_size > 20"), "assert_matches": ('p_name, "^b"', "starts_with(p_name, 'b')"),
        }.items()
    },
    "test_run_tests": ('test::run_tests([test::test_case("t", fn(): test::assert(p_size > 20);)])', "p_size > 20"),
    "test_case": ('test::test_case("t" + p_size, fn(): true;) | get("name")', "'t' || p_size"),
    "test_run_test": ('test::_run_test("t", fn(): test::assert(p_size > 20);) | get("status")', "CASE WHEN p_size > 20 THEN 'passed' ELSE 'failed' END"),
    "test_diff": ('_diff(p_name, p_name) | len', "1"),
}

FILES = {"notes/a.md": b"# Note\n\nwritten", "notes/b.txt": b"x", "tools.mq": b"def plus(x): x + 1;"}
HOST = {"thrice": lambda x: 3 * x}

GALLERY = """---
title: n§
---

# H1 §

## H2 §

### H3 §

#### H4 §

##### H5 §

###### H6 §

Text *em §* **st §** ~~del §~~ `ci §` $mi §$ [link §](http://l/§ "T§") ![alt §](http://i/§ "I§") [ref §][id§] ![iref §][iid§] [[wiki §]] ![[embed §]] foot[^f§] <b>

[id§]: http://d/§ "D§"

[^f§]: note §

- [ ] todo §
- [x] done §
- plain §
  - inner §

1. ord §

> quote §

> [!NOTE] call §
> body §

---

```lang§ meta§
code §
```

    indented §

$$
math §
$$

| A§ | B |
| :-- | --: |
| c§ | d§ |

<div>html §</div>
"""
MDX = "import a§ from 'x'\n\n{flow§}\n\n<Block>\n\ninner §\n\n</Block>\n\ntext {expr§} <Inline§ />\n"
TOML = "+++\na = §\n+++\n\n# T§\n\nline one  \nline two §\n"

#: By name: the document, the query, and SQL for its values, of one nation each.
SELECTORS = {
    **{f"h{i}": (GALLERY, f".h{i} | to_text", f"'H{i} ' || n") for i in range(1, 7)},
    "heading": (GALLERY, "nodes | filter(fn(n): n.heading;) | len", "6"),
    "h_levels": (GALLERY, ".h(2) | to_text", "'H2 ' || n"),
    "h_range": (GALLERY, "nodes | filter(fn(n): n.h(1..3);) | len", "3"),
    "yaml": (GALLERY, ".yaml.value", "'title: n' || n"),
    "toml": (TOML, ".toml.value", "'a = ' || n"),
    "break": (TOML, "nodes | .. | filter(fn(n): n.break;) | len", "1"),
    "br": (TOML, "nodes | .. | filter(fn(n): n.br;) | len", "1"),
    "emphasis": (GALLERY, ".emphasis | to_text", "'em ' || n"),
    "strong": (GALLERY, ".strong | to_text", "'st ' || n"),
    "delete": (GALLERY, ".delete | to_text", "'del ' || n"),
    "code_inline": (GALLERY, ".code_inline | to_text", "'ci ' || n"),
    "inline_code": (GALLERY, ".inline_code.value", "'ci ' || n"),
    "math_inline": (GALLERY, ".math_inline.value", "'mi ' || n"),
    "inline_math": (GALLERY, ".inline_math | to_text", "'mi ' || n"),
    "link": (GALLERY, f".link(\"http://l/§\") | to_text", "'link ' || n"),
    "link_url": (GALLERY, "nodes | filter(fn(n): n.link.title;) | first | .url", "'http://l/' || n"),
    "link_title": (GALLERY, "nodes | filter(fn(n): n.link.title;) | first | .title", "'T' || n"),
    "image": (GALLERY, ".image.url", "'http://i/' || n"),
    "image_alt": (GALLERY, ".image.alt", "'alt ' || n"),
    "image_title": (GALLERY, ".image.title", "'I' || n"),
    "link_ref": (GALLERY, ".link_ref | to_text", "'ref ' || n"),
    "link_ref_ident": (GALLERY, ".link_ref.ident", "'id' || n"),
    "link_ref_label": (GALLERY, ".link_ref.label", "'id' || n"),
    "link_ref_argument": (GALLERY, '.link_ref("id§").ident', "'id' || n"),
    "image_ref": (GALLERY, ".image_ref.ident", "'iid' || n"),
    "image_ref_argument": (GALLERY, '.image_ref("iid§").alt', "'iref ' || n"),
    "wikilink": (GALLERY, ".wikilink.url", "'wiki ' || n"),
    "embed": (GALLERY, ".embed.url", "'embed ' || n"),
    "footnote": (GALLERY, ".footnote | to_text", "'note ' || n"),
    "footnote_ident": (GALLERY, '.footnote("f§").ident', "'f' || n"),
    "footnote_ref": (GALLERY, ".footnote_ref.ident", "'f' || n"),
    "footnote_ref_argument": (GALLERY, '.footnote_ref("f§").label', "'f' || n"),
    "definition": (GALLERY, ".definition.url", "'http://d/' || n"),
    "definition_argument": (GALLERY, '.definition("id§").title', "'D' || n"),
    "html": (GALLERY, "nodes | filter(fn(n): n.html;) | map(to_text) | last", "'<div>html ' || n || '</div>'"),
    "task": (GALLERY, "nodes | filter(fn(n): n.task;) | len", "2"),
    "todo": (GALLERY, ".todo | to_text", "'todo ' || n"),
    "done": (GALLERY, ".done | to_text", "'done ' || n"),
    "checked": (GALLERY, ".done | .checked", "'true'"),
    "list": (GALLERY, "nodes | filter(fn(n): n.list;) | len", "5"),
    "list_index": (GALLERY, ".[2] | to_text", "'plain ' || n"),
    "list_ordered": (GALLERY, "nodes | filter(fn(n): n.list.ordered;) | map(to_text) | first", "'ord ' || n"),
    "list_level": (GALLERY, "nodes | filter(fn(n): n.list.level == 1;) | map(to_text) | first", "'inner ' || n"),
    "index": (GALLERY, "nodes | filter(fn(n): n.list.index == 2;) | map(to_text) | first", "'plain ' || n"),
    "blockquote": (GALLERY, ".blockquote | to_text", "'quote ' || n"),
    "callout": (GALLERY, ".callout.title", "'call ' || n"),
    "callout_kind": (GALLERY, ".callout.kind", "'NOTE'"),
    "horizontal_rule": (GALLERY, "nodes | filter(fn(n): n.horizontal_rule;) | len", "1"),
    "hr": (GALLERY, "nodes | filter(fn(n): n.hr;) | len", "1"),
    "code": (GALLERY, '.code("lang§").value', "'code ' || n"),
    "code_block": (GALLERY, "nodes | filter(fn(n): n.code_block;) | len", "2"),
    "lang": (GALLERY, ".code.lang", "'lang' || n"),
    "meta": (GALLERY, ".code.meta", "'meta' || n"),
    "fence": (GALLERY, "nodes | filter(fn(n): n.code.fence;) | map(to_text) | first", "'code ' || n"),
    "math": (GALLERY, ".math.value", "'math ' || n"),
    "table": (GALLERY, "nodes | filter(fn(n): n.table;) | len", "5"),
    "table_cell": (GALLERY, ".[1][0] | to_text", "'c' || n"),
    "table_row": (GALLERY, "nodes | filter(fn(n): n.[1][];) | map(to_text) | last", "'d' || n"),
    "table_column": (GALLERY, "nodes | filter(fn(n): n.[][0];) | map(to_text) | first", "'A' || n"),
    "table_align": (GALLERY, ".table_align | .align | join(\",\")", "'left,right'"),
    "column": (GALLERY, ".[1][1].column", "'1'"),
    "row": (GALLERY, ".[1][1].row", "'1'"),
    "text": (GALLERY, "nodes | filter(fn(n): n.text;) | map(to_text) | map(trim) | first", "'Text'"),
    "paragraph": (GALLERY, "nodes | filter(fn(n): n.paragraph;) | len | if (self > 5): \"many\" else: \"few\"", "'many'"),
    "value": (GALLERY, ".strong.value", "'st ' || n"),
    "values": (GALLERY, "nodes | filter(fn(n): n.strong;) | first | .values | first | to_text", "'st ' || n"),
    "children": (GALLERY, "nodes | filter(fn(n): n.blockquote;) | first | .children | len", "1"),
    "cn": (GALLERY, "nodes | filter(fn(n): n.callout;) | first | .cn | map(to_text) | first", "'body ' || n"),
    "depth": (GALLERY, ".h3.depth", "'3'"),
    "level": (GALLERY, ".h4.level", "'4'"),
    "name": (MDX, ".mdx_jsx_flow_element.name", "'Block'"),
    "mdx_js_esm": (MDX, ".mdx_js_esm.value", "'import a' || n || ' from ''x'''"),
    "mdx_flow_expression": (MDX, ".mdx_flow_expression.value", "'flow' || n"),
    "mdx_jsx_flow_element": (MDX, ".mdx_jsx_flow_element | to_text", "'inner ' || n"),
    "mdx_text_expression": (MDX, ".mdx_text_expression.value", "'expr' || n"),
    "mdx_jsx_text_element": (MDX, ".mdx_jsx_text_element.name", "'Inline' || n"),
    "update_url": (GALLERY, '.image | .image.url |= "u" | .image.url', "'u'"),
    "descendant": (GALLERY, ".callout .text | map(to_text) | first", "'body ' || n"),
    "recursive": (GALLERY, "nodes | .. | filter(fn(n): n.strong;) | len", "1"),
}


def _over_part(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf_dir):
        rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
        return run.over_rows(rows, text, files=FILES, functions=HOST).select("p_partkey", "value")

    return query


def _over_nations(document: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf_dir):
        n = F.col("n_nationkey").cast("string")
        docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.replace(F.lit(document), F.lit("§"), n).alias("text"))
        wanted = text
        if "§" in text:  # an argument that names the document: those of all nations, of which each document has its own
            keys = sorted(r.doc_id for r in docs.select("doc_id").collect())
            wanted = re.sub(r'"([^"]*)§"', lambda m: ", ".join(f'"{m.group(1)}{k}"' for k in keys), text)
        return run.run(docs, wanted, mdx=document is MDX)

    return query


def register(queries: dict, sql: dict) -> None:
    for name, (text, value) in PART.items():
        queries[f"ql_fn_{name}"] = _over_part(text)
        sql[f"ql_fn_{name}"] = f"SELECT p_partkey, coalesce(CAST(to_json({value}) AS VARCHAR), 'null') AS value FROM part"
    for name, (document, text, value) in SELECTORS.items():
        queries[f"ql_sel_{name}"] = _over_nations(document, text)
        sql[f"ql_sel_{name}"] = f"SELECT n_nationkey AS doc_id, CAST({value} AS VARCHAR) AS value FROM (SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS n FROM nation)"
