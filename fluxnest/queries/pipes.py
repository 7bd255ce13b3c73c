"""Queries of the pipeline language, one for each construct and builtin, over orders with their items.

TYPED ones return typed arrays or values. INTERPRETED ones return JSON texts: they are compiled too where that can be done, and run in
the interpreter otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..pipeline.compile import Untyped
from ..pipeline.run import as_json, compile_pipeline, interpret, pipeline
from ..sources.nested import events_by_user, orders_nested
from .nested import ORDERS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_K = "list_transform(items, lambda x: x.l_partkey)"
_Q = "list_transform(items, lambda x: x.l_quantity)"
_F = "list_transform(items, lambda x: x.l_returnflag)"
_FIRST = "items[1]"
# Quantities in the order of the narrower items that interpreted programs read.
_SENT = "list_transform(list_sort(list_transform(items, lambda x: {'a': x.l_linenumber, 'b': x.l_partkey, 'c': x.l_quantity, 'd': x.l_returnflag})), lambda x: x.c)"
#: name -> (program, SQL of its outputs as a list over the nested table n)
TYPED: dict[str, tuple[str, str]] = {
    "identity": (".o_orderkey | .", "[o_orderkey]"),
    "field_chain": (".items[0].l_partkey", "[items[1].l_partkey]"),
    "iterate": (".items[].l_partkey", _K),
    "index_negative": (".items[-1].l_partkey", "[items[-1].l_partkey]"),
    "collect": ("[.items[].l_quantity]", f"[{_Q}]"),
    "comma": (".o_orderkey, .o_custkey", "[o_orderkey, o_custkey]"),
    "pipe": (".items[] | .l_partkey | . + 1", "list_transform(items, lambda x: x.l_partkey + 1)"),
    "select": (".items[] | select(.l_quantity > 25) | .l_partkey", "list_transform(list_filter(items, lambda x: x.l_quantity > 25), lambda x: x.l_partkey)"),
    "compare": (".items[] | .l_partkey >= 100", "list_transform(items, lambda x: x.l_partkey >= 100)"),
    "and": (".items[] | .l_discount and .l_tax", "list_transform(items, lambda x: x.l_discount <> 0 AND x.l_tax <> 0)"),
    "or": (".items[] | .l_discount or .l_tax", "list_transform(items, lambda x: x.l_discount <> 0 OR x.l_tax <> 0)"),
    "not": (".items[] | .l_discount | not", "list_transform(items, lambda x: x.l_discount = 0)"),
    "literal": ('.items[] | .l_returnflag + "x"', "list_transform(items, lambda x: x.l_returnflag || 'x')"),
    "empty": (".items[] | select(.l_quantity < 0) | .l_partkey, empty", "CAST([] AS BIGINT[])"),
    "as": (".o_custkey as $c | .items[] | .l_partkey + $c", "list_transform(items, lambda x: x.l_partkey + o_custkey)"),
    "if": ('if .o_totalprice > 200000 then "high" elif .o_totalprice > 50000 then "mid" else "low" end', "[CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END]"),
    "alternative": (".items[0].l_discount // 0.5", "[coalesce(nullif(items[1].l_discount, 0), 0.5)]"),
    "arithmetic": (".items[] | .l_extendedprice * (1 - .l_discount)", "list_transform(items, lambda x: x.l_extendedprice * (1 - x.l_discount))"),
    "integer_division": (".items[] | .l_partkey / 7, .l_partkey % 7", "flatten(list_transform(items, lambda x: [x.l_partkey // 7, x.l_partkey % 7]))"),
    "negate": (".items[] | -.l_partkey", "list_transform(items, lambda x: -x.l_partkey)"),
    "reduce": ("reduce .items[] as $i (0; . + $i.l_quantity)", f"[coalesce(list_sum({_Q}), 0.0)]"),
    "foreach": ("[foreach .items[] as $i (0; . + $i.l_linenumber)]", "[list_transform(items, lambda x, i: CAST(list_sum(list_transform(items[1:i], lambda y: y.l_linenumber)) AS BIGINT))]"),
    "def": ("def net(d): .l_extendedprice * (1 - d); .items[] | net(.l_discount)", "list_transform(items, lambda x: x.l_extendedprice * (1 - x.l_discount))"),
    "object": (".items[] | {part: .l_partkey, qty: .l_quantity} | .part + .qty", "list_transform(items, lambda x: x.l_partkey + x.l_quantity)"),
    "interpolate": (r'"order \(.o_orderkey): \(.items[].l_returnflag)"', f"['order ' || o_orderkey || ': ' || array_to_string({_F}, '')]"),
    "length": (".items | length", "[CAST(len(items) AS BIGINT)]"),
    "utf8bytelength": (".o_orderpriority | utf8bytelength", "[strlen(o_orderpriority)]"),
    "type": (".items[0].l_returnflag | type", "[CASE WHEN len(items) = 0 THEN 'null' ELSE 'string' END]"),
    "keys": (".items | keys", "[list_transform(items, lambda x, i: i - 1)]"),
    "add": ("[.items[].l_partkey] | add", f"[CASE WHEN len(items) > 0 THEN CAST(list_sum({_K}) AS BIGINT) END]"),
    "add_strings": ("[.items[].l_returnflag] | add", f"[CASE WHEN len(items) > 0 THEN array_to_string({_F}, '') END]"),
    "tostring": (".o_orderkey | tostring", "[CAST(o_orderkey AS VARCHAR)]"),
    "tonumber": (".o_orderkey | tonumber", "[o_orderkey]"),
    "not_null": (".items[0].l_partkey | not_null", "CASE WHEN len(items) > 0 THEN [items[1].l_partkey] ELSE [] END"),
    "strings": (".items[0].l_returnflag | strings", "CASE WHEN len(items) > 0 THEN [items[1].l_returnflag] ELSE [] END"),
    "numbers": (".o_custkey | numbers", "[o_custkey]"),
    "booleans": ("(.o_custkey > 5) | booleans", "[o_custkey > 5]"),
    "nulls": (".items[0].l_partkey | nulls", "CASE WHEN len(items) = 0 THEN [NULL::BIGINT] ELSE [] END"),
    "scalars": (".o_custkey | scalars", "[o_custkey]"),
    "arrays": (".items | arrays | length", "[CAST(len(items) AS BIGINT)]"),
    "iterables": (".items | iterables | length", "[CAST(len(items) AS BIGINT)]"),
    "ascii_downcase": (".o_orderpriority | ascii_downcase", "[lower(o_orderpriority)]"),
    "ascii_upcase": (".o_orderpriority | ascii_upcase", "[upper(o_orderpriority)]"),
    "ltrimstr": ('.o_orderpriority | ltrimstr("1-")', "[CASE WHEN starts_with(o_orderpriority, '1-') THEN substr(o_orderpriority, 3) ELSE o_orderpriority END]"),
    "rtrimstr": ('.o_orderpriority | rtrimstr("H")', "[CASE WHEN suffix(o_orderpriority, 'H') THEN left(o_orderpriority, -1) ELSE o_orderpriority END]"),
    "startswith": ('.o_orderpriority | startswith("1")', "[starts_with(o_orderpriority, '1')]"),
    "endswith": ('.o_orderpriority | endswith("H")', "[suffix(o_orderpriority, 'H')]"),
    "split": ('.o_orderpriority | split("-")', "[string_split(o_orderpriority, '-')]"),
    "join": ('[.items[].l_returnflag] | join(";")', f"[coalesce(array_to_string({_F}, ';'), '')]"),
    "test": ('.o_orderpriority | test("^[12]-")', "[regexp_matches(o_orderpriority, '^[12]-')]"),
    "gsub": ('.o_orderpriority | gsub("([A-Z])"; "<$1>")', r"[regexp_replace(o_orderpriority, '([A-Z])', '<\1>', 'g')]"),
    "explode": (".o_orderstatus | explode", "[[CAST(unicode(o_orderstatus) AS BIGINT)]]"),
    "map": (".items | map(.l_quantity * 2)", "[list_transform(items, lambda x: x.l_quantity * 2)]"),
    "sort": ("[.items[].l_partkey] | sort", f"[list_sort({_K})]"),
    "sort_by": ("[.items | sort_by(.l_extendedprice) | .[].l_extendedprice]", "[list_sort(list_transform(items, lambda x: x.l_extendedprice))]"),
    "group_by": (".items | group_by(.l_returnflag) | map(length)", f"[list_transform(list_sort(list_distinct({_F})), lambda f: CAST(len(list_filter(items, lambda x: x.l_returnflag = f)) AS BIGINT))]"),
    "unique": ("[.items[].l_returnflag] | unique", f"[list_sort(list_distinct({_F}))]"),
    "unique_by": ("[.items | unique_by(.l_returnflag) | .[].l_returnflag] | sort", f"[list_sort(list_distinct({_F}))]"),
    "min_by": (".items | min_by(.l_extendedprice) | .l_extendedprice", "[list_min(list_transform(items, lambda x: x.l_extendedprice))]"),
    "max_by": (".items | max_by(.l_extendedprice) | .l_extendedprice", "[list_max(list_transform(items, lambda x: x.l_extendedprice))]"),
    "min": ("[.items[].l_partkey] | min", f"[list_min({_K})]"),
    "max": ("[.items[].l_partkey] | max", f"[list_max({_K})]"),
    "any": ("[.items[].l_discount] | any", "[coalesce(list_bool_or(list_transform(items, lambda x: x.l_discount <> 0)), false)]"),
    "all": ("[.items[].l_discount] | all", "[coalesce(list_bool_and(list_transform(items, lambda x: x.l_discount <> 0)), true)]"),
    "any_of": (".items | any(.l_quantity > 40)", "[len(list_filter(items, lambda x: x.l_quantity > 40)) > 0]"),
    "all_of": (".items | all(.l_quantity > 5)", "[len(list_filter(items, lambda x: NOT x.l_quantity > 5)) = 0]"),
    "limit": ("limit(2; .items[].l_partkey)", f"({_K})[1:2]"),
    "first": ("[.items[].l_partkey] | first", f"[({_K})[1]]"),
    "last": ("[.items[].l_partkey] | last", f"[({_K})[-1]]"),
    "first_of": ("first(.items[].l_partkey)", f"({_K})[1:1]"),
    "last_of": ("last(.items[].l_partkey)", f"({_K})[-1:]"),
    "nth": ("[.items[].l_partkey] | nth(1)", f"[({_K})[2]]"),
    "flatten": ("[[.items[].l_partkey], [.o_custkey]] | flatten", f"[list_concat({_K}, [o_custkey])]"),
    "reverse": ("[.items[].l_partkey] | reverse", f"[list_reverse({_K})]"),
    "contains": ('.o_orderpriority | contains("GE")', "[contains(o_orderpriority, 'GE')]"),
    "inside": ('"GE" as $x | .o_orderstatus | inside("FOX")', "[contains('FOX', o_orderstatus)]"),
    "range": (".items | length | range", "list_transform(items, lambda x, i: i - 1)"),
    "floor": (".items[] | .l_extendedprice | floor", "list_transform(items, lambda x: CAST(floor(x.l_extendedprice) AS BIGINT))"),
    "ceil": (".items[] | .l_extendedprice | ceil", "list_transform(items, lambda x: CAST(ceil(x.l_extendedprice) AS BIGINT))"),
    "round": (".items[] | .l_quantity / 2 | round", "list_transform(items, lambda x: CAST(round(x.l_quantity / 2) AS BIGINT))"),
    "fabs": (".o_custkey | -. | fabs", "[CAST(o_custkey AS DOUBLE)]"),
    "sqrt": (".o_custkey | sqrt", "[sqrt(o_custkey)]"),
    # The last bit of a logarithm is each library's own: both sides give nine digits after the point, as whole numbers.
    "log": ("(.o_custkey + 1) | log * 1000000000 | round", "[CAST(round(ln(o_custkey + 1) * 1000000000) AS BIGINT)]"),
    "pow": ("[.o_custkey, 2] | pow", "[pow(o_custkey, 2)]"),
    "isnan": (".o_totalprice | isnan", "[isnan(o_totalprice)]"),
    "isinfinite": (".o_totalprice | isinfinite", "[isinf(o_totalprice)]"),
    "isnormal": (".o_totalprice | isnormal", "[o_totalprice <> 0]"),
    "csv": ("[.o_orderstatus, .o_orderpriority] | @csv", "[o_orderstatus || ',' || o_orderpriority]"),
    "tsv": ("[.o_orderstatus, .o_orderpriority] | @tsv", "[o_orderstatus || chr(9) || o_orderpriority]"),
    "html": ('(.o_orderstatus + "<&>") | @html', "[o_orderstatus || '&lt;&amp;&gt;']"),
    "uri": ('(.o_orderstatus + " /*~") | @uri', "[o_orderstatus || '+%2F%2A~']"),
    "base64": (".o_orderpriority | @base64", "[base64(encode(o_orderpriority))]"),
    "text": (".o_orderkey | @text", "[CAST(o_orderkey AS VARCHAR)]"),
    "debug": (".o_orderkey | debug", "[o_orderkey]"),
}
_JSON = "['[' || array_to_string({}, ',') || ']']".format
_DOUBLED = "list_transform(range(0, 11), lambda k: (o_custkey + 1) * (1 << k))"
#: name -> (program, SQL of its outputs as JSON texts, or None)
INTERPRETED: dict[str, tuple[str, str | None]] = {
    "values_object": ("{a: .o_orderkey, b: .o_custkey} | values", "['[' || o_orderkey || ',' || o_custkey || ']']"),
    "try_catch": ('try error("no " + .o_orderstatus) catch .', "['\"no ' || o_orderstatus || '\"']"),
    "optional": ("[.o_orderkey[]?]", "['[]']"),
    "label_break": ("label $done | reduce .items[] as $i (0; if . > 50 then break $done else . + $i.l_quantity end)", f"[CASE WHEN len(items) = 0 THEN '0' ELSE CAST(coalesce(list_filter(list_transform(range(1, len(items)), lambda k: list_sum(({_SENT})[1:k])), lambda x: x > 50)[1], list_sum({_Q})) AS VARCHAR) END]"),
    "def_recursive": ("def f: if . > 1000 then . else . * 2 | f end; (.o_custkey + 1) | f", "[CAST(list_filter(list_transform(range(0, 11), lambda k: (o_custkey + 1) * (1 << k)), lambda x: x > 1000)[1] AS VARCHAR)]"),
    "path": ("[path(.o_custkey)] | length", "['1']"),
    "match": ('.o_orderpriority | match("[A-Z]+")', "['[2,' || length(regexp_extract(o_orderpriority, '[A-Z]+')) || ',\"' || regexp_extract(o_orderpriority, '[A-Z]+') || '\"]']"),
    "capture": ('.o_orderpriority | capture("(?P<n>[0-9])-(?P<word>.*)")', "['[\"n\",\"' || left(o_orderpriority, 1) || '\",\"word\",\"' || substr(o_orderpriority, 3) || '\"]']"),
    "scan": ('[.o_orderpriority | scan("[A-Z]")] | length', "[CAST(length(regexp_replace(o_orderpriority, '[^A-Z]', '', 'g')) AS VARCHAR)]"),
    "splits": ('[.o_orderpriority | splits("-")]', "['[\"' || replace(o_orderpriority, '-', '\",\"') || '\"]']"),
    "sub": ('.o_orderpriority | sub("([A-Z])"; "<$1>")', "['\"' || regexp_replace(o_orderpriority, '([A-Z])', '<\\1>') || '\"']"),
    "implode": (".o_orderstatus | explode | implode", "['\"' || o_orderstatus || '\"']"),
    "ascii": (".o_orderstatus | ascii", "[CAST(unicode(o_orderstatus) AS VARCHAR)]"),
    "transpose": ("[[.items[].l_linenumber], [.o_custkey]] | transpose | length", "[CAST(greatest(len(items), 1) AS VARCHAR)]"),
    "indices": ("[.items[].l_returnflag] | sort | indices(\"R\")", f"['[' || array_to_string(list_transform(list_filter(list_transform(list_sort({_F}), lambda x, i: CASE WHEN x = 'R' THEN i - 1 END), lambda i: i IS NOT NULL), lambda i: CAST(i AS VARCHAR)), ',') || ']']"),
    "index": ('.o_orderpriority | index("-")', "[coalesce(CAST(nullif(strpos(o_orderpriority, '-'), 0) - 1 AS VARCHAR), 'null')]"),
    "rindex": ('[.items[].l_returnflag] | sort | rindex("R")', f"[CASE WHEN list_contains({_F}, 'R') THEN CAST(len(items) - 1 AS VARCHAR) ELSE 'null' END]"),
    "nan": ("[.items[] | if .l_linenumber > 3 then nan else .l_quantity end | isnan]", _JSON("list_transform(items, lambda x: CASE WHEN x.l_linenumber > 3 THEN 'true' ELSE 'false' END)")),
    "infinite": ("[.items[] | if .l_linenumber > 3 then infinite else .l_quantity end | isinfinite]", _JSON("list_transform(items, lambda x: CASE WHEN x.l_linenumber > 3 THEN 'true' ELSE 'false' END)")),
    "tojson": ("{k: .o_orderkey} | tojson", "['\"{\\\"k\\\":' || o_orderkey || '}\"']"),
    "fromjson": ("[.items | tojson | fromjson | .[].l_partkey]", _JSON(_K)),
    "json": ("[.o_orderkey] | @json", "['\"[' || o_orderkey || ']\"']"),
    "base64d": (".o_orderpriority | @base64 | @base64d", "['\"' || o_orderpriority || '\"']"),
    "keys_unsorted": ('[.items[] | keys_unsorted | join("+") | length]', _JSON("list_transform(items, lambda x: '46')")),
    "has": ('[.items[] | has("l_partkey"), has("no")]', _JSON("flatten(list_transform(items, lambda x: ['true', 'false']))")),
    "in": ('[.items[] | . as $i | "l_partkey" | in($i)]', _JSON("list_transform(items, lambda x: 'true')")),
    "to_entries": ("{k: .o_orderkey} | to_entries", "['[{\"key\":\"k\",\"value\":' || o_orderkey || '}]']"),
    "from_entries": ("[[\"k\", .o_orderkey]] | from_entries", "['{\"k\":' || o_orderkey || '}']"),
    "with_entries": ("{k: .o_orderkey} | with_entries({key: (.key + \"2\"), value: .value})", "['{\"k2\":' || o_orderkey || '}']"),
    "getpath": ('getpath(["items", 0, "l_partkey"])', "[coalesce(CAST(items[1].l_partkey AS VARCHAR), 'null')]"),
    "setpath": ('[.items[] | setpath(["l_partkey"]; 7) | .l_partkey + .l_linenumber]', _JSON("list_transform(items, lambda x: x.l_linenumber + 7)")),
    "delpaths": ('[.items[] | delpaths([["l_partkey"]]) | .l_partkey // .l_linenumber]', _JSON("list_transform(items, lambda x: x.l_linenumber)")),
    "merge": ("[.items[] | . + {l_partkey: .l_linenumber} | .l_partkey + .l_linenumber]", _JSON("list_transform(items, lambda x: 2 * x.l_linenumber)")),
    "deep_merge": ("[.items[] | {a: .} * {a: {x: 1}} | .a.x + .a.l_partkey]", _JSON("list_transform(items, lambda x: x.l_partkey + 1)")),
    "paths": ("[.items | paths] | length", "[CAST(5 * len(items) AS VARCHAR)]"),
    "leaf_paths": ("[.items | leaf_paths] | length", "[CAST(4 * len(items) AS VARCHAR)]"),
    "paths_filter": ("[.items | paths(strings) | .[0]]", _JSON("range(0, len(items))")),
    "recurse": ("[.items | recurse | objects | .l_partkey], ([.items | recurse] | length)", f"['[' || array_to_string({_K}, ',') || ']', CAST(1 + 5 * len(items) AS VARCHAR)]"),
    "recurse_f": ("[.o_custkey | recurse(if . < 700 then . + 100 else empty end)] | length", "[CAST(1 + greatest(0, CAST(ceil((700 - o_custkey) / 100.0) AS BIGINT)) AS VARCHAR)]"),
    "while": ("[.o_custkey + 1 | while(. <= 1000; . * 2)]", _JSON(f"list_filter({_DOUBLED}, lambda x: x <= 1000)")),
    "until": (".o_custkey + 1 | until(. > 1000; . * 2)", f"[CAST(list_filter({_DOUBLED}, lambda x: x > 1000)[1] AS VARCHAR)]"),
    "repeat": (".o_custkey as $c | [$c | repeat(if . > $c + 1 then empty else . + 1 end)]", _JSON("[o_custkey, o_custkey + 1, o_custkey + 2]")),
    "error": ('try (if .o_custkey > 700 then error else .o_orderkey end) catch "caught"', "[CASE WHEN o_custkey > 700 THEN '\"caught\"' ELSE CAST(o_orderkey AS VARCHAR) END]"),
    "env": ("[.items[] | env, input, .l_linenumber]", _JSON("flatten(list_transform(items, lambda x: ['null', 'null', CAST(x.l_linenumber AS VARCHAR)]))")),
    "inputs": ("[.items[] | inputs, .l_linenumber]", _JSON("list_transform(items, lambda x: x.l_linenumber)")),
    "builtins": ("(builtins | length > 100) and .o_custkey > 100", "[CASE WHEN o_custkey > 100 THEN 'true' ELSE 'false' END]"),
    "objects": ("[(.items[], 1) | objects | .l_partkey]", _JSON(_K)),
    "interpolate_mixed": (r'"\(.o_orderkey)/\(.items | length)"', "['\"' || o_orderkey || '/' || len(items) || '\"']"),
}

def _typed(program: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: pipeline(orders_nested(s, d), program, ["o_orderkey"], engine="columns")


def _texts(program: str) -> Callable[[SparkSession, str], DataFrame]:
    """A program's outputs as JSON texts: compiled where it can be typed, interpreted otherwise."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = orders_nested(spark, d, ["l_linenumber", "l_partkey", "l_quantity", "l_returnflag"])
        try:
            v = compile_pipeline(df.schema, program).array
        except Untyped:
            return interpret(df, program, ["o_orderkey"])
        return df.select("o_orderkey", as_json(v.col, v.kind).alias("out"))

    return run


for _name, (_program, _sql) in TYPED.items():
    QUERIES[f"pipe_{_name}"] = _typed(_program)
    ORACLES[f"pipe_{_name}"] = f"WITH {ORDERS} SELECT o_orderkey, {_sql} AS out FROM n"
for _name, (_program, _sql) in INTERPRETED.items():
    QUERIES[f"pipe_{_name}"] = _texts(_program)
    if _sql:
        ORACLES[f"pipe_{_name}"] = f"WITH {ORDERS} SELECT o_orderkey, {_sql} AS out FROM n"

def _map_values(spark: SparkSession, d: str) -> DataFrame:
    out = pipeline(events_by_user(spark, d), ".counts[]", ["user_id"], engine="columns")
    return out.select("user_id", F.array_sort("out").alias("out"))


QUERIES["pipe_map_values"] = _map_values
ORACLES["pipe_map_values"] = "SELECT user_id, list_sort(list(n)) AS out FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id"
