import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fluxnest.functions.exprs import call
from fluxnest.functions.values import PlanError
from fluxnest.pipeline.interpret import PipeError, execute
from fluxnest.pipeline.run import Untyped, as_json, compile_pipeline, interpret, outputs, pipeline
from fluxnest.pipeline.syntax import BUILTINS, parse
from fluxnest.plans.config import parse_config, skeleton
from fluxnest.plans.denorm import Col, DenormPlan, denorm, query

SCHEMA = "name string, crates array<struct<code string, mass double>>, ports array<string>, leg bigint, __pos1 int, __item0 int"
ROWS = [("two", [("a", 1.0), ("b", 2.0)], ["x", "y", "z"], 1, 0, 0), ("none", [], ["x"], 2, 0, 0), ("bare", None, None, 3, 0, 0)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(1)


def flat(df, *specs, **named):
    return [tuple(r) for r in denorm(df, *specs, **named).collect()]


def test_fan_out(df):
    assert flat(df, "name", "crates[*].code") == [("two", "a"), ("two", "b"), ("none", None), ("bare", None)]
    assert flat(df, "name", "crates[*].code", "ports[*]")[:6] == [("two", i, t) for i in "ab" for t in "xyz"]
    assert flat(df, "crates[9].code", "name") == [(None, None)] * 3  # an empty first column empties its group
    assert flat(df, "name", last="crates[-1].code") == [("two", "b"), ("none", None), ("bare", None)]


def test_groups_take_the_size_of_their_first_column(spark):
    d = spark.createDataFrame([({"u": [1, 2, 3]}, {"u": [7]})], "a struct<u array<int>>, b struct<u array<int>>")
    assert flat(d, x="a.u[*]", y="b.u[*]") == [(1, 7), (2, None), (3, None)]
    assert flat(d, y="b.u[*]", x="a.u[*]") == [(7, 1)]


def test_expressions_over_empty_groups(df):
    both = call("concat", "crates[*].code", "crates[*].mass", sep=":")
    assert flat(df, "name", v=both) == [("two", "a:1"), ("two", "b:2"), ("none", ":"), ("bare", ":")]
    assert flat(df, "name", "crates[*].code", v=both)[2:] == [("none", None, None), ("bare", None, None)]
    assert flat(df, "name", n=call("sum", "crates[*].mass"), d=call("distinct", "ports[*]"))[0] == ("two", 3.0, 3)


def test_strict(df):
    d = df.filter("leg = 1")
    with pytest.raises(Exception, match="clamped"):
        denorm(d, Col("v", "crates[0:5].code", strict=True)).collect()
    assert flat(d, Col("v", "crates[0:2].code", strict=True)) == [("a",), ("b",)]


@pytest.mark.parametrize("bad", ["crates", "crates[*]", "nope", "name.x"])
def test_bad_plans(df, bad):
    with pytest.raises(PlanError):
        DenormPlan(df.schema, [Col("v", bad)])


def test_no_shuffle(df):
    plan = denorm(df, "name", "crates[*].code", "ports[*]")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Generate") == 2


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=4))
def test_rows_are_the_product(spark, sizes):
    d = spark.createDataFrame([(list(range(a)), list(range(b))) for a, b in sizes], "a array<int>, b array<int>")
    assert denorm(d, "a[*]", "b[*]").count() == sum(max(1, a) * max(1, b) for a, b in sizes)


def test_query(df):
    assert [tuple(r) for r in query(df, ids="crates[*].code", first="ports[0]").collect()][:2] == [(["a", "b"], ["x"]), ([], ["x"])]


YAML = """
proto: {file: o.proto, message: Order}
denormalizer:
  columns:
    - {name: name, path: name}
    - {name: item, path: "crates[*].code", strict: true}
    - name: label
      expr: {func: cond, args: [{expr: {func: gt, args: [{path: "crates[*].mass"}, {literal: 1.5}]}}, {literal: dear}, {literal: cheap}]}
"""


def test_config(df):
    c = parse_config(YAML)
    assert [tuple(r) for r in c.plan(df.schema).apply(df).collect()][:2] == [("two", "a", "cheap"), ("two", "b", "dear")]
    again = parse_config(skeleton(df.schema, "o.proto", "Order"))
    assert [x.path for x in again.columns] == ["name", "crates[*].code", "crates[*].mass", "ports[*]", "leg", "__pos1", "__item0"]


@pytest.mark.parametrize(
    "change",
    [("proto:", "prto:"), ("message: Order", "other: 1"), ("func: gt", "func: nope"), ("{literal: 1.5}", "{literal: 1.5, path: a}"), ("path: name", "pth: name"), ("{name: name, path: name}", "{path: name}"), ("columns:", "cols:")],
)
def test_bad_config(change):
    with pytest.raises(PlanError):
        parse_config(YAML.replace(*change))


# ---- pipelines

DATA = [{"s": "a b,c", "n": 5, "x": 2.5, "l": ["k", "j", None], "crates": [{"p": 3, "q": "x"}, {"p": 1, "q": "y"}], "m": {"u": 1}}, {"s": "", "n": -7, "x": -0.5, "l": [], "crates": [], "m": {}}]
PIPE_SCHEMA = "s string, n bigint, x double, l array<string>, crates array<struct<p bigint, q string>>, m map<string, bigint>"
PROGRAMS = """
.crates[] | select(.p > 1) | .q
[.crates[].p] | add
.crates | map(.p) | sort
.crates | sort_by(.p) | map(.q)
.crates | group_by(.q) | map(length)
reduce .crates[] as $i (0; . + $i.p)
[foreach .crates[] as $i (0; . + $i.p)]
if .n > 0 then "pos" else "neg" end
.s // "none"
.n as $k | .crates | map(.p + $k)
def inc(f): f + 1; inc(.n)
{a: .n, b: .s}
"n=\\(.n) l=\\(.l[])"
.s | split(",")
.l | join("-")
[limit(1; .crates[].q)]
.x | round
.x | tostring
.n / 2, .n % 2
.m | to_entries
.crates | min_by(.p) | .q
.crates | any(.p > 2), all(.p > 0)
.l | @csv
.s | @html
""".strip().split("\n")


@pytest.mark.parametrize("program", PROGRAMS)
def test_columns_and_interpreter_agree(spark, program):
    d = spark.createDataFrame([tuple(r.values()) for r in [{**x, "crates": [tuple(i.values()) for i in x["crates"]]} for x in DATA]], PIPE_SCHEMA).coalesce(1)
    s = compile_pipeline(d.schema, program)
    got = [[json.loads(t) for t in r[0]] for r in d.select(as_json(s.array.col, s.array.kind)).collect()]
    assert got == [execute(parse(program), x) for x in DATA]
    assert [[json.loads(t) for t in r.out] for r in interpret(d, program, ["n"]).collect()] == got


@pytest.mark.parametrize(
    "program,value,want",
    [
        ("try error(\"e\") catch .", None, ["e"]),
        (".a?", 1, []),
        ("1 / 0 // 5", None, PipeError),
        ("label $f | reduce range as $i (0; if . > 3 then break $f else . + 1 end)", 9, [4]),
        ("def f: if . > 10 then . else . * 2 | f end; f", 3, [12]),
        ("[recurse(if . < 3 then . + 1 else empty end)]", 1, [[1, 2, 3]]),
        ("[.[] | tostring]", [1, 1.5, True, "x"], [["1", "1.5", "true", "x"]]),
        ("transpose", [[1, 2], [3]], [[[1, 3], [2, None]]]),
        ("[paths]", {"a": [1]}, [[["a", 0], ["a"]]]),
        ("path(.a)", {"a": 1}, [["a"]]),
        ("setpath([\"a\", \"b\"]; 1)", {}, [{"a": {"b": 1}}]),
        ("delpaths([[\"a\"], [\"b\", 0]])", {"a": 1, "b": [1, 2]}, [{"b": [2]}]),
        ("with_entries({key: (.key + \"!\"), value})", {"a": 1}, [{"a!": 1}]),
        ("{(.k): 1, x: (1, 2)}", {"k": "v"}, [{"v": 1, "x": 2}]),
        ("match(\"(b)\")", "éb", [[2, 1, "b"]]),
        ("capture(\"(?P<y>\\\\d+)\")", "in 1999", [["y", "1999"]]),
        ("[scan(\"[a-z]\")]", "a1b", [[["a"], ["b"]]]),
        ("sub(\"(.)\"; \"$1$1\")", "ab", ["aab"]),
        ("@base64 | ., @base64d", "hi?", ["aGk/", "hi?"]),
        ("@uri", "a b*~/é", ["a+b%2A~%2F%C3%A9"]),
        ("@tsv", ["a\tb", 1], ["a\\\\tb\t1"]),
        ("fromjson", "[1.0, {\"a\": 2}]", [[1, {"a": 2}]]),
        ("indices(\"aa\")", "aaa", [[0, 1]]),
        ("limit(-1; .[])", [1], []),
        ("{a: {x: 1}} * {a: {y: 2}}", None, [{"a": {"x": 1, "y": 2}}]),
        ("flatten", [1, [2, [3]]], [[1, 2, 3]]),
        ("range", 20_000, PipeError),
        ("implode", [-1], PipeError),
        (".[]", 1, PipeError),
    ],
)
def test_interpreter(program, value, want):
    if want is PipeError:
        with pytest.raises(PipeError):
            execute(parse(program), value)
    else:
        assert execute(parse(program), value) == want


@pytest.mark.parametrize("program", ["recurse", "recurse(.[]?)"])
def test_recurse_walks_whole_records(program):
    value = {"crates": [{"n": i, "ports": [str(i)]} for i in range(30_000)]}
    got = execute(parse(program), value)
    assert len(got) == 2 + 30_000 * 4
    assert [x for x in got if isinstance(x, int)] == list(range(30_000)) and got[-1] == "29999"


@pytest.mark.parametrize("program", ["recurse(. + 1)", "recurse(.)", "recurse(recurse(. + 1))"])
def test_endless_recurse_is_an_error(program):
    with pytest.raises(PipeError):
        execute(parse(program), 1)


def test_every_builtin_is_there():
    for name, counts in BUILTINS.items():
        for n in counts:
            try:
                execute(("call", name, (("lit", "a"),) * n), "a")
            except PipeError:
                pass
    assert len(BUILTINS) > 100


@pytest.mark.parametrize("bad", ["", ".a |", "nope", "$x", "if . then 1", "map(.a", '"abc', "{a:}", "reduce .[] as x (0; .)", ".a.[", "limit(1)"])
def test_bad_programs(bad):
    with pytest.raises(PlanError):
        parse(bad)


def test_fallback_and_permissive_mode(spark):
    d = spark.createDataFrame([(1, "2"), (2, "x")], "k bigint, t string").coalesce(1)
    with pytest.raises(Untyped):
        pipeline(d, ".t | tonumber", ["k"], engine="columns")
    assert [r.out for r in pipeline(d, 'try (.t | tonumber) catch "bad"', ["k"]).collect()] == [["2"], ['"bad"']]
    got = interpret(d, ".t | tonumber", ["k"], strict=False).collect()
    assert got[0].out == ["2"] and got[1].out is None and "no number" in got[1]._error
    assert [tuple(r) for r in outputs(d, ".k, .k * 2", ["k"]).collect()] == [(1, 1), (1, 2), (2, 2), (2, 4)]


BOTH = [
    ".t | ascii", ".t | explode | implode", ".t | @base64 | @base64d", ".xs | transpose", '{b: .n, a: [.t, "q\\"x"], c: (.n > 5)} | tojson', ".xs | @json", '.t | index("b")', ".ns | index(2), rindex(2)", ".ns | indices(2)",
    '.t | capture("(?P<x>[a-z])(?P<y>.?)")', '.t | scan("[a-z]")', '.t | scan("([a-z])(.)")', '.t | splits("b+")', 'getpath(["o", "k"]), getpath(["ns", -1])', '.o | has("k"), has("no")', ".n + .n, .n * .n, - .n, ([.ns[], .n] | add)",
]


@pytest.mark.parametrize("program", BOTH)
def test_compiled_builtins_equal_interpreted_ones(spark, program):
    """Texts beyond ASCII, empty and null lists, and numbers at the end of 64 bits."""
    from fluxnest.pipeline.run import as_json, compile_pipeline, interpret

    rows = [(1, "aébb", [[1, 2], [3]], [2, 5, 2], (7,), 3), (2, "日b-bb本", [[], [4]], [1], (None,), 2**63 - 1), (3, "🙂xb", [], [2], (0,), -(2**63) + 1)]
    df = spark.createDataFrame(rows, "i int, t string, xs array<array<bigint>>, ns array<bigint>, o struct<k: bigint>, n bigint").coalesce(1)
    v = compile_pipeline(df.schema, program).array
    got = {r.i: r.out for r in df.select("i", as_json(v.col, v.kind).alias("out")).collect()}
    assert got == {r.i: r.out for r in interpret(df, program, ["i"]).collect()}
