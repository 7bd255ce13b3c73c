import datetime
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxnest.functions.exprs import Lit, build, call
from fluxnest.functions.strptime import compile_format, strptime
from fluxnest.functions.values import PlanError, V, fnv1a64, to_str
from fluxnest.path.compile import compile_path, slice_clamped, slice_places
from fluxnest.path.syntax import Slice, default_name, format_path, parse_path, prefix

SCHEMA = "id bigint, name string, tags array<string>, items array<struct<id string, price double, sub array<int>>>, m map<string, int>, one struct<x int, y array<struct<z int>>>"


@pytest.fixture(scope="module")
def df(spark):
    rows = [
        (1, "n", ["a", "b", "c"], [("p", 1.0, [1, 2]), ("q", 2.0, []), ("r", None, [3])], {"k": 5, "j": 0}, (7, [(1,), (2,)])),
        (2, None, [], [], {}, (None, None)),
        (3, "", None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


@pytest.mark.parametrize(
    "path,want",
    [
        ("items[*].id", ["p", "q", "r"]),
        ("items[0].id", ["p"]),
        ("items[-1].id", ["r"]),
        ("items[9].id", []),
        ("items[-4].id", []),
        ("items[1:].id", ["q", "r"]),
        ("items[:1].id", ["p"]),
        ("items[::-1].id", ["r", "q", "p"]),
        ("items[*].sub[*]", [1, 2, 3]),
        ("items[*].sub[0]", [1, 3]),
        ("items[?(.price > 1)].id", ["q"]),
        ('items[?(!(.id == "q") && .price >= 0)].id', ["p"]),
        ("items[?(.price || .id == \"r\")].id", ["p", "q", "r"]),
        ("one[?(.x == 7)].x", [7]),
        ("one[?(.x == 8)].x", []),
        ('m["k"]', [5]),
        ('m["no"]', []),
        ("m[*]", [0, 5]),
        ("one.y[*].z", [1, 2]),
    ],
)
def test_branches(df, path, want):
    col = compile_path(df.schema, parse_path(path)).value.col
    got = [r[0] for r in df.select(col).collect()]
    assert got[0] == want and got[2] == []


@pytest.mark.parametrize("bad", ["", "a[", "a[0:1:0]", "a..b", "a[x]", "a[?(]", "a b"])
def test_bad_paths(bad):
    with pytest.raises(PlanError):
        parse_path(bad)


@pytest.mark.parametrize("bad", ["nope", "one.nope", "name[0]", "m[0:1]", 'tags["a"]', "name.x"])
def test_paths_that_dont_fit(df, bad):
    with pytest.raises(PlanError):
        compile_path(df.schema, parse_path(bad))


def test_text_of_paths():
    for p in ("a.b[*].c", "(pkg.Msg).a[0]", "a[1:2:-1]", 'm["k"]', "a[:3]"):
        assert format_path(parse_path(p)) == p
    assert format_path(prefix(parse_path("a.b[*].c"), 1)) == "a.b" and format_path(prefix(parse_path("a.b[*].c"), -2)) == "a.b[*]"
    assert default_name("imp[*].pmp.deals[0]") == "deals"


def clamps(s, n):
    """The strict flag: a start outside the list, or with a forward step an end beyond it."""
    start = s.start + n if s.start is not None and s.start < 0 else s.start
    end = s.end + n if s.end is not None and s.end < 0 else s.end
    return start is not None and not 0 <= start <= n or end is not None and s.step > 0 and end > n


def test_slices_are_pythons(spark):
    ends = [None, -7, -3, -1, 0, 1, 3, 8]
    cases = [Slice(a, b, c) for a in ends for b in ends for c in (1, 2, -1, -2)]
    df = spark.range(0, 6).select(F.col("id").cast("int").alias("n")).coalesce(1)
    for at in range(0, len(cases), 64):
        some = cases[at : at + 64]
        cols = [c for i, s in enumerate(some) for c in (slice_places(F.col("n"), s).alias(f"p{i}"), slice_clamped(F.col("n"), s).alias(f"c{i}"))]
        for r in df.select("n", *cols).collect():
            for i, s in enumerate(some):
                assert r[f"p{i}"] == list(range(r.n))[s.start : s.end : s.step], (r.n, s)
                assert r[f"c{i}"] == clamps(s, r.n), (r.n, s)


# ---- functions


def value(spark, e, **cols):
    schema = T.StructType([T.StructField(n, k) for n, (_, k) in cols.items()] or [T.StructField("_", T.IntegerType())])
    df = spark.createDataFrame([tuple(v for v, _ in cols.values()) or (1,)], schema)
    return df.select(build(e, lambda n: V(F.col(n), schema[n].dataType), None).col).first()[0]


L, D, S, B = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()


@pytest.mark.parametrize(
    "e,cols,want",
    [
        (call("coalesce", "a", "b"), {"a": ("", S), "b": ("x", S)}, "x"),
        (call("coalesce", "a", "b"), {"a": (0, L), "b": (None, L)}, None),
        (call("default", "a", literal=5), {"a": (0, L)}, 5),
        (call("cond", "a", Lit(1), Lit(2.5)), {"a": (None, B)}, 2.5),
        (call("len", "a"), {"a": ("é€", S)}, 5),
        (call("len", "a"), {"a": (None, S)}, 0),
        (call("add", "a", "b"), {"a": (2**63 - 1, L), "b": (1, L)}, None),
        (call("add", "a", "b"), {"a": (True, B), "b": (1, L)}, 2),
        (call("add", "a", "b"), {"a": ("x", S), "b": (1, L)}, None),
        (call("div", "a", "b"), {"a": (-7, L), "b": (2, L)}, -3),
        (call("div", "a", "b"), {"a": (7, L), "b": (0, L)}, 0),
        (call("mod", "a", "b"), {"a": (-7, L), "b": (2, L)}, -1),
        (call("div", "a", "b"), {"a": (7.0, D), "b": (0.0, D)}, 0.0),
        (call("div", "a", "b"), {"a": (None, L), "b": (0, L)}, None),
        (call("concat", "a", "b", sep="-"), {"a": (None, S), "b": (1.0, D)}, "-1"),
        (call("eq", "a", "b"), {"a": (None, L), "b": (None, L)}, False),
        (call("ne", "a", "b"), {"a": (None, L), "b": (1, L)}, False),
        (call("eq", "a", "b"), {"a": (True, B), "b": (1, L)}, True),
        (call("lt", "a", "b"), {"a": ("1", S), "b": (2, L)}, False),
        (call("le", "a", "b"), {"a": (math.nan, D), "b": (2.0, D)}, True),
        (call("upper", "a"), {"a": ("straße", S)}, "STRAßE"),
        (call("trim", "a"), {"a": (" \tx\n", S)}, "x"),
        (call("trim_prefix", "a", sep="aa"), {"a": ("aaaab", S)}, "aab"),
        (call("trim_suffix", "a", sep="b"), {"a": ("abb", S)}, "ab"),
        (call("abs", "a"), {"a": (-(2**63), L)}, None),
        (call("ceil", "a"), {"a": (1.2, D)}, 2.0),
        (call("round", "a"), {"a": (2.5, D)}, 2.0),
        (call("min", "a", "b"), {"a": (1, L), "b": (None, L)}, None),
        (call("max", "a", "b"), {"a": (1, L), "b": (0.5, D)}, 1.0),
        (call("cast_int", "a"), {"a": ("12.9", S)}, 12),
        (call("cast_int", "a"), {"a": (" 12", S)}, None),
        (call("cast_float", "a"), {"a": ("1e3", S)}, 1000.0),
        (call("cast_string", "a"), {"a": (1e20, D)}, "100000000000000000000"),
        (call("cast_string", "a"), {"a": (1.5e-7, D)}, "0.00000015"),
        (call("mask", "a", param=2, sep="#"), {"a": ("héllo", S)}, "hé###"),
        (call("mask", "a", param=9), {"a": ("hi", S)}, "hi"),
        (call("coerce", "a", literal="y", literal2="n"), {"a": (0, L)}, "n"),
        (call("enum_name", "a", names={1: "ONE"}), {"a": (2, L)}, None),
        (call("bucket", "a", param=10), {"a": (-27, L)}, -20),
        (call("bucket", "a", param=0), {"a": (27, L)}, 27),
        (call("epoch_to_date", "a"), {"a": (-1, L)}, 0),
        (call("date_part", "a", sep="YEAR"), {"a": (0, L)}, 1970),
        (call("date_part", "a", sep="era"), {"a": (0, L)}, None),
        (call("extract_hour", "a"), {"a": (3_600_000 * 5, L)}, 5),
        (call("age", "a", "b"), {"a": (10, L), "b": (3, L)}, 7),
        (call("select", "a", "b"), {"a": (False, B), "b": (3, L)}, None),
        (call("not", "a"), {"a": (None, L)}, True),
        (call("try_strptime", "a", sep="%Y"), {"a": (None, S)}, 0),
    ],
)
def test_functions(spark, e, cols, want):
    got = value(spark, e, **cols)
    assert got == want and type(got) is type(want)


def test_arity():
    for bad in (lambda: call("add", "a"), lambda: call("nope", "a"), lambda: call("not", "a", "b"), lambda: call("coalesce", "a")):
        with pytest.raises(PlanError):
            bad()


def test_fnv(spark):
    texts = ["", "a", "foobar", "é", "x" * 300]

    def fnv(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h - 2**64 if h >= 2**63 else h

    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r[0] for r in df.select(fnv1a64(F.col("t"))).collect()] == [fnv(t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_float_text_has_no_exponent(spark, x):
    from decimal import Decimal

    got = spark.createDataFrame([(x,)], "x double").select(to_str(V(F.col("x"), D))).first()[0]
    assert "E" not in got and float(got) == x and Decimal(got) == Decimal(got)


@pytest.mark.parametrize(
    "fmt,text,want",
    [
        ("%Y-%m-%d %H:%M:%S.%f", "2024-02-29 13:14:15.250", datetime.datetime(2024, 2, 29, 13, 14, 15, 250_000)),
        ("%-d/%-m/%y", "1/2/24", datetime.datetime(2024, 2, 1)),
        ("%b %d %Y %I%p", "mar 05 2020 12AM", datetime.datetime(2020, 3, 5)),
        ("%Y-%j", "2024-060", datetime.datetime(2024, 2, 29)),
        ("%Y-%m-%dT%H:%M%z", "2020-01-01T10:00+02:00", datetime.datetime(2020, 1, 1, 8)),
        ("2006-01-02T15:04:05Z07:00", "2020-01-01T10:00:00Z", datetime.datetime(2020, 1, 1, 10)),
        ("Jan 2, 2006", "Feb 3, 2021", datetime.datetime(2021, 2, 3)),
        ("%Y", "2020x", None),
        ("%Y-%m-%d", "2021-02-30", None),
        ("%H:%M", "25:00", None),
    ],
)
def test_strptime(spark, fmt, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(strptime(F.col("t"), fmt)).first()[0]
    assert got == (None if want is None else int(want.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000))
    with pytest.raises(PlanError):
        compile_format("%Q")
