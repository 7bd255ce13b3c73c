"""The expression functions of computed columns.

An expression is a tree of Path, Lit and Call. Each function is a builder from typed columns to a typed
column, so a whole tree becomes one Catalyst expression. Arity is checked when the tree is built.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import strptime as times
from .values import BOOL, DOUBLE, LONG, STRING, PlanError, V, common, compare, float_view, fnv1a64, int_view, literal, null, to_str, truthy


@dataclass(frozen=True)
class PathRef:
    path: str


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Call:
    func: str
    args: tuple["Expr", ...] = ()
    params: dict[str, Any] = field(default_factory=dict, hash=False)


Expr = PathRef | Lit | Call
AGGREGATES = ("sum", "distinct", "list_concat")
Builder = Callable[[list[V], dict[str, Any]], V]
#: name -> (least args, most args or None, builder)
FUNCTIONS: dict[str, tuple[int, int | None, Builder]] = {}


def register(name: str, least: int, most: int | None = None):
    def keep(f: Builder) -> Builder:
        FUNCTIONS[name] = (least, most if most is not None or least == 0 else None, f)
        return f

    return keep


def _unary(name: str):
    return register(name, 1, 1)


def _binary(name: str):
    return register(name, 2, 2)


def call(func: str, *args: Expr | str, **params: Any) -> Call:
    """Build a checked call; a plain string argument is a path."""
    if func not in FUNCTIONS and func not in AGGREGATES:
        raise PlanError(f"unknown func {func!r}")
    least, most, _ = FUNCTIONS.get(func, (1, 1, None))
    if len(args) < least or most is not None and len(args) > most:
        raise PlanError(f"{func} takes {least}{'' if most == least else f' to {most}' if most else ' or more'} args, got {len(args)}")
    return Call(func, tuple(PathRef(a) if isinstance(a, str) else a for a in args), params)


def leaves(e: Expr) -> list[str]:
    """Paths of an expression in order of appearance, each once."""
    if isinstance(e, PathRef):
        return [e.path]
    if isinstance(e, Lit):
        return []
    return list(dict.fromkeys(p for a in e.args for p in leaves(a)))


def build(e: Expr, leaf: Callable[[str], V], aggregate: Callable[[Call], V]) -> V:
    """The column of an expression; leaf gives the value of a path, aggregate that of an aggregate call."""
    if isinstance(e, PathRef):
        return leaf(e.path)
    if isinstance(e, Lit):
        return literal(e.value)
    if e.func in AGGREGATES:
        return aggregate(e)
    return FUNCTIONS[e.func][2]([build(a, leaf, aggregate) for a in e.args], e.params)


# ---- control and predicates


@register("coalesce", 2)
def _coalesce(a: list[V], _) -> V:
    kind, cols = common(*a)
    return V(F.coalesce(*(F.when(truthy(v), c) for v, c in zip(a, cols))), kind)


@_unary("default")
def _default(a: list[V], p) -> V:
    kind, (x, d) = common(a[0], literal(p.get("literal")))
    return V(F.when(truthy(a[0]), x).otherwise(d), kind)


@register("cond", 3, 3)
def _cond(a: list[V], _) -> V:
    kind, (t, e) = common(a[1], a[2])
    return V(F.when(truthy(a[0]), t).otherwise(e), kind)


@_unary("has")
def _has(a: list[V], _) -> V:
    return V(truthy(a[0]), BOOL)


@_unary("len")
def _len(a: list[V], _) -> V:
    v = a[0]
    if v.is_string or isinstance(v.kind, T.BinaryType):
        n = F.octet_length(v.col)
    elif isinstance(v.kind, (T.ArrayType, T.MapType)):
        n = F.when(v.col.isNotNull(), F.size(v.col))
    else:
        n = F.lit(0)
    return V(F.coalesce(n, F.lit(0)).cast("bigint"), LONG)


@_binary("select")
def _select(a: list[V], _) -> V:
    return V(F.when(truthy(a[0]), a[1].col), a[1].kind)


@_binary("and")
def _and(a: list[V], _) -> V:
    return V(truthy(a[0]) & truthy(a[1]), BOOL)


@_binary("or")
def _or(a: list[V], _) -> V:
    return V(truthy(a[0]) | truthy(a[1]), BOOL)


@_unary("not")
def _not(a: list[V], _) -> V:
    return V(~truthy(a[0]), BOOL)


def _comparison(op: str) -> None:
    @_binary(op)
    def f(a: list[V], _) -> V:
        return V(compare(a[0], a[1], op), BOOL)


for _op in ("eq", "ne", "lt", "le", "gt", "ge"):
    _comparison(_op)


# ---- arithmetic


def _arithmetic(name: str, whole: Callable[[Column, Column], Column], real: Callable[[Column, Column], Column]) -> None:
    @_binary(name)
    def f(a: list[V], _) -> V:
        x, y = (int_view(v) for v in a)
        if x is not None and y is not None:
            return V(whole(x, y), LONG)
        x, y = (float_view(v) for v in a)
        if x is None or y is None:
            return null(LONG)
        return V(real(x, y), DOUBLE)


_arithmetic("add", lambda x, y: F.try_add(x, y), lambda x, y: x + y)
_arithmetic("sub", lambda x, y: F.try_subtract(x, y), lambda x, y: x - y)
_arithmetic("mul", lambda x, y: F.try_multiply(x, y), lambda x, y: x * y)


def _guard(y: Column, zero: Column, out: Column, x: Column) -> Column:
    return F.when(x.isNull() | y.isNull(), None).when(y == 0, zero).otherwise(out)


_arithmetic("div", lambda x, y: _guard(y, F.lit(0).cast("bigint"), F.call_function("div", x, F.nullif(y, F.lit(0).cast("bigint"))), x), lambda x, y: _guard(y, F.lit(0.0), x / F.nullif(y, F.lit(0.0)), x))
_arithmetic("mod", lambda x, y: _guard(y, F.lit(0).cast("bigint"), x % F.nullif(y, F.lit(0).cast("bigint")), x), lambda x, y: _guard(y, F.lit(0.0), x % F.nullif(y, F.lit(0.0)), x))


def _pick(name: str, f: Callable[..., Column]) -> None:
    @_binary(name)
    def g(a: list[V], _) -> V:
        x, y = (int_view(v) for v in a)
        if x is not None and y is not None:
            return V(F.when(x.isNotNull() & y.isNotNull(), f(x, y)), LONG)
        x, y = (float_view(v) for v in a)
        if x is None or y is None:
            return null(LONG)
        return V(F.when(x.isNotNull() & y.isNotNull(), F.when(F.isnan(x) | F.isnan(y), float("nan")).otherwise(f(x, y))), DOUBLE)


_pick("min", F.least)
_pick("max", F.greatest)


@_unary("abs")
def _abs(a: list[V], _) -> V:
    x = int_view(a[0])
    if x is not None:
        return V(F.when(x < 0, F.try_subtract(F.lit(0).cast("bigint"), x)).otherwise(x), LONG)
    x = float_view(a[0])
    return null(LONG) if x is None else V(F.abs(x), DOUBLE)


def _rounding(name: str, f: Callable[[Column], Column]) -> None:
    @_unary(name)
    def g(a: list[V], _) -> V:
        x = int_view(a[0])
        if x is not None:
            return V(x, LONG)
        x = float_view(a[0])
        return null(DOUBLE) if x is None else V(F.when(F.abs(x) < 2.0**52, f(x)).otherwise(x), DOUBLE)


_rounding("ceil", lambda x: F.ceil(x).cast("double"))
_rounding("floor", lambda x: F.floor(x).cast("double"))
_rounding("round", F.rint)


# ---- strings


@register("concat", 1)
def _concat(a: list[V], p) -> V:
    sep = p.get("sep") or ""
    return V(F.concat_ws(sep, *(to_str(v) for v in a)), STRING)


@_unary("upper")
def _upper(a: list[V], _) -> V:
    # A letter whose capital is two letters stays as it is; a noncharacter stands for it meanwhile.
    return V(F.replace(F.upper(F.replace(to_str(a[0]), F.lit("ß"), F.lit("\ufdd1"))), F.lit("\ufdd1"), F.lit("ß")), STRING)


@_unary("lower")
def _lower(a: list[V], _) -> V:
    return V(F.lower(to_str(a[0])), STRING)


@_unary("trim")
def _trim(a: list[V], _) -> V:
    return V(F.regexp_replace(to_str(a[0]), r"(?U)^[\s\x{85}]+|[\s\x{85}]+$", ""), STRING)


@_unary("trim_prefix")
def _trim_prefix(a: list[V], p) -> V:
    s, sep = to_str(a[0]), p.get("sep") or ""
    return V(F.when(s.startswith(sep), F.substring(s, F.lit(len(sep) + 1), F.length(s))).otherwise(s), STRING)


@_unary("trim_suffix")
def _trim_suffix(a: list[V], p) -> V:
    s, sep = to_str(a[0]), p.get("sep") or ""
    return V(F.when(s.endswith(sep), F.substring(s, F.lit(1), F.length(s) - len(sep))).otherwise(s), STRING)


@_unary("mask")
def _mask(a: list[V], p) -> V:
    if a[0].is_null:
        return null(STRING)
    s, first, last = to_str(a[0]), max(0, p.get("param") or 0), max(0, p.get("last") or 0)
    n = F.length(s)
    hidden = F.concat(F.substring(s, 1, first), F.repeat(F.lit((p.get("sep") or "*")[0]), n - first - last), F.substring(s, n - last + 1, F.lit(last)))
    return V(F.when(a[0].col.isNotNull(), F.when(n <= first + last, s).otherwise(hidden)), STRING)


@_unary("coerce")
def _coerce(a: list[V], p) -> V:
    kind, (t, f) = common(literal(p.get("literal")), literal(p.get("literal2")))
    return V(F.when(truthy(a[0]), t).otherwise(f), kind)


@_unary("enum_name")
def _enum_name(a: list[V], p) -> V:
    names = p.get("names")
    if not names:
        raise PlanError("enum_name needs a field of an enum type, or names")
    pairs = [x for number, name in names.items() for x in (F.lit(int(number)).cast("bigint"), F.lit(name))]
    return V(F.try_element_at(F.create_map(*pairs), int_view(a[0])), STRING)


# ---- casts


def _text_to_double(s: Column) -> Column:
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))


@_unary("cast_int")
def _cast_int(a: list[V], _) -> V:
    v = a[0]
    x = int_view(v)
    if x is not None:
        return V(x, LONG)
    if v.is_float:
        return V(v.col.cast("double").try_cast("bigint"), LONG)
    if v.is_string:
        return V(F.coalesce(F.when(v.col.rlike(r"^[+-]?\d+$"), v.col.try_cast("bigint")), _text_to_double(v.col).try_cast("bigint")), LONG)
    return null(LONG)


@_unary("cast_float")
def _cast_float(a: list[V], _) -> V:
    x = float_view(a[0])
    if x is not None:
        return V(x, DOUBLE)
    return V(_text_to_double(a[0].col), DOUBLE) if a[0].is_string else null(DOUBLE)


@_unary("cast_string")
def _cast_string(a: list[V], _) -> V:
    return V(to_str(a[0]), STRING)


# ---- times


def _ms(v: V) -> Column | None:
    """Epoch milliseconds of a value: timestamps as they are, whole numbers as milliseconds."""
    if isinstance(v.kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_millis(v.col.cast("timestamp"))
    return int_view(v)


@_unary("strptime")
def _strptime(a: list[V], p) -> V:
    if a[0].is_null:
        return null(LONG)
    return V(F.when(a[0].col.isNotNull(), times.strptime(to_str(a[0]), p.get("sep") or "")), LONG)


@_unary("try_strptime")
def _try_strptime(a: list[V], p) -> V:
    return V(F.coalesce(_strptime(a, p).col, F.lit(0).cast("bigint")), LONG)


@register("age", 1, 2)
def _age(a: list[V], _) -> V:
    ts = [_ms(v) for v in a]
    if any(t is None for t in ts):
        return null(LONG)
    return V(F.unix_millis(F.current_timestamp()) - ts[0] if len(ts) == 1 else ts[0] - ts[1], LONG)


def _extract(name: str, f: Callable[[Column], Column]) -> None:
    @_unary(f"extract_{name}")
    def g(a: list[V], _) -> V:
        t = _ms(a[0])
        return null(LONG) if t is None else V(f(F.timestamp_millis(t)).cast("bigint"), LONG)


_PARTS = {"year": F.year, "month": F.month, "day": F.day, "hour": F.hour, "minute": F.minute, "second": F.second}
for _name, _f in _PARTS.items():
    _extract(_name, _f)


@_unary("date_part")
def _date_part(a: list[V], p) -> V:
    s, part = int_view(a[0]), _PARTS.get((p.get("sep") or "").lower())
    return null(LONG) if s is None or part is None else V(part(F.timestamp_seconds(s)).cast("bigint"), LONG)


@_unary("epoch_to_date")
def _epoch_to_date(a: list[V], _) -> V:
    s = int_view(a[0])
    return null(T.IntegerType()) if s is None else V(F.call_function("div", s, F.lit(86400).cast("bigint")).cast("int"), T.IntegerType())


# ---- hashing and buckets


@register("hash", 1)
def _hash(a: list[V], _) -> V:
    return V(fnv1a64(F.concat(*(to_str(v) for v in a))), LONG)


@_unary("bucket")
def _bucket(a: list[V], p) -> V:
    n, x = int(p.get("param") or 0), int_view(a[0])
    if x is None:
        return null(LONG)
    return V(x if n <= 0 else x - x % n, LONG)


# ---- aggregates over a record's branches


def aggregate_array(func: str, array: Column, element: T.DataType, params: dict[str, Any]) -> V:
    """sum, distinct or list_concat of an array of branches."""
    item = lambda c: V(c, element)
    if func == "sum":
        v = item(F.lit(None))
        if int_view(v) is not None:
            total = F.aggregate(array, F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(int_view(item(x)), F.lit(0)))
            kind: T.DataType = LONG
        elif v.is_float:
            total, kind = F.aggregate(array, F.lit(0.0), lambda s, x: s + F.coalesce(float_view(item(x)), F.lit(0.0))), DOUBLE
        else:
            total, kind = F.lit(0).cast("bigint"), LONG
        return V(F.when(F.size(array) > 0, total), kind)
    texts = F.transform(F.filter(array, lambda x: x.isNotNull()), lambda x: to_str(item(x)))
    if func == "distinct":
        return V(F.coalesce(F.size(F.array_distinct(texts)), F.lit(0)).cast("bigint"), LONG)
    return V(F.coalesce(F.array_join(texts, params.get("sep") or ""), F.lit("")), STRING)
