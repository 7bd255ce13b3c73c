"""Compilation of pipelines to columns.

A stream of exactly one value is a typed column; any other stream is a typed array column. Programs whose types
depend on the data (recursion, dynamic keys, error handling, loops without a bound) raise Untyped, and run.py
interprets them instead.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import BOOL, DOUBLE, LONG, NULL, STRING, PlanError, V, common, compare, float_view, int_view, literal, null, to_str, truthy
from .interpret import PipeError, execute


class Untyped(Exception):
    """The program can't be typed before it runs."""


@dataclass(frozen=True)
class Stream:
    """many: v is an array of the outputs; otherwise v is the one output."""

    v: V
    many: bool = False

    @property
    def element(self) -> T.DataType:
        return self.v.kind.elementType if self.many else self.v.kind

    @property
    def array(self) -> V:
        return self.v if self.many else V(F.array(self.v.col), T.ArrayType(self.v.kind))

    def any(self) -> Column:
        if not self.many:
            return truthy(self.v)
        kind = self.element
        return F.coalesce(F.exists(self.v.col, lambda x: truthy(V(x, kind))), F.lit(False))

    def first(self) -> V:
        return V(F.get(self.v.col, F.lit(0)), self.element) if self.many else self.v


@dataclass(frozen=True)
class Scope:
    vars: dict
    funcs: dict


def one(col: Column, kind: T.DataType) -> Stream:
    return Stream(V(col, kind))


def many(col: Column, element: T.DataType) -> Stream:
    return Stream(V(col, T.ArrayType(element)), True)


def bind(s: Stream, f: Callable[[V], Stream]) -> Stream:
    """Feed every output of s to f and concatenate."""
    if not s.many:
        return f(s.v)
    kind = s.element
    sample = f(V(F.lit(None).cast(kind), kind))
    if not sample.many:
        return many(F.transform(s.v.col, lambda x: f(V(x, kind)).v.col), sample.element)
    return many(F.flatten(F.transform(s.v.col, lambda x: f(V(x, kind)).v.col)), sample.element)


def compile_tree(t: tuple, v: V, s: Scope | None = None) -> Stream:
    return _RULES[t[0]](t, v, s or Scope({}, {}))


def _is_list(v: V) -> bool:
    return isinstance(v.kind, T.ArrayType)


def _is_object(v: V) -> bool:
    return isinstance(v.kind, (T.StructType, T.MapType))


def _list(v: V, what: str) -> V:
    if not _is_list(v):
        raise Untyped(f"{what} of {v.kind.simpleString()}")
    return v


def _text(v: V, what: str) -> Column:
    if not v.is_string:
        raise Untyped(f"{what} of {v.kind.simpleString()}")
    return v.col


def _field(t, v, s):
    def get(x: V) -> Stream:
        if isinstance(x.kind, T.StructType):
            if t[2] not in x.kind.fieldNames():
                raise PlanError(f"unknown field {t[2]!r}; there are {', '.join(x.kind.fieldNames())}")
            return one(x.col[t[2]], x.kind[t[2]].dataType)
        if isinstance(x.kind, T.MapType) and isinstance(x.kind.keyType, T.StringType):
            return one(F.try_element_at(x.col, F.lit(t[2])), x.kind.valueType)
        if x.is_null:
            return Stream(null())
        raise Untyped(f"field of {x.kind.simpleString()}")

    return bind(compile_tree(t[1], v, s), get)


def _iterate(v: V) -> Stream:
    if _is_list(v):
        return many(F.coalesce(v.col, F.array().cast(v.kind)), v.kind.elementType)
    if isinstance(v.kind, T.MapType):
        return many(F.transform(F.array_sort(F.map_entries(v.col)), lambda e: e["value"]), v.kind.valueType)
    if isinstance(v.kind, T.StructType):
        try:
            kind, cols = common(*(V(v.col[f.name], f.dataType) for f in v.kind.fields))
        except PlanError as e:
            raise Untyped(str(e)) from None
        return many(F.filter(F.array(*cols), lambda x: x.isNotNull()), kind)
    raise Untyped(f"iteration of {v.kind.simpleString()}")


def _index(t, v, s):
    def get(x: V) -> Stream:
        if not _is_list(x):
            raise Untyped("index of no list")
        at = F.lit(t[2]) if t[2] >= 0 else F.size(x.col) + t[2]
        return one(F.get(x.col, at), x.kind.elementType)

    return bind(compile_tree(t[1], v, s), get)


def _collect(t, v, s):
    if t[1] == ("empty",):
        return one(F.array(), T.ArrayType(NULL))
    a = compile_tree(t[1], v, s).array
    return Stream(a)


def _comma(t, v, s):
    parts = [compile_tree(e, v, s) for e in t[1]]
    try:
        kind, cols = common(*(p.array for p in parts))
    except PlanError as e:
        raise Untyped(str(e)) from None
    return Stream(V(F.concat(*cols), kind), True)


def _pipe(t, v, s):
    return bind(compile_tree(t[1], v, s), lambda x: compile_tree(t[2], x, s))


def _as(t, v, s):
    return compile_tree(t[3], v, Scope({**s.vars, t[2]: compile_tree(t[1], v, s)}, s.funcs))


def _alt(t, v, s):
    a, b = compile_tree(t[1], v, s), compile_tree(t[2], v, s)
    try:
        if not a.many and not b.many:
            kind, (x, y) = common(a.v, b.v)
            return one(F.when(a.any(), x).otherwise(y), kind)
        kind, (x, y) = common(a.array, b.array)
    except PlanError as e:
        raise Untyped(str(e)) from None
    return Stream(V(F.when(a.any(), x).otherwise(y), kind), True)


def _if(t, v, s):
    arms = [(compile_tree(c, v, s).any(), compile_tree(b, v, s)) for c, b in t[1]]
    other = compile_tree(t[2], v, s) if t[2] is not None else Stream(v)
    branches = [b for _, b in arms] + [other]
    wide = any(b.many for b in branches)
    try:
        kind, cols = common(*(b.array if wide else b.v for b in branches))
    except PlanError as e:
        raise Untyped(str(e)) from None
    out = cols[-1]
    for (c, _), col in zip(reversed(arms), reversed(cols[:-1])):
        out = F.when(c, col).otherwise(out)
    return Stream(V(out, kind), wide)


def _number(v: V) -> V:
    if v.is_bool or not v.is_number:
        raise Untyped(f"arithmetic on {v.kind.simpleString()}")
    return v


def _fail(message: str, kind: T.DataType) -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def _arith(t, v, s):
    op, a, b = t[1], compile_tree(t[2], v, s).first(), compile_tree(t[3], v, s).first()
    if op == "+":
        if a.is_null or b.is_null:
            return Stream(b if a.is_null else a)
        if a.is_string and b.is_string:
            return one(F.coalesce(F.concat(a.col, b.col), a.col, b.col), STRING)
        if _is_list(a) and _is_list(b):
            kind, (x, y) = common(a, b)
            return one(F.coalesce(F.concat(x, y), x, y), kind)
        if isinstance(a.kind, T.StructType) and isinstance(b.kind, T.StructType):
            fields = {f.name: (a, f.dataType) for f in a.kind.fields} | {f.name: (b, f.dataType) for f in b.kind.fields}
            return one(F.struct(*(x.col[n].alias(n) for n, (x, _) in fields.items())), T.StructType([T.StructField(n, k) for n, (_, k) in fields.items()]))
    _number(a), _number(b)
    whole = a.is_int and b.is_int
    x, y = (int_view(a), int_view(b)) if whole else (float_view(a), float_view(b))
    kind = LONG if whole else DOUBLE
    zero = F.lit(0).cast(kind)
    if op in "/%":
        safe = F.nullif(y, zero)
        out = F.when((safe == -1) & (x == -(2**63)), F.lit(None)).otherwise(F.call_function("div", x, F.when((safe == -1) & (x == -(2**63)), 1).otherwise(safe))) if op == "/" and whole else x / safe if op == "/" else x % safe
        return one(F.when(y == zero, _fail("division by zero", kind)).otherwise(out), kind)
    if op == "+":
        return one(F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.try_add(x, y) if whole else x + y), kind)
    return one({"-": F.try_subtract, "*": F.try_multiply}[op](x, y) if whole else {"-": x - y, "*": x * y}[op], kind)


def _neg(t, v, s):
    x = _number(compile_tree(t[1], v, s).first())
    return one(F.try_subtract(F.lit(0).cast(LONG), int_view(x)), LONG) if x.is_int else one(-float_view(x), DOUBLE)


def _reduce(t, v, s):
    _, source, var, init, update, *more = t
    src, start = compile_tree(source, v, s).array, compile_tree(init, v, s).first()
    inner = src.kind.elementType

    def step(acc: V, x: Column) -> Stream:
        return compile_tree(update, acc, Scope({**s.vars, var: one(x, inner)}, s.funcs))

    kind = start.kind
    for _ in range(2):  # the accumulator's type may widen once
        got = step(V(F.lit(None).cast(kind), kind), F.lit(None).cast(inner)).first().kind
        if got == kind:
            break
        try:
            kind = common(V(F.lit(None), kind), V(F.lit(None), got))[0]
        except PlanError as e:
            raise Untyped(str(e)) from None

    def move(acc: Column, x: Column) -> Column:
        r = step(V(acc, kind), x)
        new = r.first().col.cast(kind)
        return F.when(F.size(r.v.col) > 0, new).otherwise(acc) if r.many else new

    items = F.coalesce(src.col, F.array().cast(src.kind))
    if t[0] == "reduce":
        return one(F.aggregate(items, start.col.cast(kind), move), kind)
    extract = more[0]

    def shown(acc: Column, x: Column) -> Stream:
        return compile_tree(extract, V(acc, kind), Scope({**s.vars, var: one(x, inner)}, s.funcs)) if extract is not None else one(acc, kind)

    element = shown(F.lit(None).cast(kind), F.lit(None).cast(inner)).element
    empty = F.array().cast(T.ArrayType(element))

    def scan(acc: Column, x: Column) -> Column:
        new = move(acc["a"], x)
        return F.struct(new.alias("a"), F.concat(acc["o"], shown(new, x).array.col.cast(T.ArrayType(element))).alias("o"))

    return many(F.aggregate(items, F.struct(start.col.cast(kind).alias("a"), empty.alias("o")), scan, lambda z: z["o"]), element)


def _object(t, v, s):
    fields: dict[str, V] = {}
    for key, value in t[1]:
        if key[0] != "lit":
            raise Untyped("dynamic key")
        x = compile_tree(value, v, s)
        if x.many:
            raise Untyped("several values for a key")
        fields[str(key[1])] = x.v
    if not fields:
        raise Untyped("empty object")
    return one(F.struct(*(x.col.alias(n) for n, x in fields.items())), T.StructType([T.StructField(n, x.kind) for n, x in fields.items()]))


def _interp(t, v, s):
    parts = []
    for p in t[1]:
        if isinstance(p, str):
            parts.append(F.lit(p))
            continue
        x = compile_tree(p, v, s)
        kind = x.element
        parts.append(F.array_join(F.transform(x.v.col, lambda e: to_str(V(e, kind))), "") if x.many else to_str(x.v))
    return one(F.concat(*parts), STRING)


def _def(t, v, s):
    _, name, params, body, rest = t

    def calls(x) -> bool:
        return isinstance(x, tuple) and (x[:2] == ("call", name) and len(x[2]) == len(params) or any(map(calls, x)))

    if calls(body):
        raise Untyped("recursion")
    return compile_tree(rest, v, Scope(s.vars, {**s.funcs, (name, len(params)): (params, body, s)}))


def _call(t, v, s):
    _, name, args = t
    own = s.funcs.get((name, len(args)))
    if own:
        params, body, home = own
        if params is None:  # an argument: it runs in its caller's scope
            return compile_tree(body, v, home)
        inner = Scope(home.vars, {**home.funcs, **{(p, 0): (None, a, s) for p, a in zip(params, args)}})
        return compile_tree(body, v, inner)
    rule = _BUILTINS.get((name, len(args)))
    if rule is None:
        raise Untyped(name)
    return rule(v, *(_Arg(a, s) for a in args))


@dataclass(frozen=True)
class _Arg:
    """An argument of a builtin: a function of its input, and the tree it comes from."""

    tree: tuple
    scope: Scope

    def __call__(self, v: V) -> Stream:
        return compile_tree(self.tree, v, self.scope)


def _untyped(t, v, s):
    raise Untyped(t[0])


def _cmp(t, v, s):
    return one(compare(compile_tree(t[2], v, s).first(), compile_tree(t[3], v, s).first(), t[1]), BOOL)


_RULES = {
    "id": lambda t, v, s: Stream(v),
    "field": _field,
    "iter": lambda t, v, s: bind(compile_tree(t[1], v, s), _iterate),
    "index": _index,
    "collect": _collect,
    "comma": _comma,
    "pipe": _pipe,
    "as": _as,
    "alt": _alt,
    "or": lambda t, v, s: one(compile_tree(t[1], v, s).any() | compile_tree(t[2], v, s).any(), BOOL),
    "and": lambda t, v, s: one(compile_tree(t[1], v, s).any() & compile_tree(t[2], v, s).any(), BOOL),
    "cmp": _cmp,
    "arith": _arith,
    "neg": _neg,
    "not": lambda t, v, s: one(~compile_tree(t[1], v, s).any(), BOOL),
    "try": _untyped,
    "opt": _untyped,
    "if": _if,
    "reduce": _reduce,
    "foreach": _reduce,
    "label": _untyped,
    "break": _untyped,
    "def": _def,
    "object": _object,
    "interp": _interp,
    "lit": lambda t, v, s: Stream(literal(t[1])),
    "empty": lambda t, v, s: many(F.array(), NULL),
    "var": lambda t, v, s: s.vars[t[1]],
    "call": _call,
}

# ---- builtins that have a typed form

_BUILTINS: dict[tuple[str, int], Callable[..., Stream]] = {}


def _builtin(*names: str, args: int = 0):
    def keep(f):
        for n in names:
            _BUILTINS[n, args] = f
        return f

    return keep


@_builtin("length")
def _length(v):
    if v.is_string:
        n = F.octet_length(v.col)
    elif _is_list(v) or isinstance(v.kind, T.MapType):
        n = F.size(v.col)
    elif isinstance(v.kind, T.StructType):
        n = sum((v.col[f.name].isNotNull().cast("int") for f in v.kind.fields), F.lit(0))
    elif v.is_number:
        return one(F.coalesce(F.abs(v.col), F.lit(0)), v.kind)
    else:
        raise Untyped("length")
    return one(F.when(v.col.isNull(), 0).otherwise(n).cast("bigint"), LONG)


@_builtin("utf8bytelength")
def _bytes(v):
    return one(F.octet_length(_text(v, "utf8bytelength")).cast("bigint"), LONG)


def _type_name(v: V) -> str:
    return "boolean" if v.is_bool else "number" if v.is_number else "array" if _is_list(v) else "object" if _is_object(v) else "null" if v.is_null else "string"


@_builtin("type")
def _type(v):
    return one(F.when(v.col.isNull(), "null").otherwise(_type_name(v)), STRING)


def _kind_filter(kinds: tuple[str, ...]):
    def f(v):
        keep = v.col.isNotNull() & (_type_name(v) in kinds) | v.col.isNull() & ("null" in kinds)
        return many(F.filter(F.array(v.col), lambda x: keep), v.kind)

    return f


for _n, _k in {"objects": ("object",), "arrays": ("array",), "strings": ("string",), "numbers": ("number",), "booleans": ("boolean",), "nulls": ("null",), "iterables": ("array", "object"), "scalars": ("null", "boolean", "number", "string")}.items():
    _BUILTINS[_n, 0] = _kind_filter(_k)
_BUILTINS["not_null", 0] = lambda v: many(F.filter(F.array(v.col), lambda x: x.isNotNull()), v.kind)


@_builtin("keys", "keys_unsorted")
def _keys(v):
    if _is_list(v):
        n = F.size(v.col)
        return one(F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>")), T.ArrayType(LONG))
    if isinstance(v.kind, T.MapType):
        return one(F.array_sort(F.map_keys(v.col)), T.ArrayType(v.kind.keyType))
    if isinstance(v.kind, T.StructType):
        names = [F.when(v.col[n].isNotNull(), n) for n in sorted(v.kind.fieldNames())]
        return one(F.filter(F.array(*names), lambda x: x.isNotNull()), T.ArrayType(STRING))
    raise Untyped("keys")


@_builtin("values")
def _values(v):
    return Stream(_iterate(v).v) if _is_object(v) else Stream(v)


@_builtin("add")
def _add(v):
    kind = _list(v, "add").kind.elementType
    x = V(F.lit(None), kind)
    real = F.filter(v.col, lambda e: e.isNotNull())
    if x.is_string:
        out = F.array_join(real, "")
    elif x.is_int and not x.is_bool:
        kind, out = LONG, F.aggregate(real, F.lit(0).cast("bigint"), lambda a, e: F.try_add(a, e.cast("bigint")))
    elif x.is_float:
        kind, out = DOUBLE, F.aggregate(real, F.lit(0.0), lambda a, e: a + e.cast("double"))
    elif isinstance(kind, T.ArrayType):
        out = F.flatten(real)
    else:
        raise Untyped("add")
    return one(F.when(F.size(real) > 0, out), kind)


@_builtin("tostring", "@text")
def _tostring(v):
    if _is_list(v) or _is_object(v):
        raise Untyped("tostring")
    return one(to_str(v), STRING)


@_builtin("tonumber")
def _tonumber(v):
    if v.is_number and not v.is_bool:
        return Stream(v)
    raise Untyped("tonumber")


def _text_rule(name: str, f: Callable[[Column], Column]) -> None:
    _BUILTINS[name, 0] = lambda v: one(f(_text(v, name)), STRING)


_text_rule("ascii_downcase", F.lower)
_text_rule("ascii_upcase", F.upper)
_text_rule("@base64", lambda c: F.regexp_replace(F.base64(F.encode(c, "UTF-8")), "[\r\n]", ""))
_text_rule("@html", lambda c: _replaced(c, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")))
_text_rule("@uri", lambda c: _replaced(F.url_encode(c), ("*", "%2A"), ("%7E", "~")))


def _replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _constant(x: Stream, what: str) -> Column:
    return _text(x.first(), what)


@_builtin("startswith", args=1)
def _startswith(v, a):
    return one(_text(v, "startswith").startswith(_constant(a(v), "startswith")), BOOL)


@_builtin("endswith", args=1)
def _endswith(v, a):
    return one(_text(v, "endswith").endswith(_constant(a(v), "endswith")), BOOL)


@_builtin("ltrimstr", args=1)
def _ltrimstr(v, a):
    s, p = _text(v, "ltrimstr"), _constant(a(v), "ltrimstr")
    return one(F.when(s.startswith(p), F.substring(s, F.length(p) + 1, F.length(s))).otherwise(s), STRING)


@_builtin("rtrimstr", args=1)
def _rtrimstr(v, a):
    s, p = _text(v, "rtrimstr"), _constant(a(v), "rtrimstr")
    return one(F.when(s.endswith(p), F.substring(s, F.lit(1), F.length(s) - F.length(p))).otherwise(s), STRING)


@_builtin("split", args=1)
def _split(v, a):
    s, p = _text(v, "split"), _constant(a(v), "split")
    letters = F.filter(F.split(s, ""), lambda x: x != "")
    return one(F.when(p == "", letters).otherwise(F.split(s, F.concat(F.lit("\\Q"), p, F.lit("\\E")), -1)), T.ArrayType(STRING))


@_builtin("join", args=1)
def _join(v, a):
    kind = _list(v, "join").kind.elementType
    return one(F.array_join(F.transform(v.col, lambda x: F.when(x.isNotNull(), to_str(V(x, kind)))), _constant_text(a), "null"), STRING)


def _constant_text(arg) -> str:
    """The text of an argument that is a literal, where Spark needs one."""
    if arg.tree[0] != "lit" or not isinstance(arg.tree[1], str):
        raise Untyped("argument that is no literal")
    return arg.tree[1]


def _regex(p: str) -> str:
    return p.replace("(?P<", "(?<")


@_builtin("test", args=1)
def _test(v, a):
    return one(_text(v, "test").rlike(_regex(_constant_text(a))), BOOL)


@_builtin("gsub", args=2)
def _gsub(v, a, b):
    return one(F.regexp_replace(_text(v, "gsub"), F.lit(_regex(_constant_text(a))), F.lit(_constant_text(b))), STRING)


@_builtin("explode")
def _explode(v):
    s = _text(v, "explode")
    return one(F.transform(F.filter(F.split(s, ""), lambda x: x != ""), lambda c: F.ascii(c).cast("bigint")), T.ArrayType(LONG))


@_builtin("implode")
def _implode(v):
    kind = _list(v, "implode").kind.elementType
    if not V(F.lit(None), kind).is_int:
        raise Untyped("implode")
    wide = F.transform(v.col, lambda c: F.lpad(F.hex(c.cast("bigint")), 8, "0"))
    odd = F.exists(v.col, lambda c: F.coalesce((c < 0) | (c >= 0x110000), F.lit(True)))
    return one(F.when(odd, _fail("implode: no code point", STRING)).otherwise(F.decode(F.unhex(F.array_join(wide, "")), "UTF-32")), STRING)


@_builtin("ascii")
def _ascii(v):
    s = _text(v, "ascii")
    first = F.conv(F.substring(F.hex(F.encode(s, "UTF-8")), 1, 2), 16, 10).cast("bigint")
    return one(F.when(F.coalesce(s, F.lit("")) == "", _fail("ascii: empty string", LONG)).otherwise(first), LONG)


@_builtin("@base64d")
def _unbase64(v):
    s = _text(v, "@base64d")
    plain = F.translate(F.concat(s, F.repeat(F.lit("="), F.pmod(-F.length(s), F.lit(4)))), "-_", "+/")
    raw = F.try_to_binary(plain, F.lit("base64"))
    text = F.try_validate_utf8(raw.cast("string"))
    return one(F.when(text.isNull(), _fail("@base64d: the input is no base64", STRING)).otherwise(text), STRING)


@_builtin("transpose")
def _transpose(v):
    kind = _list(v, "transpose").kind.elementType
    if not isinstance(kind, T.ArrayType):
        raise Untyped("transpose")
    n = F.coalesce(F.array_max(F.transform(v.col, lambda r: F.size(r))), F.lit(0))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return one(F.transform(places, lambda i: F.transform(v.col, lambda r: F.get(r, i))), T.ArrayType(kind))


def _json_text(v: V) -> Column:
    """A value as JSON, keys in order; numbers with a fraction aren't written alike everywhere."""
    if isinstance(v.kind, T.StructType):
        parts = [F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ":"), _json_text(V(v.col[n], v.kind[n].dataType))) for n in sorted(v.kind.fieldNames())]
        out = F.concat(F.lit("{"), *(x for i, part in enumerate(parts) for x in ([F.lit(",")] if i else []) + [part]), F.lit("}"))
    elif _is_list(v):
        kind = v.kind.elementType
        out = F.concat(F.lit("["), F.array_join(F.transform(v.col, lambda x: _json_text(V(x, kind))), ","), F.lit("]"))
    elif v.is_string:
        out = F.regexp_extract(F.to_json(F.array(v.col)), r"(?s)^\[(.*)\]$", 1)
    elif v.is_bool or v.is_int:
        out = v.col.cast("string")
    else:
        raise Untyped("tojson")
    return F.when(v.col.isNull(), "null").otherwise(out)


@_builtin("tojson", "@json")
def _tojson(v):
    return one(_json_text(v), STRING)


def _found(v: V, a, last: bool) -> Stream:
    x = a(v).first()
    if v.is_string and x.is_string and not last:
        at = F.locate(a.tree[1], v.col) if a.tree[0] == "lit" and a.tree[1] else None
        if at is None:
            raise Untyped("index")
        return one(F.when(at > 0, F.octet_length(F.substring(v.col, F.lit(1), at - 1)).cast("bigint")), LONG)
    places = _indices(v, a).v.col
    return one(F.get(places, F.size(places) - 1 if last else F.lit(0)), LONG)


@_builtin("indices", args=1)
def _indices(v, a):
    kind, x = _list(v, "indices").kind.elementType, a(v).first()
    places = F.transform(v.col, lambda y, i: F.when(compare(V(y, kind), x, "eq"), i.cast("bigint")))
    return one(F.filter(places, lambda i: i.isNotNull()), T.ArrayType(LONG))


_BUILTINS["index", 1] = lambda v, a: _found(v, a, False)
_BUILTINS["rindex", 1] = lambda v, a: _found(v, a, True)


@_builtin("capture", args=1)
def _capture(v, a):
    p = _constant_text(a)
    names = re.compile(p).groupindex
    pairs = [x for n, i in names.items() for x in (F.lit(n), F.regexp_extract(_text(v, "capture"), _regex(p), i))]
    return one(F.when(_text(v, "capture").rlike(_regex(p)), F.array(*pairs) if pairs else F.array().cast("array<string>")), T.ArrayType(STRING))


@_builtin("scan", args=1)
def _scan(v, a):
    p, s = _constant_text(a), _text(v, "scan")
    groups = range(1, re.compile(p).groups + 1) or [0]
    every = [F.regexp_extract_all(s, F.lit(_regex(p)), F.lit(g)) for g in groups]
    return many(F.transform(every[0], lambda x, i: F.array(*(F.get(e, i) for e in every))), T.ArrayType(STRING))


@_builtin("splits", args=1)
def _splits(v, a):
    p = _constant_text(a)
    if re.compile(p).search("") is not None:
        raise Untyped("a pattern that matches nothing")
    return many(F.split(_text(v, "splits"), _regex(p), -1), STRING)


@_builtin("getpath", args=1)
def _getpath(v, a):
    try:
        (path,) = execute(a.tree, None)
    except PipeError:
        raise Untyped("path that isn't constant") from None
    for k in path if isinstance(path, list) else ():
        if isinstance(v.kind, T.StructType) and isinstance(k, str) and k in v.kind.fieldNames():
            v = V(v.col[k], v.kind[k].dataType)
        elif _is_list(v) and isinstance(k, int) and not isinstance(k, bool):
            v = V(F.get(v.col, F.lit(k) if k >= 0 else F.size(v.col) + k), v.kind.elementType)
        else:
            raise Untyped("getpath")
    return Stream(v)


@_builtin("map", args=1)
def _map(v, f):
    return Stream(bind(_iterate(_list(v, "map")), f).array)


@_builtin("select", args=1)
def _select(v, f):
    keep = f(v).any()
    return many(F.filter(F.array(v.col), lambda _: keep), v.kind)


def _sortable(v: V, what: str) -> V:
    if _is_object(V(v.col, _list(v, what).kind.elementType)):
        raise Untyped(what)
    return v


@_builtin("sort")
def _sort(v):
    return one(F.sort_array(_sortable(v, "sort").col), v.kind)


@_builtin("unique")
def _unique(v):
    return one(F.sort_array(F.array_distinct(_sortable(v, "unique").col)), v.kind)


def _keyed(v: V, f) -> tuple[Column, T.DataType]:
    """array<struct<k, i, x>> of a list with each element's key and place."""
    kind = _list(v, "by").kind.elementType
    key = f(V(F.lit(None).cast(kind), kind)).first()
    if _is_object(key) or _is_list(key):
        raise Untyped("key that is no simple value")
    return F.transform(v.col, lambda x, i: F.struct(f(V(x, kind)).first().col.alias("k"), i.alias("i"), x.alias("x"))), key.kind


@_builtin("sort_by", args=1)
def _sort_by(v, f):
    pairs, _ = _keyed(v, f)
    ordered = F.array_sort(pairs, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise((a["i"] > b["i"]).cast("int") - (a["i"] < b["i"]).cast("int")))
    return one(F.transform(ordered, lambda p: p["x"]), v.kind)


@_builtin("group_by", args=1)
def _group_by(v, f):
    pairs, kind = _keyed(v, f)
    name = lambda p: to_str(V(p["k"], kind)) if not kind == STRING else F.coalesce(p["k"], F.lit("null"))
    names = F.array_sort(F.array_distinct(F.transform(pairs, name)))
    return one(F.transform(names, lambda n: F.transform(F.filter(pairs, lambda p: name(p) == n), lambda p: p["x"])), T.ArrayType(v.kind))


@_builtin("unique_by", args=1)
def _unique_by(v, f):
    pairs, _ = _keyed(v, f)
    fresh = F.filter(pairs, lambda p: ~F.exists(F.slice(pairs, F.lit(1), p["i"]), lambda q: q["k"].eqNullSafe(p["k"])))
    return one(F.transform(fresh, lambda p: p["x"]), v.kind)


def _best_by(sign: int):
    def rule(v, f):
        pairs, _ = _keyed(v, f)
        real = F.filter(pairs, lambda p: p["k"].isNotNull())
        better = lambda a, b: F.when((a["k"] < b["k"]) if sign < 0 else (a["k"] > b["k"]), -1).when((a["k"] > b["k"]) if sign < 0 else (a["k"] < b["k"]), 1).otherwise((a["i"] > b["i"]).cast("int") - (a["i"] < b["i"]).cast("int"))
        return one(F.get(F.array_sort(real, better), F.lit(0))["x"], v.kind.elementType)

    return rule


_BUILTINS["min_by", 1], _BUILTINS["max_by", 1] = _best_by(-1), _best_by(1)


@_builtin("min")
def _min(v):
    return one(F.array_min(_sortable(v, "min").col), v.kind.elementType)


@_builtin("max")
def _max(v):
    return one(F.array_max(_sortable(v, "max").col), v.kind.elementType)


@_builtin("any")
def _any(v):
    return one(Stream(_list(v, "any"), True).any(), BOOL)


@_builtin("all")
def _all(v):
    kind = _list(v, "all").kind.elementType
    return one(F.coalesce(F.forall(v.col, lambda x: truthy(V(x, kind))), F.lit(True)), BOOL)


@_builtin("any", args=1)
def _any_of(v, f):
    kind = _list(v, "any").kind.elementType
    return one(F.coalesce(F.exists(v.col, lambda x: f(V(x, kind)).any()), F.lit(False)), BOOL)


@_builtin("all", args=1)
def _all_of(v, f):
    kind = _list(v, "all").kind.elementType
    return one(F.coalesce(F.forall(v.col, lambda x: f(V(x, kind)).any()), F.lit(True)), BOOL)


@_builtin("first")
def _first(v):
    return one(F.get(v.col, F.lit(0)), v.kind.elementType) if _is_list(v) else Stream(v)


@_builtin("last")
def _last(v):
    return one(F.get(v.col, F.size(v.col) - 1), v.kind.elementType) if _is_list(v) else Stream(v)


@_builtin("first", args=1)
def _first_of(v, f):
    a = f(v).array
    return Stream(V(F.slice(a.col, 1, 1), a.kind), True)


@_builtin("last", args=1)
def _last_of(v, f):
    a = f(v).array
    return Stream(V(F.when(F.size(a.col) > 0, F.slice(a.col, -1, 1)).otherwise(a.col), a.kind), True)


@_builtin("limit", args=2)
def _limit(v, n, f):
    a, k = f(v).array, int_view(n(v).first())
    return Stream(V(F.slice(a.col, F.lit(1), F.greatest(k, F.lit(0)).cast("int")), a.kind), True)


@_builtin("nth", args=1)
def _nth(v, n):
    at = int_view(n(v).first())
    return one(F.get(_list(v, "nth").col, F.when(at < 0, at + F.size(v.col)).otherwise(at).cast("int")), v.kind.elementType)


@_builtin("flatten")
def _flatten(v):
    col, kind = _list(v, "flatten").col, v.kind
    while isinstance(kind.elementType, T.ArrayType):
        col, kind = F.flatten(F.filter(col, lambda x: x.isNotNull())), kind.elementType
    return one(col, kind)


@_builtin("reverse")
def _reverse(v):
    if not v.is_string and not _is_list(v):
        raise Untyped("reverse")
    return one(F.reverse(v.col), v.kind)


@_builtin("contains", args=1)
def _contains(v, a):
    return one(_text(v, "contains").contains(_constant(a(v), "contains")), BOOL)


@_builtin("inside", args=1)
def _inside(v, a):
    return one(_constant(a(v), "inside").contains(_text(v, "inside")), BOOL)


@_builtin("range")
def _range(v):
    n = int_view(_number(v))
    if n is None:
        raise Untyped("range")
    run = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), F.least(n, F.lit(10_000)) - 1)).otherwise(F.array().cast("array<bigint>"))
    return many(F.when(n > 10_000, _fail("range: more than 10000", T.ArrayType(LONG))).otherwise(run), LONG)


def _rounded(name: str, f: Callable[[Column], Column]) -> None:
    def rule(v):
        x = _number(v)
        return one(int_view(x) if x.is_int else f(float_view(x)).cast("bigint"), LONG)

    _BUILTINS[name, 0] = rule


_rounded("floor", F.floor)
_rounded("ceil", F.ceil)
_rounded("round", lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5))


def _math(name: str, f: Callable[[Column], Column]) -> None:
    _BUILTINS[name, 0] = lambda v: one(f(float_view(_number(v))), DOUBLE)


_math("fabs", F.abs)
_math("sqrt", F.sqrt)
_math("log", lambda x: F.when(x > 0, F.ln(x)).when(x == 0, -math.inf).otherwise(math.nan))
_BUILTINS["nan", 0] = lambda v: one(F.lit(math.nan), DOUBLE)
_BUILTINS["infinite", 0] = lambda v: one(F.lit(math.inf), DOUBLE)
_BUILTINS["isnan", 0] = lambda v: one(F.isnan(v.col) if v.is_float else F.lit(False), BOOL)
_BUILTINS["isinfinite", 0] = lambda v: one(F.abs(v.col.cast("double")) == math.inf if v.is_float else F.lit(False), BOOL)
_BUILTINS["isnormal", 0] = lambda v: one((v.col != 0) & ~F.isnan(v.col.cast("double")) & (F.abs(v.col.cast("double")) != math.inf) if v.is_number and not v.is_bool else F.lit(False), BOOL)


@_builtin("pow")
def _pow(v):
    kind = _list(v, "pow").kind.elementType
    _number(V(F.lit(None), kind))
    return one(F.pow(F.get(v.col, F.lit(0)).cast("double"), F.get(v.col, F.lit(1)).cast("double")), DOUBLE)


@_builtin("@csv")
def _csv(v):
    kind = _list(v, "@csv").kind.elementType
    quoted = lambda s: F.when(s.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)
    return one(F.array_join(F.transform(v.col, lambda x: quoted(to_str(V(x, kind)))), ","), STRING)


@_builtin("@tsv")
def _tsv(v):
    kind = _list(v, "@tsv").kind.elementType
    clean = lambda s: _replaced(s, ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\\", "\\\\"))
    return one(F.array_join(F.transform(v.col, lambda x: clean(to_str(V(x, kind)))), "\t"), STRING)


@_builtin("has", args=1)
def _has(v, k):
    if isinstance(v.kind, T.MapType):
        return one(F.map_contains_key(v.col, k(v).first().col), BOOL)
    if isinstance(v.kind, T.StructType) and k.tree[0] == "lit":
        return one(F.when(v.col.isNull(), _fail("has needs an object", BOOL)).otherwise(F.lit(k.tree[1] in v.kind.fieldNames())), BOOL)
    raise Untyped("has")


@_builtin("to_entries")
def _to_entries(v):
    if isinstance(v.kind, T.MapType):
        return one(F.array_sort(F.map_entries(v.col)), T.ArrayType(T.StructType([T.StructField("key", v.kind.keyType), T.StructField("value", v.kind.valueType)])))
    raise Untyped("to_entries")


_BUILTINS["env", 0] = _BUILTINS["input", 0] = lambda v: Stream(null())
_BUILTINS["debug", 0] = lambda v: Stream(v)
_BUILTINS["inputs", 0] = lambda v: many(F.array(), NULL)
