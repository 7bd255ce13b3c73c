"""Interpreter of pipelines over plain Python values.

It defines what every construct means and runs, batch by batch, the programs that can't be typed before they run;
all others are compiled to columns. Values are None, bool, int, float, str, list and dict. Whole numbers have 64 bits: a
result beyond them is null, as in columns.
"""

from __future__ import annotations

import base64
import functools
import html
import itertools
import json
import math
import re
import urllib.parse
from collections.abc import Callable

from .syntax import BUILTINS

LOOPS = 10_000


class PipeError(Exception):
    """An error of a program; try and ? catch it."""


class TooDeep(PipeError):
    """A walk that doesn't end; an outer recurse doesn't take it for the end of a branch."""


class _Break(Exception):
    def __init__(self, name: str, value):
        self.name, self.value = name, value


def truthy(v) -> bool:
    return not (v is None or v is False or v == 0 and isinstance(v, (int, float)) or v == "" or isinstance(v, (list, dict)) and not v)


def type_name(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def float_text(x: float) -> str:
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    if x == int(x):
        return str(int(x)) if x or math.copysign(1, x) > 0 else "-0"
    s = repr(x)
    return format(__import__("decimal").Decimal(s), "f") if "e" in s else s


def text_of(v) -> str:
    """Text of a simple value; containers are placeholders."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return float_text(v)
    if isinstance(v, list):
        return "[" + ",".join(map(text_of, v)) + "]"
    return "<object>" if isinstance(v, dict) else str(v)


def compare(a, b) -> int | None:
    """-1, 0 or 1; None where the values can't be compared."""
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, (int, float)) and isinstance(b, (int, float)):
        if isinstance(a, float) and math.isnan(a) or isinstance(b, float) and math.isnan(b):
            return 0
        return (a > b) - (a < b)
    return None


_RANK = {"null": 0, "number": 3, "string": 4, "array": 5, "object": 6}


def order(a, b) -> int:
    """Total order: null, false, true, numbers, strings, arrays, objects."""
    rank = lambda v: (2 if v else 1) if isinstance(v, bool) else _RANK[type_name(v)]
    if rank(a) != rank(b):
        return -1 if rank(a) < rank(b) else 1
    if isinstance(a, list):
        for x, y in zip(a, b):
            if c := order(x, y):
                return c
        return (len(a) > len(b)) - (len(a) < len(b))
    if isinstance(a, dict):
        return order(sorted(a), sorted(b)) or next((c for k in sorted(a) if (c := order(a[k], b[k]))), 0)
    return compare(a, b) or 0


def equal(a, b) -> bool:
    return compare(a, b) == 0


def items(v, what: str) -> list:
    if not isinstance(v, list):
        raise PipeError(f"{what}: input must be an array, got {type_name(v)}")
    return v


def text(v, what: str) -> str:
    if not isinstance(v, str):
        raise PipeError(f"{what} needs a string, got {type_name(v)}")
    return v


def pattern(p) -> re.Pattern:
    try:
        return re.compile(text_of(p))
    except re.error as e:
        raise PipeError(f"invalid regex {p!r}: {e}") from None


def contains(a, b) -> bool:
    if b is None:
        return True
    if isinstance(a, str) and isinstance(b, str):
        return b in a
    if isinstance(a, list) and isinstance(b, list):
        return all(any(contains(x, y) for x in a) for y in b)
    return equal(a, b)


def bounded(n: int) -> int | None:
    """A whole number, or null where it has more than 64 bits."""
    return n if -(2**63) <= n < 2**63 else None


def _merge(a: dict, b: dict, deep: bool) -> dict:
    out = dict(a)
    for k, v in b.items():
        out[k] = _merge(out[k], v, True) if deep and isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def arith(op: str, a, b):
    if op == "+":
        if isinstance(a, str) and isinstance(b, str) or isinstance(a, list) and isinstance(b, list):
            return a + b
        if isinstance(a, dict) and isinstance(b, dict):
            return _merge(a, b, False)
        if a is None or b is None:
            return b if a is None else a
    if op == "*" and isinstance(a, dict) and isinstance(b, dict):
        return _merge(a, b, True)
    if not isinstance(a, (int, float)) or not isinstance(b, (int, float)):
        raise PipeError(f"{type_name(a)} and {type_name(b)} can't be combined with {op}")
    if op in "/%" and not b:
        raise PipeError("division by zero")
    if isinstance(a, int) and isinstance(b, int):
        a, b = int(a), int(b)
        if op == "/":
            return bounded(abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1))
        if op == "%":
            return abs(a) % abs(b) * (1 if a >= 0 else -1)
        return bounded({"+": a + b, "-": a - b, "*": a * b}[op])
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: math.fmod(a, b)}[op]()


def to_json(v) -> str:
    return json.dumps(v, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def walk_paths(v, at: list):
    """(path, value) of everything below v, children before parents."""
    steps = enumerate(v) if isinstance(v, list) else sorted(v.items()) if isinstance(v, dict) else ()
    for k, x in steps:
        yield from walk_paths(x, [*at, k])
        yield [*at, k], x


def get_path(v, path: list):
    for k in path:
        if isinstance(v, dict) and isinstance(k, str):
            v = v.get(k)
        elif isinstance(v, list) and isinstance(k, int):
            v = v[k] if -len(v) <= k < len(v) else None
        else:
            return None
    return v


def set_path(v, path: list, new):
    if not path:
        return new
    k, rest = path[0], path[1:]
    if isinstance(k, int) and isinstance(v, list):
        out = list(v)
        if not -len(out) <= k < len(out):
            raise PipeError("setpath: index out of range")
        out[k] = set_path(out[k], rest, new)
        return out
    out = dict(v) if isinstance(v, dict) else {}
    out[str(k)] = set_path(out.get(str(k)), rest, new)
    return out


def del_path(v, path: list):
    k, rest = path[0], path[1:]
    if isinstance(v, dict) and k in v:
        if rest:
            return {**v, k: del_path(v[k], rest)}
        return {x: y for x, y in v.items() if x != k}
    if isinstance(v, list) and isinstance(k, int) and -len(v) <= k < len(v):
        k %= len(v)
        return [*v[:k], *([del_path(v[k], rest)] if rest else []), *v[k + 1 :]]
    return v


#: Functions of one value: name -> value -> list of outputs.
PLAIN: dict[str, Callable] = {}


def plain(*names: str):
    def keep(f):
        for n in names:
            PLAIN[n] = f
        return f

    return keep


def _one(name: str, f: Callable) -> None:
    PLAIN[name] = lambda v: [f(v)]


def _length(v):
    if v is None:
        return 0
    if isinstance(v, bool):
        raise PipeError("boolean has no length")
    if isinstance(v, (int, float)):
        return abs(v)
    return len(v.encode()) if isinstance(v, str) else len([x for x in v.values() if x is not None]) if isinstance(v, dict) else len(v)


def _add(v):
    real = [x for x in v if x is not None] if isinstance(v, list) else []
    if not real:
        return None
    if isinstance(real[0], str):
        return "".join(x if isinstance(x, str) else text_of(x) for x in real)
    if isinstance(real[0], list):
        return [y for x in real if isinstance(x, list) for y in x]
    if isinstance(real[0], dict):
        return functools.reduce(lambda a, b: _merge(a, b, False), (x for x in real if isinstance(x, dict)))
    total = sum(x for x in real if isinstance(x, (int, float)))
    return bounded(total) if isinstance(total, int) else total


def _tonumber(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float)):
        return v
    s = text(v, "tonumber")
    try:
        return float(s) if re.search("[.eE]", s) else int(s)
    except ValueError:
        raise PipeError(f"{s!r} is no number") from None


def _flatten(v: list) -> list:
    return [y for x in v for y in (_flatten(x) if isinstance(x, list) else [x])]


def _unique(v: list) -> list:
    out: list = []
    for x in sorted(v, key=functools.cmp_to_key(order)):
        if not out or order(out[-1], x):
            out.append(x)
    return out


def _extreme(v: list, sign: int):
    best = None
    for x in v:
        if best is None or (c := compare(x, best)) is not None and c * sign > 0:
            best = x
    return best


def _whole(v, f):
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise PipeError(f"a number is needed, got {type_name(v)}")
    return v if isinstance(v, int) else int(f(v))


def _math(v, f):
    if not isinstance(v, (int, float)):
        raise PipeError(f"a number is needed, got {type_name(v)}")
    return f(float(v))


def _log(x: float) -> float:
    return math.log(x) if x > 0 else -math.inf if x == 0 else math.nan


def _range(v):
    n = _whole(v, math.floor)
    if n > LOOPS:
        raise PipeError(f"range: {n} is more than {LOOPS}")
    return list(range(n))


def _fromjson(v):
    whole = lambda x: int(x) if isinstance(x, float) and x == x and abs(x) < 2**63 and x == int(x) else {k: whole(y) for k, y in x.items()} if isinstance(x, dict) else [whole(y) for y in x] if isinstance(x, list) else x
    try:
        return whole(json.loads(text(v, "fromjson")))
    except ValueError as e:
        raise PipeError(f"fromjson: {e}") from None


def _entries(v):
    if not isinstance(v, dict):
        raise PipeError(f"to_entries needs an object, got {type_name(v)}")
    return [{"key": k, "value": x} for k, x in v.items()]


def _from_entries(v):
    out = {}
    for e in items(v, "from_entries"):
        if isinstance(e, dict):
            key = next((e[k] for k in ("key", "name", "k", "Key", "Name") if e.get(k) is not None), None)
            out[text_of(key)] = next((e[k] for k in ("value", "v", "Value") if k in e), None)
        elif isinstance(e, list) and len(e) == 2:
            out[text_of(e[0])] = e[1]
        else:
            raise PipeError("from_entries needs objects or pairs")
    return out


def _csv(x) -> str:
    s = "" if x is None else text_of(x)
    return '"' + s.replace('"', '""') + '"' if re.search('[,"\n]', s) else s


def _tsv(x) -> str:
    s = "" if x is None else text_of(x)
    return s.replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r").replace("\\", "\\\\")


def _unbase64(v) -> str:
    s = text(v, "@base64d")
    for decode in (base64.b64decode, base64.urlsafe_b64decode):
        try:
            return decode(s + "=" * (-len(s) % 4), **({"validate": True} if decode is base64.b64decode else {})).decode()
        except ValueError:
            continue
    raise PipeError("@base64d: the input is no base64")


def _keys(v):
    if isinstance(v, dict):
        return sorted(k for k, x in v.items() if x is not None)
    return list(range(len(items(v, "keys"))))


def _iterate(v) -> list:
    if isinstance(v, list):
        return v
    if isinstance(v, dict):
        return [x for x in v.values() if x is not None]
    raise PipeError(f"{type_name(v)} can't be iterated")


for _name, _f in {
    "length": _length,
    "utf8bytelength": lambda v: len(text(v, "utf8bytelength").encode()),
    "type": type_name,
    "keys": _keys,
    "keys_unsorted": _keys,
    "values": lambda v: v if isinstance(v, list) else [x for x in v.values() if x is not None] if isinstance(v, dict) else v,
    "add": _add,
    "tostring": lambda v: "" if v is None else text_of(v),
    "tonumber": _tonumber,
    "ascii_downcase": lambda v: text(v, "ascii_downcase").lower(),
    "ascii_upcase": lambda v: text(v, "ascii_upcase").upper(),
    "explode": lambda v: [ord(c) for c in text(v, "explode")],
    "implode": lambda v: "".join(chr(c) if isinstance(c, int) and 0 <= c < 0x110000 else _raise("implode: no code point") for c in items(v, "implode")),
    "ascii": lambda v: text(v, "ascii").encode()[0] if v else _raise("ascii: empty string"),
    "sort": lambda v: sorted(items(v, "sort"), key=functools.cmp_to_key(order)),
    "unique": lambda v: _unique(items(v, "unique")),
    "min": lambda v: _extreme(items(v, "min"), -1),
    "max": lambda v: _extreme(items(v, "max"), 1),
    "any/0": lambda v: any(map(truthy, items(v, "any"))),
    "all/0": lambda v: all(map(truthy, items(v, "all"))),
    "first/0": lambda v: (v[0] if v else None) if isinstance(v, list) else v,
    "last/0": lambda v: (v[-1] if v else None) if isinstance(v, list) else v,
    "flatten": lambda v: _flatten(items(v, "flatten")),
    "reverse": lambda v: v[::-1] if isinstance(v, (str, list)) else _raise("reverse needs an array or a string"),
    "transpose": lambda v: [[r[i] if i < len(r) else None for r in v] for i in range(max(map(len, items(v, "transpose")), default=0))],
    "range": None,
    "floor": lambda v: _whole(v, math.floor),
    "ceil": lambda v: _whole(v, math.ceil),
    "round": lambda v: _whole(v, lambda x: math.copysign(math.floor(abs(x) + 0.5), x)),
    "fabs": lambda v: _math(v, abs),
    "sqrt": lambda v: _math(v, lambda x: math.sqrt(x) if x >= 0 else math.nan),
    "log": lambda v: _math(v, _log),
    "pow": lambda v: float(items(v, "pow")[0]) ** float(v[1]) if len(v) == 2 else _raise("pow needs [base, exponent]"),
    "nan": lambda v: math.nan,
    "infinite": lambda v: math.inf,
    "isnan": lambda v: isinstance(v, float) and math.isnan(v),
    "isinfinite": lambda v: isinstance(v, float) and math.isinf(v),
    "isnormal": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) and v != 0,
    "tojson": to_json,
    "@json": to_json,
    "fromjson": _fromjson,
    "@text": lambda v: "" if v is None else text_of(v),
    "@base64": lambda v: base64.b64encode(text_of(v).encode()).decode(),
    "@base64d": _unbase64,
    "@uri": lambda v: urllib.parse.quote_plus(text_of(v), safe=""),
    "@csv": lambda v: ",".join(map(_csv, items(v, "@csv"))),
    "@tsv": lambda v: "\t".join(map(_tsv, items(v, "@tsv"))),
    "@html": lambda v: html.escape(text_of(v)).replace("&quot;", "&#34;").replace("&#x27;", "&#39;"),
    "to_entries": _entries,
    "from_entries": _from_entries,
    "env": lambda v: None,
    "input": lambda v: None,
    "debug": lambda v: v,
    "builtins": lambda v: sorted(f"{n}/{k}" for n, ks in BUILTINS.items() for k in ks),
}.items():
    if _f:
        _one(_name, _f)

PLAIN["range"] = _range
PLAIN["not_null"] = lambda v: [] if v is None else [v]
for _name, _kinds in {"objects": ("object",), "arrays": ("array",), "strings": ("string",), "numbers": ("number",), "booleans": ("boolean",), "nulls": ("null",), "iterables": ("array", "object"), "scalars": ("null", "boolean", "number", "string")}.items():
    PLAIN[_name] = lambda v, kinds=_kinds: [v] if type_name(v) in kinds else []
PLAIN["paths/0"] = lambda v: [p for p, _ in walk_paths(v, [])]
PLAIN["leaf_paths"] = lambda v: [p for p, x in walk_paths(v, []) if not isinstance(x, (list, dict))]
PLAIN["inputs"] = lambda v: []


def _raise(message: str):
    raise PipeError(message)


#: Functions of a value and the first output of each argument.
WITH_VALUE: dict[str, Callable] = {
    "ltrimstr": lambda v, s: v[len(s) :] if isinstance(v, str) and isinstance(s, str) and v.startswith(s) else v,
    "rtrimstr": lambda v, s: v[: len(v) - len(s)] if isinstance(v, str) and isinstance(s, str) and v.endswith(s) else v,
    "startswith": lambda v, s: text(v, "startswith").startswith(text(s, "startswith")),
    "endswith": lambda v, s: text(v, "endswith").endswith(text(s, "endswith")),
    "split": lambda v, s: list(text(v, "split")) if s == "" else text(v, "split").split(text(s, "split")),
    "join": lambda v, s: text_of(s).join(map(text_of, items(v, "join"))),
    "test": lambda v, p: bool(pattern(p).search(text_of(v))),
    "match": lambda v, p: [len(text_of(v)[: m.start()].encode()), len(m.group().encode()), m.group()] if (m := pattern(p).search(text_of(v))) else None,
    "capture": lambda v, p: [x for k in m.re.groupindex for x in (k, m.group(k) or "")] if (m := pattern(p).search(text_of(v))) else None,
    "nth": lambda v, n: v[n] if isinstance(v, list) and -len(v) <= n < len(v) else None,
    "contains": contains,
    "inside": lambda v, x: contains(x, v),
    "has": lambda v, k: k in v if isinstance(v, dict) else _raise(f"has needs an object, got {type_name(v)}"),
    "in": lambda v, o: v in o if isinstance(o, dict) else _raise("in needs an object"),
    "getpath": lambda v, p: get_path(v, items(p, "getpath")),
    "delpaths": lambda v, ps: functools.reduce(del_path, sorted(items(ps, "delpaths"), key=functools.cmp_to_key(order), reverse=True), v),
    "error/1": lambda v, m: _raise(text_of(m)),
    "setpath": lambda v, p, x: set_path(v, items(p, "setpath"), x),
    "sub": lambda v, p, r: pattern(p).sub(lambda m: _template(m, text_of(r)), text_of(v), count=1),
    "gsub": lambda v, p, r: pattern(p).sub(lambda m: _template(m, text_of(r)), text_of(v)),
}


def _template(m: re.Match, r: str) -> str:
    def group(g: re.Match) -> str:
        name = g[1] or g[2]
        try:
            return m.group(int(name) if name.isdigit() else name) or ""
        except (IndexError, re.error):
            return ""

    return re.sub(r"\$(?:\{(\w+)\}|(\w+))", group, r)


def _indices(v, x) -> list[int]:
    if isinstance(v, str) and isinstance(x, str):
        b, s = v.encode(), x.encode()
        return [i for i in range(len(b) - len(s) + 1) if b[i : i + len(s)] == s] if s else []
    return [i for i, y in enumerate(items(v, "indices")) if equal(y, x)]


WITH_VALUE["indices"] = _indices
WITH_VALUE["index"] = lambda v, x: next(iter(_indices(v, x)), None)
WITH_VALUE["rindex"] = lambda v, x: next(iter(_indices(v, x)[::-1]), None)


class Scope:
    """Variables and functions in sight. A function is (parameters, body, scope of its definition)."""

    __slots__ = ("vars", "funcs")

    def __init__(self, variables: dict | None = None, functions: dict | None = None):
        self.vars, self.funcs = variables or {}, functions or {}

    def bind(self, name: str, values: list) -> "Scope":
        return Scope({**self.vars, name: values}, self.funcs)


def run(t: tuple, v, s: Scope) -> list:
    """All outputs of a tree for one value."""
    return _RUN[t[0]](t, v, s)


def _first(t: tuple, v, s: Scope):
    out = run(t, v, s)
    return out[0] if out else None


def _any(t: tuple, v, s: Scope) -> bool:
    return any(map(truthy, run(t, v, s)))


def _field(t, v, s):
    out = []
    for x in run(t[1], v, s):
        if x is None:
            out.append(None)
        elif isinstance(x, dict):
            out.append(x.get(t[2]))
        else:
            raise PipeError(f"{type_name(x)} has no field {t[2]!r}")
    return out


def _if(t, v, s):
    for c, then in t[1]:
        if _any(c, v, s):
            return run(then, v, s)
    return run(t[2], v, s) if t[2] is not None else [v]


def _try(t, v, s):
    try:
        return run(t[1], v, s)
    except PipeError as e:
        return run(t[2], str(e), s) if len(t) > 2 and t[2] is not None else []


def _alt(t, v, s):
    out = run(t[1], v, s)
    return out if any(map(truthy, out)) else run(t[2], v, s)


def _fold(t, v, s):
    _, source, var, init, update, *more = t
    acc, out = _first(init, v, s), []
    for x in run(source, v, s):
        inner = s.bind(var, [x])
        result = run(update, acc, inner)
        acc = result[0] if result else acc
        if t[0] == "foreach":
            out.extend(run(more[0], acc, inner) if more[0] is not None else [acc])
    return out if t[0] == "foreach" else [acc]


def _label(t, v, s):
    try:
        return run(t[2], v, s)
    except _Break as b:
        if b.name != t[1]:
            raise
        return [b.value]


def _break(t, v, s):
    raise _Break(t[1], v)


def _def(t, v, s):
    _, name, params, body, rest = t
    inner = Scope(s.vars, dict(s.funcs))
    inner.funcs[name, len(params)] = (params, body, inner)
    return run(rest, v, inner)


def _object(t, v, s):
    out = {}
    for k, e in t[1]:
        for key in run(k, v, s):
            for x in run(e, v, s):
                out[text_of(key)] = x
    return [out]


def _arith(t, v, s):
    return [arith(t[1], _first(t[2], v, s), _first(t[3], v, s))]


def _neg(t, v, s):
    x = _first(t[1], v, s)
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise PipeError(f"{type_name(x)} can't be negated")
    return [bounded(-x) if isinstance(x, int) else -x]


def _cmp(t, v, s):
    c = compare(_first(t[2], v, s), _first(t[3], v, s))
    return [c is not None and {"eq": c == 0, "ne": c != 0, "lt": c < 0, "le": c <= 0, "gt": c > 0, "ge": c >= 0}[t[1]]]


def _index(t, v, s):
    return [x[t[2]] if isinstance(x, list) and -len(x) <= t[2] < len(x) else None for x in run(t[1], v, s)]


def _by(args, v, s, what: str) -> list[tuple]:
    return [(_first(args[0], x, s), x) for x in items(v, what)]


def _rounds(name, args, v, s):
    """The values of while, until and repeat, one at a time; more than LOOPS rounds are an error, never a cut-off."""
    for _ in range(LOOPS):
        if name == "while" and not _any(args[0], v, s):
            return
        if name == "until" and _any(args[0], v, s):
            yield v
            return
        if name != "until":
            yield v
        step = run(args[-1], v, s)
        if not step:
            return
        v = step[0]
    raise PipeError(f"{name}: more than {LOOPS} rounds")


def _lazy(t: tuple, v, s: Scope):
    """The outputs of a tree one at a time, so that limit and first may stop a repeat."""
    if t[0] == "pipe":
        for x in _lazy(t[1], v, s):
            yield from _lazy(t[2], x, s)
    elif t[0] == "comma":
        for e in t[1]:
            yield from _lazy(e, v, s)
    elif t[0] == "call" and t[1] in ("while", "until", "repeat") and (t[1], len(t[2])) not in s.funcs:
        yield from _rounds(t[1], t[2], v, s)
    else:
        yield from run(t, v, s)


def _limit(args, v, s) -> list:
    return list(itertools.islice(_lazy(args[1], v, s), max(0, _first(args[0], v, s))))


def _recurse(args, v, s) -> list:
    """Every value, parents first. A record ends by itself; recurse(f) is an error once a chain has more than LOOPS values."""
    out, todo = [], [iter((v,))]
    while todo:
        try:
            x = next(todo[-1])
        except StopIteration:
            todo.pop()
            continue
        if args and len(todo) > LOOPS:
            raise TooDeep(f"recurse: a chain of more than {LOOPS} values")
        out.append(x)
        try:
            todo.append(iter(run(args[0], x, s) if args else _iterate(x)))
        except TooDeep:
            raise
        except PipeError:
            pass
    return out


def _call(t, v, s):
    _, name, args = t
    own = s.funcs.get((name, len(args)))
    if own:
        params, body, home = own
        inner = Scope(home.vars, dict(home.funcs))
        for p, a in zip(params, args):
            inner.funcs[p, 0] = ((), a, s)
        try:
            return run(body, v, inner)
        except RecursionError:
            raise PipeError(f"{name} calls itself too deeply") from None
    try:
        return _builtin(name, args, v, s)
    except (TypeError, ValueError, KeyError, IndexError, OverflowError, AttributeError) as e:
        raise PipeError(f"{name}: {e}") from None


def _builtin(name, args, v, s):
    plain_name = name if name in PLAIN and not args else f"{name}/0" if not args else ""
    if plain_name in PLAIN:
        return PLAIN[plain_name](v)
    key = f"{name}/1" if name == "error" else name
    if name == "error" and not args:
        raise PipeError(text_of(v))
    if key in WITH_VALUE:
        return [WITH_VALUE[key](v, *(_first(a, v, s) for a in args))]
    return _STREAM[name](args, v, s)


def _min_by(args, v, s, sign, what):
    best = None
    for k, x in _by(args, v, s, what):
        if best is None or (c := compare(k, best[0])) is not None and c * sign > 0:
            best = (k, x)
    return [best[1] if best else None]


def _group_by(args, v, s):
    groups: dict[str, list] = {}
    for k, x in _by(args, v, s, "group_by"):
        groups.setdefault(text_of(k), []).append(x)
    return [[groups[k] for k in sorted(groups)]]


def _unique_by(args, v, s):
    seen: dict[str, object] = {}
    for k, x in _by(args, v, s, "unique_by"):
        seen.setdefault(text_of(k), x)
    return [list(seen.values())]


def _path_of(args, v, s):
    want = run(args[0], v, s)
    every = list(walk_paths(v, []))
    return [next((p for p, x in every if type(x) is type(w) and x == w), None) for w in want]


def _scan(args, v, s):
    out = []
    for m in pattern(_first(args[0], v, s)).finditer(text(v, "scan")):
        out.append([m.group()] if not m.re.groups else [g or "" for g in m.groups()])
    return out


def _splits(args, v, s):
    p, at, out = pattern(_first(args[0], v, s)), 0, []
    for m in p.finditer(text(v, "splits")):
        out.append(v[at : m.start()])
        at = m.end()
    return [*out, v[at:]]


_STREAM: dict[str, Callable] = {
    "select": lambda a, v, s: [v] if _any(a[0], v, s) else [],
    "map": lambda a, v, s: [[y for x in items(v, "map") for y in run(a[0], x, s)]],
    "sort_by": lambda a, v, s: [[x for _, x in sorted(_by(a, v, s, "sort_by"), key=functools.cmp_to_key(lambda p, q: compare(p[0], q[0]) or 0))]],
    "group_by": _group_by,
    "unique_by": _unique_by,
    "min_by": lambda a, v, s: _min_by(a, v, s, -1, "min_by"),
    "max_by": lambda a, v, s: _min_by(a, v, s, 1, "max_by"),
    "any": lambda a, v, s: [any(_any(a[0], x, s) for x in items(v, "any"))],
    "all": lambda a, v, s: [all(_any(a[0], x, s) for x in items(v, "all"))],
    "limit": _limit,
    "first": lambda a, v, s: list(itertools.islice(_lazy(a[0], v, s), 1)),
    "last": lambda a, v, s: run(a[0], v, s)[-1:],
    "scan": _scan,
    "splits": _splits,
    "with_entries": lambda a, v, s: [_from_entries([y for e in _entries(v) for y in run(a[0], e, s)])],
    "paths": lambda a, v, s: [p for p, x in [*walk_paths(v, []), ([], v)] if _safe(a[0], x, s)],
    "path": _path_of,
    "recurse": _recurse,
    "while": lambda a, v, s: list(_rounds("while", a, v, s)),
    "until": lambda a, v, s: list(_rounds("until", a, v, s)),
    "repeat": lambda a, v, s: list(_rounds("repeat", a, v, s)),
}


def _safe(t, v, s) -> bool:
    try:
        return _any(t, v, s)
    except PipeError:
        return False


_RUN: dict[str, Callable] = {
    "id": lambda t, v, s: [v],
    "field": _field,
    "iter": lambda t, v, s: [y for x in run(t[1], v, s) for y in _iterate(x)],
    "index": _index,
    "collect": lambda t, v, s: [run(t[1], v, s)],
    "comma": lambda t, v, s: [x for e in t[1] for x in run(e, v, s)],
    "pipe": lambda t, v, s: [y for x in run(t[1], v, s) for y in run(t[2], x, s)],
    "as": lambda t, v, s: run(t[3], v, s.bind(t[2], run(t[1], v, s))),
    "alt": _alt,
    "or": lambda t, v, s: [_any(t[1], v, s) or _any(t[2], v, s)],
    "and": lambda t, v, s: [_any(t[1], v, s) and _any(t[2], v, s)],
    "cmp": _cmp,
    "arith": _arith,
    "neg": _neg,
    "not": lambda t, v, s: [not _any(t[1], v, s)],
    "try": _try,
    "opt": _try,
    "if": _if,
    "reduce": _fold,
    "foreach": _fold,
    "label": _label,
    "break": _break,
    "def": _def,
    "object": _object,
    "interp": lambda t, v, s: ["".join(p if isinstance(p, str) else "".join("" if x is None else text_of(x) for x in run(p, v, s)) for p in t[1])],
    "lit": lambda t, v, s: [t[1]],
    "empty": lambda t, v, s: [],
    "var": lambda t, v, s: s.vars[t[1]],
    "call": _call,
}


def execute(tree: tuple, value) -> list:
    """All outputs of a program for one value; PipeError where it fails."""
    try:
        return run(tree, value, Scope())
    except _Break as b:
        raise PipeError(f"break outside of label ${b.name}") from None
