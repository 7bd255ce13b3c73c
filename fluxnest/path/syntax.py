"""Syntax of paths: fields, indices, slices, wildcards, map keys and predicates."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from ..functions.values import PlanError


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Index:
    at: int


@dataclass(frozen=True)
class Key:
    key: str | int | bool


@dataclass(frozen=True)
class Wildcard:
    pass


@dataclass(frozen=True)
class Slice:
    start: int | None
    end: int | None
    step: int = 1


@dataclass(frozen=True)
class Where:
    predicate: tuple


Step = Field | Index | Key | Wildcard | Slice | Where


@dataclass(frozen=True)
class Path:
    """A parsed path. root is the record type's name where the path gives one."""

    steps: tuple[Step, ...]
    root: str | None = None
    text: str = field(default="", compare=False)


_TOKEN = re.compile(
    r"""\s*(?:(?P<num>-?\d+\.\d+(?:[eE][+-]?\d+)?|-?\d+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<id>[A-Za-z_]\w*)|(?P<op>\|\||&&|==|!=|<=|>=|\?\(|[][.()<>!:*?-]))"""
)


def tokens(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise PlanError(f"unexpected {text[at]!r} at {at} in {text!r}")
        at = m.end()
        if m["num"] is not None:
            out.append(("num", float(m["num"]) if "." in m["num"] else int(m["num"])))
        elif m["str"] is not None:
            s = m["str"]
            out.append(("str", json.loads(s) if s[0] == '"' else s[1:-1].replace("\\'", "'").replace("\\\\", "\\")))
        elif m["id"] is not None:
            out.append(("id", m["id"]))
        else:
            out.append(("op", m["op"]))
    return out


class _Parser:
    def __init__(self, text: str):
        self.text, self.toks, self.at = text, tokens(text), 0

    def peek(self, *ops: str) -> bool:
        return self.at < len(self.toks) and self.toks[self.at][0] == "op" and self.toks[self.at][1] in ops

    def take(self, op: str) -> None:
        if not self.peek(op):
            raise PlanError(f"expected {op!r} in {self.text!r}")
        self.at += 1

    def next(self, *kinds: str):
        if self.at >= len(self.toks) or self.toks[self.at][0] not in kinds:
            raise PlanError(f"expected {' or '.join(kinds)} in {self.text!r}")
        self.at += 1
        return self.toks[self.at - 1][1]

    def path(self) -> Path:
        root, steps = None, []
        if self.peek("("):
            self.take("(")
            root = self.next("id")
            while self.peek("."):
                self.take(".")
                root += "." + self.next("id")
            self.take(")")
            if self.at < len(self.toks):
                self.take(".") if self.peek(".") else None
                if self.at < len(self.toks) and self.toks[self.at][0] == "id":
                    steps.append(Field(self.next("id")))
        else:
            steps.append(Field(self.next("id")))
        while self.at < len(self.toks):
            if self.peek("."):
                self.take(".")
                steps.append(Field(self.next("id")))
            elif self.peek("["):
                steps.append(self.bracket())
            else:
                raise PlanError(f"unexpected {self.toks[self.at][1]!r} in {self.text!r}")
        return Path(tuple(steps), root, self.text)

    def whole(self) -> int | None:
        if self.at < len(self.toks) and self.toks[self.at][0] == "num":
            n = self.next("num")
            if not isinstance(n, int):
                raise PlanError(f"whole number expected in {self.text!r}")
            return n
        return None

    def bracket(self) -> Step:
        self.take("[")
        if self.peek("*"):
            self.take("*")
            self.take("]")
            return Wildcard()
        if self.peek("?("):
            self.take("?(")
            p = self.either()
            self.take(")")
            self.take("]")
            return Where(p)
        kind, value = self.toks[self.at] if self.at < len(self.toks) else ("", None)
        if kind == "str":
            self.at += 1
            self.take("]")
            return Key(value)
        if kind == "id" and value in ("true", "false"):
            self.at += 1
            self.take("]")
            return Key(value == "true")
        start = self.whole()
        if not self.peek(":"):
            self.take("]")
            if start is None:
                raise PlanError(f"empty brackets in {self.text!r}")
            return Index(start)
        self.take(":")
        end, step = self.whole(), 1
        if self.peek(":"):
            self.take(":")
            s = self.whole()
            step = 1 if s is None else s
        self.take("]")
        if step == 0:
            raise PlanError(f"a slice's step must not be zero: {self.text!r}")
        return Wildcard() if (start, end, step) == (None, None, 1) else Slice(start, end, step)

    # Predicates: ("or", a, b), ("and", a, b), ("not", a), ("cmp", op, a, b), ("lit", x), ("rel", (names...)).
    def either(self) -> tuple:
        left = self.both()
        while self.peek("||"):
            self.take("||")
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.peek("&&"):
            self.take("&&")
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        if self.peek("!"):
            self.take("!")
            return ("not", self.negated())
        left = self.operand()
        for op, name in (("==", "eq"), ("!=", "ne"), ("<=", "le"), (">=", "ge"), ("<", "lt"), (">", "gt")):
            if self.peek(op):
                self.take(op)
                return ("cmp", name, left, self.operand())
        return left

    def operand(self) -> tuple:
        if self.peek("("):
            self.take("(")
            p = self.either()
            self.take(")")
            return p
        if self.peek("."):
            self.take(".")
        elif self.at < len(self.toks) and self.toks[self.at][0] in ("num", "str"):
            return ("lit", self.next("num", "str"))
        name = self.next("id")
        if name in ("true", "false", "null"):
            return ("lit", {"true": True, "false": False, "null": None}[name])
        names = [name]
        while self.peek("."):
            self.take(".")
            names.append(self.next("id"))
        return ("rel", tuple(names))


def parse_path(text: str) -> Path:
    """Parse a path; raises PlanError with the reason."""
    p = _Parser(text)
    if not p.toks:
        raise PlanError("empty path")
    return p.path()


def format_path(path: Path) -> str:
    """The path's canonical text."""
    out = f"({path.root})" if path.root else ""

    def value(p: tuple) -> str:
        if p[0] == "lit":
            return json.dumps(p[1])
        if p[0] == "rel":
            return "." + ".".join(p[1])
        if p[0] == "not":
            return "!" + value(p[1])
        if p[0] == "cmp":
            return f"{value(p[2])} {dict(eq='==', ne='!=', le='<=', ge='>=', lt='<', gt='>')[p[1]]} {value(p[3])}"
        return f"({value(p[1])} {'||' if p[0] == 'or' else '&&'} {value(p[2])})"

    for s in path.steps:
        if isinstance(s, Field):
            out += ("." if out else "") + s.name
        elif isinstance(s, Index):
            out += f"[{s.at}]"
        elif isinstance(s, Key):
            out += f"[{json.dumps(s.key)}]"
        elif isinstance(s, Wildcard):
            out += "[*]"
        elif isinstance(s, Slice):
            tail = f":{s.step}" if s.step != 1 else ""
            out += f"[{'' if s.start is None else s.start}:{'' if s.end is None else s.end}{tail}]"
        else:
            out += f"[?({value(s.predicate)})]"
    return out


def prefix(path: Path, k: int) -> Path:
    """The path up to its k-th step, counted from the end where k is negative: the k-th value along the way."""
    return Path(path.steps[: k + 1 if k != -1 else None], path.root)


def default_name(text: str) -> str:
    """Column name of a bare path: its last segment without subscripts."""
    return re.sub(r"\[[^\]]*\]", "", text.split(".")[-1])
