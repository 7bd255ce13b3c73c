"""Message schemas: a parser of .proto text, and the Spark types of its messages."""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T


class SchemaError(ValueError):
    """A schema that can't be read or used."""


class MaxDepthError(SchemaError):
    """Messages nest deeper than MAX_DEPTH."""


class CyclicTypeError(SchemaError):
    """A message contains itself."""


class PathNotFoundError(SchemaError):
    """A schema has no field at a path."""


class ExclusiveOptionsError(SchemaError):
    """Two options that exclude each other were given."""


class FingerprintMismatchError(SchemaError):
    """A schema isn't the one that a reader was made for."""


MAX_DEPTH = 10
#: Scalar kind -> Spark type. Unsigned 32-bit numbers are bigint, unsigned 64-bit ones decimal(20,0).
SCALARS: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    **dict.fromkeys(("int32", "sint32", "sfixed32", "enum"), T.IntegerType()),
    **dict.fromkeys(("uint32", "fixed32", "int64", "sint64", "sfixed64"), T.LongType()),
    **dict.fromkeys(("uint64", "fixed64"), T.DecimalType(20, 0)),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "bytes": T.BinaryType(),
}


@dataclass(frozen=True)
class FieldDef:
    """kind is a scalar's name, "enum", "message" or "map"; type is the full name of an enum or message."""

    name: str
    number: int
    kind: str
    type: str = ""
    repeated: bool = False
    optional: bool = False
    oneof: str = ""
    key_kind: str = ""
    value: "FieldDef | None" = None

    @property
    def presence(self) -> bool:
        return self.optional or bool(self.oneof)


@dataclass(frozen=True)
class MessageDef:
    name: str
    fields: tuple[FieldDef, ...] = ()

    def field(self, name: str) -> FieldDef | None:
        return next((f for f in self.fields if f.name == name), None)


@dataclass
class Registry:
    """All messages and enums of a file and its imports, by full name."""

    messages: dict[str, MessageDef] = field(default_factory=dict)
    enums: dict[str, dict[int, str]] = field(default_factory=dict)
    top: list[str] = field(default_factory=list)

    def lookup(self, short: str) -> MessageDef:
        """A top-level message by its short name."""
        for name in self.top:
            if name.split(".")[-1] == short.split(".")[-1]:
                return self.messages[name]
        raise SchemaError(f"no top-level message {short!r}")


# Fields of the well-known messages, as name, number, kind, repeated.
_WELL_KNOWN = {
    "google.protobuf.Timestamp": (("seconds", 1, "int64"), ("nanos", 2, "int32")),
    "google.protobuf.Duration": (("seconds", 1, "int64"), ("nanos", 2, "int32")),
    "google.protobuf.FieldMask": (("paths", 1, "string", True),),
    "google.protobuf.Empty": (),
    "google.protobuf.Any": (("type_url", 1, "string"), ("value", 2, "bytes")),
    **{f"google.protobuf.{n}Value": (("value", 1, k),) for n, k in (("Bool", "bool"), ("Int32", "int32"), ("Int64", "int64"), ("UInt32", "uint32"), ("UInt64", "uint64"), ("Float", "float"), ("Double", "double"), ("String", "string"), ("Bytes", "bytes"))},
    "google.type.Date": (("year", 1, "int32"), ("month", 2, "int32"), ("day", 3, "int32")),
    "google.type.TimeOfDay": (("hours", 1, "int32"), ("minutes", 2, "int32"), ("seconds", 3, "int32"), ("nanos", 4, "int32")),
    "google.type.Money": (("currency_code", 1, "string"), ("units", 2, "int64"), ("nanos", 3, "int32")),
    "google.type.LatLng": (("latitude", 1, "double"), ("longitude", 2, "double")),
}
#: Recursive messages that are kept as JSON text, and messages kept as bytes.
JSON_LEAVES = {"google.protobuf.Struct", "google.protobuf.Value", "google.protobuf.ListValue"}
BINARY_LEAVES = {"opentelemetry.proto.common.v1.AnyValue"}
WRAPPERS = {f"google.protobuf.{n}Value" for n in ("Bool", "Int32", "Int64", "UInt32", "UInt64", "Float", "Double", "String", "Bytes")}

_TOKEN = re.compile(r"""\s+|//[^\n]*|/\*.*?\*/|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<word>[A-Za-z_.][\w.]*|-?\d[\w.]*)|(?P<op>[{}()\[\]<>=;,:+-])""", re.S)


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SchemaError(f"unexpected {text[at]!r} at {at}")
        at = m.end()
        if m.lastgroup:
            out.append(m.group(m.lastgroup))
    return out


class _Proto:
    """One file's definitions, types still as written."""

    def __init__(self, text: str):
        self.toks, self.at = _tokens(text), 0
        self.package, self.imports, self.messages, self.enums, self.top = "", [], {}, {}, []
        while self.at < len(self.toks):
            word = self.next()
            if word in ("syntax", "edition", "option"):
                self.skip()
            elif word == "package":
                self.package = self.next()
                self.skip()
            elif word == "import":
                name = self.next()
                if name in ("public", "weak"):
                    name = self.next()
                self.imports.append(name.strip("\"'"))
                self.skip()
            elif word == "message":
                self.top.append(self.message(self.package))
            elif word == "enum":
                self.enum(self.package)
            elif word in ("service", "extend"):
                self.next()
                self.block()
            elif word != ";":
                raise SchemaError(f"unexpected {word!r}")

    def next(self) -> str:
        if self.at >= len(self.toks):
            raise SchemaError("unexpected end of the file")
        self.at += 1
        return self.toks[self.at - 1]

    def peek(self) -> str:
        return self.toks[self.at] if self.at < len(self.toks) else ""

    def need(self, word: str) -> None:
        if (got := self.next()) != word:
            raise SchemaError(f"expected {word!r}, found {got!r}")

    def skip(self) -> None:
        while (w := self.next()) != ";":
            if w == "{":
                self.at -= 1
                self.block()

    def block(self) -> None:
        while self.next() != "{":
            pass
        depth = 1
        while depth:
            depth += {"{": 1, "}": -1}.get(self.next(), 0)

    def enum(self, scope: str) -> None:
        name = f"{scope}.{self.next()}".lstrip(".")
        self.need("{")
        values: dict[int, str] = {}
        while (w := self.next()) != "}":
            if w in ("option", "reserved"):
                self.skip()
            elif w != ";":
                self.need("=")
                values.setdefault(int(self.next(), 0), w)
                self.skip()
        self.enums[name] = values

    def message(self, scope: str) -> str:
        name = f"{scope}.{self.next()}".lstrip(".")
        self.need("{")
        self.messages[name] = []
        self.body(name, "")
        return name

    def body(self, name: str, oneof: str) -> None:
        while (w := self.next()) != "}":
            if w == ";":
                continue
            if w in ("option", "reserved", "extensions"):
                self.skip()
            elif w == "message":
                self.message(name)
            elif w == "enum":
                self.enum(name)
            elif w == "oneof":
                group = self.next()
                self.need("{")
                self.body(name, group)
            elif w == "extend":
                self.next()
                self.block()
            else:
                self.field(name, w, oneof)

    def field(self, owner: str, w: str, oneof: str) -> None:
        label = ""
        if w in ("optional", "repeated", "required"):
            label, w = w, self.next()
        if w == "map":
            self.need("<")
            key = self.next()
            self.need(",")
            value = self.next()
            self.need(">")
            raw = ("map", key, value)
        else:
            raw = (w,)
        name = self.next()
        self.need("=")
        number = int(self.next(), 0)
        self.skip()
        self.messages[owner].append((name, number, raw, label, oneof))


def compile_proto(path: str, import_paths: list[str] | tuple[str, ...] = ()) -> Registry:
    """Read a .proto file and what it imports; import paths are searched in order, then the file's own folder."""
    roots = [*import_paths, os.path.dirname(os.path.abspath(path))]
    files: dict[str, _Proto] = {}

    def load(name: str, required: bool) -> None:
        if name in files:
            return
        found = name if os.path.isabs(name) and os.path.exists(name) else next((p for r in roots if os.path.exists(p := os.path.join(r, name))), None)
        if found is None:
            if required:
                raise SchemaError(f"{name!r} is in none of the import paths")
            return
        with open(found) as f:
            files[name] = _Proto(f.read())
        for i in files[name].imports:
            load(i, not i.startswith("google/"))

    load(os.path.abspath(path) if os.path.exists(path) else path, True)
    return _resolve(list(files.values()))


def parse_proto(text: str) -> Registry:
    """A registry from the text of one file."""
    return _resolve([_Proto(text)])


def _resolve(files: list[_Proto]) -> Registry:
    out = Registry(top=list(files[0].top) if files else [])
    raw: dict[str, list] = {}
    for f in files:
        raw |= f.messages
        out.enums |= f.enums
    for name, fields in _WELL_KNOWN.items():
        if name not in raw:
            out.messages[name] = MessageDef(name, tuple(FieldDef(x[0], x[1], x[2], repeated=len(x) > 3) for x in fields))
    leaves = JSON_LEAVES | BINARY_LEAVES

    def kind_of(word: str, scope: str) -> tuple[str, str]:
        if word in SCALARS and word != "enum":
            return word, ""
        if word.startswith("."):
            tries = [word[1:]]
        else:
            parts = scope.split(".")
            tries = [".".join([*parts[:i], word]) for i in range(len(parts), -1, -1)]
        for t in tries:
            if t in raw or t in out.messages or t in leaves:
                return "message", t
            if t in out.enums:
                return "enum", t
        raise SchemaError(f"unknown type {word!r} in {scope}")

    for name, fields in raw.items():
        defs = []
        for fname, number, spec, label, oneof in fields:
            if spec[0] == "map":
                kind, type_ = kind_of(spec[2], name)
                defs.append(FieldDef(fname, number, "map", key_kind=spec[1], value=FieldDef("value", 2, kind, type_)))
            else:
                kind, type_ = kind_of(spec[0], name)
                defs.append(FieldDef(fname, number, kind, type_, label == "repeated", label == "optional", oneof))
        numbers = [d.number for d in defs]
        if len(set(numbers)) < len(numbers) or len({d.name for d in defs}) < len(defs):
            raise SchemaError(f"{name} has two fields of one name or number")
        out.messages[name] = MessageDef(name, tuple(defs))
    return out


# ---- Spark types


def flattened(type_name: str) -> T.DataType | None:
    """The simple type that the flatten option gives a well-known message; None where it stays a struct."""
    if type_name == "google.protobuf.Timestamp":
        return T.TimestampType()
    if type_name == "google.protobuf.FieldMask":
        return T.StringType()
    if type_name == "google.type.Date":
        return T.DateType()
    if type_name == "google.type.TimeOfDay":
        return T.LongType()
    if type_name in WRAPPERS:
        return SCALARS[_WELL_KNOWN[type_name][0][2]]
    return None


def leaf_type(type_name: str, flatten: bool) -> T.DataType | None:
    """The simple type of a message that is kept as one value."""
    if type_name in JSON_LEAVES:
        return T.StringType()
    if type_name in BINARY_LEAVES:
        return T.BinaryType()
    return flattened(type_name) if flatten else None


def struct_type(reg: Registry, message: MessageDef, flatten: bool = False) -> T.StructType:
    """The Spark schema of a message; each field's metadata has its number and path."""

    def of(f: FieldDef, above: tuple[str, ...], path: str) -> T.DataType:
        if f.kind == "map":
            return T.MapType(SCALARS[f.key_kind], of(f.value, above, path))
        if f.kind != "message":
            kind = SCALARS[f.kind]
        elif (kind := leaf_type(f.type, flatten)) is None:
            kind = build(reg.messages[f.type], above, path)
        return T.ArrayType(kind) if f.repeated else kind

    def build(m: MessageDef, above: tuple[str, ...], path: str) -> T.StructType:
        if m.name in above:
            raise CyclicTypeError(f"{m.name} contains itself at {path}")
        if len(above) >= MAX_DEPTH:
            raise MaxDepthError(f"more than {MAX_DEPTH} levels at {path}")
        here = (*above, m.name)
        fields = []
        for f in m.fields:
            at = f"{path}.{f.name}" if path else f.name
            fields.append(T.StructField(f.name, of(f, here, at), True, {"parquet.field.id": f.number, "path": at}))
        return T.StructType(fields)

    return build(message, (), "")


def field_at(schema: T.StructType, path: list[str]) -> T.StructField:
    """The field at a path of names; lists and maps are walked through."""
    kind, out = schema, None
    for name in path:
        while isinstance(kind, (T.ArrayType, T.MapType)):
            kind = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
            raise PathNotFoundError(".".join(path))
        out = kind[name]
        kind = out.dataType
    if out is None:
        raise PathNotFoundError("empty path")
    return out


def merge(reg: Registry, a: MessageDef, b: MessageDef, other: Registry | None = None) -> MessageDef:
    """a with b's fields, renumbered after a's highest number; registers b's types in reg."""
    names = {f.name for f in a.fields}
    if clash := [f.name for f in b.fields if f.name in names]:
        raise SchemaError(f"both messages have {', '.join(clash)}")
    if other is not None:
        for name, m in other.messages.items():
            if name in reg.messages and reg.messages[name] != m:
                raise SchemaError(f"both schemas define {name}, differently")
        for name, e in other.enums.items():
            if reg.enums.get(name, e) != e:
                raise SchemaError(f"both schemas define {name}, differently")
        reg.messages |= {n: m for n, m in other.messages.items() if n not in reg.messages}
        reg.enums |= other.enums
    top = max((f.number for f in a.fields), default=0)
    out = MessageDef(f"{a.name}Merged", a.fields + tuple(replace(f, number=top + i + 1) for i, f in enumerate(b.fields)))
    reg.messages[out.name] = out
    return out


def prune_empty(reg: Registry, message: MessageDef) -> tuple[Registry, MessageDef]:
    """Drop fields whose message has no fields, again and again until none is left; maps are kept."""
    messages = dict(reg.messages)
    while True:
        empty = {n for n, m in messages.items() if not m.fields}
        slim = {n: MessageDef(n, tuple(f for f in m.fields if not (f.kind == "message" and f.type in empty))) for n, m in messages.items()}
        if slim == messages:
            break
        messages = slim
    out = Registry(messages, reg.enums, reg.top)
    return out, messages[message.name]


def prune_type(kind: T.DataType) -> T.DataType | None:
    """A Spark type without structs that have no fields, at any depth; None where nothing is left. Maps are kept."""
    if isinstance(kind, T.StructType):
        fields = [T.StructField(f.name, k, f.nullable, f.metadata) for f in kind.fields if (k := prune_type(f.dataType)) is not None]
        return T.StructType(fields) if fields else None
    if isinstance(kind, T.ArrayType):
        inner = prune_type(kind.elementType)
        return None if inner is None else T.ArrayType(inner, kind.containsNull)
    return kind


def fingerprint(reg: Registry, message: MessageDef) -> str:
    """SHA-256 over the message and every type it reaches."""
    seen: dict[str, MessageDef] = {}
    todo = [message]
    while todo:
        m = todo.pop()
        if m.name in seen:
            continue
        seen[m.name] = m
        todo += [reg.messages[x.type] for f in m.fields for x in (f, f.value) if x is not None and x.kind == "message" and x.type in reg.messages]
    return hashlib.sha256("\n".join(repr(seen[n]) for n in sorted(seen)).encode()).hexdigest()


def check_fingerprint(reg: Registry, message: MessageDef, expected: str, policy: str = "strict") -> bool:
    """Whether the schema is the expected one; policy strict raises, rebuild lets the caller build anew."""
    if policy not in ("strict", "rebuild"):
        raise SchemaError(f"unknown policy {policy!r}")
    same = fingerprint(reg, message) == expected
    if not same and policy == "strict":
        raise FingerprintMismatchError(f"{message.name} has changed")
    return same


def enum_names(reg: Registry, message: MessageDef, path: list[str]) -> dict[int, str]:
    """Number -> name of the enum at a path, for the enum_name function."""
    for i, name in enumerate(path):
        f = message.field(name)
        if f is None:
            raise PathNotFoundError(".".join(path))
        f = f.value if f.kind == "map" else f
        if i == len(path) - 1:
            if f.kind != "enum":
                raise SchemaError(f"{'.'.join(path)} is no enum")
            return reg.enums[f.type]
        message = reg.messages[f.type]
    raise PathNotFoundError("empty path")
