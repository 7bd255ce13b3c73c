"""Protobuf wire format: decoding to the values of a schema, with defaults filled in, and encoding back.

Decoders are built once a schema: a table from field number to a function. Fields that aren't needed are skipped by
their wire type, so a plan that reads three fields pays for three.
"""

from __future__ import annotations

import datetime
import json
import math
import struct
from collections.abc import Callable
from decimal import Decimal

from ..schema.proto import JSON_LEAVES, WRAPPERS, FieldDef, MessageDef, Registry, SchemaError, leaf_type

_EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)
_DEFAULT = {"bool": False, "float": 0.0, "double": 0.0, "string": "", "bytes": None, "uint64": Decimal(0), "fixed64": Decimal(0)}
_FIXED = {"fixed32": "<I", "sfixed32": "<i", "float": "<f", "fixed64": "<Q", "sfixed64": "<q", "double": "<d"}


class WireError(ValueError):
    """Bytes that are no message of the schema."""


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(b) or shift > 63:
            raise WireError("cut-off or overlong number")
        x = b[at]
        at += 1
        out |= (x & 127) << shift
        if x < 128:
            return out & 0xFFFFFFFFFFFFFFFF, at
        shift += 7


def write_varint(n: int) -> bytes:
    n &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _signed(n: int, bits: int) -> int:
    n &= (1 << bits) - 1
    return n - (1 << bits) if n >> (bits - 1) else n


_VARINT: dict[str, Callable[[int], object]] = {
    "bool": bool,
    "int32": lambda n: _signed(n, 32),
    "enum": lambda n: _signed(n, 32),
    "int64": lambda n: _signed(n, 64),
    "uint32": lambda n: n & 0xFFFFFFFF,
    "uint64": Decimal,
    "sint32": lambda n: _signed(n >> 1 ^ -(n & 1), 32),
    "sint64": lambda n: _signed(n >> 1 ^ -(n & 1), 64),
}


def wire_type(kind: str) -> int:
    return 0 if kind in _VARINT else 5 if kind in ("fixed32", "sfixed32", "float") else 1 if kind in _FIXED else 2


def skip(b: bytes, at: int, wire: int) -> int:
    if wire == 0:
        return read_varint(b, at)[1]
    if wire in (1, 5):
        at += 8 if wire == 1 else 4
    elif wire == 2:
        n, at = read_varint(b, at)
        at += n
    elif wire == 3:
        while True:
            tag, at = read_varint(b, at)
            if tag & 7 == 4:
                return at
            at = skip(b, at, tag & 7)
    else:
        raise WireError(f"wire type {wire}")
    if at > len(b):
        raise WireError("cut-off field")
    return at


class Codec:
    """Reads and writes messages of one type.

    needed names the top-level fields to decode; None is all. flatten has the meaning of struct_type.
    """

    def __init__(self, reg: Registry, message: MessageDef, flatten: bool = False, needed: set[str] | None = None):
        self.reg, self.message, self.flatten, self.needed = reg, message, flatten, needed
        self._tables: dict[str, dict[int, FieldDef]] = {}

    def fields(self) -> tuple[FieldDef, ...]:
        return tuple(f for f in self.message.fields if self.needed is None or f.name in self.needed)

    # ---- decoding

    def decode(self, b: bytes) -> dict:
        """The values of a message; unset fields have their defaults."""
        return self._message(b, 0, len(b), self.message, self.fields())

    def _table(self, m: MessageDef, fields: tuple[FieldDef, ...]) -> dict[int, FieldDef]:
        key = m.name
        if key not in self._tables:
            self._tables[key] = {f.number: f for f in fields}
        return self._tables[key]

    def default(self, f: FieldDef):
        if f.kind == "map":
            return []
        if f.repeated:
            return []
        if f.presence:
            return None
        if f.kind == "message":
            leaf = leaf_type(f.type, self.flatten)
            if leaf is not None:
                return self._leaf(f.type, b"") if self.flatten and f.type not in JSON_LEAVES and f.type not in WRAPPERS else None
            m = self.reg.messages[f.type]
            return {x.name: self.default(x) for x in m.fields}
        return _DEFAULT.get(f.kind, 0)

    def _message(self, b: bytes, at: int, end: int, m: MessageDef, fields: tuple[FieldDef, ...]) -> dict:
        table, out = self._table(m, fields), {}
        while at < end:
            tag, at = read_varint(b, at)
            f = table.get(tag >> 3)
            wire = tag & 7
            if f is None:
                if not tag >> 3:
                    raise WireError("field number 0")
                at = skip(b, at, wire)
                continue
            if f.kind == "map":
                n, at = read_varint(b, at)
                k, v = self._entry(b, at, at + n, f)
                at += n
                out.setdefault(f.name, {})[k] = v
                continue
            if f.repeated and wire == 2 and wire_type(f.kind) != 2:
                n, at = read_varint(b, at)
                stop, items = at + n, out.setdefault(f.name, [])
                if stop > end:
                    raise WireError("cut-off list")
                while at < stop:
                    v, at = self._scalar(b, at, f.kind)
                    items.append(v)
                continue
            if wire != wire_type(f.kind):
                at = skip(b, at, wire)
                continue
            v, at = self._value(b, at, end, f)
            if f.repeated:
                out.setdefault(f.name, []).append(v)
            else:
                if f.oneof:
                    for x in m.fields:
                        if x.oneof == f.oneof:
                            out.pop(x.name, None)
                out[f.name] = v
        if at != end:
            raise WireError("a field runs over its message")
        return {f.name: list(out[f.name].items()) if f.kind == "map" and f.name in out else out[f.name] if f.name in out else self.default(f) for f in fields}

    def _value(self, b: bytes, at: int, end: int, f: FieldDef):
        if wire_type(f.kind) != 2:
            return self._scalar(b, at, f.kind)
        n, at = read_varint(b, at)
        stop = at + n
        if stop > end:
            raise WireError("cut-off field")
        if f.kind == "string":
            try:
                return b[at:stop].decode(), stop
            except UnicodeDecodeError:
                raise WireError(f"{f.name} is no UTF-8") from None
        if f.kind == "bytes":
            return b[at:stop] or None, stop
        if leaf_type(f.type, self.flatten) is not None:
            return self._leaf(f.type, b[at:stop]), stop
        m = self.reg.messages[f.type]
        return self._message(b, at, stop, m, m.fields), stop

    def _scalar(self, b: bytes, at: int, kind: str):
        if kind in _VARINT:
            n, at = read_varint(b, at)
            return _VARINT[kind](n), at
        fmt = _FIXED[kind]
        size = struct.calcsize(fmt)
        if at + size > len(b):
            raise WireError("cut-off number")
        v = struct.unpack_from(fmt, b, at)[0]
        return Decimal(v) if kind == "fixed64" else v, at + size

    def _entry(self, b: bytes, at: int, end: int, f: FieldDef):
        key, value = FieldDef("key", 1, f.key_kind), f.value
        k, v = self.default(key), self.default(value)
        while at < end:
            tag, at = read_varint(b, at)
            x = key if tag >> 3 == 1 else value if tag >> 3 == 2 else None
            if x is None or tag & 7 != wire_type(x.kind):
                at = skip(b, at, tag & 7)
                continue
            got, at = self._value(b, at, end, x)
            k, v = (got, v) if x is key else (k, got)
        return k, v

    def _leaf(self, type_name: str, b: bytes):
        if type_name in JSON_LEAVES:
            return json.dumps(_json_value(type_name, b), separators=(",", ":"), ensure_ascii=False)
        m = self.reg.messages.get(type_name)
        if m is None:
            return b
        v = Codec(self.reg, m).decode(b)
        if type_name == "google.protobuf.Timestamp":
            return _EPOCH + datetime.timedelta(seconds=v["seconds"], milliseconds=int(v["nanos"] / 1e6))
        if type_name == "google.protobuf.FieldMask":
            return ",".join(v["paths"])
        if type_name == "google.type.Date":
            try:
                return datetime.date(v["year"], v["month"], v["day"])
            except ValueError:
                return None
        if type_name == "google.type.TimeOfDay":
            return ((v["hours"] * 60 + v["minutes"]) * 60 + v["seconds"]) * 1_000_000 + v["nanos"] // 1000
        if type_name in WRAPPERS:
            return v["value"]
        return b

    # ---- encoding

    def encode(self, row: dict) -> bytes:
        """The bytes of a message; nulls and defaults are left out, as the format has it."""
        return self._encode(row, self.message)

    def _encode(self, row: dict, m: MessageDef) -> bytes:
        out = bytearray()
        for f in m.fields:
            v = row.get(f.name)
            if v is None:
                continue
            if f.kind == "map":
                for k, x in sorted(dict(v).items()):
                    entry = self._tagged(FieldDef("key", 1, f.key_kind), k) + (b"" if x is None else self._tagged(f.value, x))
                    out += write_varint(f.number << 3 | 2) + write_varint(len(entry)) + entry
            elif f.repeated:
                if wire_type(f.kind) != 2:
                    body = b"".join(self._bare(f, x) for x in v)
                    if body:
                        out += write_varint(f.number << 3 | 2) + write_varint(len(body)) + body
                else:
                    for x in v:
                        out += self._tagged(f, x)
            elif f.presence or f.kind == "message" or v != _DEFAULT.get(f.kind, 0) or isinstance(v, float) and math.copysign(1, v) < 0:
                out += self._tagged(f, v)
        return bytes(out)

    def _tagged(self, f: FieldDef, v) -> bytes:
        body = self._bare(f, v)
        head = write_varint(f.number << 3 | wire_type(f.kind))
        return head + (write_varint(len(body)) if wire_type(f.kind) == 2 else b"") + body

    def _bare(self, f: FieldDef, v) -> bytes:
        k = f.kind
        if k in ("sint32", "sint64"):
            return write_varint(v << 1 ^ v >> 63)
        if k in _VARINT:
            return write_varint(int(v))
        if k in _FIXED:
            return struct.pack(_FIXED[k], int(v) if k == "fixed64" else v)
        if k == "string":
            return v.encode()
        if k == "bytes":
            return bytes(v)
        if leaf_type(f.type, self.flatten) is not None:
            return self._encode_leaf(f.type, v)
        return self._encode(v, self.reg.messages[f.type])

    def _encode_leaf(self, type_name: str, v) -> bytes:
        if type_name in JSON_LEAVES:
            return _wire_value(type_name, json.loads(v))
        m = self.reg.messages.get(type_name)
        if type_name == "google.protobuf.Timestamp":
            ms = math.floor((v.astimezone(datetime.timezone.utc) - _EPOCH) / datetime.timedelta(milliseconds=1))
            row = {"seconds": ms // 1000, "nanos": ms % 1000 * 1_000_000}
        elif type_name == "google.protobuf.FieldMask":
            row = {"paths": v.split(",") if v else []}
        elif type_name == "google.type.Date":
            row = {"year": v.year, "month": v.month, "day": v.day}
        elif type_name == "google.type.TimeOfDay":
            s, us = divmod(v, 1_000_000)
            row = {"hours": s // 3600, "minutes": s // 60 % 60, "seconds": s % 60, "nanos": us * 1000}
        elif type_name in WRAPPERS:
            row = {"value": v}
        else:
            return bytes(v)
        if m is None:
            raise SchemaError(f"{type_name} isn't known")
        return Codec(self.reg, m).encode(row)


def _json_value(type_name: str, b: bytes):
    """The JSON value of a Struct, Value or ListValue."""
    at, obj, items, value = 0, {}, [], None
    while at < len(b):
        tag, at = read_varint(b, at)
        number, wire = tag >> 3, tag & 7
        if wire == 2:
            n, at = read_varint(b, at)
            body = b[at : at + n]
            at += n
            if type_name.endswith(".Struct") and number == 1:
                key, x, p = "", None, 0
                while p < len(body):
                    t, p = read_varint(body, p)
                    n, p = read_varint(body, p)
                    if t >> 3 == 1:
                        key = body[p : p + n].decode()
                    else:
                        x = _json_value("google.protobuf.Value", body[p : p + n])
                    p += n
                obj[key] = x
            elif type_name.endswith(".ListValue") and number == 1:
                items.append(_json_value("google.protobuf.Value", body))
            elif number == 3:
                value = body.decode()
            elif number == 5:
                value = _json_value("google.protobuf.Struct", body)
            elif number == 6:
                value = _json_value("google.protobuf.ListValue", body)
        elif wire == 1:
            x = struct.unpack_from("<d", b, at)[0]
            value = int(x) if x == x and abs(x) < 2**53 and x == int(x) else x
            at += 8
        else:
            n, at = read_varint(b, at)
            value = bool(n) if number == 4 else None
    return obj if type_name.endswith(".Struct") else items if type_name.endswith(".ListValue") else value


def _wire_value(type_name: str, v) -> bytes:
    part = lambda number, body: write_varint(number << 3 | 2) + write_varint(len(body)) + body
    if type_name.endswith(".Struct"):
        return b"".join(part(1, part(1, k.encode()) + part(2, _wire_value("google.protobuf.Value", x))) for k, x in sorted(v.items()))
    if type_name.endswith(".ListValue"):
        return b"".join(part(1, _wire_value("google.protobuf.Value", x)) for x in v)
    if v is None:
        return b"\x08\x00"
    if isinstance(v, bool):
        return b"\x20" + (b"\x01" if v else b"\x00")
    if isinstance(v, (int, float)):
        return b"\x11" + struct.pack("<d", v)
    if isinstance(v, str):
        return part(3, v.encode())
    return part(5, _wire_value("google.protobuf.Struct", v)) if isinstance(v, dict) else part(6, _wire_value("google.protobuf.ListValue", v))
