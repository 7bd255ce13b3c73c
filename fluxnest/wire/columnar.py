"""Encoding by the installed protobuf runtime, where it is there and a message is plain enough; the codec of this package gives the same bytes."""

from __future__ import annotations

from ..schema.proto import BINARY_LEAVES, JSON_LEAVES, FieldDef, MessageDef, Registry, leaf_type
from .codec import Codec

try:
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory
except ImportError:  # pragma: no cover
    descriptor_pb2 = None

#: Numbers of the scalar kinds in a descriptor, fixed values.
_KINDS = {"double": 1, "float": 2, "int64": 3, "uint64": 4, "int32": 5, "fixed64": 6, "fixed32": 7, "bool": 8, "string": 9, "bytes": 12, "uint32": 13, "enum": 5, "sfixed32": 15, "sfixed64": 16, "sint32": 17, "sint64": 18}


def available() -> bool:
    return descriptor_pb2 is not None


def _flat(name: str) -> str:
    return name.replace("_", "__").replace(".", "_")


def _is_leaf(type_name: str, flatten: bool) -> bool:
    return type_name in JSON_LEAVES | BINARY_LEAVES or leaf_type(type_name, flatten) is not None


def message_class(reg: Registry, message: MessageDef, flatten: bool):
    """A class of the runtime for a message. Messages that are kept as one value are declared as bytes, which have the same wire form."""
    file = descriptor_pb2.FileDescriptorProto(name="record.proto", package="record", syntax="proto3")
    done: set[str] = set()

    def declare(out, f: FieldDef, number: int, owner: str) -> None:
        kind = 12 if f.kind == "message" and _is_leaf(f.type, flatten) else 11 if f.kind == "message" else _KINDS[f.kind]
        d = out.field.add(name=f.name, number=number, type=kind, label=3 if f.repeated else 1)
        if kind == 11:
            d.type_name = f".record.{_flat(f.type)}"
            add(reg.messages[f.type])

    def add(m: MessageDef) -> None:
        if m.name in done:
            return
        done.add(m.name)
        out = descriptor_pb2.DescriptorProto(name=_flat(m.name))
        unions = list(dict.fromkeys(f.oneof for f in m.fields if f.oneof))
        for u in unions:
            out.oneof_decl.add(name=u)
        for f in m.fields:
            if f.kind == "map":
                entry = "".join(p.capitalize() for p in f.name.split("_")) + "Entry"
                nested = out.nested_type.add(name=entry)
                nested.options.map_entry = True
                declare(nested, FieldDef("key", 1, f.key_kind), 1, entry)
                declare(nested, f.value, 2, entry)
                out.field.add(name=f.name, number=f.number, type=11, label=3, type_name=f".record.{_flat(m.name)}.{entry}")
            else:
                declare(out, f, f.number, m.name)
                if f.oneof:
                    out.field[-1].oneof_index = unions.index(f.oneof)
        for f, d in zip([f for f in m.fields], list(out.field)):
            if f.optional:
                d.oneof_index = len(out.oneof_decl)
                d.proto3_optional = True
                out.oneof_decl.add(name=f"_{f.name}")
        file.message_type.append(out)

    add(message)
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(f"record.{_flat(message.name)}"))


def plain(reg: Registry, message: MessageDef, flatten: bool) -> bool:
    """Whether the runtime can build a message from nested dicts as they come from Arrow: no maps, 64-bit unsigned numbers or one-value messages."""
    for f in message.fields:
        if f.kind in ("map", "uint64", "fixed64") or f.kind == "message" and (_is_leaf(f.type, flatten) or not plain(reg, reg.messages[f.type], flatten)):
            return False
    return True


class PlainEncoder:
    def __init__(self, reg: Registry, message: MessageDef, flatten: bool):
        self.cls, self.codec = message_class(reg, message, flatten), Codec(reg, message, flatten)

    def encode(self, row: dict) -> bytes:
        try:
            return self.cls(**row).SerializeToString(deterministic=True)
        except (TypeError, ValueError):
            return self.codec.encode(row)
