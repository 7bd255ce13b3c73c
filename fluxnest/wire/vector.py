"""Decoding of a whole batch of messages at once, by arithmetic on arrays.

All messages of a batch are read in step: round i reads the i-th field of every message that has so many. What a field
holds is noted as positions in the batch's bytes; messages within messages are batches of their own. Nothing is done a message.

A batch that holds something rare or wrong (damaged bytes, groups, a message given twice, repeated map keys, more than
ROUNDS fields) raises Odd; the caller then halves it and leaves the small rest to the exact decoder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..schema.proto import FieldDef, MessageDef, Registry, leaf_type, struct_type
from .codec import Codec, wire_type

#: Fields of a message that are read in step; longer messages go to the exact decoder.
ROUNDS = 512
#: Rows of a batch that isn't halved any more.
SMALL = 64


class Odd(Exception):
    """A batch that this decoder leaves to the exact one."""


def varints(buf: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that begin at the positions at, and the positions after them."""
    if (at >= end).any():
        raise Odd
    byte = buf[at]
    value, at = (byte & 127).astype(np.uint64), at + 1
    more = np.flatnonzero(byte > 127)
    for shift in range(7, 70, 7):
        if not len(more):
            return value, at
        if (at[more] >= end[more]).any():
            raise Odd
        byte = buf[at[more]]
        value[more] |= (byte & 127).astype(np.uint64) << np.uint64(shift)
        at[more] += 1
        more = more[byte > 127]
    if len(more):
        raise Odd
    return value, at


def _signed(n: np.ndarray) -> np.ndarray:
    return (n >> np.uint64(1)).astype(np.int64) ^ -(n & np.uint64(1)).astype(np.int64)


#: Numbers of a kind from its 64 bits on the wire.
_NUMBERS = {
    "bool": lambda n: n != 0,
    **dict.fromkeys(("int32", "enum"), lambda n: n.astype(np.uint32).astype(np.int32)),
    "int64": lambda n: n.astype(np.int64),
    "uint32": lambda n: n.astype(np.uint32).astype(np.int64),
    "uint64": lambda n: n,
    "sint32": lambda n: _signed(n).astype(np.int32),
    "sint64": _signed,
}
_FIXED = {"fixed32": "<u4", "sfixed32": "<i4", "float": "<f4", "fixed64": "<u8", "sfixed64": "<i8", "double": "<f8"}


def gather(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the stretches of buf, one after another."""
    size = stop - start
    offsets = np.r_[0, np.cumsum(size)]
    return offsets, buf[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)]


class Fields:
    """The fields of a batch of messages in the order of reading: whose, number, wire type, and where (or what) each value is."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray):
        rows: list[tuple[np.ndarray, ...]] = []
        at, live = start.copy(), np.flatnonzero(start < end)
        for _ in range(ROUNDS):
            if not len(live):
                break
            stop = end[live]
            tag, value = varints(buf, at[live], stop)
            number, wire = (tag >> np.uint64(3)).astype(np.int64), (tag & np.uint64(7)).astype(np.int8)
            if (number == 0).any() or not np.isin(wire, (0, 1, 2, 5)).all():
                raise Odd
            bits, after = np.zeros(len(live), np.uint64), value + np.where(wire == 1, 8, 4)
            if len(some := np.flatnonzero(wire == 0)):
                bits[some], after[some] = varints(buf, value[some], stop[some])
            if len(some := np.flatnonzero(wire == 2)):
                size, value[some] = varints(buf, value[some], stop[some])
                if (size > np.uint64(1 << 31)).any():
                    raise Odd
                after[some] = value[some] + size.astype(np.int64)
            if (after > stop).any():
                raise Odd
            rows.append((live, number, wire, value, after, bits))
            at[live] = after
            live = live[after < stop]
        else:
            if len(live):
                raise Odd
        empty = np.zeros(0, np.int64)
        self.owner, self.number, self.wire, self.start, self.stop, self.bits = (np.concatenate(x) for x in zip(*rows)) if rows else (empty, empty, empty, empty, empty, empty.astype(np.uint64))

    def of(self, f: FieldDef, packed: bool = False) -> np.ndarray:
        """Where a field's values are, in order of reading; values of another wire type are unknown fields."""
        wire = 2 if f.kind == "map" or packed else wire_type(f.kind)
        return np.flatnonzero((self.number == f.number) & (self.wire == wire))


class VectorDecoder:
    def __init__(self, reg: Registry, message: MessageDef, flatten: bool):
        self.reg, self.message, self.flatten, self.codec = reg, message, flatten, Codec(reg, message, flatten)
        self.kind = struct_type(reg, message, flatten)

    def decode(self, blobs: pa.Array) -> pa.Array:
        """The struct array of a batch of messages; null bytes give null."""
        wide = np.int64 if pa.types.is_large_binary(blobs.type) else np.int32
        offsets = np.frombuffer(blobs.buffers()[1], wide)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
        data = blobs.buffers()[2]
        buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        there = blobs.is_valid().to_numpy(zero_copy_only=False)
        return self._struct(buf, offsets[:-1], np.where(there, offsets[1:], offsets[:-1]), self.message, self.kind, None if there.all() else pa.array(~there))

    def _struct(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, m: MessageDef, kind: T.StructType, mask: pa.Array | None = None) -> pa.Array:
        arrow = to_arrow_type(kind)
        if not m.fields:
            return pa.array([{}] * len(start), arrow)
        fields = Fields(buf, start, end)
        chosen: dict[str, np.ndarray] = {}  # the last member of each oneof that a message has
        for f in m.fields:
            if f.oneof:
                at = fields.of(f)
                np.maximum.at(chosen.setdefault(f.oneof, np.full(len(start), -1)), fields.owner[at], at)
        arrays = [self._field(buf, fields, len(start), f, kind[f.name].dataType, chosen.get(f.oneof) if f.oneof else None) for f in m.fields]
        return pa.StructArray.from_arrays(arrays, fields=[arrow.field(i) for i in range(arrow.num_fields)], mask=mask)

    def _field(self, buf: np.ndarray, fields: Fields, n: int, f: FieldDef, kind: T.DataType, chosen: np.ndarray | None) -> pa.Array:
        if f.kind == "map" or f.repeated:
            return self._many(buf, fields, n, f, kind)
        at = fields.of(f)
        last = np.full(n, -1)
        last[fields.owner[at]] = at
        if f.kind == "message" and leaf_type(f.type, self.flatten) is None and len(at) != (last >= 0).sum():
            raise Odd  # two halves of one message are to be merged
        if chosen is not None:
            last[last != chosen] = -1
        return self._values(buf, fields, last, f, kind, f.presence)

    def _values(self, buf: np.ndarray, fields: Fields, at: np.ndarray, f: FieldDef, kind: T.DataType, presence: bool) -> pa.Array:
        """The values at the places at, -1 for a field that isn't there: null or, without presence, the default."""
        absent, arrow = at < 0, to_arrow_type(kind)
        if not len(fields.owner):
            fields_start = fields_stop = np.zeros(len(at), np.int64)
            bits = np.zeros(len(at), np.uint64)
        else:
            fields_start, fields_stop, bits = (np.where(absent, x.dtype.type(0), x[at]) for x in (fields.start, fields.stop, fields.bits))
        null = pa.array(absent) if presence and absent.any() else None
        if f.kind == "message":
            if leaf_type(f.type, self.flatten) is not None:
                return self._leaves(buf, fields_start, fields_stop, absent, f, arrow, presence)
            return self._struct(buf, fields_start, fields_stop, self.reg.messages[f.type], kind, null)
        if f.kind in ("string", "bytes"):
            offsets, data = gather(buf, fields_start, fields_stop)
            if f.kind == "bytes":
                null = pa.array(fields_start == fields_stop)  # empty bytes are null
            valid = None if null is None else pa.array(~null.to_numpy(zero_copy_only=False)).buffers()[1]
            out = pa.Array.from_buffers(pa.binary(), len(at), [valid, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
            try:
                return out.cast(arrow)
            except pa.ArrowInvalid:
                raise Odd from None  # no UTF-8
        return self._numbers(self._plain(buf, fields_start, absent, bits, f.kind), f.kind, arrow, null)

    def _plain(self, buf: np.ndarray, start: np.ndarray, absent: np.ndarray | None, bits: np.ndarray, kind: str) -> np.ndarray:
        if kind in _NUMBERS:
            return _NUMBERS[kind](bits)
        form = np.dtype(_FIXED[kind])
        if not len(buf):
            return np.zeros(len(start), form)
        places = np.minimum(start[:, None] + np.arange(form.itemsize), len(buf) - 1)
        out = np.ascontiguousarray(buf[places]).view(form).reshape(-1)
        return np.where(absent, form.type(0), out) if absent is not None else out

    def _numbers(self, values: np.ndarray, kind: str, arrow: pa.DataType, null: pa.Array | None = None) -> pa.Array:
        if kind == "fixed32":
            values = values.astype(np.int64)
        out = pa.array(values, mask=None if null is None else null.to_numpy(zero_copy_only=False))
        return out if out.type == arrow else out.cast(arrow)

    def _leaves(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray, absent: np.ndarray, f: FieldDef, arrow: pa.DataType, presence: bool) -> pa.Array:
        """Messages that are kept as one value."""
        default = None if presence else self.codec.default(f)
        if f.type == "google.protobuf.Timestamp" and f.type in self.reg.messages and pa.types.is_timestamp(arrow):
            own = Fields(buf, start, stop)
            part = lambda g: self._field(buf, own, len(start), g, T.LongType(), None).to_numpy(zero_copy_only=False)
            seconds, nanos = (part(g).astype(np.int64) for g in self.reg.messages[f.type].fields)
            if (np.abs(seconds) > 10**11).any():
                raise Odd
            micros = (seconds * 1000 + np.trunc(nanos / 1e6).astype(np.int64)) * 1000
            return pa.array(micros, mask=absent if presence and absent.any() else None).cast(arrow)
        data = buf.tobytes()
        return pa.array([default if gone else self.codec._leaf(f.type, data[a:b]) for a, b, gone in zip(start.tolist(), stop.tolist(), absent.tolist())], arrow)

    def _many(self, buf: np.ndarray, fields: Fields, n: int, f: FieldDef, kind: T.DataType) -> pa.Array:
        arrow = to_arrow_type(kind)
        single, packed = fields.of(f), fields.of(f, True)
        if f.kind != "map" and wire_type(f.kind) != 2 and len(packed):
            if len(single):
                raise Odd  # a list half packed and half not
            return self._packed(buf, fields, packed, n, f, arrow)
        order = single[np.argsort(fields.owner[single], kind="stable")]
        offsets = np.r_[0, np.cumsum(np.bincount(fields.owner[order], minlength=n))].astype(np.int32)
        if f.kind != "map":
            return pa.ListArray.from_arrays(pa.array(offsets), self._values(buf, fields, order, f, kind.elementType, False)).cast(arrow)
        entry = Fields(buf, fields.start[order], fields.stop[order])
        key, value = FieldDef("key", 1, f.key_kind), FieldDef("value", 2, f.value.kind, f.value.type)
        keys = self._field(buf, entry, len(order), key, kind.keyType, None)
        codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(np.unique(fields.owner[order] * (codes.max(initial=0) + 1) + codes)) != len(order):
            raise Odd  # the last of equal keys holds
        return pa.MapArray.from_arrays(pa.array(offsets), keys, self._field(buf, entry, len(order), value, kind.valueType, None)).cast(arrow)

    def _packed(self, buf: np.ndarray, fields: Fields, at: np.ndarray, n: int, f: FieldDef, arrow: pa.DataType) -> pa.Array:
        order = at[np.argsort(fields.owner[at], kind="stable")]
        ends, data = gather(buf, fields.start[order], fields.stop[order])
        if f.kind in _NUMBERS:
            full = ends[1:][ends[1:] > ends[:-1]]
            if len(full) and (data[full - 1] > 127).any():
                raise Odd
            last = np.flatnonzero(data < 128)
            first = np.r_[0, last[:-1] + 1] if len(last) else last
            bits, _ = varints(data, first, last + 1) if len(last) else (np.zeros(0, np.uint64), None)
            values = _NUMBERS[f.kind](bits)
            sizes = np.diff(np.searchsorted(last, ends))
        else:
            form = np.dtype(_FIXED[f.kind])
            if (np.diff(ends) % form.itemsize).any():
                raise Odd
            values, sizes = data.view(form), np.diff(ends) // form.itemsize
        counts = np.bincount(fields.owner[order], weights=sizes, minlength=n).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), self._numbers(values, f.kind, arrow.value_type)).cast(arrow)


def decode_halving(blobs: pa.Array, fast: VectorDecoder, exact, strict: bool) -> tuple[pa.Array, list[str | None]]:
    """A batch by the fast decoder, halved around what it leaves to the exact one."""
    try:
        return fast.decode(blobs), [None] * len(blobs)
    except Odd:
        if len(blobs) <= SMALL:
            return exact(blobs.to_pylist(), strict)
    middle = len(blobs) // 2
    (a, why), (b, more) = (decode_halving(x, fast, exact, strict) for x in (blobs.slice(0, middle), blobs.slice(middle)))
    return pa.concat_arrays([a, b]), why + more
