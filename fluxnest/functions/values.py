"""Typed columns and the coercions shared by expressions and pipelines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG, DOUBLE, STRING, BOOL, NULL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.NullType()
_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class PlanError(ValueError):
    """A path, expression or plan that can't be compiled against its schema."""


@dataclass(frozen=True)
class V:
    """A column with its type."""

    col: Column
    kind: T.DataType

    @property
    def is_int(self) -> bool:
        return isinstance(self.kind, _INTS) or isinstance(self.kind, T.DecimalType) and self.kind.scale == 0

    @property
    def is_float(self) -> bool:
        return isinstance(self.kind, (T.FloatType, T.DoubleType)) or isinstance(self.kind, T.DecimalType) and self.kind.scale > 0

    @property
    def is_bool(self) -> bool:
        return isinstance(self.kind, T.BooleanType)

    @property
    def is_number(self) -> bool:
        return self.is_int or self.is_float

    @property
    def is_string(self) -> bool:
        return isinstance(self.kind, T.StringType)

    @property
    def is_null(self) -> bool:
        return isinstance(self.kind, T.NullType)


def null(kind: T.DataType = NULL) -> V:
    return V(F.lit(None).cast(kind), kind)


def literal(value) -> V:
    """A constant; whole numbers are bigint."""
    if value is None:
        return null()
    kind = BOOL if isinstance(value, bool) else LONG if isinstance(value, int) else DOUBLE if isinstance(value, float) else STRING
    return V(F.lit(value).cast(kind), kind)


def truthy(v: V) -> Column:
    """Null, false, 0, "", empty bytes, lists and maps are false; a struct that is there is true."""
    if v.is_null:
        return F.lit(False)
    if v.is_bool:
        return F.coalesce(v.col, F.lit(False))
    if v.is_number:
        return F.coalesce(v.col != 0, F.lit(False))
    if v.is_string or isinstance(v.kind, T.BinaryType):
        return F.coalesce(F.octet_length(v.col) > 0, F.lit(False))
    if isinstance(v.kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    return v.col.isNotNull()


def int_view(v: V) -> Column | None:
    """Whole numbers and booleans as bigint; None for other types."""
    if v.is_bool:
        return v.col.cast("int").cast("bigint")
    return v.col.cast("bigint") if v.is_int else None


def float_view(v: V) -> Column | None:
    as_int = int_view(v)
    return as_int.cast("double") if as_int is not None else v.col.cast("double") if v.is_float else None


def _plain_float(value: Column) -> Column:
    """The shortest decimal form without an exponent."""
    s = value.cast("string")
    sign, lead, tail = (F.regexp_extract(s, r"^(-?)(\d+)\.(\d+)E(-?\d+)$", i) for i in (1, 2, 3))
    power = F.coalesce(F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    digits = F.concat(lead, F.regexp_replace(tail, "0+$", ""))
    whole = F.when(F.length(digits) <= power + 1, F.rpad(digits, power + 1, "0")).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    special = F.when(s == "Infinity", "+Inf").when(s == "-Infinity", "-Inf")
    return F.coalesce(special, F.when(s.contains("E"), F.concat(sign, F.when(power >= 0, whole).otherwise(small))).otherwise(F.regexp_replace(s, r"\.0$", "")))


def to_str(v: V) -> Column:
    """Text of a value: null is "", floats have no exponent, bytes are hexadecimal, containers are placeholders."""
    if v.is_null:
        return F.lit("")
    if v.is_string:
        out = v.col
    elif isinstance(v.kind, (T.FloatType, T.DoubleType)):
        out = _plain_float(v.col)
    elif isinstance(v.kind, T.BinaryType):
        out = F.lower(F.hex(v.col))
    elif isinstance(v.kind, T.StructType):
        out = F.when(v.col.isNotNull(), "<message>")
    elif isinstance(v.kind, T.ArrayType):
        out = F.when(v.col.isNotNull(), "<list>")
    elif isinstance(v.kind, T.MapType):
        out = F.when(v.col.isNotNull(), "<map>")
    else:
        out = v.col.cast("string")
    return F.coalesce(out, F.lit(""))


def common(*vs: V) -> tuple[T.DataType, list[Column]]:
    """The type that all values share, and the values cast to it."""
    kinds = [v.kind for v in vs if not v.is_null]
    if not kinds:
        return NULL, [v.col for v in vs]
    if all(k == kinds[0] for k in kinds):
        kind = kinds[0]
    elif all(v.is_int for v in vs if not v.is_null):
        kind = LONG
    elif all(v.is_number for v in vs if not v.is_null):
        kind = DOUBLE
    elif all(isinstance(k, T.ArrayType) for k in kinds):
        inner = common(*(V(F.lit(None), k.elementType) for k in kinds))[0]
        kind = T.ArrayType(inner)
    else:
        raise PlanError(f"no common type for {', '.join(sorted({k.simpleString() for k in kinds}))}")
    return kind, [v.col.cast(kind) for v in vs]


def compare(a: V, b: V, op: str) -> Column:
    """A comparison that is never null: null and values of different families are incomparable, which is false.

    Strings compare with strings; whole numbers and booleans as whole numbers; with a float as doubles. NaN compares
    equal to everything.
    """
    false = F.lit(False)
    if a.is_null or b.is_null:
        return false
    if a.is_string and b.is_string or isinstance(a.kind, T.BinaryType) and isinstance(b.kind, T.BinaryType):
        x, y, nan = a.col, b.col, None
    elif (ia := int_view(a)) is not None and (ib := int_view(b)) is not None:
        x, y, nan = ia, ib, None
    elif (fa := float_view(a)) is not None and (fb := float_view(b)) is not None:
        x, y, nan = fa, fb, F.isnan(fa) | F.isnan(fb)
    else:
        return false
    out = {"eq": x == y, "ne": x != y, "lt": x < y, "le": x <= y, "gt": x > y, "ge": x >= y}[op]
    if nan is not None:
        out = F.when(x.isNull() | y.isNull(), False).when(nan, op in ("eq", "le", "ge")).otherwise(out)
    return F.coalesce(out, false)


def fnv1a64(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes as a signed bigint: a fold over bytes with the product split into 32-bit limbs."""
    data = F.hex(F.encode(text, "UTF-8"))
    # The offset basis 0xcbf29ce484222325 as (high, low) and the prime 2^40 + 0x1b3.
    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("h"), F.lit(0x84222325).cast("bigint").alias("l"))
    mask = F.lit(0xFFFFFFFF).cast("bigint")

    def step(s: Column, at: Column) -> Column:
        byte = F.conv(F.substring(data, at * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
        low = s["l"].bitwiseXOR(byte)
        p = low * 0x1B3
        high = (s["h"] * 0x1B3 + F.shiftright(p, 32) + F.shiftleft(low, 8)).bitwiseAND(mask)
        return F.struct(high.alias("h"), p.bitwiseAND(mask).alias("l"))

    n = F.octet_length(text)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda s: F.shiftleft(s["h"], 32).bitwiseOR(s["l"]))
