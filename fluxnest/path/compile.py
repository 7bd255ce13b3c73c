"""Compilation of paths to columns.

A path that only walks fields is one value. Any other path is an array of branches, one for each value
it reaches; an index or key that isn't there drops its branch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import BOOL, PlanError, V, compare, literal, truthy
from .syntax import Field, Index, Key, Path, Slice, Step, Where, Wildcard


@dataclass(frozen=True)
class Branches:
    """What a path reaches. single: exactly one value; otherwise value is an array of branches.

    indices is array<array<int>>, the concrete list positions of each branch, where asked for.
    """

    value: V
    single: bool
    clamped: Column | None = None

    @property
    def element(self) -> T.DataType:
        return self.value.kind if self.single else self.value.kind.elementType

    @property
    def array(self) -> Column:
        return F.array(self.value.col) if self.single else self.value.col


def field_of(v: V, name: str) -> V:
    if not isinstance(v.kind, T.StructType):
        raise PlanError(f"no field {name!r} in {v.kind.simpleString()}")
    if name not in v.kind.fieldNames():
        raise PlanError(f"unknown field {name!r}; there are {', '.join(v.kind.fieldNames())}")
    return V(v.col[name], v.kind[name].dataType)


def slice_places(size: Column, s: Slice) -> Column:
    """Positions that a slice selects from a list of the given size, as Python has it."""
    size = F.coalesce(size.cast("int"), F.lit(0))
    fix = lambda n: F.lit(n) if n >= 0 else size + n
    if s.step > 0:
        start = F.lit(0) if s.start is None else F.greatest(F.lit(0), F.least(fix(s.start), size))
        end = size if s.end is None else F.least(fix(s.end), size)
        some = start < end
        last = end - 1
    else:
        start = size - 1 if s.start is None else F.least(fix(s.start), size - 1)
        end = F.lit(-1) if s.end is None else F.greatest(fix(s.end), F.lit(-1))
        some = (start > end) & (start >= 0)
        last = end + 1
    return F.when(some, F.sequence(start.cast("int"), last.cast("int"), F.lit(s.step))).otherwise(F.array().cast("array<int>"))


def slice_clamped(size: Column, s: Slice) -> Column:
    """Whether strict mode objects: a start outside the list, or with a forward step an end beyond it."""
    fix = lambda n: F.lit(n) if n >= 0 else size + n
    out = F.lit(False)
    if s.start is not None:
        out = out | (fix(s.start) < 0) | (fix(s.start) > size)
    if s.end is not None and s.step > 0:
        out = out | (fix(s.end) > size)
    return F.coalesce(out, F.lit(False))


def predicate(p: tuple, cursor: V) -> Column:
    """Truth of a predicate at a cursor."""
    if p[0] == "or":
        return predicate(p[1], cursor) | predicate(p[2], cursor)
    if p[0] == "and":
        return predicate(p[1], cursor) & predicate(p[2], cursor)
    if p[0] == "not":
        return ~predicate(p[1], cursor)
    if p[0] == "cmp":
        return compare(_operand(p[2], cursor), _operand(p[3], cursor), p[1])
    return truthy(_operand(p, cursor))


def _operand(p: tuple, cursor: V) -> V:
    if p[0] == "lit":
        return literal(p[1])
    if p[0] == "rel":
        for name in p[1]:
            cursor = field_of(cursor, name)
        return cursor
    return V(predicate(p, cursor), BOOL)


def _key(map_col: Column, kind: T.MapType, key) -> Column:
    return F.try_element_at(map_col, F.lit(key).cast(kind.keyType))


def step_many(v: V, step: Step) -> tuple[Column, T.DataType]:
    """The branches of one cursor under a step that may drop or multiply it, as an array."""
    kind = v.kind
    if isinstance(step, Where):
        if isinstance(kind, T.ArrayType):
            return F.filter(v.col, lambda x: predicate(step.predicate, V(x, kind.elementType))), kind.elementType
        return F.filter(F.array(v.col), lambda x: predicate(step.predicate, V(x, kind))), kind
    if isinstance(kind, T.MapType):
        if isinstance(step, Wildcard):
            return F.transform(F.array_sort(F.map_entries(v.col)), lambda e: e["value"]), kind.valueType
        key = step.at if isinstance(step, Index) else step.key if isinstance(step, Key) else None
        if key is None:
            raise PlanError("a map takes a key or a wildcard")
        held = F.map_contains_key(v.col, F.lit(key).cast(kind.keyType))
        return F.when(held, F.array(_key(v.col, kind, key))).otherwise(F.array().cast(T.ArrayType(kind.valueType))), kind.valueType
    if not isinstance(kind, T.ArrayType):
        raise PlanError(f"{type(step).__name__} needs a list, not {kind.simpleString()}")
    if isinstance(step, Wildcard):
        return v.col, kind.elementType
    if isinstance(step, Index):
        held = F.size(v.col) > step.at if step.at >= 0 else F.size(v.col) >= -step.at
        at = F.lit(step.at) if step.at >= 0 else F.size(v.col) + step.at
        return F.when(held, F.array(F.get(v.col, at))).otherwise(F.array().cast(kind)), kind.elementType
    if isinstance(step, Slice):
        return F.transform(slice_places(F.size(v.col), step), lambda i: F.get(v.col, i)), kind.elementType
    raise PlanError("a key needs a map")


def compile_steps(start: V, steps: tuple[Step, ...]) -> Branches:
    """Branches reached from a value."""
    value, single, clamped = start, True, None
    for step in steps:
        if isinstance(step, Field):
            if single:
                value = field_of(value, step.name)
            else:
                inner = field_of(V(F.lit(None), value.kind.elementType), step.name).kind
                name = step.name
                value = V(F.transform(value.col, lambda x: x[name]), T.ArrayType(inner))
            continue
        if isinstance(step, Slice):
            flag = slice_clamped(F.size(value.col), step) if single else F.exists(value.col, lambda x: slice_clamped(F.size(x), step))
            clamped = flag if clamped is None else clamped | flag
        if single:
            col, kind = step_many(value, step)
            value = V(F.coalesce(col, F.array().cast(T.ArrayType(kind))), T.ArrayType(kind))
        else:
            element = value.kind.elementType
            if isinstance(step, Where) and not isinstance(element, T.ArrayType):
                value = V(F.filter(value.col, lambda x: predicate(step.predicate, V(x, element))), value.kind)
            else:
                kind = step_many(V(F.lit(None), element), step)[1]
                empty = F.array().cast(T.ArrayType(kind))
                value = V(F.flatten(F.transform(value.col, lambda x: F.coalesce(step_many(V(x, element), step)[0], empty))), T.ArrayType(kind))
        single = False
    return Branches(value, single, clamped)


def root_value(schema: T.StructType, record: str | None = None) -> V:
    """The record: a struct column, or the whole row."""
    return V(F.col(record), schema[record].dataType) if record else V(F.struct(*(F.col(f"`{n}`") for n in schema.fieldNames())), schema)


def compile_path(schema: T.StructType, path: Path, record: str | None = None, name: str | None = None) -> Branches:
    """Branches of a path over a DataFrame's schema; record names the struct column that holds the message."""
    if path.root and name and path.root.split(".")[-1] != name.split(".")[-1]:
        raise PlanError(f"path {path.text!r} starts at {path.root}, not at {name}")
    if not path.steps:
        return Branches(root_value(schema, record), True)
    if record:
        return compile_steps(V(F.col(record), schema[record].dataType), path.steps)
    first = path.steps[0]
    if not isinstance(first, Field) or first.name not in schema.fieldNames():
        raise PlanError(f"unknown field in {path.text!r}; there are {', '.join(schema.fieldNames())}")
    return compile_steps(V(F.col(f"`{first.name}`"), schema[first.name].dataType), path.steps[1:])


def list_indices(schema: T.StructType, path: Path, record: str | None = None) -> Column:
    """array<struct<indices array<int>, value T>>: the concrete list positions along each branch."""
    def walk(v: V, steps: tuple[Step, ...], at: list[Column]) -> tuple[Column, T.DataType]:
        for n, s in enumerate(steps):
            if isinstance(s, Field):
                v = field_of(v, s.name)
                continue
            if isinstance(s, (Wildcard, Slice, Index)) and isinstance(v.kind, T.ArrayType):
                size = F.size(v.col)
                places = slice_places(size, s if isinstance(s, Slice) else Slice(None, None)) if not isinstance(s, Index) else F.filter(F.array(F.lit(s.at) if s.at >= 0 else size + s.at), lambda i: (i >= 0) & (i < size))
                inner = v.kind.elementType
                kind = walk(V(F.lit(None), inner), steps[n + 1 :], [])[1]
                each = F.transform(places, lambda i: walk(V(F.get(v.col, i), inner), steps[n + 1 :], [*at, i])[0])
                return F.flatten(F.coalesce(each, F.array())), kind
            raise PlanError("positions are of lists only")
        here = F.array(*at) if at else F.array().cast("array<int>")
        return F.array(F.struct(here.alias("indices"), v.col.alias("value"))), v.kind

    return walk(root_value(schema, record), path.steps, [])[0]


def is_scalar(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def path_value(branches: Branches, strict: bool = False) -> Column:
    """The branches' array; in strict mode a clamped slice raises."""
    if strict and branches.clamped is not None:
        return F.when(branches.clamped, F.raise_error(F.lit("range or index was clamped")).cast(branches.value.kind)).otherwise(branches.value.col)
    return branches.value.col
