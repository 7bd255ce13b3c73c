"""Structural-variant tables: nested records become flat tables that keep their parent links.

A bottom-up tree automaton runs over each record. A node's state follows from its children's states: *dead* (holds no
simple value at any depth), *live*, and for every object that is an entity the name of its variant, whose rule asks of some
children that they are live or in a state of their own (a device is located if its geo is a point). The same rules
compile to Spark columns for typed structs and to a Python evaluator for JSON text, which opens and settles each node once,
so both kinds of source meet in the same tables.

Every output row carries the supertype keys (record key, entity, variant, place) and the place
begins with the parent's place, which is the parent link. Dead objects give no row but keep their
index. A null record, an empty list and an empty text give no rows. Neither the depth nor the size of a record is bounded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Entity:
    """An object kind. path is dotted and relative to the parent entity (or the record).

    Variants are tried in order; each asks for children by name that aren't dead, or, as "child=state", in that state.
    """

    name: str
    path: str
    repeated: bool = False
    parent: str | None = None
    variants: tuple[tuple[str, tuple[str, ...]], ...] = ()


@dataclass(frozen=True)
class RecordSpec:
    entities: tuple[Entity, ...]

    def __getitem__(self, name: str) -> Entity:
        return next(e for e in self.entities if e.name == name)

    def chain(self, name: str) -> list[Entity]:
        """The entity with its ancestors, outermost first."""
        out, e = [], self[name]
        while e:
            out.insert(0, e)
            e = self[e.parent] if e.parent else None
        return out

    def child(self, owner: str, path: str) -> Entity | None:
        """The entity that lies at a path within another one."""
        return next((e for e in self.entities if e.parent == owner and e.path == path), None)

    @property
    def roots(self) -> frozenset[str]:
        """Field names by which a message is recognised inside an outer object or list."""
        return frozenset(e.path.split(".")[0] for e in self.entities if not e.parent)


BID_REQUEST = RecordSpec((
    Entity("imp", "imp", True, None, (("imp_av", ("banner", "video")), ("imp_video", ("video",)), ("imp_banner", ("banner",)), ("imp_bare", ()))),
    Entity("deal", "pmp.deals", True, "imp", (("deal_seated", ("wseat",)), ("deal_open", ()))),
    Entity("device", "device", False, None, (("device_located", ("geo=geo_point",)), ("device_placed", ("geo",)), ("device_bare", ()))),
    Entity("geo", "geo", False, "device", (("geo_point", ("lat", "lon")), ("geo_place", ()))),
    Entity("user", "user", False, None, (("user_profiled", ("ext",)), ("user_bare", ()))),
    Entity("demographic", "ext.demographic", False, "user", (("demographic", ()),)),
))


# ---- the automaton on typed structs -------------------------------------------------------------


def live(value: Column, kind: T.DataType) -> Column:
    """Whether the value holds at least one non-null simple value at any depth."""
    if isinstance(kind, T.StructType):
        return reduce(lambda a, b: a | b, (live(value[f.name], f.dataType) for f in kind.fields), F.lit(False))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(value, lambda x: live(x, kind.elementType)), F.lit(False))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.exists(F.map_values(value), lambda x: live(x, kind.valueType)), F.lit(False))
    return value.isNotNull()


def state(value: Column, kind: T.StructType, entity: Entity, spec: RecordSpec) -> Column:
    """The automaton's state of an entity: its variant, or null where the object is dead."""

    def meets(need: str) -> Column | None:
        name, _, wanted = need.partition("=")
        if name not in kind.fieldNames():
            return None
        child = spec.child(entity.name, name)
        if not wanted:
            return live(value[name], kind[name].dataType)
        if child is None:
            raise ValueError(f"{name} has no states of its own")
        return F.coalesce(state(value[name], kind[name].dataType, child, spec) == wanted, F.lit(False))

    out = F.lit(None).cast("string")
    for variant, needs in reversed(entity.variants):
        met = [m for n in needs if (m := meets(n)) is not None]
        if len(met) == len(needs):
            out = F.when(reduce(lambda a, b: a & b, met), F.lit(variant)).otherwise(out) if met else F.lit(variant)
    return F.when(live(value, kind), out)


def _step(value: Column, kind: T.DataType, path: str) -> tuple[Column, T.DataType]:
    for name in path.split("."):
        value, kind = value[name], kind[name].dataType
    return value, kind


def places(record: Column, kind: T.StructType, spec: RecordSpec, name: str, keep: bool = False) -> Column:
    """array<struct<place array<bigint>, variant string[, obj struct]>> of the live objects of one entity."""
    chain = spec.chain(name)

    def walk(value: Column, kind: T.DataType, rest: list[Entity], place: list[Column]) -> Column:
        e, more = rest[0], rest[1:]
        inner, k = _step(value, kind, e.path)
        if e.repeated:
            each = F.transform(inner, lambda x, i: walk_one(x, k.elementType, e, more, [*place, i]))
            return F.flatten(F.coalesce(each, F.array()))
        return walk_one(inner, k, e, more, place)

    def walk_one(value: Column, kind: T.StructType, e: Entity, more: list[Entity], place: list[Column]) -> Column:
        if more:
            return walk(value, kind, more, place)
        at = F.array(*(p.cast("bigint") for p in place)) if place else F.array().cast("array<bigint>")
        cols = [at.alias("place"), state(value, kind, e, spec).alias("variant"), *([value.alias("obj")] if keep else [])]
        return F.array(F.struct(*cols))

    return F.filter(walk(record, kind, chain, []), lambda x: x["variant"].isNotNull())


def shred(df: DataFrame, record: str, spec: RecordSpec, keys: list[str], only: Iterable[str] | None = None) -> DataFrame:
    """All entities of a typed record column in one pass, one narrow explode: keys, entity, variant, place."""
    kind = df.schema[record].dataType

    def tagged(name: str) -> Column:
        return F.transform(places(F.col(record), kind, spec, name), lambda x: F.struct(F.lit(name).alias("entity"), x["variant"].alias("variant"), x["place"].alias("place")))

    parts = [tagged(e.name) for e in spec.entities if only is None or e.name in only]
    return df.select(*keys, F.explode(F.concat(*parts)).alias("__row")).select(*keys, "__row.entity", "__row.variant", "__row.place")


def entity_table(df: DataFrame, record: str, spec: RecordSpec, name: str, keys: list[str]) -> DataFrame:
    """One entity's typed table: keys, variant, place and the object's own fields under obj."""
    kind = df.schema[record].dataType
    return df.select(*keys, F.explode(places(F.col(record), kind, spec, name, keep=True)).alias("__row")).select(*keys, "__row.variant", "__row.place", "__row.obj")


def shred_objects(df: DataFrame, record: str, spec: RecordSpec, keys: list[str]) -> DataFrame:
    """All entities of a typed record column with their objects, in one pass: keys, entity, variant, place and a column an entity, null but for the row's own.

    No key may have an entity's name.
    """
    kind = df.schema[record].dataType
    kinds = {e.name: entity_kind(kind, spec, e.name) for e in spec.entities}

    def tagged(name: str) -> Column:
        own = lambda x: [(x["obj"] if e == name else F.lit(None).cast(k)).alias(e) for e, k in kinds.items()]
        return F.transform(places(F.col(record), kind, spec, name, keep=True), lambda x: F.struct(F.lit(name).alias("entity"), x["variant"].alias("variant"), x["place"].alias("place"), *own(x)))

    rows = df.select(*keys, F.explode(F.concat(*map(tagged, kinds))).alias("__row"))
    return rows.select(*keys, *(f"__row.{c}" for c in ("entity", "variant", "place", *kinds)))


def entity_kind(kind: T.StructType, spec: RecordSpec, name: str) -> T.StructType:
    """The type of an entity's objects within the record's type."""
    for e in spec.chain(name):
        for step in e.path.split("."):
            kind = kind[step].dataType
        if e.repeated:
            kind = kind.elementType
    return kind


def dead_children(entity: Entity, variant: str, kind: T.StructType) -> list[str]:
    """Children that hold no value in any object of the variant: an earlier variant failed by them alone."""
    own, out = set(dict(entity.variants)[variant]), []
    for earlier, children in entity.variants:
        if earlier == variant:
            break
        missing = [c for c in children if c not in own]
        if len(missing) == 1 and missing[0] not in out and set(children) <= set(kind.fieldNames()):
            out += missing
    return out


def route(objects: DataFrame, entity: Entity, keys: list[str]) -> dict[str, DataFrame]:
    """The entity's subtype tables, one for each variant, from a table of shred_objects' columns: keys, variant, place and obj with the variant's own fields.

    Where the table lies in folders by entity and variant, each subtype table reads its own folder and its own column only.
    """
    kind = objects.schema[entity.name].dataType
    out = {}
    for variant, _ in entity.variants:
        dead = dead_children(entity, variant, kind)
        obj = F.col(entity.name).dropFields(*dead) if dead else F.col(entity.name)
        out[variant] = objects.filter((F.col("entity") == entity.name) & (F.col("variant") == variant)).select(*keys, "variant", "place", obj.alias("obj"))
    return out


# ---- the automaton on JSON text -----------------------------------------------------------------


def _refuse(word: str):
    raise ValueError(word)


_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\]|\\.)*")|([-+.\w]+))', re.DOTALL)
_END = re.compile(r"[ \t\n\r]*")


def _deep_loads(text: str):
    """json.loads with a stack of its own, for texts nested deeper than the library goes."""
    top: list = []
    stack: list = [top]
    keys: list[str | None] = [None]
    at, due = 0, "value"  # what may come: value, first (a value or an end), key, firstkey, colon, comma
    while stack[-1] is not top or not top:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        mark, quoted, word = m.groups()
        holder = stack[-1]
        if mark and mark in "}]":
            if len(stack) == 1 or isinstance(holder, dict) != (mark == "}") or due not in ("comma", "first" if mark == "]" else "firstkey"):
                raise ValueError(f"unexpected {mark} at {at}")
            stack.pop(), keys.pop()
            due = "comma"
        elif mark == ",":
            if due != "comma" or len(stack) == 1:
                raise ValueError(f"unexpected , at {at}")
            due = "key" if isinstance(holder, dict) else "value"
        elif mark == ":":
            if due != "colon":
                raise ValueError(f"unexpected : at {at}")
            due = "value"
        elif due in ("key", "firstkey"):
            if not quoted:
                raise ValueError(f"no key at {at}")
            keys[-1], due = json.loads(quoted), "colon"
        elif due in ("value", "first"):
            new = {"{": dict, "[": list}[mark]() if mark else json.loads(quoted or word, parse_constant=_refuse)
            if isinstance(holder, dict):
                holder[keys[-1]] = new
            else:
                holder.append(new)
            due = "comma"
            if mark:
                stack.append(new), keys.append(None)
                due = "firstkey" if mark == "{" else "first"
        else:
            raise ValueError(f"unexpected text at {at}")
    if _END.match(text, at).end() != len(text):
        raise ValueError("text after the value")
    return top[0]


def _loads(text: str):
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return _deep_loads(text)


#: What a text may begin with that spells an object, a list or a text of one.
_OPENS = frozenset('{["\ufeff \t\r\n')


def _decode(value):
    """What a value spells: JSON inside strings is opened as long as it spells an object or a list."""
    while isinstance(value, str):
        if value[:1] not in _OPENS:
            return value
        text = value.strip("﻿ \t\r\n")
        if text[:1] not in ("{", "[", '"'):
            return value
        try:
            inner = _loads(text)
        except ValueError:
            return value
        if not isinstance(inner, (dict, list, str)):
            return value
        value = inner
    return value


def parse_payload(payload: str | None):
    """The JSON value of a payload; None where it is blank or not complete JSON."""
    if payload is None:
        return None
    try:
        return _decode(_loads(payload.strip("﻿ \t\r\n")))
    except ValueError:
        return None


class Settled:
    """A JSON value whose strings are opened and whose nodes' states are known, all once and from the leaves up."""

    def __init__(self, value):
        self.value = value = _decode(value)
        order, todo = [], [value] if isinstance(value, (dict, list)) else []
        while todo:
            v = todo.pop()
            order.append(v)
            for k, x in v.items() if isinstance(v, dict) else enumerate(v):
                kind = type(x)
                if kind is str:
                    if x[:1] not in _OPENS or (opened := _decode(x)) is x:
                        continue
                    v[k] = x = opened  # a value in its place: the walk goes on
                    kind = type(x)
                if kind is dict or kind is list:
                    todo.append(x)
        self._live: dict[int, bool] = {}
        live = self._live
        for v in reversed(order):  # children come after their parents
            live[id(v)] = any(live[id(x)] if type(x) is dict or type(x) is list else x is not None for x in (v.values() if type(v) is dict else v))

    def live(self, x) -> bool:
        return self._live[id(x)] if isinstance(x, (dict, list)) else x is not None

    def state(self, value: dict, entity: Entity, spec: RecordSpec) -> str | None:
        """The automaton's state of an entity's object: its variant, or None where it is dead."""
        if not self.live(value):
            return None

        def meets(need: str) -> bool:
            name, _, wanted = need.partition("=")
            x = value.get(name)
            if not wanted:
                return self.live(x)
            obj = _object(x)
            return obj is not None and self.state(obj, spec.child(entity.name, name), spec) == wanted

        return next((variant for variant, needs in entity.variants if all(map(meets, needs))), None)


def _object(value) -> dict | None:
    if isinstance(value, list) and len(value) == 1:
        value = value[0]
    return value if isinstance(value, dict) else None


def _elements(value) -> list[tuple[int, object]]:
    """The places of a list, however it is written: a list, a single object, or an object keyed by whole numbers."""
    if isinstance(value, list):
        return list(enumerate(value))
    if isinstance(value, dict):
        if value and all(k.isascii() and k.isdigit() for k in value):
            return sorted(((int(k), x) for k, x in value.items() if len(k.lstrip("0")) < 20 and int(k) < 2**63), key=lambda e: e[0])
        return [(0, value)]
    return []


def find_message(value, roots: frozenset[str]) -> dict | None:
    """The nearest object that has one of the root fields, looking outside in."""
    level = [value]
    while level:
        deeper = []
        for v in level:
            if isinstance(v, dict):
                if roots & v.keys():
                    return v
                deeper.extend(v.values())
            elif isinstance(v, list):
                deeper.extend(v)
        level = [x for x in deeper if isinstance(x, (dict, list))]
    return None


def json_entities(payload: str | None, spec: RecordSpec) -> Iterator[tuple[str, str, list[int], dict]]:
    """(entity, variant, place, object) of every live entity of a payload."""
    settled = Settled(parse_payload(payload))
    message = find_message(settled.value, spec.roots)
    if message is None:
        return

    def walk(parent: dict, owner: str | None, place: list[int]):
        for e in spec.entities:
            if e.parent != owner:
                continue
            *way, last = e.path.split(".")
            holder = parent
            for name in way:
                holder = _object(holder.get(name)) or {}
            found = _elements(holder.get(last)) if e.repeated else [(-1, holder.get(last))]
            for i, x in found:
                obj = _object(x)
                if obj is None:
                    continue
                at = [*place, i] if e.repeated else place
                variant = settled.state(obj, e, spec)
                if variant:
                    yield e.name, variant, at, obj
                    yield from walk(obj, e.name, at)

    yield from walk(message, None, [])


def _coerce(value, kind: T.DataType):
    """A JSON value as the schema has it; null where it can't be."""
    if isinstance(kind, T.StructType):
        obj = _object(value)
        return None if obj is None else {f.name: _coerce(obj.get(f.name), f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        items = _elements(value)
        return [_coerce(x, kind.elementType) for _, x in items] if items or isinstance(value, list) else None
    if value is None or isinstance(value, (dict, list)):
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value)
    try:
        if isinstance(kind, T.BooleanType):
            return {"true": True, "false": False}.get(str(value).lower())
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return float(value)
        return int(value)
    except (ValueError, OverflowError):
        return None


def shred_json(df: DataFrame, payload: str, spec: RecordSpec, key: str, objects: dict[str, T.StructType] | None = None) -> DataFrame:
    """Entities of a JSON text column: key, entity, variant, place and, for the entities in objects, their canonical JSON."""
    names = objects or {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ents, variants, at, texts = [], [], [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for name, variant, place, obj in json_entities(text, spec):
                    if objects is not None and name not in names:
                        continue
                    keys.append(k)
                    ents.append(name)
                    variants.append(variant)
                    at.append(place)
                    texts.append(json.dumps(_coerce(obj, names[name])) if name in names else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.schema.types[0]), pa.array(ents, pa.string()), pa.array(variants, pa.string()), pa.array(at, pa.list_(pa.int64())), pa.array(texts, pa.string())],
                names=[key, "entity", "variant", "place", "obj_json"],
            )

    schema = T.StructType([df.select(key).schema[0], *T.StructType.fromDDL("entity string, variant string, place array<bigint>, obj_json string").fields])
    return df.select(key, payload).mapInArrow(run, schema)


def shred_json_objects(df: DataFrame, payload: str, spec: RecordSpec, key: str, kinds: dict[str, T.StructType]) -> DataFrame:
    """The same rows as shred_objects, from JSON text: each payload is parsed once for all entities."""
    rows = shred_json(df, payload, spec, key, kinds)
    own = [F.from_json(F.when(F.col("entity") == name, F.col("obj_json")), kind).alias(name) for name, kind in kinds.items()]
    return rows.select(key, "entity", "variant", "place", *own)
