"""Plans written as YAML. Unknown keys are errors."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import types as T

from ..functions import exprs
from ..functions.values import PlanError
from .denorm import Col, DenormPlan

_KEYS = {
    "config": {"proto", "custom_message", "denormalizer"},
    "message": {"file", "message", "import_paths"},
    "denormalizer": {"columns"},
    "column": {"name", "path", "strict", "expr"},
    "expr": {"func", "args", "sep", "literal", "literal2", "param"},
    "arg": {"path", "literal", "expr"},
}


@dataclass(frozen=True)
class MessageRef:
    file: str
    message: str
    import_paths: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    proto: MessageRef
    columns: list[Col] = field(default_factory=list)
    custom_message: MessageRef | None = None

    def plan(self, schema: T.StructType, record: str | None = None, **options: Any) -> DenormPlan:
        return DenormPlan(schema, self.columns, record, **options)


def _check(kind: str, node: Any, where: str) -> dict:
    if not isinstance(node, dict):
        raise PlanError(f"{where} must be a mapping")
    if odd := set(node) - _KEYS[kind]:
        raise PlanError(f"unknown key {sorted(map(str, odd))[0]!r} in {where}")
    return node


def _message(node: Any, where: str) -> MessageRef:
    node = _check("message", node, where)
    for key in ("file", "message"):
        if not node.get(key):
            raise PlanError(f"{where}.{key} is required")
    return MessageRef(node["file"], node["message"], tuple(node.get("import_paths") or ()))


def parse_expr(node: Any, where: str = "expr") -> exprs.Call:
    node = _check("expr", node, where)
    args = []
    for i, a in enumerate(node.get("args") or []):
        here = f"{where}.args[{i}]"
        a = _check("arg", a, here)
        if len(a) != 1:
            raise PlanError(f"{here} needs exactly one of path, literal and expr")
        if "expr" in a:
            args.append(parse_expr(a["expr"], here))
        elif "path" in a:
            args.append(exprs.PathRef(str(a["path"])))
        else:
            if isinstance(a["literal"], (list, dict)):
                raise PlanError(f"{here}: a literal is a string, number or boolean")
            args.append(exprs.Lit(a["literal"]))
    if node.get("func") == "select":
        raise PlanError("unknown func 'select'")
    params = {k: node[k] for k in ("sep", "literal", "literal2", "param") if k in node}
    return exprs.call(str(node.get("func")), *args, **params)


def parse_config(text: str) -> Config:
    """A configuration from YAML text."""
    root = _check("config", yaml.safe_load(text), "the configuration")
    if "proto" not in root:
        raise PlanError("proto.file is required")
    plan = _check("denormalizer", root.get("denormalizer") or {}, "denormalizer")
    cols = []
    for i, c in enumerate(plan.get("columns") or []):
        where = f"denormalizer.columns[{i}]"
        c = _check("column", c, where)
        if not c.get("name"):
            raise PlanError(f"{where}.name is required")
        if bool(c.get("path")) == bool(c.get("expr")):
            raise PlanError(f"{where} needs exactly one of path and expr")
        cols.append(Col(c["name"], c.get("path"), parse_expr(c["expr"], where + ".expr") if c.get("expr") else None, bool(c.get("strict"))))
    if not cols:
        raise PlanError("denormalizer.columns needs at least one column")
    custom = root.get("custom_message")
    return Config(_message(root["proto"], "proto"), cols, _message(custom, "custom_message") if custom else None)


def load_config(path: str) -> Config:
    with open(path) as f:
        return parse_config(f.read())


def skeleton(schema: T.StructType, file: str, message: str) -> str:
    """Starter YAML with a column for every simple field; lists become wildcards."""

    def walk(kind: T.DataType, path: str):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from walk(f.dataType, f"{path}.{f.name}" if path else f.name)
        elif isinstance(kind, T.ArrayType):
            yield from walk(kind.elementType, path + "[*]")
        elif isinstance(kind, T.MapType):
            yield from walk(kind.valueType, path + "[*]")
        else:
            yield path

    cols = [{"name": p.replace("[*]", "").replace(".", "_"), "path": p} for p in walk(schema, "")]
    return yaml.safe_dump({"proto": {"file": file, "message": message}, "denormalizer": {"columns": cols}}, sort_keys=False)
