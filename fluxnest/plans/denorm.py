"""Denormalisation: nested records to flat rows.

Columns are grouped by the shape of their fan-out. Columns of one group advance together; groups are
cross-joined, the last one fastest; an empty group gives one row of nulls. Everything is narrow: one select and one
outer explode a group, so no plan of this module shuffles.

A group whose columns read fields of one list's elements explodes that list itself, which keeps nested column pruning
and code generation; only groups of mixed shapes zip arrays first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs
from ..functions.values import PlanError, V, truthy
from ..path.compile import Branches, compile_path, compile_steps, is_scalar
from ..path.syntax import Field, Path, Slice, Where, Wildcard, default_name, parse_path


@dataclass(frozen=True)
class Col:
    """One output column: a path or an expression."""

    name: str
    path: str | None = None
    expr: exprs.Expr | None = None
    strict: bool = False

    def __post_init__(self) -> None:
        if (self.path is None) == (self.expr is None):
            raise PlanError(f"column {self.name!r} needs a path or an expression, and only one")


def columns(*specs: str | Col, **named: str | exprs.Expr) -> list[Col]:
    """Columns from bare paths (named by their last segment), Col objects and name=path or name=expression."""
    out = [s if isinstance(s, Col) else Col(default_name(s), s) for s in specs]
    return out + [Col(n, s) if isinstance(s, str) else Col(n, expr=s) for n, s in named.items()]


def signature(path: Path, schema: T.StructType, record: str | None) -> str:
    """What decides the fan-out group: each wildcard and slice with its place and the field before it."""
    out = []
    kinds = _kinds(path, schema, record)
    for i, s in enumerate(path.steps):
        before = path.steps[i - 1].name if i and isinstance(path.steps[i - 1], Field) else ""
        if isinstance(s, Wildcard):
            out.append(f"{'M' if isinstance(kinds[i], T.MapType) else 'W'}{i}:{before}")
        elif isinstance(s, Slice):
            out.append(f"R{i}:{before}[{s.start}:{s.end}:{s.step}]")
    return ".".join(out)


def _kinds(path: Path, schema: T.StructType, record: str | None) -> list[T.DataType]:
    """Type before each step."""
    kind: T.DataType = schema[record].dataType if record else schema
    out = []
    for s in path.steps:
        out.append(kind)
        b = compile_steps(V(F.lit(None), kind), (s,))
        kind = b.element
    return out


def _split(path: Path) -> tuple[tuple, tuple]:
    """Steps up to the last that isn't a field, and the fields after it."""
    last = max((i for i, s in enumerate(path.steps) if not isinstance(s, Field)), default=-1)
    return path.steps[: last + 1], path.steps[last + 1 :]


class DenormPlan:
    """A plan bound to a schema. record names the struct column that holds the record; None is the whole row.

    correlated: nested fan-outs follow their parent's row instead of being crossed with it.
    broadcast: a path of one value counts on every branch of an expression, not just on the first.
    """

    def __init__(self, schema: T.StructType, cols: list[Col], record: str | None = None, *, correlated: bool = False, broadcast: bool = False, message: str | None = None):
        if not cols:
            raise PlanError("a plan needs at least one column")
        if len({c.name for c in cols}) < len(cols):
            raise PlanError("column names must differ")
        self.schema, self.cols, self.record, self.correlated, self.broadcast, self.message = schema, cols, record, correlated, broadcast, message
        self.paths: dict[str, Path] = {}
        errors = []
        for c in cols:
            for text in [c.path] if c.path is not None else exprs.leaves(c.expr):
                try:
                    self.paths.setdefault(text, parse_path(text))
                    b = self.branches(text)
                    if c.path is not None and not is_scalar(b.element):
                        raise PlanError(f"{text!r} ends at {b.element.simpleString()}, not at a simple value")
                except PlanError as e:
                    errors.append(f"{c.name}: {e}")
        if errors:
            raise PlanError("; ".join(errors))
        self.groups: dict[str, list[Col]] = {}
        for c in cols:
            self.groups.setdefault(self.signature(c), []).append(c)

    def branches(self, text: str) -> Branches:
        return compile_path(self.schema, self.paths[text], self.record, self.message)

    def signature(self, c: Col) -> str:
        first = c.path if c.path is not None else next(iter(exprs.leaves(c.expr)), None)
        return signature(self.paths[first], self.schema, self.record) if first is not None else ""

    # ---- expressions

    def _leaf_at(self, text: str, i: Column) -> V:
        """A path's value at branch i."""
        b = self.branches(text)
        if b.single:
            return b.value if self.broadcast else V(F.when(i == 0, b.value.col), b.value.kind)
        return V(F.get(b.value.col, i), b.element)

    def _aggregate(self, e: exprs.Call) -> V:
        child, first = e.args[0], next(iter(exprs.leaves(e.args[0])), None)
        if first is None:
            none = exprs.aggregate_array(e.func, F.array().cast("array<bigint>"), T.LongType(), e.params)
            return none
        n = F.size(self.branches(first).array)
        if isinstance(child, exprs.PathRef):
            b = self.branches(child.path)
            return exprs.aggregate_array(e.func, b.array, b.element, e.params)
        element = exprs.build(child, lambda t: self._leaf_at(t, F.lit(0)), self._aggregate).kind
        each = F.transform(_upto(n), lambda i: exprs.build(child, lambda t: self._leaf_at(t, i), self._aggregate).col)
        return exprs.aggregate_array(e.func, each, element, e.params)

    def _expr_array(self, e: exprs.Expr) -> tuple[Column, T.DataType]:
        """All branches of an expression: as many as its widest leaf has, and at least one."""
        sizes = [F.size(b.value.col) for b in map(self.branches, exprs.leaves(e)) if not b.single]
        n = F.greatest(F.lit(1), *sizes) if sizes else F.lit(1)
        kind = exprs.build(e, lambda t: self._leaf_at(t, F.lit(0)), self._aggregate).kind
        return F.transform(_upto(n), lambda i: exprs.build(e, lambda t: self._leaf_at(t, i), self._aggregate).col), kind

    # ---- groups

    def _shared_base(self, cols: list[Col]) -> tuple | None:
        """The steps whose elements all columns of a group read by fields only; None if they differ."""
        bases = set()
        for c in cols:
            for text in [c.path] if c.path is not None else exprs.leaves(c.expr):
                base, _ = _split(self.paths[text])
                if base:
                    bases.add(base)
                elif c.path is not None:
                    return None
            if c.strict:
                return None
        if len(bases) != 1:
            return None
        base = bases.pop()
        kinds = _kinds(Path(base), self.schema, self.record)
        list_step = isinstance(base[-1], (Wildcard, Slice)) or isinstance(base[-1], Where) and isinstance(kinds[-1], T.ArrayType)
        return base if list_step else None

    def apply(self, df: DataFrame) -> DataFrame:
        """Flat rows of df, with exactly the plan's columns."""
        out: dict[str, Column] = {}
        held: dict[tuple, str] = {}
        extra: dict[str, Column] = {}
        tag = "__"
        while any(c.startswith(tag) for c in df.columns):
            tag += "_"

        def aggregate(e: exprs.Call) -> V:
            v = self._aggregate(e)
            name = f"{tag}agg{len(extra)}"
            extra[name] = v.col
            return V(F.col(name), v.kind)

        steps: list[tuple[str, Column]] = []
        for g, (sig, cols) in enumerate(self.groups.items()):
            first = cols[0]
            base = self._shared_base(cols) if sig else None
            if base is not None:
                pos, item = f"{tag}pos{g}", f"{tag}item{g}"
                parent = max((p for p in held if self.correlated and base[: len(p)] == p), key=len, default=None)
                if parent:
                    start = V(F.col(held[parent]), compile_path(self.schema, Path(parent), self.record).element)
                    b = compile_steps(start, base[len(parent) :])
                else:
                    b = compile_path(self.schema, Path(base), self.record)
                held[base] = item
                steps.append((f"{pos},{item}", F.posexplode_outer(b.value.col)))
                element = b.element
                at = F.coalesce(F.col(pos), F.lit(0))

                def leaf(text: str, item=item, element=element, at=at, base=base) -> V:
                    prefix, fields = _split(self.paths[text])
                    if prefix == base:
                        return compile_steps(V(F.col(item), element), fields).value
                    return self._leaf_at(text, at)

                for c in cols:
                    if c.path is not None:
                        out[c.name] = leaf(c.path).col
                    else:
                        v = exprs.build(c.expr, leaf, aggregate).col
                        out[c.name] = v if first.expr is not None else F.when(F.col(pos).isNotNull(), v)
                continue
            wide = bool(sig) or first.path is not None and self._many(first.path) or first.expr is not None and any(map(self._many, exprs.leaves(first.expr)))
            if not wide:
                there = None
                if first.path is not None and not self.branches(first.path).single:
                    there = F.size(self.branches(first.path).value.col) > 0
                for c in cols:
                    if c.path is not None:
                        b = self.branches(c.path)
                        col = b.value.col if b.single else F.get(_strict(b, c.strict), F.lit(0))
                    else:
                        col = exprs.build(c.expr, lambda t: self._leaf_at(t, F.lit(0)), aggregate).col
                    out[c.name] = col if there is None else F.when(there, col)
                continue
            arrays = []
            for c in cols:
                if c.path is not None:
                    b = self.branches(c.path)
                    arrays.append(_strict(b, c.strict) if not b.single else b.array)
                else:
                    arrays.append(self._expr_array(c.expr)[0])
            names = [f"{tag}c{g}_{i}" for i in range(len(cols))]
            extra.update(zip(names, arrays))
            item = f"{tag}item{g}"
            size = F.size(F.col(names[0]))
            zipped = F.transform(_upto(size), _zipper(names))
            steps.append((item, F.explode_outer(zipped)))
            for n, c in zip(names, cols):
                out[c.name] = F.col(item)[n]
        if extra:
            df = df.select("*", *(c.alias(n) for n, c in extra.items()))
        for names, generator in steps:
            df = df.select("*", generator.alias(*names.split(",")))
        return df.select(*(out[c.name].alias(c.name) for c in self.cols))

    def _many(self, text: str) -> bool:
        """Whether a path outside every list fan-out can still have several branches: a filter on a list."""
        path = self.paths[text]
        kinds = _kinds(path, self.schema, self.record)
        return any(isinstance(s, Where) and isinstance(k, T.ArrayType) for s, k in zip(path.steps, kinds))

    def output_schema(self, df: DataFrame) -> T.StructType:
        return self.apply(df.limit(0)).schema


def _zipper(names: list[str]):
    return lambda i: F.struct(*(F.get(F.col(n), i).alias(n) for n in names))


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _strict(b: Branches, strict: bool) -> Column:
    if not strict or b.clamped is None:
        return b.value.col
    return F.when(b.clamped, F.raise_error(F.lit("range or index was clamped (strict)")).cast(b.value.kind)).otherwise(b.value.col)


def denorm(df: DataFrame, *specs: str | Col, record: str | None = None, correlated: bool = False, broadcast: bool = False, **named: str | exprs.Expr) -> DataFrame:
    """Flatten df by paths and expressions; works alike on batch and streaming DataFrames."""
    return DenormPlan(df.schema, columns(*specs, **named), record, correlated=correlated, broadcast=broadcast).apply(df)


def query(df: DataFrame, record: str | None = None, **paths: str) -> DataFrame:
    """One array of branches for each named path; the row stays one row."""
    return df.select(*(F.coalesce(compile_path(df.schema, parse_path(p), record).array, F.array()).alias(n) for n, p in paths.items()))


def first_int(array: Column, kind: T.DataType) -> Column:
    """The first branch as a whole number; 0 where there is none or it is no number."""
    v = V(F.get(array, F.lit(0)), kind)
    return F.coalesce(exprs.FUNCTIONS["cast_int"][2]([v], {}).col, F.lit(0).cast("bigint"))


def first_float(array: Column, kind: T.DataType) -> Column:
    v = V(F.get(array, F.lit(0)), kind)
    return F.coalesce(exprs.FUNCTIONS["cast_float"][2]([v], {}).col, F.lit(0.0))


def first_bool(array: Column, kind: T.DataType) -> Column:
    return truthy(V(F.get(array, F.lit(0)), kind))


def first_string(array: Column, kind: T.DataType) -> Column:
    return exprs.FUNCTIONS["cast_string"][2]([V(F.get(array, F.lit(0)), kind)], {}).col


def first_bytes(array: Column, kind: T.DataType) -> Column:
    """The first branch as bytes; null where there is none."""
    return F.get(array, F.lit(0)).cast("binary") if isinstance(kind, (T.BinaryType, T.StringType)) else F.lit(None).cast("binary")


def first_message(array: Column, kind: T.DataType) -> Column:
    """The first branch as a struct; null where there is none."""
    if not isinstance(kind, T.StructType):
        raise PlanError(f"{kind.simpleString()} is no message")
    return F.get(array, F.lit(0))


def all_floats(array: Column, kind: T.DataType) -> Column:
    return F.filter(F.transform(array, lambda x: exprs.FUNCTIONS["cast_float"][2]([V(x, kind)], {}).col), lambda x: x.isNotNull())


def all_bools(array: Column, kind: T.DataType) -> Column:
    return F.transform(F.filter(array, lambda x: x.isNotNull()), lambda x: truthy(V(x, kind)))


def all_ints(array: Column, kind: T.DataType) -> Column:
    """Every branch that is a whole number; others are skipped."""
    return F.filter(F.transform(array, lambda x: exprs.FUNCTIONS["cast_int"][2]([V(x, kind)], {}).col), lambda x: x.isNotNull())


def all_strings(array: Column, kind: T.DataType) -> Column:
    return F.transform(F.filter(array, lambda x: x.isNotNull()), lambda x: exprs.FUNCTIONS["cast_string"][2]([V(x, kind)], {}).col)


def _unsigned(x: Column, kind: T.DataType) -> Column:
    whole = exprs.FUNCTIONS["cast_int"][2]([V(x, kind)], {}).col
    return F.when(whole >= 0, whole.cast("decimal(20,0)"))


def first_uint(array: Column, kind: T.DataType) -> Column:
    """The first branch as an unsigned number; 0 where there is none, or it is negative or no number."""
    return F.coalesce(_unsigned(F.get(array, F.lit(0)), kind), F.lit(0).cast("decimal(20,0)"))


def all_uints(array: Column, kind: T.DataType) -> Column:
    """Every branch that is a whole number of at least 0; others are skipped."""
    return F.filter(F.transform(array, lambda x: _unsigned(x, kind)), lambda x: x.isNotNull())


def all_bytes(array: Column, kind: T.DataType) -> Column:
    """Every branch that is a text or bytes, as bytes; an empty array for other kinds."""
    if not isinstance(kind, (T.BinaryType, T.StringType)):
        return F.array().cast("array<binary>")
    return F.transform(F.filter(array, lambda x: x.isNotNull()), lambda x: x.cast("binary"))


def all_messages(array: Column, kind: T.DataType) -> Column:
    """Every branch that is a message."""
    if not isinstance(kind, T.StructType):
        raise PlanError(f"{kind.simpleString()} is no message")
    return F.filter(array, lambda x: x.isNotNull())
