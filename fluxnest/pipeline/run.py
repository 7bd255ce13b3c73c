"""Pipelines over DataFrames: compiled where they can be typed, interpreted in Arrow batches otherwise."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import PlanError, V
from ..path.compile import root_value
from .compile import Stream, Untyped, compile_tree
from .interpret import PipeError, execute
from .syntax import parse


def compile_pipeline(schema: T.StructType, program: str, record: str | None = None) -> Stream:
    """The program's outputs as a column; raises Untyped where it can't be typed."""
    return compile_tree(parse(program), root_value(schema, record))


def _jsonable(v):
    """Floats that JSON can't write become null."""
    if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
        return None
    if isinstance(v, list):
        return [_jsonable(x) for x in v]
    return {k: _jsonable(x) for k, x in v.items()} if isinstance(v, dict) else v


def interpret(df: DataFrame, program: str, keep: list[str], record: str | None = None, strict: bool = True, out: str = "out") -> DataFrame:
    """keep and out, an array of the outputs as JSON texts. In permissive mode a failing row has out null and its reason in _error."""
    return _interpreted(df, parse(program), F.to_json(root_value(df.schema, record).col, {"ignoreNullFields": "false"}), keep, strict, out)


def _read(t: str | None):
    try:
        return None if t is None else json.loads(t)
    except ValueError as e:
        raise PipeError(f"no JSON: {e}") from None


def _interpreted(df: DataFrame, tree: tuple, value: Column, keep: list[str], strict: bool, out: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            outs, errors = [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                try:
                    got = execute(tree, _read(t))
                    outs.append([json.dumps(_jsonable(x), separators=(",", ":"), ensure_ascii=False) for x in got])
                    errors.append(None)
                except PipeError as e:
                    if strict:
                        raise
                    outs.append(None)
                    errors.append(str(e))
            cols = [*b.columns[:-1], pa.array(outs, pa.list_(pa.string()))] + ([] if strict else [pa.array(errors, pa.string())])
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, out] + ([] if strict else ["_error"]))

    schema = df.select(*keep).schema.add(out, T.ArrayType(T.StringType()))
    if not strict:
        schema = schema.add("_error", T.StringType())
    return df.select(*keep, value.alias("__value")).mapInArrow(run, schema)


def interpret_json(df: DataFrame, program: str, column: str, keep: list[str], strict: bool = True, out: str = "out") -> DataFrame:
    """The same over a column of JSON texts; a null text is the value null, and a text that is no JSON an error of its row."""
    return _interpreted(df, parse(program), F.col(column), keep, strict, out)


def pipeline(df: DataFrame, program: str, keep: list[str], record: str | None = None, out: str = "out", engine: str = "auto") -> DataFrame:
    """keep and out, the program's outputs a row as an array.

    engine: "auto" compiles and falls back; "columns" raises Untyped instead; "interpreter" never compiles. Compiled
    programs give typed arrays, interpreted ones arrays of JSON text.
    """
    if engine != "interpreter":
        try:
            return df.select(*keep, compile_pipeline(df.schema, program, record).array.col.alias(out))
        except Untyped:
            if engine == "columns":
                raise
    return interpret(df, program, keep, record, out=out)


def outputs(df: DataFrame, program: str, keep: list[str], record: str | None = None, out: str = "out") -> DataFrame:
    """One row for each output."""
    return pipeline(df, program, keep, record, out).select(*keep, F.explode(out).alias(out))


def as_json(col: Column, kind: T.DataType) -> Column:
    """A compiled output array as JSON texts, to compare with interpreted ones."""
    element = kind.elementType
    if isinstance(element, (T.StructType, T.ArrayType, T.MapType)):
        return F.transform(col, lambda x: F.to_json(x, {"ignoreNullFields": "false"}))
    wrapped = lambda x: F.to_json(F.struct(x.alias("x")), {"ignoreNullFields": "false"})
    return F.transform(col, lambda x: F.regexp_extract(wrapped(x), r'(?s)^\{"x":(.*)\}$', 1))
