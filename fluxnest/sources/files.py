"""Parquet sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def leaf_columns(schema: T.StructType) -> list[str]:
    """Dotted names of a schema's simple fields, in Parquet leaf order."""

    def walk(kind: T.DataType, top: str):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from walk(f.dataType, top)
        elif isinstance(kind, T.ArrayType):
            yield from walk(kind.elementType, top)
        elif isinstance(kind, T.MapType):
            yield from walk(kind.keyType, top)
            yield from walk(kind.valueType, top)
        else:
            yield top

    return [top for f in schema.fields for top in walk(f.dataType, f.name)]


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write with ZSTD compression; as many files and row groups as there are partitions."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def read_parquet(spark: SparkSession, path: str, leaves: list[int] | None = None) -> DataFrame:
    """Read whole files, every row group; leaves picks top-level columns by the index of any of their Parquet leaves."""
    df = spark.read.parquet(path)
    if leaves is None:
        return df
    names = leaf_columns(df.schema)
    if odd := [i for i in leaves if not 0 <= i < len(names)]:
        raise IndexError(f"no leaf {odd[0]}; there are {len(names)}")
    return df.select(*(f"`{n}`" for n in dict.fromkeys(names[i] for i in leaves)))


def to_table(df: DataFrame) -> pa.Table:
    """The whole result as one Arrow table on the driver; for results that fit there. An empty one keeps its schema."""
    return df.toArrow()


def iter_batches(df: DataFrame, batch_size: int = 1024) -> Iterator[pa.RecordBatch]:
    """The result as Arrow batches of batch_size rows (the last may be shorter), in order; the driver holds a partition at a time."""
    schema, held = to_arrow_schema(df.schema), []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(tuple(row))
        if len(held) == batch_size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def concat(parts: list[DataFrame]) -> DataFrame:
    """Results one behind the other; a column that a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def observed(df: DataFrame, threshold: int) -> tuple[DataFrame, Callable[[], tuple[int, bool]]]:
    """df and a function that, once df has run, gives the number of its rows and whether it reached the threshold."""
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n"))
    return out, lambda: (seen.get["n"], seen.get["n"] >= threshold)
