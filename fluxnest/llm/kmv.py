"""Distinct counts with k-minimum-values sketches.

A group's sketch is the sorted list of its k smallest hash values. Sketches merge by keeping the k
smallest of both, so partial results of any batch can be combined later. A group with fewer than k
values is counted exactly; otherwise the relative standard error is 1 / sqrt(k - 2).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hashes are the first 60 bits of MD5: even over [0, 2^60) and the same in any engine.
HASH_RANGE = 2.0**60
K = 1024
#: Rows a block of the partial step; bounds its memory.
BLOCK = 400_000
#: Sketches of one group that a merging task reads at most, as long as there are fewer than FAN^2 scan tasks.
FAN = 1024
#: Sketches that a merging task holds at a time.
SLICE = 1024


def hash60(value: Column) -> Column:
    """60-bit hash of a string; null for null and empty strings, which are no identifiers."""
    return F.when(value != "", F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("bigint"))


def _smallest(key: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(groups, offsets, hashes): the k smallest different hashes of each key, sorted."""
    order = np.lexsort((h, key))
    key, h = key[order], h[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
    key, h = key[fresh], h[fresh]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.array([], int)
    sizes = np.diff(np.r_[start, len(key)])
    rank = np.arange(len(key)) - np.repeat(start, sizes)
    keep = rank < k
    return key[start], np.r_[0, np.cumsum(np.minimum(sizes, k))], h[keep]


def _partial(dims: list[str], fields: list[str], k: int, schema: pa.Schema):
    sets = [s for n in range(1, len(dims) + 1) for s in combinations(range(len(dims)), n)]

    def flush(held: list[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        books, codes = [], []
        for d in dims:
            e = t.column(d).combine_chunks().dictionary_encode() if t.num_rows else None
            codes.append(e.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64))
            books.append(e.dictionary)
        for f in fields:
            col = t.column(f).combine_chunks()
            there = col.is_valid().to_numpy(zero_copy_only=False)
            h = col.fill_null(0).to_numpy(zero_copy_only=False)
            for s in sets:
                ok, key, span = there.copy(), np.zeros(len(h), np.int64), 1
                for i in s:
                    ok &= codes[i] >= 0
                    key += codes[i] * span
                    span *= max(1, len(books[i]))
                groups, offsets, hashes = _smallest(key[ok], h[ok], k)
                if not len(groups):
                    continue
                cols = {"field": pa.array([f] * len(groups), pa.string()), "by": pa.array([",".join(dims[i] for i in s)] * len(groups), pa.string()), "part": pa.array([part] * len(groups), pa.int32())}
                rest = groups
                for i in s:
                    size = max(1, len(books[i]))
                    cols[dims[i]] = books[i].take(pa.array(rest % size))
                    rest = rest // size
                for i, d in enumerate(dims):
                    if i not in s:
                        cols[d] = pa.nulls(len(groups), pa.string())
                cols["hashes"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes, pa.int64()))
                yield pa.RecordBatch.from_arrays([cols[n].cast(schema.field(n).type) for n in schema.names], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BLOCK:
                yield from flush(held, part)
                held, n = [], 0
        if n:
            yield from flush(held, part)

    return run


def _merging(keys: list[str], k: int, schema: pa.Schema):
    """Merge of sketches that come sorted by keys: k hashes of the group at hand and one slice of rows are held, however many sketches a group has."""

    def groups_of(t: pa.Table) -> np.ndarray:
        """Where a row's keys differ from those of the row before."""
        fresh = np.zeros(t.num_rows, bool)
        for c in keys:
            codes = t.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            fresh[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(fresh)

    def fold(t: pa.Table) -> pa.Table:
        """One row for each group of a sorted table."""
        group, lists = groups_of(t), t.column("hashes").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        _, offsets, hashes = _smallest(np.repeat(group, sizes), lists.flatten().to_numpy(zero_copy_only=False), k)
        at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        merged = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes, pa.int64()))
        return t.take(pa.array(at)).set_column(t.schema.get_field_index("hashes"), "hashes", merged)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                t = pa.Table.from_batches([b.slice(at, SLICE)]).select(schema.names).cast(schema)
                t = fold(t if held is None else pa.concat_tables([held, t]))
                held = t.slice(t.num_rows - 1)
                yield from t.slice(0, t.num_rows - 1).combine_chunks().to_batches()
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return run


def merge(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """(keys..., hashes): union of the sketches of equal keys, the k smallest hashes of all; sketches are never empty. Keys are strings or whole numbers.

    One shuffle; a task holds k hashes and SLICE sketches whatever the size of a group.
    """
    rows = sketches.select(*keys, "hashes")
    schema = pa.schema([*((c, pa.string() if isinstance(rows.schema[c].dataType, T.StringType) else pa.int64()) for c in keys), ("hashes", pa.list_(pa.int64()))])
    kinds = [f"`{c}` {'string' if schema.field(c).type == pa.string() else 'bigint'}" for c in keys]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merging(keys, k, schema), ", ".join([*kinds, "hashes array<bigint>"]))


def sketch_groups(df: DataFrame, dims: list[str], fields: list[str], k: int = K, fan: int = FAN, tasks: int | None = None) -> DataFrame:
    """(field, by, dims..., hashes): one sketch for each field, each combination of the string columns dims and each group.

    by names the combination; dims outside it are null. fields hold 60-bit hashes. Rows that lack a dimension of a
    combination or the identifier take no part there; an empty table has no groups. Each scan task keeps k hashes a group
    and block. With more than fan scan tasks (or an unknown number) sketches are merged by group and task number mod fan
    first, then by group, so that no task reads more than fan sketches of a group and level, nor holds more than merge does.
    """
    ddl = ", ".join(["field string", "by string", "part int", *(f"`{d}` string" for d in dims), "hashes array<bigint>"])
    schema = pa.schema([("field", pa.string()), ("by", pa.string()), ("part", pa.int32()), *((d, pa.string()) for d in dims), ("hashes", pa.list_(pa.int64()))])
    partial = df.select(*(F.col(d).cast("string") for d in dims), *fields).mapInArrow(_partial(dims, fields, k, schema), ddl)
    keys = ["field", "by", *dims]
    if tasks is None or tasks > fan:
        partial = merge(partial.withColumn("part", F.pmod("part", F.lit(fan))), [*keys, "part"], k)
    return merge(partial, keys, k)


def estimate(hashes: Column, k: int = K, z: float = 1.96) -> tuple[Column, Column, Column]:
    """(estimate, low, high) of a sketch at z standard errors; exact below k values."""
    n = F.size(hashes)
    value = (k - 1) / (F.element_at(hashes, k) / F.lit(HASH_RANGE))
    rel = z / math.sqrt(k - 2)
    pick = lambda full: F.when(n < k, n.cast("double")).otherwise(full)
    return pick(value), pick(value * (1 - rel)), pick(value * (1 + rel))


def set_operation(a: Column, b: Column, kind: str, k: int = K, z: float = 1.96) -> tuple[Column, Column, Column]:
    """(estimate, low, high) of the union, intersection or difference of two sketched sets.

    The union's k smallest hashes are a uniform sample of it; the share of the sample that the operation keeps gives
    the estimate, and its binomial error together with the union's gives the bounds.
    """
    sample = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    whole, low, high = estimate(sample, k, z)
    if kind == "union":
        return whole, low, high
    kept = F.array_intersect(a, b) if kind == "intersection" else F.array_except(a, b)
    n, hits = F.greatest(F.size(sample), F.lit(1)), F.size(F.array_intersect(kept, sample))
    p = hits / n
    exact = F.size(sample) < k
    error = F.when(exact, 0.0).otherwise(z * F.sqrt((p * (1 - p) + 1.0 / k) / n) + p * z / math.sqrt(k - 2))
    return whole * p, F.greatest(whole * (p - error), F.lit(0.0)), whole * F.least(p + error, F.lit(1.0 + z / math.sqrt(k - 2)))
