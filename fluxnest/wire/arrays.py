"""Arrow arrays as Python values, column by column: many times faster on nested arrays than value by value."""

from __future__ import annotations

import pyarrow as pa


def to_values(a: pa.Array) -> list:
    """The same as a.to_pylist(), maps as lists of pairs."""
    if isinstance(a, pa.ChunkedArray):
        return [v for c in a.chunks for v in to_values(c)]
    kind = a.type
    if pa.types.is_struct(kind):
        names = [kind.field(i).name for i in range(kind.num_fields)]
        cols = [to_values(c) for c in a.flatten()]
        rows = [dict(zip(names, t)) for t in zip(*cols)] if cols else [{} for _ in range(len(a))]
        return _masked(a, rows)
    if pa.types.is_map(kind):
        pairs = list(zip(to_values(a.keys), to_values(a.items)))
        return _sliced(a, pairs)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return _sliced(a, to_values(a.values))
    if a.null_count == 0 and (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return a.to_numpy(zero_copy_only=False).tolist()
    return a.to_pylist()


def _masked(a: pa.Array, rows: list) -> list:
    return [r if ok else None for r, ok in zip(rows, a.is_valid().to_pylist())] if a.null_count else rows


def _sliced(a: pa.Array, flat: list) -> list:
    at = a.offsets.to_numpy(zero_copy_only=False).tolist()
    return _masked(a, [flat[b:e] for b, e in zip(at, at[1:])])
