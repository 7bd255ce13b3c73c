"""Exact deduplication of redelivered messages with quotient tables.

A message's identifier (id and time) is packed into fixed-width words and permuted by a keyed
Feistel network. The permutation can be undone, so two identifiers share quotient and remainder
only if they are the same: there are no false matches. The top bits are the quotient, which names
the shard; the remainder is stored whole. Ids that don't fit the fixed width keep their full text in
the remainder.

Each scan task inserts its own rows into a bounded table and sends on one survivor of each
identifier, so a message delivered to a third of all rows reaches its shard once a task. Shards
are sorted by quotient and remainder, as runs of a quotient table are, and insertion is one
comparison with the run before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sessions import event_ms

#: Ids of fixed width: a prefix, 8 and 18 hexadecimal digits.
FIXED_ID = r"^br-[0-9a-f]{8}-[0-9a-f]{18}$"


def canonical_id(value: Column) -> Column:
    """Lower case without surrounding white space; null where nothing is left."""
    bare = F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    return F.when(bare != "", bare)


def pack_id(value: Column) -> tuple[Column, Column, Column]:
    """(w1, w2, rest) of a canonical id: the 26 hexadecimal digits of a fixed-width id as two words of 52 bits and a null rest.

    Ids of any other form keep their whole text as rest; their words only place them.
    """
    fixed = value.rlike(FIXED_ID)
    digits = F.concat(F.substring(value, 4, 8), F.substring(value, 13, 18))
    word = lambda at: F.conv(F.substring(digits, at, 13), 16, 10).cast("bigint")
    return F.when(fixed, word(1)).otherwise(F.xxhash64(value)), F.when(fixed, word(14)).otherwise(F.xxhash64(F.lit(1), value)), F.when(~fixed, value)


def feistel(left: Column, right: Column, rounds: int = 4, seed: int = 20) -> tuple[Column, Column]:
    """A keyed permutation of two 64-bit words; unfeistel undoes it."""
    for i in range(rounds):
        left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(seed + i)))
    return left, right


def unfeistel(left: Column, right: Column, rounds: int = 4, seed: int = 20) -> tuple[Column, Column]:
    for i in reversed(range(rounds)):
        left, right = right.bitwiseXOR(F.xxhash64(left, F.lit(seed + i))), left
    return left, right


def _first_of_runs(w1, w2, ts, rest, rec):
    """Order by identifier then record, and which rows open a run. rest holds codes of the texts."""
    order = np.lexsort((rec, rest, ts, w2, w1))
    same = np.ones(len(order), bool)
    for a in (w1, w2, ts, rest):
        b = a[order]
        same[1:] &= b[1:] == b[:-1]
    same[:1] = False
    return order, ~same


def _codes(column: pa.Array, book: dict[str, int]) -> np.ndarray:
    """Whole numbers for texts, -1 for null; equal texts have equal numbers within one task's book."""
    if column.null_count == len(column):
        return np.full(len(column), -1, np.int64)
    return np.array([-1 if t is None else book.setdefault(t, len(book)) for t in column.to_pylist()], np.int64)


def _batch(schema: pa.Schema, w1, w2, ts, rest, rec, lose) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(w1, pa.int64()), pa.array(w2, pa.int64()), pa.array(ts, pa.int64()), rest, pa.array(rec, pa.int64()), pa.array(lose, pa.bool_())], schema=schema)


def _local(block: int):
    """One survivor of each identifier a block of rows; the rest are marked as lost at once."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("ts", pa.int64()), ("rest", pa.string()), ("rec", pa.int64()), ("lose", pa.bool_())])

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        w1, w2, ts, rec = (t.column(c).to_numpy() for c in ("w1", "w2", "ts", "rec"))
        text = t.column("rest").combine_chunks() if t.num_rows else pa.array([], pa.string())
        order, first = _first_of_runs(w1, w2, ts, _codes(text, {}), rec)
        return _batch(schema, w1[order], w2[order], ts[order], text.take(pa.array(order)), rec[order], ~first)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= block:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return run


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by identifier and record: a row that repeats the identifier before it is lost."""
    before = None
    for b in batches:
        if not b.num_rows:
            continue
        w1, w2, ts, rec = (b.column(c).to_numpy() for c in ("w1", "w2", "ts", "rec"))
        lose = b.column("lose").to_numpy(zero_copy_only=False)
        book: dict[str, int] = {}
        texts = b.column("rest")
        codes = _codes(texts, book)
        same = np.zeros(len(rec), bool)
        same[1:] = (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1]) & (ts[1:] == ts[:-1]) & (codes[1:] == codes[:-1])
        same[0] = before == (w1[0], w2[0], ts[0], texts[0].as_py())
        before = (w1[-1], w2[-1], ts[-1], texts[-1].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(rec[same | lose], pa.int64())], names=["rec_id"])


def identifiers(df: DataFrame, key: str, ident: str, ts: str) -> DataFrame:
    """(w1, w2, ts, rest, rec) of the rows that can be copies: permuted words, time and remainder text."""
    rows = df.select(F.col(key).alias("rec"), canonical_id(F.col(ident)).alias("id"), event_ms(F.col(ts)).alias("ts"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("ts").isNotNull() & F.col("rec").isNotNull())
    left, right, rest = pack_id(F.col("id"))
    rows = rows.select(left.alias("l"), right.alias("r"), "ts", rest.alias("rest"), "rec")
    w1, w2 = feistel(F.col("l"), F.col("r").bitwiseXOR(F.xxhash64("ts")))
    return rows.select(w1.alias("w1"), w2.alias("w2"), "ts", "rest", "rec")


def redelivered(df: DataFrame, key: str = "rec_id", ident: str = "id", ts: str = "req_ts", block: int = 500_000, shard_bits: int = 16) -> DataFrame:
    """(rec_id) of every copy of a message but the one with the smallest rec_id.

    Copies agree in id (letter case and surrounding white space aside) and in whole milliseconds of
    the time. Rows with a null or blank id, a null or unset time or a null key are never copies. One shuffle.
    """
    local = identifiers(df, key, ident, ts).mapInArrow(_local(block), "w1 bigint, w2 bigint, ts bigint, rest string, rec bigint, lose boolean")
    quotient = F.shiftrightunsigned("w1", 64 - shard_bits)
    where = F.when(F.col("lose"), F.col("rec")).otherwise(quotient)
    spread = local.repartition(where).sortWithinPartitions("w1", "w2", "ts", "rest", "rec")
    return spread.mapInArrow(_shards, "rec_id bigint")


def fresh_messages(batch: DataFrame, seen: DataFrame, key: str = "rec_id", ident: str = "id", ts: str = "req_ts") -> tuple[DataFrame, DataFrame]:
    """(rows to keep, identifiers to append) of a later batch, given the identifiers (w1, w2, ts, rest) stored so far.

    Copies within the batch and copies of earlier batches are dropped; rows that can't be copies are always kept. seen is
    partitioned by nothing but its words, so it may be bucketed by w1 to spare its shuffle.
    """
    once = batch.join(redelivered(batch, key, ident, ts), key, "left_anti")
    words = identifiers(once, key, ident, ts)
    same = [words[c].eqNullSafe(seen[c]) for c in ("w1", "w2", "ts", "rest")]
    known = words.join(seen, same[0] & same[1] & same[2] & same[3], "left_semi").select(F.col("rec").alias(key))
    kept = once.join(known, key, "left_anti")
    return kept, identifiers(kept, key, ident, ts).select("w1", "w2", "ts", "rest")
