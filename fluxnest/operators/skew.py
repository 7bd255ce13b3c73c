"""Per-key results when a few keys hold most rows.

Heavy keys are found with a mergeable frequent-items sketch (every value above the share is in
it, whatever the data), counted exactly, and then handled apart: their rows meet the other side
by a broadcast join of at most 1 / share keys (salted where these have many rows), all others by an ordinary shuffle; the results
are united.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise, small_enough

#: Dimension rows of heavy keys that may be broadcast.
HOT_ROWS = 10_000


def _prune(counts: dict[str, int], k: int) -> tuple[dict[str, int], int]:
    """Keep at most k counters by subtracting the (k+1)-th largest from all."""
    if len(counts) <= k:
        return counts, 0
    cut = sorted(counts.values(), reverse=True)[k]
    return {v: n - cut for v, n in counts.items() if n > cut}, cut


def frequent_candidates(df: DataFrame, fields: list[str], k: int) -> DataFrame:
    """(field, value, low): at most k counters a partition and field; low is short of the truth by at most n / (k + 1) in all.

    Nulls and empty strings are no values. Memory a task: k counters and one batch for each field.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {f: {} for f in fields}
        for batch in batches:
            for f in fields:
                seen = pc.value_counts(batch.column(f))
                counts = held[f]
                for v, n in zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist()):
                    if v:
                        counts[v] = counts.get(v, 0) + n
                held[f], _ = _prune(counts, k)
        rows = [(f, v, n) for f, c in held.items() for v, n in c.items()]
        yield pa.RecordBatch.from_pydict({"field": [r[0] for r in rows], "value": [r[1] for r in rows], "low": pa.array([r[2] for r in rows], pa.int64())}, schema=pa.schema([("field", pa.string()), ("value", pa.string()), ("low", pa.int64())]))

    return df.select(*fields).mapInArrow(run, "field string, value string, low bigint").groupBy("field", "value").agg(F.sum("low").alias("low"))


def _likely(df: DataFrame, fields: list[str], share: float, total: int) -> DataFrame:
    """(field, value) of everything that may have the share: at most 1 / (share - 1 / (k + 1)) values a field, whatever the data."""
    k = int(4 / share)
    floor = share * total - total / (k + 1)
    return frequent_candidates(df, fields, k).filter(F.col("low") >= floor).select("field", "value")


def _long(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value) of every row and column, without nulls."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields)))
    return df.select(pairs.alias("x")).select("x.*").filter(F.col("value").isNotNull())


def heavy_hitters(df: DataFrame, fields: list[str], share: float) -> DataFrame:
    """(field, value, n): values of columns, as strings, found in at least share of all rows, with exact counts.

    All rows count for the share; nulls and empty strings are never heavy. An empty table has none.
    """
    df = df.select(*(F.col(f).cast("string").alias(f) for f in fields))
    total = df.count()
    likely = _likely(df, fields, share, total)
    exact = _long(df, fields).join(F.broadcast(likely), ["field", "value"]).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return exact.filter(F.col("n") >= share * total)


def per_key_counts(df: DataFrame, fields: list[str], share: float) -> DataFrame:
    """(field, value, n, hot): exact number of rows of every value of columns, as strings; hot values are found in at least share of all rows.

    Likely heavy values are detected by the sketch and counted where their rows lie, by a broadcast of them; rows of all
    other values, each below the share, go through an ordinary shuffle; the results are united. Null is no value, the empty
    string one that is never hot. An empty table has none.
    """
    df = df.select(*(F.col(f).cast("string").alias(f) for f in fields))
    total = df.count()
    likely = F.broadcast(materialise(_likely(df, fields, share, total), "likely"))
    rows, keys = _long(df, fields), ["field", "value"]
    count = F.count(F.lit(1)).alias("n")
    heavy = rows.join(likely, keys).groupBy(*keys).agg(count).withColumn("hot", F.col("n") >= share * total)
    light = rows.join(likely, keys, "left_anti").groupBy(*keys).agg(count).withColumn("hot", F.lit(False))
    return heavy.unionByName(light)


def skew_join(left: DataFrame, right: DataFrame, key: str, share: float = 0.03, how: str = "left", salts: int = 64) -> DataFrame:
    """Join a skewed table with a dimension; same rows as the plain join.

    Rows of heavy keys, and of the empty string, meet those keys' dimension rows by a broadcast while these are at most
    HOT_ROWS, as they are with a row a key; otherwise they are spread over salts and the dimension rows repeated for each. Rows
    of other keys are joined by shuffle; rows with a null key match nothing and skip the shuffle. how is "left" or "inner". The key may be of
    any simple type, the same on both sides. A column of right whose name left has too is renamed with the suffix _2.
    Empty tables give the plain join's result.
    """
    kind = left.schema[key].dataType
    if kind != right.schema[key].dataType:
        raise TypeError(f"{key} is {kind.simpleString()} on the left and {right.schema[key].dataType.simpleString()} on the right")
    taken = set(left.columns)
    right = right.withColumnsRenamed({c: f"{c}_2" for c in right.columns if c != key and c in taken})
    hot = [r["value"] for r in heavy_hitters(left, [key], share).select("value").collect()]  # at most 1 / share rows
    is_hot, blank = F.col(key).cast("string").isin(["", *hot]), F.col(key).isNull()
    few, many = right.filter(is_hot), left.filter(is_hot & ~blank)
    if small_enough(few, HOT_ROWS):
        heavy = many.join(F.broadcast(few), key, how)
    else:
        spread = many.withColumn("__salt", (F.rand() * salts).cast("int"))
        heavy = spread.join(few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [key, "__salt"], how).drop("__salt")
    light = left.filter(~is_hot & ~blank).join(right.filter(~is_hot), key, how)
    out = heavy.unionByName(light)
    if how == "left":
        extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != key]
        out = out.unionByName(left.filter(blank).select("*", *extra))
    return out


def per_key_totals(df: DataFrame, key: str, distinct: str, share: float = 0.03, salts: int = 64) -> DataFrame:
    """(key, n_rows, n_distinct): exact counts a key without a hot task.

    Rows of heavy keys, of the empty string and of null keys are deduplicated on (key, value), which spreads them
    over all tasks, and their counts added in two steps, over salts first; rows of other keys, each below the share,
    are counted by an ordinary shuffle on the key; the results are united. Null keys form one group; null values
    don't count. Other columns are ignored; an empty table gives no rows.
    """
    df = df.select(key, distinct)
    hot = [r["value"] for r in heavy_hitters(df, [key], share).select("value").collect()]  # at most 1 / share rows
    is_hot = F.col(key).isNull() | F.col(key).cast("string").isin(["", *hot])
    light = df.filter(~is_hot).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(distinct).alias("n_distinct"))
    return _salted_totals(df.filter(is_hot), key, distinct, salts).unionByName(light)


def _salted_totals(df: DataFrame, key: str, distinct: str, salts: int) -> DataFrame:
    pairs = df.select(F.col(key).alias("__k"), F.col(distinct).alias("__v")).groupBy("__k", "__v").agg(F.count(F.lit(1)).alias("rows"))
    part = pairs.groupBy("__k", F.pmod(F.xxhash64("__v"), F.lit(salts)).alias("__salt")).agg(F.sum("rows").alias("rows"), F.count("__v").alias("values"))
    return part.groupBy(F.col("__k").alias(key)).agg(F.sum("rows").alias("n_rows"), F.sum("values").alias("n_distinct"))
