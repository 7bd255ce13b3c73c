"""Structured Streaming around the same functions that run in batch: decoding, flattening, pipelines, sessions and deduplication."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.denorm import DenormPlan


def flatten_stream(df: DataFrame, plan: DenormPlan) -> DataFrame:
    """Flat rows of a streaming DataFrame: stateless, so append mode works and batches are independent."""
    return plan.apply(df)


def run_available(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all that is there in bounded batches and stop; write gets each batch and its number."""
    q = df.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()
    q.awaitTermination()


def windowed_counts(df: DataFrame, time: str, keys: list[str], width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows a window and key; rows later than the watermark are dropped."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = df.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def session_counts(df: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions a key by inactivity gap."""
    out = df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def distinct_messages(df: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """One copy of each message within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """The running total of a value a key, kept as state."""

    def add(group: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0.0
        for b in batches:
            total += float(b[value].fillna(0).sum())
        state.update((total,))
        yield pd.DataFrame({key: [group[0]], "total": [total]})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(add, f"`{key}` {kind}, total double", "total double", "update", GroupStateTimeout.NoTimeout)
