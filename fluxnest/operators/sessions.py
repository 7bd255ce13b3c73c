"""Sessions separated by inactivity gaps, by pointer doubling.

Events are first collapsed into cells (device, floor(time / gap)): all events of a cell belong to
one session, and a cell's predecessor within the gap can only be the cell before it. A device
that holds a third of all rows therefore spreads over its cells. Each cell points to its
predecessor or to itself; pointers are joined with pointers until every one shows a root, and
cells are aggregated by root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise, release


def clean_ifa(ifa: Column) -> Column:
    """The 32 lower-case hexadecimal digits of a device id; null if it isn't one or is all zero."""
    bare = F.lower(F.regexp_replace(ifa, r"[\p{Punct}\p{P}]", ""))
    return F.when(bare.rlike("^[0-9a-f]{32}$") & (bare != "0" * 32), bare)


def event_ms(ts: Column) -> Column:
    """Whole milliseconds of a timestamp; null for the unset value 1970-01-01 00:00:00."""
    micros = F.unix_micros(ts)
    return F.when(micros != 0, F.floor(micros / 1000).cast("bigint"))


def resolve_roots(links: DataFrame, key: str = "device", node: str = "cell", max_rounds: int = 64) -> DataFrame:
    """Pointer doubling over (key, node, ptr) rows, one for each node that has a predecessor.

    Returns (key, node, ptr) with ptr the root. Each round joins pointers that may still move with
    the pointers of their targets; a target without a row is a root.
    """
    now = links.select(key, node, "ptr", F.lit(False).alias("done"))
    held: DataFrame | None = None
    for _ in range(max_rounds):
        step = now.select(F.col(key).alias("k2"), F.col(node).alias("n2"), F.col("ptr").alias("next"))
        moving = now.filter("not done").join(step, (F.col(key) == F.col("k2")) & (F.col("ptr") == F.col("n2")), "left")
        moved = moving.select(key, node, F.coalesce("next", "ptr").alias("ptr"), F.col("next").isNull().alias("done"))
        after = materialise(now.filter("done").unionByName(moved), "ptr")
        if held is not None:
            release(held)
        now = held = after
        if after.filter("not done").isEmpty():
            return after.select(key, node, "ptr")
    raise ValueError(f"pointers did not settle in {max_rounds} rounds")


def sessionise(events: DataFrame, device: str, time_ms: str, gap_ms: int) -> DataFrame:
    """(device, start_ms, end_ms, n_events) of each session.

    Neighbours at most gap_ms apart share a session. Rows with a null device or time take no
    part; repeated rows count in n_events; an empty table gives no sessions; other columns are ignored.
    """
    cell = F.floor(F.col(time_ms) / F.lit(gap_ms)).cast("bigint")
    cells = (
        events.filter(F.col(device).isNotNull() & F.col(time_ms).isNotNull())
        .groupBy(F.col(device).alias("device"), cell.alias("cell"))
        .agg(F.min(time_ms).alias("lo"), F.max(time_ms).alias("hi"), F.count(F.lit(1)).alias("n"))
    )
    cells = materialise(cells, "cells")
    before = cells.select(F.col("device").alias("d2"), (F.col("cell") + 1).alias("c2"), F.col("hi").alias("before_hi"))
    links = cells.join(before, (F.col("device") == F.col("d2")) & (F.col("cell") == F.col("c2")) & (F.col("lo") - F.col("before_hi") <= gap_ms))
    links = materialise(links.select("device", "cell", (F.col("cell") - 1).alias("ptr")), "links")
    roots = resolve_roots(links)
    release(links)
    rooted = cells.join(roots, ["device", "cell"], "left").withColumn("root", F.coalesce("ptr", "cell"))
    return rooted.groupBy("device", "root").agg(F.min("lo").alias("start_ms"), F.max("hi").alias("end_ms"), F.sum("n").alias("n_events")).drop("root")
