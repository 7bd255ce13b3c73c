"""Nested records built from flat tables: orders with their items, customers with their orders, users with their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialise, table

_kept: dict[tuple, DataFrame] = {}


def keep(spark: SparkSession, d: str) -> None:
    """Write the nested records of a folder once; the functions below read them from then on, as messages that come nested."""
    for f in (orders_nested, customers_nested, events_by_user):
        made = f(spark, d)
        _kept[f.__name__, d, spark] = materialise(made, f.__name__)


def _from_kept(name: str, spark: SparkSession, d: str) -> DataFrame | None:
    return _kept.get((name, d, spark))

ITEM = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def nest(parents: DataFrame, parent_key: str, children: DataFrame, child_key: str, child: Column, out: str) -> DataFrame:
    """parents with their children as the list out, ordered by the whole child; a parent without children has an empty list.

    Both sides meet in one shuffle on the key, without a join: rows are united, then grouped. Parent keys are unique;
    children without a parent are left out, as in a left join.
    """
    whole = F.struct(*parents.columns)
    child_kind = children.select(child.alias("c")).schema["c"].dataType
    both = parents.select(F.col(parent_key).alias("__key"), whole.alias("__parent"), F.lit(None).cast(child_kind).alias("__child"))
    both = both.unionByName(children.select(F.col(child_key).alias("__key"), F.lit(None).cast(parents.schema).alias("__parent"), child.alias("__child")))
    grouped = both.groupBy("__key").agg(F.first("__parent", ignorenulls=True).alias("__parent"), F.array_sort(F.collect_list("__child")).alias(out))
    return grouped.filter(F.col("__parent").isNotNull()).select("__parent.*", out)


def orders_nested(spark: SparkSession, d: str, items: list[str] = ITEM) -> DataFrame:
    """Each order with items[]."""
    if items == ITEM and (kept := _from_kept("orders_nested", spark, d)) is not None:
        return kept
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    return nest(orders, "o_orderkey", table(spark, d, "lineitem"), "l_orderkey", F.struct(*items), "items")


def customers_nested(spark: SparkSession, d: str) -> DataFrame:
    """Each customer with orders[*].items[*]."""
    if (kept := _from_kept("customers_nested", spark, d)) is not None:
        return kept
    slim = orders_nested(spark, d, ["l_partkey", "l_quantity"])
    customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return nest(customers, "c_custkey", slim, "o_custkey", F.struct("o_orderkey", "o_totalprice", "items"), "orders")


def events_by_user(spark: SparkSession, d: str) -> DataFrame:
    """Each user with events[] (type, value, k) and counts, a map from event type to number."""
    if (kept := _from_kept("events_by_user", spark, d)) is not None:
        return kept
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    lists = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value", "k"))).alias("events"))
    kinds = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("counts"))
    return lists.join(kinds, "user_id")
