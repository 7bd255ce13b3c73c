"""Queries of the wire format, files and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import Lit, call
from ..plans.denorm import DenormPlan, columns, denorm
from ..runtime import scratch, table
from ..schema.proto import parse_proto
from ..sources.files import read_parquet, write_parquet
from ..sources.nested import orders_nested
from ..streaming.flow import run_available
from ..wire.frames import RecordType, decode_merged

ORDER_PROTO = """
syntax = "proto3";
message Item { int32 l_linenumber = 1; int64 l_partkey = 2; double l_quantity = 3; string l_returnflag = 4; }
message Order { int64 o_orderkey = 1; optional int64 o_custkey = 2; string o_orderstatus = 3; repeated Item items = 4; }
message Extra { double o_totalprice = 1; map<string, int64> seen = 2; }
"""
_ITEM = ["l_linenumber", "l_partkey", "l_quantity", "l_returnflag"]


def _types() -> tuple[RecordType, RecordType]:
    reg = parse_proto(ORDER_PROTO)
    return RecordType(reg, reg.lookup("Order")), RecordType(reg, reg.lookup("Extra"))


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    order, _ = _types()
    nested = orders_nested(spark, d, _ITEM).select(F.struct("o_orderkey", "o_custkey", "o_orderstatus", "items").alias("msg"))
    return order.encode(nested, "msg")


def wire_denorm(spark: SparkSession, d: str) -> DataFrame:
    """Bytes to struct to flat rows: the whole way of a raw message."""
    order, _ = _types()
    return denorm(order.decode(_encoded(spark, d), "payload"), "o_orderkey", "items[*].l_partkey", "items[*].l_quantity", record="msg")


def wire_projected(spark: SparkSession, d: str) -> DataFrame:
    """Only the needed fields are decoded."""
    reg = parse_proto(ORDER_PROTO)
    slim = RecordType(reg, reg.lookup("Order"), needed={"o_orderkey", "o_orderstatus"})
    return slim.decode(_encoded(spark, d), "payload").select("msg.*")


def wire_merged(spark: SparkSession, d: str) -> DataFrame:
    """A message and its extension, merged at ingest and flattened."""
    order, extra = _types()
    nested = orders_nested(spark, d, _ITEM)
    both = nested.select(F.struct("o_orderkey", "o_custkey", "o_orderstatus", "items").alias("m"), F.struct("o_totalprice", F.create_map(F.lit("n"), F.size("items").cast("bigint")).alias("seen")).alias("x"))
    raw = extra.encode(order.encode(both, "m", "base"), "x", "custom")
    return denorm(decode_merged(raw, order, "base", extra, "custom"), "o_orderkey", "o_totalprice", record="msg", n='seen["n"]', part="items[*].l_partkey")


def wire_permissive(spark: SparkSession, d: str) -> DataFrame:
    """Damaged messages are reported with their reason and don't stop the others: here those whose key's first byte is small are cut off."""
    order, _ = _types()
    nested = orders_nested(spark, d, _ITEM).select(F.col("o_orderkey").alias("sent"), F.struct("o_orderkey", "o_custkey", "o_orderstatus", "items").alias("msg"))
    raw = order.encode(nested, "msg").withColumn("payload", F.when(F.substring(F.hex("payload"), 3, 1) == "0", F.encode(F.lit("\x08"), "UTF-8")).otherwise(F.col("payload")))
    got = order.decode(raw, "payload", strict=False)
    return got.select("sent", "msg.o_custkey", F.size("msg.items").alias("n_items"), F.col("_corrupt").alias("reason"))


def io_parquet(spark: SparkSession, d: str) -> DataFrame:
    """Flat rows written as Parquet and read back by leaf index."""
    path = scratch(spark, "flat")
    write_parquet(denorm(orders_nested(spark, d), "o_orderkey", "items[*].l_partkey", "items[*].l_quantity"), path)
    return read_parquet(spark, path, [0, 2])


def stream_denorm(spark: SparkSession, d: str) -> DataFrame:
    """The same plan over a stream of bid requests, in bounded batches, equal to the batch result."""
    schema = table(spark, d, "bid_requests").schema
    cols = columns("rec_id", imp_id="msg.imp[*].id", cur="msg.imp[*].bidfloorcur", kind=call("cond", call("has", "msg.imp[*].id"), Lit("named"), Lit("unnamed")))
    plan = DenormPlan(schema, cols)
    out = scratch(spark, "stream")
    name = f"{d}/bid_request[s].parquet"
    if not table(spark, d, "bid_requests").inputFiles()[0].endswith("bid_requests.parquet"):
        name = f"{d}/bid_requests.parquet"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(name)
    flat = plan.apply(source)
    run_available(flat, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}"), f"{out}/checkpoint")
    return spark.read.schema(plan.output_schema(table(spark, d, "bid_requests"))).parquet(f"{out}/rows").drop("batch")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (wire_denorm, wire_projected, wire_merged, wire_permissive, io_parquet, stream_denorm)}
_LEFT = "FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey"
ORACLES = {
    "wire_denorm": f"SELECT o_orderkey, l_partkey, l_quantity {_LEFT}",
    "wire_projected": "SELECT o_orderkey, o_orderstatus FROM orders",
    "wire_merged": f"SELECT o_orderkey, o_totalprice, CAST(count(l_orderkey) OVER (PARTITION BY o_orderkey) AS BIGINT) AS n, l_partkey AS part {_LEFT}",
    "wire_permissive": "SELECT o_orderkey AS sent, CASE WHEN NOT cut THEN o_custkey END AS o_custkey, CASE WHEN NOT cut THEN n END AS n_items, CASE WHEN cut THEN 'cut-off or overlong number' END AS reason FROM (SELECT o_orderkey, o_custkey, CAST(count(l_orderkey) AS INTEGER) AS n, CASE WHEN o_orderkey <> 0 THEN o_orderkey ELSE o_custkey END < 16 AS cut FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)",
    "io_parquet": f"SELECT o_orderkey, l_quantity {_LEFT}",
    "stream_denorm": "SELECT rec_id, x.id AS imp_id, x.bidfloorcur AS cur, CASE WHEN i IS NULL THEN NULL WHEN x.id <> '' THEN 'named' ELSE 'unnamed' END AS kind FROM bid_requests b LEFT JOIN LATERAL (SELECT unnest(b.msg.imp) AS x, generate_subscripts(b.msg.imp, 1) AS i) ON true",
}
