"""Queries of the interface around the engine: schemas, configurations, transcoders, framed files, accessors, time formats and errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..api import Transcoder
from ..functions.exprs import Lit, call
from ..functions.values import literal
from ..path.compile import compile_path, path_value
from ..path.syntax import format_path, parse_path, prefix
from ..pipeline.run import interpret_json
from ..plans import denorm as dn
from ..plans.config import parse_config, skeleton
from ..plans.denorm import DenormPlan, columns, denorm, query
from ..runtime import scratch, table
from ..schema import proto as p
from ..sources.files import concat, iter_batches, observed, read_parquet, to_table, write_parquet
from ..sources.nested import ITEM, customers_nested, nest, orders_nested
from ..streaming.flow import run_available
from ..wire.frames import RecordType, read_framed, retag_column, write_framed
from .io import _ITEM, ORDER_PROTO, _encoded, _types
from .nested import CUSTOMERS, ORDERS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_LEFT = "FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey"


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


# ---- the ad request as a message

BID_PROTO = """
syntax = "proto3";
import "google/protobuf/timestamp.proto";
message DecimalValue { optional int64 units = 1; optional sfixed32 nanos = 2; }
message Deal { optional string id = 1; DecimalValue bidfloor = 2; optional int64 at = 3; repeated string wseat = 4; }
message Pmp { optional int64 private_auction = 1; repeated Deal deals = 2; }
message Banner { repeated string mimes = 1; optional int64 w = 2; optional int64 h = 3; }
message Video { repeated string mimes = 1; optional int64 w = 2; repeated int64 protocols = 7; }
message Imp { optional string id = 1; optional int64 exp = 2; Pmp pmp = 3; oneof shown { Banner banner = 4; Video video = 5; } DecimalValue bidfloor = 6; optional string bidfloorcur = 7; optional uint64 dt = 9; map<string, int64> sizes = 10; }
message Geo { DecimalValue lat = 1; DecimalValue lon = 2; optional string country = 4; }
message Device { optional string ifa = 1; optional string ua = 2; Geo geo = 4; }
message BidRequest { optional string id = 1; Device device = 3; repeated Imp imp = 4; repeated string cur = 6; google.protobuf.Timestamp timestamp = 9; }
"""


def _bid_messages(spark: SparkSession, d: str) -> tuple[RecordType, DataFrame]:
    """Every bid request as bytes: nested and repeated messages, a oneof, a map, an unsigned number and a timestamp."""
    reg = p.parse_proto(BID_PROTO)
    kind = RecordType(reg, reg.lookup("BidRequest"), flatten=True)
    # A list may hold null objects; on the wire these are empty messages. An object of both kinds is sent as a video.
    imp = F.transform(
        "msg.imp",
        lambda x: F.struct(
            x["id"].alias("id"), x["exp"].alias("exp"),
            F.struct(x["pmp"]["private_auction"].alias("private_auction"), F.transform(x["pmp"]["deals"], lambda y: F.struct(y["id"].alias("id"), y["bidfloor"].alias("bidfloor"), y["at"].alias("at"), F.filter(y["wseat"], lambda s: s.isNotNull()).alias("wseat"))).alias("deals")).alias("pmp"),
            F.when(x["video"].isNull(), F.struct(x["banner"]["mimes"].alias("mimes"), x["banner"]["w"].alias("w"), x["banner"]["h"].alias("h"))).alias("banner"),
            F.when(x["video"].isNotNull(), F.struct(x["video"]["mimes"].alias("mimes"), x["video"]["w"].alias("w"), x["video"]["protocols"].alias("protocols"))).alias("video"),
            x["bidfloor"].alias("bidfloor"), x["bidfloorcur"].alias("bidfloorcur"), x["dt"].alias("dt"),
            F.create_map(F.lit("w"), F.coalesce(x["banner"]["w"], F.lit(-1)), F.lit("h"), F.coalesce(x["banner"]["h"], F.lit(-1))).alias("sizes"),
        ),
    )
    geo = F.struct(F.col("msg.device.geo.lat").alias("lat"), F.col("msg.device.geo.lon").alias("lon"), F.col("msg.device.geo.country").alias("country"))
    device = F.struct(F.col("msg.device.ifa").alias("ifa"), F.col("msg.device.ua").alias("ua"), geo.alias("geo"))
    whole = F.struct(F.col("msg.id").alias("id"), device.alias("device"), F.coalesce(imp, F.array()).alias("imp"), F.filter("msg.cur", lambda c: c.isNotNull()).alias("cur"), F.col("msg.timestamp").alias("timestamp"))
    return kind, kind.encode(table(spark, d, "bid_requests").select("rec_id", whole.alias("msg")), "msg")


_IMPS = "FROM bid_requests b LEFT JOIN LATERAL (SELECT unnest(b.msg.imp) AS x, generate_subscripts(b.msg.imp, 1) AS i) ON true"


@_query(
    f"SELECT rec_id, msg.id AS request, msg.device.ifa AS ifa, msg.device.geo.lat.units AS lat, msg.device.geo.country AS country, coalesce(CAST(floor(epoch_us(msg.timestamp) / 1000) AS BIGINT), 0) AS ts, x.id AS imp_id, x.bidfloor.nanos AS nanos, CAST(x.dt AS VARCHAR) AS dt, CASE WHEN x.video IS NULL THEN x.banner.w END AS banner_w, x.video.w AS video_w, CASE WHEN i IS NOT NULL THEN coalesce(x.banner.w, -1) END AS w {_IMPS}"
)
def wire_bid_request(spark: SparkSession, d: str) -> DataFrame:
    """The ad request, encoded, decoded in whole batches and flattened."""
    kind, raw = _bid_messages(spark, d)
    flat = denorm(
        kind.decode(raw, "payload"), dn.Col("rec_id", "rec_id"), *columns(request="msg.id", ifa="msg.device.ifa", lat="msg.device.geo.lat.units", country="msg.device.geo.country", ts="msg.timestamp", imp_id="msg.imp[*].id", nanos="msg.imp[*].bidfloor.nanos", dt="msg.imp[*].dt", banner_w="msg.imp[*].banner.w", video_w="msg.imp[*].video.w"),
        dn.Col("w", 'msg.imp[*].sizes["w"]'), correlated=True,
    )
    return flat.withColumn("ts", F.unix_millis("ts")).withColumn("dt", F.col("dt").cast("string"))


@_query("SELECT rec_id, y.id AS deal, y.bidfloor.units AS units, CAST(len(list_filter(coalesce(y.wseat, []), lambda s: s IS NOT NULL)) AS INTEGER) AS seats FROM bid_requests, unnest(msg.imp) AS t(x), unnest(x.pmp.deals) AS v(y)")
def wire_bid_deals(spark: SparkSession, d: str) -> DataFrame:
    """The deals, three messages deep, read from bytes."""
    kind, raw = _bid_messages(spark, d)
    deals = kind.decode(raw, "payload").select("rec_id", F.explode(F.flatten(F.transform("msg.imp", lambda x: x["pmp"]["deals"]))).alias("y"))
    return deals.select("rec_id", F.col("y.id").alias("deal"), F.col("y.bidfloor.units").alias("units"), F.size("y.wseat").alias("seats"))


# ---- message tools

@_query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def wire_retag(spark: SparkSession, d: str) -> DataFrame:
    """Field numbers rewritten in the bytes, read by a schema with the new numbers."""
    reg = p.parse_proto('syntax = "proto3"; message Order { int64 o_orderkey = 101; optional int64 o_custkey = 2; string o_orderstatus = 17; }')
    moved = retag_column(_encoded(spark, d), "payload", {1: 101, 3: 17})
    return RecordType(reg, reg.lookup("Order")).decode(moved, "payload").select("msg.*")


@_query(f"SELECT o_orderkey, o_totalprice, CAST(count(l_orderkey) OVER (PARTITION BY o_orderkey) AS BIGINT) AS n, l_partkey AS part {_LEFT}")
def schema_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two messages as one by a merged schema: the second one's fields are renumbered and its bytes put behind the first one's."""
    order, extra = _types()
    merged = p.merge(order.reg, order.message, extra.message)
    top = max(f.number for f in order.message.fields)
    nested = orders_nested(spark, d, _ITEM)
    both = nested.select(F.struct("o_orderkey", "o_custkey", "o_orderstatus", "items").alias("m"), F.struct("o_totalprice", F.create_map(F.lit("n"), F.size("items").cast("bigint")).alias("seen")).alias("x"))
    raw = extra.encode(order.encode(both, "m", "base"), "x", "more")
    raw = retag_column(raw, "more", {f.number: top + i + 1 for i, f in enumerate(extra.message.fields)}).select(F.concat("base", "more").alias("payload"))
    return denorm(RecordType(order.reg, merged).decode(raw, "payload"), "o_orderkey", "o_totalprice", record="msg", n='seen["n"]', part="items[*].l_partkey")


@_query("SELECT o_orderkey, o_custkey FROM orders")
def schema_prune(spark: SparkSession, d: str) -> DataFrame:
    """A schema without the fields of messages that hold nothing, at any depth; the columns are what is left."""
    text = 'syntax = "proto3"; message Void {} message Shell { Void v = 1; repeated Void w = 2; } message Order { int64 o_orderkey = 1; Void gone = 9; optional int64 o_custkey = 2; Shell shell = 10; }'
    reg = p.parse_proto(text)
    slim, message = p.prune_empty(reg, reg.lookup("Order"))
    return RecordType(slim, message).decode(_encoded(spark, d), "payload").select("msg.*")


@_query("SELECT o_orderkey, true AS same, false AS other FROM orders")
def schema_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Messages are read only by the schema they were written by; another one is reported to a caller that can rebuild."""
    order, extra = _types()
    known = p.fingerprint(order.reg, order.message)
    same = p.check_fingerprint(order.reg, order.message, known)
    other = p.check_fingerprint(extra.reg, extra.message, known, "rebuild")
    return order.decode(_encoded(spark, d), "payload").select("msg.o_orderkey", F.lit(same).alias("same"), F.lit(other).alias("other"))


@_query(f"SELECT o_orderkey, CAST(l_quantity AS DOUBLE) AS v, 'double' AS kind {_LEFT}")
def schema_path(spark: SparkSession, d: str) -> DataFrame:
    """A field of a message's schema, found by its path, gives the column and its type."""
    order, _ = _types()
    f = p.field_at(order.schema, ["items", "l_quantity"])
    flat = denorm(order.decode(_encoded(spark, d), "payload"), "o_orderkey", record="msg", v=f"items[*].{f.name}")
    return flat.withColumn("kind", F.lit(f.dataType.simpleString()))


@_query("SELECT event_id, '{\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS props, '[' || CAST(json_extract(props, '$.k') AS BIGINT) || ',\"x\"]' AS list FROM events")
def wire_struct_json(spark: SparkSession, d: str) -> DataFrame:
    """Recursive JSON-like messages to bytes and back to JSON text."""
    reg = p.parse_proto('syntax = "proto3"; import "google/protobuf/struct.proto"; message E { int64 event_id = 1; google.protobuf.Struct props = 2; google.protobuf.ListValue list = 3; }')
    kind = RecordType(reg, reg.lookup("E"))
    e = table(spark, d, "events")
    rows = e.select(F.struct("event_id", "props", F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit(',"x"]')).alias("list")).alias("m"))
    return kind.decode(kind.encode(rows, "m"), "payload").select("msg.*")


@_query("SELECT o_orderkey, epoch_ms(o_orderdate) AS at, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_custkey AS cust, o_totalprice AS price, o_orderstatus AS status, o_totalprice > 50000 AS large, o_orderstatus || ',b' AS mask FROM orders")
def wire_flattened(spark: SparkSession, d: str) -> DataFrame:
    """Well-known messages as simple columns, to bytes and back."""
    text = """syntax = "proto3"; import "google/protobuf/timestamp.proto"; import "google/protobuf/wrappers.proto"; import "google/protobuf/field_mask.proto"; import "google/type/date.proto";
    message W { int64 o_orderkey = 1; google.protobuf.Timestamp at = 2; google.type.Date day = 3; google.protobuf.Int64Value cust = 4; google.protobuf.DoubleValue price = 5; google.protobuf.StringValue status = 6; google.protobuf.BoolValue large = 7; google.protobuf.FieldMask mask = 8; }"""
    reg = p.parse_proto(text)
    kind = RecordType(reg, reg.lookup("W"), flatten=True)
    o = table(spark, d, "orders")
    row = F.struct("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"), F.to_date("o_orderdate").alias("day"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") > 50000).alias("large"), F.concat("o_orderstatus", F.lit(",b")).alias("mask"))
    back = kind.decode(kind.encode(o.select(row.alias("m")), "m"), "payload").select("msg.*")
    return back.withColumn("at", F.unix_millis("at")).withColumn("day", F.col("day").cast("string"))


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def schema_prune_type(spark: SparkSession, d: str) -> DataFrame:
    """A type without the structs that hold nothing, at any depth, reads the rest."""
    kind = p.prune_type(T.StructType.fromDDL("k bigint").add("none", T.StructType()).add("deep", T.ArrayType(T.StructType().add("none", T.StructType()))))
    return table(spark, d, "events").select("event_id", F.from_json("props", kind).alias("x")).select("event_id", "x.*")


@_query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FILLED' WHEN 'O' THEN 'OPEN' ELSE 'NONE' END AS state FROM orders")
def plan_enum(spark: SparkSession, d: str) -> DataFrame:
    """Names of an enum, taken from the schema by the path of an expression."""
    text = 'syntax = "proto3"; enum State { NONE = 0; OPEN = 1; FILLED = 5; } message Order { int64 o_orderkey = 1; State state = 2; }'
    plan = """
proto: {file: order.proto, message: Order}
denormalizer:
  columns:
    - {name: o_orderkey, path: o_orderkey}
    - {name: state, expr: {func: enum_name, args: [{path: state}]}}
"""
    t = Transcoder.from_config_string(plan, sources={"order.proto": text})
    state = F.when(F.col("o_orderstatus") == "F", 5).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    return t.denorm(t.encode(table(spark, d, "orders").select(F.struct("o_orderkey", state.alias("state")).alias("msg"))))


# ---- configurations and transcoders

_YAML = """
proto: {file: order.proto, message: Order}
denormalizer:
  columns:
    - {name: okey, path: o_orderkey}
    - {name: part, path: "items[*].l_partkey"}
    - {name: tag, expr: {func: concat, sep: "-", args: [{path: "items[*].l_returnflag"}, {path: "items[*].l_linenumber"}]}}
    - {name: double, expr: {func: mul, args: [{path: "items[*].l_quantity"}, {expr: {func: add, args: [{literal: 1}, {literal: 1}]}}]}}
    - {name: size, expr: {func: cond, args: [{expr: {func: ge, args: [{path: "items[*].l_quantity"}, {literal: 25}]}}, {literal: large}, {literal: small}]}}
"""


def _transcoder(**options) -> Transcoder:
    return Transcoder.from_config_string(_YAML, sources={"order.proto": ORDER_PROTO}, **options)


_YAML_SQL = f"SELECT o_orderkey AS okey, l_partkey AS part, l_returnflag || '-' || l_linenumber AS tag, l_quantity * 2 AS double, CASE WHEN l_orderkey IS NULL THEN NULL WHEN l_quantity >= 25 THEN 'large' ELSE 'small' END AS size {_LEFT}"


@_query(_YAML_SQL)
def plan_yaml(spark: SparkSession, d: str) -> DataFrame:
    """A transcoder from a YAML plan, over raw messages."""
    return _transcoder().denorm(_encoded(spark, d))


@_query(_YAML_SQL)
def plan_yaml_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The plan of a YAML text over nested rows that are there already."""
    nested = orders_nested(spark, d, _ITEM)
    return parse_config(_YAML).plan(nested.schema).apply(nested)


@_query(f"SELECT o_orderkey, o_custkey, l_linenumber AS items_l_linenumber, l_partkey AS items_l_partkey, l_quantity AS items_l_quantity, l_returnflag AS items_l_returnflag, o_orderstatus {_LEFT}")
def plan_skeleton(spark: SparkSession, d: str) -> DataFrame:
    """The starter plan of a message, run as it is."""
    order, _ = _types()
    return parse_config(skeleton(order.schema, "order.proto", "Order")).plan(order.schema).apply(order.decode(_encoded(spark, d), "payload").select("msg.*"))


@_query("SELECT o_orderkey, list_transform(list_filter(items, lambda x: x.l_quantity > 25), lambda x: x.l_partkey) AS out FROM (WITH " + ORDERS + " SELECT * FROM n)")
def api_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """A transcoder's pipeline over raw messages."""
    kept = _encoded(spark, d)
    flat = _transcoder().decode(kept).select(F.col("msg.o_orderkey").alias("o_orderkey"), "msg")
    from ..pipeline.run import pipeline

    return pipeline(flat, ".items[] | select(.l_quantity > 25) | .l_partkey", ["o_orderkey"], "msg")


@_query("SELECT * FROM (VALUES ('field', 'items', 'array'), ('field', 'o_custkey', 'bigint'), ('field', 'o_orderkey', 'bigint'), ('field', 'o_orderstatus', 'string'), ('flat', 'double', 'double'), ('flat', 'okey', 'bigint'), ('flat', 'part', 'bigint'), ('flat', 'size', 'string'), ('flat', 'tag', 'string')) AS t(part, name, kind)")
def api_schemas(spark: SparkSession, d: str) -> DataFrame:
    """The nested and flat shapes that a transcoder reports before it has seen data."""
    t = _transcoder()
    rows = [("field", n, t.schema[n].dataType.simpleString().partition("<")[0]) for n in t.field_names] + [("flat", f.name, f.dataType.simpleString()) for f in t.denorm_schema(spark).fields]
    return spark.createDataFrame(rows, "part string, name string, kind string")


@_query("SELECT * FROM (VALUES ('cycle', 'CyclicTypeError'), ('depth', 'MaxDepthError'), ('two customs', 'ExclusiveOptionsError'), ('no field', 'PathNotFoundError'), ('changed', 'FingerprintMismatchError'), ('unknown key', 'PlanError'), ('message leaf', 'PlanError')) AS t(what, error)")
def api_errors(spark: SparkSession, d: str) -> DataFrame:
    """The error that each wrong use ends in, before any job runs."""
    order, extra = _types()
    loop = p.parse_proto('syntax = "proto3"; message Loop { Loop next = 1; }')
    deep = p.parse_proto('syntax = "proto3"; ' + "".join(f"message M{i} {{ M{i + 1} m = 1; }} " for i in range(12)) + "message M12 { int32 x = 1; }")
    uses: dict[str, Callable] = {
        "cycle": lambda: p.struct_type(loop, loop.lookup("Loop")),
        "depth": lambda: p.struct_type(deep, deep.lookup("M0")),
        "two customs": lambda: Transcoder(order.reg, order.message, custom=extra, custom_file=("x.proto", "X")),
        "no field": lambda: p.field_at(order.schema, ["items", "no"]),
        "changed": lambda: p.check_fingerprint(extra.reg, extra.message, p.fingerprint(order.reg, order.message)),
        "unknown key": lambda: parse_config(_YAML + "\nextra: 1\n"),
        "message leaf": lambda: DenormPlan(order.schema, columns("items[*]")),
    }
    rows = []
    for what, use in uses.items():
        try:
            use()
            rows.append((what, "none"))
        except Exception as e:
            rows.append((what, type(e).__name__))
    return spark.createDataFrame(rows, "what string, error string")


# ---- paths and accessors

def _orders(select: Callable[[DataFrame], list]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = orders_nested(spark, d)
        return df.select("o_orderkey", *select(df))

    return run


def _branches(df: DataFrame, text: str, name: str | None = None):
    return compile_path(df.schema, parse_path(text), name=name)


QUERIES["path_root"] = _orders(lambda df: [_branches(df, "(shop.Order).items[*].l_partkey", "Order").value.col.alias("v")])
ORACLES["path_root"] = f"WITH {ORDERS} SELECT o_orderkey, list_transform(items, lambda x: x.l_partkey) AS v FROM n"
QUERIES["path_clamped"] = _orders(lambda df: [F.coalesce(_branches(df, t).clamped, F.lit(False)).alias(n) for n, t in (("two", "items[0:2].l_partkey"), ("every", "items[::2].l_partkey"))])
ORACLES["path_clamped"] = f"WITH {ORDERS} SELECT o_orderkey, len(items) < 2 AS two, false AS every FROM n"


def _strict(spark: SparkSession, d: str) -> DataFrame:
    df = orders_nested(spark, d)
    kept = df.filter(~F.coalesce(_branches(df, "items[0:2].l_partkey").clamped, F.lit(False)))
    flat = denorm(kept, "o_orderkey", dn.Col("part", "items[0:2].l_partkey", strict=True))
    whole = kept.select("o_orderkey", path_value(_branches(kept, "items[1].l_suppkey"), strict=True).alias("second"))
    return flat.join(whole, "o_orderkey")


QUERIES["path_strict"] = _strict
ORACLES["path_strict"] = f"WITH {ORDERS} SELECT o_orderkey, x.l_partkey AS part, [items[2].l_suppkey] AS second FROM n, unnest(n.items[1:2]) AS t(x) WHERE len(items) >= 2"


def _prefixes(spark: SparkSession, d: str) -> DataFrame:
    df = customers_nested(spark, d)
    path = parse_path("orders[*].items[0:1].l_partkey")
    at = {k: compile_path(df.schema, prefix(path, k)).array for k in (0, 1, -1, -2)}
    return df.select("c_custkey", F.size(F.flatten(at[0])).alias("n_orders"), F.transform(at[1], lambda o: o["o_orderkey"]).alias("keys"), at[-1].alias("parts"), F.size(at[-2]).alias("n_items"), F.lit(format_path(path)).alias("text"))


QUERIES["path_along"] = _prefixes
ORACLES["path_along"] = f"WITH {CUSTOMERS} SELECT c_custkey, CAST(len(orders) AS INTEGER) AS n_orders, list_transform(orders, lambda o: o.o_orderkey) AS keys, flatten(list_transform(orders, lambda o: list_transform(o.items[1:1], lambda i: i.l_partkey))) AS parts, CAST(len(flatten(list_transform(orders, lambda o: o.items[1:1]))) AS INTEGER) AS n_items, 'orders[*].items[0:1].l_partkey' AS text FROM c"


@_query(f"WITH {ORDERS} SELECT [o_orderkey] AS key, list_transform(items, lambda x: x.l_partkey) AS parts, list_transform(items[1:2], lambda x: x.l_quantity) AS first FROM n")
def query_many(spark: SparkSession, d: str) -> DataFrame:
    """Several paths in one go, an array each."""
    return query(orders_nested(spark, d), key="o_orderkey", parts="items[*].l_partkey", first="items[0:2].l_quantity")


@_query("SELECT * FROM (VALUES ('o_orderkey', 'bigint'), ('part', 'bigint'), ('net', 'double'), ('day', 'timestamp_ntz')) AS t(name, kind)")
def plan_entries(spark: SparkSession, d: str) -> DataFrame:
    """Names and kinds of a plan's columns."""
    df = orders_nested(spark, d)
    plan = DenormPlan(df.schema, columns("o_orderkey", part="items[*].l_partkey", net=call("mul", "items[*].l_extendedprice", Lit(0.9)), day="items[*].l_shipdate"))
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in plan.output_schema(df).fields], "name string, kind string")


def _accessors(spark: SparkSession, d: str) -> DataFrame:
    df = orders_nested(spark, d)
    b = {n: (x.array, x.element) for n, t in (("k", "items[*].l_partkey"), ("q", "items[*].l_quantity"), ("f", "items[*].l_returnflag"), ("m", "items[*]")) for x in [_branches(df, t)]}
    negative = F.transform(b["k"][0], lambda x: x - 100)
    return df.select(
        "o_orderkey", dn.all_floats(*b["k"]).alias("floats"), dn.all_bools(*b["q"]).alias("bools"), F.transform(dn.all_uints(negative, b["k"][1]), lambda x: x.cast("string")).alias("uints"), dn.first_uint(negative, b["k"][1]).cast("string").alias("uint"), F.transform(dn.all_bytes(*b["f"]), lambda x: F.hex(x)).alias("bytes"), F.hex(dn.first_bytes(*b["f"])).alias("byte"),
        F.transform(dn.all_messages(*b["m"]), lambda m: m["l_suppkey"]).alias("supps"), dn.first_message(*b["m"])["l_suppkey"].alias("supp"),
    )


QUERIES["path_accessors_many"] = _accessors
ORACLES["path_accessors_many"] = f"WITH {ORDERS} SELECT o_orderkey, list_transform(items, lambda x: CAST(x.l_partkey AS DOUBLE)) AS floats, list_transform(items, lambda x: x.l_quantity <> 0) AS bools, list_transform(list_filter(items, lambda x: x.l_partkey >= 100), lambda x: CAST(x.l_partkey - 100 AS VARCHAR)) AS uints, CASE WHEN items[1].l_partkey >= 100 THEN CAST(items[1].l_partkey - 100 AS VARCHAR) ELSE '0' END AS uint, list_transform(items, lambda x: hex(encode(x.l_returnflag))) AS bytes, hex(encode(items[1].l_returnflag)) AS byte, list_transform(items, lambda x: x.l_suppkey) AS supps, items[1].l_suppkey AS supp FROM n"


@_query("SELECT o_orderkey, NULL AS nothing, true AS yes, 7 AS whole, 2.5::DOUBLE AS real, 'x' || o_orderstatus AS text FROM orders")
def value_literals(spark: SparkSession, d: str) -> DataFrame:
    """Constant values of every simple kind beside a record's."""
    one = {"yes": literal(True).col, "whole": literal(7).col.cast("int"), "real": literal(2.5).col, "text": F.concat(literal("x").col, "o_orderstatus")}
    return table(spark, d, "orders").select("o_orderkey", literal(None).col.cast("int").alias("nothing"), *(c.alias(n) for n, c in one.items()))


# ---- expressions and time formats

_P, _L = "items[*].l_extendedprice", "items[*].l_linenumber"
for _name, _sql in (("div", "l_extendedprice / (l_linenumber - 1)"), ("mod", "l_extendedprice % (l_linenumber - 1)")):
    QUERIES[f"expr_{_name}_float"] = lambda s, d, f=_name: denorm(orders_nested(s, d), "o_orderkey", part="items[*].l_partkey", value=call(f, _P, call("cast_float", call("sub", _L, Lit(1)))))
    ORACLES[f"expr_{_name}_float"] = f"SELECT o_orderkey, l_partkey AS part, CASE WHEN l_orderkey IS NULL THEN NULL WHEN l_linenumber = 1 THEN 0.0 ELSE {_sql} END AS value {_LEFT}"

_SECOND = "epoch_ms(date_trunc('second', l_shipdate))"
_DAY = "epoch_ms(CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP))"
#: name -> (pattern that writes the time, format that reads it, SQL of the milliseconds)
FORMATS: dict[str, tuple[str, str, str]] = {
    "iso": ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", _SECOND),
    "fraction": ("yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f", "epoch_ms(l_shipdate)"),
    "month_name": ("dd MMMM yyyy", "%d %B %Y", _DAY),
    "short_name": ("EEE, dd MMM yyyy HH:mm", "%a, %d %b %Y %H:%M", "epoch_ms(date_trunc('minute', l_shipdate))"),
    "day_of_year": ("yyyy DDD", "%Y %j", _DAY),
    "two_digit_year": ("yy/MM/dd", "%y/%m/%d", "epoch_ms(make_timestamp(2000 + year(l_shipdate) % 100, month(l_shipdate), day(l_shipdate), 0, 0, 0))"),
    "half_day": ("yyyy-MM-dd hh:mm:ss a", "%Y-%m-%d %I:%M:%S %p", _SECOND),
    "zone": ("yyyy-MM-dd HH:mm:ss '+02:00'", "%Y-%m-%d %H:%M:%S %z", f"{_SECOND} - 7200000"),
    "percent": ("yyyy'%'MM'%'dd", "%Y%%%m%%%d", _DAY),
    "spaces": ("yyyy  MM   dd", "%Y%n%m%t%d", _DAY),
    "loose": ("yyyy-M-d H:m:s", "%Y-%-m-%-d %-H:%-M:%-S", _SECOND),
    "layout": ("yyyy-MM-dd HH:mm:ss", "2006-01-02 15:04:05", _SECOND),
    "layout_names": ("d MMM yyyy", "2 Jan 2006", _DAY),
    "trailing": ("yyyy-MM-dd'x'", "%Y-%m-%d", "0"),
    "wrong": ("MM-dd", "%Y-%m-%d", "0"),
}


def _time_format(name: str) -> Callable[[SparkSession, str], DataFrame]:
    write, read, _ = FORMATS[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        orders = table(spark, d, "orders").select("o_orderkey")
        nested = nest(orders, "o_orderkey", table(spark, d, "lineitem"), "l_orderkey", F.struct("l_linenumber", F.date_format("l_shipdate", write).alias("text")), "items")
        return denorm(nested, "o_orderkey", line=_L, ms=call("try_strptime", "items[*].text", sep=read))

    return run


for _name, (_, _, _sql) in FORMATS.items():
    QUERIES[f"strptime_{_name}"] = _time_format(_name)
    ORACLES[f"strptime_{_name}"] = f"SELECT o_orderkey, l_linenumber AS line, CASE WHEN l_orderkey IS NOT NULL THEN {_sql} END AS ms {_LEFT}"


# ---- files, batches and streams

@_query("SELECT o_orderkey, o_custkey FROM orders")
def io_framed(spark: SparkSession, d: str) -> DataFrame:
    """Messages written to framed files and read back in parts."""
    order, _ = _types()
    path = scratch(spark, "framed")
    write_framed(_encoded(spark, d), "payload", path)
    return order.decode(read_framed(spark, path).select("payload"), "payload").select("msg.o_orderkey", "msg.o_custkey")


@_query("SELECT n_nationkey, n_name FROM nation")
def io_to_table(spark: SparkSession, d: str) -> DataFrame:
    """A result as one Arrow table on the driver, as its callers ask for it, and back."""
    return spark.createDataFrame(to_table(table(spark, d, "nation").select("n_nationkey", "n_name")))


@_query("SELECT CAST(i // 7 AS INTEGER) AS batch, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) GROUP BY ALL")
def io_batches(spark: SparkSession, d: str) -> DataFrame:
    """A result as an iterator of batches of at most 7 rows."""
    parts = iter_batches(table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey"), 7)
    return spark.createDataFrame([(i, b.num_rows, sum(b.column(0).to_pylist())) for i, b in enumerate(parts)], "batch int, n bigint, keys bigint")


@_query("SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT l_orderkey, NULL FROM lineitem")
def io_concat(spark: SparkSession, d: str) -> DataFrame:
    """Results of different columns, one behind the other."""
    return concat([table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))])


@_query("SELECT count(*) AS n, CAST(true AS BOOLEAN) AS due FROM lineitem")
def io_observed(spark: SparkSession, d: str) -> DataFrame:
    """The number of records that ran through a plan, counted beside it, and whether a threshold was passed."""
    df, count = observed(table(spark, d, "lineitem").select("l_orderkey"), threshold=100)
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([count()], "n bigint, due boolean")


@_query("SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 'again' FROM orders")
def io_append(spark: SparkSession, d: str) -> DataFrame:
    """Several batches written to one place; every file and row group is read back."""
    path = scratch(spark, "batches")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    write_parquet(orders, path)
    write_parquet(orders.withColumn("o_orderstatus", F.lit("again")), path, "append")
    return read_parquet(spark, path)


@_query("SELECT event_id, [CAST(CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS VARCHAR), '\"' || CAST(json_extract(props, '$.k') AS BIGINT) || '!\"'] AS out FROM events")
def pipe_json_text(spark: SparkSession, d: str) -> DataFrame:
    """A pipeline over a column of JSON texts."""
    return interpret_json(table(spark, d, "events"), r'.k + 1, "\(.k)!"', "props", ["event_id"])


@_query(_YAML_SQL)
def stream_wire(spark: SparkSession, d: str) -> DataFrame:
    """Raw messages as a stream: decoded, flattened by the YAML plan and flushed in bounded batches."""
    at = scratch(spark, "messages")
    _encoded(spark, d).write.parquet(f"{at}/in")
    flat = _transcoder().denorm(spark.readStream.schema("payload binary").option("maxFilesPerTrigger", 4).parquet(f"{at}/in"))
    run_available(flat, lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}"), f"{at}/checkpoint")
    return spark.read.schema(flat.schema).parquet(f"{at}/out").drop("batch")
