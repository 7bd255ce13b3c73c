"""Queries of paths, fan-out and expressions, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import Lit, call
from ..path.compile import compile_path, list_indices
from ..path.syntax import parse_path
from ..plans import denorm as dn
from ..plans.denorm import Col, columns, denorm
from ..runtime import table
from ..sources.nested import ITEM, customers_nested, events_by_user, orders_nested

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_STRUCT = "{" + ", ".join(f"'{c}': {c}" for c in ITEM) + "}"
ORDERS = f"""n AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
  coalesce(list_sort(list({_STRUCT}) FILTER (WHERE l_orderkey IS NOT NULL)), []) AS items
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""
CUSTOMERS = """s AS (SELECT o_orderkey, o_custkey, o_totalprice, coalesce(list_sort(list({'l_partkey': l_partkey, 'l_quantity': l_quantity}) FILTER (WHERE l_orderkey IS NOT NULL)), []) AS items
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
c AS (SELECT c_custkey, c_name, c_mktsegment, coalesce(list_sort(list({'o_orderkey': o_orderkey, 'o_totalprice': o_totalprice, 'items': items}) FILTER (WHERE o_orderkey IS NOT NULL)), []) AS orders
  FROM customer LEFT JOIN s ON c_custkey = o_custkey GROUP BY ALL)"""
USERS = """u AS (SELECT user_id, list_sort(list({'event_id': event_id, 'event_type': event_type, 'value': value, 'k': CAST(json_extract(props, '$.k') AS BIGINT)})) AS events FROM events GROUP BY user_id)"""


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _paths(name: str, sql: str, source: Callable = orders_nested, with_: str = ORDERS, frm: str = "n", key: str = "o_orderkey", **paths: str) -> None:
    """A query of branch arrays and its SQL over the nested table."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = source(spark, d)
        cols = {n: compile_path(df.schema, parse_path(p)) for n, p in paths.items()}
        return df.select(key, *(b.value.col.alias(n) for n, b in cols.items()))

    _add(name, run, f"WITH {with_} SELECT {key}, {sql} FROM {frm}")


_paths("path_field", "o_totalprice AS v", v="o_totalprice")
_paths("path_wildcard", "list_transform(items, lambda x: x.l_partkey) AS v", v="items[*].l_partkey")
_paths("path_index", "CASE WHEN len(items) > 1 THEN [items[2].l_partkey] ELSE [] END AS v", v="items[1].l_partkey")
_paths("path_negative_index", "CASE WHEN len(items) > 1 THEN [items[-2].l_partkey] ELSE [] END AS v", v="items[-2].l_partkey")
_paths("path_slice", "list_transform(items[2:3], lambda x: x.l_partkey) AS v", v="items[1:3].l_partkey")
_paths("path_open_slice", "list_transform(items[3:], lambda x: x.l_quantity) AS v", v="items[2:].l_quantity")
_paths("path_strided_slice", "list_transform(list_filter(items, lambda x, i: i % 2 = 1), lambda x: x.l_partkey) AS v", v="items[::2].l_partkey")
_paths("path_reversed_slice", "list_transform(list_reverse(items), lambda x: x.l_partkey) AS v", v="items[::-1].l_partkey")
_paths("path_filter", "list_transform(list_filter(items, lambda x: x.l_quantity > 25 AND x.l_returnflag = 'R'), lambda x: x.l_partkey) AS v", v='items[?(.l_quantity > 25 && .l_returnflag == "R")].l_partkey')
_paths("path_filter_or_not", "list_transform(list_filter(items, lambda x: x.l_discount < 0.02 OR NOT x.l_linestatus = 'O'), lambda x: x.l_suppkey) AS v", v='items[?(.l_discount < 0.02 || !(.l_linestatus == "O"))].l_suppkey')
_paths("path_filter_truthy", "list_transform(list_filter(items, lambda x: x.l_tax <> 0), lambda x: x.l_suppkey) AS v", v="items[?(.l_tax)].l_suppkey")
_paths("path_nested_wildcard", "flatten(list_transform(orders, lambda o: list_transform(o.items, lambda i: i.l_partkey))) AS v", customers_nested, CUSTOMERS, "c", "c_custkey", v="orders[*].items[*].l_partkey")
_paths("path_nested_index", "flatten(list_transform(orders, lambda o: CASE WHEN len(o.items) > 0 THEN [o.items[1].l_quantity] ELSE [] END)) AS v", customers_nested, CUSTOMERS, "c", "c_custkey", v="orders[*].items[0].l_quantity")
_paths("path_wildcard_slice", "flatten(list_transform(orders[1:2], lambda o: list_transform(o.items[-1:], lambda i: i.l_quantity))) AS v", customers_nested, CUSTOMERS, "c", "c_custkey", v="orders[0:2].items[-1:].l_quantity")
_paths("path_list_element", "embedding[4] AS v0, embedding[-1] AS v1", lambda s, d: table(s, d, "embeddings").select("vec_id", F.get("embedding", F.lit(3)).alias("v0"), F.element_at("embedding", -1).alias("v1")), "e AS (SELECT * FROM embeddings)", "e", "vec_id", v0="v0", v1="v1")
_paths("path_list_slice", "embedding[1:4] AS v", lambda s, d: table(s, d, "embeddings"), "e AS (SELECT * FROM embeddings)", "e", "vec_id", v="embedding[0:4]")


def _map_key(spark: SparkSession, d: str) -> DataFrame:
    df = events_by_user(spark, d)
    return df.select("user_id", compile_path(df.schema, parse_path('counts["view"]')).value.col.alias("v"), compile_path(df.schema, parse_path("counts[*]")).value.col.alias("every"))


_add(
    "path_map",
    _map_key,
    """WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, coalesce(list(n) FILTER (WHERE event_type = 'view'), []) AS v, list(n ORDER BY event_type) AS "every" FROM k GROUP BY user_id""",
)


def _indices(spark: SparkSession, d: str) -> DataFrame:
    df = customers_nested(spark, d)
    at = df.select("c_custkey", F.explode(list_indices(df.schema, parse_path("orders[*].items[0:2].l_partkey"))).alias("b"))
    return at.select("c_custkey", F.col("b.indices")[0].cast("bigint").alias("i"), F.col("b.indices")[1].cast("bigint").alias("j"), F.col("b.value").alias("v"))


_add("path_list_indices", _indices, f"WITH {CUSTOMERS}, o AS (SELECT c_custkey, unnest(orders) AS o, generate_subscripts(orders, 1) - 1 AS i FROM c), j AS (SELECT c_custkey, i, unnest(o.items) AS x, generate_subscripts(o.items, 1) - 1 AS j FROM o) SELECT c_custkey, i, j, x.l_partkey AS v FROM j WHERE j < 2")


def _accessors(spark: SparkSession, d: str) -> DataFrame:
    df = orders_nested(spark, d)
    b = {n: compile_path(df.schema, parse_path(p)) for n, p in (("k", "items[*].l_partkey"), ("q", "items[*].l_quantity"), ("f", "items[*].l_returnflag"))}
    a = {n: (x.array, x.element) for n, x in b.items()}
    return df.select("o_orderkey", dn.first_int(*a["k"]).alias("first_key"), dn.first_float(*a["q"]).alias("first_quantity"), dn.first_string(*a["f"]).alias("first_flag"), dn.first_bool(*a["q"]).alias("any_quantity"), dn.all_ints(*a["k"]).alias("every_key"), dn.all_strings(*a["f"]).alias("every_flag"))


_add("path_accessors", _accessors, f"WITH {ORDERS} SELECT o_orderkey, coalesce(items[1].l_partkey, 0) AS first_key, coalesce(items[1].l_quantity, 0.0) AS first_quantity, coalesce(items[1].l_returnflag, '') AS first_flag, coalesce(items[1].l_quantity <> 0, false) AS any_quantity, list_transform(items, lambda x: x.l_partkey) AS every_key, list_transform(items, lambda x: x.l_returnflag) AS every_flag FROM n")

# ---- fan-out


def _denorm(name: str, sql: str, *specs, source: Callable = orders_nested, **named) -> None:
    options = {k: named.pop(k) for k in ("correlated", "broadcast") if k in named}
    _add(name, lambda s, d: denorm(source(s, d), *specs, **options, **named), sql)


_LEFT = "FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey"
_denorm("denorm_wildcard", f"SELECT o_orderkey, l_partkey, l_quantity {_LEFT}", "o_orderkey", "items[*].l_partkey", "items[*].l_quantity")
_denorm("denorm_index_broadcast", f"WITH {ORDERS} SELECT o_orderkey, items[1].l_partkey AS first, x.l_suppkey FROM n LEFT JOIN unnest(n.items) AS t(x) ON true", "o_orderkey", "items[*].l_suppkey", first="items[0].l_partkey")
_denorm("denorm_slice", f"WITH {ORDERS} SELECT o_orderkey, x.l_partkey FROM n LEFT JOIN unnest(n.items[1:2]) AS t(x) ON true", "o_orderkey", "items[0:2].l_partkey")
_denorm(
    "denorm_cross_groups",
    f"WITH {ORDERS} SELECT o_orderkey, x.l_partkey AS part, y.l_suppkey AS supp FROM n LEFT JOIN unnest(n.items) AS t(x) ON true LEFT JOIN unnest(n.items[1:2]) AS v(y) ON true",
    "o_orderkey",
    part="items[*].l_partkey",
    supp="items[0:2].l_suppkey",
)
_denorm(
    "denorm_nested_crossed",
    f"WITH {CUSTOMERS} SELECT c_custkey, o.o_orderkey AS ok, i AS part FROM c LEFT JOIN unnest(orders) AS t(o) ON true LEFT JOIN unnest(flatten(list_transform(orders, lambda o: list_transform(o.items, lambda i: i.l_partkey)))) AS v(i) ON true",
    "c_custkey",
    source=customers_nested,
    ok="orders[*].o_orderkey",
    part="orders[*].items[*].l_partkey",
)
_denorm(
    "denorm_nested_correlated",
    "SELECT c_custkey, o_orderkey AS ok, l_partkey AS part FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey",
    "c_custkey",
    source=customers_nested,
    correlated=True,
    ok="orders[*].o_orderkey",
    part="orders[*].items[*].l_partkey",
)
_denorm("denorm_filter", f"WITH {ORDERS} SELECT o_orderkey, CASE WHEN len(l) > 0 THEN l[1].l_partkey END AS part FROM (SELECT o_orderkey, list_filter(items, lambda x: x.l_quantity > 30) AS l FROM n)", "o_orderkey", part="items[?(.l_quantity > 30)].l_partkey")
_denorm("denorm_filter_rows", f"WITH {ORDERS} SELECT x.l_partkey AS part FROM n LEFT JOIN unnest(list_filter(n.items, lambda x: x.l_quantity > 30)) AS t(x) ON true", part="items[?(.l_quantity > 30)].l_partkey")
_denorm("denorm_expression", f"SELECT o_orderkey, l_partkey AS part, l_extendedprice * (1.0 - l_discount) AS net {_LEFT}", "o_orderkey", part="items[*].l_partkey", net=call("mul", "items[*].l_extendedprice", call("sub", Lit(1.0), "items[*].l_discount")))
_LATERAL = "FROM (SELECT * FROM n LEFT JOIN LATERAL (SELECT unnest(n.items) AS x, generate_subscripts(n.items, 1) AS i) ON true)"
_denorm("denorm_expression_scalar_group", f"WITH {ORDERS} SELECT o_orderkey, x.l_partkey AS part, o_orderstatus || '-' || coalesce(items[1].l_returnflag, '') AS tag {_LATERAL}", "o_orderkey", part="items[*].l_partkey", tag=call("concat", "o_orderstatus", "items[*].l_returnflag", sep="-"))
_denorm("denorm_expression_first_branch", f"WITH {ORDERS} SELECT o_orderkey, x.l_partkey AS part, x.l_returnflag || '-' || CASE WHEN i = 1 THEN o_orderstatus ELSE '' END AS tag {_LATERAL}", "o_orderkey", part="items[*].l_partkey", tag=call("concat", "items[*].l_returnflag", "o_orderstatus", sep="-"))
_denorm("denorm_expression_broadcast", f"SELECT o_orderkey, l_partkey AS part, l_returnflag || '-' || CASE WHEN l_orderkey IS NOT NULL THEN o_orderstatus END AS tag {_LEFT}", "o_orderkey", broadcast=True, part="items[*].l_partkey", tag=call("concat", "items[*].l_returnflag", "o_orderstatus", sep="-"))
_denorm("denorm_map_wildcard", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id, event_type", "user_id", source=events_by_user, n="counts[*]")
_denorm("denorm_aggregates", f"WITH {ORDERS} SELECT o_orderkey, x.l_partkey AS part, list_sum(list_transform(items, lambda y: y.l_quantity)) AS total, CASE WHEN len(items) > 0 THEN CAST(len(list_distinct(list_transform(items, lambda y: y.l_returnflag))) AS BIGINT) END AS flags FROM n LEFT JOIN unnest(n.items) AS t(x) ON true", "o_orderkey", part="items[*].l_partkey", total=call("sum", "items[*].l_quantity"), flags=call("distinct", "items[*].l_returnflag"))


def _bids(spark: SparkSession, d: str) -> DataFrame:
    return denorm(table(spark, d, "bid_requests"), Col("rec_id", "rec_id"), *columns(request="msg.id", ifa="msg.device.ifa", country="msg.device.geo.country", imp_id="msg.imp[*].id", floor_units="msg.imp[*].bidfloor.units", cur="msg.imp[*].bidfloorcur", kind=call("cond", call("gt", "msg.imp[*].video.w", Lit(0)), Lit("video"), Lit("display"))))


_add("denorm_bid_requests", _bids, "SELECT rec_id, msg.id AS request, msg.device.ifa AS ifa, msg.device.geo.country AS country, x.id AS imp_id, x.bidfloor.units AS floor_units, x.bidfloorcur AS cur, CASE WHEN i IS NULL THEN NULL WHEN x.video.w > 0 THEN 'video' ELSE 'display' END AS kind FROM bid_requests b LEFT JOIN LATERAL (SELECT unnest(b.msg.imp) AS x, generate_subscripts(b.msg.imp, 1) AS i) ON true")
_add(
    "denorm_bid_deals",
    lambda s, d: denorm(table(s, d, "bid_requests"), "rec_id", correlated=True, imp_id="msg.imp[*].id", deal="msg.imp[*].pmp.deals[*].id", at="msg.imp[*].pmp.deals[*].at"),
    "SELECT rec_id, x.id AS imp_id, y.id AS deal, y.at AS at FROM bid_requests LEFT JOIN unnest(msg.imp) AS t(x) ON true LEFT JOIN unnest(x.pmp.deals) AS v(y) ON true",
)

# ---- expressions over items[*]: the first column is a path, so rows of empty orders are null

Q, P, D, K, S, FLAG, STATUS, LINE, DAY = (f"items[*].{c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_shipdate"))
_MS = "epoch_ms(l_shipdate)"
#: what prints a float in SQL as expressions print it
_TEXT = "CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"
shipped = call("sub", call("age", DAY, Lit(0)), Lit(0))
EXPRESSIONS: dict[str, tuple[object, str]] = {
    "coalesce": (call("coalesce", call("sub", LINE, Lit(1)), K), "coalesce(nullif(l_linenumber - 1, 0), nullif(l_partkey, 0))"),
    "default": (call("default", call("select", call("gt", Q, Lit(25)), FLAG), literal="none"), "CASE WHEN l_quantity > 25 THEN l_returnflag ELSE 'none' END"),
    "cond": (call("cond", call("ge", D, Lit(0.05)), Lit("deep"), Lit("flat")), "CASE WHEN l_discount >= 0.05 THEN 'deep' ELSE 'flat' END"),
    "has": (call("has", D), "l_discount <> 0"),
    "len": (call("len", FLAG), "strlen(l_returnflag)"),
    "add": (call("add", K, S), "l_partkey + l_suppkey"),
    "sub": (call("sub", P, Q), "l_extendedprice - l_quantity"),
    "mul": (call("mul", Q, P), "l_quantity * l_extendedprice"),
    "div": (call("div", K, call("sub", LINE, Lit(1))), "CASE WHEN l_linenumber = 1 THEN 0 ELSE l_partkey // (l_linenumber - 1) END"),
    "mod": (call("mod", K, call("sub", LINE, Lit(1))), "CASE WHEN l_linenumber = 1 THEN 0 ELSE l_partkey % (l_linenumber - 1) END"),
    "concat": (call("concat", FLAG, K, LINE, sep="/"), "concat_ws('/', l_returnflag, l_partkey, l_linenumber)"),
    "eq": (call("eq", FLAG, Lit("R")), "l_returnflag = 'R'"),
    "ne": (call("ne", FLAG, Lit("R")), "l_returnflag <> 'R'"),
    "lt": (call("lt", Q, LINE), "l_quantity < l_linenumber"),
    "le": (call("le", D, Lit(0.03)), "l_discount <= 0.03"),
    "gt": (call("gt", K, S), "l_partkey > l_suppkey"),
    "ge": (call("ge", LINE, Lit(3)), "l_linenumber >= 3"),
    "upper": (call("upper", call("lower", FLAG)), "upper(lower(l_returnflag))"),
    "lower": (call("lower", FLAG), "lower(l_returnflag)"),
    "trim": (call("trim", call("concat", Lit(" \t"), FLAG, Lit("\n "))), "l_returnflag"),
    "trim_prefix": (call("trim_prefix", call("concat", Lit("p-"), FLAG), sep="p-"), "l_returnflag"),
    "trim_suffix": (call("trim_suffix", call("concat", FLAG, Lit("-s")), sep="-s"), "l_returnflag"),
    "abs": (call("abs", call("sub", S, K)), "abs(l_suppkey - l_partkey)"),
    "ceil": (call("ceil", P), "ceil(l_extendedprice)"),
    "floor": (call("floor", P), "floor(l_extendedprice)"),
    "round": (call("round", call("div", Q, Lit(2.0))), "round_even(l_quantity / 2, 0)"),
    "min": (call("min", K, Q), "least(CAST(l_partkey AS DOUBLE), l_quantity)"),
    "max": (call("max", K, S), "greatest(l_partkey, l_suppkey)"),
    "cast_int": (call("cast_int", P), "CAST(trunc(l_extendedprice) AS BIGINT)"),
    "cast_float": (call("cast_float", call("cast_string", K)), "CAST(l_partkey AS DOUBLE)"),
    "cast_string": (call("cast_string", Q), _TEXT.format(x="l_quantity")),
    "strptime": (call("strptime", call("concat", Lit("2020-02-"), call("add", LINE, Lit(10))), sep="%Y-%m-%d"), "epoch_ms(make_timestamp(2020, 2, l_linenumber + 10, 0, 0, 0))"),
    "try_strptime": (call("try_strptime", FLAG, sep="%Y"), "0"),
    "age": (call("age", DAY, Lit(1000)), f"{_MS} - 1000"),
    "extract_year": (call("extract_year", shipped), "year(l_shipdate)"),
    "extract_month": (call("extract_month", shipped), "month(l_shipdate)"),
    "extract_day": (call("extract_day", shipped), "day(l_shipdate)"),
    "extract_hour": (call("extract_hour", shipped), "hour(l_shipdate)"),
    "extract_minute": (call("extract_minute", shipped), "minute(l_shipdate)"),
    "extract_second": (call("extract_second", shipped), "second(l_shipdate)"),
    "epoch_to_date": (call("epoch_to_date", call("div", shipped, Lit(1000))), f"CAST({_MS} // 1000 // 86400 AS INTEGER)"),
    "date_part": (call("date_part", call("div", shipped, Lit(1000)), sep="Month"), "month(l_shipdate)"),
    "bucket": (call("bucket", K, param=50), "l_partkey - l_partkey % 50"),
    "mask": (call("mask", call("concat", FLAG, K), sep="#", param=1), "l_returnflag || repeat('#', CAST(strlen(CAST(l_partkey AS VARCHAR)) AS INTEGER))"),
    "coerce": (call("coerce", call("eq", STATUS, Lit("O")), literal="open", literal2="done"), "CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'done' END"),
    "enum_name": (call("enum_name", LINE, names={1: "ONE", 2: "TWO", 3: "THREE"}), "CASE l_linenumber WHEN 1 THEN 'ONE' WHEN 2 THEN 'TWO' WHEN 3 THEN 'THREE' END"),
    "select": (call("select", call("gt", Q, Lit(25)), K), "CASE WHEN l_quantity > 25 THEN l_partkey END"),
    "and": (call("and", D, call("eq", FLAG, Lit("N"))), "l_discount <> 0 AND l_returnflag = 'N'"),
    "or": (call("or", D, call("eq", FLAG, Lit("N"))), "l_discount <> 0 OR l_returnflag = 'N'"),
    "not": (call("not", D), "l_discount = 0"),
    "literal": (Lit("x"), "'x'"),
}


def _expression(name: str) -> Callable[[SparkSession, str], DataFrame]:
    expr = EXPRESSIONS[name][0]
    value = call("cond", call("has", K), expr, expr) if isinstance(expr, Lit) else expr
    return lambda s, d: denorm(orders_nested(s, d), "o_orderkey", part=K, value=value)


for _name, (_, _sql) in EXPRESSIONS.items():
    _add(f"expr_{_name}", _expression(_name), f"SELECT o_orderkey, l_partkey AS part, CASE WHEN l_orderkey IS NOT NULL THEN {_sql} END AS value {_LEFT}")

_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(t, ''), lambda c: unicode(c)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_add(
    "expr_hash",
    lambda s, d: denorm(orders_nested(s, d), "o_orderkey", value=call("hash", "o_orderstatus", "o_custkey")),
    f"WITH h AS (SELECT o_orderkey, {_FNV} AS h FROM (SELECT o_orderkey, o_orderstatus || o_custkey AS t FROM orders)) SELECT o_orderkey, CAST(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END AS BIGINT) AS value FROM h",
)
for _agg, _e, _sql in (
    ("sum", call("sum", call("mul", Q, P)), "list_sum(list_transform(items, lambda x: x.l_quantity * x.l_extendedprice))"),
    ("distinct", call("distinct", STATUS), "CAST(len(list_distinct(list_transform(items, lambda x: x.l_linestatus))) AS BIGINT)"),
    ("list_concat", call("list_concat", FLAG, sep=","), "array_to_string(list_transform(items, lambda x: x.l_returnflag), ',')"),
):
    _add(f"expr_{_agg}", lambda s, d, e=_e: denorm(orders_nested(s, d), "o_orderkey", value=e), f"WITH {ORDERS} SELECT o_orderkey, {_sql} AS value FROM n LEFT JOIN unnest(n.items) AS t(z) ON true")
