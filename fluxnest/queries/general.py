"""Queries p1, p2, p3, p4 and p6."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, geo, sessions, shred, skew
from ..runtime import materialise, table

GAP_MS = 1_800_000
NEAR_M = 250.0
HOT_SHARE = 0.03


def _entities(spark: SparkSession, d: str) -> DataFrame:
    typed = shred.shred(table(spark, d, "bid_requests"), "msg", shred.BID_REQUEST, ["rec_id"])
    text = shred.shred_json(table(spark, d, "raw_requests"), "payload", shred.BID_REQUEST, "rec_id").drop("obj_json")
    return typed.unionByName(text)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i: F.coalesce(F.get("place", F.lit(i)), F.lit(-1)).cast("bigint")
    return _entities(spark, d).select("rec_id", "entity", at(0).alias("imp_index"), at(1).alias("deal_index"))


def p1_variants(spark: SparkSession, d: str) -> DataFrame:
    """How many objects each structural variant has."""
    return _entities(spark, d).groupBy("entity", "variant").agg(F.count(F.lit(1)).alias("n"))


def _objects(spark: SparkSession, d: str) -> DataFrame:
    """Every object of both sources, each source read once, in folders by entity and variant."""
    spec, bids = shred.BID_REQUEST, table(spark, d, "bid_requests")
    kinds = {e.name: shred.entity_kind(bids.schema["msg"].dataType, spec, e.name) for e in spec.entities}
    typed = shred.shred_objects(bids, "msg", spec, ["rec_id"])
    return materialise(typed.unionByName(shred.shred_json_objects(table(spark, d, "raw_requests"), "payload", spec, "rec_id", kinds)), "objects", by=("entity", "variant"))


def p1_subtypes(spark: SparkSession, d: str) -> DataFrame:
    """The subtype tables of all variants of every entity, from both sources; obj is an object's own fields as JSON, nulls included."""
    objects, parts = _objects(spark, d), []
    for e in shred.BID_REQUEST.entities:
        for t in shred.route(objects, e, ["rec_id"]).values():
            parts.append(t.select("rec_id", F.lit(e.name).alias("entity"), "variant", *_links("imp_index", "deal_index"), F.to_json("obj", {"ignoreNullFields": "false"}).alias("obj")))
    return reduce(DataFrame.unionByName, parts)


def _links(*names: str) -> list:
    """The places that tie an object to its parents; -1 where one doesn't apply."""
    return [F.coalesce(F.get("place", F.lit(i)), F.lit(-1)).cast("bigint").alias(n) for i, n in enumerate(names)]


def _fields(entity: str) -> list:
    """What the typed tables show of an object, after its keys."""
    obj = lambda *names: [F.col(f"obj.{n}") for n in names]
    value = lambda n: geo.decimal_value(F.col(f"obj.{n}")).alias(n)
    return {
        "imp": lambda: [F.col("obj.id").alias("imp_id"), *obj("exp", "bidfloorcur"), F.col("obj.video.minduration").alias("minduration")],
        "deal": lambda: [F.col("obj.id").alias("deal_id"), *obj("at"), value("bidfloor"), F.size(F.coalesce("obj.wseat", F.array())).alias("n_seats")],
        "device": lambda: obj("ifa", "ua", "ip", "w", "h"),
        "geo": lambda: [value("lat"), value("lon"), *obj("type", "country", "region", "city", "dma", "utcoffset")],
        "user": lambda: [F.col("obj.id").alias("user_id")],
        "demographic": lambda: [value("total")],
    }[entity]()


_PLACES = {"imp": ("imp_index",), "deal": ("imp_index", "deal_index")}


def _typed_table(entity: str) -> Callable[[SparkSession, str], DataFrame]:
    """One entity's table from bid_requests alone, which SQL can check."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        t = shred.entity_table(table(spark, d, "bid_requests"), "msg", shred.BID_REQUEST, entity, ["rec_id"])
        return t.select("rec_id", *_links(*_PLACES.get(entity, ())), "variant", *_fields(entity))

    return run


def _whole_table(entity: str) -> Callable[[SparkSession, str], DataFrame]:
    """One entity's table from both sources; nothing is written."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        spec, bids = shred.BID_REQUEST, table(spark, d, "bid_requests")
        kind = shred.entity_kind(bids.schema["msg"].dataType, spec, entity)
        text = shred.shred_json(table(spark, d, "raw_requests"), "payload", spec, "rec_id", {entity: kind})
        read = text.select("rec_id", "variant", "place", F.from_json("obj_json", kind).alias("obj"))
        t = shred.entity_table(bids, "msg", spec, entity, ["rec_id"]).unionByName(read)
        return t.select("rec_id", *_links(*_PLACES.get(entity, ())), "variant", *_fields(entity))

    return run


def p1_bid_variants(spark: SparkSession, d: str) -> DataFrame:
    """How many objects of bid_requests each structural variant has."""
    typed = shred.shred(table(spark, d, "bid_requests"), "msg", shred.BID_REQUEST, ["rec_id"])
    return typed.groupBy("entity", "variant").agg(F.count(F.lit(1)).alias("n"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    points = geo.usable_points(table(spark, d, "geo_points"), "geo_id")
    near = geo.near_pairs(points, NEAR_M).select(F.lit("near").alias("kind"), "a_id", "b_id")
    within = geo.zone_members(points, table(spark, d, "geo_zones")).select(F.lit("zone").alias("kind"), "a_id", F.col("zone_id").alias("b_id"))
    return near.unionByName(within)


def p2_spots(spark: SparkSession, d: str) -> DataFrame:
    """Every usable point with its place and how many others are near, without a row a pair."""
    return geo.near_spots(geo.usable_points(table(spark, d, "geo_points"), "geo_id"), NEAR_M).withColumnRenamed("id", "geo_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    counts = skew.per_key_counts(table(spark, d, "request_log"), ["site_id", "country"], HOT_SHARE)
    return counts.filter("hot").select("field", F.col("value").alias("hot_key"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every site and country, heavy or not, by the same way."""
    return skew.per_key_counts(table(spark, d, "request_log"), ["site_id", "country"], HOT_SHARE)


def p3_site_totals(spark: SparkSession, d: str) -> DataFrame:
    return skew.per_key_totals(table(spark, d, "request_log"), "site_id", "ifa")


def p3_country_totals(spark: SparkSession, d: str) -> DataFrame:
    return skew.per_key_totals(table(spark, d, "request_log"), "country", "user_id")


def p3_publisher_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows a publisher, by a skew-aware join of the log with its sites."""
    log = table(spark, d, "request_log").select("rec_id", "site_id")
    sites = table(spark, d, "sites").select("site_id", F.col("publisher.id").alias("publisher_id"))
    return skew.skew_join(log, sites, "site_id", HOT_SHARE).groupBy("publisher_id").agg(F.count(F.lit(1)).alias("n_rows"))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "request_log").select(sessions.clean_ifa(F.col("ifa")).alias("ifa"), sessions.event_ms(F.col("req_ts")).alias("ms"))
    return sessions.sessionise(log, "ifa", "ms", GAP_MS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select(F.col("device").alias("ifa"), "start_ms", "end_ms")


def p4_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select(F.col("device").alias("ifa"), "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "n_events")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.redelivered(table(spark, d, "request_log"))


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """The log with exactly one copy of each message."""
    log = table(spark, d, "request_log")
    return log.join(dedup.redelivered(log), "rec_id", "left_anti").select("rec_id", "batch_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_variants, p1_bid_variants, p1_subtypes, p2_found, p2_spots, p3_found, p3_counts, p3_site_totals, p3_country_totals, p3_publisher_rows, p4_found, p4_sessions, p6_found, p6_kept)}

for _entity in ("imp", "deal", "device", "geo", "user", "demographic"):
    QUERIES[f"p1_bid_{_entity}"] = _typed_table(_entity)
    QUERIES[f"p1_{_entity}_table"] = _whole_table(_entity)

_SESSIONS = """
WITH e AS (
  SELECT rec_id, lower(regexp_replace(ifa, '[[:punct:]]', '', 'g')) AS ifa, epoch_us(req_ts) AS us FROM request_log
), c AS (
  SELECT rec_id, ifa, CAST(floor(us / 1000) AS BIGINT) AS ms FROM e
  WHERE regexp_full_match(ifa, '[0-9a-f]{32}') AND ifa <> repeat('0', 32) AND us IS NOT NULL AND us <> 0
), g AS (
  SELECT rec_id, ifa, ms, CASE WHEN ms - lag(ms) OVER w <= 1800000 THEN 0 ELSE 1 END AS opens FROM c WINDOW w AS (PARTITION BY ifa ORDER BY ms, rec_id)
), s AS (
  SELECT ifa, ms, sum(opens) OVER (PARTITION BY ifa ORDER BY ms, rec_id ROWS UNBOUNDED PRECEDING) AS s FROM g
)
"""
_COPIES = """
WITH k AS (
  SELECT rec_id, batch_id, lower(regexp_replace(id, '^\\s+|\\s+$', '', 'g')) AS id, epoch_us(req_ts) AS us FROM request_log
), r AS (
  SELECT rec_id, batch_id, CASE WHEN id IS NULL OR id = '' OR us IS NULL OR us = 0 THEN 1
    ELSE row_number() OVER (PARTITION BY id, CAST(floor(us / 1000) AS BIGINT), id IS NULL OR id = '' OR us IS NULL OR us = 0 ORDER BY rec_id) END AS n
  FROM k
)
"""
_BID_IMPS = "SELECT rec_id, unnest(msg.imp) AS x, generate_subscripts(msg.imp, 1) - 1 AS i FROM bid_requests"
_LIVE = "(x.id IS NOT NULL OR x.exp IS NOT NULL OR {pmp} OR {banner} OR {video} OR x.bidfloor.units IS NOT NULL OR x.bidfloor.nanos IS NOT NULL OR x.bidfloorcur IS NOT NULL OR x.ext.displaytime IS NOT NULL OR x.dt IS NOT NULL OR x.qty.multiplier.units IS NOT NULL OR x.qty.multiplier.nanos IS NOT NULL)"
_SOME = "len(list_filter(coalesce({l}, []), lambda y: y IS NOT NULL)) > 0"
_BANNER = f"({_SOME.format(l='x.banner.mimes')} OR x.banner.w IS NOT NULL OR x.banner.h IS NOT NULL)"
_VIDEO = f"({_SOME.format(l='x.video.mimes')} OR {_SOME.format(l='x.video.protocols')} OR x.video.w IS NOT NULL OR x.video.h IS NOT NULL OR x.video.minduration IS NOT NULL OR x.video.maxduration IS NOT NULL)"
_DEAL = "d.id IS NOT NULL OR d.bidfloor.units IS NOT NULL OR d.bidfloor.nanos IS NOT NULL OR d.at IS NOT NULL OR len(list_filter(coalesce(d.wseat, []), lambda y: y IS NOT NULL)) > 0 OR d.bidfloorcur IS NOT NULL OR d.ext.adspottype IS NOT NULL OR d.ext.guaranteed IS NOT NULL OR d.ext.must_bid IS NOT NULL"
_PMP = f"(x.pmp.private_auction IS NOT NULL OR len(list_filter(coalesce(x.pmp.deals, []), lambda d: {_DEAL})) > 0)"
_NEAR = """
WITH p AS (
  SELECT geo_id, lat.units + lat.nanos / 1e9 AS a, lon.units + lon.nanos / 1e9 AS o FROM geo_points
  WHERE lat.units IS NOT NULL AND lat.nanos IS NOT NULL AND lon.units IS NOT NULL AND lon.nanos IS NOT NULL
), q AS (
  SELECT *, floor(a * 100) AS band FROM p WHERE a BETWEEN -90 AND 90 AND o BETWEEN -180 AND 180 AND NOT (a = 0 AND o = 0)
), b AS (
  SELECT geo_id, a, o, unnest([band - 1, band, band + 1]) AS band FROM q
), near AS (
  SELECT x.geo_id AS a_id, y.geo_id AS b_id FROM q AS x JOIN b AS y USING (band)
  WHERE x.geo_id < y.geo_id AND 2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(y.a - x.a) / 2), 2) + cos(radians(x.a)) * cos(radians(y.a)) * pow(sin(radians(y.o - x.o) / 2), 2)))) <= 250
)"""
_LAT, _LON = "(g.lat.units IS NOT NULL OR g.lat.nanos IS NOT NULL)", "(g.lon.units IS NOT NULL OR g.lon.nanos IS NOT NULL)"
_GEO = f"({_LAT} OR {_LON} OR g.type IS NOT NULL OR g.country IS NOT NULL OR g.region IS NOT NULL OR g.city IS NOT NULL OR g.dma IS NOT NULL OR g.utcoffset IS NOT NULL)"
_DEMOGRAPHIC = "(u.ext.demographic.total.units IS NOT NULL OR u.ext.demographic.total.nanos IS NOT NULL)"
_BIDS = {
    "imp": f"SELECT rec_id, i AS imp_index, CASE WHEN {_BANNER} AND {_VIDEO} THEN 'imp_av' WHEN {_VIDEO} THEN 'imp_video' WHEN {_BANNER} THEN 'imp_banner' ELSE 'imp_bare' END AS variant, x.id AS imp_id, x.exp AS exp, x.bidfloorcur AS bidfloorcur, x.video.minduration AS minduration FROM ({_BID_IMPS}) WHERE {_LIVE.format(pmp=_PMP, banner=_BANNER, video=_VIDEO)}",
    "deal": f"SELECT rec_id, imp_index, deal_index, CASE WHEN {_SOME.format(l='d.wseat')} THEN 'deal_seated' ELSE 'deal_open' END AS variant, d.id AS deal_id, d.at AS at, d.bidfloor.units + d.bidfloor.nanos / 1e9 AS bidfloor, CAST(len(coalesce(d.wseat, [])) AS INTEGER) AS n_seats FROM (SELECT rec_id, i AS imp_index, unnest(x.pmp.deals) AS d, generate_subscripts(x.pmp.deals, 1) - 1 AS deal_index FROM ({_BID_IMPS})) WHERE {_DEAL}",
    "device": f"SELECT rec_id, CASE WHEN {_LAT} AND {_LON} THEN 'device_located' WHEN {_GEO} THEN 'device_placed' ELSE 'device_bare' END AS variant, v.ifa AS ifa, v.ua AS ua, v.ip AS ip, v.w AS w, v.h AS h FROM (SELECT rec_id, msg.device AS v, msg.device.geo AS g FROM bid_requests) WHERE v.ifa IS NOT NULL OR v.ua IS NOT NULL OR v.ip IS NOT NULL OR v.w IS NOT NULL OR v.h IS NOT NULL OR {_GEO}",
    "geo": f"SELECT rec_id, CASE WHEN {_LAT} AND {_LON} THEN 'geo_point' ELSE 'geo_place' END AS variant, g.lat.units + g.lat.nanos / 1e9 AS lat, g.lon.units + g.lon.nanos / 1e9 AS lon, g.type AS type, g.country AS country, g.region AS region, g.city AS city, g.dma AS dma, g.utcoffset AS utcoffset FROM (SELECT rec_id, msg.device.geo AS g FROM bid_requests) WHERE {_GEO}",
    "user": f"SELECT rec_id, CASE WHEN {_DEMOGRAPHIC} THEN 'user_profiled' ELSE 'user_bare' END AS variant, u.id AS user_id FROM (SELECT rec_id, msg.user AS u FROM bid_requests) WHERE u.id IS NOT NULL OR {_DEMOGRAPHIC}",
    "demographic": f"SELECT rec_id, 'demographic' AS variant, u.ext.demographic.total.units + u.ext.demographic.total.nanos / 1e9 AS total FROM (SELECT rec_id, msg.user AS u FROM bid_requests) WHERE {_DEMOGRAPHIC}",
}
ORACLES = {
    **{f"p1_bid_{e}": sql for e, sql in _BIDS.items()},
    "p1_bid_variants": " UNION ALL ".join(f"SELECT '{e}' AS entity, variant, count(*) AS n FROM ({sql}) GROUP BY variant" for e, sql in _BIDS.items()),
    "p2_spots": _NEAR
    + """, o AS (
  SELECT geo_id, min(geo_id) OVER w AS spot, count(*) OVER w AS n_same FROM q WINDOW w AS (PARTITION BY a, CASE WHEN o = 180 THEN -180 ELSE o END)
), m AS (
  SELECT id, count(*) AS n FROM (SELECT a_id AS id FROM near UNION ALL SELECT b_id FROM near) GROUP BY id
)
SELECT geo_id, spot, n_same, coalesce(n, 0) AS n_near FROM o LEFT JOIN m ON geo_id = id""",
    "p2_found": _NEAR
    + """, e AS (
  SELECT zone_id, j, generate_subscripts(ring, 1) AS i, unnest(ring) AS v, len(ring) AS n, ring FROM (SELECT zone_id, generate_subscripts(rings, 1) AS j, unnest(rings) AS ring FROM geo_zones)
), s AS (
  SELECT zone_id, j, v.lat AS a1, v.lon AS o1, ring[i % n + 1].lat AS a2, ring[i % n + 1].lon AS o2 FROM e WHERE n > 1
), c AS (
  SELECT geo_id, zone_id, j, a, a1, a2, ((o1 - o + 540) % 360 + 360) % 360 - 180 AS x1, ((o2 - o + 540) % 360 + 360) % 360 - 180 AS x2 FROM q, s
), r AS (
  SELECT geo_id, zone_id, j, count(*) % 2 AS odd FROM c WHERE (x1 >= 0) <> (x2 >= 0) AND abs(x1 - x2) < 180 AND a1 + (a2 - a1) * (-x1 / (x2 - x1)) > a GROUP BY ALL
)
SELECT 'near' AS kind, a_id, b_id FROM near UNION ALL SELECT 'zone', geo_id, zone_id FROM (SELECT geo_id, zone_id, sum(odd) AS n FROM r GROUP BY ALL) WHERE n % 2 = 1
""",
    "p3_found": "SELECT field, hot_key FROM (SELECT 'site_id' AS field, site_id AS hot_key, count(*) AS n FROM request_log GROUP BY ALL UNION ALL SELECT 'country', country, count(*) FROM request_log GROUP BY ALL) WHERE hot_key IS NOT NULL AND hot_key <> '' AND n >= 0.03 * (SELECT count(*) FROM request_log)",
    "p3_counts": "SELECT field, value, n, value <> '' AND n >= 0.03 * (SELECT count(*) FROM request_log) AS hot FROM (SELECT 'site_id' AS field, site_id AS value, count(*) AS n FROM request_log GROUP BY ALL UNION ALL SELECT 'country', country, count(*) FROM request_log GROUP BY ALL) WHERE value IS NOT NULL",
    "p3_site_totals": "SELECT site_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT ifa) AS BIGINT) AS n_distinct FROM request_log GROUP BY site_id",
    "p3_country_totals": "SELECT country, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT user_id) AS BIGINT) AS n_distinct FROM request_log GROUP BY country",
    "p3_publisher_rows": "SELECT publisher.id AS publisher_id, count(*) AS n_rows FROM request_log LEFT JOIN sites USING (site_id) GROUP BY 1",
    "p4_found": _SESSIONS + "SELECT ifa, min(ms) AS start_ms, max(ms) AS end_ms FROM s GROUP BY ifa, s",
    "p4_sessions": _SESSIONS + "SELECT ifa, min(ms) AS start_ms, max(ms) AS end_ms, max(ms) - min(ms) AS duration_ms, count(*) AS n_events FROM s GROUP BY ifa, s",
    "p6_found": _COPIES + "SELECT rec_id FROM r WHERE n > 1",
    "p6_kept": _COPIES + "SELECT rec_id, batch_id FROM r WHERE n = 1",
}
