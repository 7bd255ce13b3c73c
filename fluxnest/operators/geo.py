"""Points near points, and points inside zones.

near_pairs hashes points to grid cells whose height is a multiple of the radius and whose width
follows the band's latitude, joins each point with the cells its circle touches upwards, and
verifies the great-circle distance. zone_members covers zones with cells, joins by cell and
verifies point-in-polygon by the edges of the cell's strip of longitude. Neither joins across cells that can't match.

Points at one spot are collapsed first, so crowded spots cost one candidate; pairs are expanded
afterwards, the points of a crowded spot in parts of about CROWD; near_spots gives the same links without expanding
them. Null coordinates take no part; empty tables give empty results; bands at the poles
and around +-180 degrees wrap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, materialise, small_enough
from .skew import skew_join

EARTH_M = 6_371_008.8
#: Points of one spot that one part holds when pairs are expanded, about.
CROWD = 1024
#: Places of one grid cell that one part holds when candidates are verified, about.
CELL = 10_000
#: Edges of zones that may be broadcast: 32 bytes each.
BROADCAST_EDGES = 250_000
#: Parts a cell's points are spread over where the zones are too large to be broadcast.
SALTS = 16


def decimal_value(value: Column) -> Column:
    """units + nanos / 10^9 of a {units, nanos} struct as a double; null if either is null."""
    return value["units"].cast("double") + value["nanos"].cast("double") / 1e9


def usable_points(df: DataFrame, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(id, lat, lon) in degrees of rows whose coordinates are complete, possible and set."""
    p = df.select(F.col(key).alias("id"), decimal_value(F.col(lat)).alias("lat"), decimal_value(F.col(lon)).alias("lon"))
    return p.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0)))


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Haversine distance; exact enough for metres and for antipodes alike."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


class Grid:
    """Bands of equal height from -90 degrees; each has as many equal cells as fit at its widest useful size."""

    def __init__(self, radius_m: float, factor: float = 2.0):
        self.delta = math.degrees(radius_m / EARTH_M) * (1 + 1e-9)
        self.height = min(180.0, self.delta * factor)

    def band(self, lat: Column) -> Column:
        return F.floor((lat + 90) / self.height).cast("bigint")

    def cells(self, band: Column) -> Column:
        """Number of cells of a band, from the latitude of its edge next to a pole."""
        edge = F.least(F.lit(90.0), F.greatest(F.abs(band * self.height - 90), F.abs((band + 1) * self.height - 90)))
        return F.greatest(F.lit(1), F.floor(F.cos(F.radians(edge)) * (360 / self.height))).cast("bigint")

    def cell(self, lon: Column, n: Column) -> Column:
        return F.pmod(F.floor((lon + 180) / 360 * n).cast("bigint"), n)

    def reach(self, lat: Column) -> Column:
        """Degrees of longitude that the circle spans to either side; null where it holds a pole."""
        free = F.abs(lat) + self.delta < 90
        return F.when(free, F.degrees(F.asin(F.sin(F.radians(F.lit(self.delta))) / F.cos(F.radians(lat)))) * (1 + 1e-9) + 1e-12)

    def touched(self, lat: Column, lon: Column) -> Column:
        """array<struct<band, cell>> of the cells that the upper half of the circle touches."""
        reach = self.reach(lat)

        def in_band(b: Column) -> Column:
            n = self.cells(b)
            first = F.floor((lon - reach + 180) / 360 * n).cast("bigint")
            last = F.floor((lon + reach + 180) / 360 * n).cast("bigint")
            whole = reach.isNull() | (last - first >= n)
            run = F.sequence(F.when(whole, F.lit(0)).otherwise(first), F.when(whole, n - 1).otherwise(last))
            return F.transform(run, lambda c: F.struct(b.alias("band"), F.pmod(c, n).alias("cell")))

        return F.array_distinct(F.flatten(F.transform(F.sequence(self.band(lat), self.band(F.least(lat + self.delta, F.lit(90.0)))), in_band)))


def _clean(points: DataFrame) -> DataFrame:
    """Different (id, lat, lon) with one spelling of a place: -0 is 0 and 180 degrees are -180."""
    points = points.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).filter(F.col("id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return points.withColumn("lat", F.col("lat") + F.lit(0.0)).withColumn("lon", F.when(F.col("lon") == 180, -180.0).otherwise(F.col("lon") + F.lit(0.0))).distinct()


def _spots(points: DataFrame) -> DataFrame:
    """(lat, lon, spot, n): each place, its smallest id and its number of points."""
    return materialise(points.groupBy("lat", "lon").agg(F.min("id").alias("spot"), F.count(F.lit(1)).alias("n")), "spots")


def _near_spots(spots: DataFrame, radius_m: float, factor: float) -> DataFrame:
    """(s1, n1, s2, n2): different places at most radius_m apart, each pair once."""
    grid = Grid(radius_m, factor)
    home = spots.select("spot", "n", "lat", "lon").withColumn("band", grid.band(F.col("lat"))).withColumn("cell", grid.cell(F.col("lon"), grid.cells(F.col("band"))))
    probe = spots.select(F.col("spot").alias("p_spot"), F.col("n").alias("p_n"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.explode(grid.touched(F.col("lat"), F.col("lon"))).alias("at"))
    probe = probe.select("p_spot", "p_n", "p_lat", "p_lon", "at.band", "at.cell")
    above = (F.col("lat") > F.col("p_lat")) | ((F.col("lat") == F.col("p_lat")) & (F.col("spot") > F.col("p_spot")))
    keys, hot = ["band", "cell"], home.groupBy("band", "cell").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > CELL)
    if not hot.isEmpty():
        # A crowded cell's places are spread over parts, and what probes it is repeated for each.
        parts = materialise(hot.select("band", "cell", F.ceil(F.col("m") / CELL).cast("bigint").alias("parts")), "hot")
        parts = broadcast_if_small(parts)
        count = F.coalesce("parts", F.lit(1).cast("bigint"))
        home = home.join(parts, keys, "left").withColumn("part", F.pmod(F.xxhash64("spot"), count)).drop("parts")
        probe = probe.join(parts, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1))).drop("parts")
        keys = ["band", "cell", "part"]
    near = probe.join(home, keys).filter(above & (great_circle(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")) <= radius_m))
    return near.select(F.col("p_spot").alias("s1"), F.col("p_n").alias("n1"), F.col("spot").alias("s2"), F.col("n").alias("n2"))


def near_pairs(points: DataFrame, radius_m: float, factor: float = 2.0) -> DataFrame:
    """(a_id, b_id), a_id the smaller, of points (id, lat, lon) at most radius_m apart; each pair once.

    Rows whose id is repeated count once. 180 and -180 degrees are one meridian.
    """
    points = _clean(points)
    spots = _spots(points)
    near = _near_spots(spots, radius_m, factor)
    crowded = spots.filter("n > 1")
    near = near.unionByName(crowded.select(F.col("spot").alias("s1"), F.col("n").alias("n1"), F.col("spot").alias("s2"), F.col("n").alias("n2")))
    # Only spots of several points have members to look up; any other spot is its point.
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / CROWD)).cast("bigint")
    members = points.join(broadcast_if_small(crowded), ["lat", "lon"]).select("spot", "id", F.pmod(F.xxhash64("id"), parts("n")).alias("part"))
    side = lambda s, i: members.select(F.col("spot").alias(s), F.col("id").alias(i), "part")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), parts(n) - 1))
    left = near.withColumn("part", every("n1")).join(side("s1", "i"), ["s1", "part"], "left").filter("n1 = 1 OR i IS NOT NULL").drop("part")
    both = left.withColumn("part", every("n2")).join(side("s2", "j"), ["s2", "part"], "left").filter("n2 = 1 OR j IS NOT NULL")
    both = both.select("s1", "s2", F.coalesce("i", "s1").alias("i"), F.coalesce("j", "s2").alias("j"))
    kept = both.filter((F.col("s1") != F.col("s2")) | (F.col("i") < F.col("j")))
    return kept.select(F.least("i", "j").alias("a_id"), F.greatest("i", "j").alias("b_id")).filter("a_id < b_id")


def near_spots(points: DataFrame, radius_m: float, factor: float = 2.0) -> DataFrame:
    """(id, spot, n_same, n_near): each point with its place (named by its smallest id), the points there and the number of other points at most radius_m away.

    The links of places are counted, never expanded to points. A place that holds a third of all points is met by broadcast.
    """
    points = _clean(points)
    spots = _spots(points)
    near = _near_spots(spots, radius_m, factor)
    ends = near.select(F.col("s1").alias("spot"), F.col("n2").alias("m")).unionByName(near.select(F.col("s2").alias("spot"), F.col("n1").alias("m")))
    linked = ends.groupBy("spot").agg(F.sum("m").alias("m"))
    place = F.concat_ws(",", "lat", "lon").alias("__place")
    info = spots.join(linked, "spot", "left").select(place, "spot", F.col("n").alias("n_same"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_near"))
    return skew_join(points.select("id", place), info, "__place", 0.01, "inner").drop("__place")


def _wrap(degrees: Column) -> Column:
    return F.pmod(degrees + 180, F.lit(360.0)) - 180


def crosses(lat: Column, lon: Column, edge: Column) -> Column:
    """Whether the meridian northwards from the point crosses an edge, which takes the shorter way round."""
    xa, xb = _wrap(edge["lon1"] - lon), _wrap(edge["lon2"] - lon)
    at = edge["lat1"] + (edge["lat2"] - edge["lat1"]) * (-xa / (xb - xa))
    return F.coalesce(((xa >= 0) != (xb >= 0)) & (F.abs(xa - xb) < 180) & (at > lat), F.lit(False))


def zone_strips(zones: DataFrame, degrees: float) -> DataFrame:
    """(zone_id, col, edges): the edges of all rings of a zone that lie in a column of a grid, closed where a ring is open.

    A point is inside when an odd number of rings contain it, so all rings' edges may be counted together.
    """
    cols = int(round(360 / degrees))
    ring = zones.select("zone_id", F.explode("rings").alias("ring")).filter(F.size("ring") > 1)
    n = F.size("ring")
    following = lambda i: F.get("ring", F.pmod(i + 1, n))
    edge = F.explode(F.transform("ring", lambda a, i: F.struct(a["lat"].alias("lat1"), a["lon"].alias("lon1"), following(i)["lat"].alias("lat2"), following(i)["lon"].alias("lon2"))))
    edges = ring.select("zone_id", edge.alias("edge"))
    west = F.least(F.col("edge.lon1"), F.col("edge.lon1") + _wrap(F.col("edge.lon2") - F.col("edge.lon1")))
    east = F.greatest(F.col("edge.lon1"), F.col("edge.lon1") + _wrap(F.col("edge.lon2") - F.col("edge.lon1")))
    at = lambda x: F.floor((x + 180) / degrees).cast("bigint")
    run = F.transform(F.sequence(at(west), at(east)), lambda c: F.pmod(c, F.lit(cols)))
    in_cols = edges.filter(west.isNotNull()).select("zone_id", F.explode(run).alias("col"), "edge")
    return in_cols.groupBy("zone_id", "col").agg(F.collect_list("edge").alias("edges"))


def cover_zones(zones: DataFrame, degrees: float) -> DataFrame:
    """(zone_id, row, col): the cells of a regular grid that the box around each ring touches."""
    cols = int(round(360 / degrees))
    ring = zones.select("zone_id", F.explode("rings").alias("ring")).filter(F.size("ring") > 1)
    first = F.get("ring", 0)["lon"]
    # Longitudes of a ring unwrapped along its edges, so that its box is the one the ring really spans.
    unwrapped = F.aggregate(
        "ring",
        F.struct(first.alias("at"), first.alias("lo"), first.alias("hi")),
        lambda s, p: F.struct((s["at"] + _wrap(p["lon"] - s["at"])).alias("at"), F.least(s["lo"], s["at"] + _wrap(p["lon"] - s["at"])).alias("lo"), F.greatest(s["hi"], s["at"] + _wrap(p["lon"] - s["at"])).alias("hi")),
    )
    box = ring.select("zone_id", unwrapped.alias("x"), F.array_min(F.transform("ring", lambda p: p["lat"])).alias("south"), F.array_max(F.transform("ring", lambda p: p["lat"])).alias("north"))
    west, east = F.floor((F.col("x.lo") + 180) / degrees).cast("bigint"), F.floor((F.col("x.hi") + 180) / degrees).cast("bigint")
    whole = east - west >= cols
    rows = F.sequence(F.floor((F.col("south") + 90) / degrees).cast("bigint"), F.floor((F.col("north") + 90) / degrees).cast("bigint"))
    run = F.sequence(F.when(whole, F.lit(0)).otherwise(west), F.when(whole, F.lit(cols - 1)).otherwise(east))
    cells = box.select("zone_id", F.explode(rows).alias("row"), run.alias("run")).select("zone_id", "row", F.explode("run").alias("c"))
    return cells.select("zone_id", "row", F.pmod("c", F.lit(cols)).alias("col")).distinct()


def zone_members(points: DataFrame, zones: DataFrame, degrees: float = 1.0) -> DataFrame:
    """(a_id, zone_id) of each point (id, lat, lon) and each zone that contains it.

    Points without coordinates and zones without rings have no rows. Other columns of either table are ignored. Rings are never
    repeated a cell: candidates meet the edges of their own column. Cells and edges are broadcast only while their
    counted number is small; otherwise they meet the points in shuffles, a cell's points in SALTS parts.
    """
    cols = int(round(360 / degrees))
    at = points.select("id", "lat", "lon").withColumn("row", F.floor((F.col("lat") + 90) / degrees).cast("bigint")).withColumn("col", F.pmod(F.floor((F.col("lon") + 180) / degrees).cast("bigint"), F.lit(cols)))
    cover, strips = cover_zones(zones, degrees), zone_strips(zones, degrees)
    if small_enough(cover) and (strips.agg(F.sum(F.size("edges"))).first()[0] or 0) <= BROADCAST_EDGES:
        near = at.join(F.broadcast(cover), ["row", "col"]).join(F.broadcast(strips), ["zone_id", "col"])
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salted = at.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        near = salted.join(cover.withColumn("salt", salts), ["row", "col", "salt"]).join(strips.withColumn("salt", salts), ["zone_id", "col", "salt"])
    odd = F.size(F.filter("edges", lambda e: crosses(F.col("lat"), F.col("lon"), e))) % 2 == 1
    return near.filter(odd).select(F.col("id").alias("a_id"), "zone_id")
