import math
import random

from pyspark.sql import functions as F

from fluxnest.operators import geo


def near(spark, pts, radius):
    df = spark.createDataFrame(pts, "id bigint, lat double, lon double, band int, cell string")
    return {tuple(r) for r in geo.near_pairs(df, radius).collect()}


def metres(a, b):
    la, lb = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(min(1, math.sqrt(h)))


def test_pairs_equal_brute_force_at_poles_and_the_date_line(spark):
    rnd = random.Random(5)
    pts = []
    for lat, lon in [(0, 179.999), (89.999, 10), (-89.9995, -170), (60, 0), (0, -180), (90, 0), (-90, 33), (45.0, 180.0), (71.3, -179.9999)]:
        for _ in range(25):
            y = max(-90.0, min(90.0, lat + rnd.uniform(-0.004, 0.004)))
            x = lon + rnd.uniform(-0.004, 0.004) * (1 if abs(lat) < 89 else 20_000)
            pts.append((float(y), (x + 180) % 360 - 180))
    pts = [(i + 1, y, x, 1, "c") for i, (y, x) in enumerate(pts)]
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and metres(a, b) <= 250}
    assert len(want) > 100
    assert near(spark, pts, 250.0) == want


def test_crowded_spots_ties_nulls_and_repeats(spark):
    pts = [(i, 10.0, 20.0, 0, "") for i in range(1, 21)] + [(5, 10.0, 20.0, 0, ""), (30, None, 1.0, 0, ""), (31, 1.0, None, 0, ""), (None, 10.0, 20.0, 0, ""), (40, 0.0, 180.0, 0, ""), (41, -0.0, -180.0, 0, "")]
    assert near(spark, pts, 250.0) == {(a, b) for a in range(1, 21) for b in range(a + 1, 21)} | {(40, 41)}
    assert near(spark, [], 250.0) == set()


def test_crowds_in_parts_and_places_without_pairs(spark, monkeypatch):
    rnd = random.Random(9)
    monkeypatch.setattr(geo, "CROWD", 4)
    monkeypatch.setattr(geo, "CELL", 2)
    pts = [(i, 10.0 + 0.001 * rnd.choice([0, 0, 0, 0, 1, 2, 7]), 20.0 + 0.001 * rnd.choice([0, 0, 0, 1]), 0, "") for i in range(1, 90)] + [(90, 50.0, 180.0, 0, ""), (91, 50.0, -180.0, 0, "")]
    shift = [(i, y, x if abs(x) < 180 else -180.0) for i, y, x, *_ in pts]
    want = {(a[0], b[0]) for a in shift for b in shift if a[0] < b[0] and metres(a, b) <= 250}
    assert near(spark, pts, 250.0) == want and len(want) > 500
    df = spark.createDataFrame(pts, "id bigint, lat double, lon double, n int, spot string")
    got = {r.id: (r.spot, r.n_same, r.n_near) for r in geo.near_spots(df, 250.0).collect()}
    for i, y, x in shift:
        same = [j for j, v, w in shift if (v, w) == (y, x)]
        assert got[i] == (min(same), len(same), sum(i in p for p in want))
    assert len(got) == len(pts) and geo.near_spots(df.limit(0), 250.0).count() == 0


def test_zones(spark, monkeypatch):
    square = lambda s, w, n, e: [(s, w), (s, e), (n, e), (n, w)]
    rings = {
        1: [square(0, 0, 10, 10), square(4, 4, 6, 6)],  # with a hole
        2: [square(-5, 175, 5, -175)],  # across the date line
        3: [],
        4: [[], [(1.0, 1.0)]],
        5: [square(0, 0, 10, 10)[::-1] + [(0, 0)]],  # closed, the other way round
    }
    zones = spark.createDataFrame([(z, [[(float(a), float(b)) for a, b in r] for r in rs], "x") for z, rs in rings.items()] + [(6, None, "x")], "zone_id bigint, rings array<array<struct<lat double, lon double>>>, row string")
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 1.0), (3, 0.5, 179.0), (4, 0.5, -179.0), (5, 0.5, 170.0), (6, None, 3.0), (7, 20.0, 5.0)], "id bigint, lat double, lon double").withColumn("rings", F.lit(1))
    for edges in (geo.BROADCAST_EDGES, -1):  # broadcast, and shuffled in parts
        monkeypatch.setattr(geo, "BROADCAST_EDGES", edges)
        got = {tuple(r) for r in geo.zone_members(pts, zones).collect()}
        assert got == {(1, 5), (2, 1), (2, 5), (3, 2), (4, 2)}
    assert geo.zone_members(pts.limit(0), zones).count() == 0
    assert geo.zone_members(pts, zones.limit(0)).count() == 0


def test_usable_points(spark):
    d = "struct<units bigint, nanos int>"
    df = spark.createDataFrame([(1, (1, 500_000_000), (-2, -250_000_000)), (2, None, (1, 1)), (3, (1, None), (1, 1)), (4, (0, 0), (0, 0)), (5, (90, 1), (1, 0)), (6, (2, -500_000_000), (180, 0))], f"k bigint, lat {d}, lon {d}")
    assert [tuple(r) for r in geo.usable_points(df, "k").orderBy("id").collect()] == [(1, 1.5, -2.25), (6, 1.5, 180.0)]
