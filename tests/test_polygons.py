"""Polygons of mixed size against plain Python: who covers a point, how far outlines are, how much of a circle is covered."""

import math
import random

import numpy as np
import pytest
from emberline.operators import polygons as pg
from emberline.operators.nearness import nearest
from pyspark.sql import functions as F

K = pg.KM_A_DEGREE
SCHEMA = "feature_id long, kind string, rings array<array<struct<lon:double,lat:double>>>"
POINTS = "point_id long, lat double, lon double"


def box(west, south, east, north):
    return [(float(x), float(y)) for x, y in ((west, south), (east, south), (east, north), (west, north), (west, south))]


def star(x, y, r, n, rng):
    corners = [(x + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), y + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return [*corners, corners[0]]


def plain_inside(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            if abs(cross) < 1e-12 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return True
            if (ay > y) != (by > y) and ax + (y - ay) / (by - ay) * (bx - ax) > x:
                odd = not odd
    return odd


def plain_km(rings, x, y):
    if plain_inside(rings, x, y):
        return 0.0
    best = math.inf
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            px, py, qx, qy = (ax - x) * math.cos(math.radians(y)) * K, (ay - y) * K, (bx - x) * math.cos(math.radians(y)) * K, (by - y) * K
            dx, dy = qx - px, qy - py
            t = max(0.0, min(1.0, -(px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            best = min(best, math.hypot(px + t * dx, py + t * dy))
    return best


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(8)
    shapes = [(1, "forest", [star(75, 20, 9, 400, rng)]), (2, "forest", [box(70, 15, 80, 25), box(73, 18, 76, 21)]), (3, "urban", [box(0, 0, 1e-4, 1e-4)])]
    for k in range(120):
        x, y, r = 75 + rng.gauss(0, 6), 20 + rng.gauss(0, 6), 10 ** rng.uniform(-3, -0.5)
        shapes.append((10 + k, rng.choice(["forest", "urban"]), [star(x, y, r, rng.choice([3, 5, 40]), rng)] if k % 2 else [box(x - r, y - r, x + r, y + r), box(x - r / 2, y - r / 2, x + r / 3, y)]))
    points = [(k, 20 + rng.gauss(0, 6), 75 + rng.gauss(0, 6)) for k in range(250)]
    points += [(1000 + k, s[2][0][k % 3][1], s[2][0][k % 3][0]) for k, s in enumerate(shapes)]  # corners
    points += [(2000, 15.0, 72.5), (2001, 18.0, 74.0), (2002, 0.0, 0.00005), (2003, -60.0, -170.0)]
    return shapes, points


def frames(spark, mixed):
    shapes, points = mixed
    return spark.createDataFrame([*shapes, shapes[5], (999, "urban", None), (998, "urban", [])], SCHEMA).repartition(3), spark.createDataFrame([*points, (3000, None, 1.0), (3001, 95.0, 1.0)], POINTS)


def test_covering_and_nearest(spark, mixed):
    shapes, points = mixed
    polygons, asked = frames(spark, mixed)
    got = {(r.point_id, r.feature_id) for r in pg.covering(asked, pg.index(polygons)).collect()}
    assert got == {(p, f) for p, y, x in points for f, _, rings in shapes if plain_inside(rings, x, y)}
    near = {(r.point_id, r.kind): (round(r.distance_km, 6), r.feature_id) for r in pg.nearest_polygon(asked, polygons, "kind").collect()}
    want = {}
    for p, y, x in points:
        for kind in ("forest", "urban"):
            km, f = min((plain_km(rings, x, y), f) for f, k, rings in shapes if k == kind)
            want[p, kind] = (round(km, 6), f)
    assert near == want
    within = {(r.point_id, r.feature_id): round(r.distance_km, 6) for r in pg.polygons_within(asked, polygons, 40.0).collect()}
    plain = {(p, f): round(plain_km(rings, x, y), 6) for p, y, x in points for f, _, rings in shapes}
    assert within == {pf: km for pf, km in plain.items() if km <= 40}


def test_one_huge_and_many_small(spark):
    """A continent and 100,000 small squares: what meets at all grows with the points and the squares, not with their product."""
    small = spark.range(100_000).select(
        F.col("id").alias("feature_id"), F.lit("small").alias("kind"), (60 + F.col("id") % 400 * 0.1).alias("x"), (F.floor(F.col("id") / 400) * 0.1).alias("y")
    )
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("lon"), (F.col("y") + dy).alias("lat"))
    square = F.array(F.array(corner(0.0, 0.0), corner(0.01, 0.0), corner(0.01, 0.01), corner(0.0, 0.01), corner(0.0, 0.0)))
    huge = spark.createDataFrame([(-1, "huge", [star(80, 12, 40, 5000, random.Random(1))])], SCHEMA)
    polygons = small.select("feature_id", "kind", square.alias("rings")).unionByName(huge)
    cells = pg.index(polygons)
    assert cells.count() < 1_000_000 and cells.filter("kind = 'huge'").count() < 5000 and cells.agg(F.max(F.size("edges"))).first()[0] < 1000
    points = spark.range(5000).select(F.col("id").alias("point_id"), (F.col("id") % 250 * 0.1 + 0.005).alias("lat"), (60.005 + F.col("id") % 399 * 0.1).alias("lon"))
    met = pg.located(points, cells)
    assert met.count() <= 4 * 5000
    assert met.filter("odd or on").filter("kind = 'small'").count() == 5000


def clip_area(rings_list, km, n=600):
    """The share of a circle that is covered, by a fine grid of places: good to about a per cent."""
    hit = total = 0
    for i in range(n):
        for j in range(n):
            x, y = (2 * (i + 0.5) / n - 1) * km, (2 * (j + 0.5) / n - 1) * km
            if x * x + y * y <= km * km:
                total += 1
                hit += any(plain_inside(rings, x, y) for rings in rings_list)
    return hit / total


def share(rings_list, inside, radius=1.0):
    edges = [(*a, *b, k) for k, rings in enumerate(rings_list) for ring in rings for a, b in zip(ring, ring[1:], strict=False)]
    e = np.array(edges, float).reshape(-1, 5)
    return pg.covered_share(e[:, 0], e[:, 1], e[:, 2], e[:, 3], e[:, 4].astype(int), np.array(inside, np.int64), radius)


def test_share_closed_forms():
    circle = 128 * math.sin(2 * math.pi / 256)
    two = [[box(-0.5, -0.3, 0.3, 0.2)], [box(-0.1, -0.1, 0.6, 0.4)]]
    assert share(two, [1, 1]) == pytest.approx((0.8 * 0.5 + 0.7 * 0.5 - 0.4 * 0.3) / circle, abs=1e-9)
    holed = [[box(-0.5, -0.5, 0.5, 0.5), box(-0.2, -0.2, 0.2, 0.3)]]
    assert share(holed, [0]) == pytest.approx((1 - 0.4 * 0.5) / circle, abs=1e-9)
    assert share([[box(-9, -9, 9, 9)]], [1]) == pytest.approx(1, abs=1e-12) and share([[box(0, -9, 9, 9)]], [0]) == pytest.approx(0.5, abs=1e-9)
    assert share([[box(-9, -9, 9, 9)], [box(-0.5, -0.5, 0.5, 0.5)]], [1, 1]) == pytest.approx(1, abs=1e-12)
    turned = [[[(0, -0.5), (0.5, 0), (0, 0.5), (-0.5, 0), (0, -0.5)]], [box(-0.25, -0.25, 0.25, 0.25)]]
    assert share(turned, [1, 1]) == pytest.approx(0.5 / circle, abs=1e-9)
    assert share([], []) == 0


def test_share_of_stars():
    rng = random.Random(6)
    shapes = [[star(rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(0.3, 1.2), 12, rng)] for _ in range(5)]
    assert share(shapes, [plain_inside(s, 0, 0) for s in shapes]) == pytest.approx(clip_area(shapes, 1.0, 300), abs=0.01)


def test_cover(spark):
    deg = 1 / K
    shapes = [(1, "forest", [box(-3 * deg, -3 * deg, 0, 3 * deg)]), (2, "forest", [box(-0.5 * deg, -3 * deg, 0.5 * deg, 3 * deg)]), (3, "urban", [box(-50, -50, 50, 50)])]
    polygons = spark.createDataFrame([*shapes, shapes[0]], SCHEMA)
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 2 * deg), (3, 70.0, 0.0)], POINTS)
    got = {(r.point_id, r.kind): (r.inside, r.fraction) for r in pg.cover(points, polygons, "kind").collect()}
    h = lambda x: 0.5 - (x * math.sqrt(1 - x * x) + math.asin(x)) / math.pi
    assert got[1, "forest"][0] and got[1, "forest"][1] == pytest.approx(1 - h(0.5), abs=2e-4)
    assert got[1, "urban"] == (True, pytest.approx(1, abs=1e-12)) and got[2, "urban"][0]
    assert (2, "forest") not in got or got[2, "forest"] == (False, pytest.approx(0, abs=1e-12))
    assert not any(p == 3 for p, _ in got)


def test_nearest_points_anywhere(spark):
    """On the whole earth, at the poles and the date line, with features far away, in one place, or in one dense spot."""
    from emberline.operators.radius import EARTH_KM

    def km(a, b, c, d):
        p, q = math.radians(a), math.radians(c)
        x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * EARTH_KM * math.asin(math.sqrt(min(1, max(0, x))))

    rng = random.Random(1)
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(200)] + [(1000 + i, 10 + rng.gauss(0, 0.05), 179.99 + rng.uniform(0, 0.01)) for i in range(50)]
    points += [(2000, 90.0, 0.0), (2001, -90.0, 180.0), (2002, 0.0, -180.0)]
    features = [(i, i, "a", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)] + [(500 + i, i, "b", 40 + rng.gauss(0, 0.001), -100 + rng.gauss(0, 0.001)) for i in range(700)]
    features += [(1500, 9, "c", 10.0, -179.9), (1501, 3, "c", 10.0, -179.9)]
    f = spark.createDataFrame(features, "feature_id long, ord long, kind string, lat_r double, lon_r double")
    p = spark.createDataFrame([*points, (2003, None, 1.0)], POINTS)
    got = {(r.point_id, r.kind): (round(r.distance_km, 5), r.feature_id) for r in nearest(p, f, "kind").collect()}
    want = {}
    for i, y, x in points:
        for kind in "abc":
            d, _, fid = min((km(y, x, b, a), o, fid) for fid, o, k, b, a in features if k == kind)
            want[i, kind] = (round(d, 5), fid)
    assert got == want
    assert nearest(p, f.limit(0), "kind").count() == 0 and nearest(p.limit(0), f, "kind").count() == 0
