"""Operators against golden cases and brute force."""

import random

import pytest
from emberline.operators import clean, events
from emberline.operators.graph import components
from emberline.operators.nearness import nearest
from emberline.operators.radius import radius_join
from emberline.streaming.ratelimit import limited_batch
from math import asin, cos, radians, sin, sqrt

HOUR = 3_600_000_000


def km(a, b):
    (p, q), (r, s) = a, b
    h = sin(radians(r - p) / 2) ** 2 + cos(radians(p)) * cos(radians(r)) * sin(radians(s - q) / 2) ** 2
    return 2 * 6371.0088 * asin(sqrt(min(1, h)))


def test_radius_join_everywhere(spark):
    rng = random.Random(1)
    left = [(i, rng.choice([rng.uniform(-90, 90), 89.99, -90.0, 0.0]), rng.choice([rng.uniform(-180, 180), 180.0, -180.0])) for i in range(80)]
    right = [(i, max(-90.0, min(90.0, p[1] + rng.uniform(-2, 2))), (p[2] + rng.uniform(-2, 2) + 180) % 360 - 180) for i, p in enumerate(left * 2)]
    a = spark.createDataFrame(left, "l long, lat double, lon double")
    b = spark.createDataFrame(right, "r long, lat_r double, lon_r double")
    for most in (1.0, 150.0, 9000.0, 20016.0):
        got = sorted((x.l, x.r) for x in radius_join(a, b, most, most).collect())
        want = sorted((x[0], y[0]) for x in left for y in right if km(x[1:], y[1:]) <= most)
        assert got == want


def test_nearest_rings(spark):
    points = spark.createDataFrame([(1, 0.0, 80.0), (2, 60.0, -100.0)], "point_id long, lat double, lon double")
    features = spark.createDataFrame([(7, 7, "a", 1.0, 80.0), (8, 8, "a", 0.0, 80.5), (9, 9, "b", 59.0, -100.0), (10, 10, "b", 59.0, -100.0)], "feature_id long, ord long, kind string, lat_r double, lon_r double")
    got = {(r.point_id, r.kind): r.feature_id for r in nearest(points, features, "kind").collect()}
    assert got == {(1, "a"): 8, (1, "b"): 9, (2, "a"): 7, (2, "b"): 9}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    assert got == {v: find(v) for a, b in pairs for v in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_long_paths(spark):
    """Rising, falling and in random order, all in one list: the rounds are those of the slowest."""
    mixed = random.Random(3).sample(range(2000, 3000), 1000)
    pairs = [(k, k + 1) for k in range(999)] + [(k + 1, k) for k in reversed(range(1000, 1999))] + list(zip(mixed, mixed[1:]))
    rounds: list[int] = []
    found = components(spark.createDataFrame(pairs, "a long, b long"), finish=0, rounds=rounds)
    assert sorted(found.groupBy("component").count().collect()) == [(0, 1000), (1000, 1000), (2000, 1000)]
    assert len(rounds) <= 12


def test_components_by_contraction_and_in_one_task_agree(spark):
    rng = random.Random(5)
    pairs = [(f"v{rng.randrange(90):02}", f"v{rng.randrange(90):02}") for _ in range(70)] + [("hub", f"v{k:02}") for k in range(80, 90)]
    edges = spark.createDataFrame(pairs, "a string, b string")
    assert sorted(components(edges, finish=0).collect()) == sorted(components(edges).collect())


SCHEMA = "det_id long, lat double, lon double, acq_us long, frp double, brightness double, daynight string, satellite string"


def test_events_at_the_date_line(spark):
    rows = [(1, 0.0, 179.999, 0, 10.0, 330.0, "D", "A"), (2, 0.0, -179.999, HOUR // 2, 20.0, None, "N", "B"), (3, 0.0, 179.999, 48 * HOUR, 5.0, 300.0, None, "A")]
    det = spark.createDataFrame(rows, SCHEMA)
    found = {r.component: r for r in events.describe(det, events.members(det)).collect()}
    first = found[1]
    assert sorted(found) == [1, 3]
    assert (first.detection_count, first.mean_frp, first.std_frp, first.duration_minutes, first.satellite) == (2, 15.0, 5.0, 30.0, "A|B")
    assert first.spatial_radius_km < 0.2 and abs(first.lon) > 179
    shuffled = {r.event_id for r in events.describe(det.orderBy("acq_us"), events.members(det.repartition(3))).collect()}
    assert shuffled == {r.event_id for r in found.values()}
    with pytest.raises(ValueError):
        events.Clustering(km=0)


def test_history_is_past_only(spark):
    day = 24 * HOUR
    start = 200 * day
    rows = [(1, 0.0, 0.0, start - 2 * day, 10.0, 300.0, "D", "A"), (2, 0.0, 0.0, start - day, 20.0, 300.0, "N", "A"), (3, 0.0, 0.0, start, 999.0, 300.0, "D", "A"), (4, 0.0, 0.0, start + day, 999.0, 300.0, "D", "A")]
    event = spark.createDataFrame([(9, "EV", 0.0, 0.0, start, 30.0)], "component long, event_id string, lat double, lon double, start_us long, mean_frp double")
    r = events.history(event, spark.createDataFrame(rows, SCHEMA)).first()
    assert (r.detections_7d, r.historical_mean_frp, r.frp_z_score, r.time_since_previous_detection, r.active_days_7d) == (2, 15.0, 3.0, 24.0, 2)
    assert r.spatial_location_variance == 0


def test_leakage_groups(spark):
    rows = [(0, 22.0, 70.0, 7.0, None), (1, 22.1, 70.0, 7.0, None), (2, 24.0, 70.0, 0.0, 5), (3, 40.0, 10.0, 0.0, 5), (4, -30.0, 10.0, 0.0, None)]
    frame = spark.createDataFrame(rows, "component long, lat double, lon double, extent double, facility_id long")
    assert {r.component: r.group for r in events.leakage_groups(frame).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_cleaning(spark):
    header = ["source_row", " Latitude", "longitude ", "acq_date", "acq_time", "bright_ti4", "frp", "daynight"]
    rows = [
        (2, "10", "20", "2025-06-06", "0035", "330", "5", "night"),
        (3, "10", "20", "2025-06-06", "35.0", "330", "5", "N"),
        (4, "91", "20", "2025-06-06", "0100", "330", "5", "D"),
        (5, "10", "20", "2025-06-06", "2461", "330", "5", "D"),
        (6, "10", "20", "2025-06-06", "1200", "", None, "x"),
        (7, "10", "nan", "2025-06-06", "1200", "-1", "-3", "x"),
    ]
    tagged = clean.tagged(spark.createDataFrame(rows, ", ".join(f"`{h}` {'long' if h == 'source_row' else 'string'}" for h in header)))
    ok = {r.source_row: r for r in clean.accepted(tagged).collect()}
    assert sorted(ok) == [2, 6]
    assert ok[2].acquisition_us == 1749170100000000 and ok[2].brightness == 330.0 and ok[2].daynight == "N" and len(ok[2].detection_id) == 24
    assert ok[6].brightness is None and ok[6].daynight is None
    bad = {r.source_row: r.validation_errors for r in clean.rejected(tagged).collect()}
    assert bad == {3: "duplicate", 4: "invalid:latitude", 5: "invalid:acquisition_time", 7: "invalid:longitude;invalid:frp;invalid:brightness"}
    counts = clean.report(tagged).first()
    assert (counts.input_rows, counts.accepted, counts.rejected, counts.duplicates) == (6, 2, 4, 1)
    with pytest.raises(ValueError):
        clean.normalized_names(spark.createDataFrame([(1, 2)], "a int, ` A` int"))


def test_rate_limit(spark):
    rows = [(1, k, at) for k, at in enumerate([0, 100, 250, 299, 300, 650])] + [(2, 9, 5)]
    got = {r.id: r.sent for r in limited_batch(spark.createDataFrame(rows, "recipient long, id long, at long"), 300).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: True, 5: True, 9: True}


def test_zone_by_id(spark):
    """A zone that isn't one, or doesn't exist, is an error."""
    from emberline.plans.events import zone_detail

    for zone in (10**12, -1):
        with pytest.raises(LookupError, match="no zone"):
            zone_detail(spark, "/root/testdata/sf0.001", zone)
