"""Detections connected in space and time, on crowded places and against brute force."""

import random
from math import asin, cos, radians, sin, sqrt

import pytest
from emberline.operators import events, graph, linking
from emberline.operators.events import Clustering

HOUR = 3_600_000_000


def brute(rows, km, width):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for k, (i, lat, lon, us) in enumerate(rows):
        find(i)
        for j, lat2, lon2, us2 in rows[:k]:
            h = sin(radians(lat2 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(lat2)) * sin(radians(lon2 - lon) / 2) ** 2
            if abs(us - us2) <= width and 2 * 6371.0088 * asin(sqrt(min(1, h))) <= km:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


@pytest.mark.parametrize("lat, lon, spread, hours, km, width", [(20, 75, 0.03, 400, 1.0, 24 * HOUR), (0.003, 180.0, 0.02, 200, 1.0, 24 * HOUR), (45, -10, 1.5, 200, 20.0, 6 * HOUR), (89.99, 0, 0.01, 60, 1.0, 24 * HOUR)])
def test_groups_are_those_of_all_pairs(spark, lat, lon, spread, hours, km, width):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        at = min(90.0, lat + rng.gauss(0, spread)), lon + rng.gauss(0, spread) * (1 if lat < 80 else 3000)
        rows.append((k, round(at[0], 3 + k % 5), (round(at[1], 3 + k % 5) + 180) % 360 - 180, int(rng.uniform(-hours, hours) * HOUR)))
    found = linking.groups(spark.createDataFrame(rows, "det_id long, lat double, lon double, acq_us long"), km, width)
    assert {r.det_id: r.component for r in found.collect()} == brute(rows, km, width)


def crowd(n=3000):
    """Detections of 30 days at one place, a kilometre wide."""
    rng = random.Random(5)
    return [(k, 20 + rng.uniform(0, 0.01), 75 + rng.uniform(0, 0.01), int(rng.uniform(0, 720) * HOUR)) for k in range(n)]


def test_crowded_places_make_no_pairs(spark, monkeypatch):
    """3000 detections have some 280,000 pairs within a kilometre and a day; what is stored grows with cells and days."""
    most, kept = [0], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: (out := kept(df, name), most.append(out.count()))[0])
    det = spark.createDataFrame(crowd(), "det_id long, lat double, lon double, acq_us long")
    assert {r.component for r in events.members(det).collect()} == {0}
    assert max(most) < 3000


def test_a_repeated_id_is_one_detection_at_several_places(spark):
    rows = [(1, 10.0, 70.0, 0), (2, 10.0, 70.001, 0), (2, 30.0, 80.0, 0), (3, 30.0, 80.001, HOUR), (4, None, 80.0, HOUR), (5, float("nan"), 80.0, HOUR), (6, 30.0, 80.0, None), (7, 30.0, 80.0, 49 * HOUR)]
    found = events.members(spark.createDataFrame(rows, "det_id long, lat double, lon double, acq_us long"), Clustering())
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 7)]


def test_described_events_leave_no_detections_behind(spark):
    """What ``describe`` stores on its way, rows as many as detections, is deleted when the events are there."""
    import glob

    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    rows = [(*r, 10.0, 300.0, "D", "A") for r in crowd(200)]
    det = spark.createDataFrame(rows, "det_id long, lat double, lon double, acq_us long, frp double, brightness double, daynight string, satellite string")
    member = events.members(det)
    before = set(glob.glob(f"{root}/*"))
    out = events.describe(det, member)
    assert {p.removeprefix("file://") for p in [out.stored_at]} == set(glob.glob(f"{root}/*")) - before
    assert out.first().detection_count == 200
