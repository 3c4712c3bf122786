import hashlib
import json
import math
import os
import random
import time

import pytest
from emberline.operators import clean
from emberline.operators.polygons import cover, nearest_polygon
from emberline.operators.series import sums_before
from emberline.sources.files import inline, observations
from emberline.sources.reference import geojson_points, layer, load_bundle, overpass_features, reference_bundle
from emberline.streaming.ingest import SCHEMA, Reference, alerts, current, ingest, late_rows, past_times, sessions, windowed_counts
from emberline.streaming.ratelimit import limited_batch, limited_stream
from pyspark.sql import functions as F


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("latitude,longitude,acq_date,acq_time,frp\n10,20,2025-01-01,0035,1\n10,20,2025-01-01,0035,1\n")
    (tmp_path / "b.csv").write_text("latitude,longitude,acq_date,acq_time,brightness\n,20,2025-01-01,0100,300\n11,20,2025-01-01,0100,300\n")
    paths = [str(tmp_path / "b.csv"), str(tmp_path / "a.csv"), str(tmp_path / "a.csv")]
    rows = observations(spark, paths, ("latitude", "longitude"))
    got = [(r.input_file.rsplit("/")[-1], r.input_row, r.input_sha256) for r in rows.orderBy("source_row").collect()]
    sha = {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ("a.csv", "b.csv")}
    assert got == [(n, k, sha[n]) for n in ("a.csv", "b.csv") for k in (2, 3)]
    counts = clean.report(clean.tagged(rows.drop("input_file", "input_row", "input_sha256"))).first()
    assert (counts.input_rows, counts.accepted, counts.duplicates, counts.missing_coordinates) == (4, 2, 1, 1)
    for paths, needed in ((["x.txt"], ()), ([], ()), (paths, ("frp",))):
        with pytest.raises(ValueError):
            observations(spark, paths, needed)


def test_rows_are_counted_over_a_file_in_many_blocks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,latitude\n" + "".join(f"{k},{k}\n" for k in range(5000)))
    (tmp_path / "b.csv").write_text("k,input_row\n1,2\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = observations(spark, [str(tmp_path / "a.csv")]).select("k", "input_row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((int(r.k), r.input_row) for r in rows) == [(k, k + 2) for k in range(5000)]
    with pytest.raises(ValueError):
        observations(spark, [str(tmp_path / "b.csv")])


def test_inline_feeds(spark):
    """Any order of columns, quotes, CRLF, byte order marks, missing and unknown columns; empty and null texts have no rows."""
    texts = [(1, '\ufeffA,b\r\n1,"x, y"\r\n\r\n2,\r\n'), (2, "B,z,A\n3,4,5"), (3, "a\n7"), (4, "a,b\n"), (5, ""), (6, None)]
    got = inline(spark.createDataFrame(texts, "feed long, body string"), "feed", "body", ("a", "b")).collect()
    assert sorted(tuple(r) for r in got if r.feed != 1 or r.line == 2) == sorted([(1, 2, "1", "x, y"), (2, 2, "5", "3"), (3, 2, "7", None)])
    assert {(r.line, r.a) for r in got if r.feed == 1} == {(2, "1"), (4, "2")}


def test_layer_of_a_role(spark, tmp_path):
    features = [
        feature("a", "forest", "Polygon", [square(0, 0)]),
        feature("b", "forest", "Point", [1, 1]),
        feature("c", "road", "LineString", [[0, 0], [1, 1]]),
        feature("d", None, "Point", [1, 1]),
    ]
    (tmp_path / "l.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    named = lambda role, name="l.json": sorted(r.feature_id for r in layer(spark, str(tmp_path / name), role).collect())
    assert (named("landcover"), named("transport"), named("water"), named("landcover", "none.json")) == (["a"], ["c"], [], [])


def test_sums_before_a_time(spark):
    rng = random.Random(3)
    times = [rng.choice([None, rng.randrange(-3 * 10**11, 3 * 10**11), rng.randrange(3) * 60_000_000]) for _ in range(400)]
    frame = spark.createDataFrame([(t, 1) for t in times], "us long, w long")
    known = [t for t in times if t is not None]
    assert {r.us: r.before for r in sums_before(frame, "us", "w").collect()} == {t: sum(x < t for x in known) for t in known}
    assert sums_before(frame.limit(0), "us", "w").collect() == []


def test_reference_layers(spark, tmp_path):
    point = {"type": "Feature", "id": "f1", "properties": {"category": "factory", "name": "A"}, "geometry": {"type": "Point", "coordinates": [7792364.355529151, 2511525.234845713]}}
    other = {"type": "Feature", "properties": {"infra_type": "mine"}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}}
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [point, other]}))
    row = geojson_points(spark, str(tmp_path / "g.json"), "EPSG:3857").collect()
    assert len(row) == 1 and abs(row[0].lon - 70) < 1e-6 and abs(row[0].lat - 22) < 1e-3
    ring = [{"lat": a, "lon": b} for a, b in ((0, 0), (0, 1), (1, 1), (0, 0))]
    elements = [
        {"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"power": "plant"}},
        {"type": "way", "id": 2, "center": {"lat": 1.0, "lon": 2.0}, "tags": {"industrial": "factory"}},
        {"type": "way", "id": 3, "geometry": ring, "tags": {"landuse": "industrial"}},
        {"type": "node", "id": 4, "lat": 1.0, "lon": 2.0, "tags": {"shop": "kiosk"}},
        {"type": "way", "id": 5, "geometry": ring[:3], "center": {"lat": 1.0, "lon": 2.0}, "tags": {"man_made": "mine"}},
        {"type": "way", "id": 6, "center": {"lat": 1.0, "lon": 2.0}, "tags": {"landuse": "forest"}},
        {"type": "relation", "id": 7, "tags": {"industrial": "refinery"}},
        {"type": "node", "id": 8, "lat": 1.0, "lon": 2.0},
    ]
    (tmp_path / "o.json").write_text(json.dumps({"elements": elements}))
    good, bad = overpass_features(spark, str(tmp_path / "o.json"))
    assert {r.feature_id: (r.category, r["shape"], r.center_only) for r in good.collect()} == {"node/1": ("power_plant", "Point", False), "way/2": ("factory", "Point", True), "way/3": ("industrial_area", "Polygon", False)}
    unknown = "UNKNOWN_FACILITY_TYPE"
    assert dict(tuple(r) for r in bad.collect()) == {"node/4": unknown, "way/5": "OPEN_WAY_REQUIRES_EXPLICIT_GEOMETRY", "way/6": unknown, "relation/7": "MISSING_OR_UNASSEMBLED_GEOMETRY", "node/8": unknown}


def square(x, y, size=1.0):
    return [[x, y], [x + size, y], [x + size, y + size], [x, y + size], [x, y]]


def feature(id_, category, shape, coordinates):
    return {"type": "Feature", "id": id_, "properties": {"category": category}, "geometry": {"type": shape, "coordinates": coordinates}}


def test_reference_bundle(spark, tmp_path):
    plants = [
        feature("a", "refinery", "Polygon", [square(0, 0), square(0.25, 0.25, 0.5)]),
        feature("b", "works", "Point", [5, 5]),
        feature("a", "mine", "Point", [6, 6]),
        feature("", "mine", "Point", [6, 6]),
        feature("c", "office", "Point", [6, 6]),
        feature("d", "mine", "Point", [600, 6]),
        feature("e", "forest", "Polygon", [square(0, 0)]),
    ]
    land = [feature("f", "forest", "MultiPolygon", [[square(0, 0)], [square(3, 3)]]), feature("b", "forest", "Polygon", [square(0, 0)]), feature("g", "urban", "Point", [1, 1])]
    for name, features in (("p", plants), ("l", land)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    common = {"source": "survey", "version": 1, "crs": "EPSG:4326"}
    layers = [
        {"name": "plants", "role": "industrial", "path": str(tmp_path / "p.json"), "category_map": {"works": "factory", "office": None}, **common},
        {"name": "land", "role": "landcover", "path": str(tmp_path / "l.json"), **common},
    ]
    good, audit = reference_bundle(spark, layers)
    assert sorted((r.feature_id, r.category) for r in good.collect()) == [("a", "refinery"), ("b", "factory"), ("f", "forest"), ("f", "forest")]
    a = good.filter("feature_id = 'a'").first()
    assert 0 < a.lat < 0.25 and 0 < a.lon < 1 and len(a.rings) == 2
    assert sorted((r.layer, r.feature_id, r.reason) for r in audit.collect()) == [
        ("land", "b", "DUPLICATE_FEATURE_ID"), ("land", "g", "POLYGON_REQUIRED"), ("plants", "", "MISSING_STABLE_FEATURE_ID"), ("plants", "a", "DUPLICATE_FEATURE_ID"),
        ("plants", "c", "EXPLICIT_OUT_OF_SCOPE_MAPPING"), ("plants", "d", "OUT_OF_BOUNDS"), ("plants", "e", "UNKNOWN_OR_WRONG_ROLE_CATEGORY"),
    ]
    with pytest.raises(ValueError):
        reference_bundle(spark, [{**layers[0], "role": "roof"}])


def test_bundle_with_coverage(spark, tmp_path):
    """Coverages of layers unite; the hash follows content and reading, not the layout of a file; what is wrong is refused by name."""
    place = lambda c: {"type": "Polygon", "coordinates": [c]}
    land = {"type": "FeatureCollection", "features": [feature("f", "forest", "Polygon", [square(0, 0)])], "available_categories": ["urban"], "coverage": {"forest": place(square(-1, -1, 2)), "urban": {"type": "MultiPolygon", "coordinates": [[square(0, 0)], [square(5, 5)]]}}}
    more = {"type": "FeatureCollection", "features": [feature("h", "forest", "Polygon", [square(2, 2)])], "coverage": {"forest": place(square(0.5, -1, 3))}}
    bundle = lambda name, *documents, **how: load_bundle(spark, [layer_of(name, k, d) for k, d in enumerate(documents)], **how)

    def layer_of(name, k, document, indent=None):
        (tmp_path / f"{name}{k}.json").write_text(json.dumps(document, indent=indent))
        return {"name": f"layer {k}", "role": "landcover", "path": str(tmp_path / f"{name}{k}.json"), "source": "s", "version": 1, "crs": "EPSG:4326"}

    found = bundle("a", land, more)
    assert found.available == ["forest", "urban"] and sorted(r.kind for r in found.coverage.collect()) == ["forest", "forest", "urban", "urban"] and len(found.layers) == 2
    points = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.5, 3.4), (3, 0.5, 3.6)], "point_id long, lat double, lon double")
    seen = {r.point_id: r.fraction for r in cover(points, found.coverage, "kind").collect() if r.kind == "forest"}
    assert seen[1] == pytest.approx(1) and seen[2] == pytest.approx(1) and 3 not in seen
    again = load_bundle(spark, [layer_of("b", k, d, indent=3) for k, d in enumerate((land, more))])
    assert again.sha256 == found.sha256 and again.layers == found.layers
    changed = {**more, "coverage": {"forest": place(square(0.5, -1, 3.5))}}
    others = {bundle("c", land, changed).sha256, bundle("d", more, land).sha256, load_bundle(spark, [{**layer_of("e", k, d), "version": 2} for k, d in enumerate((land, more))]).sha256}
    assert len(others | {found.sha256}) == 4
    wrong = {**more, "features": [feature("h", "forest", "Point", [1, 1])]}
    for document, reason in (({**more, "coverage": {"urban": place(square(0, 0))}}, "doesn't have: urban"), ({**more, "coverage": {"forest": {"type": "Point", "coordinates": [1, 1]}}}, "must be polygons"), ({**more, "available_categories": ["moon"]}, "unknown categories moon"), (wrong, "1 in layer 0: POLYGON_REQUIRED")):
        with pytest.raises(ValueError, match=reason):
            bundle("x", document)
    assert bundle("x", wrong | {"coverage": {}}, strict=False).features.count() == 0
    with pytest.raises(ValueError, match="needs layers"):
        load_bundle(spark, [])


def test_polygons_and_cover(spark):
    """A hole counts as outside, overlapping polygons once; distances are those of the plane at the point."""
    corners = lambda ring: [(float(x), float(y)) for x, y in ring]
    shapes = spark.createDataFrame(
        [(1, "forest", [corners(square(10, 10)), corners(square(10.4, 10.4, 0.2))]), (2, "forest", [corners(square(10, 10))]), (3, "urban", [corners(square(20, 0))])],
        "feature_id long, kind string, rings array<array<struct<lon:double,lat:double>>>",
    )
    points = spark.createDataFrame([(1, 10.5, 10.5), (2, 10.2, 10.2), (3, 10.5, 11.001), (4, 10.5, 11.5)], "point_id long, lat double, lon double")
    only = shapes.filter("feature_id = 1")
    near = {r.point_id: r.distance_km for r in nearest_polygon(points, only, "kind").collect()}
    assert near[2] == 0 and abs(near[1] - 0.1 * 111.195 * math.cos(math.radians(10.5))) < 0.05 and abs(near[4] - 0.5 * 111.195 * math.cos(math.radians(10.5))) < 0.05
    found = {r.point_id: (r.inside, r.fraction) for r in cover(points, only, "kind").collect()}
    assert found[2] == (True, pytest.approx(1)) and 1 not in found  # nothing within a kilometre
    assert found[3][0] is False and 0.4 < found[3][1] < 0.5
    both = {r.point_id: (r.inside, r.fraction) for r in cover(points, shapes.filter("kind = 'forest'"), "kind").collect()}
    assert both[2] == (True, pytest.approx(1)) and both[1] == (True, pytest.approx(1))


def test_stream_ends_as_the_batch(spark, tmp_path):
    """Repeats update, new detections are scored and alerted on once, also if a batch runs again; nothing new changes nothing."""
    us = 1_704_103_200_000_000
    row = lambda k, site, brightness, frp: (k, site, us + k * 60_000_000, 10.0, 20.0, frp, brightness, "D", "N20", 0.5, "s", "d")
    first = [row(k, k % 3, 300.0 + k, 10.0) for k in range(25)] + [row(3, 0, 301.0, 9.0)]
    second = [row(k, k % 3, 340.0, 11.0) for k in range(20, 30)] + [row(30, 7, 400.0, 200.0), row(31, 8, None, 5.0), (None, *row(32, 8, 300.0, 5.0)[1:])]
    features = spark.createDataFrame([(1, 1, "refinery", 10.0, 20.0), (2, 2, "settlement", 10.01, 20.0)], "feature_id long, ord long, category string, lat_r double, lon_r double")
    covers = spark.createDataFrame([("forest", 0.0, 1.0, 0.0, 1.0)], "kind string, south double, north double, west double, east double")
    reference = Reference(features, covers, spark.createDataFrame([(7, "CONFIRMED")], "site_id long, validation string"))
    store = str(tmp_path / "store")
    for part in (first, second):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark, str(tmp_path / "in"), store, reference, str(tmp_path / "cp"), least_risk=30.0).awaitTermination()
    ingest(spark, str(tmp_path / "in"), store, reference, str(tmp_path / "cp"), least_risk=30.0).awaitTermination()

    def state():
        held = {r.det_id: (r.brightness, r.frp, r.batch) for r in current(spark, store).collect()}
        scored = {r.det_id: (r.batch, r.n_detections, r.validation) for r in spark.read.parquet(f"{store}/scored").collect()}
        return held, scored, sorted((r.batch, r.code, r.site_id) for r in alerts(spark, store).collect())

    held, scored, due = state()
    assert sorted(held) == list(range(32)) and held[22] == (340.0, 11.0, 0) and held[4] == (304.0, 10.0, 0) and held[31] == (None, 5.0, 1)
    assert sorted(scored) == list(range(31)) and scored[30] == (1, 1, "CONFIRMED") and scored[29][:2] == (1, 10)
    assert any(site == 7 for _, _, site in due) and [c for _, c, _ in due] == [f"AL-{k:04d}" for k in range(1, len(due) + 1)]
    os.remove(tmp_path / "cp" / "commits" / "1")  # as if the last batch hadn't ended: it runs again
    for crc in (tmp_path / "cp" / "commits").glob(".1.crc"):
        os.remove(crc)
    ingest(spark, str(tmp_path / "in"), store, reference, str(tmp_path / "cp"), least_risk=30.0).awaitTermination()
    assert state() == (held, scored, due)
    notices = spark.read.parquet(f"{store}/notices").collect()
    assert {r.batch: int(r.title.split()[0]) for r in notices} == {b: sum(x == b for x, _, _ in due) for b in {x for x, _, _ in due}}
    counts = windowed_counts(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    query = counts.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(r.n for r in spark.table("daily").collect()) == len(first) + len(second)


def test_a_batch_reads_its_own_rows_only(spark, tmp_path):
    """Each batch is handed its own ids whatever came before, and of the history only the days that it looks back to."""
    day = 86_400_000_000
    row = lambda k, day_: (k, k % 5, day_ * day + k, 10.0, 20.0, 5.0, 310.0, "D", "N20", 0.5, "s", "d")
    features = spark.createDataFrame([(1, 1, "refinery", 10.0, 20.0), (2, 2, "settlement", 10.01, 20.0)], "feature_id long, ord long, category string, lat_r double, lon_r double")
    covers = spark.createDataFrame([("forest", 0.0, 1.0, 0.0, 1.0)], "kind string, south double, north double, west double, east double")
    reference = Reference(features, covers, spark.createDataFrame([], "site_id long, validation string"))
    store, cp = str(tmp_path / "store"), str(tmp_path / "cp")
    for k, days in enumerate((range(100, 160), [160, 161], [161, 162])):
        rows = [row(100 * d + j, d) for d in days for j in range(20)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark, str(tmp_path / "in"), store, reference, cp, least_risk=101.0, least_confidence=2.0).awaitTermination()
        taken = spark.read.parquet(f"{store}/log/batch={k}")
        assert taken.count() == len(rows) and taken.filter("created").count() == (20 if k == 2 else len(rows))
    assert current(spark, store).count() == 63 * 20
    back = past_times(spark, store, 2, 148 * day, 162 * day)
    assert back.count() == 14 * 20
    scan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "day" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    times = [(r[1], r[2]) for d in range(100, 163) for r in (row(100 * d + j, d) for j in range(20))]
    scored = spark.read.parquet(f"{store}/scored/batch=2").collect()
    assert len(scored) == 20 and all(r.n_detections == sum(s == r.site_id and r.acq_us - 14 * day <= us <= r.acq_us for s, us in times) for r in scored)
    waiting = ingest(spark, str(tmp_path / "in"), store, reference, cp, seconds=1)
    try:
        assert ingest(spark, str(tmp_path / "in"), store, reference, cp) is not None and len([q for q in spark.streams.active if q.name == store]) == 1
    finally:
        waiting.stop()


def test_sessions_and_sliding_windows_as_the_batch(spark, tmp_path):
    """Shuffled and late rows in six batches; one row comes after its watermark: left out, and counted."""
    hour = 3_600_000_000
    rng = random.Random(5)
    rows = [(k, k % 4, int(rng.uniform(0, 400) * hour), 1.0, 2.0, float(k), 300.0, "D", "s", 0.5, "s", "d") for k in range(300)]
    rows.sort(key=lambda r: r[2] + rng.uniform(0, 20) * hour)
    too_late = (900, 1, 2 * hour, 1.0, 2.0, 9.0, 300.0, "D", "s", 0.5, "s", "d")
    end = (901, 99, 9000 * hour, 1.0, 2.0, 9.0, 300.0, "D", "s", 0.5, "s", "d")
    source = str(tmp_path / "in")
    for part in (*[rows[k : k + 60] for k in range(0, 300, 60)], [too_late], [end], [(902, *end[1:])]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files are read in the order of their times, which have seconds
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    whole = spark.createDataFrame(rows, SCHEMA)
    for name, made in (("sessions", lambda x: sessions(x, "1 day", "6 hours")), ("slides", lambda x: windowed_counts(x, "1 day", "12 hours", "4 hours"))):
        query = made(stream()).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        got = sorted(tuple(r) for r in spark.table(name).collect() if r.site_id != 99)
        assert got == sorted(tuple(r) for r in made(whole).collect())
        assert late_rows(query) == (1 if name == "sessions" else 3)  # a row lies in three sliding windows


def test_limit_over_many_batches(spark):
    """One recipient with most rows, ties in time, several Arrow batches; a row without recipient or time is never sent."""
    rng = random.Random(4)
    rows = [(1 if k % 3 else k % 7 + 2, k, rng.randrange(9000)) for k in range(600)] + [(None, 900, 5), (1, 901, None)]
    last, want = {}, {900: False, 901: False}
    for who, k, at in sorted((r for r in rows if None not in r), key=lambda r: (r[2], r[1])):
        want[k] = who not in last or at - last[who] >= 50
        last[who] = at if want[k] else last[who]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {r.id: r.sent for r in limited_batch(spark.createDataFrame(rows, "recipient long, id long, at long"), 50).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_limit_as_a_stream(spark, tmp_path):
    rows = [(1, k, at) for k, at in enumerate([0, 100, 299, 300, 650])] + [(None, 7, 5), (1, 8, None)]
    schema = "recipient long, id long, at long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    query = limited_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 300).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.id: r.sent for r in spark.table("limited").collect()} == {0: True, 1: False, 2: False, 3: True, 4: True, 7: False, 8: False}
