"""Feature collections in chunks against the parser of whole documents."""

import json
import os
import random

import pytest
from emberline.sources import collections
from emberline.sources.reference import geojson_features


def member(rng, k):
    odd = ["}", "{", '"', "\\", '\\"}', "[", "]", '"features":[{', "é}", ",", "\\\\", "plain", ""]
    properties = {"name": "".join(rng.choice(odd) for _ in range(rng.randint(0, 6))), "category": rng.choice(["forest", "urban", None]), "nested": {"features": [{"id": "no"}, {}], "x": {}}}
    shape = rng.choice(["Point", "Polygon", "MultiPolygon", None])
    ring = [[rng.uniform(0, 5), rng.uniform(0, 5)] for _ in range(rng.randint(1, 40))]
    at = {"Point": ring[0], "Polygon": [ring, ring[:3]], "MultiPolygon": [[ring], [ring[:4]]]}.get(shape)
    return {"type": "Feature", "id": f"f{k}", "properties": properties, "geometry": {"type": shape, "coordinates": at} if shape else None}


def write(path, features, before=(), after=(), indent=None, end="", ascii=True):
    path.write_text(json.dumps({"type": "FeatureCollection", **dict(before), "features": features, **dict(after)}, indent=indent, ensure_ascii=ascii) + end)
    return str(path)


def both(spark, monkeypatch, path, chunk=64, part=4096):
    monkeypatch.setattr(collections, "WHOLE_BYTES", 1 << 40)
    whole = geojson_features(spark, path).collect()
    monkeypatch.setattr(collections, "WHOLE_BYTES", -1)
    monkeypatch.setattr(collections, "CHUNK_BYTES", chunk)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(part))
    try:
        got = geojson_features(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    key = lambda r: (r.place, str(r))
    return sorted(got, key=key), sorted(whole, key=key)


BEFORE = (("bbox", [1, [2], [[3, {"a": {}}]]]), ("crs", {"type": "name", "properties": {"features": [{"id": "crs"}]}}), ("list", [{"id": "other"}, [{"id": "x"}]]))
AFTER = (("coverage", {"forest": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}), ("notes", [{"id": "after"}, "} \" {"]))


@pytest.mark.parametrize("chunk", [1, 64, 3000])
def test_same_rows(spark, tmp_path, monkeypatch, chunk):
    rng = random.Random(chunk)
    path = write(tmp_path / "c.geojson", [member(rng, k) for k in range(120)], BEFORE, AFTER, *((1, "\n") if chunk == 64 else (None, "")), ascii=chunk != 3000)
    assert os.path.getsize(path) > 16384
    got, want = both(spark, monkeypatch, path, chunk)
    assert len(want) >= 120 and got == want
    assert {r.feature_id for r in got} == {f"f{k}" for k in range(120)}


def test_small_documents(spark, tmp_path, monkeypatch):
    for k, features in enumerate([[], [{}], [{"id": "a"}], [{"id": "a"}, {"id": "b", "properties": {"name": "}"}}]]):
        got, want = both(spark, monkeypatch, write(tmp_path / f"{k}.json", features), 1)
        assert got == want and len(got) == len(features)
    monkeypatch.setattr(collections, "WHOLE_BYTES", -1)
    path = tmp_path / "odd.json"
    path.write_text('{"features": ["{", {"id": "a"}, [{"id": "no"}], null, {"id": "b"}]}')
    assert [(r.place, r.feature_id) for r in geojson_features(spark, str(path)).orderBy("place").collect()] == [(0, "a"), (1, "b")]
    path.write_text('{"features": [{"id": "a"}, {"id": "b"}')
    with pytest.raises(ValueError, match="not a whole document"):
        geojson_features(spark, str(path))


def test_several_tasks_read_a_document(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    path = write(tmp_path / "large.geojson", [member(rng, k) for k in range(800)])
    got, want = both(spark, monkeypatch, path, 20000, 65536)
    assert got == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
