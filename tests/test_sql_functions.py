"""SQL functions against the column functions; the plan of a filter through one."""

import json
from datetime import datetime

import pytest
from emberline.functions import scoring, sql
from emberline.functions.geo import haversine_km
from pyspark.sql import functions as F


def test_as_columns(spark):
    sql.register(spark)
    rows = [(k * 7.3 % 180 - 90, k * 31.7 % 360 - 180, k * 3.1 % 105 if k % 9 else None, ["Forest", "Urban", "Nowhere", None, "Industrial"][k % 5], ["CONFIRMED", "LIKELY", None, "x"][k % 4], datetime(2024, 1, 1, k % 24, k % 60) if k % 7 else None) for k in range(200)]
    spark.createDataFrame(rows, "lat double, lon double, score double, cover string, status string, ts timestamp").createOrReplaceTempView("places")
    got = spark.sql("SELECT haversine_km(lat, lon, 10D, 20D), risk_level(score), land_cover_code(cover), satellite_score(status), time_of_day(ts) FROM places").collect()
    lit = F.lit
    want = spark.table("places").select(haversine_km("lat", "lon", lit(10.0), lit(20.0)), scoring.risk_level("score"), scoring.land_cover_code("cover"), scoring.satellite_score("status"), scoring.time_of_day("ts")).collect()
    for a, b in zip(got, want, strict=True):
        assert tuple(a)[1:4] == tuple(b)[1:4] and a[0] == pytest.approx(b[0]) and a[4] == pytest.approx(b[4])
    assert tuple(spark.sql("SELECT haversine_km(NULL, 1D, 2D, 3D), risk_level(NULL), time_of_day(NULL)").first()) == (None, "LOW", 0.5)


def test_filters_are_pushed(spark, tmp_path):
    sql.register(spark)
    spark.range(100).selectExpr("id", "cast(id as double) as score").write.parquet(str(tmp_path / "t"))
    spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("scores")
    found = spark.sql("SELECT risk_level(score) AS level FROM scores WHERE score > 80 AND risk_level(score) <> 'LOW'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(score,80.0)" in plan and "PythonUDF" not in plan and "ReadSchema: struct<score:double>" in plan and found.count() > 0


def test_table_function(spark):
    sql.register(spark)
    document = json.dumps({"elements": [{"type": "node", "id": 1, "lat": 1.5, "lon": 2.5, "tags": {"man_made": "mine"}}, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}}]})
    spark.createDataFrame([(1, document), (2, '{"elements": []}'), (3, None)], "k int, document string").createOrReplaceTempView("exports")
    got = spark.sql("SELECT k, e.* FROM exports, LATERAL overpass_elements(document) AS e ORDER BY id").collect()
    assert [tuple(r) for r in got] == [(1, "node", 1, 1.5, 2.5, {"man_made": "mine"}), (1, "way", 2, 3.0, 4.0, None)]
