"""Golden cases of the scalar library."""

import datetime as dt

import pytest
from emberline.functions import geo, scoring
from emberline.functions.temporal import patterns
from emberline.operators.hotspots import classified
from pyspark.sql import functions as F


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_haversine(spark):
    km = value(spark, geo.haversine_km(F.lit(28.61), F.lit(77.21), F.lit(27.18), F.lit(78.01)))
    assert 170 < km < 210
    assert value(spark, geo.haversine_km(F.lit(0.0), F.lit(179.999), F.lit(0.0), F.lit(-179.999))) < 0.3


@pytest.mark.parametrize(("score", "level"), [(10, "LOW"), (30, "MODERATE"), (50, "ELEVATED"), (70, "HIGH"), (90, "CRITICAL"), (20.5, "LOW"), (40.5, "LOW"), (60.7, "LOW"), (80.99, "LOW")])
def test_levels_with_gaps(spark, score, level):
    assert value(spark, scoring.risk_level(F.lit(float(score)))) == level


def hotspot(spark, **how):
    row = {
        "brightness": 320.0, "frp": 10.0, "n_detections": 3, "persistence_score": 10.0, "pattern": "intermittent", "d_industrial": -1.0, "d_forest": -1.0,
        "d_agriculture": -1.0, "d_settlement": -1.0, "land_cover": "Other", "validation": "NOT VALIDATED", "acq_ts": dt.datetime(2024, 1, 1, 12),
    } | how
    return classified(spark.createDataFrame([tuple(row.values())], list(row))).first()


@pytest.mark.parametrize(
    ("how", "kind"),
    [
        ({"brightness": 380.0, "frp": 90.0, "n_detections": 1, "d_industrial": 0.4}, "Industrial Fire"),
        ({"persistence_score": 70.0, "n_detections": 9, "d_industrial": 1.5, "land_cover": "Industrial"}, "Persistent Industrial Heat Source"),
        ({"brightness": 370.0, "frp": 95.0, "persistence_score": 80.0, "n_detections": 6, "d_industrial": 0.5}, "Gas Flare"),
        ({"d_forest": 1.0, "land_cover": "Forest"}, "Wildfire"),
        ({"d_agriculture": 0.0, "land_cover": "Agriculture"}, "Agricultural Burning"),
        ({}, "Other Thermal Anomaly"),
    ],
)
def test_classes(spark, how, kind):
    row = hotspot(spark, **how)
    assert row.classification == kind
    assert abs(sum(row[f"p{k}"] for k in range(6)) - 1) < 1e-9


def test_critical_fire(spark):
    row = hotspot(spark, brightness=400.0, frp=120.0, persistence_score=40.0, pattern="sudden", n_detections=1, d_industrial=0.8, d_settlement=2.0, d_forest=20.0, d_agriculture=15.0, validation="CONFIRMED")
    assert row.classification == "Industrial Fire" and row.risk > 80 and row.risk_level == "CRITICAL"
    assert abs(row.risk - 87.4) < 0.1


def test_square_with_hole(spark):
    def ring(r):
        return [(-r, -r), (r, -r), (r, r), (-r, r), (-r, -r)]

    kind = "rings array<array<struct<lon:double,lat:double>>>, lon double, lat double"
    rings = [ring(0.1), ring(0.01)]
    rows = [(rings, 0.0, 0.0), (rings, 0.1, 0.0), (rings, 0.05, 0.05), (rings, 0.2, 0.0), (rings, 0.01, 0.0), ([ring(0.1)], 0.0, 0.0)]
    frame = spark.createDataFrame(rows, kind)
    got = [r.v for r in frame.select(geo.polygon_covers("lon", "lat", "rings").alias("v")).collect()]
    assert got == [False, True, True, False, True, True]


def test_patterns(spark):
    hour, now = 3_600_000_000, 10**16
    times = {1: [0], 2: [100], 3: [24 * k for k in range(10)], 4: [24 * 20 * k for k in range(3)]}
    rows = [(k, now - h * hour, now) for k, hours in times.items() for h in hours for _ in range(2)]
    got = {r.key: r for r in patterns(spark.createDataFrame(rows, "key long, us long, now_us long"), "key", 14).collect()}
    assert (got[1].pattern, got[1].persistence_score) == ("sudden", 0.0)
    assert (got[2].pattern, got[2].persistence_score) == ("unknown", 0.0)
    assert got[3].pattern == "persistent" and got[3].persistence_score >= 50 and got[3].n == 10
    assert got[4].n == 1


def test_trend_and_evidence(spark):
    assert value(spark, scoring.trend(F.lit(80.0), F.lit(5), F.lit("persistent"))) == [44.0, 56.0, 70.4, 80.0]
    assert value(spark, scoring.trend(F.lit(33.33), F.lit(1), F.lit("sudden"))) == [33.3]
    assert value(spark, scoring.anomaly_status(scoring.anomaly_score(F.lit(30.0), F.lit(15.0), F.lit(5.0), F.lit(6)))) == "elevated"
    assert value(spark, scoring.anomaly_status(scoring.anomaly_score(F.lit(30.0), F.lit(15.0), F.lit(0.0), F.lit(6)))) == "unavailable"
    assert value(spark, scoring.persistence_status(F.lit(40), F.lit(10.0), F.lit(2.0))) == "persistent_candidate"
