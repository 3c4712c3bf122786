"""Artifacts: each tampered part is refused by its own reason, imports are whole and repeatable, training is gated and rebuilt."""

from datetime import datetime

import pytest
from emberline.operators import artifacts, dataset
from pyspark.sql import functions as F

NOW = datetime(2024, 6, 1)
LABELS = ("a", "b", "c")


def tables(spark, first=0, n=300):
    """Clean detections, memberships and typed events of two detections each."""
    events = spark.range(first, first + n).select(
        F.format_string("EV-%05d", "id").alias("event_id"), F.lit(datetime(2024, 1, 1)).alias("start_time"), F.lit(datetime(2024, 1, 2)).alias("end_time"),
        (10 + F.col("id") % 20).cast("double").alias("centroid_latitude"), F.lit(75.0).alias("centroid_longitude"), F.lit(2).cast("long").alias("detection_count"), (F.col("id") % 17).cast("double").alias("mean_frp"),
    )
    clean = spark.range(2 * first, 2 * (first + n)).select(F.concat(F.lit("d"), "id").alias("detection_id"), F.col("id").cast("double").alias("frp"))
    members = spark.range(2 * first, 2 * (first + n)).select(F.concat(F.lit("d"), "id").alias("detection_id"), F.format_string("EV-%05d", F.floor(F.col("id") / 2)).alias("event_id"))
    return clean, members, dataset.typed(events)


def reference(spark):
    return spark.createDataFrame([("f1", "refinery", 10.0, 75.0)], "feature_id string, category string, lat double, lon double")


def rewritten(spark, folder, part, change):
    """A part changed behind the manifest's back."""
    path = f"{folder}/{part}"
    rows = change(spark.read.parquet(path))
    spark.createDataFrame(rows.collect(), rows.schema).write.mode("overwrite").parquet(path)


def test_tampered_parts(spark, tmp_path):
    parts = tables(spark, n=20)
    changes = {
        "clean": lambda r: r.withColumn("frp", F.when(F.col("detection_id") == "d7", 1e6).otherwise(F.col("frp"))),
        "membership": lambda r: r.withColumn("event_id", F.when(F.col("detection_id") == "d7", "EV-00000").otherwise(F.col("event_id"))),
        "events": lambda r: r.filter("event_id <> 'EV-00003'"),
        "reference": lambda r: r.withColumn("lat", F.lit(11.0)),
    }
    for part, change in changes.items():
        folder = str(tmp_path / part)
        made = artifacts.build(spark, folder, *parts, reference(spark), {"history_km": 1.0})
        assert made["parts"]["events"]["rows"] == 20 and len(made["schema"]) == 69 and artifacts.read_json(spark, f"{folder}/manifest") == made
        assert artifacts.verify(spark, folder) == []
        rewritten(spark, folder, part, change)
        assert artifacts.verify(spark, folder) == [f"STALE_{part.upper()}"]
        with pytest.raises(ValueError, match=f"STALE_{part.upper()}"):
            artifacts.import_events(spark, folder, str(tmp_path / "store"))
    assert artifacts.verify(spark, str(tmp_path / "nowhere")) == ["MISSING_MANIFEST"] and artifacts.imported(spark, str(tmp_path / "store"), "events") is None


def test_broken_memberships(spark, tmp_path):
    clean, members, events = tables(spark, n=20)
    row = lambda d, e: spark.createDataFrame([(d, e)], members.schema)
    broken = {
        "REPEATED_DETECTION": (clean, members.unionByName(row("d7", "EV-00003")), events.withColumn("detection_count", F.when(F.col("event_id") == "EV-00003", 3).otherwise(F.col("detection_count")).cast("long"))),
        "MEMBERS_OF_UNKNOWN_EVENTS": (clean, members, events.filter("event_id <> 'EV-00003'")),
        "EVENTS_WITHOUT_MEMBERS": (clean.filter("detection_id not in ('d6', 'd7')"), members.filter("event_id <> 'EV-00003'"), events),
        "DETECTION_COUNTS_MISMATCH": (clean.filter("detection_id <> 'd7'"), members.filter("detection_id <> 'd7'"), events),
        "DETECTIONS_MISMATCH": (clean.filter("detection_id <> 'd7'"), members, events),
        "INVALID_EVENT_TABLE: coordinates": (clean, members, events.withColumn("centroid_latitude", F.lit(99.0))),
    }
    for reason, parts in broken.items():
        folder = str(tmp_path / reason.split(":")[0])
        artifacts.build(spark, folder, *parts)
        assert artifacts.verify(spark, folder) == [reason]


def test_imports(spark, tmp_path):
    store, a, b, c = (str(tmp_path / x) for x in ("store", "a", "b", "c"))
    clean, members, events = tables(spark, n=20)
    artifacts.build(spark, a, clean, members, events, reference(spark))
    assert artifacts.import_events(spark, a, store)["events"] == 20 and artifacts.import_events(spark, a, store)["events"] == 0
    artifacts.build(spark, b, *tables(spark, first=20, n=5), reference(spark))
    assert artifacts.import_events(spark, b, store)["events"] == 5
    held = artifacts.imported(spark, store, "events")
    assert held.count() == 25 and held.select("artifact").distinct().count() == 2 and held.filter("artifact = dataset_sha256").count() == 25
    assert artifacts.imported(spark, store, "observations").count() == 50 and artifacts.imported(spark, store, "facilities").count() == 1
    # the same events from another artifact, the same detections for other events, other facts about a facility: refused, and nothing is left
    artifacts.build(spark, c, clean, members, events.withColumn("mean_frp", F.lit(1.0)))
    with pytest.raises(ValueError, match="event held"):
        artifacts.import_events(spark, c, store)
    renamed = lambda x: x.withColumn("event_id", F.concat(F.lit("X"), "event_id"))
    artifacts.build(spark, str(tmp_path / "d"), clean, renamed(members), renamed(events))
    with pytest.raises(ValueError, match="detection held"):
        artifacts.import_events(spark, str(tmp_path / "d"), store)
    artifacts.build(spark, str(tmp_path / "e"), *tables(spark, first=40, n=3), reference(spark).withColumn("lat", F.lit(12.0)))
    with pytest.raises(ValueError, match="facility held"):
        artifacts.import_events(spark, str(tmp_path / "e"), store)
    assert artifacts.imported(spark, store, "events").count() == 25 and sorted(p.name for p in (tmp_path / "store").iterdir()) == ["imports"]


def reviews(spark, digest, **changes):
    base = {"approved": True, "reviewer": "r", "event_sha256": digest, "reviewed_at": datetime(2024, 5, 1), "evidence": ["e"]} | changes
    names = "domain string, approved boolean, reviewer string, event_sha256 string, reviewed_at timestamp, evidence array<string>"
    return spark.createDataFrame([(d, *base.values()) for d in artifacts.REVIEW_DOMAINS], names)


def test_gate(spark, tmp_path):
    folder, output = str(tmp_path / "a"), str(tmp_path / "t")
    digest = artifacts.build(spark, folder, *tables(spark), reference(spark))["parts"]["events"]["sha256"]
    events = artifacts.table(spark, folder, "events").select("event_id", F.substring("event_id", 4, 5).cast("int").alias("k"))
    labels = events.select("event_id", F.element_at(F.array(*map(F.lit, LABELS)), F.col("k") % 3 + 1).alias("label"))
    groups = events.select("event_id", (F.floor(F.col("k") / 6)).alias("group"))
    good = reviews(spark, digest)
    made = artifacts.prepare(spark, folder, labels, good, groups, output, LABELS, NOW)
    assert made["ready"] and made["blockers"] == [] and made["rows"] == 300 and made["features"] == ["detection_count", "mean_frp"]
    rows = artifacts.checked(spark, folder, labels, good, groups, output, NOW)
    assert rows.count() == 300 and {r.split for r in rows.select("split").distinct().collect()} == {"train", "validation", "test"}
    for stale, what in ((labels.limit(299), "stale labels"), (labels.withColumn("label", F.lit("a")), "stale labels")):
        with pytest.raises(ValueError, match=what):
            artifacts.checked(spark, folder, stale, good, groups, output, NOW)
    with pytest.raises(ValueError, match="made again"):
        artifacts.checked(spark, folder, labels, good, events.select("event_id", F.col("k").alias("group")), output, NOW)
    rewritten(spark, output, "training", lambda r: r.withColumn("split", F.lit("train")))
    with pytest.raises(ValueError, match="dataset hash"):
        artifacts.checked(spark, folder, labels, good, groups, output, NOW)
    blocked = lambda **how: set(artifacts.prepare(spark, folder, how.get("labels", labels), how.get("reviews", good), how.get("groups", groups), str(tmp_path / "x"), LABELS, NOW)["blockers"])
    missing = {f"{d.upper()}_NOT_REVIEWED" for d in artifacts.REVIEW_DOMAINS}
    for change in ({"approved": False}, {"reviewer": " "}, {"event_sha256": "other"}, {"reviewed_at": datetime(2025, 1, 1)}, {"evidence": []}):
        assert blocked(reviews=reviews(spark, digest, **change)) == missing
    assert blocked(labels=labels.filter("label <> 'a' or event_id < 'EV-00080'")) >= {"MINIMUM_CLASS_SUPPORT_NOT_MET"}
    assert blocked(groups=groups.withColumn("group", F.lit(1))) == {"SPLIT_VALIDATION_FAILED", "LOW_CLASS_SUPPORT_TRAIN", "LOW_CLASS_SUPPORT_VALIDATION", "LOW_CLASS_SUPPORT_TEST", "NO_TRAINABLE_FEATURES"}
    assert blocked(labels=labels.limit(0)) >= {"NO_ELIGIBLE_REVIEWED_LABELS", "EMPTY_OR_OUTSIDE_AREA"}
    with pytest.raises(ValueError, match="training blocked"):
        artifacts.checked(spark, folder, labels, good, groups, str(tmp_path / "x"), NOW)
    with pytest.raises(ValueError, match="several labels"):
        artifacts.prepare(spark, folder, labels.unionByName(labels), good, groups, str(tmp_path / "y"), LABELS, NOW)
