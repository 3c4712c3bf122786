"""Event artifacts bound by hashes: written with a manifest, verified, imported as a whole or not at all, and gated before training.

An artifact is a folder with the tables clean, membership, events and perhaps reference, and a manifest that names each by its content hash
(of its rows, whatever their order and files). An import stages its rows beside the store and becomes visible by one rename of a folder
that bears the artifact's hash, so it can be repeated and never shows half of itself.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import dataset, training
from emberline.session import stored

PARTS = ("clean", "membership", "events", "reference")
# What must be reviewed, the fewest events of a label, in all and in each split, and the area that training is for.
REVIEW_DOMAINS = ("representativeness", "references", "temporal_history", "clustering")
LEAST_OF_LABEL, LEAST_IN_SPLIT = 30, 5
AREA = {"centroid_latitude": (6, 38), "centroid_longitude": (67, 98)}
CLASSES = ("Industrial Fire", "Gas Flare", "Wildfire", "Agricultural Burning", "Other")


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    fs, place = _files(spark, path)
    return fs.exists(place)


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes an artifact that was imported: the store has its own rows."""
    fs, place = _files(spark, folder)
    fs.delete(place, True)


def _write_json(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A manifest; None if there is none."""
    return json.loads(spark.read.text(path).first().value) if _exists(spark, path) else None


def table(spark: SparkSession, folder: str, part: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{part}")


def build(spark: SparkSession, folder: str, clean: DataFrame, membership: DataFrame, events: DataFrame, reference: DataFrame | None = None, facts: dict | None = None) -> dict:
    """Writes an artifact; returns its manifest: ``facts`` (settings, sources) and, for each part, its rows and hash as read back.

    ``clean``: detection_id, .... ``membership``: detection_id, event_id, .... ``events``: a typed event table. ``reference``: feature_id, ....
    """
    manifest = {"version": dataset.VERSION, **(facts or {}), "parts": {}}
    for part, rows in zip(PARTS, (clean, membership, events, reference), strict=True):
        if rows is not None:
            found = dataset.write(rows, f"{folder}/{part}").first()
            manifest["parts"][part] = {"rows": found["rows"], "sha256": found.digest}
    manifest["schema"] = [{"name": r["name"], "dtype": r.dtype, "nullable": r.nullable} for r in dataset.schema_rows(spark).orderBy("place").collect()]
    _write_json(spark, f"{folder}/manifest", manifest)
    return manifest


def verify(spark: SparkSession, folder: str) -> list[str]:
    """Every reason why an artifact can't be trusted; none for a sound one. Memberships are only compared where all parts are what the manifest says."""
    manifest = read_json(spark, f"{folder}/manifest")
    if manifest is None:
        return ["MISSING_MANIFEST"]
    reasons = [f"MISSING_{p.upper()}" for p in PARTS[:3] if p not in manifest["parts"]]
    for part, said in manifest["parts"].items():
        if not _exists(spark, f"{folder}/{part}"):
            reasons.append(f"MISSING_{part.upper()}")
        elif dataset.content_hash(table(spark, folder, part)).first().digest != said["sha256"]:
            reasons.append(f"STALE_{part.upper()}")
    return reasons or _memberships(*[table(spark, folder, p) for p in PARTS[:3]])


def _memberships(clean: DataFrame, membership: DataFrame, events: DataFrame) -> list[str]:
    reasons = [f"INVALID_EVENT_TABLE: {r.check}" for r in dataset.problems(events).filter("n > 0").orderBy("check").collect()]
    if not membership.groupBy("detection_id").count().filter("count > 1 or detection_id is null").isEmpty():
        reasons.append("REPEATED_DETECTION")
    counts = membership.groupBy("event_id").agg(F.count("*").alias("n"))
    sides = counts.join(events.select("event_id", "detection_count", F.lit(True).alias("held")), "event_id", "full")
    sums = sides.agg(
        F.count_if(F.col("held").isNull()).alias("unknown"), F.count_if(F.col("n").isNull()).alias("empty"), F.count_if(F.col("n") != F.col("detection_count")).alias("wrong")
    ).first()
    reasons += ["MEMBERS_OF_UNKNOWN_EVENTS"] * (sums.unknown > 0) + ["EVENTS_WITHOUT_MEMBERS"] * (sums.empty > 0) + ["DETECTION_COUNTS_MISMATCH"] * (sums.wrong > 0)
    ids = clean.select("detection_id"), membership.select("detection_id")
    if any(not a.join(b, "detection_id", "left_anti").isEmpty() for a, b in (ids, ids[::-1])):
        reasons.append("DETECTIONS_MISMATCH")
    return reasons


def imported(spark: SparkSession, store: str, part: str) -> DataFrame | None:
    """All imports' rows of events, observations or facilities, with ``artifact``, the hash of what they came from; None before the first."""
    if not _exists(spark, f"{store}/imports"):
        return None
    fs, place = _files(spark, f"{store}/imports/*/{part}")
    if not len(fs.globStatus(place)):
        return None
    return spark.read.option("basePath", f"{store}/imports").parquet(f"{store}/imports/*/{part}")


def _merged(new: DataFrame, held: DataFrame | None, key: str, mark: str, reason: str) -> DataFrame:
    """The rows whose ``key`` isn't held; an error if one is held under another ``mark``."""
    if held is None:
        return new
    held = held.select(key, F.col(mark).alias("_mark")).distinct()
    if not new.join(held, key).filter(~F.col(mark).eqNullSafe(F.col("_mark"))).isEmpty():
        raise ValueError(reason)
    return new.join(held, key, "left_anti")


def import_events(spark: SparkSession, folder: str, store: str) -> dict:
    """Imports a verified artifact: its events with their predictions to be made, its observations, its facilities. What is held from the same artifact, or
    says the same, is left; an event, observation or facility that is held as something else refuses the whole import."""
    reasons = verify(spark, folder)
    if reasons:
        raise ValueError(f"import refused: {', '.join(reasons)}")
    parts = read_json(spark, f"{folder}/manifest")["parts"]
    digest, reference = parts["events"]["sha256"], parts.get("reference", {}).get("sha256")
    if _exists(spark, f"{store}/imports/artifact={digest}"):
        return {"events": 0, "artifact": digest}
    events = table(spark, folder, "events").withColumn("dataset_sha256", F.lit(digest)).withColumn("reference_sha256", F.lit(reference))
    observations = table(spark, folder, "clean").join(table(spark, folder, "membership").select("detection_id", "event_id"), "detection_id")
    staged = {
        "events": _merged(events, imported(spark, store, "events"), "event_id", "dataset_sha256", "event held from another artifact"),
        "observations": _merged(observations, imported(spark, store, "observations"), "detection_id", "event_id", "detection held for another event"),
    }
    if reference is not None:
        facilities = table(spark, folder, "reference").withColumn("reference_sha256", F.lit(reference))
        staged["facilities"] = _merged(facilities, imported(spark, store, "facilities"), "feature_id", "reference_sha256", "facility held from another reference")
    staging = f"{store}/staging-{uuid.uuid4().hex[:12]}"
    for part, rows in staged.items():
        rows.write.parquet(f"{staging}/{part}")
    added = spark.read.parquet(f"{staging}/events").count()
    fs, place = _files(spark, f"{store}/imports/artifact={digest}")
    fs.mkdirs(place.getParent())
    if not fs.rename(_files(spark, staging)[1], place):
        raise OSError(f"{staging} couldn't be renamed")
    return {"events": added, "artifact": digest}


def _reviews(reviews: DataFrame, digest: str, now: datetime) -> list[str]:
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    good = F.col("approved") & text("reviewer") & (F.col("event_sha256") == digest) & (F.col("reviewed_at") <= F.lit(now)) & (F.size(F.coalesce("evidence", F.array().cast("array<string>"))) > 0)
    held = {r.domain for r in reviews.filter(good).select("domain").distinct().filter(F.col("domain").isin(*REVIEW_DOMAINS)).collect()}
    return [f"{d.upper()}_NOT_REVIEWED" for d in REVIEW_DOMAINS if d not in held]


def _rows(spark: SparkSession, folder: str, labels: DataFrame, groups: DataFrame) -> DataFrame:
    """The typed events with an eligible label, and their split; ``excluded`` if there are too few groups to split."""
    rows = table(spark, folder, "events").join(labels.select("event_id", "label"), "event_id")
    named = rows.select(F.col("event_id").alias("component"))
    try:
        sides = training.group_split(named, groups.select(F.col("event_id").alias("component"), "group"))
    except ValueError:
        sides = named.withColumn("split", F.lit("excluded"))
    return rows.join(sides.withColumnRenamed("component", "event_id"), "event_id")


def prepare(spark: SparkSession, folder: str, labels: DataFrame, reviews: DataFrame, groups: DataFrame, output: str, classes: tuple[str, ...] = CLASSES, now: datetime | None = None) -> dict:
    """Writes the training table and its manifest, which lists all that still blocks training.

    ``labels``: event_id, label of the labels that may be trained on, one an event. ``reviews``: domain, approved, reviewer, event_sha256, reviewed_at, evidence. ``groups``:
    event_id, group of events that must stay together.
    """
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    reasons = verify(spark, folder)
    manifest = read_json(spark, f"{folder}/manifest") or {"parts": {}}
    digest = manifest["parts"].get("events", {}).get("sha256", "")
    if "reference" not in manifest["parts"]:
        reasons.append("NO_REFERENCE_BUNDLE")
    reasons += _reviews(reviews, digest, now)
    if not labels.groupBy("event_id").count().filter("count > 1").isEmpty():
        raise ValueError("an event has several labels")
    found = dataset.write(_rows(spark, folder, labels, groups), f"{output}/training").first()
    rows = table(spark, output, "training")
    counts = {(r.split, r.label): r.n for r in rows.filter(F.col("label").isin(*classes)).groupBy("split", "label").agg(F.count("*").alias("n")).collect()}
    outside = F.lit(False)
    for c, (low, high) in AREA.items():
        outside = outside | ~F.coalesce(F.col(c).between(low, high), F.lit(False))
    if not found["rows"]:
        reasons.append("NO_ELIGIBLE_REVIEWED_LABELS")
    if not found["rows"] or not rows.filter(outside).isEmpty():
        reasons.append("EMPTY_OR_OUTSIDE_AREA")
    if any(sum(n for (_, label), n in counts.items() if label == c) < LEAST_OF_LABEL for c in classes):
        reasons.append("MINIMUM_CLASS_SUPPORT_NOT_MET")
    if any(split == "excluded" for split, _ in counts):
        reasons.append("SPLIT_VALIDATION_FAILED")
    for split in ("train", "validation", "test"):
        if any(counts.get((split, c), 0) < LEAST_IN_SPLIT for c in classes):
            reasons.append(f"LOW_CLASS_SUPPORT_{split.upper()}")
    features = sorted(r.feature for r in training.usable_features(rows).collect())
    if not features:
        reasons.append("NO_TRAINABLE_FEATURES")
    inputs = {part: said["sha256"] for part, said in manifest["parts"].items()} | {"labels": dataset.content_hash(labels).first().digest, "reviews": dataset.content_hash(reviews).first().digest}
    made = {"ready": not reasons, "blockers": sorted(set(reasons)), "sha256": found.digest, "rows": found["rows"], "inputs": inputs, "features": features, "classes": list(classes)}
    _write_json(spark, f"{output}/manifest", made)
    return made


def checked(spark: SparkSession, folder: str, labels: DataFrame, reviews: DataFrame, groups: DataFrame, output: str, now: datetime | None = None) -> DataFrame:
    """The training table, if nothing blocks it, its rows and inputs are what its manifest says, and made again it is the same; else an error."""
    made = read_json(spark, f"{output}/manifest")
    if made is None or not made["ready"] or made["blockers"]:
        raise ValueError(f"training blocked: {', '.join(made['blockers']) if made else 'no manifest'}")
    rows = table(spark, output, "training")
    if dataset.content_hash(rows).first().digest != made["sha256"]:
        raise ValueError("training blocked: dataset hash mismatch")
    parts = (read_json(spark, f"{folder}/manifest") or {"parts": {}})["parts"]
    now_ = {p: said["sha256"] for p, said in parts.items()} | {"labels": dataset.content_hash(labels).first().digest, "reviews": dataset.content_hash(reviews).first().digest}
    stale = sorted(k for k in set(now_) | set(made["inputs"]) if now_.get(k) != made["inputs"].get(k))
    if stale:
        raise ValueError(f"training blocked: stale {', '.join(stale)}")
    reasons = verify(spark, folder) + _reviews(reviews, parts["events"]["sha256"], now or datetime.now(timezone.utc).replace(tzinfo=None))
    if reasons:
        raise ValueError(f"training blocked: {', '.join(reasons)}")
    again = stored(_rows(spark, folder, labels, groups).select(*rows.columns), "again")
    if not rows.exceptAll(again).isEmpty() or not again.exceptAll(rows).isEmpty():
        raise ValueError("training blocked: made again, the dataset is another")
    return rows
