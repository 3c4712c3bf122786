"""Scoring of hotspots: what is around them, their pattern in time, class, risk, and the alerts they call for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import scoring
from emberline.functions.geo import box_distance_km, in_box
from emberline.functions.temporal import patterns
from emberline.operators.nearness import nearest
from emberline.operators.numbering import numbered
from emberline.sources.fixtures import INDUSTRIAL

#: Categories whose distance is a feature of its own.
DISTANCES = {"refinery": "d_refinery", "factory": "d_factory", "power_plant": "d_power_plant", "mine": "d_mine", "settlement": "d_settlement", "industrial_area": "d_area"}


def surroundings(hot: DataFrame, features: DataFrame, covers: DataFrame) -> DataFrame:
    """Distances of each of ``hot`` (site_id, lat, lon) to the nearest facility of each category and to land cover; -1 where there is none.

    ``covers`` (kind, south, north, west, east) are boxes of a fixed number, whatever the scale.
    """
    near = nearest(hot.select(F.col("site_id").alias("point_id"), "lat", "lon"), features, "category")
    near = near.groupBy(F.col("point_id").alias("site_id")).agg(
        *[F.round(F.min(F.when(F.col("category") == c, F.col("distance_km"))), 3).alias(name) for c, name in DISTANCES.items()],
        F.min_by(F.when(F.col("category").isin(*INDUSTRIAL), F.col("feature_id")), F.when(F.col("category").isin(*INDUSTRIAL), F.struct("distance_km", "feature_id"))).alias("facility_id"),
    )
    box = ("south", "north", "west", "east")
    land = (
        hot.select("site_id", "lat", "lon")
        .join(F.broadcast(covers))
        .groupBy("site_id")
        .agg(
            *[F.round(F.min(F.when(F.col("kind") == k, box_distance_km("lat", "lon", *box))), 3).alias(f"d_{k}") for k in ("forest", "agriculture")],
            *[F.max(F.coalesce(in_box("lat", "lon", *box) & (F.col("kind") == k), F.lit(False))).alias(f"in_{k}") for k in ("forest", "agriculture", "urban")],
        )
    )
    rows = hot.select("site_id").join(near, "site_id", "left").join(land, "site_id", "left")
    return rows.fillna(-1.0, [*DISTANCES.values(), "d_forest", "d_agriculture"])


def history_patterns(hot: DataFrame, detections: DataFrame, days: int = 14) -> DataFrame:
    """The pattern in time of each site of ``hot`` over the days up to its acq_us."""
    times = detections.select("site_id", F.col("acq_us").alias("us")).join(hot.select("site_id", F.col("acq_us").alias("now_us")), "site_id")
    return patterns(times, "site_id", days)


def classified(rows: DataFrame) -> DataFrame:
    """Adds tod, historical_frequency, the class probabilities, classification, class_confidence, risk and risk_level."""
    rows = rows.withColumn("tod", scoring.time_of_day("acq_ts"))
    for k, points in enumerate(scoring.rule_scores()):
        rows = rows.withColumn(f"s{k}", points)
    scores = [F.col(f"s{k}") for k in range(len(scoring.CLASSES))]
    for k, p in enumerate(scoring.probabilities(scores)):
        rows = rows.withColumn(f"p{k}", p)
    probs = [F.col(f"p{k}") for k in range(len(scoring.CLASSES))]
    rows = rows.withColumn("classification", scoring.top_class(probs)).withColumn("class_confidence", F.greatest(*probs))
    return rows.withColumn("risk", scoring.risk_score()).withColumn("risk_level", scoring.risk_level("risk"))


def score(hot: DataFrame, around: DataFrame, temporal: DataFrame, latest: DataFrame) -> DataFrame:
    """``hot`` with its surroundings, pattern, class and risk; ``latest`` (site_id, validation) has the last validation, if any."""
    temporal = temporal.select("site_id", F.col("n").alias("n_detections"), "active_days", "mean_gap", "std_gap", "persistence_score", "pattern")
    rows = hot.join(around, "site_id").join(temporal, "site_id").join(latest, "site_id", "left")
    rows = (
        rows.withColumn("acq_ts", F.timestamp_micros("acq_us"))
        .withColumn("validation", F.coalesce("validation", F.lit("NOT VALIDATED")))
        .withColumn("d_industrial", scoring.nearest_industrial("d_refinery", "d_factory", "d_power_plant", "d_mine"))
        .withColumn("land_cover", scoring.land_cover(scoring.nearest_industrial("d_refinery", "d_factory", "d_power_plant", "d_mine", "d_area"), "in_forest", "in_agriculture", "d_settlement"))
        .withColumn("historical_frequency", F.col("n_detections") / F.lit(14.0))
    )
    return classified(rows)


def due_alerts(rows: DataFrame, least_risk: float = 80.0, least_confidence: float = 0.8, held: int = 0, order: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """Alerts that hotspots call for, numbered after the ``held`` ones there are, by default in the order of site_id."""
    kinds = F.col("classification").isin("Industrial Fire", "Gas Flare")
    due = rows.filter((F.col("risk") >= least_risk) | (kinds & (F.col("class_confidence") >= least_confidence)))
    return numbered(due, [F.col(c) for c in order]).select(
        F.format_string("AL-%04d", F.col("number") + held).alias("code"),
        "site_id",
        F.when(kinds, "industrial_fire").otherwise("risk").alias("kind"),
        F.when(F.col("risk_level").isin("CRITICAL", "HIGH"), F.col("risk_level")).otherwise("MODERATE").alias("severity"),
    )


def digest(alerts: DataFrame, by: str, most: int = 10) -> DataFrame:
    """(by, title, message, severity): one notification for the alerts of each batch, naming the first ``most`` by code.

    Only the first lines are gathered, by rank; the rest are counted.
    """
    ranked = alerts.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy("code")))
    n = F.count("*")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("k", "line")))), lambda x: x["line"]), "\n")
    more = F.when(n > most, F.concat(F.lit("\n…and "), (n - most).cast("string"), F.lit(" more."))).otherwise("")
    return ranked.withColumn("line", F.concat(F.lit("• "), "code", F.lit(" — "), "title")).groupBy(by).agg(
        F.concat(n.cast("string"), F.lit(" new auto-alert"), F.when(n == 1, "").otherwise("s"), F.lit(" generated")).alias("title"),
        F.concat(lines, more).alias("message"),
        F.when(F.bool_or(F.col("severity") == "CRITICAL"), "critical").otherwise("warning").alias("severity"),
    )
