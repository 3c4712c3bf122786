"""The typed event table: its columns, checks, and the content hash that names what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The version and the columns in order, by kind.
VERSION = "thermal-events-v1"
EVENT = "event_id centroid_latitude centroid_longitude start_time end_time duration_minutes detection_count mean_frp max_frp min_frp std_frp mean_brightness max_brightness spatial_radius_km day_detection_ratio night_detection_ratio unknown_daynight_ratio satellite instrument".split()
SPATIAL = "dist_nearest_industrial_km dist_refinery_km dist_factory_km dist_powerplant_km dist_mine_km industrial_count_500m industrial_count_1km industrial_count_5km inside_industrial_polygon nearest_facility_id nearest_facility_type dist_forest_km dist_agriculture_km dist_settlement_km inside_forest inside_agriculture inside_urban forest_fraction_1km agriculture_fraction_1km industrial_fraction_1km".split()
TEMPORAL = "detections_24h detections_7d detections_30d detections_90d active_days_7d active_days_30d active_days_90d time_since_previous_detection historical_mean_frp historical_median_frp historical_std_frp historical_max_frp frp_delta_from_baseline frp_ratio_to_baseline frp_z_score historical_mean_brightness mean_detection_interval_hours std_detection_interval_hours same_location_recurrence spatial_location_variance day_ratio night_ratio history_start history_end_exclusive".split()
EXTRA = "persistence_score temporal_pattern persistence_evidence data_source reference_source schema_version".split()
COLUMNS = EVENT + SPATIAL + TEMPORAL + EXTRA
TEXTS = {"event_id", "satellite", "instrument", "nearest_facility_id", "nearest_facility_type", "history_start", "history_end_exclusive", *EXTRA[1:]}
FLAGS = {c for c in SPATIAL if c.startswith("inside_")}
TIMES = {"start_time", "end_time"}
WHOLE = {"detection_count", *[c for c in SPATIAL if "_count_" in c], *[c for c in TEMPORAL if c.startswith(("detections_", "active_days_"))]}
REQUIRED = {"event_id", "start_time", "end_time", "centroid_latitude", "centroid_longitude", "detection_count"}
UNITS = {"distance": "km", "frp": "MW", "brightness": "K", "time_since_previous_detection": "hours", "spatial_location_variance": "km^2", "persistence_score": "heuristic 0–100"}


def kind(column: str) -> str:
    return "timestamp" if column in TIMES else "string" if column in TEXTS else "boolean" if column in FLAGS else "bigint" if column in WHOLE else "double"


def typed(rows: DataFrame) -> DataFrame:
    """``rows`` with exactly COLUMNS in order, each cast to its type; a column that is missing is null."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind(c)).alias(c) for c in COLUMNS])


def problems(rows: DataFrame) -> DataFrame:
    """(check, n): how many rows fail each check of a typed table; all are 0 for a sound one."""
    bad = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    numbers = [c for c in COLUMNS if kind(c) == "double"]
    shares = [c for c in numbers if (c.endswith("_ratio") or "_fraction_" in c or c == "same_location_recurrence") and c != "frp_ratio_to_baseline"]
    any_of = lambda cs: F.exists(F.array(*cs), lambda x: F.coalesce(x, F.lit(False)))
    checks = {
        "id_missing": bad(F.col("event_id").isNull()),
        "id_repeated": F.count("event_id") - F.count_distinct("event_id"),
        "time_range": bad(F.col("start_time").isNull() | F.col("end_time").isNull() | (F.col("end_time") < F.col("start_time"))),
        "coordinates": bad(~F.coalesce(F.col("centroid_latitude").between(-90, 90) & F.col("centroid_longitude").between(-180, 180), F.lit(False))),
        "no_detection": bad(F.coalesce(F.col("detection_count") < 1, F.lit(True))),
        "not_finite": bad(any_of([F.isnan(c) | (F.abs(c) == float("inf")) for c in numbers])),
        "not_a_share": bad(any_of([(F.col(c) < 0) | (F.col(c) > 1) for c in shares])),
    }
    found = rows.agg(*[c.cast("bigint").alias(name) for name, c in checks.items()])
    return found.select(F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).alias("n")) for name in checks])).alias("x")).select("x.*")


def schema_rows(spark) -> DataFrame:
    """(place, name, dtype, nullable): the schema as a table."""
    return spark.createDataFrame([(k, c, kind(c), c not in REQUIRED) for k, c in enumerate(COLUMNS)], "place int, name string, dtype string, nullable boolean")


def content_hash(rows: DataFrame) -> DataFrame:
    """(rows, digest): a digest of the rows whatever their order: two sums of their SHA-256, modulo 10**18."""
    text = F.sha2(F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.sum(F.conv(F.substring(text, at, 15), 16, 10).cast("decimal(38,0)")) % F.lit(10**18).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("rows"), F.concat_ws("-", part(1).cast("string"), part(16).cast("string")).alias("digest"))


def write(rows: DataFrame, path: str) -> DataFrame:
    """Writes a table as Parquet; returns its content hash as read back."""
    rows.write.mode("overwrite").parquet(path)
    return content_hash(rows.sparkSession.read.parquet(path))
