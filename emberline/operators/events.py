"""Thermal events: detections clustered in space and time, described, and compared with their past."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.geo import centroid, haversine_km
from emberline.operators.digest import ordered_digests
from emberline.operators.graph import components
from emberline.operators.linking import groups
from emberline.operators.radius import radius_join
from emberline.session import discard, stored

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000


@dataclass(frozen=True)
class Clustering:
    km: float = 1.0
    hours: float = 24.0

    def __post_init__(self) -> None:
        if not (0 < self.km <= 100 and self.hours > 0):
            raise ValueError("clustering needs 0 < km <= 100 and hours > 0")


def edges(det: DataFrame, how: Clustering = Clustering()) -> DataFrame:
    """(a, b, distance_km): pairs a < b of detections (det_id, lat, lon, acq_us) within both distances, ends included."""
    width = int(how.hours * HOUR_US)
    slot = F.floor(F.col("us") / F.lit(width))
    left = det.select(F.col("det_id").alias("a"), "lat", "lon", F.col("acq_us").alias("us"))
    right = det.select(F.col("det_id").alias("b"), F.col("lat").alias("lat_r"), F.col("lon").alias("lon_r"), F.col("acq_us").alias("us_r"))
    pairs = radius_join(left, right, how.km, how.km, [(F.array(slot - 1, slot, slot + 1), F.floor(F.col("us_r") / F.lit(width)))])
    return pairs.filter((F.col("a") < F.col("b")) & (F.abs(F.col("us") - F.col("us_r")) <= width)).select("a", "b", "distance_km")


def members(det: DataFrame, how: Clustering = Clustering()) -> DataFrame:
    """(det_id, component): each detection's event, named by its smallest det_id; one without a partner is its own."""
    return groups(det, how.km, int(how.hours * HOUR_US))


def describe(det: DataFrame, member: DataFrame, how: Clustering = Clustering()) -> DataFrame:
    """A row for each event: identity by its content, times, centroid, extent, and what its detections measured."""
    rows = stored(det.select("det_id", "lat", "lon", "acq_us", "frp", "brightness", "daynight", "satellite").join(member, "det_id"), "members")
    lat, lon = centroid("lat", "lon")
    share = lambda c: F.count_if(c) / F.count("*")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    ids = ordered_digests(rows.select("component", F.col("det_id").cast("string").alias("id")), "component", ["id"], "id", "|", f"event-v1|{how.km}|{how.hours}|")
    named = ids.select("component", F.concat(F.lit("EV-"), F.substring("digest", 1, 20)).alias("event_id"))
    events = rows.groupBy("component").agg(
        lat.alias("lat"),
        lon.alias("lon"),
        F.min("acq_us").alias("start_us"),
        F.max("acq_us").alias("end_us"),
        ((F.max("acq_us") - F.min("acq_us")) / F.lit(6e7)).alias("duration_minutes"),
        F.count("*").alias("detection_count"),
        F.avg("frp").alias("mean_frp"),
        F.max("frp").alias("max_frp"),
        F.min("frp").alias("min_frp"),
        F.stddev_pop("frp").alias("std_frp"),
        F.avg("brightness").alias("mean_brightness"),
        F.max("brightness").alias("max_brightness"),
        share(F.col("daynight") == "D").alias("day_ratio"),
        share(F.col("daynight") == "N").alias("night_ratio"),
        share(F.col("daynight").isNull()).alias("unknown_ratio"),
        names("satellite").alias("satellite"),
    )
    events = named.join(events, "component")
    middle = events.select("component", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    extent = rows.join(middle, "component").groupBy("component").agg(F.max(haversine_km("c_lat", "c_lon", "lat", "lon")).alias("spatial_radius_km"))
    out = stored(events.join(extent, "component"), "events")
    discard(rows, ids)
    return out


def prior(events: DataFrame, det: DataFrame, km: float = 1.0, days: int = 90) -> DataFrame:
    """Detections within ``km`` of an event's centroid and in [start - days, start): (component, start_us, us, ...)."""
    width = 30 * DAY_US
    first, last = (F.floor((F.col("start_us") - F.lit(k * DAY_US)) / F.lit(width)) for k in (days, 0))
    left = events.select("component", "lat", "lon", "start_us")
    right = det.select(F.col("det_id"), F.col("lat").alias("lat_r"), F.col("lon").alias("lon_r"), F.col("acq_us").alias("us"), "frp", "brightness", "daynight")
    pairs = radius_join(left, right, km, km, [(F.sequence(first, last), F.floor(F.col("us") / F.lit(width)))])
    return pairs.filter((F.col("us") < F.col("start_us")) & (F.col("us") >= F.col("start_us") - F.lit(days * DAY_US)))


def history(events: DataFrame, det: DataFrame, km: float = 1.0, days: int = 90) -> DataFrame:
    """What an event's past says about it, by component; counts are 0 and measures null without a past."""
    rows = stored(prior(events, det, km, days), "prior")
    back = lambda n: F.col("us") >= F.col("start_us") - F.lit(n * DAY_US)
    day = F.floor(F.col("us") / F.lit(DAY_US))
    gap = (F.col("us") - F.lag("us").over(Window.partitionBy("component").orderBy("us", "det_id"))) / F.lit(3.6e9)
    past = (
        rows.withColumn("gap", gap)
        .groupBy("component")
        .agg(
            *[F.count_if(back(n)).alias(f"detections_{name}") for n, name in ((1, "24h"), (7, "7d"), (30, "30d"), (90, "90d"))],
            *[F.count_distinct(F.when(back(n), day)).alias(f"active_days_{n}d") for n in (7, 30, 90)],
            (F.max("start_us") - F.max("us")).alias("since_us"),
            F.avg("frp").alias("historical_mean_frp"),
            F.median("frp").alias("historical_median_frp"),
            F.stddev_pop("frp").alias("historical_std_frp"),
            F.max("frp").alias("historical_max_frp"),
            F.count("frp").alias("with_frp"),
            F.count_distinct("us").alias("distinct_times"),
            F.avg("brightness").alias("historical_mean_brightness"),
            F.avg("gap").alias("mean_interval_hours"),
            F.stddev_pop("gap").alias("std_interval_hours"),
            F.avg(F.pow("distance_km", F.lit(2.0))).alias("spatial_location_variance"),
            (F.count_if(F.col("daynight") == "D") / F.count("*")).alias("past_day_ratio"),
        )
    )
    out = events.select("component", "event_id", "start_us", "mean_frp").join(past, "component", "left")
    counts = [c for c in past.columns if c.startswith(("detections_", "active_days_"))] + ["with_frp", "distinct_times"]
    mean, std = F.col("historical_mean_frp"), F.col("historical_std_frp")
    return out.fillna(0, counts).select(
        "*",
        (F.col("since_us") / F.lit(3.6e9)).alias("time_since_previous_detection"),
        (F.col("mean_frp") - mean).alias("frp_delta_from_baseline"),
        F.when(mean > 0, F.col("mean_frp") / mean).alias("frp_ratio_to_baseline"),
        F.when(std > 0, (F.col("mean_frp") - mean) / std).alias("frp_z_score"),
        (F.col("active_days_90d") / F.lit(90.0)).alias("same_location_recurrence"),
    )


def near_pairs(events: DataFrame, km: float = 1.0, hours: float = 24.0, most: int = 1000) -> DataFrame:
    """(a, b, distance_km, gap_hours) of different events that nearly touch: the first ``most`` by (a, b)."""
    left = events.select(F.col("component").alias("a"), "lat", "lon", F.col("start_us").alias("s"), F.col("end_us").alias("e"))
    right = events.select(F.col("component").alias("b"), F.col("lat").alias("lat_r"), F.col("lon").alias("lon_r"), F.col("start_us").alias("s_r"), F.col("end_us").alias("e_r"))
    gap = F.greatest(F.lit(0), F.greatest("s", "s_r") - F.least("e", "e_r")) / F.lit(3.6e9)
    pairs = radius_join(left, right, km, km).filter("a < b").withColumn("gap_hours", gap).filter(F.col("gap_hours") <= hours)
    return pairs.orderBy("a", "b").limit(most).select("a", "b", "distance_km", "gap_hours")


def leakage_edges(events: DataFrame, km: float = 2.0) -> DataFrame:
    """(a, b): events whose circles, widened by half of ``km``, overlap, and the first of each facility with the others of it.
    ``events``: component, lat, lon, extent, facility_id."""
    widest = events.agg(F.max("extent")).first()[0] or 0.0
    left = events.select(F.col("component").alias("a"), "lat", "lon", "extent")
    right = events.select(F.col("component").alias("b"), F.col("lat").alias("lat_r"), F.col("lon").alias("lon_r"), F.col("extent").alias("extent_r"))
    reach = F.col("extent") + F.col("extent_r") + km + 1e-9
    near = radius_join(left, right, reach, 2 * widest + km + 1e-6).filter("a < b").select("a", "b")
    shared = events.filter("facility_id is not null")
    head = shared.groupBy("facility_id").agg(F.min("component").alias("a"))
    same = shared.join(head, "facility_id").filter("a <> component").select("a", F.col("component").alias("b"))
    return near.unionByName(same).distinct()


def leakage_groups(events: DataFrame, km: float = 2.0) -> DataFrame:
    """(component, group): events that must stay on one side of a split. A group is named by its smallest event."""
    found = components(leakage_edges(events, km))
    named = found.select(F.col("id").alias("component"), F.col("component").alias("group"))
    return events.select("component").join(named, "component", "left").select("component", F.coalesce("group", "component").alias("group"))
