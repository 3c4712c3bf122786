"""Events: clustering, lineage, history, audits of splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import scoring
from emberline.operators import events as ops
from emberline.operators import polygons, series
from emberline.operators.nearness import nearest
from emberline.operators.radius import radius_join
from emberline.plans.model import BOX_SQL, DET_SQL, FAC_SQL, HOT_SQL, on_scored, sql_km
from emberline.plans.registry import query, remembered, scored
from emberline.sources import fixtures

DAY = fixtures.DAY_US
_EDGE = f"""edge AS (SELECT a.det_id AS a, b.det_id AS b, {sql_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM det a JOIN det b
  ON a.det_id < b.det_id AND abs(a.acq_us - b.acq_us) <= {DAY} AND abs(a.lat - b.lat) < 0.02 WHERE {sql_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 1)"""
_COMP = f"""{_EDGE}, ends AS (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge),
reach(n, l) AS (SELECT det_id, det_id FROM det UNION SELECT ends.b, reach.l FROM reach JOIN ends ON ends.a = reach.n WHERE reach.l < ends.b),
comp AS (SELECT n AS det_id, min(l) AS component FROM reach GROUP BY n)"""
_MID = """mid AS (SELECT component, degrees(atan2(avg(sin(radians(lat))), sqrt(pow(avg(cos(radians(lat)) * cos(radians(lon))), 2) + pow(avg(cos(radians(lat)) * sin(radians(lon))), 2)))) AS c_lat,
  degrees(atan2(avg(cos(radians(lat)) * sin(radians(lon))), avg(cos(radians(lat)) * cos(radians(lon))))) AS c_lon, min(acq_us) AS start_us, max(acq_us) AS end_us FROM det JOIN comp USING (det_id) GROUP BY component)"""
_EV = f"""{_COMP}, {_MID},
ev AS (SELECT component, c_lat, c_lon, start_us, end_us, 'EV-' || substr(sha256('event-v1|1.0|24.0|' || string_agg(det_id::VARCHAR, '|' ORDER BY det_id::VARCHAR)), 1, 20) AS event_id,
  (end_us - start_us) / 6e7 AS duration_minutes, count(*) AS detection_count, avg(frp) AS mean_frp, max(frp) AS max_frp, min(frp) AS min_frp, stddev_pop(frp) AS std_frp, avg(brightness) AS mean_brightness,
  max(brightness) AS max_brightness, count(*) FILTER (WHERE daynight = 'D') / count(*) AS day_ratio, count(*) FILTER (WHERE daynight = 'N') / count(*) AS night_ratio,
  count(*) FILTER (WHERE daynight IS NULL) / count(*) AS unknown_ratio, string_agg(DISTINCT satellite, '|' ORDER BY satellite) AS satellite, max({sql_km('c_lat', 'c_lon', 'lat', 'lon')}) AS spatial_radius_km
  FROM det JOIN comp USING (det_id) JOIN mid USING (component) GROUP BY component, c_lat, c_lon, start_us, end_us)"""
_HIST = f"""past AS (SELECT ev.component, ev.start_us AS s, det.*, {sql_km('c_lat', 'c_lon', 'lat', 'lon')} AS km FROM ev JOIN det ON acq_us < ev.start_us AND acq_us >= ev.start_us - 90 * {DAY} AND abs(lat - c_lat) < 0.02
  WHERE {sql_km('c_lat', 'c_lon', 'lat', 'lon')} <= 1),
gaps AS (SELECT *, (acq_us - lag(acq_us) OVER (PARTITION BY component ORDER BY acq_us, det_id)) / 3.6e9 AS gap FROM past),
hist AS (SELECT component, {', '.join(f"count(*) FILTER (WHERE acq_us >= s - {n} * {DAY}) AS detections_{c}" for n, c in ((1, '24h'), (7, '7d'), (30, '30d'), (90, '90d')))},
  {', '.join(f"count(DISTINCT acq_us // {DAY}) FILTER (WHERE acq_us >= s - {n} * {DAY}) AS active_days_{n}d" for n in (7, 30, 90))}, max(s) - max(acq_us) AS since_us, avg(frp) AS hm, median(frp) AS hmed, stddev_pop(frp) AS hs,
  max(frp) AS hx, count(frp) AS with_frp, count(DISTINCT acq_us) AS distinct_times, avg(brightness) AS hb, avg(gap) AS gm, stddev_pop(gap) AS gs, avg(km * km) AS variance, count(*) FILTER (WHERE daynight = 'D') / count(*) AS pd FROM gaps GROUP BY component)"""


def on_events(select: str, more: str = "") -> str:
    return f"WITH RECURSIVE {DET_SQL}, {_EV}{', ' + more if more else ''}\n{select}"


def event_tables(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """(members, events) as stored tables, made once a session and input."""
    det = fixtures.detections(spark, d)
    member = remembered(spark, d, "event-members", lambda: ops.members(det))
    return member, remembered(spark, d, "event-table", lambda: ops.describe(det, member))


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("join_04_edges", f"WITH {DET_SQL}, {_EDGE} SELECT a, b, round(km, 6) AS distance_km FROM edge")
def join_04(spark, d):
    return ops.edges(fixtures.detections(spark, d)).select("a", "b", *r6("distance_km"))


@query("grf_01_components", f"WITH RECURSIVE {DET_SQL}, {_COMP} SELECT det_id, component FROM comp")
def grf_01(spark, d):
    return ops.members(fixtures.detections(spark, d))


@query("grf_02_event_ids", on_events("SELECT event_id, component, detection_count FROM ev"))
def grf_02(spark, d):
    return event_tables(spark, d)[1].select("event_id", "component", "detection_count")


_EV_COLS = ("duration_minutes", "mean_frp", "max_frp", "min_frp", "std_frp", "mean_brightness", "max_brightness", "day_ratio", "night_ratio", "unknown_ratio")


@query("agg_12_events", on_events("SELECT event_id, start_us, end_us, detection_count, satellite, " + ", ".join(f"round({c}, 9) AS {c}" for c in _EV_COLS) + " FROM ev"))
def agg_12(spark, d):
    """Events as their detections describe them; nine decimals, as means of values with two have ties at six, which the order of summing decides."""
    return event_tables(spark, d)[1].select("event_id", "start_us", "end_us", "detection_count", "satellite", *[F.round(c, 9).alias(c) for c in _EV_COLS])


@query("agg_13_centroids", on_events("SELECT event_id, round(c_lat, 6) AS lat, round(c_lon, 6) AS lon, round(spatial_radius_km, 5) AS spatial_radius_km FROM ev"))
def agg_13(spark, d):
    return event_tables(spark, d)[1].select("event_id", *r6("lat", "lon"), F.round("spatial_radius_km", 5).alias("spatial_radius_km"))


_HIST_NAMES = {"hm": "historical_mean_frp", "hmed": "historical_median_frp", "hs": "historical_std_frp", "hx": "historical_max_frp", "hb": "historical_mean_brightness", "gm": "mean_interval_hours", "gs": "std_interval_hours", "pd": "past_day_ratio"}
_HIST_COUNTS = ("detections_24h", "detections_7d", "detections_30d", "detections_90d", "active_days_7d", "active_days_30d", "active_days_90d", "with_frp", "distinct_times")


@query("agg_14_history", on_events("SELECT event_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _HIST_COUNTS) + ", round(since_us / 3.6e9, 6) AS time_since_previous_detection, " + ", ".join(f"round({a}, 6) AS {b}" for a, b in _HIST_NAMES.items()) + ", round(mean_frp - hm, 6) AS frp_delta_from_baseline, round(coalesce(active_days_90d, 0) / 9e1, 6) AS same_location_recurrence FROM ev LEFT JOIN hist USING (component)", _HIST))
def agg_14(spark, d):
    rows = ops.history(event_tables(spark, d)[1], fixtures.detections(spark, d))
    return rows.select("event_id", *_HIST_COUNTS, *r6("time_since_previous_detection", *_HIST_NAMES.values(), "frp_delta_from_baseline", "same_location_recurrence"))


@query("join_05_history", on_events("SELECT component, count(*) AS n, min(det_id) AS first_id, max(det_id) AS last_id FROM past GROUP BY component", _HIST))
def join_05(spark, d):
    rows = ops.prior(event_tables(spark, d)[1], fixtures.detections(spark, d))
    return rows.groupBy("component").agg(F.count("*").alias("n"), F.min("det_id").alias("first_id"), F.max("det_id").alias("last_id"))


@query("join_06_event_pairs", on_events(f"""SELECT a, b, round(km, 5) AS distance_km, round(gap, 6) AS gap_hours FROM (SELECT x.component AS a, y.component AS b, {sql_km('x.c_lat', 'x.c_lon', 'y.c_lat', 'y.c_lon')} AS km,
greatest(0, greatest(x.start_us, y.start_us) - least(x.end_us, y.end_us)) / 3.6e9 AS gap FROM ev x JOIN ev y ON x.component < y.component AND abs(x.c_lat - y.c_lat) < 0.02) WHERE km <= 1 AND gap <= 48 ORDER BY a, b LIMIT 1000"""))
def join_06(spark, d):
    rows = ops.near_pairs(event_tables(spark, d)[1], 1.0, 48.0)
    return rows.select("a", "b", F.round("distance_km", 5).alias("distance_km"), *r6("gap_hours"))


@query("join_08_lineage", on_events("SELECT det_id, event_id, detection_count FROM det JOIN comp USING (det_id) JOIN ev USING (component)"))
def join_08(spark, d):
    member, event = event_tables(spark, d)
    rows = fixtures.detections(spark, d).select("det_id").join(member, "det_id").join(event.select("component", "event_id", "detection_count"), "component")
    return rows.select("det_id", "event_id", "detection_count")


@query("join_15_anti", on_events("SELECT (SELECT count(*) FROM det WHERE det_id NOT IN (SELECT det_id FROM comp)) AS without_event, (SELECT count(*) FROM ev WHERE component NOT IN (SELECT det_id FROM det)) AS without_detection, count(*)::BIGINT AS events, sum(detection_count)::BIGINT AS detections FROM ev"))
def join_15(spark, d):
    """Lineage holds both ways, and no detection is lost."""
    member, event = event_tables(spark, d)
    det = fixtures.detections(spark, d).select("det_id")
    without = det.join(member, "det_id", "left_anti").agg(F.count("*").alias("without_event"))
    idle = event.join(det, event.component == det.det_id, "left_anti").agg(F.count("*").alias("without_detection"))
    totals = event.agg(F.count("*").alias("events"), F.sum("detection_count").alias("detections"))
    return without.crossJoin(idle).crossJoin(totals)  # one row each


@query("agg_18_gaps", f"WITH {DET_SQL}, g AS (SELECT site_id, (acq_us - lag(acq_us) OVER (PARTITION BY site_id ORDER BY acq_us, det_id)) / 3.6e9 AS gap FROM det) SELECT site_id, round(avg(gap), 6) AS mean_gap, round(stddev_pop(gap), 6) AS std_gap, count(gap) AS n FROM g GROUP BY site_id")
def agg_18(spark, d):
    w = Window.partitionBy("site_id").orderBy("acq_us", "det_id")
    rows = fixtures.detections(spark, d).select("site_id", ((F.col("acq_us") - F.lag("acq_us").over(w)) / F.lit(3.6e9)).alias("gap"))
    return rows.groupBy("site_id").agg(F.round(F.avg("gap"), 6).alias("mean_gap"), F.round(F.stddev_pop("gap"), 6).alias("std_gap"), F.count("gap").alias("n"))


@query("evi_01_anomaly", on_events("""SELECT event_id, CASE WHEN z IS NULL THEN 'unavailable' WHEN z >= 3 THEN 'elevated' ELSE 'within_baseline' END AS status, round(z, 6) AS score,
CASE WHEN coalesce(active_days_90d, 0) < 5 THEN 'insufficient_history' WHEN active_days_90d >= 30 AND hm > 0 AND hs / hm <= 0.5 THEN 'persistent_candidate' ELSE 'recurrent_activity' END AS persistence
FROM (SELECT *, CASE WHEN with_frp >= 5 AND hs > 0 THEN (mean_frp - hm) / hs END AS z FROM ev LEFT JOIN hist USING (component))""", _HIST))
def evi_01(spark, d):
    rows = ops.history(event_tables(spark, d)[1], fixtures.detections(spark, d))
    z = scoring.anomaly_score("mean_frp", "historical_mean_frp", "historical_std_frp", "with_frp")
    days = scoring.persistence_status("active_days_90d", "historical_mean_frp", "historical_std_frp")
    return rows.select("event_id", scoring.anomaly_status(z).alias("status"), F.round(z, 6).alias("score"), days.alias("persistence"))


_REASON = """CASE WHEN prior = 0 THEN 'NO_PRIOR_OBSERVATIONS' WHEN in_window = 0 THEN 'NO_PRIOR_IN_HISTORY_WINDOW' WHEN coalesce(detections_90d, 0) = 0 THEN 'NO_MATCH_WITHIN_HISTORY_RADIUS' WHEN with_frp = 0 THEN 'MISSING_HISTORICAL_FRP'
WHEN with_frp < 2 OR distinct_times < 2 THEN 'INSUFFICIENT_HISTORY' WHEN hs = 0 THEN 'ZERO_HISTORICAL_VARIANCE' WHEN mean_frp IS NULL THEN 'CURRENT_FRP_MISSING' ELSE 'AVAILABLE' END"""


def reasons(spark, d):
    """Each event's reason code; prior observations at all places are counted by running sums, not by comparing all pairs."""
    event, det = event_tables(spark, d)[1], fixtures.detections(spark, d)
    rows = ops.history(event, det)
    asked = rows.select("component", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), (F.col("start_us") - F.lit(back * DAY)).alias("us")) for kind, back in (("prior", 0), ("window", 90))])).alias("a")).select("component", "a.*")
    marks = det.select(F.col("acq_us").alias("us"), F.lit(1).alias("seen")).unionByName(asked.select("us", F.lit(0).alias("seen")))
    counts = asked.join(series.sums_before(marks, "us", "seen"), "us")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("before")))
    counts = counts.groupBy("component").agg(of("prior").alias("prior"), of("window").alias("old"))
    rows = rows.join(counts, "component").withColumn("in_window", F.col("prior") - F.col("old"))
    reason = scoring.history_reason("prior", "in_window", "detections_90d", "with_frp", "distinct_times", "historical_std_frp", "mean_frp")
    return rows.select("event_id", reason.alias("reason"), "prior", "in_window")


_COUNTS = f"cnt AS (SELECT component, (SELECT count(*) FROM det WHERE acq_us < start_us) AS prior, (SELECT count(*) FROM det WHERE acq_us < start_us AND acq_us >= start_us - 90 * {DAY}) AS in_window FROM ev)"


@query("evi_04_reasons", on_events(f"SELECT event_id, {_REASON} AS reason, prior, in_window FROM ev LEFT JOIN hist USING (component) JOIN cnt USING (component)", f"{_HIST}, {_COUNTS}"))
def evi_04(spark, d):
    return reasons(spark, d)


@query("agg_21_reason_histogram", on_events(f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM ev LEFT JOIN hist USING (component) JOIN cnt USING (component)) GROUP BY reason", f"{_HIST}, {_COUNTS}"))
def agg_21(spark, d):
    return reasons(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


@query("evi_05_review_flags", on_events("SELECT event_id, concat_ws('|', CASE WHEN spatial_radius_km > 0.6 THEN 'SPATIAL_CHAIN_REVIEW' END, CASE WHEN duration_minutes > 1440 THEN 'TEMPORAL_CHAIN_REVIEW' END) AS flags FROM ev"))
def evi_05(spark, d):
    flags = F.concat_ws("|", F.when(F.col("spatial_radius_km") > 0.6, "SPATIAL_CHAIN_REVIEW"), F.when(F.col("duration_minutes") > 24 * 60, "TEMPORAL_CHAIN_REVIEW"))
    return event_tables(spark, d)[1].select("event_id", flags.alias("flags"))


_SITE_EV = "sites AS (SELECT component, min(det.site_id) AS site_id, max(spatial_radius_km) AS extent, max(c_lat) AS y, max(c_lon) AS x FROM det JOIN comp USING (det_id) JOIN ev USING (component) GROUP BY component)"


def splittable(spark, d):
    """Events with place, extent and the facility they belong to: the site, for every third one. Made once a session and input, as it is read many times."""
    return remembered(spark, d, "splittable", lambda: _splittable(spark, d))


def _splittable(spark, d) -> DataFrame:
    member, event = event_tables(spark, d)
    site = fixtures.detections(spark, d).join(member, "det_id").groupBy("component").agg(F.min("site_id").alias("site_id"))
    facility = F.when(F.col("site_id") % 3 == 0, F.col("site_id") % 20)
    return event.join(site, "component").select("component", "event_id", "lat", "lon", "start_us", F.col("spatial_radius_km").alias("extent"), facility.alias("facility_id"))


_GROUPS = f"""{_SITE_EV}, fe AS (SELECT *, CASE WHEN site_id % 3 = 0 THEN site_id % 20 END AS fid FROM sites),
le AS (SELECT p.component AS a, q.component AS b FROM fe p JOIN fe q ON p.component < q.component AND abs(p.y - q.y) < 1 WHERE {sql_km('p.y', 'p.x', 'q.y', 'q.x')} <= p.extent + q.extent + 2 + 1e-9
  UNION SELECT p.component, q.component FROM fe p JOIN (SELECT fid, min(component) AS component FROM fe GROUP BY fid) q ON p.fid = q.fid AND p.component <> q.component),
lends AS (SELECT a, b FROM le UNION SELECT b, a FROM le),
lreach(n, l) AS (SELECT component, component FROM fe UNION SELECT lends.b, lreach.l FROM lreach JOIN lends ON lends.a = lreach.n WHERE lreach.l < lends.b),
grp AS (SELECT n AS component, min(l) AS grp FROM lreach GROUP BY n)"""


@query("grf_03_leakage_groups", on_events('SELECT component, grp AS "group" FROM grp', _GROUPS))
def grf_03(spark, d):
    return ops.leakage_groups(splittable(spark, d))


@query("join_07_split_edges", on_events('SELECT grp AS "group", count(*) AS n FROM grp GROUP BY grp HAVING count(*) > 1', _GROUPS))
def join_07(spark, d):
    return ops.leakage_groups(splittable(spark, d)).groupBy("group").agg(F.count("*").alias("n")).filter("n > 1")


_CUTS = (fixtures.NOW_US - 20 * DAY, fixtures.NOW_US - 10 * DAY)
_SPLIT = "CASE WHEN start_us < {0} THEN 'train' WHEN start_us < {1} THEN 'validation' ELSE 'test' END".format(*_CUTS)


@query("agg_26_split_audit", on_events(f"""SELECT split, count(*) AS n, count(*) FILTER (WHERE mixed) AS excluded FROM (SELECT {_SPLIT} AS split, count(DISTINCT {_SPLIT}) OVER (PARTITION BY grp) > 1 AS mixed FROM ev JOIN grp USING (component)) GROUP BY split""".replace(f"count(DISTINCT {_SPLIT}) OVER (PARTITION BY grp) > 1", f"min({_SPLIT}) OVER (PARTITION BY grp) <> max({_SPLIT}) OVER (PARTITION BY grp)"), _GROUPS))
def agg_26(spark, d):
    """Temporal splits, and how many events of each are left out since their group lies on several sides."""
    rows = splittable(spark, d).join(ops.leakage_groups(splittable(spark, d)), "component").withColumn("split", F.expr(_SPLIT))
    sides = rows.groupBy("group").agg((F.count_distinct("split") > 1).alias("mixed"))
    return rows.join(sides, "group").groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("mixed")).alias("excluded"))


@query("flt_07_events", on_events(f"SELECT event_id FROM ev WHERE start_us BETWEEN {fixtures.NOW_US - 15 * DAY} AND {fixtures.NOW_US - 5 * DAY}"))
def flt_07(spark, d):
    return event_tables(spark, d)[1].filter(F.col("start_us").between(fixtures.NOW_US - 15 * DAY, fixtures.NOW_US - 5 * DAY)).select("event_id")


# Zones ------------------------------------------------------------------------------------------------------

ZONE_KM = 6.0
ZONES = ("refinery", "factory", "power_plant", "mine")
_ZONE_LIST = "(" + ", ".join(f"'{z}'" for z in ZONES) + ")"
_ZH = f"zh AS (SELECT fac.facility_id, category, scored.*, {sql_km('lat_r', 'lon_r', 'lat', 'lon')} AS km FROM fac JOIN scored ON category IN {_ZONE_LIST} WHERE {sql_km('lat_r', 'lon_r', 'lat', 'lon')} <= {ZONE_KM})".replace("scored.*", "site_id, risk, risk_level, n_detections")


def zone_hotspots(spark, d, km: float = ZONE_KM) -> DataFrame:
    """(zone_id, category, site_id, risk, n_detections, distance_km) of hotspots within a zone's radius."""
    zones = fixtures.facilities(spark, d).filter(F.col("category").isin(*ZONES)).select(F.col("facility_id").alias("zone_id"), "category", F.col("lat_r").alias("lat"), F.col("lon_r").alias("lon"))
    hot = scored(spark, d).select("site_id", "risk", "n_detections", F.col("lat").alias("lat_r"), F.col("lon").alias("lon_r"))
    return radius_join(zones, hot, km, km)


@query("join_03_zone_radius", on_scored(f"SELECT facility_id AS zone_id, site_id, round(km, 6) AS distance_km FROM zh").replace(f"\nSELECT", f", {_ZH}\nSELECT"))
def join_03(spark, d):
    return zone_hotspots(spark, d).select("zone_id", "site_id", *r6("distance_km"))


_LEVEL_OF = "CASE " + " ".join(f"WHEN m BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in scoring.LEVELS) + " ELSE 'LOW' END"
_ZR = f"{_ZH}, zr AS (SELECT facility_id AS zone_id, category, max(risk) AS m, count(*) AS n, sum(n_detections)::BIGINT AS detections FROM zh GROUP BY ALL), zl AS (SELECT *, {_LEVEL_OF} AS level FROM zr)"


def zone_risk(spark, d) -> DataFrame:
    """Each zone's level by the gravest hotspot within it, and how it's to be watched; zones without hotspots are absent."""
    rows = zone_hotspots(spark, d).groupBy("zone_id", "category").agg(F.max("risk").alias("m"), F.count("*").alias("n"), F.sum("n_detections").alias("detections"))
    rows = rows.withColumn("level", scoring.risk_level("m"))
    return rows.withColumn("monitoring", F.when(F.col("level").isin("CRITICAL", "HIGH"), "INTENSIVE").when(F.col("level") == "ELEVATED", "ELEVATED").otherwise("ROUTINE"))


@query("agg_23_zone_risk", on_scored("SELECT zone_id, category, level, CASE WHEN level IN ('CRITICAL', 'HIGH') THEN 'INTENSIVE' WHEN level = 'ELEVATED' THEN 'ELEVATED' ELSE 'ROUTINE' END AS monitoring FROM zl").replace("\nSELECT", f", {_ZR}\nSELECT"))
def agg_23(spark, d):
    return zone_risk(spark, d).select("zone_id", "category", "level", "monitoring")


_ZI = f"""{_ZH}, al AS (SELECT o_custkey AS site_id, count(*) AS alerts FROM orders GROUP BY o_custkey), zk AS (SELECT zh.*, coalesce(alerts, 0) AS alerts, row_number() OVER (PARTITION BY facility_id ORDER BY risk DESC, site_id) AS k FROM zh LEFT JOIN al USING (site_id))"""


@query("agg_22_zone_intel", on_scored("SELECT facility_id AS zone_id, count(*) FILTER (WHERE km <= 1) AS within_1km, count(*) FILTER (WHERE km <= 5) AS within_5km, sum(n_detections)::BIGINT AS history, sum(alerts)::BIGINT AS alerts, string_agg(site_id::VARCHAR, ',' ORDER BY k) FILTER (WHERE k <= 20) AS top FROM zk GROUP BY facility_id").replace("\nSELECT", f", {_ZI}\nSELECT"))
def agg_22(spark, d):
    """What is around a zone: hotspots within 1 and 5 km, their history and alerts, and the 20 gravest of them in order."""
    near = lambda km: F.count_if(F.col("distance_km") <= km)
    alerts = fixtures.alerts(spark, d).groupBy("site_id").agg(F.count("*").alias("alerts"))
    rows = zone_hotspots(spark, d).join(alerts, "site_id", "left").withColumn("k", F.row_number().over(Window.partitionBy("zone_id").orderBy(F.desc("risk"), "site_id")))
    top = F.array_sort(F.collect_list(F.when(F.col("k") <= 20, F.struct("k", "site_id"))))
    return rows.groupBy("zone_id").agg(
        near(1).alias("within_1km"),
        near(5).alias("within_5km"),
        F.sum("n_detections").alias("history"),
        F.sum(F.coalesce("alerts", F.lit(0))).alias("alerts"),
        F.array_join(F.transform(top, lambda x: x["site_id"].cast("string")), ",").alias("top"),
    )


def zone_detail(spark, d, zone_id: int) -> DataFrame:
    """A zone by its id: what lies within 1 and 5 km, its history and alerts, and how it is to be watched. An error if there is no such zone."""
    zone = fixtures.facilities(spark, d).filter(F.col("category").isin(*ZONES) & (F.col("facility_id") == zone_id))
    if zone.isEmpty():
        raise LookupError(f"no zone {zone_id}")
    alerts = fixtures.alerts(spark, d).groupBy("site_id").agg(F.count("*").alias("alerts"))
    near = zone_hotspots(spark, d).filter(F.col("zone_id") == zone_id).join(alerts, "site_id", "left")
    sums = near.groupBy("zone_id").agg(
        F.count_if(F.col("distance_km") <= 1).alias("within_1km"), F.count_if(F.col("distance_km") <= 5).alias("within_5km"), F.sum(F.when(F.col("distance_km") <= 5, F.col("n_detections"))).alias("history"),
        F.sum(F.when(F.col("distance_km") <= 5, F.col("alerts"))).alias("alerts"), F.max("risk").alias("gravest"),
    )
    rows = zone.select(F.col("facility_id").alias("zone_id"), "name", "category").join(sums, "zone_id", "left").fillna(0, ["within_1km", "within_5km", "history", "alerts"])
    level = F.when(F.col("gravest").isNotNull(), scoring.risk_level("gravest")).otherwise("LOW")
    monitoring = F.when(level.isin("CRITICAL", "HIGH"), "INTENSIVE").when(level == "ELEVATED", "ELEVATED").otherwise("ROUTINE")
    access = F.when(monitoring == "INTENSIVE", "Restricted access possible").otherwise("Good")
    return rows.select("zone_id", "name", "category", "within_1km", "within_5km", "history", "alerts", level.alias("level"), monitoring.alias("monitoring"), access.alias("road_access"))


_FIRST_ZONE = f"(SELECT min(s_suppkey) FROM fac JOIN supplier ON s_suppkey = facility_id WHERE category IN {_ZONE_LIST})"


@query("orc_09_zone", on_scored(f"""SELECT z.facility_id AS zone_id, z.name, z.category, coalesce(w1, 0) AS within_1km, coalesce(w5, 0) AS within_5km, coalesce(h, 0)::BIGINT AS history, coalesce(al, 0)::BIGINT AS alerts,
coalesce(level, 'LOW') AS level, CASE WHEN level IN ('CRITICAL', 'HIGH') THEN 'INTENSIVE' WHEN level = 'ELEVATED' THEN 'ELEVATED' ELSE 'ROUTINE' END AS monitoring,
CASE WHEN level IN ('CRITICAL', 'HIGH') THEN 'Restricted access possible' ELSE 'Good' END AS road_access
FROM fac z LEFT JOIN zl ON zl.zone_id = z.facility_id LEFT JOIN (SELECT facility_id, count(*) FILTER (WHERE km <= 1) AS w1, count(*) FILTER (WHERE km <= 5) AS w5, sum(n_detections) FILTER (WHERE km <= 5) AS h, sum(alerts) FILTER (WHERE km <= 5) AS al FROM zk GROUP BY facility_id) c ON c.facility_id = z.facility_id
WHERE z.facility_id = {_FIRST_ZONE}""").replace("\nSELECT", f", {_ZI}, {_ZR.split(f'{_ZH}, ')[1]}\nSELECT", 1))
def orc_09(spark, d):
    """The detail of the zone of smallest id."""
    first = fixtures.facilities(spark, d).filter(F.col("category").isin(*ZONES)).agg(F.min("facility_id")).first()[0]
    return zone_detail(spark, d, first)


def zone_report(spark, d) -> DataFrame:
    """(zone_id, place, code, classification, risk, distance): the table of each zone's report, its 25 gravest hotspots in order."""
    w = Window.partitionBy("zone_id").orderBy(F.desc("risk"), "site_id")
    facts = scored(spark, d).select("site_id", "code", "classification", "risk_level")
    rows = zone_hotspots(spark, d).withColumn("place", F.row_number().over(w)).filter("place <= 25").join(facts, "site_id")
    return rows.select("zone_id", "place", "code", "classification", F.format_string("%.0f %s", "risk", "risk_level").alias("risk"), F.format_string("%.2f", "distance_km").alias("distance"))


@query("snk_07_zone_report", on_scored("SELECT facility_id AS zone_id, k AS place, printf('HX-%04d', site_id) AS code, classification, printf('%.0f %s', risk, risk_level) AS risk, printf('%.2f', km) AS distance FROM (SELECT zh.*, classification, row_number() OVER (PARTITION BY facility_id ORDER BY zh.risk DESC, site_id)::INT AS k FROM zh JOIN (SELECT site_id, classification FROM scored) USING (site_id)) WHERE k <= 25").replace("\nSELECT", f", {_ZH}\nSELECT", 1))
def snk_07_zone(spark, d):
    """The tabular part of all zones' reports."""
    return zone_report(spark, d)


@query("orc_11_activity", on_scored("SELECT facility_id AS zone_id, 'report.zone' AS action, 'zone:' || facility_id AS target, least(count(*), 25) AS lines FROM zh GROUP BY facility_id").replace("\nSELECT", f", {_ZH}\nSELECT", 1))
def orc_11_activity(spark, d):
    """The activity that the reports leave: a row for each, with how many hotspots it lists."""
    return zone_report(spark, d).groupBy("zone_id").agg(F.count("*").alias("lines")).select("zone_id", F.lit("report.zone").alias("action"), F.concat(F.lit("zone:"), F.col("zone_id").cast("string")).alias("target"), "lines")


@query("srt_02_zone_lex", on_scored("SELECT zone_id, level FROM zl ORDER BY level DESC, zone_id LIMIT 10").replace("\nSELECT", f", {_ZR}\nSELECT"))
def srt_02(spark, d):
    """The ten first zones by level as text, from MODERATE down to CRITICAL: the order of the letters."""
    return zone_risk(spark, d).orderBy(F.desc("level"), "zone_id").limit(10).select("zone_id", "level")


@query("srt_05_zone_top", on_scored("SELECT zone_id, site_id, k FROM (SELECT facility_id AS zone_id, site_id, row_number() OVER (PARTITION BY facility_id ORDER BY risk DESC, site_id)::INT AS k FROM zh) WHERE k <= 20").replace("\nSELECT", f", {_ZH}\nSELECT"))
def srt_05(spark, d):
    w = Window.partitionBy("zone_id").orderBy(F.desc("risk"), "site_id")
    return zone_hotspots(spark, d).withColumn("k", F.row_number().over(w)).filter("k <= 20").select("zone_id", "site_id", "k")


@query("join_13_knn", f"""WITH {DET_SQL}, {FAC_SQL}, {HOT_SQL}, km AS (SELECT site_id, category, facility_id, {sql_km('lat', 'lon', 'lat_r', 'lon_r')} AS km FROM hot, fac)
SELECT site_id, category, round(min(km), 3) AS distance_km, arg_min(facility_id, (km, facility_id)) AS facility_id FROM km GROUP BY site_id, category""")
def join_13(spark, d):
    hot = fixtures.hotspots(spark, d).select(F.col("site_id").alias("point_id"), "lat", "lon")
    near = nearest(hot, fixtures.facilities(spark, d).withColumnRenamed("facility_id", "feature_id"), "category")
    return near.select(F.col("point_id").alias("site_id"), "category", F.round("distance_km", 3).alias("distance_km"), F.col("feature_id").alias("facility_id"))


@query("geo_05_points_within", f"""WITH {DET_SQL}, {FAC_SQL}, {HOT_SQL} SELECT site_id, count(*) FILTER (WHERE km <= 5) AS within_5km, count(*) FILTER (WHERE km <= 50) AS within_50km FROM (SELECT site_id, {sql_km('lat', 'lon', 'lat_r', 'lon_r')} AS km FROM hot, fac WHERE category <> 'settlement') WHERE km <= 50 GROUP BY site_id""")
def geo_05(spark, d):
    hot = fixtures.hotspots(spark, d).select("site_id", "lat", "lon")
    pairs = radius_join(hot, fixtures.facilities(spark, d).filter("category <> 'settlement'").select("facility_id", "lat_r", "lon_r"), 50.0, 50.0)
    return pairs.groupBy("site_id").agg(F.count_if(F.col("distance_km") <= 5).alias("within_5km"), F.count("*").alias("within_50km"))


@query("geo_06_land_cover", on_scored("SELECT site_id, land_cover, in_forest, in_agriculture, in_urban FROM scored"))
def geo_06(spark, d):
    return scored(spark, d).select("site_id", "land_cover", "in_forest", "in_agriculture", "in_urban")


@query("join_14_point_in_polygon", f"WITH {DET_SQL}, {BOX_SQL} SELECT det_id, box_id, kind FROM det JOIN box ON lat BETWEEN south AND north AND lon BETWEEN west AND east")
def join_14(spark, d):
    """Every land-cover polygon that covers a detection, through the index of polygons."""
    boxes = fixtures.land_cover(spark)
    corner = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    ring = F.array(corner("west", "south"), corner("east", "south"), corner("east", "north"), corner("west", "north"), corner("west", "south"))
    cells = polygons.index(boxes.select("box_id", "kind", F.array(ring).alias("rings")))
    return polygons.covering(fixtures.detections(spark, d).select("det_id", "lat", "lon"), cells).select("det_id", "box_id", "kind")
