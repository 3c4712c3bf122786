"""The scored hotspots that the query surface is built on, and the same model as DuckDB SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import scoring
from emberline.operators.hotspots import DISTANCES, history_patterns, score, surroundings
from emberline.sources import fixtures

def site_patterns(spark: SparkSession, sf_dir: str, hot: DataFrame, days: int = 14) -> DataFrame:
    return history_patterns(hot, fixtures.detections(spark, sf_dir), days)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each hotspot with all that the queries filter, group and order by."""
    hot = fixtures.hotspots(spark, sf_dir)
    latest = fixtures.validations(hot).groupBy("site_id").agg(F.max_by("status", "validation_id").alias("validation"))
    features = fixtures.facilities(spark, sf_dir).withColumnRenamed("facility_id", "feature_id")
    around = surroundings(hot, features, fixtures.land_cover(spark))
    return score(hot, around, site_patterns(spark, sf_dir, hot), latest).withColumn("code", F.format_string("HX-%04d", "site_id"))


# DuckDB -------------------------------------------------------------------------------------------------------


def sql_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2)"
    return f"(2 * 6371.0088e0 * asin(sqrt(least(1e0, greatest(0e0, {a})))))"


def _near(category: str) -> str:
    return f"coalesce(round(min(km) FILTER (WHERE category = '{category}'), 3), -1e0)"


_BOX_KM = sql_km("lat", "lon", "least(greatest(lat, south), north)", "least(greatest(lon, west), east)")
_IN_BOX = "lat BETWEEN south AND north AND lon BETWEEN west AND east"
_CASE_SAT = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixtures.SATELLITES)
_LEVEL = "CASE " + " ".join(f"WHEN risk BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in scoring.LEVELS) + " ELSE 'LOW' END"
_CATEGORY = "[" + ", ".join(f"'{c}'" for c in fixtures.CATEGORIES) + "]"

DET_SQL = f"""det AS (SELECT event_id AS det_id, user_id AS site_id, epoch_us(ts) AS acq_us, {fixtures.LAT} AS lat, {fixtures.LON} AS lon,
  CASE WHEN event_id % 97 <> 0 THEN value END AS frp, CASE WHEN event_id % 101 <> 0 THEN 3e2 + 8e-1 * least(value, 15e1) END AS brightness,
  CASE WHEN event_id % 89 <> 0 THEN CASE WHEN hour(ts) BETWEEN 6 AND 17 THEN 'D' ELSE 'N' END END AS daynight,
  CASE event_type {_CASE_SAT} END AS satellite, CAST(json_extract(props, '$.k') AS BIGINT) / 1e2 AS confidence, r_name AS state, n_name AS district
  FROM events JOIN nation ON n_nationkey = user_id % 25 JOIN region ON n_regionkey = r_regionkey)"""
FAC_SQL = f"""fac AS (SELECT s_suppkey AS facility_id, {_CATEGORY}[(s_suppkey % 7 + 1)::INT] AS category, s_name AS name,
  8e0 + ((s_suppkey * 7919) % 2900) / 1e2 + (s_suppkey % 5) * 2e-2 AS lat_r, 68e0 + ((s_suppkey * 6101) % 2900) / 1e2 AS lon_r FROM supplier)"""
HOT_SQL = """hot AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY acq_us DESC, det_id DESC) AS k
  FROM det WHERE brightness IS NOT NULL AND frp IS NOT NULL) WHERE k = 1)"""
BOX_SQL = """box AS (SELECT id AS box_id, CASE id % 3 WHEN 0 THEN 'forest' WHEN 1 THEN 'agriculture' ELSE 'urban' END AS kind, lat0 - 5e-2 AS south, lat0 + 5e-2 AS north,
  lon0 - 5e-2 AS west, lon0 + 5e-2 AS east FROM (SELECT id, 8e0 + ((id * 7919) % 2900) / 1e2 AS lat0, 68e0 + ((id * 6101) % 2900) / 1e2 AS lon0 FROM range(25) t(id)))"""
INFRA_SQL = f"""km AS (SELECT site_id, facility_id, category, {sql_km('lat', 'lon', 'lat_r', 'lon_r')} AS km FROM hot, fac),
near AS (SELECT site_id, {', '.join(f'{_near(c)} AS {n}' for c, n in DISTANCES.items())},
  arg_min(facility_id, (km, facility_id)) FILTER (WHERE category <> 'settlement') AS facility_id FROM km GROUP BY site_id),
land AS (SELECT site_id, coalesce(round(min({_BOX_KM}) FILTER (WHERE kind = 'forest'), 3), -1e0) AS d_forest,
  coalesce(round(min({_BOX_KM}) FILTER (WHERE kind = 'agriculture'), 3), -1e0) AS d_agriculture, bool_or({_IN_BOX} AND kind = 'forest') AS in_forest,
  bool_or({_IN_BOX} AND kind = 'agriculture') AS in_agriculture, bool_or({_IN_BOX} AND kind = 'urban') AS in_urban FROM hot, box GROUP BY site_id),
infra AS (SELECT * FROM near JOIN land USING (site_id))"""


def sql_patterns(times: str, key: str, days: int, name: str) -> str:
    """CTEs up to ``name``: as patterns(), from a relation (key, us, now_us)."""
    return f"""{name}_t AS (SELECT DISTINCT {key}, us, now_us FROM {times} WHERE us <= now_us AND us >= now_us - {days} * 86400000000),
{name}_g AS (SELECT *, (us - lag(us) OVER (PARTITION BY {key} ORDER BY us)) / 3.6e9 AS gap FROM {name}_t),
{name}_s AS (SELECT {key}, count(*) AS n, count(DISTINCT us // 86400000000) AS active_days, greatest(1e0, (max(us) - min(us)) / 8.64e10) AS span_days,
  avg(gap) AS mean_gap, stddev_pop(gap) AS std_gap, max(us) AS last_us, max(now_us) AS now_us FROM {name}_g GROUP BY {key}),
{name}_p AS (SELECT *, CASE WHEN n >= 2 THEN least(1e2, 6e0 * active_days
  + 25e0 * CASE WHEN mean_gap = 0 THEN 0e0 ELSE greatest(0e0, 1e0 - least(1e0, (std_gap / greatest(mean_gap, 1e-9)) / 1.2e0)) END
  + 15e0 * least(1e0, (n * mean_gap / 24e0) / {days}e0)) ELSE 0e0 END AS persistence_score FROM {name}_s),
{name} AS (SELECT *, CASE WHEN n = 1 THEN CASE WHEN (now_us - last_us) / 3.6e9 < 72 THEN 'sudden' ELSE 'unknown' END
  WHEN persistence_score >= 50 AND mean_gap <= 36 AND std_gap <= 24 THEN 'persistent'
  WHEN persistence_score >= 50 THEN CASE WHEN n >= 5 THEN 'persistent' ELSE 'recurring' END
  WHEN n <= 3 THEN CASE WHEN span_days <= 2 THEN 'sudden' ELSE 'intermittent' END
  ELSE CASE WHEN mean_gap > 48 THEN 'recurring' ELSE 'intermittent' END END AS pattern FROM {name}_p)"""


_LEAST = lambda *cs: "coalesce(least(" + ", ".join(f"CASE WHEN {c} >= 0 THEN {c} END" for c in cs) + "), -1e0)"
_CLOSE, _VERY = "(d_industrial >= 0 AND d_industrial < 8)", "(d_industrial >= 0 AND d_industrial < 3)"
_PERS = "(persistence_score >= 50 AND n_detections >= 4)"
_SUDDEN = f"(NOT {_PERS} AND n_detections <= 2 AND (brightness > 345 OR frp > 40))"
_IND, _FOR, _AGR = (f"(land_cover = '{x}')" for x in ("Industrial", "Forest", "Agriculture"))
_FIRE = f"({_SUDDEN} AND ({_CLOSE} OR {_IND}) AND (brightness >= 360 OR frp >= 60))"
_HEAT = f"({_PERS} AND ({_CLOSE} OR {_IND}))"
_FLARE = f"({_PERS} AND brightness >= 360 AND frp >= 60 AND ({_VERY} OR {_IND}))"
_WILD = f"(((d_forest >= 0 AND d_forest < 6) OR {_FOR}) AND NOT {_CLOSE} AND NOT {_AGR})"
_FARM = f"(((d_agriculture >= 0 AND d_agriculture < 4) OR {_AGR}) AND NOT {_FOR})"
_IF = lambda c, v: f"CASE WHEN {c} THEN {v} ELSE 0e0 END"
_S = [
    f"5e-2 + {_IF(_FIRE, 3.5)} + {_IF(f'{_FIRE} AND brightness >= 360', 0.75)} + {_IF(f'{_FIRE} AND frp >= 60', 0.75)} + {_IF(f'{_FIRE} AND d_industrial < 0.5', 0.5)}",
    f"5e-2 + {_IF(_HEAT, 3.5)} + {_IF(f'{_HEAT} AND {_VERY}', 1.0)} + {_IF(f'{_HEAT} AND NOT brightness >= 360', 0.5)} + {_IF(f'{_HEAT} AND n_detections >= 8', 0.5)}",
    f"5e-2 + {_IF(_FLARE, 4.0)} + {_IF(f'{_FLARE} AND d_industrial < 1', 1.0)} + {_IF(f'{_FLARE} AND frp >= 90', 1.0)}",
    f"5e-2 + {_IF(_WILD, 3.0)} + {_IF(f'{_WILD} AND {_FOR}', 1.0)} + {_IF(f'{_WILD} AND NOT {_SUDDEN} AND n_detections >= 3', 0.5)} + {_IF(f'{_WILD} AND (d_industrial < 0 OR d_industrial >= 8)', 0.5)}",
    f"5e-2 + {_IF(_FARM, 3.0)} + {_IF(f'{_FARM} AND {_AGR}', 1.5)} + {_IF(f'{_FARM} AND NOT brightness >= 360 AND NOT frp >= 60', 0.5)} + {_IF(f'{_FARM} AND tod >= 0.5', 0.5)} + {_IF(f'{_FARM} AND n_detections <= 3', 0.25)}",
    "5e-2",
]
_E = [f"exp(((s{k}) - top) / 1.2e0)" for k in range(6)]
_CLAMP = lambda x: f"greatest(0e0, least(1e2, {x}))"
_RISK = f"""0.2e0 * {_CLAMP('(brightness - 300) / 110e0 * 1e2')} + 0.15e0 * least(1e2, frp * 1.1e0)
  + 0.15e0 * CASE WHEN d_industrial < 0 THEN 1e1 WHEN d_industrial > 8 THEN 0e0 ELSE {_CLAMP('d_industrial / 8e0 * 1e2')} END
  + 0.15e0 * CASE WHEN d_settlement < 0 THEN 5e0 ELSE {_CLAMP('1e2 - 6e0 * d_settlement')} END
  + 0.08e0 * CASE WHEN d_forest < 0 THEN 1e1 ELSE {_CLAMP('1e2 - 14e0 * d_forest')} END * CASE WHEN classification IN ('Wildfire', 'Industrial Fire') THEN 1e0 ELSE 0.6e0 END
  + 0.05e0 * CASE WHEN d_agriculture < 0 THEN 5e0 ELSE {_CLAMP('1e2 - 20e0 * d_agriculture')} END + 0.1e0 * {_CLAMP('persistence_score')}
  + 0.07e0 * CASE validation WHEN 'CONFIRMED' THEN 9e1 WHEN 'LIKELY' THEN 7e1 WHEN 'UNCERTAIN' THEN 4e1 ELSE 25e0 END
  + 0.05e0 * CASE pattern WHEN 'persistent' THEN 45e0 WHEN 'recurring' THEN 6e1 WHEN 'sudden' THEN 25e0 WHEN 'intermittent' THEN 35e0 ELSE 15e0 END
  + CASE WHEN classification = 'Industrial Fire' THEN CASE WHEN d_settlement BETWEEN 0 AND 5 THEN 28e0 ELSE 18e0 END WHEN classification = 'Gas Flare' THEN 7e0
    WHEN classification = 'Wildfire' AND d_settlement BETWEEN 0 AND 5 THEN 1e1 WHEN classification = 'Agricultural Burning' THEN -6e0 ELSE 0e0 END"""
_TOP = "CASE " + " ".join(f"WHEN p{k} = class_confidence THEN '{c}'" for k, c in enumerate(scoring.CLASSES)) + " END"

VAL_SQL = """val AS (SELECT site_id * 2 + k AS validation_id, site_id, ['CONFIRMED', 'LIKELY', 'UNCERTAIN', 'NOT VALIDATED'][((site_id + k) % 4 + 1)::INT] AS status
  FROM hot, range(2) t(k) WHERE site_id % 6 = 0)"""
SCORED_SQL = f"""{DET_SQL}, {FAC_SQL}, {HOT_SQL}, {BOX_SQL}, {INFRA_SQL}, {VAL_SQL},
latest AS (SELECT site_id, arg_max(status, validation_id) AS validation FROM val GROUP BY site_id),
times AS (SELECT det.site_id, det.acq_us AS us, hot.acq_us AS now_us FROM det JOIN hot USING (site_id)),
{sql_patterns('times', 'site_id', 14, 'pat')},
joined AS MATERIALIZED (SELECT hot.*, infra.* EXCLUDE (site_id), n AS n_detections, active_days, mean_gap, std_gap, persistence_score, pattern,
  coalesce(validation, 'NOT VALIDATED') AS validation, printf('HX-%04d', hot.site_id) AS code, make_timestamp(hot.acq_us) AS acq_ts, n / 14e0 AS historical_frequency,
  {_LEAST('d_refinery', 'd_factory', 'd_power_plant', 'd_mine')} AS d_industrial, {_LEAST('d_refinery', 'd_factory', 'd_power_plant', 'd_mine', 'd_area')} AS d_any,
  greatest(0e0, least(1e0, 1e0 - abs(hour(make_timestamp(hot.acq_us)) + minute(make_timestamp(hot.acq_us)) / 6e1 - 12) / 12e0)) AS tod
  FROM hot JOIN infra USING (site_id) JOIN pat USING (site_id) LEFT JOIN latest USING (site_id)),
covered AS MATERIALIZED (SELECT * EXCLUDE (d_any), CASE WHEN d_any BETWEEN 0 AND 3 THEN 'Industrial' WHEN in_forest THEN 'Forest' WHEN in_agriculture THEN 'Agriculture'
  WHEN d_settlement BETWEEN 0 AND 5 THEN 'Urban' ELSE 'Other' END AS land_cover FROM joined),
ruled AS MATERIALIZED (SELECT *, {', '.join(f'{s} AS s{k}' for k, s in enumerate(_S))} FROM covered),
topped AS (SELECT *, greatest(s0, s1, s2, s3, s4, s5) AS top FROM ruled),
probs AS MATERIALIZED (SELECT *, {', '.join(f"CASE WHEN top <= 0.1 THEN {0.75 if k == 5 else 0.05}::DOUBLE ELSE {e} / ({' + '.join(_E)}) END AS p{k}" for k, e in enumerate(_E))} FROM topped),
best AS (SELECT *, greatest(p0, p1, p2, p3, p4, p5) AS class_confidence FROM probs),
named AS MATERIALIZED (SELECT *, {_TOP} AS classification FROM best),
risky AS MATERIALIZED (SELECT *, {_CLAMP(_RISK)} AS risk FROM named),
scored AS (SELECT *, {_LEVEL} AS risk_level FROM risky)"""


def on_scored(select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{SCORED_SQL}\n{select}"
