"""The event table for training: spatial fields, typed columns, splits, preparation, models."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.temporal import patterns
from emberline.operators import anomaly, artifacts, attribution, dataset, spatial, training
from emberline.operators import events as ops
from emberline.operators.radius import KM_A_DEGREE
from emberline.plans.events import _GROUPS, _HIST, event_tables, on_events, splittable
from emberline.plans.model import BOX_SQL, FAC_SQL, sql_km
from emberline.plans.records import latest_annotations
from emberline.plans.registry import query, remembered
from emberline.plans.workflow import _LABEL
from emberline.session import free_shuffles, scratch_path
from emberline.sources import fixtures

K = repr(KM_A_DEGREE)


def spatial_fields(spark, d) -> DataFrame:
    """(component, the 20 spatial fields), made once a session and input."""
    return remembered(spark, d, "spatial-fields", lambda: _spatial_fields(spark, d))


def _spatial_fields(spark, d) -> DataFrame:
    events = _event_points(spark, d)
    facilities = fixtures.facilities(spark, d).withColumnRenamed("facility_id", "feature_id")
    return spatial.event_spatial_features(events, facilities, fixtures.land_polygons(spark, d), fixtures.surveyed(spark)).withColumnRenamed("point_id", "component")


#: What lies around: all polygons as boxes, and the regions that were surveyed.
_AREAS = f"""area AS (SELECT (box_id + 1000000000)::VARCHAR AS fid, kind, NULL AS ftype, true AS landcover, south, north, west, east FROM box
  UNION ALL SELECT facility_id::VARCHAR, 'industrial', category, false, lat_r - 1e-2, lat_r + 1e-2, lon_r - 1e-2, lon_r + 1e-2 FROM fac WHERE facility_id % 3 = 0 AND category <> 'settlement'
  UNION ALL SELECT (facility_id + 2000000000)::VARCHAR, 'industrial', NULL, true, lat_r + 7e-2, lat_r + 13e-2, lon_r + 7e-2, lon_r + 13e-2 FROM fac WHERE facility_id % 11 = 5),
survey AS (SELECT kind, south - 1 AS south, north + 1 AS north, west - 1 AS west, east + 1 AS east FROM box UNION ALL SELECT 'industrial', 10e0, 28e0, 70e0, 92e0)"""
_IN = "c_lat BETWEEN south AND north AND c_lon BETWEEN west AND east"
_PLANE = f"sqrt(pow(greatest(south - c_lat, 0, c_lat - north) * {K}, 2) + pow(greatest(west - c_lon, 0, c_lon - east) * cos(radians(c_lat)) * {K}, 2))"


def sql_share(boxes: str, name: str) -> str:
    """CTEs up to ``name`` (component, kind, share): how much of the circle of 256 corners and one kilometre around (c_lat, c_lon) of ``ev`` the boxes of a
    relation (kind, south, north, west, east) cover together, by upright slabs between all corners and crossings."""
    return f"""{name}_n AS (SELECT component, kind, (south - c_lat) * {K} AS y0, (north - c_lat) * {K} AS y1, (west - c_lon) * cos(radians(c_lat)) * {K} AS x0, (east - c_lon) * cos(radians(c_lat)) * {K} AS x1
  FROM ev JOIN {boxes} ON c_lat BETWEEN south - 2e-2 AND north + 2e-2 AND c_lon BETWEEN west - 4e-2 AND east + 4e-2),
{name}_b AS (SELECT * FROM {name}_n WHERE x0 < 1 AND x1 > -1 AND y0 < 1 AND y1 > -1),
{name}_v AS (SELECT i, cos(pi() - i * pi() / 128) AS x, sin(i * pi() / 128) AS y FROM range(129) t(i)),
{name}_g AS (SELECT a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM {name}_v a JOIN {name}_v b ON b.i = a.i + 1),
{name}_x AS (SELECT DISTINCT component, kind, x FROM (SELECT component, kind, x FROM (SELECT DISTINCT component, kind FROM {name}_b), {name}_v
  UNION ALL SELECT component, kind, greatest(-1e0, least(1e0, unnest([x0, x1]))) FROM {name}_b
  UNION ALL SELECT component, kind, xa + (h - ya) / (yb - ya) * (xb - xa) FROM (SELECT component, kind, abs(unnest([y0, y1])) AS h FROM {name}_b) JOIN {name}_g ON ya <> yb AND (ya - h) * (yb - h) <= 0)),
{name}_s AS (SELECT component, kind, x, lead(x) OVER (PARTITION BY component, kind ORDER BY x) AS nx FROM {name}_x),
{name}_m AS (SELECT s.*, (x + nx) / 2 AS m, ya + ((x + nx) / 2 - xa) / (xb - xa) * (yb - ya) AS h FROM {name}_s s JOIN {name}_g ON (x + nx) / 2 >= xa AND (x + nx) / 2 < xb WHERE nx > x),
{name}_i AS (SELECT m.component, m.kind, x, nx, greatest(y0, -h) AS lo, least(y1, h) AS hi FROM {name}_m m JOIN {name}_b b ON b.component = m.component AND b.kind = m.kind AND x0 <= m AND m <= x1 WHERE greatest(y0, -h) < least(y1, h)),
{name}_u AS (SELECT *, max(hi) OVER (PARTITION BY component, kind, x ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {name}_i),
{name} AS (SELECT component, kind, least(1e0, sum((nx - x) * greatest(0e0, hi - greatest(lo, coalesce(before, lo)))) / (128 * sin(pi() / 128))) AS share FROM {name}_u GROUP BY component, kind)"""


_ON = {"forest": "inside_forest", "agriculture": "inside_agriculture", "urban": "inside_urban", "industrial": "inside_industrial_polygon"}
_SPATIAL = f"""{FAC_SQL}, {BOX_SQL}, {_AREAS},
fkm AS (SELECT component, facility_id::VARCHAR AS fid, category, {sql_km('c_lat', 'c_lon', 'lat_r', 'lon_r')} AS exact FROM ev, fac),
akm AS (SELECT component, fid, kind, ftype, landcover, {_PLANE} AS exact, {_IN} AS inside FROM ev, area),
reached AS (SELECT component, category AS what, fid, round(exact, 3) AS km FROM fkm UNION ALL SELECT component, ftype, fid, exact FROM akm WHERE NOT landcover),
within AS (SELECT component, fid, exact FROM fkm WHERE category <> 'settlement' UNION ALL SELECT component, fid, exact FROM akm WHERE NOT landcover),
fnear AS (SELECT component, {', '.join(f"min(km) FILTER (WHERE what = '{c}') AS dist_{n}_km" for c, n in (('refinery', 'refinery'), ('factory', 'factory'), ('power_plant', 'powerplant'), ('mine', 'mine'), ('settlement', 'settlement')))},
  min({{'k': km, 'f': fid, 'w': what}}) FILTER (WHERE what <> 'settlement') AS best FROM reached GROUP BY component),
fcount AS (SELECT component, {', '.join(f"count(DISTINCT fid) FILTER (WHERE exact <= {r}) AS industrial_count_{n}" for r, n in spatial.RADII)} FROM within GROUP BY component),
seen AS (SELECT component, {', '.join(f"coalesce(bool_or({_IN} AND kind = '{k}'), false) AS seen_{k}" for k in _ON)} FROM ev, survey GROUP BY component),
bnear AS (SELECT component, {', '.join(f"round(min(exact) FILTER (WHERE kind = '{k}'), 3) AS to_{k}" for k in ('forest', 'agriculture', 'industrial'))},
  {', '.join(f"CASE WHEN bool_or(inside AND kind = '{k}') THEN true WHEN any_value(seen_{k}) THEN false END AS {n}" for k, n in _ON.items())} FROM akm JOIN seen USING (component) GROUP BY component),
{sql_share('area', 'part')}, {sql_share('survey', 'whole')},
fields AS (SELECT component, best.f AS nearest_facility_id, best.w AS nearest_facility_type, least(best.k, to_industrial) AS dist_nearest_industrial_km, to_forest AS dist_forest_km, to_agriculture AS dist_agriculture_km,
  fnear.* EXCLUDE (component, best), fcount.* EXCLUDE (component), {', '.join(_ON.values())},
  {', '.join(f"CASE WHEN (SELECT share FROM whole w WHERE w.component = fnear.component AND w.kind = '{k}') >= 1 - 1e-9 THEN coalesce((SELECT share FROM part p WHERE p.component = fnear.component AND p.kind = '{k}'), 0) END AS {k}_fraction_1km" for k in spatial.FRACTIONS)}
  FROM fnear JOIN fcount USING (component) JOIN bnear USING (component))"""
_SIX = {"dist_nearest_industrial_km", "dist_refinery_km", "dist_factory_km", "dist_powerplant_km", "dist_mine_km", "dist_settlement_km", "dist_forest_km", "dist_agriculture_km", *[f"{k}_fraction_1km" for k in spatial.FRACTIONS]}
_FIELDS = ", ".join(f"round({c}, 6) AS {c}" if c in _SIX else c for c in dataset.SPATIAL)


@query("geo_08_spatial", on_events(f"SELECT event_id, {_FIELDS} FROM ev JOIN fields USING (component)", _SPATIAL))
def geo_08(spark, d):
    """All 20 fields: distances, counts, the nearest facility, and what covers the event and its surroundings."""
    rows = spatial_fields(spark, d).join(event_tables(spark, d)[1].select("component", "event_id"), "component")
    return rows.select("event_id", *[F.round(c, 6).alias(c) if c in _SIX else F.col(c) for c in dataset.SPATIAL])


@query("geo_09_fractions", on_events("SELECT event_id, round(forest_fraction_1km, 9) AS forest_fraction_1km, round(agriculture_fraction_1km, 9) AS agriculture_fraction_1km, round(industrial_fraction_1km, 9) AS industrial_fraction_1km FROM ev JOIN fields USING (component)", _SPATIAL))
def geo_09(spark, d):
    """Share of the kilometre around an event that a kind of land cover takes; overlapping polygons count once."""
    rows = spatial_fields(spark, d).join(event_tables(spark, d)[1].select("component", "event_id"), "component")
    return rows.select("event_id", *[F.round(f"{k}_fraction_1km", 9).alias(f"{k}_fraction_1km") for k in spatial.FRACTIONS])


def event_table(spark, d) -> DataFrame:
    """The typed table of 69 columns, made once a session and input."""
    return remembered(spark, d, "typed-events", lambda: described(spark, d))


def described(spark, d) -> DataFrame:
    """Events, what lies around them, and their past, as the typed table has them."""
    det = fixtures.detections(spark, d)
    member, event = event_tables(spark, d)
    past = ops.history(event, det).drop("event_id", "start_us", "mean_frp")
    times = det.select("det_id", F.col("acq_us").alias("us")).join(member, "det_id").join(event.select("component", F.col("end_us").alias("now_us")), "component")
    pattern = patterns(times.select("component", "us", "now_us"), "component", 14).select("component", "persistence_score", F.col("pattern").alias("temporal_pattern"))
    rows = event.join(spatial_fields(spark, d), "component").join(past, "component").join(pattern, "component", "left")
    iso = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return dataset.typed(
        rows.withColumnsRenamed({
            "lat": "centroid_latitude", "lon": "centroid_longitude", "day_ratio": "day_detection_ratio", "night_ratio": "night_detection_ratio", "unknown_ratio": "unknown_daynight_ratio",
            "mean_interval_hours": "mean_detection_interval_hours", "std_interval_hours": "std_detection_interval_hours", "past_day_ratio": "day_ratio",
        }).withColumns({
            "start_time": F.timestamp_micros("start_us"), "end_time": F.timestamp_micros("end_us"), "night_ratio": 1 - F.col("day_ratio"),
            "history_start": iso(F.col("start_us") - F.lit(90 * fixtures.DAY_US)), "history_end_exclusive": iso("start_us"),
            "data_source": F.lit("star schema"), "reference_source": F.lit("suppliers and boxes"), "schema_version": F.lit(dataset.VERSION),
        })
    )


@query("prj_10_typed", on_events("SELECT event_id, round(c_lat, 6) AS centroid_latitude, make_timestamp(start_us) AS start_time, detection_count, industrial_count_5km, round(dist_forest_km, 6) AS dist_forest_km, inside_forest, coalesce(detections_90d, 0) AS detections_90d, 'thermal-events-v1' AS schema_version, NULL::VARCHAR AS instrument FROM ev JOIN fields USING (component) LEFT JOIN hist USING (component)", f"{_SPATIAL}, {_HIST}"))
def prj_10(spark, d):
    """Ten of the 69 columns as the typed table has them."""
    rows = event_table(spark, d)
    r = lambda c: F.round(c, 6).alias(c)
    return rows.select("event_id", r("centroid_latitude"), F.col("start_time").cast("timestamp_ntz").alias("start_time"), "detection_count", "industrial_count_5km", r("dist_forest_km"), "inside_forest", "detections_90d", "schema_version", "instrument")


@query("orc_13_schema")
def orc_13(spark, d):
    """The schema of the typed table that the events give, with how many nulls each column holds."""
    rows = event_table(spark, d)
    nulls = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in dataset.COLUMNS])
    counted = nulls.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("nulls")) for c in dataset.COLUMNS])).alias("x")).select("x.*")
    return dataset.schema_rows(spark).join(counted, "name")


_BROKEN = {"id_missing": "component % 7 = 0", "time_range": "component % 11 = 0", "coordinates": "component % 13 = 0", "no_detection": "component % 17 = 0", "not_finite": "component % 19 = 0", "not_a_share": "component % 23 = 0"}


@query("agg_31_checks", on_events("SELECT unnest([" + ", ".join(f"{{'check': '{name}', 'n': count(*) FILTER (WHERE {bad})}}" for name, bad in _BROKEN.items()) + ", {'check': 'id_repeated', 'n': count(*) FILTER (WHERE component % 7 <> 0 AND component % 29 = 0)}], recursive := true) FROM ev"))
def agg_31(spark, d):
    """What the checks of the typed table count in one that is broken on purpose, each kind in other rows, some events twice."""
    rows = event_table(spark, d).join(event_tables(spark, d)[1].select("component", "event_id"), "event_id")
    bad = {name: F.expr(x) for name, x in _BROKEN.items()}
    twice = rows.filter("component % 7 <> 0 and component % 29 = 0").withColumn("component", F.lit(1).cast("long"))
    sound = rows.withColumns({
        "event_id": F.when(~bad["id_missing"], F.col("event_id")), "end_time": F.when(bad["time_range"], F.col("start_time") - F.expr("interval 1 hour")).otherwise(F.col("end_time")),
        "centroid_latitude": F.when(bad["coordinates"], 95.0).otherwise(F.col("centroid_latitude")), "detection_count": F.when(bad["no_detection"], 0).otherwise(F.col("detection_count")),
        "mean_frp": F.when(bad["not_finite"], float("nan")).otherwise(F.col("mean_frp")), "night_ratio": F.when(bad["not_a_share"], 1.5).otherwise(F.col("night_ratio")),
    })
    return dataset.problems(dataset.typed(sound.unionByName(twice)))


@query("agg_31_coverage", on_events(f"""SELECT kind, count(*) FILTER (WHERE coalesce(at_centroid, false)) AS at_centroid, count(*) FILTER (WHERE coalesce(share, 0) >= 1 - 1e-9) AS full_circle, count(*) AS events
FROM ev JOIN (SELECT DISTINCT kind FROM survey) ON true LEFT JOIN (SELECT component, kind, bool_or({_IN}) AS at_centroid FROM ev, survey GROUP BY ALL) USING (component, kind) LEFT JOIN whole USING (component, kind) GROUP BY kind""", _SPATIAL))
def agg_31_coverage(spark, d):
    """How many events each surveyed kind covers: at the centroid, and all of the kilometre around it."""
    rows, _ = spatial.reference_audit(_event_points(spark, d), fixtures.administrative(spark), fixtures.surveyed(spark))
    return rows.groupBy("kind").agg(F.count_if("at_centroid").alias("at_centroid"), F.count_if("full_circle").alias("full_circle"), F.count("*").alias("events"))


@query("agg_31_administrative", on_events("SELECT event_id, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (WHERE c_lat BETWEEN y AND y + 7 AND c_lon BETWEEN x AND x + 7), '') AS areas FROM ev, (SELECT id, 7e0 + (id // 5) * 6 AS y, 67e0 + (id % 5) * 6 AS x FROM range(20) t(id)) GROUP BY event_id"))
def agg_31_administrative(spark, d):
    """The administrative areas that each event lies in: all of them, borders included."""
    _, rows = spatial.reference_audit(_event_points(spark, d), fixtures.administrative(spark), fixtures.surveyed(spark))
    named = rows.join(event_tables(spark, d)[1].select(F.col("component").alias("point_id"), "event_id"), "point_id")
    return named.select("event_id", F.array_join(F.transform("feature_ids", lambda x: x.cast("string")), ",").alias("areas"))


def _event_points(spark, d) -> DataFrame:
    return event_tables(spark, d)[1].select(F.col("component").alias("point_id"), "lat", "lon")


@query("snk_01_write", on_events("SELECT event_id, start_us, detection_count, round(max_frp, 6) AS max_frp, satellite, true AS same FROM ev"))
def snk_01(spark, d):
    """The typed table written, and its rows as read back; their content hash is the written table's whatever the partitions, and not that of other rows."""
    rows = event_table(spark, d)
    path = scratch_path(spark, "typed-events")
    said = dataset.write(rows, path).first().digest
    back = spark.read.parquet(path)
    other = back.withColumn("detection_count", F.when(F.col("event_id") == back.agg(F.min("event_id")).first()[0], F.col("detection_count") + 1).otherwise(F.col("detection_count")))
    same = dataset.content_hash(back.repartition(3)).first().digest == said != dataset.content_hash(other).first().digest
    return back.select("event_id", F.unix_micros("start_time").alias("start_us"), "detection_count", F.round("max_frp", 6).alias("max_frp"), "satellite", F.lit(same).alias("same"))


def artifact_parts(spark, d, keep: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean, membership, typed events) of the events whose component a condition keeps."""
    member, event = event_tables(spark, d)
    ids = member.filter(keep).join(event.select("component", "event_id"), "component")
    named = F.concat(F.lit("d"), F.col("det_id").cast("string")).alias("detection_id")
    clean = fixtures.detections(spark, d).join(ids.select("det_id"), "det_id").select(named, "acq_us", "lat", "lon", "frp", "brightness")
    return clean, ids.select(named, "event_id"), event_table(spark, d).join(event.filter(keep).select("event_id"), "event_id", "left_semi")


def event_store(spark, d) -> str:
    """Where two artifacts were imported, the first of them twice: those of even components, then the others."""

    def run() -> str:
        store = scratch_path(spark, "event-store")
        reference = fixtures.facilities(spark, d).withColumnRenamed("facility_id", "feature_id")
        for keep in ("component % 2 = 0", "component % 2 = 0", "component % 2 = 1"):
            folder = scratch_path(spark, "artifact")
            artifacts.build(spark, folder, *artifact_parts(spark, d, keep), reference, {"clustering": {"km": 1.0, "hours": 24.0}})
            artifacts.import_events(spark, folder, store)
            artifacts.delete(spark, folder)
            free_shuffles(spark)
        return store

    return remembered(spark, d, "event-store", lambda: spark.createDataFrame([(run(),)], "place string")).first().place


@query("snk_09_imported", on_events("SELECT event_id, detection_count, detection_count AS observations, round(max_frp, 6) AS max_frp FROM ev"))
def snk_09_imported(spark, d):
    """The events in the store after all imports, with the observations that came with them: each once, whatever was imported twice."""
    store = event_store(spark, d)
    seen = artifacts.imported(spark, store, "observations").groupBy("event_id").agg(F.count("*").alias("observations"))
    return artifacts.imported(spark, store, "events").join(seen, "event_id").select("event_id", "detection_count", "observations", F.round("max_frp", 6).alias("max_frp"))


@query("snk_03_manifest", on_events("""SELECT unnest([{'part': 'clean', 'rows': (SELECT count(*) FROM det)}, {'part': 'membership', 'rows': (SELECT count(*) FROM comp)}, {'part': 'events', 'rows': (SELECT count(*) FROM ev)}, {'part': 'reference', 'rows': (SELECT count(*) FROM supplier)}], recursive := true), true AS sound"""))
def snk_03(spark, d):
    """What the manifest of all events' artifact says: each part's rows, and whether the parts are what it says."""
    folder = scratch_path(spark, "artifact")
    reference = fixtures.facilities(spark, d).withColumnRenamed("facility_id", "feature_id")
    made = artifacts.build(spark, folder, *artifact_parts(spark, d, "component is not null"), reference)
    sound = artifacts.verify(spark, folder) == []
    return spark.createDataFrame([(p, said["rows"], sound) for p, said in made["parts"].items()], "part string, rows long, sound boolean")


# Training ---------------------------------------------------------------------------------------------------

_RANKED = "ranked AS (SELECT grp, row_number() OVER (ORDER BY md5('42|' || grp::VARCHAR), grp) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM grp))"
_CUT = "least(n - 2, greatest(1, floor(n * 0.6e0)))"
_SIDES = f"{_GROUPS}, {_RANKED}, side AS (SELECT component, CASE WHEN k <= {_CUT} THEN 'train' WHEN k <= least(n - 1, greatest({_CUT} + 1, floor(n * 0.8e0))) THEN 'validation' ELSE 'test' END AS split FROM grp JOIN ranked USING (grp))"


@query("mlx_02_splits", on_events("SELECT event_id, split FROM ev JOIN side USING (component)", _SIDES))
def mlx_02(spark, d):
    """Events split by groups: all of a group on one side."""
    rows = splittable(spark, d)
    return training.group_split(rows.select("component", "event_id"), ops.leakage_groups(rows)).select("event_id", "split")


@query("mlx_02_temporal", on_events(f"""SELECT event_id, CASE WHEN min(side) OVER (PARTITION BY grp) <> max(side) OVER (PARTITION BY grp) THEN 'excluded' ELSE side END AS split FROM (SELECT event_id, grp,
CASE WHEN end_us < {fixtures.NOW_US - 20 * fixtures.DAY_US} THEN 'train' WHEN start_us >= {fixtures.NOW_US - 18 * fixtures.DAY_US} AND end_us < {fixtures.NOW_US - 10 * fixtures.DAY_US} THEN 'validation'
WHEN start_us >= {fixtures.NOW_US - 8 * fixtures.DAY_US} THEN 'test' ELSE 'excluded' END AS side FROM ev JOIN grp USING (component))""", _GROUPS))
def mlx_02_temporal(spark, d):
    """Events split by time, with an embargo after each cut; groups that touch several sides are left out."""
    rows = splittable(spark, d).join(event_tables(spark, d)[1].select("component", "end_us"), "component")
    first, second = fixtures.NOW_US - 20 * fixtures.DAY_US, fixtures.NOW_US - 10 * fixtures.DAY_US
    return training.temporal_split(rows, ops.leakage_groups(splittable(spark, d)), first, second, 2 * fixtures.DAY_US).select("event_id", "split")


def labelled(spark, d) -> DataFrame:
    """Typed events with label (of three kinds) and split, for those that are annotated."""
    named = F.when(F.col("label").isin("Gas Flare", "Wildfire"), F.col("label")).otherwise("Other")
    rows = splittable(spark, d)
    label = latest_annotations(spark, d, rows.select(F.col("component").alias("event_key"))).select(F.col("event_key").alias("component"), named.alias("label"))
    sides = training.group_split(rows.select("component", "event_id"), ops.leakage_groups(rows)).join(label, "component")
    return event_table(spark, d).join(sides.drop("component"), "event_id")


_LABELLED = f"{_SIDES}, {_LABEL}, {_HIST}, tr AS (SELECT * FROM ev JOIN side USING (component) JOIN lab ON lab.event_key = component LEFT JOIN hist USING (component))"


#: Features by their columns in the SQL of events and histories; all others of the 62 that SQL names alike.
_NAMES = {"historical_mean_frp": "hm", "historical_median_frp": "hmed", "historical_std_frp": "hs", "historical_max_frp": "hx", "historical_mean_brightness": "hb", "mean_detection_interval_hours": "gm", "std_detection_interval_hours": "gs", "spatial_location_variance": "variance"}
_SQL_FEATURES = {c: c for c in ("duration_minutes", "detection_count", "mean_frp", "max_frp", "min_frp", "std_frp", "mean_brightness", "max_brightness", "spatial_radius_km", *[x for x in dataset.SPATIAL if x in training.FEATURES])} | _NAMES
_TRAIN = f"{_SIDES}, {_LABEL}, {_HIST}, {_SPATIAL}, tr AS (SELECT * FROM ev JOIN side USING (component) JOIN lab ON lab.event_key = component LEFT JOIN hist USING (component) JOIN fields USING (component))"


@query("mlx_01_features", on_events("SELECT feature, n FROM (SELECT unnest([" + ", ".join(f"{{feature: '{c}', n: count({x})}}" for c, x in _SQL_FEATURES.items()) + "], recursive := true) FROM tr WHERE split = 'train') WHERE n > 0", _TRAIN))
def mlx_01(spark, d):
    """The features that a model may use and that describe an event, its surroundings and its past, with how often they are known in the training split."""
    return training.usable_features(labelled(spark, d)).filter(F.col("feature").isin(*_SQL_FEATURES))


_SHOWN = ("mean_frp", "max_frp", "std_frp", "mean_brightness", "duration_minutes", "historical_mean_frp", "historical_std_frp", "mean_detection_interval_hours", "dist_nearest_industrial_km", "dist_refinery_km", "industrial_count_5km")


def _sql_prepared(c: str) -> str:
    x = _SQL_FEATURES[c]
    fill = f"coalesce({x}::DOUBLE, (SELECT median({x}::DOUBLE) FROM tr WHERE split = 'train'))"
    moment = lambda f: f"(SELECT {f}({fill}) FROM tr WHERE split = 'train')"
    return f"round(({fill} - {moment('avg')}) / {moment('stddev_pop')}, 5) AS {c}, ({x} IS NULL)::INT::DOUBLE AS {c}_missing"


@query("mlx_03_prepared", on_events(f"SELECT event_id, {', '.join(map(_sql_prepared, _SHOWN))} FROM tr", _TRAIN))
def mlx_03(spark, d):
    """Features of all three kinds with medians for what is missing, an indicator of that, and scaled, all by the training split."""
    rows = training.prepared(labelled(spark, d), list(_SHOWN))
    return rows.select("event_id", *[x for c in _SHOWN for x in (F.round(c, 5).alias(c), f"{c}_missing")])


@query("mlx_06_readiness", on_events("SELECT split, kind AS label, count(*) AS n, count(*) >= 5 AS enough FROM (SELECT split, CASE WHEN label IN ('Gas Flare', 'Wildfire') THEN label ELSE 'Other' END AS kind FROM tr) GROUP BY split, kind", _LABELLED))
def mlx_06(spark, d):
    """The gate before training: are there enough events of each label on each side?"""
    return training.readiness(labelled(spark, d), 5)


_KIND = "CASE WHEN label IN ('Gas Flare', 'Wildfire') THEN label ELSE 'Other' END"
_GATE = f"""{_GROUPS}, {_LABEL}, tr AS (SELECT ev.event_id, {_KIND} AS kind, grp FROM ev JOIN grp USING (component) JOIN lab ON lab.event_key = component),
{_RANKED.replace('FROM grp)', 'FROM tr)')}, sp AS (SELECT kind, CASE WHEN k <= {_CUT} THEN 'TRAIN' WHEN k <= least(n - 1, greatest({_CUT} + 1, floor(n * 0.8e0))) THEN 'VALIDATION' ELSE 'TEST' END AS split FROM tr JOIN ranked USING (grp)),
cl AS (SELECT unnest(['Gas Flare', 'Wildfire', 'Other']) AS kind)"""


@query("mlx_06_gate", on_events("""SELECT unnest(['REPRESENTATIVENESS_NOT_REVIEWED', 'REFERENCES_NOT_REVIEWED', 'CLUSTERING_NOT_REVIEWED']) AS blocker
UNION ALL SELECT 'MINIMUM_CLASS_SUPPORT_NOT_MET' WHERE (SELECT min(n) FROM (SELECT count(sp.kind) AS n FROM cl LEFT JOIN sp USING (kind) GROUP BY cl.kind)) < 30
UNION ALL SELECT 'LOW_CLASS_SUPPORT_' || s FROM (SELECT s, cl.kind, count(sp.kind) AS n FROM (SELECT unnest(['TRAIN', 'VALIDATION', 'TEST']) AS s) JOIN cl ON true LEFT JOIN sp ON sp.kind = cl.kind AND sp.split = s GROUP BY ALL) GROUP BY s HAVING min(n) < 5""", _GATE))
def mlx_06_gate(spark, d):
    """What still blocks training on the labelled events: one review is there, those of other domains are missing, stale or not approved, and labels may be too few."""
    folder = scratch_path(spark, "artifact")
    reference = fixtures.facilities(spark, d).withColumnRenamed("facility_id", "feature_id")
    digest = artifacts.build(spark, folder, *artifact_parts(spark, d, "component is not null"), reference)["parts"]["events"]["sha256"]
    named = F.when(F.col("label").isin("Gas Flare", "Wildfire"), F.col("label")).otherwise("Other")
    events = splittable(spark, d)
    labels = latest_annotations(spark, d).select(F.col("event_key").alias("component"), named.alias("label")).join(events.select("component", "event_id"), "component").drop("component")
    groups = ops.leakage_groups(events).join(events.select("component", "event_id"), "component").drop("component")
    at = datetime(2024, 1, 1)
    reviews = [("temporal_history", True, "r", digest, at, ["note"]), ("clustering", False, "r", digest, at, ["note"]), ("references", True, "r", "older", at, ["note"])]
    reviews = spark.createDataFrame(reviews, "domain string, approved boolean, reviewer string, event_sha256 string, reviewed_at timestamp, evidence array<string>")
    made = artifacts.prepare(spark, folder, labels, reviews, groups, scratch_path(spark, "training"), ("Gas Flare", "Wildfire", "Other"), datetime(2024, 6, 1))
    return spark.createDataFrame([(b,) for b in made["blockers"]], "blocker string")


def selected(spark, d):
    rows = labelled(spark, d)
    return training.select_model(rows, sorted(r["feature"] for r in training.usable_features(rows).collect()))


@query("mlx_05_selected")
def mlx_05(spark, d):
    """Models fitted on the training split, boosted ones among them, chosen by macro F1 on the validation split, measured once on the test split."""
    return selected(spark, d)[0]


@query("mlx_10_importance")
def mlx_10(spark, d):
    """How much macro F1 of the selected model on the validation split falls when a feature's values are dealt anew among its rows, for all features."""
    _, model, split = selected(spark, d)
    return training.permutation_importance(split, model)


@query("mlx_08_contributions")
def mlx_08(spark, d):
    """What each feature adds to the selected model's probability of the label it predicts, for each event of the test split."""
    _, model, split = selected(spark, d)
    named = F.element_at(F.array(*map(F.lit, split.labels)), F.col("prediction").cast("int") + 1)
    said = model.predicted(split.test).select("event_id", named.alias("label"))
    found = attribution.contributions(split.test, model, attribution.background(split.train), split.features, split.labels)
    return found.join(said, ["event_id", "label"])


def _normal(spark, d) -> tuple[DataFrame, DataFrame]:
    """(all labelled events, the training split's that reviewers took for normal operation: neither flare nor wildfire)."""
    rows = labelled(spark, d)
    return rows, rows.filter("split = 'train' and label = 'Other'")


@query("mlx_07_isolation")
def mlx_07(spark, d):
    """How easily an isolation forest of normal events tells each event of the test split apart, by all usable features."""
    rows, normal = _normal(spark, d)
    model = anomaly.isolation_forest(normal, sorted(r["feature"] for r in training.usable_features(normal).collect()))
    return rows.filter("split = 'test'").select("event_id", model.score().alias("score"))


_SPREAD = "(SELECT {0} FROM normal)"


@query("mlx_07_distance", on_events(f"""SELECT event_id, round(sqrt((vy * pow(x - mx, 2) - 2 * vxy * (x - mx) * (y - my) + vx * pow(y - my, 2)) / (vx * vy - vxy * vxy)), 5) AS distance
FROM (SELECT event_id, coalesce(mean_frp, medx) AS x, coalesce(max_brightness, medy) AS y, s.* FROM tr, s WHERE split = 'test')""", f"""{_LABELLED}, normal AS (SELECT * FROM tr WHERE split = 'train' AND label NOT IN ('Gas Flare', 'Wildfire')),
med AS (SELECT median(mean_frp) AS medx, median(max_brightness) AS medy FROM normal),
s AS (SELECT any_value(medx) AS medx, any_value(medy) AS medy, avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vxy FROM (SELECT medx, medy, coalesce(mean_frp, medx) AS x, coalesce(max_brightness, medy) AS y FROM normal, med))"""))
def mlx_07_distance(spark, d):
    """The Mahalanobis distance of each event of the test split from normal events, by its heat."""
    rows, normal = _normal(spark, d)
    model = anomaly.ellipsoid(normal, ["mean_frp", "max_brightness"])
    return rows.filter("split = 'test'").select("event_id", F.round(model.distance(), 5).alias("distance"))
