"""Hotspot lists: filters, search, paging, top-k, joins with features, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import scoring
from emberline.functions.geo import geojson_point
from emberline.operators.hotspots import due_alerts
from emberline.plans.model import on_scored
from emberline.plans.registry import query, scored
from emberline.sources import fixtures

NOW = fixtures.NOW_US
COLORS = (("CRITICAL", "#dc2626"), ("HIGH", "#f97316"), ("ELEVATED", "#f59e0b"), ("MODERATE", "#22c55e"), ("LOW", "#3b82f6"))
OTHER_COLOR = "#64748b"


def matching(
    rows: DataFrame,
    *,
    classification: str | None = None,
    risk_level: str | None = None,
    confidence: float | None = None,
    state: str | None = None,
    district: str | None = None,
    pattern: str | None = None,
    since_us: int | None = None,
    until_us: int | None = None,
    search: str | None = None,
    industrial_km: float | None = None,
    forest_km: float | None = None,
    agriculture_km: float | None = None,
    settlement_km: float | None = None,
) -> DataFrame:
    """Every given condition must hold. The industrial one looks at refineries only, and a missing layer (-1) passes."""
    if search is not None:
        rows = rows.filter(contains(search, "code", "state", "district"))
    for name, value in (("classification", classification), ("risk_level", risk_level), ("state", state), ("district", district), ("pattern", pattern)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    for name, least in (("class_confidence", confidence), ("acq_us", since_us)):
        if least is not None:
            rows = rows.filter(F.col(name) >= least)
    for name, most in (("acq_us", until_us), ("d_refinery", industrial_km), ("d_forest", forest_km), ("d_agriculture", agriculture_km), ("d_settlement", settlement_km)):
        if most is not None:
            rows = rows.filter(F.col(name) <= most)
    return rows


def contains(term: str, *columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.ilike(F.col(c), F.lit(f"%{term}%"))
    return out


SORTABLE = ("acq_us", "risk", "brightness", "frp", "class_confidence", "persistence_score")


def page(rows: DataFrame, sort: str = "acq_us", descending: bool = True, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page in the order of one column (acq_us if it isn't sortable), ties by site_id, with the rows' total number."""
    by = F.col(sort if sort in SORTABLE else "acq_us")
    total = rows.agg(F.count("*").alias("total"))
    part = rows.orderBy(by.desc() if descending else by.asc(), "site_id").offset(offset).limit(limit)
    return part.crossJoin(F.broadcast(total))  # one row


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


_R6 = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("flt_01_multi", on_scored(f"SELECT site_id, classification, {_R6('risk')} FROM scored WHERE classification = 'Other Thermal Anomaly' AND class_confidence >= 0.5 AND acq_us >= {NOW - 3 * fixtures.DAY_US} AND acq_us <= {NOW}"))
def flt_01(spark, d):
    rows = matching(scored(spark, d), classification=scoring.CLASSES[-1], confidence=0.5, since_us=NOW - 3 * fixtures.DAY_US, until_us=NOW)
    return rows.select("site_id", "classification", *r6("risk"))


@query("flt_02_search", on_scored("SELECT site_id, code, state, district FROM scored WHERE code ILIKE '%as%' OR state ILIKE '%as%' OR district ILIKE '%as%'"))
def flt_02(spark, d):
    return matching(scored(spark, d), search="as").select("site_id", "code", "state", "district")


@query("flt_03_proximity", on_scored("SELECT site_id, d_refinery, d_settlement FROM scored WHERE d_refinery <= 300 AND d_settlement <= 300"))
def flt_03(spark, d):
    return matching(scored(spark, d), industrial_km=300, settlement_km=300).select("site_id", "d_refinery", "d_settlement")


@query("flt_04_historical", on_scored(f"SELECT site_id, state, risk_level FROM scored WHERE acq_us BETWEEN {NOW - 2 * fixtures.DAY_US} AND {NOW} AND state = 'ASIA' AND risk_level = 'MODERATE'"))
def flt_04(spark, d):
    rows = matching(scored(spark, d), since_us=NOW - 2 * fixtures.DAY_US, until_us=NOW, state="ASIA", risk_level="MODERATE")
    return rows.select("site_id", "state", "risk_level")


@query("flt_10_envelope", on_scored("SELECT count(*) AS n, count(*) FILTER (WHERE NOT (lon BETWEEN 67 AND 98 AND lat BETWEEN 6 AND 38)) AS outside FROM det"))
def flt_10(spark, d):
    inside = F.col("lon").between(67, 98) & F.col("lat").between(6, 38)
    return fixtures.detections(spark, d).agg(F.count("*").alias("n"), F.count_if(~inside).alias("outside"))


@query(
    "flt_12_unified_search",
    on_scored(
        """SELECT kind, label FROM (
SELECT * FROM (SELECT 'hotspot' AS kind, code AS label, 1 AS o FROM scored WHERE state ILIKE '%asia%' OR code ILIKE '%asia%' OR district ILIKE '%asia%' ORDER BY code LIMIT 8)
UNION ALL SELECT * FROM (SELECT 'zone', name, 2 FROM fac WHERE name ILIKE '%asia%' ORDER BY name LIMIT 8)
UNION ALL SELECT 'state', state || ':' || count(*), 3 FROM scored WHERE state ILIKE '%asia%' GROUP BY state) ORDER BY o, label LIMIT 12"""
    ),
)
def flt_12(spark, d):
    term, rows = "asia", scored(spark, d)
    hits = rows.filter(contains(term, "code", "state", "district")).orderBy("code").limit(8).select(F.lit("hotspot").alias("kind"), F.col("code").alias("label"), F.lit(1).alias("o"))
    zones = fixtures.facilities(spark, d).filter(contains(term, "name")).orderBy("name").limit(8).select(F.lit("zone"), "name", F.lit(2))
    states = rows.filter(contains(term, "state")).groupBy("state").count().select(F.lit("state"), F.concat_ws(":", "state", "count"), F.lit(3))
    return hits.union(zones).union(states).orderBy("o", "label").limit(12).select("kind", "label")


@query("srt_01_page", on_scored(f"SELECT site_id, {_R6('risk')}, (SELECT count(*) FROM scored) AS total FROM scored ORDER BY scored.risk DESC, site_id OFFSET 20 LIMIT 20"))
def srt_01(spark, d):
    return page(scored(spark, d), "risk", True, 20, 20).select("site_id", *r6("risk"), "total")


@query("srt_03_recurring", on_scored(f"SELECT site_id, pattern, {_R6('persistence_score')} FROM scored WHERE pattern IN ('recurring', 'persistent') ORDER BY scored.persistence_score DESC, site_id LIMIT 10"))
def srt_03(spark, d):
    rows = scored(spark, d).filter(F.col("pattern").isin("recurring", "persistent"))
    return rows.orderBy(F.desc("persistence_score"), "site_id").limit(10).select("site_id", "pattern", *r6("persistence_score"))


@query("srt_04_top_districts", on_scored("SELECT district, count(*) AS n FROM scored GROUP BY district ORDER BY n DESC, district LIMIT 12"))
def srt_04(spark, d):
    return scored(spark, d).groupBy("district").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "district").limit(12)


@query("srt_06_canonical", on_scored("SELECT det_id, acq_us, row_number() OVER (ORDER BY acq_us, det_id) AS place FROM det ORDER BY acq_us, det_id LIMIT 500"))
def srt_06(spark, d):
    from pyspark.sql import Window

    first = fixtures.detections(spark, d).orderBy("acq_us", "det_id").limit(500).select("det_id", "acq_us")
    return first.withColumn("place", F.row_number().over(Window.orderBy("acq_us", "det_id")).cast("long"))


@query("srt_08_copilot_top", on_scored(f"SELECT code, risk_level, {_R6('risk')} FROM scored ORDER BY scored.risk DESC, code LIMIT 8"))
def srt_08(spark, d):
    return scored(spark, d).orderBy(F.desc("risk"), "code").limit(8).select("code", "risk_level", *r6("risk"))


@query(
    "srt_09_first_available",
    on_scored("SELECT site_id, risk_level FROM (SELECT site_id, risk_level, rank() OVER (ORDER BY CASE risk_level WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'ELEVATED' THEN 3 WHEN 'MODERATE' THEN 4 ELSE 5 END) AS k FROM scored) WHERE k = 1"),
)
def srt_09(spark, d):
    """All hotspots of the gravest level that occurs."""
    rank = scoring.one_of("risk_level", [(name, k) for k, (name, *_) in enumerate(reversed(scoring.LEVELS))], 9)
    rows = scored(spark, d).withColumn("rank", rank)
    least = rows.agg(F.min("rank").alias("least"))
    return rows.join(F.broadcast(least), F.col("rank") == F.col("least")).select("site_id", "risk_level")


@query("join_01_features", on_scored("SELECT hot.site_id, d_refinery, d_forest, in_forest, facility_id FROM hot JOIN infra USING (site_id)"))
def join_01(spark, d):
    return scored(spark, d).select("site_id", "d_refinery", "d_forest", "in_forest", "facility_id")


@query(
    "join_02_detail",
    on_scored("""SELECT scored.site_id, count(DISTINCT det.det_id) AS n_history, min(det.acq_us) AS first_us, count(DISTINCT validation_id) AS n_validations
FROM scored LEFT JOIN det ON det.site_id = scored.site_id AND det.det_id <> scored.det_id LEFT JOIN val ON val.site_id = scored.site_id GROUP BY scored.site_id"""),
)
def join_02(spark, d):
    """Each hotspot with its history and validations, aggregated on their own before they are joined."""
    hot = scored(spark, d).select("site_id", F.col("det_id").alias("own"))
    det = fixtures.detections(spark, d).select("site_id", "det_id", "acq_us")
    history = det.join(hot, "site_id").filter("det_id <> own").groupBy("site_id").agg(F.count("*").alias("n_history"), F.min("acq_us").alias("first_us"))
    checks = fixtures.validations(hot).groupBy("site_id").agg(F.count("*").alias("n_validations"))
    return hot.join(history, "site_id", "left").join(checks, "site_id", "left").select("site_id", F.coalesce("n_history", F.lit(0)).alias("n_history"), "first_us", F.coalesce("n_validations", F.lit(0)).alias("n_validations"))


@query("join_16_alerts_in_set", on_scored("SELECT o_orderkey AS alert_id, o_custkey AS site_id FROM orders WHERE o_custkey IN (SELECT site_id FROM scored WHERE risk_level = 'ELEVATED')"))
def join_16(spark, d):
    some = scored(spark, d).filter("risk_level = 'ELEVATED'").select("site_id")
    return fixtures.alerts(spark, d).join(some, "site_id", "left_semi").select("alert_id", "site_id")


@query("join_17_near_refinery", on_scored("SELECT code, d_refinery FROM scored WHERE d_refinery BETWEEN 0 AND 60 ORDER BY d_refinery, code LIMIT 10"))
def join_17(spark, d):
    return scored(spark, d).filter(F.col("d_refinery").between(0, 60)).orderBy("d_refinery", "code").limit(10).select("code", "d_refinery")


@query("join_18_alert_codes", on_scored("SELECT o_orderkey AS alert_id, code FROM orders LEFT JOIN scored ON site_id = o_custkey"))
def join_18(spark, d):
    return fixtures.alerts(spark, d).join(scored(spark, d).select("site_id", "code"), "site_id", "left").select("alert_id", "code")


@query("win_06_samples", on_scored("SELECT state, site_id FROM (SELECT state, site_id, row_number() OVER (PARTITION BY state ORDER BY frp DESC, site_id) AS k FROM scored) WHERE k = 1"))
def win_06(spark, d):
    """The hotspot of greatest FRP of each state, ties to the smaller id: an aggregate, not a sort."""
    return scored(spark, d).groupBy("state").agg(F.max_by("site_id", F.struct("frp", -F.col("site_id"))).alias("site_id"))


@query(
    "win_10_runner_up",
    on_scored("SELECT site_id, classification, round(list_sort([p0, p1, p2, p3, p4, p5], 'DESC')[1] - list_sort([p0, p1, p2, p3, p4, p5], 'DESC')[2], 6) AS gap FROM scored"),
)
def win_10(spark, d):
    ranked = F.sort_array(F.array(*[F.col(f"p{k}") for k in range(6)]), asc=False)
    return scored(spark, d).select("site_id", "classification", F.round(F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1)), 6).alias("gap"))


_EXPORT = ("code", "site_id", "lat", "lon", "acq_us", "brightness", "frp", "state", "district", "classification", "class_confidence", "risk", "risk_level", "pattern")


@query("snk_04_export_csv", on_scored("SELECT " + ", ".join(f"round({c}, 6) AS {c}" if c in ("lat", "lon", "brightness", "frp", "class_confidence", "risk") else c for c in _EXPORT) + " FROM scored"))
def snk_04(spark, d):
    """The 14 columns of the CSV export, in their order."""
    return scored(spark, d).select(*[F.round(c, 6).alias(c) if c in ("lat", "lon", "brightness", "frp", "class_confidence", "risk") else F.col(c) for c in _EXPORT])


@query("snk_05_export_json", on_scored("SELECT site_id, to_json({'site_id': site_id, 'code': code, 'state': state, 'risk_level': risk_level})::VARCHAR AS doc FROM scored"))
def snk_05(spark, d):
    return scored(spark, d).select("site_id", F.to_json(F.struct("site_id", "code", "state", "risk_level")).alias("doc"))


def geojson_features(rows: DataFrame) -> DataFrame:
    """A GeoJSON Feature of each hotspot as text, coloured by risk level."""
    color = scoring.one_of("risk_level", COLORS, OTHER_COLOR)
    feature = F.struct(
        F.lit("Feature").alias("type"),
        geojson_point("lat", "lon").alias("geometry"),
        F.struct("site_id", "code", "classification", "risk_level", color.alias("color")).alias("properties"),
    )
    return rows.select("site_id", F.to_json(feature).alias("feature"))


_COLOR = "CASE risk_level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COLORS) + f" ELSE '{OTHER_COLOR}' END"


@query(
    "snk_06_geojson",
    on_scored(f"""SELECT site_id, to_json({{'type': 'Feature', 'geometry': {{'type': 'Point', 'coordinates': [lon, lat]}},
'properties': {{'site_id': site_id, 'code': code, 'classification': classification, 'risk_level': risk_level, 'color': {_COLOR}}}}})::VARCHAR AS feature FROM scored"""),
)
def snk_06(spark, d):
    return geojson_features(scored(spark, d))


@query("orc_02_rescore", on_scored(f"SELECT site_id, classification, risk_level, {_R6('risk', 'class_confidence', *[f'p{k}' for k in range(6)])} FROM scored"))
def orc_02(spark, d):
    return scored(spark, d).select("site_id", "classification", "risk_level", *r6("risk", "class_confidence", *[f"p{k}" for k in range(6)]))


@query("fea_03_vectors", on_scored(f"""SELECT site_id, {_R6('brightness', 'frp')}, n_detections::DOUBLE AS n_detections, {_R6('persistence_score')}, d_industrial AS dist_industrial_km, d_forest AS dist_forest_km,
d_agriculture AS dist_agriculture_km, d_settlement AS dist_settlement_km, CASE land_cover WHEN 'Industrial' THEN 0e0 WHEN 'Forest' THEN 1e0 WHEN 'Agriculture' THEN 2e0 WHEN 'Urban' THEN 3e0 ELSE 5e0 END AS land_cover_code,
round(tod, 6) AS time_of_day, {_R6('historical_frequency')}, CASE validation WHEN 'CONFIRMED' THEN 3e0 WHEN 'LIKELY' THEN 2e0 WHEN 'UNCERTAIN' THEN 1e0 ELSE 0e0 END AS satellite_score,
round(frp / 16e1, 6) AS frp_normalized, round((brightness - 3e2) / 12e1, 6) AS brightness_normalized FROM scored"""))
def fea_03(spark, d):
    rows = scored(spark, d).select("site_id", *scoring.feature_vector())
    return rows.select("site_id", *r6(*scoring.FEATURES))


@query("cls_01_rules", on_scored(f"SELECT site_id, {_R6(*[f's{k}' for k in range(6)])} FROM scored"))
def cls_01(spark, d):
    return scored(spark, d).select("site_id", *r6(*[f"s{k}" for k in range(6)]))


@query("rsk_01_risk", on_scored(f"SELECT site_id, {_R6('risk')}, risk_level FROM scored"))
def rsk_01(spark, d):
    return scored(spark, d).select("site_id", *r6("risk"), "risk_level")


_SHAPE = {"persistent": (0.55, 0.7, 0.88, 1.0), "recurring": (0.5, 0.85, 0.6, 1.0), "sudden": (0.25, 0.5, 0.78, 1.0), None: (0.4, 0.6, 0.8, 1.0)}


@query("rsk_03_trend", on_scored("SELECT site_id, n_detections, " + ", ".join("CASE WHEN n_detections <= 1 THEN NULL ELSE round(least(1e2, risk * CASE pattern " + " ".join(f"WHEN '{n}' THEN {v[k]}e0" for n, v in _SHAPE.items() if n) + f" ELSE {_SHAPE[None][k]}e0 END), 1) END AS t{k}" for k in range(4)) + " FROM scored"))
def rsk_03(spark, d):
    t = scoring.trend("risk", "n_detections", "pattern")
    return scored(spark, d).select("site_id", "n_detections", *[F.when(F.col("n_detections") > 1, F.get(t, F.lit(k))).alias(f"t{k}") for k in range(4)])


_REC = "CASE risk_level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scoring.RECOMMENDATIONS) + " END"


@query("rsk_04_recommendation", on_scored(f"SELECT site_id, {_REC} AS recommendation FROM scored"))
def rsk_04(spark, d):
    return scored(spark, d).select("site_id", scoring.one_of("risk_level", scoring.RECOMMENDATIONS, "Continue monitoring.").alias("recommendation"))


_DUE = """SELECT printf('AL-%04d', row_number() OVER (ORDER BY site_id)) AS code, site_id, CASE WHEN classification IN ('Industrial Fire', 'Gas Flare') THEN 'industrial_fire' ELSE 'risk' END AS kind,
CASE WHEN risk_level IN ('CRITICAL', 'HIGH') THEN risk_level ELSE 'MODERATE' END AS severity FROM scored WHERE risk >= {r} OR (classification IN ('Industrial Fire', 'Gas Flare') AND class_confidence >= {c})"""


@query("alr_01_auto", on_scored(_DUE.format(r=80, c=0.8)))
def alr_01(spark, d):
    return due_alerts(scored(spark, d))


@query("alr_01_lower_bar", on_scored(_DUE.format(r=40, c=0.5)))
def alr_01_lower(spark, d):
    return due_alerts(scored(spark, d), 40.0, 0.5)


@query("mut_04_codes", on_scored("SELECT site_id, printf('HX-%04d', 1000 + row_number() OVER (ORDER BY acq_us, site_id)) AS code FROM scored WHERE acq_us >= " + str(NOW - 2 * fixtures.DAY_US)))
def mut_04(spark, d):
    """Codes for new rows, from the number of rows there are: numbered within the batch."""
    from emberline.operators.numbering import numbered

    new = scored(spark, d).filter(F.col("acq_us") >= NOW - 2 * fixtures.DAY_US).select("site_id", "acq_us")
    return numbered(new, [F.col("acq_us"), F.col("site_id")]).select("site_id", F.format_string("HX-%04d", F.col("number") + 1000).alias("code"))
