"""Explanations, decisions, lookups and reports over scored hotspots and their records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import explain, geo, scoring
from emberline.operators.hotspots import classified, digest
from emberline.plans.model import on_scored
from emberline.plans.registry import query, scored
from emberline.sources import fixtures

NOW, DAY = fixtures.NOW_US, fixtures.DAY_US
_Q = lambda text: "'" + text.replace("'", "''") + "'"


def _steps(value: str, steps, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} <= {most} THEN '{name}'" for most, name in steps) + f" ELSE '{default}' END"


_near = lambda c, s: f"CASE WHEN {c} >= 0 THEN {_steps(c, *s)} ELSE 'N/A' END"
_LABELS = f"""{_steps('brightness', *explain.THERMAL)} AS thermal_intensity, {_steps('frp', *explain.POWER)} AS frp, {_near('d_industrial', explain.INDUSTRY)} AS industrial_proximity,
{_near('d_forest', explain.SURROUNDINGS)} AS forest_proximity, {_near('d_agriculture', explain.SURROUNDINGS)} AS agricultural_proximity, {_near('d_settlement', explain.SURROUNDINGS)} AS settlement_proximity,
CASE WHEN persistence_score >= 55 THEN 'HIGH' WHEN persistence_score >= 25 THEN 'MODERATE' ELSE 'LOW' END AS persistence, land_cover,
CASE pattern WHEN 'recurring' THEN 'HIGH' WHEN 'persistent' THEN 'MODERATE' ELSE 'LOW' END AS historical_recurrence, validation AS satellite_validation"""


@query("fea_04_factor_labels", on_scored(f"SELECT site_id, {_LABELS} FROM scored"))
def fea_04(spark, d):
    return scored(spark, d).select("site_id", *[c.alias(name) for name, c in explain.factor_labels().items()])


_TEXT = lambda t: "printf('%d.0', n_detections) || " + _Q(t.removeprefix("{n}")) if t.startswith("{n}") else _Q(t)
_FACTORS = "concat_ws(';', " + ", ".join(f"CASE WHEN classification = '{k}' AND ({c or 'true'}) THEN {_TEXT(t)} END" for k, c, t in explain.FACTORS) + ")"
_REASON = "CASE classification " + " ".join(f"WHEN '{k}' THEN {_Q(t)}" for k, t in explain.REASONING) + " ELSE '' END"


@query("cls_03_context", on_scored(f"SELECT site_id, {_FACTORS} AS factors FROM scored"))
def cls_03(spark, d):
    return scored(spark, d).select("site_id", F.array_join(explain.contextual_factors(), ";").alias("factors"))


@query("cls_04_reasoning", on_scored(f"SELECT site_id, {_REASON} AS reasoning FROM scored"))
def cls_04(spark, d):
    return scored(spark, d).select("site_id", explain.reasoning().alias("reasoning"))


_RANKED = "unnest([{p: p0, k: 0, c: 'Industrial Fire'}, {p: p1, k: 1, c: 'Persistent Industrial Heat Source'}, {p: p2, k: 2, c: 'Gas Flare'}, {p: p3, k: 3, c: 'Wildfire'}, {p: p4, k: 4, c: 'Agricultural Burning'}, {p: p5, k: 5, c: 'Other Thermal Anomaly'}])"
_PAYLOAD = on_scored(f"""SELECT site_id, max(c) FILTER (WHERE r = 1) AS top_class, round(max(p) FILTER (WHERE r = 1) * 100, 1) AS confidence, max(c) FILTER (WHERE r = 2) AS runner_up,
round((max(p) FILTER (WHERE r = 1) - max(p) FILTER (WHERE r = 2)) * 100, 1) AS gap_pct, any_value(factors) AS factors, any_value(length(reasoning)) AS reasoning_length
FROM (SELECT site_id, factors, reasoning, x.p AS p, x.c AS c, row_number() OVER (PARTITION BY site_id ORDER BY x.p DESC, x.k) AS r FROM (SELECT site_id, {_FACTORS} AS factors, {_REASON} AS reasoning, {_RANKED} AS x FROM scored)) GROUP BY site_id""")


def payload(rows: DataFrame) -> DataFrame:
    """(site_id, explanation): the classification with everything that explains it."""
    ranked = rows.withColumn("ranked", explain.ranked_classes())
    top, second = F.element_at("ranked", 1), F.element_at("ranked", 2)
    return ranked.select(
        "site_id",
        F.struct(
            top["name"].alias("top_class"),
            F.round(top["p"] * 100, 1).alias("confidence"),
            second["name"].alias("runner_up"),
            F.round((top["p"] - second["p"]) * 100, 1).alias("gap_pct"),
            F.struct(*[c.alias(name) for name, c in explain.factor_labels().items()]).alias("labels"),
            explain.contextual_factors().alias("factors"),
            explain.reasoning().alias("reasoning"),
            F.lit("heuristic_context").alias("factor_type"),
            F.lit("heuristic_score").alias("probability_type"),
        ).alias("explanation"),
    )


def _flat(rows: DataFrame) -> DataFrame:
    e = F.col("explanation")
    return payload(rows).select("site_id", e["top_class"].alias("top_class"), e["confidence"].alias("confidence"), e["runner_up"].alias("runner_up"), e["gap_pct"].alias("gap_pct"), F.array_join(e["factors"], ";").alias("factors"), F.length(e["reasoning"]).cast("long").alias("reasoning_length"))


@query("cls_05_payload", _PAYLOAD)
def cls_05(spark, d):
    return _flat(scored(spark, d))


@query("orc_04_one_row", _PAYLOAD.replace("FROM scored)) GROUP", "FROM scored WHERE code = 'HX-0007')) GROUP"))
def orc_04(spark, d):
    """One hotspot by its code; the filter reaches the scan."""
    return _flat(scored(spark, d).filter("code = 'HX-0007'"))


@query("geo_12_imagery_box", on_scored("SELECT site_id, round(lon - 1e-2, 6) AS west, round(lat - 1e-2, 6) AS south, round(lon + 1e-2, 6) AS east, round(lat + 1e-2, 6) AS north, acq_us - 86400000000 AS from_us, acq_us + 86400000000 AS to_us FROM scored"))
def geo_12(spark, d):
    """The box and the days in which imagery of a hotspot is looked for."""
    r = lambda c: F.round(c, 6)
    return scored(spark, d).select(
        "site_id", r(F.col("lon") - 0.01).alias("west"), r(F.col("lat") - 0.01).alias("south"), r(F.col("lon") + 0.01).alias("east"), r(F.col("lat") + 0.01).alias("north"),
        (F.col("acq_us") - DAY).alias("from_us"), (F.col("acq_us") + DAY).alias("to_us"),
    )


@query("geo_02_valid", "SELECT event_id, event_id % 11 <> 0 AND coalesce(v BETWEEN -90 AND 90, false) AS valid FROM (SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN value - 60 END AS v FROM events)")
def geo_02(spark, d):
    """Coordinates checked: null, NaN and out of range are not valid."""
    from emberline.session import table

    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 13 != 0, F.col("value") - 60).alias("lat"), F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.lit(70.0)).alias("lon"))
    return rows.select("event_id", geo.valid_coordinates("lat", "lon").alias("valid"))


@query("geo_10_wkt", "SELECT s_suppkey AS facility_id, 'POINT(' || (s_suppkey % 180)::DOUBLE::VARCHAR || ' ' || (s_suppkey % 90 + 0.5)::DOUBLE::VARCHAR || ')' AS wkt FROM supplier")
def geo_10(spark, d):
    rows = fixtures.facilities(spark, d).select("facility_id", (F.col("facility_id") % 180).cast("double").alias("lon"), (F.col("facility_id") % 90 + 0.5).cast("double").alias("lat"))
    return rows.select("facility_id", geo.wkt_point("lat", "lon").alias("wkt"))


@query("tmp_03_iso", "SELECT event_id, epoch_us(ts) AS us FROM events")
def tmp_03(spark, d):
    """ISO texts with Z or an offset, and without a zone (taken as UTC), all to the same instant."""
    from emberline.session import table

    ts = F.col("ts").cast("timestamp")
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    east = F.concat(F.date_format(ts + F.expr("interval 330 minutes"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+05:30"))
    k = F.col("event_id") % 3
    iso = F.when(k == 0, F.concat(text, F.lit("Z"))).when(k == 1, east).otherwise(text)
    return table(spark, d, "events").select("event_id", F.unix_micros(F.to_timestamp(iso)).alias("us"))


# Alerts and notifications -----------------------------------------------------------------------------------

_SEED = """WITH_SELECT site_id, CASE WHEN classification = 'Industrial Fire' THEN 'industrial_fire' WHEN classification IN ('Persistent Industrial Heat Source', 'Gas Flare') AND persistence_score >= 55 THEN 'persistent'
WHEN classification = 'Wildfire' THEN 'wildfire' ELSE 'risk' END AS kind, CASE WHEN risk_level IN ('CRITICAL', 'HIGH', 'ELEVATED') THEN risk_level ELSE 'MODERATE' END AS severity, round(class_confidence, 2) AS confidence
FROM scored WHERE risk >= {r} OR (classification IN ('Industrial Fire', 'Gas Flare') AND class_confidence >= {c})""".replace("WITH_", "")


def seed_alerts(rows: DataFrame, risk: float = 75.0, confidence: float = 0.7) -> DataFrame:
    """Alerts of the seeding rule, with their kind."""
    kind = (
        F.when(F.col("classification") == "Industrial Fire", "industrial_fire")
        .when(F.col("classification").isin("Persistent Industrial Heat Source", "Gas Flare") & (F.col("persistence_score") >= 55), "persistent")
        .when(F.col("classification") == "Wildfire", "wildfire")
        .otherwise("risk")
    )
    severity = F.when(F.col("risk_level").isin("CRITICAL", "HIGH", "ELEVATED"), F.col("risk_level")).otherwise("MODERATE")
    due = (F.col("risk") >= risk) | (F.col("classification").isin("Industrial Fire", "Gas Flare") & (F.col("class_confidence") >= confidence))
    return rows.filter(due).select("site_id", kind.alias("kind"), severity.alias("severity"), F.round("class_confidence", 2).alias("confidence"))


@query("alr_02_seed", on_scored(_SEED.format(r=75, c=0.7)))
def alr_02(spark, d):
    return seed_alerts(scored(spark, d))


@query("alr_02_lower_bar", on_scored(_SEED.format(r=35, c=0.4)))
def alr_02_lower(spark, d):
    return seed_alerts(scored(spark, d), 35.0, 0.4)


@query("str_05_digest", """WITH a AS (SELECT strftime(o_orderdate, '%Y-%m') AS batch, printf('AL-%08d', o_orderkey) AS code, o_orderpriority AS title, o_totalprice > 300000 AS critical, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) AS k FROM orders)
SELECT batch, count(*)::VARCHAR || ' new auto-alert' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || ' generated' AS title, string_agg('• ' || code || ' — ' || title, chr(10) ORDER BY k) FILTER (WHERE k <= 10) || CASE WHEN count(*) > 10 THEN chr(10) || '…and ' || (count(*) - 10)::VARCHAR || ' more.' ELSE '' END AS message,
CASE WHEN bool_or(critical) THEN 'critical' ELSE 'warning' END AS severity FROM a GROUP BY batch""")
def str_05(spark, d):
    from emberline.session import table

    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("alert_id"), F.col("o_orderpriority").alias("title"))
    rows = fixtures.alerts(spark, d).join(orders, "alert_id")
    return digest(rows.select(F.date_format("created", "yyyy-MM").alias("batch"), F.format_string("AL-%08d", "alert_id").alias("code"), "title", "severity"), "batch")


# Intents ----------------------------------------------------------------------------------------------------

#: An intent is the first whose words occur in the question (any of them).
INTENTS = (
    ("critical", ("critical", "highest risk")),
    ("zones", ("industrial zone", "zones")),
    ("explain", ("explain",)),
    ("persistent", ("persistent",)),
    ("refinery", ("refiner",)),
    ("wildfire", ("wildfire",)),
    ("summary", ("summary", "today", "incident")),
    ("settlement", ("settlement", "population", "people")),
    ("investigate", ("investigat", "immediate", "attention")),
)


def intent(question) -> Column:
    """The intent of a question; "why" counts as explain at the start, or with "classified"."""
    q = F.lower(geo.col(question))
    has = lambda words: reduce(lambda a, b: a | b, [q.contains(w) for w in words])
    out = F.lit("overview")
    for name, words in reversed(INTENTS):
        holds = has(words)
        if name == "explain":
            holds = holds | q.startswith("why") | (q.contains("why") & q.contains("classified"))
        out = F.when(holds, name).otherwise(out)
    return out


_INTENT = "CASE " + " ".join(
    "WHEN " + " OR ".join([f"contains(q, '{w}')" for w in words] + (["starts_with(q, 'why')", "(contains(q, 'why') AND contains(q, 'classified'))"] if name == "explain" else [])) + f" THEN '{name}'" for name, words in INTENTS
) + " ELSE 'overview' END"


@query("orc_08_intents", f"SELECT conv_id, turn, {_INTENT} AS intent, nullif(regexp_extract(upper(text), 'HX-[0-9]{{3,4}}'), '') AS code FROM (SELECT conv_id, turn, text, lower(text) AS q FROM conversations) WHERE text IS NOT NULL")
def orc_08(spark, d):
    """Each turn's intent and the hotspot code that it names."""
    from emberline.session import table

    rows = table(spark, d, "conversations").filter("text is not null")
    code = F.regexp_extract(F.upper("text"), "HX-[0-9]{3,4}", 0)
    return rows.select("conv_id", "turn", intent("text").alias("intent"), F.when(code != "", code).alias("code"))


@query("orc_08_answers", on_scored(f"""SELECT intent, string_agg(site_id::VARCHAR, ',' ORDER BY place, site_id) AS sites, count(*) AS n FROM (
SELECT *, row_number() OVER (PARTITION BY intent ORDER BY place, site_id) AS k FROM (
SELECT 'critical' AS intent, site_id, -risk AS place FROM scored WHERE risk_level IN ('CRITICAL', 'HIGH') UNION ALL SELECT 'persistent', site_id, -persistence_score FROM scored WHERE persistence_score >= 50
UNION ALL SELECT 'refinery', site_id, d_refinery FROM scored WHERE d_refinery <= 5 UNION ALL SELECT 'settlement', site_id, d_settlement FROM scored WHERE d_settlement <= 3
UNION ALL SELECT 'wildfire', site_id, -acq_us::DOUBLE FROM scored WHERE classification = 'Wildfire')) WHERE k <= 10 GROUP BY intent"""))
def orc_08_answers(spark, d):
    """The first ten hotspots that answer each intent of the list kind."""
    from pyspark.sql import Window

    rows = scored(spark, d)
    lists = {
        "critical": (F.col("risk_level").isin("CRITICAL", "HIGH"), -F.col("risk")),
        "persistent": (F.col("persistence_score") >= 50, -F.col("persistence_score")),
        "refinery": (F.col("d_refinery") <= 5, F.col("d_refinery")),
        "settlement": (F.col("d_settlement") <= 3, F.col("d_settlement")),
        "wildfire": (F.col("classification") == "Wildfire", -F.col("acq_us").cast("double")),
    }
    parts = [F.when(c, F.struct(F.lit(name).alias("intent"), place.alias("place"))) for name, (c, place) in lists.items()]
    each = rows.select("site_id", F.explode(F.array_compact(F.array(*parts))).alias("x")).select("site_id", "x.intent", "x.place")
    first = each.withColumn("k", F.row_number().over(Window.partitionBy("intent").orderBy("place", "site_id"))).filter("k <= 10")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("place", "site_id"))), lambda x: x["site_id"].cast("string"))
    return first.groupBy("intent").agg(F.array_join(in_order, ",").alias("sites"), F.count("*").alias("n"))


# Reports and re-scoring -------------------------------------------------------------------------------------


def markdown_rows(rows: DataFrame) -> DataFrame:
    """(line): each row as one line of a Markdown table; null is "unavailable", bars are escaped."""
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("unavailable"))
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in rows.columns]), F.lit(" |")).alias("line"))


@query("snk_08_markdown", r"""SELECT '| ' || event_id::VARCHAR || ' | ' || coalesce(replace(CASE WHEN event_id % 4 <> 0 THEN event_type || '|' || (event_id % 7)::VARCHAR END, '|', '\|'), 'unavailable') || ' |' AS line FROM events""")
def snk_08(spark, d):
    from emberline.session import table

    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.concat("event_type", F.lit("|"), (F.col("event_id") % 7).cast("string"))).alias("kind"))
    return markdown_rows(rows)


@query("orc_11_incident_report", on_scored(f"SELECT site_id, code, classification, round(class_confidence * 100, 1) AS confidence_pct, risk_level, round(risk, 1) AS risk, {_LABELS.replace(' AS frp', ' AS frp_label')}, {_FACTORS} AS factors FROM scored WHERE site_id % 5 = 0"))
def orc_11(spark, d):
    """The tabular part of incident reports, for the hotspots asked for."""
    labels = [c.alias("frp_label" if name == "frp" else name) for name, c in explain.factor_labels().items()]
    rows = scored(spark, d).filter("site_id % 5 = 0")
    return rows.select("site_id", "code", "classification", F.round(F.col("class_confidence") * 100, 1).alias("confidence_pct"), "risk_level", F.round("risk", 1).alias("risk"), *labels, F.array_join(explain.contextual_factors(), ";").alias("factors"))


@query("orc_03_revalidate", on_scored("""SELECT site_id, validation, round(risk, 6) AS risk FROM (SELECT site_id, 'CONFIRMED' AS validation,
risk + 0.07e0 * (9e1 - CASE validation WHEN 'CONFIRMED' THEN 9e1 WHEN 'LIKELY' THEN 7e1 WHEN 'UNCERTAIN' THEN 4e1 ELSE 25e0 END) AS risk FROM scored WHERE site_id % 3 = 0 AND risk BETWEEN 1 AND 90)"""))
def orc_03(spark, d):
    """A validation appended to some hotspots, and those scored again: the newest validation counts."""

    rows = scored(spark, d).filter("site_id % 3 = 0 and risk between 1 and 90")
    made = [*[f"s{k}" for k in range(6)], *[f"p{k}" for k in range(6)], "tod", "classification", "class_confidence", "risk", "risk_level"]
    old = rows.select("site_id", F.lit(0).alias("at"), "validation")
    new = rows.select("site_id", F.lit(1).alias("at"), F.lit("CONFIRMED").alias("validation"))
    latest = old.unionByName(new).groupBy("site_id").agg(F.max_by("validation", "at").alias("validation"))
    return classified(rows.drop("validation", *made).join(latest, "site_id")).select("site_id", "validation", F.round("risk", 6).alias("risk"))
