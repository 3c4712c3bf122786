"""Cleaning, revisions, labels, alerts and sets over records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import scoring
from emberline.operators import clean
from emberline.plans.model import DET_SQL, on_scored
from emberline.plans.registry import query, scored
from emberline.session import stored, table
from emberline.sources import fixtures

DAY = fixtures.DAY_US


def raw_observations(spark, d) -> DataFrame:
    """Observations as a feed delivers them: text columns under the feed's names, with faults in known rows and copies of others."""
    events = table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    k = F.col("event_id")
    rows = events.select(
        k.alias("source_row"),
        F.when(k % 50 == 7, "91.5").when(k % 50 == 8, "north").otherwise(F.expr("cast(8 + (user_id * 7919) % 29 as string)")).alias(" Latitude "),
        F.when(k % 70 == 9, "").otherwise(F.expr("cast(68 + (user_id * 6101) % 29 as string)")).alias("LONGITUDE"),
        F.when(k % 30 == 3, "").otherwise(F.expr("cast(300 + event_id % 90 as string)")).alias("bright_ti4"),
        F.when(k % 90 == 11, "-4").otherwise(F.expr("cast(event_id % 120 as string)")).alias("frp"),
        F.date_format(ts, "yyyy-MM-dd").alias("acq_date"),
        F.when(k % 60 == 13, "2461").otherwise(F.regexp_replace(F.date_format(ts, "HHmm"), "^0{1,3}", "")).alias("acq_time"),
        F.element_at(F.array(F.lit("day"), F.lit("N"), F.lit("?")), (k % 3 + 1).cast("int")).alias("daynight"),
        F.element_at(F.array(F.lit("N20"), F.lit("N21")), (k % 2 + 1).cast("int")).alias("satellite"),
        F.when(k % 4 == 0, "h").otherwise((k % 130).cast("string")).alias("confidence"),
    )
    again = rows.filter("source_row % 40 = 1").withColumn("source_row", F.col("source_row") + 1_000_000_000)
    return rows.unionByName(again)


_RAW = f"""base AS (SELECT event_id AS source_row, event_id AS k, ts, user_id FROM events UNION ALL SELECT event_id + 1000000000, event_id, ts, user_id FROM events WHERE event_id % 40 = 1),
raw AS (SELECT source_row, k, CASE WHEN k % 50 IN (7, 8) THEN NULL ELSE (8 + (user_id * 7919) % 29)::DOUBLE END AS latitude, CASE WHEN k % 70 = 9 THEN NULL ELSE (68 + (user_id * 6101) % 29)::DOUBLE END AS longitude,
  CASE WHEN k % 90 = 11 THEN NULL ELSE (k % 120)::DOUBLE END AS frp, CASE WHEN k % 30 = 3 THEN NULL ELSE (300 + k % 90)::DOUBLE END AS brightness,
  CASE WHEN k % 60 = 13 THEN NULL ELSE epoch_us(date_trunc('minute', ts)) END AS acquisition_us, CASE k % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'N' END AS daynight, CASE k % 2 WHEN 0 THEN 'N20' ELSE 'N21' END AS satellite,
  concat_ws(';', CASE WHEN k % 50 IN (7, 8) THEN 'invalid:latitude' END, CASE WHEN k % 70 = 9 THEN 'invalid:longitude' END, CASE WHEN k % 90 = 11 THEN 'invalid:frp' END, CASE WHEN k % 60 = 13 THEN 'invalid:acquisition_time' END) AS errors FROM base),
dup AS (SELECT *, errors = '' AND row_number() OVER (PARTITION BY errors = '', CASE WHEN errors <> '' THEN source_row END, latitude, longitude, acquisition_us, satellite ORDER BY source_row) > 1 AS duplicate FROM raw)"""


@query("prj_03_accepted", f"WITH {_RAW} SELECT source_row, latitude, longitude, frp, brightness, acquisition_us, daynight, satellite FROM dup WHERE errors = '' AND NOT duplicate")
def prj_03(spark, d):
    rows = clean.accepted(clean.tagged(raw_observations(spark, d)))
    return rows.select("source_row", "latitude", "longitude", "frp", "brightness", "acquisition_us", "daynight", "satellite")


@query("snk_02_rejected", f"WITH {_RAW} SELECT source_row, CASE WHEN duplicate THEN 'duplicate' ELSE errors END AS validation_errors FROM dup WHERE errors <> '' OR duplicate")
def snk_02(spark, d):
    return clean.rejected(clean.tagged(raw_observations(spark, d)))


@query("agg_20_validation", f"""WITH {_RAW} SELECT count(*) AS input_rows, count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE NOT ok) AS rejected, count(*) FILTER (WHERE duplicate) AS duplicates,
count(*) FILTER (WHERE latitude IS NULL OR longitude IS NULL) AS missing_coordinates, count(DISTINCT satellite) FILTER (WHERE ok) AS satellites, min(acquisition_us) FILTER (WHERE ok) AS first_us, max(acquisition_us) FILTER (WHERE ok) AS last_us
FROM (SELECT *, errors = '' AND NOT duplicate AS ok FROM dup)""")
def agg_20(spark, d):
    return clean.report(clean.tagged(raw_observations(spark, d)))


@query("win_01_keep_first", f"WITH {_RAW} SELECT source_row FROM dup WHERE duplicate")
def win_01(spark, d):
    return clean.tagged(raw_observations(spark, d)).filter("duplicate").select("source_row")


@query("prj_06_ids", f"WITH {DET_SQL} SELECT det_id, substr(sha256(concat_ws('|', site_id::VARCHAR, acq_us::VARCHAR, coalesce(satellite, ''), '')), 1, 24) AS detection_id FROM det")
def prj_06(spark, d):
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("site_id", "acq_us", "satellite")]
    return fixtures.detections(spark, d).select("det_id", F.substring(F.sha2(F.concat_ws("|", *text, F.lit("")), 256), 1, 24).alias("detection_id"))


@query("prj_08_confidence", "SELECT event_id AS source_row, CASE WHEN event_id % 4 = 0 OR event_id % 130 > 100 THEN 0e0 ELSE (event_id % 130) / 1e2 END AS confidence FROM events")
def prj_08(spark, d):
    return raw_observations(spark, d).filter("source_row < 1000000000").select("source_row", clean.live_confidence("confidence").alias("confidence"))


@query("prj_09_thermal", f"WITH {DET_SQL} SELECT det_id, CASE WHEN brightness IS NULL OR frp IS NULL THEN 'legacy_ingest_requires_thermal_values' END AS reason FROM det")
def prj_09(spark, d):
    lacking = F.col("brightness").isNull() | F.col("frp").isNull()
    return fixtures.detections(spark, d).select("det_id", F.when(lacking, "legacy_ingest_requires_thermal_values").alias("reason"))


# Revisions and labels ---------------------------------------------------------------------------------------

_ANN = """ann AS (SELECT l_orderkey AS event_key, l_linenumber AS revision, ['Industrial Fire', 'Gas Flare', 'Wildfire', 'Agricultural Burning', 'Other', 'Unknown'][(l_partkey % 6 + 1)::INT] AS label,
  CASE WHEN l_linestatus = 'F' THEN 'approved' ELSE 'draft' END AS review_status, ['A', 'B', 'C'][(l_suppkey % 3 + 1)::INT] AS quality, 1e0 - l_discount * 4 AS confidence FROM lineitem)"""
_LAST = f"{_ANN}, last AS (SELECT * FROM ann JOIN (SELECT event_key, max(revision) AS revision FROM ann GROUP BY event_key) USING (event_key, revision))"
_PICK = "SELECT event_key, revision, min(label) AS label, min(review_status) AS review_status, min(quality) AS quality, round(min(confidence), 6) AS confidence FROM last GROUP BY event_key, revision"


def latest_annotations(spark, d, of: DataFrame | None = None) -> DataFrame:
    """Each event's annotation of the highest revision; fields of equal revisions are resolved to the least. ``of``: the events (event_key) that are asked for, so that
    no other annotation is shuffled."""
    rows = fixtures.annotations(spark, d)
    if of is not None:
        rows = stored(rows.join(of, "event_key", "left_semi"), "annotations")
    last = rows.groupBy("event_key").agg(F.max("revision").alias("revision"))
    kept = rows.join(last, ["event_key", "revision"])
    return kept.groupBy("event_key", "revision").agg(*[F.min(c).alias(c) for c in ("label", "review_status", "quality")], F.round(F.min("confidence"), 6).alias("confidence"))


@query("join_09_latest_rev", f"WITH {_LAST} {_PICK}")
def join_09(spark, d):
    return latest_annotations(spark, d)


@query("join_10_latest_pred", "SELECT l_orderkey AS event_key, max(l_orderkey * 8 + l_linenumber) AS prediction_id FROM lineitem GROUP BY l_orderkey")
def join_10(spark, d):
    rows = fixtures.predictions(spark, d)
    last = rows.groupBy("event_key").agg(F.max("prediction_id").alias("prediction_id"))
    return rows.join(last, ["event_key", "prediction_id"], "left_semi").select("event_key", "prediction_id").distinct()


@query("lbl_01_eligible", f"WITH {_LAST} SELECT event_key, coalesce(review_status = 'approved' AND label <> 'Unknown' AND quality IN ('A', 'B') AND confidence >= 0.8, false) AS eligible FROM ({_PICK})")
def lbl_01(spark, d):
    return latest_annotations(spark, d).select("event_key", scoring.training_eligible("review_status", "label", "quality", "confidence").alias("eligible"))


@query("agg_25_labels", f"WITH {_LAST} SELECT label, quality, count(*) AS n FROM ({_PICK}) GROUP BY label, quality")
def agg_25(spark, d):
    return latest_annotations(spark, d).groupBy("label", "quality").agg(F.count("*").alias("n"))


@query("set_05_unlabeled", "SELECT o_orderkey AS event_key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def set_05(spark, d):
    approved = fixtures.annotations(spark, d).filter("review_status = 'approved'").select("event_key")
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_key"))
    return events.join(approved, "event_key", "left_anti")


@query("set_03_except", "SELECT DISTINCT o_custkey AS site_id FROM orders EXCEPT SELECT user_id FROM events")
def set_03(spark, d):
    return fixtures.alerts(spark, d).select("site_id").distinct().exceptAll(fixtures.detections(spark, d).select("site_id").distinct())


@query("set_04_intersect", "SELECT o_custkey AS site_id FROM orders INTERSECT SELECT user_id FROM events")
def set_04(spark, d):
    return fixtures.alerts(spark, d).select("site_id").intersect(fixtures.detections(spark, d).select("site_id"))


@query("set_01_union", "SELECT event_id AS id, event_type AS kind, NULL::DOUBLE AS price FROM events UNION ALL BY NAME SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
def set_01(spark, d):
    events = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return events.unionByName(orders, allowMissingColumns=True)


@query("set_02_facility_ids", f"WITH {DET_SQL} SELECT count(*) AS n FROM (SELECT s_suppkey AS id FROM supplier UNION SELECT site_id FROM det)")
def set_02(spark, d):
    ids = fixtures.facilities(spark, d).select(F.col("facility_id").alias("id")).union(fixtures.detections(spark, d).select("site_id"))
    return ids.agg(F.count_distinct("id").alias("n"))


@query("set_07_distinct_in_order", f"WITH {DET_SQL} SELECT site_id, string_agg(satellite, '>' ORDER BY first_us, first_id) AS satellites FROM (SELECT site_id, satellite, min(acq_us) AS first_us, arg_min(det_id, (acq_us, det_id)) AS first_id FROM det GROUP BY site_id, satellite) GROUP BY site_id")
def set_07(spark, d):
    """A site's satellites in the order in which they first saw it."""
    seen = fixtures.detections(spark, d).groupBy("site_id", "satellite").agg(F.min(F.struct("acq_us", "det_id")).alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "satellite")))
    return seen.groupBy("site_id").agg(F.array_join(F.transform(ordered, lambda x: x["satellite"]), ">").alias("satellites"))


# Alerts -----------------------------------------------------------------------------------------------------


@query("flt_05_alerts", "SELECT o_orderkey AS alert_id FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 150000 AND o_totalprice <= 300000 AND o_orderkey % 3 = 0")
def flt_05(spark, d):
    return fixtures.alerts(spark, d).filter("status = 'NEW' and severity = 'HIGH' and kind = 'industrial_fire'").select("alert_id")


@query("flt_06_facilities", "SELECT s_suppkey AS facility_id FROM supplier WHERE s_suppkey % 7 = 3")
def flt_06(spark, d):
    return fixtures.facilities(spark, d).filter("category = 'mine'").select("facility_id")


@query("flt_09_notifications", "SELECT count(*) AS visible, count(*) FILTER (WHERE o_orderstatus = 'O') AS unread FROM orders WHERE o_custkey = 7 OR o_orderkey % 10 = 0")
def flt_09(spark, d):
    """What a user may see: their own notifications and those without a recipient."""
    rows = fixtures.alerts(spark, d).withColumn("user_id", F.when(F.col("alert_id") % 10 != 0, F.col("site_id")))
    mine = rows.filter((F.col("user_id") == 7) | F.col("user_id").isNull())
    return mine.agg(F.count("*").alias("visible"), F.count_if(F.col("status") == "NEW").alias("unread"))


@query("srt_07_alert_page", "SELECT o_orderkey AS alert_id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50")
def srt_07(spark, d):
    first = fixtures.alerts(spark, d).orderBy(F.desc("created"), "alert_id").limit(100)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("created"), "alert_id")).cast("long"))
    return placed.filter("place > 50").select("alert_id", "place")


@query("alr_03_transitions", "SELECT l_orderkey AS alert_id, arg_max(l_returnflag, l_linenumber) AS status, count(*) AS steps FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def alr_03(spark, d):
    """The state that a log of transitions leads to: the step of the highest number."""
    steps = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("status"))
    return steps.groupBy(F.col("l_orderkey").alias("alert_id")).agg(F.max_by("status", "l_linenumber").alias("status"), F.count("*").alias("steps"))


@query("snk_09_import", "SELECT l_orderkey AS event_key, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY l_orderkey")
def snk_09(spark, d):
    """Insert if absent: new rows whose key the table doesn't hold."""
    held = table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("event_key"))
    new = fixtures.annotations(spark, d).groupBy("event_key").agg(F.count("*").alias("n"))
    return new.join(held, "event_key", "left_anti")


@query("snk_10_upsert", f"""WITH {DET_SQL}, old AS (SELECT det_id, frp, brightness FROM det WHERE det_id % 2 = 0), new AS (SELECT det_id, frp + 1 AS frp, brightness FROM det WHERE det_id % 3 = 0)
SELECT coalesce(old.det_id, new.det_id) AS det_id, round(CASE WHEN new.det_id IS NOT NULL THEN new.frp ELSE old.frp END, 6) AS frp, round(CASE WHEN new.det_id IS NOT NULL THEN new.brightness ELSE old.brightness END, 6) AS brightness, old.det_id IS NULL AS created
FROM old FULL JOIN new ON old.det_id = new.det_id""")
def snk_10(spark, d):
    det = fixtures.detections(spark, d).select("det_id", "frp", "brightness")
    return upserted(det.filter("det_id % 2 = 0"), det.filter("det_id % 3 = 0").withColumn("frp", F.col("frp") + 1)).select("det_id", F.round("frp", 6).alias("frp"), F.round("brightness", 6).alias("brightness"), "created")


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with brightness and FRP of ``new`` where det_id is known, and the rows of ``new`` that aren't."""
    new = new.withColumnsRenamed({c: f"new_{c}" for c in new.columns})
    rows = old.join(new, F.col("det_id") == F.col("new_det_id"), "full")
    pick = lambda c: F.when(F.col("new_det_id").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return rows.select(F.coalesce("det_id", "new_det_id").alias("det_id"), pick("frp"), pick("brightness"), F.col("det_id").isNull().alias("created"))


@query("mut_01_mark_read", "SELECT o_orderkey AS alert_id, o_orderstatus = 'F' OR o_custkey = 7 AS read FROM orders")
def mut_01(spark, d):
    """Read receipts joined over the table: what was read before, or belongs to the user who marks all."""
    rows = fixtures.alerts(spark, d)
    return rows.select("alert_id", ((F.col("status") == "RESOLVED") | (F.col("site_id") == 7)).alias("read"))


# Metrics ----------------------------------------------------------------------------------------------------

_PRED = f"""{_LAST}, truth AS (SELECT event_key, CASE WHEN label IN ('Gas Flare', 'Wildfire') THEN label ELSE 'Other' END AS label FROM ({_PICK})),
pred AS (SELECT l_orderkey AS event_key, CASE arg_max(l_returnflag, l_linenumber) WHEN 'R' THEN 'Gas Flare' WHEN 'A' THEN 'Wildfire' ELSE 'Other' END AS predicted, arg_max(1e0 - l_tax * 5, l_linenumber) AS probability
  FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, min(l_tax) AS l_tax FROM lineitem GROUP BY ALL) GROUP BY l_orderkey), both_ AS (SELECT * FROM truth JOIN pred USING (event_key))"""


def judged(spark, d) -> DataFrame:
    """(event_key, label, predicted, probability): each event's latest label and latest prediction."""
    label = F.when(F.col("label").isin("Gas Flare", "Wildfire"), F.col("label")).otherwise("Other")
    truth = latest_annotations(spark, d).select("event_key", label.alias("label"))
    steps = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"), F.min("l_tax").alias("tax"))
    last = steps.groupBy(F.col("l_orderkey").alias("event_key")).agg(F.max_by("flag", "l_linenumber").alias("flag"), F.max_by("tax", "l_linenumber").alias("tax"))
    named = F.when(F.col("flag") == "R", "Gas Flare").when(F.col("flag") == "A", "Wildfire").otherwise("Other")
    return truth.join(last.select("event_key", named.alias("predicted"), (F.lit(1.0) - F.col("tax") * 5).alias("probability")), "event_key")


@query("agg_27_confusion", f"WITH {_PRED} SELECT label, predicted, count(*) AS n FROM both_ GROUP BY ALL")
def agg_27(spark, d):
    return judged(spark, d).groupBy("label", "predicted").agg(F.count("*").alias("n"))


@query("agg_27_scores", f"""WITH {_PRED}, c AS (SELECT DISTINCT label FROM both_), s AS (SELECT c.label, count(*) FILTER (WHERE b.label = c.label AND predicted = c.label) AS tp, count(*) FILTER (WHERE predicted = c.label) AS p, count(*) FILTER (WHERE b.label = c.label) AS t FROM c, both_ b GROUP BY c.label)
SELECT label, round(CASE WHEN p = 0 THEN 0 ELSE tp / p END, 6) AS "precision", round(CASE WHEN t = 0 THEN 0 ELSE tp / t END, 6) AS recall, round(CASE WHEN p + t = 0 THEN 0 ELSE 2e0 * tp / (p + t) END, 6) AS f1 FROM s""")
def agg_27_scores(spark, d):
    from emberline.operators.metrics import class_scores

    return class_scores(judged(spark, d))


@query("agg_27_reliability", f"WITH {_PRED} SELECT least(floor(probability * 10), 9)::INT AS bin, count(*) AS n, round(avg(probability), 5) AS mean_probability, round(avg((label = predicted)::INT), 5) AS right_share FROM both_ GROUP BY bin")
def agg_27_reliability(spark, d):
    from emberline.operators.metrics import reliability

    return reliability(judged(spark, d))


@query("agg_27_roc", f"""WITH {_PRED}, g AS (SELECT probability, count(*) FILTER (WHERE label = predicted) AS pos, count(*) FILTER (WHERE label <> predicted) AS neg FROM both_ GROUP BY probability),
c AS (SELECT probability, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS allp, sum(neg) OVER () AS alln FROM g WINDOW w AS (ORDER BY probability DESC))
SELECT round(probability, 6) AS threshold, round(tp / allp, 6) AS tpr, round(fp / alln, 6) AS fpr FROM c""")
def agg_27_roc(spark, d):
    from emberline.operators.metrics import roc

    return roc(judged(spark, d).select("probability", (F.col("label") == F.col("predicted")).alias("positive")))


_EACH = "k AS (SELECT c AS class, CASE WHEN c = predicted THEN probability ELSE (1 - probability) / 2 END AS probability, label = c AS positive FROM both_, (SELECT unnest(['Gas Flare', 'Wildfire', 'Other']) AS c)), g AS (SELECT class, probability, count(*) FILTER (WHERE positive) AS pos, count(*) AS n FROM k GROUP BY ALL), s AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS said, sum(pos) OVER (PARTITION BY class) AS p, sum(n) OVER (PARTITION BY class) AS total FROM g WINDOW w AS (PARTITION BY class ORDER BY probability DESC))"


@query("agg_27_class_curves", f"WITH {_PRED}, {_EACH} SELECT class, round(probability, 6) AS threshold, round(tp / said, 6) AS \"precision\", round(tp / p, 6) AS recall FROM s")
def agg_27_curves(spark, d):
    """The precision-recall curve of each class."""
    from emberline.operators.metrics import each_class, precision_recall

    return precision_recall(each_class(judged(spark, d), ("Gas Flare", "Wildfire", "Other")), ["class"])


@query("agg_27_class_summary", f"""WITH {_PRED}, {_EACH}, a AS (SELECT class, round(sum((pos / p) * (tp / said)), 6) AS average_precision, round(sum((n - pos) * (tp - pos / 2)) / max(p * (total - p)), 6) AS roc_auc FROM s GROUP BY class)
SELECT class, count(*) AS n, count(*) FILTER (WHERE positive) AS positives, true AS available, round(avg(pow(probability - positive::INT, 2)), 6) AS brier, any_value(average_precision) AS average_precision, any_value(roc_auc) AS roc_auc FROM k JOIN a USING (class) GROUP BY class""")
def agg_27_summary(spark, d):
    """Brier score, average precision and area under the ROC curve of each class."""
    from emberline.operators.metrics import class_summary, each_class

    return class_summary(each_class(judged(spark, d), ("Gas Flare", "Wildfire", "Other")))


@query("str_06_ratelimit", """WITH RECURSIVE m AS (SELECT o_custkey % 50 AS recipient, o_orderkey AS id, epoch_us(o_orderdate) // 1000000 AS s, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
f(recipient, k, id, sent, last) AS (SELECT recipient, k, id, true, s FROM m WHERE k = 1 UNION ALL
SELECT m.recipient, m.k, m.id, m.s - f.last >= 2592000, CASE WHEN m.s - f.last >= 2592000 THEN m.s ELSE f.last END FROM f JOIN m ON m.recipient = f.recipient AND m.k = f.k + 1)
SELECT id, sent FROM f""")
def str_06(spark, d):
    """Notifications that a limit per recipient lets through: each is compared with the last one sent, not the last one due."""
    from emberline.streaming.ratelimit import limited_batch

    rows = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("recipient"), F.col("o_orderkey").alias("id"), F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000000").alias("at"))
    return limited_batch(rows, 30 * 86400).select("id", "sent")


@query("rollup_state_district", f"WITH {DET_SQL} SELECT state, district, count(*) AS n FROM det GROUP BY ROLLUP (state, district)")
def rollup(spark, d):
    return fixtures.detections(spark, d).rollup("state", "district").agg(F.count("*").alias("n"))


@query("snk_07_daily_report", on_scored(f"""SELECT 'hotspots' AS item, count(*) AS n FROM scored WHERE acq_us >= {fixtures.NOW_US - DAY} UNION ALL SELECT 'critical', count(*) FROM scored WHERE risk_level IN ('CRITICAL', 'HIGH')
UNION ALL SELECT 'new alerts', count(*) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'detections', count(*) FROM det WHERE acq_us >= {fixtures.NOW_US - DAY}"""))
def snk_07(spark, d):
    """The tabular part of the daily report."""
    rows, det, alerts = scored(spark, d), fixtures.detections(spark, d), fixtures.alerts(spark, d)
    since = F.col("acq_us") >= fixtures.NOW_US - DAY
    item = lambda name, frame: frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")
    parts = [item("hotspots", rows.filter(since)), item("critical", rows.filter(F.col("risk_level").isin("CRITICAL", "HIGH"))), item("new alerts", alerts.filter("status = 'NEW'")), item("detections", det.filter(since))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


_TAGGED = """el AS (SELECT s_suppkey AS k, ['refinery', 'factory', 'power_plant', 'mine', 'industrial_area', NULL][(s_suppkey % 6 + 1)::INT] AS category, s_suppkey % 5 AS form FROM supplier)"""


def overpass_elements(spark, d) -> DataFrame:
    """Elements as an Overpass export holds them, from supplier: places, closed and open ways, centres, and some with nothing."""
    k = F.col("s_suppkey")
    tags = [F.create_map(F.lit(a), F.lit(b)) for a, b in (("industrial", "refinery"), ("industrial", "factory"), ("power", "plant"), ("man_made", "mine"), ("landuse", "industrial"), ("landuse", "forest"))]
    form, lat, lon = k % 5, (F.lit(8.0) + k % 20), (F.lit(70.0) + k % 20)
    at = lambda dy, dx: F.struct((lat + dy).alias("lat"), (lon + dx).alias("lon"))
    line = F.array(at(0, 0), at(0, 1), at(1, 1), at(0, 0))
    return table(spark, d, "supplier").select(
        F.when(form.isin(1, 2, 3), "way").when(form == 4, "relation").otherwise("node").alias("type"),
        k.alias("id"),
        F.when(form == 0, lat).alias("lat"),
        F.when(form == 0, lon).alias("lon"),
        F.when(form.isin(2, 3), at(0.5, 0.5)).alias("center"),
        F.when(form == 1, line).when(form == 2, F.slice(line, 1, 3)).alias("geometry"),
        F.element_at(F.array(*tags), (k % 6 + 1).cast("int")).alias("tags"),
    )


@query("src_08_overpass", f"""WITH {_TAGGED} SELECT CASE form WHEN 0 THEN 'node' WHEN 4 THEN 'relation' ELSE 'way' END || '/' || k::VARCHAR AS feature_id, CASE WHEN category IS NULL THEN 'UNKNOWN_FACILITY_TYPE' WHEN form = 2 THEN 'OPEN_WAY_REQUIRES_EXPLICIT_GEOMETRY'
WHEN form = 4 THEN 'MISSING_OR_UNASSEMBLED_GEOMETRY' ELSE category END AS outcome, CASE WHEN category IS NULL OR form IN (2, 4) THEN NULL WHEN form = 1 THEN 'Polygon' ELSE 'Point' END AS "shape", CASE WHEN category IS NOT NULL AND form NOT IN (2, 4) THEN form = 3 END AS center_only FROM el""")
def src_08(spark, d):
    from emberline.sources.reference import overpass_rows

    good, bad = overpass_rows(overpass_elements(spark, d))
    taken = good.select("feature_id", F.col("category").alias("outcome"), "shape", "center_only")
    return taken.unionByName(bad.select("feature_id", F.col("reason").alias("outcome")), allowMissingColumns=True)
