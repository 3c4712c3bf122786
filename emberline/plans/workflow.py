"""Annotation and alert workflows, event details, audits of reviews and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import explain, scoring
from emberline.operators import events as ops
from emberline.operators import workflow as flow
from emberline.operators.metrics import average_precision, probability_scores
from emberline.operators.numbering import numbered
from emberline.plans.events import _GROUPS, _HIST, _SPLIT, event_tables, on_events, splittable
from emberline.plans.model import on_scored
from emberline.plans.records import _LAST, _PICK, _PRED, judged, latest_annotations
from emberline.plans.registry import query, scored
from emberline.session import stored, table
from emberline.sources import fixtures

NOW, DAY = fixtures.NOW_US, fixtures.DAY_US

# Annotations ------------------------------------------------------------------------------------------------

_ACTIONS = ("draft", "submit", "approve", "reject", "submit")
_LOG = """log AS (SELECT l_orderkey AS event_key, l_linenumber AS step, (min(l_suppkey) % 3)::BIGINT AS actor, ['draft', 'submit', 'approve', 'reject', 'submit'][(min(l_partkey) % 5 + 1)::INT] AS action,
  (l_linenumber - 1 - CASE WHEN min(l_partkey) % 3 = 0 THEN 1 ELSE 0 END)::INT AS expected FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def annotation_log(spark, d) -> DataFrame:
    """Steps on annotations, from lineitem: (event_key, step, actor, action, expected)."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_key"), F.col("l_linenumber").alias("step")).agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    stale = F.when(F.col("p") % 3 == 0, 1).otherwise(0)
    return rows.select(
        "event_key", "step", (F.col("s") % 3).cast("long").alias("actor"), F.element_at(F.array(*map(F.lit, _ACTIONS)), (F.col("p") % 5 + 1).cast("int")).alias("action"), (F.col("step") - 1 - stale).cast("int").alias("expected")
    )


@query("lbl_02_revisions", f"""WITH RECURSIVE {_LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY step) AS k FROM log),
s(event_key, k, revision, status, annotator, reviewer, conflicts, refused) AS (SELECT DISTINCT event_key, 0::BIGINT, 0, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, 0, 0 FROM log UNION ALL
SELECT event_key, k, revision + done::INT, CASE WHEN done THEN CASE action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'submit' THEN 'submitted' ELSE 'draft' END ELSE status END,
CASE WHEN done AND NOT review THEN actor ELSE annotator END, CASE WHEN done THEN CASE WHEN review THEN actor END ELSE reviewer END, conflicts + stale::INT, refused + no::INT FROM (
SELECT *, NOT stale AND NOT no AS done FROM (SELECT *, NOT stale AND review AND (status IS DISTINCT FROM 'submitted' OR annotator IS NOT DISTINCT FROM actor) AS no FROM (
SELECT s.*, o.k AS k1, o.actor, o.action, o.expected <> s.revision AS stale, o.action IN ('approve', 'reject') AS review FROM s JOIN o ON o.event_key = s.event_key AND o.k = s.k + 1))) t(event_key, k0, revision, status, annotator, reviewer, conflicts, refused, k, actor, action, stale, review, no, done))
SELECT event_key, revision, status, annotator, reviewer, conflicts, refused FROM s WHERE (event_key, k) IN (SELECT event_key, max(k) FROM o GROUP BY event_key)""")
def lbl_02(spark, d):
    return flow.revised(annotation_log(spark, d))


_NOTES = """notes AS (SELECT o_orderkey AS event_key, CASE o_orderstatus WHEN 'F' THEN 'approved' ELSE 'draft' END AS review_status, 'u' || (o_custkey % 4)::VARCHAR AS annotator,
  CASE WHEN o_orderkey % 9 <> 0 THEN 'U' || (o_custkey % 3)::VARCHAR END AS reviewer, CASE WHEN o_orderkey % 7 <> 0 THEN 'archive' ELSE ' ' END AS source, o_orderkey % 4 AS proofs,
  CASE WHEN o_orderkey % 8 <> 0 THEN 0.9 END AS confidence, CASE WHEN o_orderkey % 10 <> 0 THEN epoch_us(o_orderdate) + CASE WHEN o_orderkey % 11 = 0 THEN 3155760000000000 ELSE 0 END END AS reviewed_us, o_orderkey % 5 <> 1 AS normal_operation FROM orders)"""


def notes(spark, d) -> DataFrame:
    """Annotations with their evidence, from orders; some lack what a review needs."""
    k = F.col("o_orderkey")
    when = F.expr("unix_micros(cast(o_orderdate as timestamp))") + F.when(k % 11 == 0, F.lit(3155760000000000)).otherwise(0)
    return table(spark, d, "orders").select(
        k.alias("event_key"),
        F.when(F.col("o_orderstatus") == "F", "approved").otherwise("draft").alias("review_status"),
        F.concat(F.lit("u"), (F.col("o_custkey") % 4).cast("string")).alias("annotator"),
        F.when(k % 9 != 0, F.concat(F.lit("U"), (F.col("o_custkey") % 3).cast("string"))).alias("reviewer"),
        F.when(k % 7 != 0, "archive").otherwise(" ").alias("source"),
        F.array_repeat(F.lit("scene"), (k % 4).cast("int")).alias("evidence"),
        F.when(k % 8 != 0, 0.9).alias("confidence"),
        F.when(k % 10 != 0, when).alias("reviewed_us"),
        (k % 5 != 1).alias("normal_operation"),
    )


@query("lbl_01_validity", f"""WITH {_NOTES} SELECT event_key, concat_ws(';', CASE WHEN reviewed_us > {NOW} THEN 'REVIEW_IN_THE_FUTURE' END,
CASE WHEN review_status = 'approved' AND (reviewer IS NULL OR lower(reviewer) = lower(annotator)) THEN 'REVIEWER_NOT_INDEPENDENT' END, CASE WHEN review_status = 'approved' AND (trim(source) = '' OR proofs = 0) THEN 'SOURCE_OR_EVIDENCE_MISSING' END,
CASE WHEN review_status = 'approved' AND (confidence IS NULL OR reviewed_us IS NULL) THEN 'CONFIDENCE_OR_TIME_MISSING' END) AS errors FROM notes""")
def lbl_01_validity(spark, d):
    return notes(spark, d).select("event_key", F.array_join(flow.annotation_errors(F.lit(NOW)), ";").alias("errors"))


@query("lbl_03_normal", f"""WITH {_NOTES} SELECT event_key, CASE WHEN NOT normal_operation THEN 'NOT_NORMAL' WHEN reviewer IS NULL OR reviewer = annotator THEN 'REVIEWER_NOT_INDEPENDENT' WHEN trim(source) = '' OR proofs = 0 THEN 'SOURCE_OR_EVIDENCE_MISSING'
WHEN reviewed_us IS NULL OR reviewed_us > {NOW} THEN 'TIME_INVALID' END AS error FROM notes""")
def lbl_03(spark, d):
    return notes(spark, d).select("event_key", flow.normal_review_error(F.lit(NOW)).alias("error"))


@query("snk_12_export", f"""WITH {_LAST} SELECT event_key, '{{"event_key":' || event_key::VARCHAR || ',"revision":' || revision::VARCHAR || ',"label":"' || label || '","review_status":"' || review_status || '","quality":"' || quality || '"}}' AS payload FROM ({_PICK})""")
def snk_12(spark, d):
    """The latest revision of each annotation as JSON."""
    return latest_annotations(spark, d).select("event_key", F.to_json(F.struct("event_key", "revision", "label", "review_status", "quality")).alias("payload"))


# Alerts and activity ----------------------------------------------------------------------------------------

_STEPS = """steps AS (SELECT l_orderkey AS alert_id, l_linenumber AS step, (min(l_suppkey) % 6)::BIGINT AS actor, CASE max(l_returnflag) WHEN 'A' THEN 'acknowledged' WHEN 'R' THEN 'escalated' ELSE 'resolved' END AS status FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def alert_log(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("alert_id"), F.col("l_linenumber").alias("step")).agg(F.min("l_suppkey").alias("s"), F.max("l_returnflag").alias("flag"))
    status = F.when(F.col("flag") == "A", "acknowledged").when(F.col("flag") == "R", "escalated").otherwise("resolved")
    return rows.select("alert_id", "step", (F.col("s") % 6).cast("long").alias("actor"), status.alias("status"))


@query("alr_03_workflow", f"WITH {_STEPS} SELECT alert_id, arg_max(status, step) AS status, arg_min(actor, step) AS officer, count(*) AS steps FROM steps GROUP BY alert_id")
def alr_03_workflow(spark, d):
    return flow.transitions(alert_log(spark, d))[0]


@query("mut_03_activity", f"WITH {_STEPS} SELECT actor AS user_id, 'alert_' || status AS action, 'alert' AS entity, printf('AL-%04d', alert_id) AS entity_id, step FROM steps")
def mut_03(spark, d):
    """The audit trail: each transition appends a row."""
    return flow.transitions(alert_log(spark, d))[1]


@query("flt_08_activity", f"WITH {_STEPS} SELECT actor AS user_id, 'alert_' || status AS action, 'alert' AS entity, printf('AL-%04d', alert_id) AS entity_id, step FROM steps WHERE actor = 2 AND status = 'escalated' ORDER BY step DESC, entity_id LIMIT 100")
def flt_08(spark, d):
    return flow.visible_activity(flow.transitions(alert_log(spark, d))[1], user=2, admin=False, action="alert_escalated")


@query("mut_01_mark_one", "SELECT o_orderkey AS alert_id, o_orderstatus = 'F' OR (o_orderkey % 17 = 3 AND (o_custkey = 7 OR o_orderkey % 10 = 0)) AS read, o_orderkey % 17 = 3 AND NOT (o_custkey = 7 OR o_orderkey % 10 = 0) AS refused FROM orders")
def mut_01_one(spark, d):
    """Read receipts of user 7, joined over the table: one for what the user may not see is refused and changes nothing."""
    rows = fixtures.alerts(spark, d).withColumn("user_id", F.when(F.col("alert_id") % 10 != 0, F.col("site_id")))
    receipts = rows.filter("alert_id % 17 = 3").select("alert_id", F.lit(True).alias("marked"))
    mine = F.coalesce(F.col("user_id") == 7, F.lit(True))
    marked = F.coalesce("marked", F.lit(False))
    return rows.join(receipts, "alert_id", "left").select("alert_id", ((F.col("status") == "RESOLVED") | (marked & mine)).alias("read"), (marked & ~mine).alias("refused"))


@query("flt_06_validations", on_scored("SELECT validation_id, site_id, status FROM val WHERE status = 'LIKELY' AND site_id % 4 = 0"))
def flt_06_validations(spark, d):
    return fixtures.validations(fixtures.hotspots(spark, d)).filter("status = 'LIKELY' and site_id % 4 = 0")


@query("flt_06_zones", "SELECT s_suppkey AS facility_id, s_name AS name FROM supplier WHERE s_suppkey % 7 IN (0, 5) AND contains(lower(s_name), '1')")
def flt_06_zones(spark, d):
    return fixtures.facilities(spark, d).filter(F.col("category").isin("refinery", "industrial_area") & F.lower("name").contains("1")).select("facility_id", "name")


@query("flt_11_playback", on_scored("SELECT site_id, day FROM (SELECT site_id, strftime(acq_ts, '%Y-%m-%d') AS day FROM scored) WHERE starts_with(day, '2024-01-1') OR day LIKE '%-3_'"))
def flt_11(spark, d):
    """Filters of the client: a prefix of the day, or one of its ending."""
    rows = scored(spark, d).select("site_id", F.date_format("acq_ts", "yyyy-MM-dd").alias("day"))
    return rows.filter(F.col("day").startswith("2024-01-1") | F.col("day").like("%-3_"))


@query("snk_09_conflicts", "SELECT event_key, CASE WHEN held IS NULL THEN 'insert' WHEN held = sent THEN 'same' ELSE 'conflict' END AS outcome FROM (SELECT l_orderkey AS event_key, min(l_partkey % 3) AS sent FROM lineitem GROUP BY l_orderkey) LEFT JOIN (SELECT o_orderkey AS event_key, o_custkey % 3 AS held FROM orders WHERE o_orderkey % 2 = 0) USING (event_key)")
def snk_09_conflicts(spark, d):
    """An import by key: what is new is inserted, what is held under the same artifact is skipped, and under another one is a conflict."""
    held = table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("event_key"), (F.col("o_custkey") % 3).alias("held"))
    sent = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_key")).agg(F.min(F.col("l_partkey") % 3).alias("sent"))
    outcome = F.when(F.col("held").isNull(), "insert").when(F.col("held") == F.col("sent"), "same").otherwise("conflict")
    return flow.one_to_one(sent, held, "event_key", "left").select("event_key", outcome.alias("outcome"))


@query("orc_12_numbers", "SELECT event_id, CASE WHEN isfinite(v) THEN v END AS number, CASE WHEN isfinite(v) THEN greatest(0, least(100, v)) END AS score FROM (SELECT event_id, TRY_CAST(t AS DOUBLE) AS v FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN 'inf' WHEN 2 THEN NULL WHEN 3 THEN '-12' ELSE (event_id % 300)::VARCHAR END AS t FROM events))")
def orc_12(spark, d):
    """Text to a number, null if it isn't finite, and clamped to a score; null stays null."""
    k = F.col("event_id")
    text = F.when(k % 6 == 0, "n/a").when(k % 6 == 1, "Infinity").when(k % 6 == 2, F.lit(None)).when(k % 6 == 3, "-12").otherwise((k % 300).cast("string"))
    v = text.try_cast("double")
    finite = F.when(F.abs(v) < float("inf"), v)
    return table(spark, d, "events").select("event_id", finite.alias("number"), F.when(finite.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), finite))).alias("score"))


# Events -----------------------------------------------------------------------------------------------------

_FE = _GROUPS


@query("join_19_facility_history", on_events("SELECT fid AS facility_id, event_id, k FROM (SELECT fid, event_id, row_number() OVER (PARTITION BY fid ORDER BY start_us, event_id)::INT AS k FROM fe JOIN ev USING (component) WHERE fid IS NOT NULL) WHERE k <= 1000", _FE))
def join_19(spark, d):
    """Each facility's events in order of time, the first 1000."""
    rows = splittable(spark, d).filter("facility_id is not null")
    k = F.row_number().over(Window.partitionBy("facility_id").orderBy("start_us", "event_id"))
    return rows.select("facility_id", "event_id", k.alias("k")).filter("k <= 1000")


_LABEL = f"{_LAST}, lab AS ({_PICK})"


@query("join_11_labels_splits", on_events(f"SELECT event_id, label, {_SPLIT} AS split FROM ev JOIN lab ON lab.event_key = ev.component", _LABEL))
def join_11(spark, d):
    """Events with their label and their split, each of them once."""
    event = event_tables(spark, d)[1].select("component", "event_id", "start_us")
    label = latest_annotations(spark, d).select(F.col("event_key").alias("component"), "label")
    split = event.select("component", F.expr(_SPLIT).alias("split"))
    return flow.one_to_one(flow.one_to_one(event, label, "component"), split, "component").select("event_id", "label", "split")


@query("join_12_sample_history", on_events("SELECT event_id, detection_count, coalesce(detections_90d, 0) AS detections_90d, hx AS historical_max_frp FROM ev LEFT JOIN hist USING (component) WHERE component % 10 = 0", _HIST))
def join_12(spark, d):
    event = event_tables(spark, d)[1]
    sample = event.filter("component % 10 = 0").select("event_id", "detection_count")
    past = ops.history(event, fixtures.detections(spark, d)).select("event_id", "detections_90d", "historical_max_frp")
    return flow.one_to_one(sample, past, "event_id", "left")


@query("orc_05_event_detail", on_events(f"""SELECT ev.event_id, observations, coalesce(n_predictions, 0) AS n_predictions, last_prediction, annotations FROM ev
JOIN (SELECT component, string_agg(det_id::VARCHAR, ',' ORDER BY acq_us, det_id) FILTER (WHERE k <= 1000) AS observations FROM (SELECT component, det_id, acq_us, row_number() OVER (PARTITION BY component ORDER BY acq_us, det_id) AS k FROM det JOIN comp USING (det_id)) GROUP BY component) USING (component)
LEFT JOIN (SELECT l_orderkey AS component, count(*) AS n_predictions, max(l_orderkey * 8 + l_linenumber) AS last_prediction FROM lineitem GROUP BY l_orderkey) USING (component)
LEFT JOIN (SELECT event_key AS component, string_agg(revision::VARCHAR || ':' || label, ',' ORDER BY revision, label) AS annotations FROM ann GROUP BY event_key) USING (component)""", _LAST))
def orc_05(spark, d):
    """An event with its latest prediction, its observations in order of time (the first 1000) and its annotations by revision."""
    member, event = event_tables(spark, d)
    at = Window.partitionBy("component").orderBy("acq_us", "det_id")
    seen = fixtures.detections(spark, d).select("det_id", "acq_us").join(member, "det_id").withColumn("k", F.row_number().over(at)).filter("k <= 1000")
    listed = lambda fields, show: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*fields))), show), ",")
    observations = seen.groupBy("component").agg(listed(("k", "det_id"), lambda x: x["det_id"].cast("string")).alias("observations"))
    predictions = fixtures.predictions(spark, d).groupBy(F.col("event_key").alias("component")).agg(F.count("*").alias("n_predictions"), F.max("prediction_id").alias("last_prediction"))
    notes_ = fixtures.annotations(spark, d).groupBy(F.col("event_key").alias("component")).agg(listed(("revision", "label"), lambda x: F.concat_ws(":", x["revision"].cast("string"), x["label"])).alias("annotations"))
    rows = event.select("component", "event_id").join(observations, "component").join(predictions, "component", "left").join(notes_, "component", "left")
    return rows.fillna(0, ["n_predictions"]).drop("component")


@query("orc_06_status", on_events("SELECT count(*) AS events, 'evidence_rules' AS mode, 6::BIGINT AS classes FROM ev"))
def orc_06(spark, d):
    return event_tables(spark, d)[1].agg(F.count("*").alias("events"), F.lit("evidence_rules").alias("mode"), F.lit(len(scoring.CLASSES)).cast("long").alias("classes"))


_DECIDED = """SELECT event_id, CASE WHEN event_id_ok THEN 'Gas Flare' ELSE 'Unknown' END AS decision, CASE WHEN event_id_ok THEN 0.6e0 END AS confidence, CASE WHEN event_id_ok THEN 'trained_with_context' ELSE 'evidence_rules' END AS mode,
CASE WHEN z >= 3 THEN 'review' ELSE 'unassessed' END AS priority, 1 + (days >= 30 AND hm > 0 AND hs / hm <= 0.5)::INT + coalesce(z >= 3, false)::INT + (component % 2 = 0)::INT AS n_reasons
FROM (SELECT *, component % 3 = 0 AS event_id_ok, coalesce(active_days_90d, 0) AS days, CASE WHEN with_frp >= 5 AND hs > 0 THEN (mean_frp - hm) / hs END AS z FROM ev LEFT JOIN hist USING (component))"""


def decisions(spark, d) -> DataFrame:
    """Events decided by an approved model where there is one (every third), else by evidence alone."""
    rows = ops.history(event_tables(spark, d)[1], fixtures.detections(spark, d))
    z = scoring.anomaly_score("mean_frp", "historical_mean_frp", "historical_std_frp", "with_frp")
    days = scoring.persistence_status("active_days_90d", "historical_mean_frp", "historical_std_frp")
    context = F.when(F.col("component") % 2 == 0, F.array(F.lit("industrial polygon"))).otherwise(F.array().cast("array<string>"))
    given = F.create_map(F.lit("Gas Flare"), F.lit(0.6), F.lit("Wildfire"), F.lit(0.4))
    rows = rows.withColumns({"approved": F.col("component") % 3 == 0, "given": given, "anomaly": scoring.anomaly_status(z), "held": days, "context": context})
    return rows.select("event_id", explain.hybrid_decision("given", "approved", "anomaly", "held", "context").alias("x")).select("event_id", "x.*")


@query("evi_03_decisions", on_events(_DECIDED, _HIST))
def evi_03(spark, d):
    return decisions(spark, d).select("event_id", "decision", "confidence", "mode", "priority", F.size("reasons").alias("n_reasons"))


@query("orc_07_reanalyze", on_events(f"""SELECT event_id, decision, n + 1 AS n, first + row_number() OVER (ORDER BY event_id) AS prediction_id FROM ({_DECIDED}) JOIN (SELECT event_id AS e, component FROM ev) ON e = event_id
LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_orderkey * 8 + l_linenumber) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = component JOIN (SELECT max(l_orderkey * 8 + l_linenumber) AS first FROM lineitem) ON true WHERE n IS NOT NULL""", _HIST))
def orc_07(spark, d):
    """A new analysis appended to the predictions of each event that has some: numbered after all there are, in the order of the events; the history keeps them all,
    the latest counts."""
    held = fixtures.predictions(spark, d).select("prediction_id", F.col("event_key").alias("component"), F.col("predicted").alias("decision"))
    event = event_tables(spark, d)[1].select("component", "event_id")
    last = held.agg(F.max("prediction_id")).first()[0] or 0
    # events first: predictions of other keys are never shuffled; what an event has twice counts once
    named = stored(held.join(event, "component").dropDuplicates(["event_id", "prediction_id"]).select("event_id", "prediction_id", "decision"), "held")
    due = decisions(spark, d).select("event_id", "decision").join(named.select("event_id").distinct(), "event_id")
    new = numbered(due, [F.col("event_id")]).select("event_id", (F.col("number") + last).alias("prediction_id"), "decision")
    return named.unionByName(new).groupBy("event_id").agg(F.max_by("decision", "prediction_id").alias("decision"), F.count("*").alias("n"), F.max("prediction_id").alias("prediction_id"))


@query("agg_26_leaks", on_events(f"""SELECT reason, n FROM (SELECT 'GROUP_LEAKAGE' AS reason, count(*) AS n FROM (SELECT grp FROM sp GROUP BY grp HAVING count(DISTINCT split) > 1) UNION ALL
SELECT 'FACILITY_LEAKAGE', count(*) FROM (SELECT fid FROM sp WHERE fid IS NOT NULL GROUP BY fid HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'EMPTY_' || upper(s), (count(*) FILTER (WHERE split = s) = 0)::BIGINT FROM sp, (VALUES ('train'), ('validation'), ('test')) t(s) GROUP BY s)""",
    f"{_GROUPS}, sp AS (SELECT {_SPLIT} AS split, grp, fid FROM ev JOIN grp USING (component) JOIN fe USING (component))"))
def agg_26_leaks(spark, d):
    """What is wrong with a split: groups and facilities on several sides, and sides that are empty."""
    rows = splittable(spark, d).join(ops.leakage_groups(splittable(spark, d)), "component").withColumn("split", F.expr(_SPLIT))
    several = lambda c, name: rows.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit(name).alias("reason"), "n")
    sides = rows.agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test")])
    empty = sides.select(F.explode(F.array(*[F.struct(F.lit(f"EMPTY_{s.upper()}").alias("reason"), (F.col(s) == 0).cast("long").alias("n")) for s in ("train", "validation", "test")])).alias("x")).select("x.*")
    return several("group", "GROUP_LEAKAGE").unionByName(several("facility_id", "FACILITY_LEAKAGE")).unionByName(empty)


@query("join_07_edges", on_events("SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM le", _GROUPS))
def join_07_edges(spark, d):
    return ops.leakage_edges(splittable(spark, d))


@query("agg_27_probability", f"""WITH {_PRED} SELECT round(avg(-ln(greatest(1e-12, CASE WHEN label = predicted THEN probability ELSE (1 - probability) / 2 END))), 6) AS log_loss, round(avg(pow(probability - (label = predicted)::INT, 2)), 6) AS brier, count(*) AS n FROM both_""")
def agg_27_probability(spark, d):
    return probability_scores(judged(spark, d), classes=3)


@query("agg_27_average_precision", f"""WITH {_PRED}, g AS (SELECT probability, count(*) FILTER (WHERE label = predicted) AS pos, count(*) AS n FROM both_ GROUP BY probability),
c AS (SELECT probability, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS said, sum(pos) OVER () AS allp, sum(n) OVER () AS alln, n FROM g WINDOW w AS (ORDER BY probability DESC))
SELECT round(sum((pos / allp) * (tp / said)), 6) AS average_precision, round(sum((n - pos) * (tp - pos / 2e0)) / max(allp * (alln - allp)), 6) AS roc_auc FROM c""")
def agg_27_average_precision(spark, d):
    return average_precision(judged(spark, d).select("probability", (F.col("label") == F.col("predicted")).alias("positive")))
