"""Workflows that are kept as logs: revisions of annotations, transitions of alerts, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join that fails as soon as ``right`` repeats a key, instead of multiplying rows."""
    once = right.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in right.columns if c != key])
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string")))).otherwise(F.col(key))
    return left.join(once.withColumn(key, checked).drop("_n"), key, how)


def revised(log: DataFrame) -> DataFrame:
    """(event_key, revision, status, annotator, reviewer, conflicts, refused) from a log (event_key, step, actor, action, expected).

    Steps apply in order. One is a conflict unless it expects the revision there is. Anyone may write a draft or submit; only a
    submitted annotation can be approved or rejected, and only by another than who wrote it, else the step is refused. An event's log
    is a few steps, so it is folded as one array.
    """
    start = F.struct(F.lit(0).alias("revision"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("annotator"), F.lit(None).cast("long").alias("reviewer"), F.lit(0).alias("conflicts"), F.lit(0).alias("refused"))

    def step(s: Column, x: Column) -> Column:
        stale = x["expected"] != s["revision"]
        review = x["action"].isin("approve", "reject")
        refused = ~stale & review & (~s["status"].eqNullSafe(F.lit("submitted")) | s["annotator"].eqNullSafe(x["actor"]))
        done = ~stale & ~refused
        name = F.when(x["action"] == "approve", "approved").when(x["action"] == "reject", "rejected").when(x["action"] == "submit", "submitted").otherwise("draft")
        return F.struct(
            (s["revision"] + done.cast("int")).alias("revision"),
            F.when(done, name).otherwise(s["status"]).alias("status"),
            F.when(done & ~review, x["actor"]).otherwise(s["annotator"]).alias("annotator"),
            F.when(done, F.when(review, x["actor"])).otherwise(s["reviewer"]).alias("reviewer"),
            (s["conflicts"] + stale.cast("int")).alias("conflicts"),
            (s["refused"] + refused.cast("int")).alias("refused"),
        )

    logs = log.groupBy("event_key").agg(F.array_sort(F.collect_list(F.struct("step", "actor", "action", "expected"))).alias("log"))
    return logs.select("event_key", F.aggregate("log", start, step).alias("s")).select("event_key", "s.*")


def annotation_errors(now) -> Column:
    """What keeps an annotation (review_status, annotator, reviewer, source, evidence, confidence, reviewed_us) from being valid."""
    approved, blank = F.col("review_status") == "approved", lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    bare = F.coalesce(F.size("evidence") < 1, F.lit(True)) | F.exists(F.coalesce("evidence", F.array().cast("array<string>")), blank)
    return F.array_compact(
        F.array(
            F.when(F.col("reviewed_us") > now, "REVIEW_IN_THE_FUTURE"),
            F.when(approved & (blank(F.col("reviewer")) | (F.lower("reviewer") == F.lower("annotator"))), "REVIEWER_NOT_INDEPENDENT"),
            F.when(approved & (blank(F.col("source")) | bare), "SOURCE_OR_EVIDENCE_MISSING"),
            F.when(approved & (F.col("confidence").isNull() | F.col("reviewed_us").isNull()), "CONFIDENCE_OR_TIME_MISSING"),
        )
    )


def normal_review_error(now) -> Column:
    """Why a review of normal operation doesn't count: the first reason that holds, null if it does."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return (
        F.when(F.col("event_key").isNull(), "EVENT_MISSING")
        .when(~F.coalesce(F.col("normal_operation"), F.lit(False)), "NOT_NORMAL")
        .when(blank("reviewer") | blank("annotator") | (F.col("reviewer") == F.col("annotator")), "REVIEWER_NOT_INDEPENDENT")
        .when(blank("source") | F.coalesce(F.size("evidence") < 1, F.lit(True)), "SOURCE_OR_EVIDENCE_MISSING")
        .when(F.col("reviewed_us").isNull() | (F.col("reviewed_us") > now), "TIME_INVALID")
    )


def transitions(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts, activity) from a log (alert_id, step, actor, status): each alert's last status and the officer assigned, who is the
    first to act on it; and a row of activity for each step."""
    alerts = log.groupBy("alert_id").agg(F.max_by("status", "step").alias("status"), F.min_by("actor", "step").alias("officer"), F.count("*").alias("steps"))
    activity = log.select(F.col("actor").alias("user_id"), F.concat(F.lit("alert_"), "status").alias("action"), F.lit("alert").alias("entity"), F.format_string("AL-%04d", "alert_id").alias("entity_id"), "step")
    return alerts, activity


def visible_activity(activity: DataFrame, user, admin: bool, scope: str = "self", of=None, action: str | None = None, limit: int = 100) -> DataFrame:
    """The newest rows of activity that ``user`` may see: their own, or as an admin with scope "all" everyone's or those ``of`` one."""
    if scope == "all" and not admin:
        raise PermissionError("scope all is for admins")
    if scope == "all":
        rows = activity if of is None else activity.filter(F.col("user_id") == of)
    else:
        rows = activity.filter(F.col("user_id") == user)
    rows = rows if action is None else rows.filter(F.col("action") == action)
    return rows.orderBy(F.desc("step"), "entity_id", "action", "user_id").limit(limit)
