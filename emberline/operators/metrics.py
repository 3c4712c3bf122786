"""Classification metrics as aggregates, so that they need no pass through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.numbering import running


def class_scores(rows: DataFrame) -> DataFrame:
    """(label, precision, recall, f1) from (label, predicted), for each label that occurs."""
    counts = rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    said = counts.groupBy("predicted").agg(F.sum("n").alias("p")).withColumnRenamed("predicted", "label")
    true = counts.groupBy("label").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    both = true.join(said, "label", "left").fillna(0, ["p"])
    ratio = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(a / b), 6)
    tp, p, t = F.col("tp"), F.col("p"), F.col("t")
    return both.select("label", ratio(tp, p).alias("precision"), ratio(tp, t).alias("recall"), ratio(tp * 2.0, p + t).alias("f1"))


def reliability(rows: DataFrame) -> DataFrame:
    """Ten bins of probability: how many, what they claim and how often they are right."""
    bin_ = F.least(F.floor(F.col("probability") * 10), F.lit(9)).cast("int")
    right = (F.col("label") == F.col("predicted")).cast("int")
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("probability"), 5).alias("mean_probability"), F.round(F.avg(right), 5).alias("right_share"))


def curve(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., probability, pos, n, tp, said, p, all) from (by..., probability, positive): for each distinct probability how many rows have it and how many have it
    or more, and the totals. The running sums go over ranges of probabilities."""
    by = list(by)
    counts = rows.groupBy(*by, "probability").agg(F.count_if("positive").alias("pos"), F.count("*").alias("n"))
    steps = running(counts, [F.desc("probability")], {"tp": F.col("pos"), "said": F.col("n")}, by)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("n").alias("all"))
    return steps.join(totals, by) if by else steps.crossJoin(F.broadcast(totals))  # one row


def roc(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., threshold, tpr, fpr) from (by..., probability, positive)."""
    c = F.col
    return curve(rows, by).select(*by, F.round("probability", 6).alias("threshold"), F.round(F.try_divide("tp", "p"), 6).alias("tpr"), F.round(F.try_divide(c("said") - c("tp"), c("all") - c("p")), 6).alias("fpr"))


def precision_recall(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., threshold, precision, recall) from (by..., probability, positive)."""
    c = F.col
    return curve(rows, by).select(*by, F.round("probability", 6).alias("threshold"), F.round(c("tp") / c("said"), 6).alias("precision"), F.round(F.try_divide("tp", "p"), 6).alias("recall"))


def probability_scores(rows: DataFrame, classes: int) -> DataFrame:
    """(log_loss, brier, n) from (label, predicted, probability); what a prediction leaves is shared by the other classes."""
    right = F.col("label") == F.col("predicted")
    given = F.when(right, F.col("probability")).otherwise((1 - F.col("probability")) / (classes - 1))
    return rows.agg(
        F.round(F.avg(-F.log(F.greatest(F.lit(1e-12), given))), 6).alias("log_loss"),
        F.round(F.avg(F.pow(F.col("probability") - right.cast("int"), F.lit(2.0))), 6).alias("brier"),
        F.count("*").alias("n"),
    )


def average_precision(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., average_precision, roc_auc) from (by..., probability, positive); equal probabilities are one step of either curve. Null where all rows are of one side."""
    c = F.col
    both = curve(rows, by)
    return both.groupBy(*by).agg(
        F.round(F.sum(F.try_divide("pos", "p") * (c("tp") / c("said"))), 6).alias("average_precision"),
        F.round(F.try_divide(F.sum((c("n") - c("pos")) * (c("tp") - c("pos") / 2)), F.max(c("p") * (c("all") - c("p")))), 6).alias("roc_auc"),
    )


def each_class(rows: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """(class, probability, positive) for each class of each row of (label, predicted, probability): what a prediction leaves is shared by the other classes."""
    named = rows.withColumn("class", F.explode(F.array(*map(F.lit, classes))))
    given = F.when(F.col("class") == F.col("predicted"), F.col("probability")).otherwise((1 - F.col("probability")) / (len(classes) - 1))
    return named.select("class", given.alias("probability"), (F.col("label") == F.col("class")).alias("positive"))


def class_summary(rows: DataFrame) -> DataFrame:
    """(class, n, positives, available, brier, average_precision, roc_auc) from (class, probability, positive): a class without rows of both sides has no figures."""
    facts = rows.groupBy("class").agg(F.count("*").alias("n"), F.count_if("positive").alias("positives"), F.avg(F.pow(F.col("probability") - F.col("positive").cast("int"), F.lit(2.0))).alias("brier"))
    facts = facts.withColumn("available", (F.col("positives") > 0) & (F.col("positives") < F.col("n")))
    joined = facts.join(average_precision(rows, ["class"]), "class")
    return joined.select("class", "n", "positives", "available", *[F.when(F.col("available"), F.round(c, 6)).alias(c) for c in ("brier", "average_precision", "roc_auc")])
