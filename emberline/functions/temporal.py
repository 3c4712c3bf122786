"""Temporal pattern and persistence of a place, from the distinct times of its detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US, DAY_US = 3.6e9, 8.64e10


def day_of(us: str) -> Column:
    return F.floor(F.col(us) / F.lit(86_400_000_000))


def interval_statistics(times: DataFrame, key: str, days: int) -> DataFrame:
    """One row for each key of ``times`` (key, us, now_us): n, active_days, span_days, mean_gap, std_gap (hours), last_us, now_us.

    Times count once, and only within [now - days, now].
    """
    inside = times.filter((F.col("us") <= F.col("now_us")) & (F.col("us") >= F.col("now_us") - F.lit(days * 86_400_000_000)))
    distinct = inside.select(key, "us", "now_us").distinct()
    gap = (F.col("us") - F.lag("us").over(Window.partitionBy(key).orderBy("us"))) / F.lit(HOUR_US)
    return (
        distinct.withColumn("gap", gap)
        .groupBy(key)
        .agg(
            F.count("*").alias("n"),
            F.count_distinct(day_of("us")).alias("active_days"),
            F.greatest(F.lit(1.0), (F.max("us") - F.min("us")) / F.lit(DAY_US)).alias("span_days"),
            F.avg("gap").alias("mean_gap"),
            F.stddev_pop("gap").alias("std_gap"),
            F.max("us").alias("last_us"),
            F.max("now_us").alias("now_us"),
        )
    )


def persistence_score(days: int) -> Column:
    """0 to 100 from active days, regularity and coverage; 0 for fewer than two times."""
    mean, std = F.col("mean_gap"), F.col("std_gap")
    regular = F.when(mean == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), (std / F.greatest(mean, F.lit(1e-9))) / 1.2)))
    coverage = F.least(F.lit(1.0), (F.col("n") * mean / 24.0) / float(days))
    return F.when(F.col("n") >= 2, F.least(F.lit(100.0), 6.0 * F.col("active_days") + 25.0 * regular + 15.0 * coverage)).otherwise(0.0)


def pattern(score: Column) -> Column:
    age = (F.col("now_us") - F.col("last_us")) / F.lit(HOUR_US)
    n, mean = F.col("n"), F.col("mean_gap")
    return (
        F.when(n == 0, "unknown")
        .when(n == 1, F.when(age < 72, "sudden").otherwise("unknown"))
        .when((score >= 50) & (mean <= 36) & (F.col("std_gap") <= 24), "persistent")
        .when(score >= 50, F.when(n >= 5, "persistent").otherwise("recurring"))
        .when(n <= 3, F.when(F.col("span_days") <= 2, "sudden").otherwise("intermittent"))
        .otherwise(F.when(mean > 48, "recurring").otherwise("intermittent"))
    )


def patterns(times: DataFrame, key: str, days: int) -> DataFrame:
    """interval_statistics with persistence_score and pattern; keys without a time in the window are absent."""
    rows = interval_statistics(times, key, days).withColumn("persistence_score", persistence_score(days))
    return rows.withColumn("pattern", pattern(F.col("persistence_score")))
