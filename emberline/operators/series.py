"""Counts in time buckets, with empty buckets filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def buckets(rows: DataFrame, starts: list[int], width_us: int, us: str, aggregates: list[Column]) -> DataFrame:
    """(bucket, start_us, aggregates...) for each start, in order: rows with start <= us < start + width.

    Starts are ``width_us`` apart, so a row's bucket is one division, and the aggregation is one shuffle of counts.
    Aggregates of a bucket without rows are 0.
    """
    spark = rows.sparkSession
    first = starts[0]
    place = F.floor((F.col(us) - F.lit(first)) / F.lit(width_us)).cast("int")
    counted = rows.withColumn("bucket", place).filter(F.col("bucket").between(0, len(starts) - 1)).groupBy("bucket").agg(*aggregates)
    calendar = spark.createDataFrame(list(enumerate(starts)), "bucket int, start_us long")
    names = [c for c in counted.columns if c != "bucket"]
    filled = F.broadcast(calendar).join(counted, "bucket", "left")
    return filled.select("bucket", "start_us", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def over_domain(rows: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """(value, place, n): the count of each value of a fixed domain, in its order, 0 where it doesn't occur."""
    wanted = rows.sparkSession.createDataFrame(list(enumerate(domain)), f"place int, {column} string")
    return F.broadcast(wanted).join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, "place", F.coalesce("n", F.lit(0)).alias("n"))


def days_before(now_us: int, days: int) -> list[int]:
    """Midnights of ``days`` days up to today's."""
    today = now_us // DAY_US * DAY_US
    return [today - k * DAY_US for k in range(days - 1, -1, -1)]


def rolling(now_us: int, periods: int, days: int, last: int = 0) -> list[int]:
    """Starts now - days * i, for i from periods - 1 + last to last. With last 0 the last bucket lies ahead of now."""
    return [now_us - days * DAY_US * i for i in range(periods - 1 + last, last - 1, -1)]


MINUTE_US = 60_000_000


def sums_before(marks: DataFrame, us: str, weight: str) -> DataFrame:
    """(us, before): for each time that occurs, the sum of ``weight`` over all rows with an earlier time; null times are left out.

    Rows of one time are added up first. Running sums go over the times of a minute, the minutes of a day and the days, so no
    task holds more than the distinct times of a minute, however many rows a day has.
    """
    per = marks.filter(F.col(us).isNotNull()).groupBy(us).agg(F.sum(weight).alias("n"))
    per = per.withColumn("minute", F.floor(F.col(us) / F.lit(MINUTE_US)))
    minutes = per.groupBy("minute").agg(F.sum("n").alias("n")).withColumn("day", F.floor(F.col("minute") / F.lit(1440)))
    days = minutes.groupBy("day").agg(F.sum("n").alias("n"))

    def running(by: str | None, order: str) -> Column:
        w = Window.partitionBy(by).orderBy(order) if by else Window.orderBy(order)  # without a key only for the days
        return F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    days = days.select("day", running(None, "day").alias("days_sum"))
    minutes = minutes.select("minute", "day", running("day", "minute").alias("minutes_sum")).join(days, "day")
    per = per.select(us, "minute", running("minute", us).alias("times_sum"))
    return per.join(minutes, "minute").select(us, (F.col("days_sum") + F.col("minutes_sum") + F.col("times_sum")).alias("before"))
