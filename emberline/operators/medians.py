"""Exact medians of many columns, without a task that holds a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How far around the middle, in shares of the ranks, values are looked at one by one.
AROUND = 0.002


def medians(rows: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The median of each numeric or boolean column's known values, the mean of the middle two if they are even in number; None without any.

    A sketch brackets the middle; only the values within the bracket, counted by value, are ranked, column by column.
    """
    if not columns:
        return {}
    x = rows.select(*[F.col(c).cast("double").alias(c) for c in columns])
    ends = F.array(F.lit(0.5 - AROUND), F.lit(0.5 + AROUND))
    first = x.agg(*[F.struct(F.count(c).alias("n"), F.percentile_approx(c, ends, F.lit(int(4 / AROUND))).alias("ends")).alias(c) for c in columns]).first()
    known = [c for c in columns if first[c].n]
    if not known:
        return dict.fromkeys(columns)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v"), (F.col(c) < first[c].ends[0]).alias("below"), (F.col(c) > first[c].ends[1]).alias("above")) for c in known])).alias("e")
    rows = x.select(each).select("e.*").filter("v is not null and not above")
    counts = rows.groupBy("name", F.when(~F.col("below"), F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("name").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    total = F.create_map(*[F.lit(x) for c in known for x in (c, int(first[c].n))])[F.col("name")]
    ranked = counts.withColumn("upto", upto).withColumn("total", total)
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    holds = lambda k: (F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)
    middle = ranked.groupBy("name").agg(((F.max(F.when(holds(low), F.col("v"))) + F.max(F.when(holds(high), F.col("v")))) / 2).alias("m"))
    return dict.fromkeys(columns) | {r.name: r.m for r in middle.collect()}
