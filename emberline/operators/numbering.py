"""Running totals and consecutive numbers over a whole order, without one task that sees it all.

Rows are dealt into ranges of the order. Each range adds up its own rows; the totals of the ranges before it, one row a range, are
added to that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.session import stored


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """``rows`` with, for each name, the sum of its column over the rows up to and with this one, within rows of equal ``by`` (not null). Rows that
    are equal in ``order`` come in any order and lie in one range, so it should tell rows apart."""
    by = list(by)
    named = rows.withColumns({f"_{name}": c for name, c in sums.items()})
    placed = stored(named.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    whole = placed.groupBy(*by, "_range").agg(*[F.sum(f"_{name}").alias(f"_{name}") for name in sums])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = whole.select(*by, "_range", *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in sums])
    own = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = placed.withColumns({f"_{name}": F.sum(f"_{name}").over(own) for name in sums}).join(before, [*by, "_range"])
    return within.select(*rows.columns, *[(F.col(f"_{name}") + F.col(f"_before_{name}")).alias(name) for name in sums])


def numbered(rows: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """``rows`` with consecutive numbers from 1 in ``order``."""
    return running(rows, order, {name: F.lit(1).cast("long")})
