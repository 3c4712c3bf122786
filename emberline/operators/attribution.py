"""What each feature adds to a model's probabilities for a row, by sampled orders of the features.

Along an order the row's features replace a background row's one after the other; what the mean probability over the background changes by
at a feature's turn is its contribution. Each order is taken together with its reverse, which makes pairs of features that act
together come out exactly. Whatever the orders, a row's contributions add up to its probability less the background's mean.

All evaluations are rows of one job: rows to explain times orders times steps times background rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The most background rows: they are joined to every step.
BACKGROUND = 64


def background(rows: DataFrame, n: int = 8, seed: int = 42) -> DataFrame:
    """(inputs) of ``n`` rows (event_id, inputs), those that a seeded hash puts first."""
    if not 0 < n <= BACKGROUND:
        raise ValueError(f"between 1 and {BACKGROUND} background rows")
    return rows.orderBy(F.xxhash64(F.lit(seed), "event_id"), "event_id").limit(n).select("inputs")


def contributions(rows: DataFrame, model, against: DataFrame, features: list[str], labels: list[str], pairs: int = 1, seed: int = 42) -> DataFrame:
    """(event_id, label, feature, contribution, base, probability) for each row (event_id, inputs; two inputs a feature), label and feature. ``model.predicted`` adds
    ``probabilities`` in the order of ``labels``; ``against``: background rows (inputs), at most BACKGROUND. ``pairs``: orders drawn for each row, reversed
    ones beside them. ``base``: the background's mean probability."""
    n = len(features)
    drawn = rows.select("event_id", "inputs").withColumn("pair", F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))))
    order = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda f: F.struct(F.xxhash64(F.lit(seed), F.col("event_id"), F.col("pair"), f).alias("h"), f.alias("f")))), lambda x: x["f"])
    both = drawn.withColumn("forth", order).withColumn("orders", F.array("forth", F.reverse("forth"))).select("event_id", "inputs", "pair", F.posexplode("orders").alias("back", "order"))
    # the place of each feature in the order, from 1
    place = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda f: F.array_position("order", f))
    steps = both.withColumn("place", place).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n))))
    given = steps.crossJoin(F.broadcast(against.limit(BACKGROUND).select(F.col("inputs").alias("other"))))  # at most BACKGROUND rows
    two = F.arrays_zip(F.col("inputs"), F.col("other"), F.sequence(F.lit(0), F.lit(2 * n - 1)).alias("i"))
    mixed = F.transform(two, lambda z: F.when(F.element_at("place", (z["i"] / 2).cast("int") + 1) <= F.col("step"), z["inputs"]).otherwise(z["other"]))
    said = model.predicted(given.select("event_id", "pair", "back", "order", "step", mixed.alias("inputs")))
    means = said.groupBy("event_id", "pair", "back", "order", "step").agg(F.array(*[F.avg(F.get("probabilities", F.lit(k))) for k in range(len(labels))]).alias("p"))
    along = Window.partitionBy("event_id", "pair", "back").orderBy("step")
    gained = means.withColumn("before", F.lag("p").over(along)).filter("step > 0")
    each = gained.select("event_id", F.element_at("order", F.col("step")).alias("f"), F.zip_with("p", "before", lambda a, b: a - b).alias("d"))
    per = each.groupBy("event_id", "f").agg(F.array(*[F.avg(F.get("d", F.lit(k))) for k in range(len(labels))]).alias("d"))
    ends = means.filter(F.col("step").isin(0, n)).groupBy("event_id").agg(F.first(F.when(F.col("step") == 0, F.col("p")), ignorenulls=True).alias("base"), F.first(F.when(F.col("step") == n, F.col("p")), ignorenulls=True).alias("at"))
    named = F.posexplode(F.array(*map(F.lit, labels))).alias("k", "label")
    rows = per.join(ends, "event_id").select("event_id", "f", "d", "base", "at", named)
    at = lambda c: F.get(c, F.col("k"))
    return rows.select("event_id", "label", F.element_at(F.array(*map(F.lit, features)), F.col("f") + 1).alias("feature"), at("d").alias("contribution"), at("base").alias("base"), at("at").alias("probability"))
