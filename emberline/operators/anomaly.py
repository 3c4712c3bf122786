"""How far events are from reviewed normal ones: an isolation forest, and the Mahalanobis distance.

Both learn from the normal events of the training split alone, at least LEAST of them, with medians in place of what is missing.
Scores are deviations, not probabilities: above 0 an event is odder than what the model takes for normal.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.medians import medians

#: The fewest reviewed normal events; trees; rows that a tree sees at most; the share of normal events beyond the distance's 0.
LEAST, TREES, SAMPLE, TAIL, SEED = 30, 100, 256, 0.05, 42
_NODES = "tree long, nodes array<struct<feature:int, threshold:double, low:int, high:int, depth:double>>"


def average_path(n: float) -> float:
    """The expected depth at which a search tree of ``n`` rows ends."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, seed: int) -> list[tuple[int, float, int, int, float]]:
    """An isolation tree's nodes (feature or -1, threshold, node of rows up to it, node of rows beyond it, depth of the rows that end here).

    A node splits a feature that isn't constant in it, at a place between its ends, both drawn evenly, down to the binary logarithm of the rows.
    """
    rng = np.random.default_rng(seed)
    most = math.ceil(math.log2(max(len(x), 2)))
    nodes, open_ = [None], [(0, np.arange(len(x)), 0)]
    while open_:
        at, rows, depth = open_.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        ready = np.flatnonzero(high > low)
        if depth == most or len(rows) <= 1 or not len(ready):
            nodes[at] = (-1, 0.0, 0, 0, depth + average_path(len(rows)))
            continue
        f = int(rng.choice(ready))
        cut = float(rng.uniform(low[f], high[f]))
        below = x[rows, f] <= cut
        nodes[at] = (f, cut, len(nodes), len(nodes) + 1, 0.0)
        nodes += [None, None]
        open_ += [(nodes[at][2], rows[below], depth + 1), (nodes[at][3], rows[~below], depth + 1)]
    return nodes


def filled(features: list[str], known: dict[str, float]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float(known[c]))) for c in features])


def checked(normal: DataFrame, features: list[str]) -> int:
    """How many distinct normal events there are; an error if too few, or nothing to learn from."""
    n = normal.select("event_id").distinct().count()
    if n < LEAST:
        raise ValueError(f"{n} reviewed normal events in the training split; {LEAST} are needed")
    if not features:
        raise ValueError("no features")
    return n


@dataclass
class Forest:
    features: list[str]
    known: dict[str, float]
    trees: list[list[tuple[int, float, int, int, float]]]
    sample: int

    def score(self) -> Column:
        """2 to the power of minus the mean depth over its expectation, minus a half: one expression that walks all trees."""
        text = json.dumps([[dict(zip(("feature", "threshold", "low", "high", "depth"), node, strict=True)) for node in tree] for tree in self.trees])
        forest = F.from_json(F.lit(text), "array<array<struct<feature:int, threshold:double, low:int, high:int, depth:double>>>")
        levels = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(max(self.sample, 2)))))
        x = filled(self.features, self.known)

        def depth(tree: Column) -> Column:
            def down(at: Column, _: Column) -> Column:
                node = F.get(tree, at)
                return F.when(node["feature"] < 0, at).when(F.get(x, node["feature"]) <= node["threshold"], node["low"]).otherwise(node["high"])

            return F.get(tree, F.aggregate(levels, F.lit(0), down))["depth"]

        total = F.aggregate(F.transform(forest, depth), F.lit(0.0), lambda a, b: a + b)
        return F.pow(F.lit(2.0), -total / (len(self.trees) * average_path(self.sample))) - 0.5


def isolation_forest(normal: DataFrame, features: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """From ``normal`` (event_id, features...): each tree sees ``sample`` events (or all, if fewer), those that its own seeded hash puts first.

    An event goes to about twice as many trees' candidates as are taken, so what is ranked doesn't grow with the table; trees are grown in parallel, and
    come back to the driver: at most ``trees`` times 2 * ``sample`` nodes.
    """
    n = checked(normal, features)
    rows = normal.dropDuplicates(["event_id"])
    known = medians(rows, features)
    sample = min(sample, n)
    share = min(1.0, 2.0 * sample / n)
    x = rows.select("event_id", filled(features, known).alias("x"))
    drawn = x.withColumn("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long"))))
    drawn = drawn.withColumn("h", F.xxhash64(F.lit(seed), "tree", "event_id")).filter(F.pmod("h", F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    first = drawn.withColumn("k", F.row_number().over(Window.partitionBy("tree").orderBy("h", "event_id"))).filter(F.col("k") <= sample)

    def run(tree, frame):
        import pandas as pd

        ordered = frame.sort_values("k")
        nodes = grow(np.stack(ordered["x"].to_numpy()), seed * 1_000_003 + int(tree[0]))
        return pd.DataFrame({"tree": [tree[0]], "nodes": [[dict(zip(("feature", "threshold", "low", "high", "depth"), node, strict=True)) for node in nodes]]})

    grown = first.groupBy("tree").applyInPandas(run, _NODES).orderBy("tree").collect()
    return Forest(list(features), known, [[tuple(node) for node in r.nodes] for r in grown], sample)


@dataclass
class Ellipsoid:
    features: list[str]
    known: dict[str, float]
    mean: list[float]
    whiten: list[list[float]]
    edge: float

    def distance(self) -> Column:
        off = F.zip_with(filled(self.features, self.known), F.array(*map(F.lit, self.mean)), lambda a, m: a - m)
        rows = F.from_json(F.lit(json.dumps(self.whiten)), "array<array<double>>")
        parts = F.transform(rows, lambda row: F.aggregate(F.zip_with(row, off, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
        return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b * b))

    def score(self) -> Column:
        return self.distance() - F.lit(self.edge)


def ellipsoid(normal: DataFrame, features: list[str]) -> Ellipsoid:
    """Mahalanobis distances from the mean of ``normal`` (event_id, features...), less the distance that TAIL of them exceed (to a thousandth of the ranks).

    Features that don't vary take no part. Of features that follow from others the pseudo-inverse keeps one direction.
    """
    checked(normal, features)
    rows = normal.dropDuplicates(["event_id"])
    known = medians(rows, features)
    x = rows.select(array_to_vector(filled(features, known)).alias("x"))
    mean, variance = (v.toArray() for v in x.select(Summarizer.mean(F.col("x")).alias("m"), Summarizer.variance(F.col("x")).alias("v")).first())
    scale = np.sqrt(np.nan_to_num(variance))
    between = np.nan_to_num(Correlation.corr(x, "x").first()[0].toArray()) if len(features) > 1 else np.ones((1, 1))
    np.fill_diagonal(between, (scale > 0).astype(float))
    between[scale == 0, :] = 0
    between[:, scale == 0] = 0
    values, axes = np.linalg.eigh(between)
    good = values > 1e-9
    whiten = (axes[:, good] / np.sqrt(values[good])).T / np.where(scale > 0, scale, 1.0)
    found = Ellipsoid(list(features), known, mean.tolist(), whiten.tolist(), 0.0)
    found.edge = float(rows.agg(F.percentile_approx(found.distance(), F.lit(1 - TAIL), F.lit(1000))).first()[0])
    return found
