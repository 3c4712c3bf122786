"""Connected components of an edge list, by repeated contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.session import discard, stored

#: So few edges are left to one task. More are contracted in Spark until no more are left than this.
FINISH = 1 << 14


def _simple(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _halved(edges: DataFrame, seed: int) -> DataFrame:
    """(id, to) for every vertex: a vertex that stands for several, at least two, that are connected.

    Each vertex points to the neighbour that a hash seeded anew puts first. Such pointers have cycles of two vertices only (going
    round a longer one, every second vertex would have to come before itself), whose smaller one becomes a root. Paths of pointers
    follow falling hashes, so they are short; each is followed up to two steps.
    """
    ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = ends.groupBy("a").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "b").alias("h"), "b")).alias("first"))
    link = stored(first.select(F.col("a").alias("id"), F.col("first.b").alias("to")), "links")
    onward = link.select(F.col("id").alias("to"), F.col("to").alias("next"))
    root = (F.col("next") == F.col("id")) & (F.col("id") < F.col("to"))
    parent = link.join(onward, "to").select("id", F.when(root, F.col("id")).otherwise(F.col("to")).alias("to"))
    onward = parent.select(F.col("id").alias("to"), F.col("to").alias("next"))
    out = stored(parent.join(onward, "to").select("id", F.col("next").alias("to")), "roots")
    discard(link)
    return out


def _finished(edges: DataFrame) -> DataFrame:
    """(id, to): the smallest vertex reachable, for at most FINISH edges in one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches):
        held = [batch for batch in batches if len(batch)]
        if not held:
            return
        ends = [np.concatenate([batch.column(k).to_numpy(zero_copy_only=False) for batch in held]) for k in (0, 1)]
        names, number = np.unique(np.concatenate(ends), return_inverse=True)
        a, b = np.split(number, 2)
        root, old = np.arange(len(names)), None
        while old is None or (root != old).any():
            old = root
            low, root = np.minimum(old[a], old[b]), old.copy()
            for end in (old[a], old[b]):
                np.minimum.at(root, end, low)
            while (root[root] != root).any():
                root = root[root]
        kind = held[0].schema.field(0).type
        yield pa.record_batch([pa.array(names).cast(kind), pa.array(names[root]).cast(kind)], names=["id", "to"])

    return edges.coalesce(1).mapInArrow(run, f"id {kind}, to {kind}")


def components(edges: DataFrame, left: str = "a", right: str = "b", finish: int = FINISH, rounds: list[int] | None = None) -> DataFrame:
    """(id, component): the smallest id reachable from each end of an edge.

    A round at least halves the vertices of each component (about a quarter is left on a path, one of a star), so their number
    is logarithmic whatever the shape and the order of the ids. What is left under ``finish`` edges goes to one task. Hubs
    are safe: minima are pre-aggregated, and the joins are plain equi-joins, which adaptive execution splits.
    Edges with a null end and loops are ignored, so a vertex that has no other edge doesn't appear. ``rounds`` takes the number of
    edges at the start of each round.
    """
    edges = stored(_simple(edges.select(F.col(left).alias("a"), F.col(right).alias("b"))), "edges")
    left_, labels, seed = edges.count(), None, 0
    while left_:
        if rounds is not None:
            rounds.append(left_)
        last = left_ <= finish
        step = stored(_finished(edges), "roots") if last else _halved(edges, seed)
        seed += 1
        if labels is None:
            grown = step.withColumnRenamed("to", "at")
        else:
            grown = labels.join(step.withColumnRenamed("id", "at"), "at", "left").select("id", F.coalesce("to", "at").alias("at"))
        done, labels = labels, stored(grown, "labels")
        if last:
            discard(edges, step, done)
            break
        moved = edges
        for end in ("a", "b"):
            moved = moved.join(step.withColumnRenamed("id", end), end).drop(end).withColumnRenamed("to", end)
        moved = stored(_simple(moved), "edges")
        discard(edges, step, done)
        edges = moved
        left_ = edges.count()
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = labels.groupBy("at").agg(F.min("id").alias("component"))
    return labels.join(least, "at").select("id", "component")
