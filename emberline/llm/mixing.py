"""Mixing sources to target weights, by exact subset-sum budgets over document lengths.

A source's size is the number of words of its documents. Sources, in code point order with null last, get the given
weights in turn and share ``share`` times all words; no target exceeds ``limit`` times its source's size, and the
excess is shared again by weight. To meet a target, documents are counted by exact length; each length first gives
documents in proportion, what remains of the budget is filled from the longest lengths down, and the last part by a
bounded knapsack over the lengths left. That part is at least twice the longest document (documents are given back for it if
need be), so that few long documents are combined anew rather than left as the proportion had them. Which documents of a
length are taken follows a seeded hash of doc_id and text.

A document's length is its number of words; null text has none. A source without words has target 0. Rows that
repeat a doc_id count each; a row without doc_id counts as well.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.session import stored

WEIGHTS, SHARE, LIMIT, SEED = (5, 2, 1), 1.5, 2, 17
#: Words of a budget that are left to the knapsack at least, and bytes that its steps may hold. Lengths are divided by what divides them all first; if
#: the steps don't suffice, what is left is filled from the longest length that fits down.
KNAPSACK, KNAPSACK_BYTES = 1 << 13, 64 << 20
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources are filled in the order of limit over weight: one is at its limit if the even level of all that aren't
    before it would lift it above. The windows run over one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    rows = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(limit)))
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("rank", F.row_number().over(by_limit))
    left = F.sum("source_size").over(everyone) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    free = F.col("level") * F.col("weight") <= F.col("most")
    rows = rows.withColumn("at", F.min(F.when(free, F.struct("rank", "level"))).over(everyone))
    target = F.when(F.col("at").isNull() | (F.col("rank") < F.col("at.rank")), F.col("most")).otherwise(F.col("at.level") * F.col("weight"))
    return rows.select("source", "source_size", F.least(target, "most").alias("target"))


def subset_counts(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of the ``counts`` items of each size to take so that their sum is the budget or little less."""
    order = np.argsort(-sizes)
    sizes, counts = sizes[order], counts[order]
    total = int((sizes * counts).sum())
    taken = np.minimum(np.floor(counts * (budget / total)).astype(np.int64), counts) if total else counts * 0
    left = budget - int((taken * sizes).sum())
    while left < 0:  # only by rounding of the proportion
        k = int(np.flatnonzero(taken * sizes)[-1])
        taken[k] -= 1
        left += int(sizes[k])
    room = max(KNAPSACK, 2 * int(sizes.max(initial=0)))
    for k, size in enumerate(sizes.tolist()):
        if size and left > room:
            more = min(int(counts[k] - taken[k]), (left - room) // size)
            taken[k] += more
            left -= more * size
    for k, size in enumerate(sizes.tolist()):
        if size and left < room:
            fewer = min(int(taken[k]), -(-(room - left) // size))
            taken[k] -= fewer
            left += fewer * size
    # Reachable sums as the bits of an integer; each step adds a power of two of one size's items.
    usable = np.flatnonzero((sizes > 0) & (sizes <= left) & (counts > taken)).tolist()
    unit = int(np.gcd.reduce(sizes[usable])) if usable else 1
    most, of = left // unit, {k: int(sizes[k]) // unit for k in usable}
    mask, bits, steps, held = (1 << (most + 1)) - 1, 1, [], 0
    for k in usable:
        spare, piece = int(min(counts[k] - taken[k], left // sizes[k])), 1
        while spare and not bits >> most & 1:
            piece = min(piece, spare)
            grown = (bits | bits << piece * of[k]) & mask
            if grown != bits:
                held += bits.bit_length() // 8
                steps.append((bits, k, piece))
            bits, spare, piece = grown, spare - piece, piece * 2
            if held > KNAPSACK_BYTES:
                break
        if bits >> most & 1 or held > KNAPSACK_BYTES:
            break
    at = bits.bit_length() - 1
    left -= at * unit
    for old, k, piece in reversed(steps):
        if not old >> at & 1:
            taken[k] += piece
            at -= piece * of[k]
    for k in usable:
        more = min(int(counts[k] - taken[k]), left // int(sizes[k]))
        taken[k] += more
        left -= more * int(sizes[k])
    out = np.empty_like(taken)
    out[order] = taken
    return out


def _fit(cells: pd.DataFrame) -> pd.DataFrame:
    sizes, counts = cells["size"].to_numpy(np.int64), cells["n"].to_numpy(np.int64)
    total, budget = int((sizes * counts).sum()), int(cells["target"].iloc[0] + 0.5)
    base = budget // total if total else 0
    extra = subset_counts(sizes, counts, budget - base * total) if total else counts * 0
    return pd.DataFrame({"source": cells["source"], "size": sizes, "n": counts, "base": base, "extra": extra, "source_size": cells["source_size"], "target": cells["target"]})


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: int = SEED, carry: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of ``docs``: copies are 0 to ``limit``.

    ``carry``: columns of ``docs`` that are returned as well."""
    drawn = F.xxhash64(F.lit(seed), "doc_id", "text").alias("drawn")
    each = stored(docs.select("doc_id", F.col("source").cast("string"), n_words().alias("size"), drawn, *carry), "sizes")
    carried = each.columns[4:]
    counts = stored(each.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(totals, weights, share, limit)
    cells = counts.join(goals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    plan = cells.groupBy("source").applyInPandas(
        _fit, "source string, size long, n long, base long, extra long, source_size long, target double"
    )
    plan = stored(plan, "plan").withColumnsRenamed({"source": "_source", "size": "_size"})
    # A length's documents are ranked in salts of near the square root of their number, so that no task ranks them all.
    salts = F.ceil(F.col("n") / F.greatest(F.lit(200.0), F.sqrt("n"))).cast("int")
    placed = stored(
        each.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
        .drop("_source", "_size")
        .withColumn("salt", F.pmod(F.xxhash64("drawn"), salts)),
        "placed",
    )
    part = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    in_salt = placed.filter(part).groupBy("source", "size", "salt").agg(F.count("*").alias("k"))
    before = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = in_salt.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0))).select(
        F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("salt").alias("_salt"), "before"
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("drawn", "doc_id"))
    ranked = placed.filter(part).withColumn("rank", rank).join(
        offset,
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("salt") == F.col("_salt")),
    )
    columns = ["doc_id", "source", "size", "source_size", "target", *carried]
    some = ranked.select(*columns, (F.col("base") + (F.col("before") + F.col("rank") <= F.col("extra")).cast("long")).alias("copies"))
    rest = placed.filter(~part).select(*columns, (F.col("base") + (F.col("extra") > 0).cast("long")).alias("copies"))
    return some.unionByName(rest)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs``, each row as often as the mix takes it. Rows that agree in every column share what they are taken for, so it
    makes no difference which of them stands in the result. Columns of ``docs`` can't be maps."""
    # two hashes of the whole row name it; equal rows meet again under them, other rows of a doc_id don't
    names = [F.xxhash64(F.lit(k), *[F.col(f"`{c}`") for c in docs.columns]).alias(f"_row_{k}") for k in (1, 2)]
    keys = [f"_row_{k}" for k in (1, 2)]
    copies = mix(docs, carry=tuple(names), **how).groupBy(*keys).agg(F.sum("copies").cast("int").alias("_copies")).filter("_copies > 0")
    rows = docs.select(*names, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).groupBy(*keys).agg(F.first("_row").alias("_row"))
    taken = rows.join(copies, keys).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return taken.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
