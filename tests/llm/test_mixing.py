import random

import numpy as np
from pyspark.sql import functions as F

from emberline.llm.mixing import mix, mixed_documents, subset_counts, targets


def filled(sizes, weights=(5, 2, 1), share=1.5, limit=2):
    """Shares the excess again until no target is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = {}
    while True:
        left, free = share * sum(sizes.values()) - sum(capped.values()), [s for s in names if s not in capped]
        total = sum(weight[s] for s in free)
        goal = {s: left * weight[s] / total for s in free}
        over = {s: limit * sizes[s] for s in free if goal[s] > limit * sizes[s]}
        if not over:
            return {**capped, **goal}
        capped.update(over)


def test_targets(spark):
    rng = random.Random(1)
    for n in (1, 2, 5, 23):
        sizes = {f"s{i}": rng.choice([0, rng.randint(1, 2000)]) for i in range(n)} | {None: 40}
        rows = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = filled(sizes)
        assert len(rows) == len(sizes)
        for r in rows:
            assert abs(r.target - want[r.source]) < 1e-6


def test_subset_counts():
    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = np.unique(rng.integers(0, 60, rng.integers(1, 12)))
        counts = rng.integers(1, 6, len(sizes))
        total = int((sizes * counts).sum())
        budget = int(rng.integers(0, total + 1))
        sums = {0}
        for s, c in zip(sizes.tolist(), counts.tolist()):
            sums = {x + s * k for x in sums for k in range(c + 1)}
        taken = subset_counts(sizes, counts, budget)
        got = int((taken * sizes).sum())
        assert (taken >= 0).all() and (taken <= counts).all() and got <= budget
        best = max(x for x in sums if x <= budget)
        assert best - got <= 60


def test_few_long_documents():
    """The proportion alone would leave a sixth of the budget."""
    sizes, counts = np.array([20000, 30000]), np.array([3, 2])
    for budget in (0, 20000, 50000, 60000, 80000, 120000):
        assert int((subset_counts(sizes, counts, budget) * sizes).sum()) == budget


def test_mixed_rows_of_one_id(spark):
    """Rows of a doc_id aren't taken by the largest of their copies."""
    rows = [(i // 4, " ".join(["w"] * (1 + i % 90)), "abc"[i % 3], i, 0) for i in range(400)] + [(1, "same row", "a", 1, 0)] * 9 + [(None, "no id", "b", k % 2, 0) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int, _copies int")
    goal = {r.source: r.target for r in mix(docs).collect()}
    got = mixed_documents(docs)
    assert got.columns == docs.columns
    for source, target in goal.items():
        assert abs(sum(len(r.text.split()) for r in got.filter(F.col("source") == source).collect()) - target) <= 1
    assert {tuple(r) for r in got.collect()} <= set(rows)


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, rng.randint(1, 300)])), rng.choice(["a", "b", "c", None, "a", "a"]), 7) for i in range(900)]
    rows += [(None, "x y", "a", 7), (5000, None, "d", 7)] + [(6000 + i, "same text here", "b", 7) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mix(docs).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mix(docs.repartition(7)).collect()))
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        assert sum(r["size"] for r in mine) == mine[0].source_size
        taken = sum(r["size"] * r.copies for r in mine)
        assert all(0 <= r.copies <= 2 for r in mine)
        assert abs(taken - mine[0].target) <= 1
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.filter("doc_id is not null").count() == sum(r.copies for r in got if r.doc_id is not None)
    assert mix(docs.filter("doc_id < 0")).count() == 0


def test_long_documents_beyond_the_knapsack(monkeypatch):
    """Many long lengths: by their common divisor the sums fit; where they don't, little more than the shortest document is missed."""
    rng = np.random.default_rng(3)
    sizes = np.unique(rng.integers(5_000, 10_000, 300)) * 1000
    counts = rng.integers(1, 3, len(sizes))
    budget = int((sizes * counts).sum() * 0.43)
    taken = subset_counts(sizes, counts, budget)
    assert (taken <= counts).all() and 0 <= budget - int((sizes * taken).sum()) < 1000
    odd = sizes + rng.integers(0, 1000, len(sizes))
    monkeypatch.setattr("emberline.llm.mixing.KNAPSACK_BYTES", 1 << 12)
    budget = int((odd * counts).sum() * 0.43)
    taken = subset_counts(odd, counts, budget)
    assert (taken <= counts).all() and 0 <= budget - int((odd * taken).sum()) < int(odd.min())


def test_rows_without_doc_id_spread(spark):
    """Their draw depends on the text as well, so that no salt holds all of them."""
    rows = spark.range(4000).selectExpr("cast(null as long) as doc_id", "concat('w', id, ' x') as text", "'s' as source")
    copies = mix(rows, share=0.5).collect()
    assert sum(r.copies for r in copies) == 2000 and len({r.size for r in copies}) == 1
    assert rows.select(F.xxhash64(F.lit(17), "doc_id", "text")).distinct().count() == 4000
