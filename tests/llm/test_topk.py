import math
import random

from emberline.llm import topk


def brute(rows, queries, k):
    known = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            known.setdefault(i, []).append([math.floor(256 * x) for x in v])
    out = []
    for q in sorted(known):
        if queries(q):
            scored = [(-sum(a * b for a, b in zip(known[q][0], v)), i) for i, vs in known.items() if i != q for v in vs if len(v) == len(known[q][0])]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def test_top_k(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.5]) for _ in range(40)]) for i in range(700)]
    rows += [(800 + i, rows[3][1]) for i in range(9)]  # ties
    rows += [(900, None), (901, [None] * 40), (902, [float("nan")] * 40), (903, [float("inf")] + [0.0] * 39), (None, [1.0] * 40)]
    rows += [(950, [1.0, 2.0]), (1000, [2.0, 1.0]), (1050, []), (1001, [])]
    for wave in (1 << 22, 4000):
        monkeypatch.setattr(topk, "WAVE_BYTES", wave)
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
        got = topk.top_k(frame, frame.filter("vec_id % 50 = 0"), 5).collect()
        assert sorted(tuple(r) for r in got) == sorted(brute(rows, lambda q: q % 50 == 0, 5))


def test_large_components_and_few_rows(spark):
    rows = [(i, [1e6 * (i + 1), -3e5, 2.0]) for i in range(4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(frame, frame.filter("vec_id = 0"), 5).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(rows, lambda q: q == 0, 5))
    assert topk.top_k(frame, frame.filter("vec_id > 9"), 5).count() == 0


def test_repeated_query_rows(spark):
    """Of a vec_id's rows one asks, whatever the order of the rows, and one that can."""
    rows = [(50, [1.0, 0.0]), (50, [None, 1.0]), (50, [0.0, 2.0]), (50, None), (1, [3.0, 1.0]), (2, [1.0, 4.0]), (3, [-1.0, float("inf")]), (4, [0.5, 0.25])]
    answers = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        frame = spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(4)
        answers.add(tuple(sorted(tuple(r) for r in topk.top_k(frame, frame.filter("vec_id = 50"), 5).collect())))
    (got,) = answers
    score = lambda q: sorted(((-sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(q, v)), i) for i, v in ((1, [3.0, 1.0]), (2, [1.0, 4.0]), (4, [0.5, 0.25]))))
    assert got in {tuple((50, k + 1, i, -s) for k, (s, i) in enumerate(score(q))) for q in ([1.0, 0.0], [0.0, 2.0])}
