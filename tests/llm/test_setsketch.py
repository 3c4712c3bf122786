import random
import re
from itertools import combinations

import numpy as np
from emberline.llm import setsketch
from emberline.llm.setsketch import Sketch, likely_similarity, near_duplicates, registers


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(docs, k):
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus(seed):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(900)]
    docs = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(1, 150))]
        docs.append((i * 7, " ".join(base)))
        for j in range(rng.choice([0, 0, 1, 3, 12])):
            near = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                near[rng.randrange(len(near))] = rng.choice(words)
            docs.append((1000 + 20 * i + j, " ".join(near).upper() if j % 2 else "\t".join(near)))
    docs += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one two"), (5004, "One  TWO"), (5005, "two one")]
    # a chain: neighbours are similar, the ends aren't
    chain = [rng.choice(words) for _ in range(200)]
    docs += [(6000 + i, " ".join(chain[6 * i : 6 * i + 120])) for i in range(12)]
    return docs


def test_components(spark, monkeypatch):
    for seed, block in ((1, 256), (2, 4)):
        monkeypatch.setattr(setsketch, "BLOCK", block)
        docs = corpus(seed)
        frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame, Sketch(shingle=4)).collect()}
        assert got == brute(docs, 4)


def test_odd_rows(spark):
    frame = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    rows = near_duplicates(frame).collect()
    assert len(rows) == 4 and all(r.kept for r in rows)
    assert near_duplicates(frame.filter("doc_id = 9")).count() == 0


def test_texts_of_one_id(spark):
    """A doc_id with several texts is one document: what links one text links all."""
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(5, a), (5, b), (7, a + " z"), (9, b + " z"), (11, "c d e f g h"), (3, b)]
    got = {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 3), (5, 3), (7, 3), (9, 3), (11, 11)}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(5)
    sketch = Sketch(bands=64)
    f = sketch.functions()
    x, y = rng.integers(0, 1 << 63, 3000, dtype=np.uint64), rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    a, b = registers(x, sketch, *f), registers(np.concatenate((x[:2500], y)), sketch, *f)
    assert (np.maximum(a, b) == registers(np.concatenate((x, y)), sketch, *f)).all()
    s = likely_similarity(np.array([3000]), np.array([3500]), np.array([(a > b).sum()]), np.array([(a < b).sum()]), sketch)[0]
    assert abs(s - 2500 / 4000) < 0.1
