import random
import re

import numpy as np
from emberline.llm import fm_decontam
from emberline.llm.fm_decontam import FMIndex, WaveletMatrix, cleaned, contamination, suffix_array

SPLIT = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    phrases = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 10, 0) + 1 if w and item is not None else 0):
            phrases.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = {}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in phrases:
                    hit.update(range(i, i + n))
                    found |= phrases[tuple(w[i : i + n])]
        out[doc_id] = (len(w), sorted(hit), sorted(found))
    return out


def corpus(seed, short):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "日本", "9"]
    items = [(i * 5, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 40)))) for i in range(20)]
    items += [(7, items[0][1]), (8, None), (9, "!!"), (None, items[1][1])]
    items += [(100, "w1 w2"), (101, "W3"), (102, "w4 w5 w6 w7 w8")] if short else []
    docs = [(-1, None), (-2, ""), (-3, "...")]
    for i in range(80):
        parts = []
        for _ in range(rng.randint(0, 6)):
            w = items[rng.randrange(20)][1].split()
            a = rng.randrange(len(w))
            parts.append(", ".join(w[a : a + rng.randint(1, 30)]).upper() if rng.random() < 0.5 else " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))))
        docs.append((i, "; ".join(parts)))
    return docs + [(200 + i, docs[10][1]) for i in range(30)], items


def test_contamination(spark, monkeypatch):
    for seed, short, portion in ((1, False, 200_000), (2, True, 200_000), (3, True, 100)):
        monkeypatch.setattr(fm_decontam, "PORTION_WORDS", portion)
        docs, items = corpus(seed, short)
        frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, hits int").repartition(3)
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = {r.doc_id: r for r in contamination(frame, bench).collect()}
        want = brute(docs, items)
        assert got.keys() == want.keys()
        for doc_id, (n, hit, found) in want.items():
            r = got[doc_id]
            assert (r.n_words, r["items"]) == (n, found)
            assert [x for s in r.hits for x in range(s.start, s.stop)] == hit
            assert all(a.stop < b.start for a, b in zip(r.hits, r.hits[1:]))


def test_cleaned(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    rows = [(1, "so A b, c d e f g h i j k! then", "en"), (2, "a b c", None), (None, None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    got = cleaned(frame, bench)
    assert got.columns == frame.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "so ! then", 2: "a b c", None: None}
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted(map(str, cleaned(frame, none).collect())) == sorted(map(str, frame.collect()))
    assert contamination(frame.limit(0), bench).count() == 0


def test_index():
    rng = np.random.default_rng(1)
    for alphabet, n in ((2, 300), (50, 500), (1, 40)):
        text = rng.integers(1, alphabet + 1, n)
        padded = np.append(text, 0)
        assert suffix_array(padded).tolist() == sorted(range(n + 1), key=lambda i: padded[i:].tolist())
        index = FMIndex(text)
        for length in (1, 2, 5):
            phrases = np.array([text[i : i + length] for i in range(0, n - length, 7)])
            lo, hi = index.search(phrases, np.full(len(phrases), length))
            for k, p in enumerate(phrases):
                places = sorted(index.locate(np.arange(lo[k], hi[k])).tolist())
                assert places == [i for i in range(n - length + 1) if (text[i : i + length] == p).all()]
    values = rng.integers(0, 13, 200)
    tree = WaveletMatrix(values, 4)
    at = np.arange(200)
    value, before = tree.value(at)
    assert (value == values).all() and before.tolist() == [(values[:i] == values[i]).sum() for i in at]
