"""Spelling variants against plain Python: every pair of words compared, every chain followed."""

import random
import re
import zlib

import numpy as np
import pytest
from emberline.llm import queries, spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(n, ratio=5):
    """(word, form, root, n, n_near, form_n) by comparing every two words."""
    found = {w: sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: xs[0] if xs and n[xs[0]] >= ratio * n[w] else None for w, xs in found.items()}
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(found[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def plain_counts(docs, min_length=6, min_count=5, drop_every=None):
    n = {}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if drop_every and h % drop_every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= min_length:
                n[run] = n.get(run, 0) + 1
    return {w: k for w, k in n.items() if k >= min_count}


def random_docs(seed=4, n=300):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abeéÿ×") for _ in range(rng.randint(5, 9))) for _ in range(40)]

    def word():
        w = rng.choice(stems)
        k = rng.randrange(len(w) + 1)
        kind = rng.random()
        return w if kind < 0.6 else w[:k] + rng.choice("abz") + w[k:] if kind < 0.75 else w[:k] + w[k + 1 :] if kind < 0.9 else w[:k] + "É" + w[k + 1 :]

    docs = [(k, " ".join(word() + rng.choice(["", "", ".", "1"]) for _ in range(rng.randint(0, 80)))) for k in range(n)]
    long = "xy" * 700
    return docs + [(None, "abcdef ABCDEF abcdef"), (n, None), (n + 1, ""), (n + 1, "abcdef " * 9), (n + 2, f"{long} {long}z " * 6), (n + 3, f"{long}z " * 40)]


def plain(rows):
    return sorted(tuple(r) for r in rows)


@pytest.mark.parametrize(("part_words", "letters"), [(4096, 1 << 20), (3, 1 << 20), (40, 300)])
def test_variants(spark, monkeypatch, part_words, letters):
    monkeypatch.setattr(spelling, "CHUNK_LETTERS", letters)
    n = plain_counts(random_docs(), drop_every=7)
    words = spark.createDataFrame([(w, k) for w, k in n.items()], "word string, n long").repartition(3)
    assert plain(spelling.variants(words, part_words=part_words).collect()) == plain_variants(n)


def test_one_family_of_words(spark):
    """All words share all but one letter with very many: parts are split down to one place, and chains have several links."""
    words = {"a" * k + b + "a" * (11 - k): 1 + 7 ** (ord(b) % 4) + k for k in range(12) for b in "bcdefghijkäö"} | {"a" * 12: 5000, "a" * 11: 40, "a" * 13: 900}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert plain(spelling.variants(df, part_words=4).collect()) == plain_variants(words)


def test_counts_and_planted_misspellings(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in random_docs()], "doc_id long, text string, word string").repartition(3)
    for every in (None, 7, 199):
        got = {r.word: r.n for r in spelling.word_counts(docs, drop_every=every).collect()}
        assert got == plain_counts(random_docs(), drop_every=every)


def test_crc32s():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    starts = rng.integers(0, 2000, 200)
    ends = starts + rng.integers(0, 300, 200)
    before = np.array([zlib.crc32(b"%d:" % k) for k in range(200)], np.uint32)
    want = [zlib.crc32(b"%d:" % k + data[a:b].tobytes()) for k, (a, b) in enumerate(zip(starts, ends, strict=True))]
    assert spelling.crc32s(data, starts, ends, before).tolist() == want


def test_acceptor_is_minimal():
    """Words of equal endings share states: 4 x 3 words of one shape need a state a letter, and the final one."""
    words = sorted(a + b for a in ("kaba", "kabe", "kabi", "kabo") for b in ("end", "ent", "est"))
    codes = np.array([[ord(c) for c in w] for w in words], np.uint32)
    found = spelling.Acceptor(codes, np.full(12, 7), np.arange(12) == 0)
    assert len(found.count) == 9 and found.count[found.initial[0]] == 12


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(docs).collect() == []


def test_query(spark, tmp_path):
    docs = random_docs(9, 500)
    spark.createDataFrame([(i, t, t) for i, t in docs], "doc_id long, text string, form string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_spelling(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert plain(got.collect()) == plain_variants(plain_counts(docs, drop_every=199))
