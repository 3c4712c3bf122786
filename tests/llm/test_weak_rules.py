"""Weak supervision: counts against plain Python, estimates against planted ones, the compiled column against the formula."""

import random
import re

import numpy as np
import pytest
from emberline.llm import queries, weak_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for k in range(len(words) - 2):
        windows.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {k + d for at in windows.values() if len(at) > 1 for k in at for d in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    marks = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    n = {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_upper": sum("A" <= c <= "Z" for c in text),
        "n_lower": sum("a" <= c <= "z" for c in text),
        "n_ends": sum(w[-1] in ".!?" for w in words),
        "n_doubled": sum(len(w.encode()) > 2 and w[-1] in marks and w[-2] == w[-1] for w in words),
        "n_bare": sum(all(c in marks for c in w) for w in words),
        "n_marks": sum(c in marks for c in text),
        "n_digits": sum("0" <= c <= "9" for c in text),
        "n_plain": sum(not any(c in marks or "0" <= c <= "9" for c in w[:-1]) and not "0" <= w[-1] <= "9" and not (len(w) == 1 and w in marks) for w in words),
    }
    return tuple(n[x] for x in weak_rules.STATISTICS)


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t", "a a a a", "a b c\na b c\n\na b c\r", "x\n x\nx \nx", "!! ! é!! #*$%&|<>", "ééé ÀÀ ß ß 漢字 😀", "a\x0bb\x0cc a b c", "w " * 70_000 + "end", "line\n" * 60_000]
    for _ in range(300):
        out.append("".join(rng.choice(["a ", "b ", "ab", "Ab. ", "c\n", "!!", "| ", "é", "7", "\n", "\t", " "]) for _ in range(rng.randint(0, 120))))
    return out


def test_counts(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").selectExpr("*", "doc_id as n_words").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in weak_rules.statistics(df).collect()}
    assert got == {k: plain_counts(t) for k, t in enumerate(texts())}


def test_repeated_windows_when_hashes_meet(monkeypatch):
    monkeypatch.setattr(weak_rules, "mix", lambda x: x * np.uint64(0))
    keys = [np.array(x) for x in ([1, 2, 1, 3, 2, 1], [5, 5, 5, 5, 5, 6])]
    assert weak_rules._repeated(keys).tolist() == [True, True, True, False, True, False]


def test_estimates():
    """Independent votes with known shares: 70 per cent good documents, rules of several strengths."""
    rng = np.random.default_rng(1)
    n, good, bad, speaks = 200_000, np.array([0.95, 0.9, 0.99, 0.8, 0.97]), np.array([0.5, 0.8, 0.3, 0.6, 0.9]), np.array([1, 0.9, 0.8, 0.5, 0.7])
    is_good = rng.random(n) < 0.7
    says_good = np.where(is_good[:, None], rng.random((n, 5)) < good, rng.random((n, 5)) >= bad)
    votes = np.where(rng.random((n, 5)) < speaks, np.where(says_good, 1, -1), 0)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    w = weak_rules.estimate(patterns, counts.astype(float), steps=3000)
    assert abs(w.share - 0.7) < 0.03 and np.abs(w.good - good).max() < 0.03 and np.abs(w.bad - bad).max() < 0.05
    truth = weak_rules.Weights(0.7, good, bad).probability(patterns)
    assert np.average(np.abs(w.probability(patterns) - truth), weights=counts) < 0.02


def test_estimates_without_votes():
    w = weak_rules.estimate(np.zeros((0, 3), np.int64), np.zeros(0))
    assert w.share == pytest.approx(0.8) and w.probability(np.zeros((1, 3), np.int64))[0] == pytest.approx(0.8)


def test_compiled_column(spark):
    rows = [(k, *plain_counts(t)) for k, t in enumerate(texts())]
    stats = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{x} long" for x in weak_rules.STATISTICS))
    w = weak_rules.weigh(stats)
    got = weak_rules.judged(stats).select("doc_id", "probability", "good", *[weak_rules.vote(r).alias(f"v{k}") for k, r in enumerate(weak_rules.RULES)]).collect()
    for r in got:
        p = w.probability(np.array([r[3:]]))[0]
        assert r.probability == pytest.approx(p) and r.good == (p >= 0.5)


def test_query(spark, tmp_path):
    rng = random.Random(3)
    words = "the of and with house river walked under light stone seldom window morning".split()
    sentence = lambda: " ".join(rng.choice(words) + rng.choice(["", "", str(rng.choice("abcdefgh"))]) for _ in range(rng.randint(6, 14))).capitalize() + "."
    prose = lambda: " ".join(sentence() for _ in range(rng.randint(8, 20)))
    clean = [prose() for _ in range(200)]
    junk = [re.sub(" ", "### ", prose()) for _ in range(10)] + [re.sub(" ", "!! ", prose()).upper() for _ in range(10)] + [re.sub(" ", " | ", prose()) for _ in range(10)]
    docs = clean + junk + texts()[:-302] + ["Same line again.\n" * 40, None, ""]
    spark.createDataFrame([(k, t, k) for k, t in enumerate(docs)], "doc_id long, text string, kept long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_quality_rules(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    for k, text in enumerate(docs):
        n = dict(zip(weak_rules.STATISTICS, plain_counts(text), strict=True))
        failed = n["n_words"] < 50 or 100 * n["n_repeat_words"] > 50 * n["n_words"]
        assert all(got[k][x] == n[x] for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) and got[k].base_failed == failed
        assert not (failed and got[k].kept)
        if k < len(clean):
            assert got[k].kept == (not failed)
        elif k < len(clean) + len(junk):
            assert not got[k].kept
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op12_quality_rules(spark, f"{tmp_path}/none").collect() == []
