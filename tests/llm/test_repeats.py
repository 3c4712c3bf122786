"""Repeated windows against brute force, over small corpora with many repeats."""

import hashlib
import random
import re

import numpy as np
import pytest
from emberline.llm import fingerprint_index, repeats, suffix_dedup
from pyspark.sql import functions as F


def brute(docs, width, split, join):
    """doc_id -> (units, removed flags), by a dictionary of all windows."""
    seen, flags = {}, {}
    for doc_id, text in sorted(docs):
        units = split(text)
        gone = [False] * len(units)
        for i in range(len(units) - width + 1):
            key = join(units[i : i + width])
            if key in seen:
                gone[i : i + width] = [True] * width
            seen.setdefault(key, (doc_id, i))
        flags[doc_id] = (units, gone)
    return flags


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(15, 60))) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 80))))
        docs.append((i * 3, "\n".join(parts)))
    docs += [(500 + i, docs[5][1]) for i in range(20)]
    docs += [(600, None), (601, ""), (602, "ab " * 300), (603, "x" * 500), (604, "ab " * 200), (605, "é" * 120)]
    for i in range(30):
        text = docs[7][1] + " " + passages[0] + " " + passages[1]
        at = rng.randint(0, len(text))
        docs.append((700 + i, text[:at] + rng.choice(words) + text[at:]))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("a_task", [4096, 3])
def test_bytes(spark, seed, a_task, monkeypatch):
    monkeypatch.setattr(repeats, "CONTEXTS_A_TASK", a_task)
    docs = corpus(seed)
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, spans int").repartition(5)
    got = {r.doc_id: r for r in suffix_dedup.deduplicate(frame).collect()}
    want = brute([(d, (t or "").encode()) for d, t in docs], 100, list, bytes)
    assert got.keys() == want.keys()
    for doc_id, (units, gone) in want.items():
        assert bytes(got[doc_id].kept) == bytes(u for u, g in zip(units, gone) if not g), doc_id
        assert got[doc_id].n_units == len(units)
        runs = [(m.start(), m.end()) for m in re.finditer("1+", "".join("01"[g] for g in gone))]
        assert [tuple(x) for x in got[doc_id].removed] == runs


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("a_task", [4096, 3])
def test_words(spark, seed, a_task, monkeypatch):
    monkeypatch.setattr(repeats, "CONTEXTS_A_TASK", a_task)
    docs = corpus(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in fingerprint_index.deduplicate(frame).collect()}
    want = brute([(d, t or "") for d, t in docs], 20, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), " ".join)
    assert got.keys() == want.keys()
    for doc_id, (units, gone) in want.items():
        assert got[doc_id].kept == " ".join(u for u, g in zip(units, gone) if not g), doc_id
        assert (got[doc_id].n_units, got[doc_id].n_removed) == (len(units), sum(gone))


@pytest.mark.parametrize("a_task", [4096, 1])
def test_repeated_ids(spark, a_task, monkeypatch):
    monkeypatch.setattr(repeats, "CONTEXTS_A_TASK", a_task)
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passages = [text(60) for _ in range(4)]
    docs = [(i, f"{text(30)} {passages[i % 4]} {text(30)}") for i in range(12)]
    rows = docs + docs[:8] + docs[:3]
    rows += [(20, f"{text(25)} {passages[k % 4]} {text(40 + k)}") for k in range(9)]  # a doc_id of several texts
    rows += [rows[-1], (20, None), (20, ""), (None, docs[0][1])]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    ranked = frame.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) as h").distinct().collect()
    order = sorted((r.doc_id, r.h, r.text or "") for r in ranked if r.doc_id is not None)
    number = {(d, t): k for k, (d, _, t) in enumerate(order)}
    of = lambda d, t: number.get((d, t or ""))
    for found, width, split, join, glue in (
        (suffix_dedup, 100, lambda t: list(t.encode()), bytes, bytes),
        (fingerprint_index, 20, lambda t: t.split(), " ".join, " ".join),
    ):
        flags = brute([(k, t) for (_, t), k in number.items()], width, split, join)
        want = [(d, glue(u for u, g in zip(*flags[of(d, t)]) if not g) if d is not None else glue(split(t))) for d, t in rows]
        got = [(r.doc_id, bytes(r.kept) if glue is bytes else r.kept) for r in found.deduplicate(frame).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_nothing_to_read(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.deduplicate(empty).count() == 0
    assert fingerprint_index.deduplicate(empty).count() == 0
    odd = spark.createDataFrame([(None, "a " * 60), (None, None), (4, "b " * 60), (4, "b " * 60)], "doc_id long, text string")
    rows = fingerprint_index.deduplicate(odd).collect()
    assert sorted((r.doc_id is None, r.n_units, r.n_removed) for r in rows) == [(False, 60, 59), (False, 60, 59), (True, 0, 0), (True, 60, 0)]
    assert len(rows) == 4 and len(suffix_dedup.deduplicate(odd).collect()) == 4


@pytest.mark.parametrize("alphabet", [2, 200])
def test_suffix_order(alphabet):
    rng = np.random.default_rng(3)
    text = rng.integers(1, alphabet, 700).astype(np.uint64)
    text[300:500] = text[100:300]
    ranks = suffix_dedup.suffix_ranks(suffix_dedup.dense(text), 1, 10**6)
    want = sorted(range(700), key=lambda i: text[i:].tolist())
    assert np.argsort(ranks).tolist() == want


def test_digest_of_kept(spark):
    frame = spark.createDataFrame([(1, "a b  c")], "doc_id long, text string")
    assert hashlib.sha256(b"a b c").hexdigest() == hashlib.sha256(fingerprint_index.deduplicate(frame).first().kept.encode()).hexdigest()


def test_contexts_of_one_document_spread(spark):
    """One long text with very many contexts of one fingerprint: its place decides the salt as well."""
    width, n, salts = 20, 3000, 8
    docs = spark.createDataFrame([(1, 0, "abcde fghij " * 20_000)], "doc_id long, version long, text string")
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(F.lit(7).cast("long").alias("fp"), F.lit(salts).alias("salts"), (k * 30).cast("int").alias("start"), F.lit(5).alias("count")))
    contexts = docs.select("doc_id", "version", at.alias("at"))
    found = repeats._context_units(docs, contexts, "byte", repeats.Windows(width=width, gram=8))
    sizes = [r["count"] for r in found.groupBy("salt").count().collect()]
    assert len(sizes) == salts and sum(sizes) == n and max(sizes) < 2 * n / salts
