"""An index that is kept: batches in sessions of their own against brute force and against the whole table at once."""

import shutil

import pytest
from emberline.llm import fingerprint_index
from emberline.llm.kept_index import KeptIndex
from test_repeats import brute, corpus

SCHEMA = "doc_id long, text string, kept int"


def blank_words(text):
    return (text or "").split()


def kept(docs):
    return {d: (len(units), sum(gone), " ".join(u for u, g in zip(units, gone) if not g)) for d, (units, gone) in brute([(d, t or "") for d, t in docs], 20, blank_words, tuple).items()}


def rows(frame):
    return {r.doc_id: (r.n_units, r.n_removed, r.kept or "") for r in frame.collect()}


def write(spark, docs, path):
    spark.createDataFrame([(*d, 1) for d in docs], SCHEMA).repartition(3).write.parquet(path)
    return path


def test_three_sessions(spark, tmp_path):
    docs = sorted(corpus(3))
    parts, got = [docs[:40], docs[40:75], docs[75:]], {}
    for k, part in enumerate(parts):
        session = spark.newSession()
        index = KeptIndex(session, f"file://{tmp_path}/index")
        path = write(session, part, str(tmp_path / f"batch{k}"))
        got |= rows(index.append(session.read.parquet(path)))
        index.close()
        shutil.rmtree(path)  # no later batch can read it
    assert got == kept(docs)
    assert any(n for _, n, _ in got.values())
    whole = spark.createDataFrame([(*d, 1) for d in docs], SCHEMA)
    assert got == rows(fingerprint_index.deduplicate(whole))


def test_again_and_lost_halfway(spark, tmp_path, monkeypatch):
    docs = sorted(corpus(4))
    first, second = (spark.createDataFrame([(*d, 1) for d in part], SCHEMA) for part in (docs[:60], docs[60:]))
    where = f"file://{tmp_path}/index"
    index = KeptIndex(spark, where)
    index.append(first).collect()
    with monkeypatch.context() as patch:
        patch.setattr(KeptIndex, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            KeptIndex(spark, where).append(second)
    index = KeptIndex(spark, where)
    once = rows(index.append(second))
    assert once == {d: v for d, v in kept(docs).items() if d in once}
    before = list(index.runs)
    assert rows(index.append(second)) == once and index.runs == before
    with pytest.raises(ValueError, match="windows of 20 words"):
        KeptIndex(spark, where, width=10)
    stale = KeptIndex(spark, where)
    index.append(spark.createDataFrame([(9000, " ".join(f"w{k}" for k in range(40)), 1)], SCHEMA)).collect()
    with pytest.raises(RuntimeError, match="changed meanwhile"):
        stale.append(spark.createDataFrame([(9001, " ".join(f"v{k}" for k in range(40)), 1)], SCHEMA))


def test_odd_rows(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(25))
    index = KeptIndex(spark, f"file://{tmp_path}/index")
    assert index.append(spark.createDataFrame([], SCHEMA)).collect() == []
    batch = [(1, text, 0), (1, text, 0), (None, text, 0), (2, None, 0), (3, "", 0), (4, text.replace(" ", "\n \t"), 0), (4, "w1 w2", 0)]
    got = sorted((r.doc_id or 0, r.n_units, r.n_removed) for r in index.append(spark.createDataFrame(batch, SCHEMA)).collect())
    assert got == [(0, 25, 0), (1, 25, 0), (1, 25, 0), (2, 0, 0), (3, 0, 0), (4, 2, 0), (4, 25, 25)]
    later = index.append(spark.createDataFrame([(0, text + " more", 0), (1, text, 0)], SCHEMA))
    assert sorted((r.doc_id, r.n_removed, r.kept) for r in later.collect()) == [(0, 25, "more"), (1, 0, text)]


def test_hot_context_and_long_text(spark, tmp_path):
    """One fingerprint holds most contexts, many of them in one long text."""
    stem = [f"s{k}" for k in range(6)]
    long = " ".join(w for k in range(1500) for w in (*stem, *(f"x{k}_{j}" for j in range(20))))
    index = KeptIndex(spark, f"file://{tmp_path}/index")
    docs = [(1, long), (2, long[: len(long) // 2]), (3, "a " * 30)]
    got = {}
    for doc in docs:
        got |= rows(index.append(spark.createDataFrame([(*doc, 0)], SCHEMA)))
    assert got == kept(docs)
