"""The registered queries and the pipeline on a small table with nulls, empty and repeated texts, ties and columns of clashing names."""

import random
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from emberline.llm import queries
from tokenizers import Tokenizer

WORDS = {"aa": "the and of with from this that shing ther house".split(), "bb": "der und mit von dass schen keit ung haus wir".split()}


def document_rows():
    rng = random.Random(9)
    rows = []
    for i in range(120):
        lang = rng.choice(["aa", "bb"])
        rows.append((i, " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", str(rng.randrange(99))]) for _ in range(rng.randint(1, 90))), lang, rng.choice(["web", "books", None]), 0, "x"))
    copies = [(200 + k, rows[k][1], rows[k][2], "web", 0, "y") for k in (3, 4, 5)]
    leak = " ".join(f"q{k}" for k in range(14))
    rows += copies + [(300, None, "aa", "web", 0, "z"), (301, "", None, None, 0, "z"), (302, "12 !?", "bb", "web", 0, "z")]
    rows += [(303, rows[7][1] + " " + leak + " " + rows[8][1], rows[7][2], "web", 0, "z"), (304, "mail a@b.co or 10.0.0.1 or +49 (30) 123456-78", "aa", "web", 0, "z")]
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(3)
    vectors = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(120)] + [(150, None), (200, [float("nan")] * 8), (250, [1.0] * 8), (251, [1.0] * 8)]
    spark.createDataFrame(document_rows(), "doc_id long, text string, lang string, source string, n_chars long, held_out string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("i1", " ".join(f"Q{k}" for k in range(12))), ("i2", None), ("i3", "")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    turns = [(k // 5, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", None]), rng.choice(["Yes.", "no", "", None, f"é {k % 7}?"])) for k in range(400)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


def plain(rows):
    return sorted(tuple(str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, tables, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"create view {table} as select * from '{tables}/{table}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, tables)
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert plain(got.select(*names).collect()) == plain(want.fetchall())


def test_token_records(spark, tables):
    tokenizer, start, want = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for doc_id, text, *_ in sorted(document_rows(), key=lambda r: r[0]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op4_token_records(spark, tables).collect()) == want


def test_mixing_pii_and_models(spark, tables):
    n = len(document_rows())
    mixed = queries.op1_mixing(spark, tables).collect()
    assert len(mixed) == n and all(0 <= r.taken <= 2 * r["size"] for r in mixed)
    for source in {r.source_size for r in mixed}:
        mine = [r for r in mixed if r.source_size == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
    found = {r.doc_id: r for r in queries.op5_pii(spark, tables).collect()}
    assert len(found) == n and (found[304].n_email, found[304].n_ip, found[304].n_card, found[304].n_phone) == (1, 1, 0, 1)
    assert found[304].spans == "email:5:11,ip:15:23,phone:27:45" and found[300].spans == ""
    for name in ("op9_quality", "op10_language"):
        rows = queries.QUERIES[name](spark, tables).collect()
        assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_pipeline(spark, tables):
    """Each stage on what the one before kept: columns stay, clean documents stay, copies and the leak go."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == columns, name
        seen.append({r.doc_id: r.text for r in docs.collect()})
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    by_language, without_copies, clean, mixed = seen
    assert not {300, 301, 302} & set(by_language) and len(by_language) >= 115
    assert not {203, 204, 205} & set(without_copies) and len(without_copies) >= len(by_language) - 8
    assert set(clean) == set(without_copies) and "q3" not in (clean.get(303) or "")
    assert set(mixed) <= set(clean)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    assert len(last) == docs.count() and min(r.start for r in last) == 0
    whole = corpus_pipeline.run(spark, tables).collect()
    assert sorted(tuple(r) for r in whole) == sorted(tuple(r) for r in last)
    empty = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tables).count() == 0, name
