import functools
import random
import zlib

import numpy as np
import pytest
from emberline.llm import token_records
from emberline.llm.queries import tokenizer_path
from tokenizers import Tokenizer

TEXTS = [
    "The quick brown fox isn't 12 years old.  Two  blanks\n\nand\tlines \r\n",
    "a \t\tb   c​ d　　 e\x1c\x1c f \x85 g",
    "  leading and trailing  ",
    "<|endoftext|> is text; don't 've 'll I'M",
    "",
    None,
    "école été 日本語 🙂🙂 x",
    "\n",
    "word " * 3000,
]


def corpus():
    rng = random.Random(1)
    pieces = ["the", " a", "\n", "  ", "'s", "12", "é", " ", "\t", "!!", "x" * 40, " ", "日本"]
    texts = TEXTS + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    return [(i * 3, t) for i, t in enumerate(texts)] + [(0, "again"), (None, "no id")]


@functools.cache
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def reference(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [0]


def test_round_trip(spark):
    docs = corpus()
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, part int").repartition(6)
    got = token_records.round_trip(frame, tokenizer_path()).collect()
    assert len(got) == len(docs)
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in got) == sorted(reference(t) for _, t in docs)
    by_id = {r.doc_id: r for r in got if r.doc_id != 0}
    for doc_id, text in docs:
        if doc_id:
            assert np.frombuffer(by_id[doc_id].ids, "<u4").tolist() == reference(text)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    assert [r.doc_id or -1 for r in sorted(got, key=lambda r: r.start)] == sorted(r.doc_id or -1 for r in got)


def test_index_seeks_and_damage(spark, tmp_path):
    out = f"file://{tmp_path}/rec"
    frame = spark.createDataFrame(corpus(), "doc_id long, text string")
    parts = token_records.write_records(frame, tokenizer_path(), out)
    assert parts.agg({"n_docs": "sum"}).first()[0] == len(corpus())
    rec = sorted((tmp_path / "rec").glob("*.rec"), key=lambda p: p.stat().st_size)[-1]
    content = rec.read_bytes()
    index = np.frombuffer(rec.with_suffix(".idx").read_bytes(), "<i8").reshape(-1, 3)
    for doc_id, offset, n in index:
        payload = next(token_records.records(content, int(offset)))[1]
        assert len(payload) == 9 + 2 * n and int.from_bytes(payload[1:9], "little") == doc_id
    bad = bytearray(content)
    bad[-6] ^= 1
    with pytest.raises(ValueError):
        list(token_records.records(bytes(bad)))
    head = (5).to_bytes(8, "little")
    c = zlib.crc32(head)
    assert token_records.masked(head) == ((c >> 15 | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def test_parts_and_ranges_are_bounded(spark, tmp_path):
    docs = [(None, f"null {i} " + "word " * 50) for i in range(300)] + [(7, f"same {i}") for i in range(300)] + [(8, "twin")] * 300 + [(i, "x") for i in range(9, 40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    out = f"file://{tmp_path}/rec"
    parts = token_records.write_records(frame, tokenizer_path(), out)
    assert all(r.n_docs < 400 for r in parts.collect())  # of 931 in four parts
    got = token_records.with_starts(token_records.read_records(spark, out), parts).collect()
    assert sorted((repr(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((repr(d), reference(t)) for d, t in docs)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id or -1 for r in sorted(got, key=lambda r: r.start)] == sorted(r.doc_id or -1 for r in got)


def test_files_roll(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_records, "FILE_BYTES", 3000)
    monkeypatch.setattr(token_records, "RANGE_BYTES", 1000)
    cloudpickle = __import__("pyspark.cloudpickle", fromlist=["x"])
    cloudpickle.register_pickle_by_value(token_records)
    docs = [(i, f"{i} " + "word " * 300) for i in range(60)]
    out = f"file://{tmp_path}/rec"
    try:
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
        parts = token_records.write_records(frame, tokenizer_path(), out)
        assert parts.count() > 8
        assert token_records.read_ranges(spark, out).count() > 24
        got = token_records.with_starts(token_records.read_records(spark, out), parts).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        cloudpickle.unregister_pickle_by_value(token_records)
    at = 0
    for (doc_id, text), r in zip(docs, sorted(got, key=lambda r: r.start), strict=True):
        assert (r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) == (doc_id, at, reference(text))
        at += r.n_tokens


def test_names_of_special_tokens():
    """As by the plain call: 50256 for a name in a text, also beside texts that only come close."""
    texts = ["a<|endoftext|>b", "a <|endoftext|", "|> b", "x <|endoftext|> <|endoftext|>", "<|end oftext|>"]
    data = "".join(texts).encode()
    with open(tokenizer_path(), encoding="utf-8") as f:
        encoder = token_records.Encoder(f.read())
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    for _ in range(2):
        got = [x.tolist() for x in encoder.encode(np.frombuffer(data, np.uint8), offsets)]
        assert got == [tokenizer().encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [64, 50256, 65]


def test_empty(spark):
    assert token_records.round_trip(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_long_pieces_are_forgotten(monkeypatch):
    """What a worker remembers is bounded by ids too, for texts without white space."""
    monkeypatch.setattr(token_records, "REMEMBERED", 1000)
    code = plain_encoder()
    for k in range(40):
        text = "".join(chr(0x4E00 + (k * 400 + i * 7) % 5000) for i in range(400))
        assert encoded(code, [text]) == [tokenizer().encode(text, add_special_tokens=False).ids]
        assert len(code.flat) <= 8000


def test_forgetting(monkeypatch):
    monkeypatch.setattr(token_records, "REMEMBERED", 5)
    with open(tokenizer_path()) as f:
        code = token_records.Encoder(f.read())
    for text in TEXTS:
        raw = (text or "").encode()
        ids = code.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        assert [*ids.tolist(), 0] == reference(text)


def plain_encoder():
    with open(tokenizer_path(), encoding="utf-8") as f:
        return token_records.Encoder(f.read())


def encoded(code, texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    return [x.tolist() for x in code.encode(data, np.cumsum([0] + [len(t.encode()) for t in texts]))]


def test_words_are_learnt_once():
    """Whatever marks follow a word, and over more of them than 500,000."""
    code, marks = plain_encoder(), ["", ".", ",", "!!", "***", "'s", ")", "&&&"]
    words = [f" w{chr(97 + k % 26)}{chr(97 + k // 26)}{end}" for k in range(260) for end in ("o", "\u00e9", "7")]
    texts = [word + mark for word in words for mark in marks]
    assert encoded(code, texts) == [tokenizer().encode(t, add_special_tokens=False).ids for t in texts]
    assert len(code.known) == len(words) + len(marks) - 1
    code.tokenizer = None  # nothing is left to encode
    assert encoded(code, ["".join(texts[::-1])]) == [tokenizer().encode("".join(texts[::-1]), add_special_tokens=False).ids]
    assert token_records.REMEMBERED > 1_000_000


def test_cuts_at_symbols():
    """Letters, digits, marks and what only looks like them, in any order, at the ends of rows too; known pieces as new ones."""
    rng, code = random.Random(5), plain_encoder()
    parts = ["a", "Zz", "s", "ll", "\u00e9", "\u00ff", "\u00c0", "\u00d7", "\u00f7", "\u0416", "\u0308", "\u00aa", "\u00bd", "1", "42", "'", "'s", "'ll", ".", "***", "<|", "|>"]
    parts += [" ", "  ", "\n", "\t", "\r\n", "\u65e5", "\x00", "\x7f", "\x1b", "\U0001f642", "_", "\u0660", "\u00a1"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(6000)]
    want = [tokenizer().encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        for k in range(0, len(texts), 500):
            assert encoded(code, texts[k : k + 500]) == want[k : k + 500]


def test_added_tokens_with_white_space():
    """Pieces strung together must not make one."""
    import json

    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"].append(spec["added_tokens"][0] | {"id": 50257, "content": "b c"})
    code = token_records.Encoder(json.dumps(spec))
    whole = Tokenizer.from_str(json.dumps(spec))
    texts = [" ab", " bb", " cb", " db", " c", "a b c"]
    assert encoded(code, texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]
