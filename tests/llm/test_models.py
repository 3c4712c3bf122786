import random
import re

import numpy as np
from emberline.llm import langid, rule_quality
from pyspark.sql import functions as F

WORDS = {"aa": "the and of with from this that shing ther".split(), "bb": "der und mit von dass schen keit ung".split(), "cc": "que los con una para ción mente ñado".split()}


def language_docs(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 60))), lang, "s", 0))
    return rows


def test_language(spark):
    rows = language_docs(900, 1) + [(5000, None, "aa", "s", 0), (5001, "", "aa", "s", 0), (5002, "12 !? 3", None, "s", 0), (None, "the and of with", None, "s", 0), (5003, "日本", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for doc_id in (5000, 5001, 5002):
        assert (by_id[doc_id].lang_pred, by_id[doc_id].score) == ("und", 0.0)
    assert by_id[5003].lang_pred in WORDS and by_id[None].lang_pred == "aa" and by_id[None].held_out is False
    held = [r for r in got if r.held_out and r.lang and r.doc_id < 900]
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    untaught = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in untaught} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_rare_language(spark):
    """A dozen documents among thousands are learned, whatever the draw of the others; null ids don't come all or none."""
    rows = [(None if i % 3 == 0 else i, *r[1:3]) for i, r in enumerate(language_docs(4000, 4))]
    rows += [(90000 + i, f"zork blib {i} quaz vemt zork" + " blib quaz" * i, "zz") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, sample=300).filter("lang = 'zz'").collect()
    assert np.mean([r.lang_pred == "zz" for r in got]) > 0.9
    drawn, sizes = langid.drawn_by_language(docs.filter("lang = 'aa'"), 300)
    assert sizes["aa"] > 1000 and 200 < drawn.count() < 400


def test_folded_table_is_the_mean_of_embeddings():
    """The table of bucket scores gives what averaging embeddings and a linear softmax give."""
    rng = np.random.default_rng(8)
    embed, weight, bias = rng.normal(size=(1 << langid.BUCKET_BITS, 4)), rng.normal(size=(4, 3)), rng.normal(size=3)
    model = langid.Model(["a", "b", "c"], np.ascontiguousarray((embed @ weight).T.astype(np.float32)), bias)
    texts = [b"Some text with words", "Ünd nöch einer".encode(), b"abc", b"a", b""]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    got = model.probabilities(data, offsets)
    for k, text in enumerate(texts):
        ids = np.concatenate([b for b, _ in langid.subwords(np.frombuffer(text, np.uint8), np.array([0, len(text)]))])
        want = langid.softmax((embed[ids].mean(axis=0) if len(ids) else np.zeros(4)) @ weight + bias)
        assert np.allclose(got[k], want, atol=1e-4)


def plain_statistics(text):
    """Plain Python for those statistics whose words say it all."""
    words, lines, n = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if x], max(len(text.encode()), 1)
    w = max(len(words), 1)
    return {
        "bytes": len(text.encode()),
        "words": len(words),
        "lines": len(lines),
        "word_bytes": sum(len(x.encode()) for x in words) / w,
        "words_a_line": len(words) / max(len(lines), 1),
        "upper": len(re.findall("[A-Z]", text)) / n,
        "digit": len(re.findall("[0-9]", text)) / n,
        "distinct_words": len(set(words)) / w,
        "again_words": sum(a == b for a, b in zip(words, words[1:])) / w,
        "repeated_lines": 1 - len(set(lines)) / max(len(lines), 1),
        "comma_end": sum(x.endswith(",") for x in words) / w,
        "long_words": sum(len(x.encode()) > 14 for x in words) / w,
        "short_words": sum(len(x.encode()) < 3 for x in words) / w,
    }


def test_statistics_and_compiled_rules(spark):
    rng = random.Random(6)
    pieces = ["The", "quick", "FOX,", "é", "a", "a", "12", "\n", "!!", "x" * 20, "--"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 50))) for _ in range(60)] + [""]
    stats = rule_quality.statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rules = rule_quality.Rules(0.3, [(((0, True, 40.0), (5, False, 0.1)), 1.25), (((1, False, 20.0),), -0.75), (((13, True, 0.0),), 0.5)])
    for r in stats.select("*", rules.score().alias("score")).collect():
        for name, value in plain_statistics(texts[r.doc_id]).items():
            assert abs(r[name] - value) < 1e-9, name
        x = [r[name] for name in rule_quality.STATISTICS]
        total = rules.bias + sum(w for rule, w in rules.rules if all((x[f] > t) == above for f, above, t in rule))
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9


def quality_docs(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS["aa"]) for _ in range(rng.randint(5, 80))]
        bad = rng.random() < 0.3
        kind = rng.randrange(3)
        if bad:
            words = [w.upper() + "!!" for w in words] if kind == 0 else [words[0]] * len(words) if kind == 1 else [x for w in words for x in (w, "|")]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad)))
    return rows, labels


def test_quality(spark):
    rows, labels = quality_docs(1200, 2)
    docs = spark.createDataFrame([*rows, (7000, None), (7001, ""), (None, "x y")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (7000, None)], "doc_id long, label int")
    stats = rule_quality.statistics(docs)
    rules = rule_quality.learn(stats, marks.filter(~langid.held_out()))
    assert 0 < len(rules.rules) < 200
    got = {r.doc_id: r.score for r in stats.select("doc_id", rules.score().alias("score")).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= s <= 1 for s in got.values())
    held = {r.doc_id for r in docs.filter(langid.held_out()).collect()}
    right = [(got[i] >= 0.3) == bool(y) for i, y in labels if i in held]
    assert len(right) > 100 and np.mean(right) > 0.95


def test_quality_without_labels(spark):
    stats = rule_quality.statistics(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    none = spark.createDataFrame([], "doc_id long, label int")
    assert stats.select(rule_quality.learn(stats, none).score()).first()[0] == 0.5
    one = spark.createDataFrame([(1, 1)], "doc_id long, label int")
    assert stats.select(rule_quality.learn(stats, one).score()).first()[0] > 0.9
    assert rule_quality.statistics(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_repeated_doc_id_teaches_once(spark, monkeypatch):
    """400 rows of each doc_id: no more come to the driver than there are labelled documents."""
    seen = []
    fit = rule_quality.fit
    monkeypatch.setattr(rule_quality, "fit", lambda x, y: seen.append(len(y)) or fit(x, y))
    rows = [(k % 20, f"word{k} " * (k % 30 + 1)) for k in range(8000)]
    stats = rule_quality.statistics(spark.createDataFrame(rows, "doc_id long, text string"))
    rule_quality.learn(stats, spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, label int"))
    assert seen == [20]


def test_a_dirty_language_column(spark, monkeypatch):
    """Only the most frequent languages are gathered and learned; rows of the others are scored all the same."""
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    rows = language_docs(600, 7) + [(1000 + k, "the and of", f"x{k}", "s", 0) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    _, sizes = langid.drawn_by_language(docs, 600)
    assert set(sizes) == set(WORDS)
    assert {r.lang_pred for r in langid.identify(docs).collect()} <= set(WORDS)


def test_language_sample_goes_packed(spark):
    """What goes to the driver is under half of two ints a bucket, and holds the same buckets and counts, however often one comes."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(3000)) for _ in range(40)] + ["ab " * 5000, "a" * 70000, "ab", ""]
    rows = langid.bags(spark.createDataFrame([("aa", k, text) for k, text in enumerate(texts)], "lang string, drawn long, text string")).toArrow()
    total = 0
    for drawn, bag in zip(rows.column("drawn").to_pylist(), rows.column("bag").to_pylist(), strict=True):
        data = np.frombuffer(texts[drawn].encode(), np.uint8)
        ids, counts = np.unique(np.concatenate([b for b, _ in langid.subwords(data, np.array([0, len(data)]))]), return_counts=True)
        got = langid.unpacked(bag)
        assert np.array_equal(got[0], ids) and np.array_equal(got[1], counts)
        total += len(ids)
    assert len(rows) == len(texts) and rows.nbytes < 4 * total
