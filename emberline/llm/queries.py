"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import conversations, fingerprint_index, fm_decontam, langid, mixing, pii, rule_quality, setsketch, spelling, suffix_dedup, token_records, topk, weak_rules
from emberline.session import stored, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizers are installed."""
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.join(os.path.dirname(spec.origin) if spec else "/opt/tokenizers", name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id",
        F.col("n_units").alias("n_bytes"),
        (F.col("n_units") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5, scale=256.0)
    return found.select("query_id", "rank", "vec_id", "score")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_records.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id", *[of(kind) for kind in pii.BASE_KINDS], F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans")
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = fingerprint_index.deduplicate(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = setsketch.near_duplicates(table(spark, sf_dir, "documents"), setsketch.Sketch(shingle=4, similarity=0.8))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(rule_quality.statistics(table(spark, sf_dir, "documents")), "statistics")
    labels = table(spark, sf_dir, "labels").filter(~langid.held_out()).select("doc_id", F.col("quality").alias("label"))
    rules = rule_quality.learn(stats, labels)
    scored = stats.select("doc_id", langid.held_out().alias("held_out"), rules.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"), drop_every=199)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(weak_rules.statistics(table(spark, sf_dir, "documents")), "counts")
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return weak_rules.judged(stats).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "probability"
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversations.summary(stored(conversations.repair(conversations.damaged(rows)), "repaired"))
    named = found.withColumnRenamed("conv_id", "c")
    joined = rows.select("conv_id").distinct().join(named, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_suffix_dedup,
        op3_exact_topk,
        op4_token_records,
        op5_pii,
        op6_substring_dedup,
        op7_decontamination,
        op8_minhash_dedup,
        op9_quality,
        op10_language,
        op11_spelling,
        op12_quality_rules,
        op13_conversation_repair,
    )
}

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, b[i:i + 99] AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 100)) AS p FROM r),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before < p - 1) AS n_spans
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM g) GROUP BY doc_id),
units AS (SELECT doc_id, p, hex(b[p:p]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) + 1)) AS p FROM d)),
kept AS (SELECT u.doc_id, string_agg(u.h, '' ORDER BY u.p) AS h FROM units u ANTI JOIN g ON u.doc_id = g.doc_id AND u.p = g.p GROUP BY u.doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op3_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
units AS (SELECT doc_id, p, ws[p] AS u FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d)),
kept AS (SELECT u.doc_id, count(*) AS n, string_agg(u.u, ' ' ORDER BY u.p) AS t FROM units u ANTI JOIN g ON u.doc_id = g.doc_id AND u.p = g.p GROUP BY u.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWERED}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
w AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes)),
h AS (SELECT w.doc_id, w.i, w.n, p.item_id FROM w JOIN p ON w.n = p.n AND w.s = p.s),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op8_minhash_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
ends AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, l) AS (SELECT DISTINCT a, a FROM ends UNION SELECT ends.b, reach.l FROM reach JOIN ends ON ends.a = reach.a WHERE reach.l < ends.b),
c AS (SELECT a AS doc_id, min(l) AS l FROM reach GROUP BY a)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.l, documents.doc_id) AS component_id,
  documents.doc_id = coalesce(c.l, documents.doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op11_spelling": rf"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list(c ORDER BY i) AS tb FROM (SELECT i, list_reduce(range(8), lambda c, k:
  CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM (SELECT unnest(range(256)) AS i))),
r AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents)
  WHERE length(w) >= 6 GROUP BY doc_id, w),
h AS (SELECT w, k, xor(list_reduce(flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda c:
  CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c)::BIGINT - 64] END)), lambda s, b: xor(s >> 8, tb[xor(s & 255, b) + 1]), 4294967295), 4294967295) AS h
  FROM r, t),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n, length(word) AS len FROM (SELECT k,
  CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
v AS (SELECT word, n, len, i, left(word, i - 1) || substr(word, i + 1) AS s FROM (SELECT *, unnest(range(1, len + 1)) AS i FROM words)),
ins AS (SELECT DISTINCT v.word AS a, v.n AS an, w.word AS b, w.n AS bn FROM v JOIN words w ON v.s = w.word),
near AS (SELECT x.word AS a, y.word AS b, y.n AS bn FROM v x JOIN v y ON x.len = y.len AND x.i = y.i AND x.s = y.s AND x.word <> y.word
  UNION ALL SELECT a, b, bn FROM ins UNION ALL SELECT b, a, an FROM ins),
best AS (SELECT a, n_near, b, bn FROM (SELECT *, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY bn DESC, b) AS k FROM near) WHERE k = 1),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN bn >= 5 * n THEN b END AS form, CASE WHEN bn >= 5 * n THEN bn END AS form_n
  FROM words LEFT JOIN best ON a = word),
chain(word, place) AS (SELECT word, word FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.place WHERE f.form IS NOT NULL),
roots AS (SELECT chain.word, chain.place AS root FROM chain JOIN f ON f.word = chain.place WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN roots USING (word)""",
    "op13_conversation_repair": r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list(c ORDER BY i) AS tb FROM (SELECT i, list_reduce(range(8), lambda c, k:
  CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM (SELECT unnest(range(256)) AS i))),
n AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT),
    lambda s, b: xor(s >> 8, tb[xor(s & 255, b) + 1]), 4294967295), 4294967295) % 20 AS fault FROM conversations, t),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM n WHERE fault <> 0),
o AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS r,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM d),
f AS MATERIALIZED (SELECT *, body = '' AS is_blank, body <> '' AND again > 1 AS is_again, body <> '' AND again = 1 AND NOT contains('.!?', right(body, 1)) AS is_cut,
  lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
counts AS (SELECT conv_id, count(*) AS last, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE is_blank) AS blank,
  count(*) FILTER (WHERE is_again) AS duplicate, count(*) FILTER (WHERE is_cut) AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
dp(conv_id, i, a, b, c, e) AS (
  SELECT conv_id, 0::BIGINT, {'k': 0, 'l': '', 't': ''}, {'k': 900, 'l': '', 't': ''}, {'k': 5, 'l': 'I', 't': chr(10) || 'user:'},
    {'k': 10, 'l': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} FROM counts
  UNION ALL
  SELECT conv_id, i, a, b, c, list_min([e, {'k': c.k + 5, 'l': c.l || 'I', 't': c.t || chr(10) || 'assistant:'}]) FROM (
  SELECT conv_id, i, a, b, list_min([c, {'k': a.k + 5, 'l': a.l || 'I', 't': a.t || chr(10) || 'user:'}, {'k': b.k + 5, 'l': b.l || 'I', 't': b.t || chr(10) || 'user:'},
    {'k': e.k + 5, 'l': e.l || 'I', 't': e.t || chr(10) || 'user:'}]) AS c, e FROM (
  SELECT conv_id, i, {'k': a.k + 2, 'l': a.l || 'D', 't': a.t} AS a,
    list_min([{'k': b.k + 2, 'l': b.l || 'D', 't': b.t}, CASE WHEN r = 's' AND ok THEN {'k': a.k + x, 'l': a.l || 'K', 't': a.t || line} ELSE none END]) AS b,
    list_min([{'k': c.k + 2, 'l': c.l || 'D', 't': c.t}, CASE WHEN r = 'u' AND ok THEN {'k': o.k + x, 'l': o.l || 'K', 't': o.t || line} ELSE none END,
      CASE WHEN ok THEN {'k': o.k + x + 1, 'l': o.l || 'R', 't': o.t || chr(10) || 'user:' || text} ELSE none END]) AS c,
    list_min([{'k': e.k + 2, 'l': e.l || 'D', 't': e.t}, CASE WHEN r = 'a' AND ok THEN {'k': c.k + x, 'l': c.l || 'K', 't': c.t || line} ELSE none END,
      CASE WHEN ok THEN {'k': c.k + x + 1, 'l': c.l || 'R', 't': c.t || chr(10) || 'assistant:' || text} ELSE none END]) AS e FROM (
  SELECT f.conv_id, f.i, f.r, f.text, a, b, c, e, list_min([a, b, e]) AS o, NOT is_blank AND NOT is_again AS ok, CASE WHEN is_cut THEN 5 ELSE 0 END AS x,
    chr(10) || f.role || ':' || f.text AS line, {'k': 1000000, 'l': '', 't': ''} AS none
  FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1)))),
ends AS (SELECT dp.conv_id, gaps, blank, duplicate, truncated, illegal, list_min([a, e]) AS w
  FROM dp JOIN counts ON counts.conv_id IS NOT DISTINCT FROM dp.conv_id AND counts.last = dp.i)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.k, 0)::BIGINT AS cost, coalesce(w.l, '') AS audit,
  sha256(coalesce(substr(w.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id""",
}
