"""Digests of ordered rows against hashlib over whole lists, in one and in many pieces."""

import hashlib
import random

import pytest
from emberline.operators import digest
from emberline.operators.events import describe
from pyspark.sql import functions as F


@pytest.mark.parametrize(("piece", "partitions", "coalesce"), [(1 << 20, "4", "true"), (40, "7", "false"), (1, "3", "false")])
def test_digests(spark, monkeypatch, piece, partitions, coalesce):
    monkeypatch.setattr(digest, "PIECE_BYTES", piece)
    settings = {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.coalescePartitions.enabled": coalesce}
    before = {k: spark.conf.get(k) for k in settings}
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 2, 2, 2, 2, 3, *range(10, 60)]), k, rng.choice([f"é{k}", str(k), "", None])) for k in range(3000)]
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.createDataFrame(rows, "key long, place long, text string").repartition(5)
        got = {r.key: (r.n, r.digest) for r in digest.ordered_digests(df, "key", ["place"], "text", ", ", "head ").collect()}
        assert digest.ordered_digests(df.limit(0), "key", ["place"], "text", ",").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {}
    for key, _, text in sorted(rows, key=lambda r: r[1]):
        if text is not None:
            want.setdefault(key, []).append(text)
    assert got == {k: (len(v), hashlib.sha256(("head " + ", ".join(v)).encode()).hexdigest()) for k, v in want.items()}


def test_an_event_of_a_million(spark):
    """One event with a million detections: its rows go to many tasks, and one task reads a piece for each of these, or each megabyte."""
    n = 1_000_000
    det = spark.range(n).select(F.col("id").alias("det_id"), F.lit(10.0).alias("lat"), F.lit(20.0).alias("lon"), (F.col("id") * 1000).alias("acq_us"), F.lit(1.0).alias("frp"), F.lit(300.0).alias("brightness"), F.lit("D").alias("daynight"), F.lit("s").alias("satellite"))
    event = describe(det, det.select("det_id", F.lit(0).cast("long").alias("component"))).collect()
    ids = "|".join(sorted(map(str, range(n))))
    assert len(event) == 1 and event[0].detection_count == n
    assert event[0].event_id == "EV-" + hashlib.sha256(f"event-v1|1.0|24.0|{ids}".encode()).hexdigest()[:20]
