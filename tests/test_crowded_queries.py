"""Queries over events on tables whose places are crowded, against their SQL, and what they store on the way."""

import glob
import os

import __spark_entry__
import duckdb
import pytest
from emberline.operators import graph
from emberline.plans import events as plans
from emberline.plans.dataset import event_store
from emberline.plans.records import latest_annotations
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def scratch(spark, name):
    return set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/{name}-*"))


def plain(rows):
    value = lambda x: None if x is None else str(x) if not isinstance(x, (int, float)) or isinstance(x, bool) else round(float(x), 9) + 0.0
    return sorted((tuple(map(value, r)) for r in rows), key=repr)


def same_as_sql(spark, d, name):
    con = duckdb.connect()
    for t in os.listdir(d):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{d}/{t}{'/*.parquet' if os.path.isdir(f'{d}/{t}') else ''}'")
    found = __spark_entry__.queries()[name](spark, d)
    want = con.sql(f"SELECT {', '.join(found.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert want and plain(found.collect()) == plain(want)


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """(folder, most rows of edges stored): the events four times at the same places, with shifted ids."""
    d = str(tmp_path_factory.mktemp("crowded"))
    for t in os.listdir(SF):
        if t != "events.parquet":
            os.symlink(f"{SF}/{t}", f"{d}/{t}")
    rows = spark.read.parquet(f"{SF}/events.parquet").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    rows.withColumn("event_id", F.col("event_id") + F.col("k") * 1000).drop("k").write.parquet(f"{d}/events.parquet")
    most, kept = [0], graph.stored
    graph.stored = lambda df, name: (out := kept(df, name), most.append(out.count()))[0]
    try:
        plans.event_tables(spark, d)
    finally:
        graph.stored = kept
    return d, max(most)


@pytest.mark.parametrize("name", ["grf_02_event_ids", "agg_13_centroids", "join_08_lineage", "orc_06_status", "agg_14_history", "mlx_02_splits"])
def test_queries_on_crowded_places(spark, crowded, name):
    d, most = crowded
    same_as_sql(spark, d, name)
    assert most < 8000  # there are over 30,000 pairs of the 4000 detections


def test_typed_events_on_crowded_places(spark, crowded):
    d, most = crowded
    same_as_sql(spark, d, "prj_10_typed")
    assert most < 8000


def test_schema_of_crowded_places(spark, crowded):
    nulls = {r["name"]: r.nulls for r in __spark_entry__.queries()["orc_13_schema"](spark, crowded[0]).collect()}
    assert len(nulls) == 69 and nulls["event_id"] == 0 and crowded[1] < 8000


def test_splits_read_a_stored_table(spark):
    """Detections and members are joined once, however often a split looks at its events."""
    assert all("/splittable-" in f for f in plans.splittable(spark, SF).inputFiles())


def test_annotations_of_the_events_asked_for(spark):
    asked = spark.range(0, 900, 7).select(F.col("id").alias("event_key"))
    got = latest_annotations(spark, SF, asked)
    want = latest_annotations(spark, SF).join(asked, "event_key", "left_semi")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_an_appended_analysis_counts_the_predictions_of_its_event(spark, tmp_path):
    """Ids of predictions of different events may be equal: line 8 of an event and line 0 of the next one."""
    for t in os.listdir(SF):
        if t != "lineitem.parquet":
            os.symlink(f"{SF}/{t}", f"{tmp_path}/{t}")
    line = spark.read.parquet(f"{SF}/lineitem.parquet")
    more = line.limit(1).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(99))))
    first = more.withColumn("l_orderkey", F.col("k").cast("long")).withColumn("l_linenumber", F.lit(8))
    then = more.withColumn("l_orderkey", F.col("k").cast("long") + 1).withColumn("l_linenumber", F.lit(0))
    line.unionByName(first.drop("k")).unionByName(then.drop("k")).write.parquet(f"{tmp_path}/lineitem.parquet")
    same_as_sql(spark, str(tmp_path), "orc_07_reanalyze")


def test_imported_artifacts_are_deleted(spark):
    before = scratch(spark, "artifact")
    event_store(spark, SF)
    assert scratch(spark, "artifact") == before
    same_as_sql(spark, SF, "snk_09_imported")


def test_features_on_crowded_places(spark, crowded):
    same_as_sql(spark, crowded[0], "mlx_01_features")
    assert crowded[1] < 8000
