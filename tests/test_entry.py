import __spark_entry__
from emberline import plans


def test_every_oracle_has_a_query():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(plans.QUERIES) <= set(queries)


def test_flagship(spark):
    rows = __spark_entry__.entry(spark)
    assert {"event_id", "detection_count", "spatial_radius_km"} <= set(rows.columns) and rows.count() > 0
