"""Dashboard aggregates: counts by class and level, time series, timelines, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import scoring
from emberline.operators import series
from emberline.plans.model import DET_SQL, on_scored
from emberline.plans.registry import query, scored
from emberline.sources import fixtures

NOW, DAY = fixtures.NOW_US, fixtures.DAY_US
CLASS_OF = "CASE satellite WHEN 'VIIRS S-NPP' THEN 'Wildfire' WHEN 'VIIRS NOAA-20' THEN 'Agricultural Burning' WHEN 'VIIRS NOAA-21' THEN 'Gas Flare' WHEN 'MODIS Aqua' THEN 'Industrial Fire' ELSE 'Other Thermal Anomaly' END"
_CLASS_SQL = f"{DET_SQL}, cls AS (SELECT *, {CLASS_OF} AS classification FROM det)"


def classes(spark, d):
    """Detections with the class that their satellite stands for, for series over all rows."""
    return fixtures.detections(spark, d).withColumn("classification", F.expr(CLASS_OF))


@query("agg_01_by_class", on_scored("SELECT classification, state, count(*) AS n FROM scored GROUP BY ALL"))
def agg_01(spark, d):
    return scored(spark, d).groupBy("classification", "state").agg(F.count("*").alias("n"))


_LEVELS = "(VALUES " + ", ".join(f"('{name}', {k})" for k, (name, *_) in enumerate(scoring.LEVELS)) + ") v(risk_level, place)"


@query("agg_02_by_risk_filled", on_scored(f"SELECT risk_level, place::INT AS place, count(site_id) AS n FROM {_LEVELS} LEFT JOIN scored USING (risk_level) GROUP BY ALL"))
def agg_02(spark, d):
    return series.over_domain(scored(spark, d), "risk_level", tuple(name for name, *_ in scoring.LEVELS))


def _series_sql(starts: list[int], width: int, value: str, relation: str = "det") -> str:
    rows = ", ".join(f"({k}, {s})" for k, s in enumerate(starts))
    return f"FROM (VALUES {rows}) v(bucket, start_us) LEFT JOIN {relation} ON acq_us >= start_us AND acq_us < start_us + {width} GROUP BY bucket, start_us {value}"


_D14, _W12, _M12, _D8 = series.days_before(NOW, 14), series.rolling(NOW, 12, 7), series.rolling(NOW, 12, 30), series.rolling(NOW, 8, 1)


@query("agg_03_daily", f"WITH {DET_SQL} SELECT strftime(make_timestamp(start_us), '%b %d') AS label, bucket::INT AS bucket, count(det_id) AS n {_series_sql(_D14, DAY, '')}")
def agg_03(spark, d):
    rows = series.buckets(fixtures.detections(spark, d), _D14, DAY, "acq_us", [F.count("*").alias("n")])
    return rows.select(F.date_format(F.timestamp_micros("start_us"), "MMM dd").alias("label"), "bucket", "n")


@query("agg_04_weekly", f"WITH {DET_SQL} SELECT bucket::INT AS bucket, start_us::BIGINT AS start_us, count(det_id) AS n {_series_sql(_W12, 7 * DAY, '')}")
def agg_04(spark, d):
    """Twelve rolling weeks; the last one starts now and is empty."""
    return series.buckets(fixtures.detections(spark, d), _W12, 7 * DAY, "acq_us", [F.count("*").alias("n")])


@query("agg_05_monthly", f"WITH {DET_SQL} SELECT strftime(make_timestamp(start_us), '%b %y') AS label, bucket::INT AS bucket, count(det_id) AS n {_series_sql(_M12, 30 * DAY, '')}")
def agg_05(spark, d):
    rows = series.buckets(fixtures.detections(spark, d), _M12, 30 * DAY, "acq_us", [F.count("*").alias("n")])
    return rows.select(F.date_format(F.timestamp_micros("start_us"), "MMM yy").alias("label"), "bucket", "n")


_PIVOT = ", ".join(f"count(det_id) FILTER (WHERE classification = '{c}') AS c{k}" for k, c in enumerate(scoring.CLASSES))


@query("agg_06_class_day_pivot", f"WITH {_CLASS_SQL} SELECT bucket::INT AS bucket, {_PIVOT} {_series_sql(_D14, DAY, '', 'cls')}")
def agg_06(spark, d):
    counts = [F.count_if(F.col("classification") == c).alias(f"c{k}") for k, c in enumerate(scoring.CLASSES)]
    return series.buckets(classes(spark, d), _D14, DAY, "acq_us", counts).drop("start_us")


@query("agg_07_industrial_wildfire", f"WITH {_CLASS_SQL} SELECT bucket::INT AS bucket, count(det_id) FILTER (WHERE classification IN ('Industrial Fire', 'Gas Flare')) AS industrial, count(det_id) FILTER (WHERE classification = 'Wildfire') AS wildfire {_series_sql(_D8, DAY, '', 'cls')}")
def agg_07(spark, d):
    kinds = [F.count_if(F.col("classification").isin("Industrial Fire", "Gas Flare")).alias("industrial"), F.count_if(F.col("classification") == "Wildfire").alias("wildfire")]
    return series.buckets(classes(spark, d), _D8, DAY, "acq_us", kinds).drop("start_us")


@query("agg_08_averages", on_scored("SELECT round(coalesce(avg(class_confidence) * 1e2, 0), 1) AS confidence, round(coalesce(avg(risk), 0), 1) AS risk FROM scored"))
def agg_08(spark, d):
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 1)
    return scored(spark, d).agg(mean(F.col("class_confidence") * 100.0).alias("confidence"), mean("risk").alias("risk"))


@query("agg_09_timeline", f"WITH {DET_SQL} SELECT acq_us // {DAY} AS day, count(*) AS n FROM det WHERE acq_us >= {NOW // DAY * DAY - 10 * DAY} GROUP BY day")
def agg_09(spark, d):
    rows = fixtures.detections(spark, d).filter(F.col("acq_us") >= NOW // DAY * DAY - 10 * DAY)
    return rows.groupBy(F.floor(F.col("acq_us") / F.lit(DAY)).alias("day")).agg(F.count("*").alias("n"))


@query("agg_10_stats", f"""WITH {_CLASS_SQL}, s AS (SELECT count(*) AS total, count(*) FILTER (WHERE acq_us >= {NOW - 7 * DAY}) AS this_week,
count(*) FILTER (WHERE acq_us >= {NOW - 14 * DAY} AND acq_us < {NOW - 7 * DAY}) AS last_week, count(*) FILTER (WHERE classification = 'Wildfire') AS wildfires FROM cls)
SELECT *, round(CASE WHEN last_week = 0 THEN 0e0 ELSE (this_week - last_week) * 1e2 / last_week END, 1) AS change FROM s""")
def agg_10(spark, d):
    us = F.col("acq_us")
    rows = classes(spark, d).agg(
        F.count("*").alias("total"),
        F.count_if(us >= NOW - 7 * DAY).alias("this_week"),
        F.count_if((us >= NOW - 14 * DAY) & (us < NOW - 7 * DAY)).alias("last_week"),
        F.count_if(F.col("classification") == "Wildfire").alias("wildfires"),
    )
    change = F.when(F.col("last_week") == 0, 0.0).otherwise((F.col("this_week") - F.col("last_week")) * 100.0 / F.col("last_week"))
    return rows.withColumn("change", F.round(change, 1))


@query("agg_11_frames", f"WITH {DET_SQL} SELECT acq_us // {DAY} AS day, count(*) AS n, sha256(string_agg(det_id::VARCHAR, ',' ORDER BY det_id)) AS members FROM det GROUP BY day")
def agg_11(spark, d):
    """Playback frames: each day's detections, as a count and a digest of the ordered list."""
    from emberline.operators.digest import ordered_digests

    rows = fixtures.detections(spark, d).select(F.floor(F.col("acq_us") / F.lit(DAY)).alias("day"), "det_id", F.col("det_id").cast("string").alias("id"))
    return ordered_digests(rows, "day", ["det_id"], "id", ",").withColumnRenamed("digest", "members")


@query("agg_15_active_days", f"WITH {DET_SQL} SELECT site_id, count(DISTINCT acq_us // {DAY}) AS days, count(DISTINCT CASE WHEN acq_us >= {NOW - 7 * DAY} THEN acq_us // {DAY} END) AS days_7 FROM det GROUP BY site_id")
def agg_15(spark, d):
    day = F.floor(F.col("acq_us") / F.lit(DAY))
    return fixtures.detections(spark, d).groupBy("site_id").agg(F.count_distinct(day).alias("days"), F.count_distinct(F.when(F.col("acq_us") >= NOW - 7 * DAY, day)).alias("days_7"))


@query("agg_16_median_std", f"WITH {DET_SQL} SELECT site_id, round(median(frp), 6) AS frp_median, round(stddev_pop(frp), 6) AS frp_std, round(avg(brightness), 6) AS brightness_mean FROM det GROUP BY site_id")
def agg_16(spark, d):
    rows = fixtures.detections(spark, d).groupBy("site_id")
    return rows.agg(F.round(F.median("frp"), 6).alias("frp_median"), F.round(F.stddev_pop("frp"), 6).alias("frp_std"), F.round(F.avg("brightness"), 6).alias("brightness_mean"))


_NULLS = ("frp", "brightness", "daynight", "satellite", "confidence")


@query("agg_19_nulls", f"WITH {DET_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) - count({c}) AS nulls, round((count(*) - count({c})) * 1e2 / count(*), 6) AS percent FROM det" for c in _NULLS))
def agg_19(spark, d):
    """Nulls of each column in one pass, then a row for each column."""
    counts = fixtures.detections(spark, d).agg(F.count("*").alias("total"), *[F.count(c).alias(c) for c in _NULLS])
    rows = counts.unpivot("total", list(_NULLS), "name", "known")
    nulls = F.col("total") - F.col("known")
    return rows.select("name", nulls.alias("nulls"), F.round(nulls * 100.0 / F.col("total"), 6).alias("percent"))


@query("agg_24_patterns", on_scored("SELECT pattern, land_cover, count(*) AS n FROM scored GROUP BY ALL"))
def agg_24(spark, d):
    return scored(spark, d).groupBy("pattern", "land_cover").agg(F.count("*").alias("n"))


@query("agg_28_alert_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS investigating, count(*) FILTER (WHERE o_orderstatus = 'O') AS new, count(*) FILTER (WHERE o_totalprice > 300000) AS critical FROM orders")
def agg_28(spark, d):
    return fixtures.alerts(spark, d).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "INVESTIGATING").alias("investigating"), F.count_if(F.col("status") == "NEW").alias("new"), F.count_if(F.col("severity") == "CRITICAL").alias("critical")
    )


@query("agg_29_peak", f"""WITH {DET_SQL}, days AS (SELECT state, acq_us // {DAY} AS day, count(*) AS n FROM det GROUP BY ALL)
SELECT state, sum(n)::BIGINT AS total, round(sum(n) / count(*)) AS per_day, arg_max(day, (n, -day)) AS peak FROM days GROUP BY state""")
def agg_29(spark, d):
    days = fixtures.detections(spark, d).groupBy("state", F.floor(F.col("acq_us") / F.lit(DAY)).alias("day")).agg(F.count("*").alias("n"))
    return days.groupBy("state").agg(
        F.sum("n").alias("total"), F.round(F.sum("n") / F.count("*")).alias("per_day"), F.max_by("day", F.struct("n", -F.col("day"))).alias("peak")
    )


ZOOM, TILE = 6, 256


@query("agg_30_map_clusters", f"""WITH {DET_SQL} SELECT floor((lon + 18e1) / 36e1 * {TILE << ZOOM} / 48e0)::BIGINT AS x,
floor((1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / pi()) / 2e0 * {TILE << ZOOM} / 48e0)::BIGINT AS y, count(*) AS n FROM det GROUP BY ALL""")
def agg_30(spark, d):
    """Marker clusters: Web Mercator squares of 48 pixels at a zoom level."""
    lat = F.radians("lat")
    pixels = float(TILE << ZOOM)
    x = F.floor((F.col("lon") + 180.0) / 360.0 * pixels / 48.0)
    y = F.floor((1.0 - F.log(F.tan(lat) + 1.0 / F.cos(lat)) / F.pi()) / 2.0 * pixels / 48.0)
    return fixtures.detections(spark, d).groupBy(x.alias("x"), y.alias("y")).agg(F.count("*").alias("n"))


@query("agg_32_latest_validation", on_scored("SELECT site_id, validation FROM latest"))
def agg_32(spark, d):
    return fixtures.validations(fixtures.hotspots(spark, d)).groupBy("site_id").agg(F.max_by("status", "validation_id").alias("validation"))


@query("win_03_since_previous", f"WITH {DET_SQL} SELECT det_id, round((acq_us - lag(acq_us) OVER (PARTITION BY site_id ORDER BY acq_us, det_id)) / 3.6e9, 6) AS hours FROM det")
def win_03(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("site_id").orderBy("acq_us", "det_id")
    return fixtures.detections(spark, d).select("det_id", F.round((F.col("acq_us") - F.lag("acq_us").over(w)) / F.lit(3.6e9), 6).alias("hours"))


_TRAIL = {"d1": 1, "d7": 7, "d30": 30}


@query("win_05_trailing", f"WITH {DET_SQL} SELECT det_id, " + ", ".join(f"count(*) OVER (PARTITION BY site_id ORDER BY acq_us RANGE BETWEEN {n * DAY} PRECEDING AND 1 PRECEDING) AS {c}" for c, n in _TRAIL.items()) + " FROM det")
def win_05(spark, d):
    """Counts of a site's detections in the days before each: the lower end counts, the detection's own time doesn't."""
    from pyspark.sql import Window

    w = Window.partitionBy("site_id").orderBy("acq_us")
    return fixtures.detections(spark, d).select("det_id", *[F.count("*").over(w.rangeBetween(-n * DAY, -1)).alias(c) for c, n in _TRAIL.items()])


@query("win_08_previous_period", f"WITH {DET_SQL} SELECT state, count(*) FILTER (WHERE acq_us >= {NOW - 7 * DAY}) AS now_n, count(*) FILTER (WHERE acq_us BETWEEN {NOW - 14 * DAY} AND {NOW - 7 * DAY - 1}) AS before_n FROM det GROUP BY state")
def win_08(spark, d):
    us = F.col("acq_us")
    return fixtures.detections(spark, d).groupBy("state").agg(F.count_if(us >= NOW - 7 * DAY).alias("now_n"), F.count_if(us.between(NOW - 14 * DAY, NOW - 7 * DAY - 1)).alias("before_n"))


@query("win_09_prior_counts", f"WITH {DET_SQL} SELECT det_id, count(*) OVER (ORDER BY acq_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM det")
def win_09(spark, d):
    """Observations before each one, at all places."""
    rows = fixtures.detections(spark, d).select("det_id", "acq_us")
    before = series.sums_before(rows.withColumn("seen", F.lit(1)), "acq_us", "seen")
    return rows.join(before, "acq_us").select("det_id", F.col("before").alias("prior"))


@query("win_07_presence", f"""WITH {DET_SQL}, last AS (SELECT site_id, max(acq_us) AS us FROM det GROUP BY site_id), bins AS (SELECT site_id, us - 14 * {DAY} + k * {DAY} AS start_us, k FROM last, range(16) t(k))
SELECT bins.site_id, k::INT AS k, count(det_id) AS n FROM bins LEFT JOIN det ON det.site_id = bins.site_id AND acq_us >= start_us AND acq_us < start_us + {DAY} GROUP BY ALL""")
def win_07(spark, d):
    """Presence by day over the 14 days to a site's last detection: bins start at its time of day, and two more follow."""
    det = fixtures.detections(spark, d).select("site_id", "acq_us")
    last = det.groupBy("site_id").agg(F.max("acq_us").alias("last"))
    k = F.floor((F.col("acq_us") - F.col("last") + 14 * DAY) / F.lit(DAY)).cast("int")
    counts = det.join(last, "site_id").withColumn("k", k).filter(F.col("k").between(0, 15)).groupBy("site_id", "k").agg(F.count("*").alias("n"))
    bins = last.select("site_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    return bins.join(counts, ["site_id", "k"], "left").select("site_id", "k", F.coalesce("n", F.lit(0)).alias("n"))


@query("tmp_01_patterns", on_scored("SELECT site_id, n, active_days, round(mean_gap, 6) AS mean_gap, round(std_gap, 6) AS std_gap, round(persistence_score, 6) AS persistence_score, pattern FROM pat"))
def tmp_01(spark, d):
    from emberline.plans.hotspots import r6
    from emberline.plans.model import site_patterns

    rows = site_patterns(spark, d, fixtures.hotspots(spark, d))
    return rows.select("site_id", "n", "active_days", *r6("mean_gap", "std_gap", "persistence_score"), "pattern")
