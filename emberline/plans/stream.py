"""Queries over what the stream leaves behind, and feeds that arrive as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators import clean
from emberline.plans.hotspots import _DUE
from emberline.plans.model import DET_SQL, HOT_SQL, on_scored
from emberline.plans.records import _RAW, raw_observations
from emberline.plans.registry import query, remembered
from emberline.session import scratch_path
from emberline.sources import fixtures
from emberline.sources.files import inline
from emberline.streaming import ingest as stream


def store(spark, d) -> str:
    """Where the stream put its tables, after two runs over what had landed.

    The first load brings all detections but the last usable one of each site. The second brings those, and each third detection of the first
    load once more with a higher FRP. Only the second is scored; alerts go by a lower bar than usual.
    """

    def run() -> str:
        landing, place, checkpoint = (scratch_path(spark, n) for n in ("landing", "store", "stream"))
        det, hot = fixtures.detections(spark, d), fixtures.hotspots(spark, d)
        names = [f.split()[0] for f in stream.SCHEMA.split(", ")]
        last = hot.select("det_id")
        old = det.join(last, "det_id", "left_anti").select(*names)
        validations = fixtures.validations(hot).groupBy("site_id").agg(F.max_by("status", "validation_id").alias("validation"))
        features = fixtures.facilities(spark, d).withColumnRenamed("facility_id", "feature_id")
        reference = stream.Reference(features, fixtures.land_cover(spark), validations)
        again = old.filter("det_id % 3 = 0").withColumn("frp", F.col("frp") + 1)
        for rows, scoring in ((old, False), (hot.select(*names).unionByName(again), True)):
            rows.write.mode("append").parquet(landing)
            stream.ingest(spark, landing, place, reference, checkpoint, scoring=scoring, least_risk=40.0, least_confidence=0.5).awaitTermination()
        return place

    return remembered(spark, d, "stream", lambda: spark.createDataFrame([(run(),)], "place string")).first().place


@query("str_02_upserted", f"""WITH {DET_SQL}, {HOT_SQL} SELECT det.det_id, round(det.frp + CASE WHEN hot.det_id IS NULL AND det.det_id % 3 = 0 THEN 1 ELSE 0 END, 6) AS frp, round(det.brightness, 6) AS brightness,
hot.det_id IS NOT NULL AS late FROM det LEFT JOIN hot ON hot.det_id = det.det_id""")
def str_02(spark, d):
    """The table of detections that the stream ends with: repeated deliveries update, the rest is added."""
    return stream.current(spark, store(spark, d)).select("det_id", F.round("frp", 6).alias("frp"), F.round("brightness", 6).alias("brightness"), (F.col("batch") > 0).alias("late"))


@query("str_03_scored", on_scored("SELECT det_id, site_id, classification, risk_level, pattern, validation, round(risk, 6) AS risk, round(class_confidence, 6) AS class_confidence FROM scored"))
def str_03(spark, d):
    """New detections as the stream scored them on arrival."""
    rows = spark.read.parquet(f"{store(spark, d)}/scored")
    return rows.select("det_id", "site_id", "classification", "risk_level", "pattern", "validation", F.round("risk", 6).alias("risk"), F.round("class_confidence", 6).alias("class_confidence"))


@query("str_04_alerts", on_scored(_DUE.format(r=40, c=0.5)))
def str_04(spark, d):
    """The alerts that the stream gave out for new detections."""
    return stream.alerts(spark, store(spark, d)).drop("batch")


def _windowed(spark, d, name: str, made) -> DataFrame:
    """What a windowed stream has given out in the end: detections land in four parts by time, the second and third swapped, and at last two rows of no
    site that lie a year ahead, so that the watermark passes all windows."""

    def run() -> DataFrame:
        landing, place = (scratch_path(spark, n) for n in ("landing", name))
        names = [f.split()[0] for f in stream.SCHEMA.split(", ")]
        det = fixtures.detections(spark, d).select(*names)
        ends = det.agg(F.min("acq_us").alias("a"), F.max("acq_us").alias("b")).first()
        cuts = [ends.a + (ends.b - ends.a) * k // 4 for k in range(4)] + [ends.b + 1]
        after = spark.createDataFrame([(-1, None, ends.b + 365 * fixtures.DAY_US)], "det_id long, site_id long, acq_us long")
        after = after.select(*[F.col(c) if c in after.columns else F.lit(None).cast(stream.SCHEMA.split(f"{c} ")[1].split(",")[0]).alias(c) for c in names])
        parts = [det.filter((F.col("acq_us") >= cuts[k]) & (F.col("acq_us") < cuts[k + 1])) for k in (0, 2, 1, 3)] + [after, after]
        checkpoint = scratch_path(spark, "stream")
        for part in parts:
            part.write.mode("append").parquet(landing)
            rows = spark.readStream.schema(stream.SCHEMA).parquet(landing)
            sink = made(rows).writeStream.format("parquet").option("path", place).option("checkpointLocation", checkpoint).outputMode("append")
            sink.trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(place).filter("site_id is not null")

    return remembered(spark, d, name, run)


@query("str_09_sessions", f"""WITH {DET_SQL}, s AS (SELECT *, sum((before IS NULL OR acq_us - before >= 6 * 3600000000)::INT) OVER (PARTITION BY site_id ORDER BY acq_us, det_id) AS k
FROM (SELECT *, lag(acq_us) OVER (PARTITION BY site_id ORDER BY acq_us, det_id) AS before FROM det))
SELECT site_id, min(acq_us) AS start_us, max(acq_us) AS last_us, count(*) AS n, round(max(frp), 6) AS max_frp FROM s GROUP BY site_id, k""")
def str_09_sessions(spark, d):
    """Runs of a site's detections less than six hours apart, as the stream gave them out."""
    rows = _windowed(spark, d, "sessions", lambda x: stream.sessions(x, "20 days", "6 hours"))
    return rows.select("site_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n", F.round("max_frp", 6).alias("max_frp"))


@query("str_09_sliding", f"""WITH {DET_SQL} SELECT site_id, start_us, count(*) AS n FROM (SELECT site_id, unnest(range(acq_us - acq_us % 21600000000 - 3 * 21600000000, acq_us - acq_us % 21600000000 + 1, 21600000000)) AS start_us FROM det) GROUP BY ALL""")
def str_09_sliding(spark, d):
    """Detections of each site in windows of a day, one every six hours, as the stream gave them out."""
    rows = _windowed(spark, d, "sliding", lambda x: stream.windowed_counts(x, "20 days", "1 day", "6 hours"))
    return rows.select("site_id", F.unix_micros("start").alias("start_us"), "n")


@query("src_04_inline", f"WITH {_RAW} SELECT source_row, latitude, longitude, frp, brightness, acquisition_us, daynight, satellite, CASE WHEN duplicate THEN 'duplicate' ELSE errors END AS problem FROM dup")
def src_04(spark, d):
    """Feeds as CSV texts, one for each observation, whose columns come in two orders: read and judged."""
    rows = raw_observations(spark, d)
    names = [c for c in rows.columns if c != "source_row"]

    def text(order: list[str]):
        return F.concat(F.lit(",".join(f'"{c}"' for c in order) + "\n"), F.to_csv(F.struct(*[F.col(f"`{c}`") for c in order])), F.lit("\n"))

    feeds = rows.select(F.col("source_row").alias("feed"), F.when(F.col("source_row") % 2 == 0, text(names)).otherwise(text(names[::-1])).alias("body"))
    read = inline(feeds, "feed", "body", ("latitude", "longitude", "bright_ti4", "frp", "acq_date", "acq_time", "daynight", "satellite", "confidence"))
    judged = clean.tagged(read.withColumn("source_row", F.col("feed")).drop("feed", "line"))
    problem = F.when(F.col("duplicate"), "duplicate").otherwise(F.array_join("errors", ";"))
    return judged.select("source_row", "latitude", "longitude", "frp", "brightness", "acquisition_us", "daynight", "satellite", problem.alias("problem"))
