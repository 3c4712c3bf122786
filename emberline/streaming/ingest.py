"""Detections as a stream: each micro-batch is upserted, what it adds is scored, alerted on once, and summed up in a notice.

Which ids are known is state of the stream, and a site's history is read by day, so a batch costs its own rows and the days that it looks back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.operators.hotspots import digest, due_alerts, history_patterns, score, surroundings
from emberline.operators.series import DAY_US
from emberline.session import scratch_path

SCHEMA = "det_id long, site_id long, acq_us long, lat double, lon double, frp double, brightness double, daynight string, satellite string, confidence double, state string, district string"
#: The columns that a repeated delivery of a det_id replaces.
UPDATED = ("frp", "brightness")
LOG = SCHEMA + ", created boolean, batch long"
ALERTS = "code string, site_id long, kind string, severity string, batch long"


@dataclass(frozen=True)
class Reference:
    """What new detections are compared with: facilities (feature_id, ord, category, lat_r, lon_r), land-cover boxes, and the last validation of each site."""

    features: DataFrame
    covers: DataFrame
    validations: DataFrame


def _timed(rows: DataFrame, lateness: str) -> DataFrame:
    return rows.withColumn("ts", F.timestamp_micros("acq_us")).withWatermark("ts", lateness)


def windowed_counts(rows: DataFrame, lateness: str = "1 day", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """(start, site_id, n): detections in windows of ``width``, one after the other or, with ``slide``, one every ``slide``; each is given out when the
    watermark has passed it."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return _timed(rows, lateness).groupBy(window.alias("w"), "site_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "site_id", "n")


def sessions(rows: DataFrame, lateness: str = "1 day", gap: str = "6 hours") -> DataFrame:
    """(site_id, start, last, n, max_frp): runs of a site's detections less than ``gap`` apart. As a stream a session is kept open until the watermark has
    passed it by ``gap``, then given out and forgotten; a row that comes too late for that is dropped and counted (``late_rows``)."""
    timed = _timed(rows, lateness).withColumn("_us", F.col("acq_us"))
    found = timed.groupBy(F.session_window("ts", gap).alias("w"), "site_id").agg(F.max("_us").alias("last_us"), F.count("*").alias("n"), F.max("frp").alias("max_frp"))
    return found.select("site_id", F.col("w.start").alias("start"), F.timestamp_micros("last_us").alias("last"), "n", "max_frp")


def late_rows(query: StreamingQuery) -> int:
    """How many rows the query's watermark kept out, as far as it remembers its progress (``spark.sql.streaming.numRecentProgressUpdates``). An aggregation
    counts rows as they reach its state: after its partial sums."""
    return sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches of a table of the store; empty before the first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def log(spark: SparkSession, store: str) -> DataFrame:
    """Every delivery of every detection."""
    return _table(spark, f"{store}/log", LOG)


def alerts(spark: SparkSession, store: str) -> DataFrame:
    return _table(spark, f"{store}/alerts", ALERTS)


def current(spark: SparkSession, store: str) -> DataFrame:
    """The table of detections: each as its first delivery made it, with FRP and brightness of its last; ``batch`` is the first's."""
    rows = log(spark, store)
    kept = [c for c in rows.columns if c not in ("det_id", "created", *UPDATED)]
    one = rows.groupBy("det_id").agg(F.min_by(F.struct(*kept), "batch").alias("first"), F.max_by(F.struct(*UPDATED), "batch").alias("last"))
    return one.select("det_id", "first.*", "last.*")


def arrivals(rows: DataFrame) -> DataFrame:
    """A stream's rows (SCHEMA) by det_id with ``created``, whether this micro-batch is the first that has it; to be written in update mode.

    An id's first and last arrival are kept in the state store, so a batch costs its own rows whatever came before (at scale let
    ``spark.sql.streaming.stateStore.providerClass`` name the RocksDB provider: the state is as large as there are ids). Of several deliveries in a
    batch the latest by time counts; rows without det_id are left out. The time of a batch is in its offset log, so one that runs again gives the same.
    """
    fields = [c for c in rows.columns if c not in ("det_id", "acq_us")]
    stamped = rows.filter("det_id is not null").withColumn("_at", F.current_timestamp())
    each = stamped.groupBy("det_id").agg(F.min("_at").alias("_first"), F.max(F.struct("_at", "acq_us", *fields)).alias("_d"))
    return each.select("det_id", *[F.col(f"_d.{c}").alias(c) for c in rows.columns if c != "det_id"], (F.col("_first") == F.col("_d._at")).alias("created"))


def _held(spark: SparkSession, store: str, number: int) -> int:
    """How many alerts there were before a batch: the batch before says so, in one row."""
    before = f"{store}/totals/batch={number - 1}"
    place = spark._jvm.org.apache.hadoop.fs.Path(before)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema("alerts long").parquet(before).first().alerts
    return alerts(spark, store).filter(F.col("batch") < number).count()


def past_times(spark: SparkSession, store: str, number: int, first_us: int, last_us: int) -> DataFrame:
    """(site_id, acq_us) of the detections that batches up to ``number`` created, between two times: only the days between are read."""
    rows = _table(spark, f"{store}/times", "site_id long, acq_us long, batch long, day long")
    days = F.col("day").between(first_us // DAY_US, last_us // DAY_US)
    return rows.filter((F.col("batch") <= number) & days & F.col("acq_us").between(first_us, last_us)).select("site_id", "acq_us")


def take(spark: SparkSession, store: str, batch: DataFrame, number: int, reference: Reference, scoring: bool = True, least_risk: float = 80.0, least_confidence: float = 0.8, days: int = 14) -> None:
    """Takes in one batch of ``arrivals``. Everything goes under the batch's number and is made from that batch, reference and the ``days`` before its
    detections, so a batch that runs again replaces itself, and one costs the same however long the log is.

    Detections with FRP and brightness that are new are scored with their site's history; without ``scoring`` they are only stored, as a first load of
    history is. New ones without a time have no history to be in.
    """
    batch.write.mode("overwrite").parquet(f"{store}/log/batch={number}")
    now = spark.read.schema(LOG.removesuffix(", batch long")).parquet(f"{store}/log/batch={number}")
    created = now.filter("created")
    times = created.filter("acq_us is not null").select("site_id", "acq_us", F.floor(F.col("acq_us") / F.lit(DAY_US)).alias("day"))
    times.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{store}/times/batch={number}")
    held = _held(spark, store, number)
    if scoring:
        _judge(spark, store, created, number, reference, held, least_risk, least_confidence, days)
    added = alerts(spark, store).filter(F.col("batch") == number).count() if scoring else 0
    spark.range(1).select(F.lit(held + added).cast("long").alias("alerts")).write.mode("overwrite").parquet(f"{store}/totals/batch={number}")


def _judge(spark: SparkSession, store: str, created: DataFrame, number: int, reference: Reference, held: int, least_risk: float, least_confidence: float, days: int) -> None:
    """Scores, alerts and the notice of a batch's new detections."""
    new = created.filter(F.col("frp").isNotNull() & F.col("brightness").isNotNull()).drop("created")
    span = new.agg(F.min("acq_us").alias("first"), F.max("acq_us").alias("last")).first()
    # the scoring operators go by site_id; here each detection is a place of its own, with the history of its site
    hot = new.withColumnRenamed("site_id", "site").withColumn("site_id", F.col("det_id"))
    past = past_times(spark, store, number, (span.first or 0) - days * DAY_US, span.last or 0) if span.first is not None else past_times(spark, store, -1, 0, 0)
    history = past.withColumnRenamed("site_id", "site").join(hot.select("site", "site_id"), "site").select("site_id", "acq_us")
    latest = hot.select("site", "site_id").join(reference.validations.withColumnRenamed("site_id", "site"), "site").select("site_id", "validation")
    scored = score(hot, surroundings(hot, reference.features, reference.covers), history_patterns(hot, history, days), latest)
    scored.drop("site_id").withColumnRenamed("site", "site_id").write.mode("overwrite").parquet(f"{store}/scored/batch={number}")
    scored = spark.read.parquet(f"{store}/scored/batch={number}")
    due_alerts(scored, least_risk, least_confidence, held, ("site_id", "det_id")).write.mode("overwrite").parquet(f"{store}/alerts/batch={number}")
    due = alerts(spark, store).filter(F.col("batch") == number)
    digest(due.withColumn("title", F.col("kind")), "batch").withColumnRenamed("batch", "of").write.mode("overwrite").parquet(f"{store}/notices/batch={number}")


#: Seconds between two looks at the source, by default and at least.
INTERVAL, LEAST_INTERVAL = 900, 120


def ingest(spark: SparkSession, source: str, store: str, reference: Reference, checkpoint: str | None = None, seconds: int | None = None, files: int | None = None, **options) -> StreamingQuery:
    """Reads Parquet files as they land in ``source``: every ``seconds`` (0: INTERVAL; never under LEAST_INTERVAL), or without that until none is left; at most
    ``files`` a batch. ``options`` go to ``take``.

    A run goes on from ``checkpoint``; only there is it known which files were read and which ids came. While a store's query runs, a second call
    gives back that one.
    """
    for running in spark.streams.active:
        if running.name == store:
            return running
    reader = spark.readStream.schema(SCHEMA)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
    writer = arrivals(rows).writeStream.queryName(store).outputMode("update").foreachBatch(lambda batch, number: take(spark, store, batch, number, reference, **options))
    writer = writer.option("checkpointLocation", checkpoint or scratch_path(spark, "stream"))
    if seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{max(LEAST_INTERVAL, seconds or INTERVAL)} seconds").start()
