"""Thermal detections, facilities, land cover and records around them, projected from the star schema tables.

Every definition is a deterministic expression of the given rows, so that the views grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import table

#: "Now" of all queries that look back in time: 2024-01-31 00:00:00 UTC, as microseconds.
NOW_US = 1_706_659_200_000_000
HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000

CATEGORIES = ("refinery", "factory", "power_plant", "mine", "settlement", "industrial_area", "oil_gas")
INDUSTRIAL = ("refinery", "factory", "power_plant", "mine", "industrial_area", "oil_gas")
SATELLITES = (("view", "VIIRS S-NPP"), ("click", "VIIRS NOAA-20"), ("purchase", "VIIRS NOAA-21"), ("signup", "MODIS Aqua"), ("error", "MODIS Terra"))
LAT = "8e0 + ((user_id * 7919) % 2900) / 1e2 + (((event_id * 37) % 1001) - 500) / 1e5"
LON = "68e0 + ((user_id * 6101) % 2900) / 1e2 + (((event_id * 53) % 1001) - 500) / 1e5"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nationkey, district, state)."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("n_name").alias("district"), F.col("r_name").alias("state"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each event: place, time, brightness, FRP, day or night, satellite, confidence, state and district."""
    events = table(spark, sf_dir, "events")
    satellite = F.lit(None).cast("string")
    for kind, name in SATELLITES:
        satellite = F.when(F.col("event_type") == kind, name).otherwise(satellite)
    hour = F.hour(F.col("ts").cast("timestamp"))
    rows = events.select(
        F.col("event_id").alias("det_id"),
        F.col("user_id").alias("site_id"),
        F.expr("unix_micros(cast(ts as timestamp))").alias("acq_us"),
        F.expr(LAT).alias("lat"),
        F.expr(LON).alias("lon"),
        F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("frp"),
        F.when(F.col("event_id") % 101 != 0, F.lit(300.0) + 0.8 * F.least("value", F.lit(150.0))).alias("brightness"),
        F.when(F.col("event_id") % 89 != 0, F.when(hour.between(6, 17), "D").otherwise("N")).alias("daynight"),
        satellite.alias("satellite"),
        (F.get_json_object("props", "$.k").cast("bigint") / F.lit(100.0)).alias("confidence"),
        (F.col("user_id") % 25).cast("int").alias("_nation"),
    )
    return rows.join(regions(spark, sf_dir), F.col("_nation") == F.col("n_nationkey")).drop("_nation", "n_nationkey")


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(facility_id, ord, category, name, lat_r, lon_r)."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("facility_id"),
        F.col("s_suppkey").alias("ord"),
        F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("s_suppkey") % 7 + 1).cast("int")).alias("category"),
        F.col("s_name").alias("name"),
        F.expr("8e0 + ((s_suppkey * 7919) % 2900) / 1e2 + (s_suppkey % 5) * 2e-2").alias("lat_r"),
        F.expr("68e0 + ((s_suppkey * 6101) % 2900) / 1e2").alias("lon_r"),
    )


def land_cover(spark: SparkSession) -> DataFrame:
    """Boxes of 0.1 degrees around the sites 0 to 24, covered by their neighbourhood of 2 degrees: (box_id, kind, south, north, west, east)."""
    k = F.col("id")
    rows = spark.range(25).select(
        k.alias("box_id"),
        F.when(k % 3 == 0, "forest").when(k % 3 == 1, "agriculture").otherwise("urban").alias("kind"),
        F.expr("8e0 + ((id * 7919) % 2900) / 1e2").alias("lat0"),
        F.expr("68e0 + ((id * 6101) % 2900) / 1e2").alias("lon0"),
    )
    return rows.select("box_id", "kind", (F.col("lat0") - 0.05).alias("south"), (F.col("lat0") + 0.05).alias("north"), (F.col("lon0") - 0.05).alias("west"), (F.col("lon0") + 0.05).alias("east"))


def _boxes(rows: DataFrame, half: float, shift: float, *keep) -> DataFrame:
    """(keep..., rings) with a square around (lat_r, lon_r), moved by ``shift`` degrees both ways."""
    corner = lambda dy, dx: F.struct((F.col("lon_r") + (shift + dx)).alias("lon"), (F.col("lat_r") + (shift + dy)).alias("lat"))
    ring = F.array(*[corner(dy, dx) for dy, dx in ((-half, -half), (-half, half), (half, half), (half, -half), (-half, -half))])
    return rows.select(*keep, F.array(ring).alias("rings"))


def land_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature_id, kind, facility_type, landcover, rings): the land-cover boxes, the footprints of every third industrial facility (under its own id), and
    cells of industrial land near every eleventh facility."""
    corner = lambda lat, lon: F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    ring = F.array(*[corner(*c) for c in (("south", "west"), ("south", "east"), ("north", "east"), ("north", "west"), ("south", "west"))])
    none = F.lit(None).cast("string").alias("facility_type")
    boxes = land_cover(spark).select((F.col("box_id") + 1_000_000_000).alias("feature_id"), "kind", none, F.lit(True).alias("landcover"), F.array(ring).alias("rings"))
    place, industrial = facilities(spark, sf_dir), F.lit("industrial").alias("kind")
    prints = _boxes(place.filter("facility_id % 3 = 0 and category <> 'settlement'"), 0.01, 0.0, F.col("facility_id").alias("feature_id"), industrial, F.col("category").alias("facility_type"), F.lit(False).alias("landcover"))
    cells = _boxes(place.filter("facility_id % 11 = 5"), 0.03, 0.1, (F.col("facility_id") + 2_000_000_000).alias("feature_id"), industrial, none, F.lit(True).alias("landcover"))
    return boxes.unionByName(prints).unionByName(cells)


def surveyed(spark: SparkSession) -> DataFrame:
    """(kind, rings): where each kind of land cover was surveyed: a degree around each of its boxes, and for industry one region as large as a country."""
    edges = [(F.col(c) + by).alias(c) for c, by in (("south", -1), ("north", 1), ("west", -1), ("east", 1))]
    region = spark.range(1).select(F.lit("industrial").alias("kind"), *[F.lit(v).alias(c) for c, v in (("south", 10.0), ("north", 28.0), ("west", 70.0), ("east", 92.0))])
    corner = lambda lat, lon: F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    ring = F.array(*[corner(*c) for c in (("south", "west"), ("south", "east"), ("north", "east"), ("north", "west"), ("south", "west"))])
    return land_cover(spark).select("kind", *edges).unionByName(region).select("kind", F.array(ring).alias("rings"))


def administrative(spark: SparkSession) -> DataFrame:
    """(feature_id, rings): areas of seven by seven degrees, which overlap by one, south and west of 36 degrees and 96."""
    cell = spark.range(20).select(F.col("id").alias("feature_id"), (F.lit(7.0) + F.floor(F.col("id") / 5) * 6.0 + 3.5).alias("lat_r"), (F.lit(67.0) + F.col("id") % 5 * 6.0 + 3.5).alias("lon_r"))
    return _boxes(cell, 3.5, 0.0, "feature_id")


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest detection of each site that has brightness and FRP; ``n_history`` counts the site's detections before it."""
    det = detections(spark, sf_dir)
    good = det.filter("brightness is not null and frp is not null")
    fields = ["acq_us", "det_id", "lat", "lon", "frp", "brightness", "daynight", "satellite", "confidence", "state", "district"]
    return good.groupBy("site_id").agg(F.max(F.struct(*fields)).alias("d")).select("site_id", *[F.col(f"d.{c}").alias(c) for c in fields])


def validations(hot: DataFrame) -> DataFrame:
    """Two satellite validations for each sixth site: (validation_id, site_id, status)."""
    statuses = ("CONFIRMED", "LIKELY", "UNCERTAIN", "NOT VALIDATED")
    k = F.explode(F.array(F.lit(0), F.lit(1)))
    rows = hot.filter("site_id % 6 = 0").select("site_id", k.alias("k"))
    status = F.element_at(F.array(*map(F.lit, statuses)), ((F.col("site_id") + F.col("k")) % 4 + 1).cast("int"))
    return rows.select((F.col("site_id") * 2 + F.col("k")).alias("validation_id"), "site_id", status.alias("status"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions of event labels, from lineitem: (event_key, revision, label, review_status, quality, confidence)."""
    labels = ("Industrial Fire", "Gas Flare", "Wildfire", "Agricultural Burning", "Other", "Unknown")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event_key"),
        F.col("l_linenumber").alias("revision"),
        F.element_at(F.array(*map(F.lit, labels)), (F.col("l_partkey") % 6 + 1).cast("int")).alias("label"),
        F.when(F.col("l_linestatus") == "F", "approved").otherwise("draft").alias("review_status"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("quality"),
        (F.lit(1.0) - F.col("l_discount") * 4).alias("confidence"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of events, from lineitem: (prediction_id, event_key, predicted, probability)."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("prediction_id"),
        F.col("l_orderkey").alias("event_key"),
        F.when(F.col("l_returnflag") == "R", "Gas Flare").when(F.col("l_returnflag") == "A", "Wildfire").otherwise("Other").alias("predicted"),
        (F.lit(1.0) - F.col("l_tax") * 5).alias("probability"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts, from orders: (alert_id, site_id, status, severity, kind, created)."""
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "RESOLVED").when(F.col("o_orderstatus") == "O", "NEW").otherwise("INVESTIGATING")
    severity = F.when(F.col("o_totalprice") > 300000, "CRITICAL").when(F.col("o_totalprice") > 150000, "HIGH").otherwise("MODERATE")
    return orders.select(
        F.col("o_orderkey").alias("alert_id"),
        F.col("o_custkey").alias("site_id"),
        status.alias("status"),
        severity.alias("severity"),
        F.when(F.col("o_orderkey") % 3 == 0, "industrial_fire").otherwise("risk").alias("kind"),
        F.col("o_orderdate").alias("created"),
    )
