"""Nearest features by descending two trees of cells together: one over the points that ask, one over the features.

Cells of a level are parted into five by five on the next. A pair of cells has a least and a largest possible distance, from the
boxes around what is really in them; per cell that asks, only feature cells stay that can hold a nearest one. So a pair of cells
is looked into only if it may matter, however far the nearest feature is, and only the last level's few are joined row by row.
The depth follows from the data: cells are parted until none has more than LEAF features, or they are some 300 metres wide.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.geo import EARTH_KM, haversine_km, valid_coordinates
from emberline.session import discard, stored

KM_A_DEGREE = math.pi * EARTH_KM / 180
#: Degrees of the finest cells, and how many times five of them make one of the coarsest (45 degrees).
FINEST, LEVELS = 0.00288, 7
LEAF = 64
_BOX = ("south", "north", "west", "east")
#: (distance of two boxes, given as dicts of columns): what no pair of their contents goes below, or beyond.
Bound = Callable[[dict[str, Column], dict[str, Column]], Column]


def _parent(c: str, level: int) -> Column:
    return F.floor(F.col(c) / 5 ** (LEVELS - 1 - level))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with a box get the finest cell of its middle."""
    return rows.withColumns({"_y": F.floor(((F.col("south") + F.col("north")) / 2 + 90.0) / FINEST), "_x": F.floor(((F.col("west") + F.col("east")) / 2 + 180.0) / FINEST)})


def _cells(placed: DataFrame, by: list[str]) -> DataFrame:
    ends = [(F.min if c in ("south", "west") else F.max)(c).alias(c) for c in _BOX]
    return stored(placed.groupBy(*by, "_y", "_x").agg(*ends, F.count("*").alias("n")), "cells")


def _level(cells: DataFrame, by: list[str], level: int, name: str) -> DataFrame:
    """A level's cells with boxes ({name}_south...), and the cells (_{name}y, _{name}x) of the level above that they are in."""
    ends = [(F.min if c in ("south", "west") else F.max)(c).alias(f"{name}_{c}") for c in _BOX]
    rows = cells.groupBy(*by, _parent("_y", level).alias(f"{name}y"), _parent("_x", level).alias(f"{name}x")).agg(*ends)
    return rows.withColumns({f"_{name}y": F.floor(F.col(f"{name}y") / 5), f"_{name}x": F.floor(F.col(f"{name}x") / 5)})


def _depth(features: DataFrame, group: str) -> int:
    """The first level, from the third on, with at most LEAF features in each cell."""
    levels = F.explode(F.sequence(F.lit(2), F.lit(LEVELS - 1))).alias("level")
    wide = F.pow(F.lit(5.0), F.lit(LEVELS - 1) - F.col("level"))
    rows = features.select(group, "_y", "_x", "n", levels).groupBy(group, "level", F.floor(F.col("_y") / wide), F.floor(F.col("_x") / wide)).agg(F.sum("n").alias("n"))
    most = {r.level: r.n for r in rows.groupBy("level").agg(F.max("n").alias("n")).collect()}
    return next((k for k in sorted(most) if most[k] <= LEAF), LEVELS - 1)


def _candidates(queries: DataFrame, features: DataFrame, group: str, depth: int, lower: Bound, upper: Bound) -> DataFrame:
    """(qy, qx, group, fy, fx): the feature cells of a level in which a nearest feature of what is in a query cell can be."""
    box = lambda name: {c: F.col(f"{name}_{c}") for c in _BOX}
    found = None
    for level in range(depth + 1):
        q, f = _level(queries, [], level, "q"), _level(features, [group], level, "f")
        if found is None:
            # the coarsest level has at most 5 times 9 cells
            all_cells = q.withColumn("fy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).withColumn("fx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))))
            pairs = all_cells.join(f, ["fy", "fx"])
        else:
            above = found.select(F.col("qy").alias("_qy"), F.col("qx").alias("_qx"), group, F.col("fy").alias("_fy"), F.col("fx").alias("_fx"))
            pairs = above.join(q, ["_qy", "_qx"]).join(f, [group, "_fy", "_fx"])
        pairs = pairs.select("qy", "qx", group, "fy", "fx", lower(box("q"), box("f")).alias("lo"), upper(box("q"), box("f")).alias("hi"))
        least = F.min("hi").over(Window.partitionBy("qy", "qx", group))
        found = pairs.withColumn("least", least).filter(F.col("lo") <= F.col("least") + 1e-6).select("qy", "qx", group, "fy", "fx")
    return found


def nearest_pairs(points: DataFrame, features: DataFrame, group: str, lower: Bound, upper: Bound) -> tuple[DataFrame, list[DataFrame]]:
    """Rows of ``points`` (lat, lon) with rows of ``features`` (the group column, south, north, west, east), among them each point's nearest feature
    of each group; and the stored tables that this reads. Points and features without valid coordinates meet nothing."""
    points = points.filter(valid_coordinates("lat", "lon"))
    boxes = {"south": F.col("lat"), "north": F.col("lat"), "west": F.col("lon"), "east": F.col("lon")}
    placed = _placed(points.withColumns(boxes))
    features = _placed(features.filter(valid_coordinates("south", "west") & valid_coordinates("north", "east")))
    q_cells, f_cells = _cells(placed, []), _cells(features, [group])
    depth = _depth(f_cells, group)
    found = _candidates(q_cells, f_cells, group, depth, lower, upper)
    asking = placed.drop(*_BOX).withColumns({"qy": _parent("_y", depth), "qx": _parent("_x", depth)}).drop("_y", "_x")
    given = features.withColumns({"fy": _parent("_y", depth), "fx": _parent("_x", depth)}).drop("_y", "_x")
    return asking.join(found, ["qy", "qx"]).join(given, [group, "fy", "fx"]).drop("qy", "qx", "fy", "fx"), [q_cells, f_cells]


def _centre(box: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Latitude, longitude, and kilometres that reach everything in the box: along the meridian, then along the wider parallel."""
    s, n, w, e = (box[c] for c in _BOX)
    flat = F.when((s <= 0) & (n >= 0), F.lit(0.0)).otherwise(F.least(F.abs(s), F.abs(n)))
    return (s + n) / 2, (w + e) / 2, ((n - s) / 2 + (e - w) / 2 * F.cos(F.radians(flat))) * F.lit(KM_A_DEGREE)


def sphere_lower(a: dict[str, Column], b: dict[str, Column]) -> Column:
    (alat, alon, ar), (blat, blon, br) = _centre(a), _centre(b)
    return haversine_km(alat, alon, blat, blon) - ar - br


def sphere_upper(a: dict[str, Column], b: dict[str, Column]) -> Column:
    (alat, alon, ar), (blat, blon, br) = _centre(a), _centre(b)
    return haversine_km(alat, alon, blat, blon) + ar + br


def _spans(a: dict[str, Column], b: dict[str, Column]) -> tuple[Column, Column, Column, Column, Column]:
    """Least and largest differences of latitude and of longitude; the largest latitude of ``a`` without its sign."""
    zero = F.lit(0.0)
    lat = F.greatest(zero, b["south"] - a["north"], a["south"] - b["north"]), F.greatest(b["north"] - a["south"], a["north"] - b["south"])
    lon = F.greatest(zero, b["west"] - a["east"], a["west"] - b["east"]), F.greatest(b["east"] - a["west"], a["east"] - b["west"])
    return *lat, *lon, F.greatest(F.abs(a["south"]), F.abs(a["north"]))


def plane_lower(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """In the plane that touches the earth at a point of ``a``."""
    lat, _, lon, _, steep = _spans(a, b)
    return F.hypot(lat, lon * F.cos(F.radians(steep))) * F.lit(KM_A_DEGREE)


def plane_upper(a: dict[str, Column], b: dict[str, Column]) -> Column:
    _, lat, _, lon, _ = _spans(a, b)
    flat = F.when((a["south"] <= 0) & (a["north"] >= 0), F.lit(0.0)).otherwise(F.least(F.abs(a["south"]), F.abs(a["north"])))
    return F.hypot(lat, lon * F.cos(F.radians(flat))) * F.lit(KM_A_DEGREE)


def nearest(points: DataFrame, features: DataFrame, group: str) -> DataFrame:
    """(point_id, group, distance_km, feature_id): for each point and group the nearest feature on the sphere, ties to the least ``ord``.

    ``points``: point_id, lat, lon. ``features``: feature_id, ord, the group column, lat_r, lon_r; of features at one place only the first is compared.
    """
    at = features.groupBy(group, "lat_r", "lon_r").agg(F.min(F.struct("ord", "feature_id")).alias("first"))
    boxes = {"south": F.col("lat_r"), "north": F.col("lat_r"), "west": F.col("lon_r"), "east": F.col("lon_r")}
    pairs, read = nearest_pairs(points.select("point_id", "lat", "lon"), at.withColumns(boxes), group, sphere_lower, sphere_upper)
    best = pairs.groupBy("point_id", group).agg(F.min(F.struct(haversine_km("lat", "lon", "lat_r", "lon_r").alias("km"), "first")).alias("m"))
    out = stored(best.select("point_id", group, F.col("m.km").alias("distance_km"), F.col("m.first.feature_id").alias("feature_id")), "nearest")
    discard(*read)
    return out
