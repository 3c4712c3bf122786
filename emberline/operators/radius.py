"""Joins within a radius."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.geo import EARTH_KM, haversine_km

KM_A_DEGREE = math.pi * EARTH_KM / 180


def _band(lat: Column, size: float) -> Column:
    return F.floor((lat + 90.0) / size)


def _cells_in_band(band: Column, size: float) -> Column:
    """How many cells a latitude band is parted into, so that each is about as wide as high; at least 1."""
    middle = F.least(F.abs(band * size - 90.0), F.abs((band + 1) * size - 90.0))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0 / size) * F.cos(F.radians(F.least(middle, F.lit(90.0))))))


def _cell(lon: Column, cells: Column) -> Column:
    return F.pmod(F.floor((lon + 180.0) / (F.lit(360.0) / cells)), cells)


def radius_join(left: DataFrame, right: DataFrame, km: float | Column, most_km: float, extra: list[tuple[Column, Column]] = ()) -> DataFrame:
    """All pairs of rows within ``km`` (a number, or a column of either side, at most ``most_km``) with ``distance_km``.

    ``left`` has lat, lon; ``right`` has lat_r, lon_r; names are otherwise disjoint. Both sides go to the cells of a grid
    of latitude bands whose cells keep their width in kilometres up to the poles; a left row goes to every cell that its
    circle can touch, across the date line too, so a pair meets exactly once. ``extra``: (left array column, right
    column) keys that must meet as well, such as time buckets.
    """
    size = min(180.0, most_km / KM_A_DEGREE)
    angle = min(math.pi, most_km / EARTH_KM)
    reach = math.degrees(angle)
    lat = F.radians(F.col("lat"))
    near_pole = F.abs(F.col("lat")) + reach >= 90.0
    wide = F.when(near_pole, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(angle, math.pi / 2))) / F.cos(lat)))))
    first, last = _band(F.greatest(F.col("lat") - reach, F.lit(-90.0)), size), _band(F.least(F.col("lat") + reach, F.lit(90.0)), size)
    rows = left.withColumn("_band", F.explode(F.sequence(first, last))).withColumn("_cells", _cells_in_band(F.col("_band"), size))
    step = F.lit(360.0) / F.col("_cells")
    low, high = F.floor((F.col("lon") - wide + 180.0) / step), F.floor((F.col("lon") + wide + 180.0) / step)
    rows = rows.withColumn("_cell", F.explode(F.transform(F.sequence(low, F.least(high, low + F.col("_cells") - 1)), lambda c: F.pmod(c, F.col("_cells")))))
    other = right.withColumn("_band", _band(F.col("lat_r"), size))
    other = other.withColumn("_cell", _cell(F.col("lon_r"), _cells_in_band(F.col("_band"), size)))
    keys = ["_band", "_cell"]
    for k, (mine, theirs) in enumerate(extra):
        rows, other = rows.withColumn(f"_key{k}", F.explode(mine)), other.withColumn(f"_key{k}", theirs)
        keys.append(f"_key{k}")
    pairs = rows.drop("_cells").join(other, keys).drop(*keys)
    within = F.lit(float(km)) if isinstance(km, (int, float)) else km
    return pairs.withColumn("distance_km", haversine_km("lat", "lon", "lat_r", "lon_r")).filter(F.col("distance_km") <= within)
