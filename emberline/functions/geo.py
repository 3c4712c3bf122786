"""Geography as column expressions: degrees in, kilometres out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0)
    )
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def valid_coordinates(lat, lon) -> Column:
    """False for null, NaN and out-of-range coordinates."""
    lat, lon = col(lat), col(lon)
    good = lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(good, F.lit(False))


def box_distance_km(lat, lon, south, north, west, east) -> Column:
    """Distance to an axis-aligned box; 0 inside and on its border."""
    near_lat = F.least(F.greatest(col(lat), col(south)), col(north))
    near_lon = F.least(F.greatest(col(lon), col(west)), col(east))
    return haversine_km(lat, lon, near_lat, near_lon)


def in_box(lat, lon, south, north, west, east) -> Column:
    return col(lat).between(col(south), col(north)) & col(lon).between(col(west), col(east))


def centroid(lat, lon) -> tuple[Column, Column]:
    """Aggregates: latitude and longitude of the mean unit vector, which is safe at the date line."""
    lat, lon = F.radians(col(lat)), F.radians(col(lon))
    x, y, z = F.avg(F.cos(lat) * F.cos(lon)), F.avg(F.cos(lat) * F.sin(lon)), F.avg(F.sin(lat))
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def wkt_point(lat, lon) -> Column:
    return F.concat(F.lit("POINT("), col(lon).cast("string"), F.lit(" "), col(lat).cast("string"), F.lit(")"))


def geojson_point(lat, lon) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(col(lon), col(lat)).alias("coordinates"))


def ring_covers(lon, lat, ring) -> Column:
    """Whether a closed ring (array of structs lon, lat) covers a point; its border counts as inside.

    Even-odd rule over the ring's edges, in one fold without a Python function.
    """
    x, y, ring = col(lon), col(lat), col(ring)
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"), F.slice(ring, 2, F.size(ring) - 1).alias("q"))

    def on(e: Column) -> Column:
        (ax, ay), (bx, by) = ((e[k]["lon"], e[k]["lat"]) for k in ("p", "q"))
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        return (F.abs(cross) < 1e-12) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))

    def passes(e: Column) -> Column:
        (ax, ay), (bx, by) = ((e[k]["lon"], e[k]["lat"]) for k in ("p", "q"))
        return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)

    return F.exists(edges, on) | (F.size(F.filter(edges, passes)) % 2 == 1)


def polygon_covers(lon, lat, rings) -> Column:
    """The same for a polygon: an outer ring, then holes, whose borders still belong to the polygon."""
    rings = col(rings)
    inside = lambda ring: ring_covers(lon, lat, ring)
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    in_hole = F.exists(holes, lambda h: inside(h) & ~_on_border(lon, lat, h))
    return (F.size(rings) > 0) & inside(F.get(rings, F.lit(0))) & ~in_hole


def _on_border(lon, lat, ring: Column) -> Column:
    x, y = col(lon), col(lat)
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"), F.slice(ring, 2, F.size(ring) - 1).alias("q"))

    def on(e: Column) -> Column:
        (ax, ay), (bx, by) = ((e[k]["lon"], e[k]["lat"]) for k in ("p", "q"))
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        return (F.abs(cross) < 1e-12) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))

    return F.exists(edges, on)
