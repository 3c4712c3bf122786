"""Polygons of any size: a grid for each size, exact cover of circles, distances to outlines.

A polygon is covered by cells of its own size class, about as many as it has corners, so a country and a tank meet the points
near them at the same cost. A cell keeps the edges that touch it and whether its reference place is inside; cells that no edge
touches are kept only inside the polygon. A point is looked up once in each size class that occurs (a handful), and decided by its
cell's edges alone: the way from the reference place to the point, along the cell's own row and column, changes sides with
every edge it crosses.

A polygon is `rings`, arrays of corners (lon, lat), closed, an outer one and holes, in any direction; what is inside an odd number of
rings is inside, and so are all borders. Equal rows are one polygon. Coordinates are planar degrees: no polygon crosses the date line.
Polygons without rings, and points without valid coordinates, meet nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.geo import col, valid_coordinates
from emberline.operators.nearness import KM_A_DEGREE, nearest_pairs, plane_lower, plane_upper
from emberline.operators.radius import radius_join
from emberline.session import stored

#: Most cells along a polygon's longer side (but one), and degrees of the longest piece of an edge where nearest ones are looked for.
MOST_CELLS, PIECE = 64, 0.36
#: Corners of the polygon that stands for a circle.
CIRCLE = 256
#: Where in a cell its reference place lies: not in the middle, where outlines drawn on round coordinates are.
_AT_X, _AT_Y = 0.5137, 0.4871


def identified(polygons: DataFrame) -> DataFrame:
    """Distinct polygons with ``pid``, a hash of 128 bits of the whole row."""
    rows = polygons.filter("rings is not null and size(rings) > 0").distinct()
    h = lambda seed: F.hex(F.xxhash64(F.lit(seed), *[F.col(c).isNull() for c in polygons.columns], *polygons.columns))
    return rows.withColumn("pid", F.concat(h(1), F.lit(":"), h(2)))


def _others(polygons: DataFrame) -> list[str]:
    return [c for c in polygons.columns if c != "rings"]


def edges(shapes: DataFrame, keep: list[str]) -> DataFrame:
    """(pid, keep..., ax, ay, bx, by): the edges of all rings; x is the longitude."""
    ring = shapes.select("pid", *keep, F.explode("rings").alias("r"))
    pairs = F.explode(F.arrays_zip(F.slice("r", 1, F.size("r") - 1).alias("p"), F.slice("r", 2, F.size("r") - 1).alias("q"))).alias("e")
    flat = ring.filter(F.size("r") > 1).select("pid", *keep, pairs)
    return flat.select("pid", *keep, *[F.col(f"e.{end}.{c}").alias(name) for name, end, c in (("ax", "p", "lon"), ("ay", "p", "lat"), ("bx", "q", "lon"), ("by", "q", "lat"))])


def _bounds(shapes: DataFrame) -> DataFrame:
    """With size (degrees of its cells, a power of two), and the ranges of cells of its bounding box."""
    corners = F.flatten("rings")
    along = {"lon": F.transform(corners, lambda p: p["lon"]), "lat": F.transform(corners, lambda p: p["lat"])}
    rows = shapes.withColumns({"x0": F.array_min(along["lon"]), "x1": F.array_max(along["lon"]), "y0": F.array_min(along["lat"]), "y1": F.array_max(along["lat"]), "n": F.size(corners)})
    cells = F.least(F.lit(float(MOST_CELLS)), F.ceil(F.sqrt(F.col("n") / 4.0)))
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-6))
    rows = rows.withColumn("size", F.pow(F.lit(2.0), F.ceil(F.log2(extent / cells))))
    return rows.withColumns({f"c{c}": F.floor(F.col(c) / F.col("size")) for c in ("x0", "x1", "y0", "y1")})


def _crossing(e: Column, x0: Column, x1: Column, y: Column) -> Column:
    """Whether the way from (x0, y) to (x1, y) changes sides at an edge."""
    at = e["ax"] + (y - e["ay"]) / (e["by"] - e["ay"]) * (e["bx"] - e["ax"])
    return ((e["ay"] > y) != (e["by"] > y)) & ((at > x0) != (at > x1))


def _climbing(e: Column, x: Column, y0: Column, y1: Column) -> Column:
    """The same for the way from (x, y0) to (x, y1)."""
    at = e["ay"] + (x - e["ax"]) / (e["bx"] - e["ax"]) * (e["by"] - e["ay"])
    return ((e["ax"] > x) != (e["bx"] > x)) & ((at > y0) != (at > y1))


def _touching(e: Column, x: Column, y: Column) -> Column:
    cross = (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
    return (F.abs(cross) < 1e-12) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))


def index(polygons: DataFrame) -> DataFrame:
    """(pid, the other columns, size, cy, cx, inside, edges): the cells of each polygon, stored."""
    keep = _others(polygons)
    shapes = stored(_bounds(identified(polygons)), "shapes")
    size = F.col("size")
    rowwise = edges(shapes, ["size"]).withColumn("cy", F.explode(F.sequence(F.floor(F.least("ay", "by") / size), F.floor(F.greatest("ay", "by") / size))))
    # the part of an edge within a row of cells, a hair wider than it is: a cell too many does no harm
    def at(y):
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (y - F.col("ay")) / (F.col("by") - F.col("ay"))))
        return F.when(F.col("by") == F.col("ay"), None).otherwise(F.col("ax") + t * (F.col("bx") - F.col("ax")))

    low, high = at(F.col("cy") * size), at((F.col("cy") + 1) * size)
    first, last = (F.coalesce(f(low, high), f("ax", "bx")) for f in (F.least, F.greatest))
    cellwise = rowwise.withColumn("cx", F.explode(F.sequence(F.floor(first / size - 1e-9), F.floor(last / size + 1e-9))))
    edge = F.struct("ax", "ay", "bx", "by")
    touched = cellwise.groupBy("pid", "cy", "cx").agg(F.collect_list(edge).alias("edges"))
    # reference places of a row of cells: inside if an odd number of edges lies to the east
    y = (F.col("cy") + _AT_Y) * size
    east = F.col("ax") + (y - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    crossed = rowwise.filter((F.col("ay") > y) != (F.col("by") > y)).groupBy("pid", "cy").agg(F.collect_list(east).alias("xs"))
    spans = shapes.select("pid", "size", "cx0", "cx1").join(crossed, "pid")
    at_cell = spans.select("pid", "size", "cy", "xs", F.explode(F.sequence("cx0", "cx1")).alias("cx"))
    odd = F.size(F.filter("xs", lambda x: x > (F.col("cx") + _AT_X) * size)) % 2 == 1
    within = at_cell.filter(odd).select("pid", "cy", "cx", F.lit(True).alias("inside"))
    cells = touched.join(within, ["pid", "cy", "cx"], "full")
    return stored(cells.join(shapes.select("pid", *keep, "size"), "pid").select("pid", *keep, "size", "cy", "cx", F.coalesce("inside", F.lit(False)).alias("inside"), "edges"), "polygons")


def located(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows of ``points`` (lat, lon) with each polygon of an index that has their cell, with ``odd`` (inside by its edges) and ``on`` (on its border)."""
    sizes = [r[0] for r in cells.select("size").distinct().collect()]  # powers of two: a handful
    if not sizes:
        sizes = [1.0]
    points = points.filter(valid_coordinates("lat", "lon")).withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    points = points.withColumns({"cy": F.floor(F.col("lat") / F.col("size")), "cx": F.floor(F.col("lon") / F.col("size"))})
    met = points.join(cells, ["size", "cy", "cx"])
    x, y = F.col("lon"), F.col("lat")
    x0, y0 = (F.col("cx") + _AT_X) * F.col("size"), (F.col("cy") + _AT_Y) * F.col("size")
    turns = F.size(F.filter("edges", lambda e: _crossing(e, x0, x, y0))) + F.size(F.filter("edges", lambda e: _climbing(e, x, y0, y)))
    odd = F.when(F.col("edges").isNull(), F.col("inside")).otherwise(F.col("inside") != (turns % 2 == 1))
    on = F.coalesce(F.exists("edges", lambda e: _touching(e, x, y)), F.lit(False))
    return met.withColumns({"odd": odd, "on": on}).drop("size", "cy", "cx", "inside", "edges")


def covering(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows of ``points`` with each polygon of an index that covers them, its border included."""
    return located(points, cells).filter("odd or on").drop("odd", "on")


def pieces(polygons: DataFrame, longest: float = PIECE) -> DataFrame:
    """(pid, the other columns, ax, ay, bx, by): all edges, cut to at most ``longest`` degrees in both directions."""
    keep = _others(polygons)
    flat = edges(identified(polygons), keep)
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))) / longest).cast("int"))
    rows = flat.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda a, b, k: F.when(k == F.col("_n"), F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * (k / F.col("_n")))
    k = F.col("_k")
    return rows.select("pid", *keep, at("ax", "bx", k).alias("ax"), at("ay", "by", k).alias("ay"), at("ax", "bx", k + 1).alias("bx"), at("ay", "by", k + 1).alias("by"))


def piece_km(lat="lat", lon="lon") -> Column:
    """Kilometres from a point to the piece ax, ay, bx, by in the plane that touches the earth at the point."""
    lat, lon = col(lat), col(lon)
    x = lambda c: (F.col(c) - lon) * F.cos(F.radians(lat)) * F.lit(KM_A_DEGREE)
    y = lambda c: (F.col(c) - lat) * F.lit(KM_A_DEGREE)
    ax, ay, bx, by = x("ax"), y("ay"), x("bx"), y("by")
    dx, dy = bx - ax, by - ay
    along = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(along > 0, -(ax * dx + ay * dy) / along).otherwise(0.0)))
    return F.hypot(ax + t * dx, ay + t * dy)


def nearest_polygon(points: DataFrame, polygons: DataFrame, group: str, cells: DataFrame | None = None) -> DataFrame:
    """(point_id, group, distance_km, feature_id): the nearest polygon of each group, 0 where it covers the point; ties to the least feature_id.

    ``points``: point_id, lat, lon. ``polygons``: feature_id, the group column, rings, and whatever else; ``cells``: their index.
    """
    points = points.select("point_id", "lat", "lon")
    cells = index(polygons) if cells is None else cells
    on = covering(points, cells).select("point_id", group, F.lit(0.0).alias("km"), "feature_id")
    outline = pieces(polygons).withColumns(
        {"south": F.least("ay", "by"), "north": F.greatest("ay", "by"), "west": F.least("ax", "bx"), "east": F.greatest("ax", "bx")}
    )
    pairs, _ = nearest_pairs(points, outline, group, plane_lower, plane_upper)
    near = pairs.select("point_id", group, piece_km().alias("km"), "feature_id")
    best = on.unionByName(near).groupBy("point_id", group).agg(F.min(F.struct("km", "feature_id")).alias("m"))
    return stored(best.select("point_id", group, F.col("m.km").alias("distance_km"), F.col("m.feature_id").alias("feature_id")), "nearest")


def _close(points: DataFrame, polygons: DataFrame, km: float) -> DataFrame:
    """Rows of ``points`` with the pieces of outlines whose middle is so near that the piece can come within ``km``."""
    longest = km / KM_A_DEGREE
    outline = pieces(polygons, longest).withColumns({"lat_r": (F.col("ay") + F.col("by")) / 2, "lon_r": (F.col("ax") + F.col("bx")) / 2})
    reach = km + km / math.sqrt(2) + 0.01 * km + 0.01
    return radius_join(points, outline.filter(valid_coordinates("lat_r", "lon_r")), reach, reach)


def polygons_within(points: DataFrame, polygons: DataFrame, km: float, cells: DataFrame | None = None) -> DataFrame:
    """(point_id, feature_id, distance_km) of the polygons within ``km`` of points, 0 where they cover them. ``cells``: their index."""
    cells = index(polygons) if cells is None else cells
    points = points.filter(valid_coordinates("lat", "lon")).select("point_id", "lat", "lon")
    near = _close(points, polygons, km).select("point_id", "feature_id", piece_km().alias("km")).filter(F.col("km") <= km)
    on = covering(points, cells).select("point_id", "feature_id", F.lit(0.0).alias("km"))
    return on.unionByName(near).groupBy("point_id", "feature_id").agg(F.min("km").alias("distance_km"))


def covered_share(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, owner: np.ndarray, inside: np.ndarray, radius: float) -> float:
    """The share of a circle around (0, 0), as a polygon of CIRCLE corners, that polygons cover together.

    Edges (x0, y0) to (x1, y1) of polygon ``owner``, all that touch the circle's bounding box; ``inside``: which polygons the centre is in. The circle is
    cut into upright slabs at every corner and crossing; within a slab no outlines cross, so its middle line tells its area exactly.
    """
    angle = np.arange(CIRCLE) * (2 * math.pi / CIRCLE)
    cx, cy = radius * np.cos(angle), radius * np.sin(angle)
    upper = np.arange(CIRCLE // 2, -1, -1)
    cuts = [cx, x0, x1, *_crossings(x0, y0, x1, y1, cx, cy, np.roll(cx, -1), np.roll(cy, -1)), *_crossings(x0, y0, x1, y1, x0, y0, x1, y1)]
    xs = np.unique(np.clip(np.concatenate(cuts), -radius, radius))
    width, middle = np.diff(xs), (xs[1:] + xs[:-1]) / 2
    total, n = 0.0, max(len(inside), 1)
    half = np.interp(middle, cx[upper], cy[upper])
    for lo in range(0, len(middle), 256):
        part = slice(lo, lo + 256)
        x, h = middle[part], half[part]
        slab, edge = np.nonzero((x0[None, :] > x[:, None]) != (x1[None, :] > x[:, None]))
        y = y0[edge] + (x[slab] - x0[edge]) / (x1[edge] - x0[edge]) * (y1[edge] - y0[edge])
        # sides at (x, 0), by the way from the centre; then at the slab's lower end
        level = np.flatnonzero((y0 > 0) != (y1 > 0))
        at = x0[level] - y0[level] / (y1[level] - y0[level]) * (x1[level] - x0[level])
        side = np.broadcast_to(inside[None, :], (len(x), len(inside))).astype(np.int64)
        flips = np.zeros((len(x), n), np.int64)
        s, e = np.nonzero((at[None, :] > 0) != (at[None, :] > x[:, None]))
        np.add.at(flips, (s, owner[level[e]]), 1)
        low = (y > -h[slab]) & (y <= 0)
        np.add.at(flips, (slab[low], owner[edge[low]]), 1)
        side = (side + flips[:, : len(inside)]) % 2
        # going up, each edge opens or closes its polygon
        keep = (y > -h[slab]) & (y < h[slab])
        slab, y, who = slab[keep], y[keep], owner[edge[keep]]
        order = np.lexsort((y, who, slab))
        slab, y, who = slab[order], y[order], who[order]
        first = np.ones(len(y), bool)
        first[1:] = (slab[1:] != slab[:-1]) | (who[1:] != who[:-1])
        rank = np.arange(len(y)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(y) else np.zeros(0, np.int64)
        step = np.where((side[slab, who] + rank) % 2 == 0, 1, -1)
        order = np.lexsort((y, slab))
        slab, y, step = slab[order], y[order], step[order]
        bounds = np.searchsorted(slab, np.arange(len(x) + 1))
        before = np.concatenate(([0], np.cumsum(step)))
        depth = side.sum(axis=1)
        # stretches: from the lower end or an edge up to the next edge or the upper end
        down = np.concatenate((-h, y))
        where = np.concatenate((np.arange(len(x)), slab))
        deep = np.concatenate((depth, depth[slab] + before[1:] - before[bounds[slab]]))
        order = np.lexsort((down, where))
        down, where, deep = down[order], where[order], deep[order]
        up = np.append(down[1:], 0.0)
        ends = np.append(where[1:] != where[:-1], True)
        up[ends] = h[where[ends]]
        total += float((((up - down) * (deep > 0)) * width[part][where]).sum())
    area = CIRCLE / 2 * radius * radius * math.sin(2 * math.pi / CIRCLE)
    return min(1.0, total / area)


def _crossings(ax, ay, bx, by, cx, cy, dx, dy) -> list[np.ndarray]:
    """x of the places where edges a-b and c-d cross, a block of edges at a time."""
    out = []
    for lo in range(0, len(ax), 256):
        px, py, qx, qy = (v[lo : lo + 256, None] for v in (ax, ay, bx, by))
        rx, ry, sx, sy = qx - px, qy - py, (dx - cx)[None, :], (dy - cy)[None, :]
        turn = rx * sy - ry * sx
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((cx[None, :] - px) * sy - (cy[None, :] - py) * sx) / turn
            u = ((cx[None, :] - px) * ry - (cy[None, :] - py) * rx) / turn
        hit = (turn != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        out.append(np.broadcast_to(px, hit.shape)[hit] + t[hit] * np.broadcast_to(rx, hit.shape)[hit])
    return out


def cover(points: DataFrame, polygons: DataFrame, group: str, km: float = 1.0, cells: DataFrame | None = None) -> DataFrame:
    """(point_id, group, inside, fraction): whether a polygon of the group covers the point, and the share of the circle of ``km`` around it that
    the polygons of the group cover together. Groups without a polygon nearby have no row.

    Streamed by (point, group); a task holds the edges within one circle.
    """
    points = points.filter(valid_coordinates("lat", "lon")).select("point_id", "lat", "lon")
    cells = index(polygons) if cells is None else cells
    place = located(points, cells).filter("odd or on").select("point_id", group, "pid", "odd", F.lit(True).alias("inside"), *[F.lit(None).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    # the bounding box of the circle reaches sqrt(2) times as far as the circle
    close = _close(points, polygons, km * math.sqrt(2))
    x = lambda c: ((F.col(c) - F.col("lon")) * F.cos(F.radians("lat")) * F.lit(KM_A_DEGREE))
    y = lambda c: (F.col(c) - F.col("lat")) * F.lit(KM_A_DEGREE)
    near = close.select("point_id", group, "pid", F.lit(None).cast("boolean").alias("odd"), F.lit(False).alias("inside"), x("ax").alias("x0"), y("ay").alias("y0"), x("bx").alias("x1"), y("by").alias("y1"))
    rows = place.unionByName(near).repartition("point_id", group).sortWithinPartitions("point_id", group, "pid")
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("point_id", group)}

    def run(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            held = yield from shares(held.combine_chunks(), False)
        if held is not None and len(held):
            yield from shares(held, True)

    def shares(table, last):
        keys = list(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))
        starts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
        stops = [*starts[1:], len(keys)] if last else starts[1:]
        out = []
        for lo, hi in zip(starts, stops, strict=False):
            part = table.slice(lo, hi - lo)
            _, owner = np.unique(part.column("pid").to_numpy(), return_inverse=True)
            odd = np.zeros(int(owner.max()) + 1, np.int64)
            odd[owner[part.column("odd").fill_null(False).to_numpy()]] = 1
            x0, y0, x1, y1 = (part.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1"))
            edge = ~np.isnan(x0)
            share = covered_share(x0[edge], y0[edge], x1[edge], y1[edge], owner[edge], odd, km)
            out.append((*keys[lo], bool(part.column("inside").to_numpy().any()), share))
        if out:
            columns = list(zip(*out, strict=True))
            types = [table.schema.field(0).type, table.schema.field(1).type, pa.bool_(), pa.float64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["point_id", group, "inside", "fraction"])
        return table.slice(stops[-1] if stops else 0) if not last else None

    return rows.mapInArrow(run, f"point_id {kind['point_id']}, {group} {kind[group]}, inside boolean, fraction double")
