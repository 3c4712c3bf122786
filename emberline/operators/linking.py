"""What connects detections in space and time, without making all pairs of them.

Detections of one cell and one slot of time are all within both distances, so they are one vertex. Vertices of a cell in slots that follow each other are joined by
their times alone. Others meet only near each other, by the boxes around what is really in their parts (PARTS by PARTS of a cell): boxes that are wholly within the radius
are linked, boxes that are wholly beyond it are not, and of what is left only pairs that nothing else has connected yet are looked into detection by detection.
So the number of vertices, not of detections, is what grows with a place's density: there is at most one for each cell and slot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.geo import haversine_km
from emberline.operators.graph import components
from emberline.operators.nearness import sphere_lower, sphere_upper
from emberline.operators.radius import KM_A_DEGREE, radius_join
from emberline.session import discard, stored

#: Parts along each side of a cell.
PARTS = 3
#: Kilometres that a bound of boxes may be off by rounding, and the share of a cell's side that keeps its diagonal below the radius.
SLACK, SHRUNK = 1e-6, 0.999
_KEY = ["_band", "_cell", "_slot"]
_BOX = ("south", "north", "west", "east")


def placed(lat="lat", lon="lon", us="acq_us", key="det_id") -> Column:
    """Whether a detection can be near to another: it has an id, a finite place and a time."""
    finite = lambda c: F.abs(F.col(c)) < F.lit(float("inf"))
    return F.coalesce(finite(lat) & finite(lon) & F.col(us).isNotNull() & F.col(key).isNotNull(), F.lit(False))


def keyed(det: DataFrame, km: float, width: int) -> DataFrame:
    """``det`` (det_id, lat, lon, acq_us), all of it placed, with its cell, slot and part, which are never null: so no filter repeats how they are computed."""
    side = SHRUNK * km / math.sqrt(2) / KM_A_DEGREE
    whole = lambda c: F.coalesce(F.floor(c), F.lit(0).cast("long"))
    east = F.when((F.col("lon") >= -180) & (F.col("lon") < 180), F.col("lon")).otherwise(F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0)
    rows = det.withColumns({"_at": (F.col("lat") + 90.0) / side, "_lon": east}).withColumn("_band", whole("_at"))
    low, high = F.col("_band") * side - 90.0, (F.col("_band") + 1) * side - 90.0
    widest = F.when((low < 0) & (high > 0), F.lit(1.0)).otherwise(F.greatest(*[F.abs(F.cos(F.radians(c))) for c in (low, high)]))
    rows = rows.withColumn("_step", F.lit(360.0) / F.greatest(F.lit(1.0), F.ceil(F.lit(360.0 / side) * widest))).withColumn("_over", (F.col("_lon") + 180.0) / F.col("_step"))
    rows = rows.withColumns({"_cell": whole("_over"), "_slot": whole((F.col("acq_us") - F.pmod(F.col("acq_us"), F.lit(width))) / F.lit(width))})
    part = whole((F.col("_at") - F.col("_band")) * PARTS) * PARTS + whole((F.col("_over") - F.col("_cell")) * PARTS)
    return rows.withColumn("_part", part).drop("_at", "_over", "_step")


def _bounds(rows: DataFrame, by: list[str], **more: Column) -> DataFrame:
    ends = [(F.min if c in ("south", "west", "t0") else F.max)(c).alias(c) for c in (*_BOX, "t0", "t1")]
    return rows.groupBy(*by).agg(*ends, *[c.alias(name) for name, c in more.items()])


def _gap(a: str, b: str) -> Column:
    return F.greatest(F.lit(0), F.col(f"{b}t0") - F.col(f"{a}t1"), F.col(f"{a}t0") - F.col(f"{b}t1"))


def _box(name: str) -> dict[str, Column]:
    return {c: F.col(f"{name}{c}") for c in _BOX}


def _ahead(vertices: DataFrame, width: int) -> DataFrame:
    """(a, b): vertices of one cell in slots that follow each other, near enough in time."""
    first = vertices.select(*_KEY, F.col("v").alias("a"), F.col("t1"))
    then = vertices.select("_band", "_cell", (F.col("_slot") - 1).alias("_slot"), F.col("v").alias("b"), F.col("t0"))
    return first.join(then, _KEY).filter(F.col("t0") - F.col("t1") <= width).select("a", "b")


def _meeting(vertices: DataFrame, km: float, width: int) -> DataFrame:
    """(a, b): vertices of different cells, in one slot or slots that follow each other, whose boxes may come within both distances."""
    middle = {"lat": (F.col("south") + F.col("north")) / 2, "lon": (F.col("west") + F.col("east")) / 2}
    inner = [*_KEY, "v", *_BOX, "t0", "t1"]
    left = vertices.select(*[F.col(c).alias(f"l_{c}") for c in inner], middle["lat"].alias("lat"), middle["lon"].alias("lon"))
    right = vertices.select(*[F.col(c).alias(f"r_{c}") for c in inner], middle["lat"].alias("lat_r"), middle["lon"].alias("lon_r"))
    # a box's middle is within half a cell's diagonal of all that is in it
    reach = 2 * km + SLACK
    pairs = radius_join(left, right, reach, reach, [(F.array(F.col("l__slot"), F.col("l__slot") + 1), F.col("r__slot"))])
    other = (F.col("l__band") != F.col("r__band")) | (F.col("l__cell") != F.col("r__cell"))
    once = (F.col("l__slot") < F.col("r__slot")) | (F.col("l_v") < F.col("r_v"))
    near = (sphere_lower(_box("l_"), _box("r_")) <= km + SLACK) & (_gap("l_", "r_") <= width)
    return pairs.filter(other & once & near).select(F.col("l_v").alias("a"), F.col("r_v").alias("b"))


def _judged(pairs: DataFrame, parts: DataFrame, km: float, width: int) -> DataFrame:
    """(a, b, pa, pb, sure): parts of the vertices of ``pairs`` that are within both distances for certain, or may be."""
    side = lambda end, p: parts.select(F.col("v").alias(end), F.col("_part").alias(f"p{end}"), *[F.col(c).alias(f"{p}{c}") for c in (*_BOX, "t0", "t1")])
    met = pairs.join(side("a", "l_"), "a").join(side("b", "r_"), "b").filter(_gap("l_", "r_") <= width)
    point = lambda p: (F.col(f"{p}south") == F.col(f"{p}north")) & (F.col(f"{p}west") == F.col(f"{p}east"))
    # two places: their distance is what counts; in all else bounds
    exact = haversine_km("l_south", "l_west", "r_south", "r_west") <= km
    low, high = sphere_lower(_box("l_"), _box("r_")), sphere_upper(_box("l_"), _box("r_"))
    sure = F.when(point("l_") & point("r_"), F.when(exact, True)).when(high <= km - SLACK, True).when(low <= km + SLACK, False)
    return met.select("a", "b", "pa", "pb", sure.alias("sure")).filter("sure is not null")


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``pairs`` with the components of their ends (la, lb) so far, where these differ."""
    if labels is None:
        return pairs.withColumns({"la": F.col("a"), "lb": F.col("b")})
    rows = pairs
    for end in ("a", "b"):
        rows = rows.join(labels.select(F.col("id").alias(end), F.col("component").alias(f"l{end}")), end, "left").withColumn(f"l{end}", F.coalesce(f"l{end}", end))
    return rows.filter("la <> lb")


def _touching(open_: DataFrame, parts: DataFrame, det: DataFrame, km: float, width: int) -> DataFrame:
    """(a, b) of the pairs of parts in which two detections are within both distances."""
    asked = open_.select(F.col("a").alias("v"), F.col("pa").alias("_part")).unionByName(open_.select(F.col("b").alias("v"), F.col("pb").alias("_part"))).distinct()
    wanted = parts.select("v", *_KEY, "_part").join(asked, ["v", "_part"])
    points = stored(det.join(wanted, [*_KEY, "_part"]).select("v", "_part", "lat", "lon", "acq_us").distinct(), "points")
    left = points.select(F.col("v").alias("a"), F.col("_part").alias("pa"), "lat", "lon", F.col("acq_us").alias("us"))
    right = points.select(F.col("v").alias("b"), F.col("_part").alias("pb"), F.col("lat").alias("lat_r"), F.col("lon").alias("lon_r"), F.col("acq_us").alias("us_r"))
    near = (F.abs(F.col("us") - F.col("us_r")) <= width) & (haversine_km("lat", "lon", "lat_r", "lon_r") <= km)
    found = stored(open_.select("a", "b", "pa", "pb").join(left, ["a", "pa"]).join(right, ["b", "pb"]).filter(near).select("a", "b").distinct(), "touching")
    discard(points)
    return found


def _same_id(det: DataFrame, vertices: DataFrame) -> DataFrame | None:
    """(a, b): vertices that share a det_id; None if no det_id is on several rows."""
    often = stored(det.groupBy("det_id").count().filter("count > 1").select("det_id"), "often")
    if often.isEmpty():
        return None
    of = det.join(often, "det_id").join(vertices.select(*_KEY, "v"), _KEY).select("det_id", "v").distinct()
    least = of.groupBy("det_id").agg(F.min("v").alias("a"))
    return of.join(least, "det_id").filter("a <> v").select("a", F.col("v").alias("b")).distinct()


def groups(det: DataFrame, km: float, width: int) -> DataFrame:
    """(det_id, component): for each det_id the smallest one that it is connected with by steps of at most ``km`` and ``width`` microseconds, or itself. A det_id
    on several rows is one detection at several places; a row without a finite place or a time is near to nothing."""
    all_ = det.select("det_id", "lat", "lon", "acq_us")
    det = keyed(all_.filter(placed()), km, width)
    boxes = det.withColumns({"south": F.col("lat"), "north": F.col("lat"), "west": F.col("_lon"), "east": F.col("_lon"), "t0": F.col("acq_us"), "t1": F.col("acq_us")})
    cut = _bounds(boxes, [*_KEY, "_part"], least=F.min("det_id"))
    # a vertex has at most PARTS * PARTS parts
    parts = stored(cut.withColumn("v", F.min("least").over(Window.partitionBy(*_KEY))).drop("least"), "parts")
    vertices = stored(_bounds(parts, _KEY, v=F.min("v")), "vertices")
    meeting = stored(_meeting(vertices, km, width), "meeting")
    links, same = _ahead(vertices, width), _same_id(det, vertices)
    links = stored(links if same is None else links.unionByName(same), "links")
    labels = stored(components(links), "labels")

    def joined(found: DataFrame) -> None:
        """Takes the links ``found`` (a, b) in: what they connect beside those before."""
        nonlocal labels
        steps = components(_apart(found, labels).select("la", "lb"), "la", "lb").select(F.col("id").alias("component"), F.col("component").alias("_to"))
        both = vertices.select(F.col("v").alias("id")).distinct().join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        before, labels = labels, stored(both.join(steps, "component", "left").select("id", F.coalesce("_to", "component").alias("component")), "labels")
        discard(before)

    # one pair of vertices for each pair of components often tells; then all that are still apart; then their detections
    one = _apart(meeting, labels).groupBy("la", "lb").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
    first = stored(_judged(one, parts, km, width).filter("sure").select("a", "b").distinct(), "links")
    joined(first)
    judged = stored(_judged(_apart(meeting, labels).select("a", "b"), parts, km, width), "judged")
    joined(judged.filter("sure").select("a", "b").distinct())
    open_ = stored(_apart(judged.filter("not sure").select("a", "b", "pa", "pb"), labels), "open")
    if not open_.isEmpty():
        touching = _touching(open_, parts, det, km, width)
        joined(touching)
        discard(touching)
    named = vertices.select(*_KEY, "v").join(labels.withColumnRenamed("id", "v"), "v", "left").select(*_KEY, F.coalesce("component", "v").alias("component"))
    found = det.join(named, _KEY).select("det_id", "component").unionByName(all_.filter(~placed()).select("det_id", F.col("det_id").alias("component")))
    out = stored(found.groupBy("det_id").agg(F.min("component").alias("component")), "members")
    discard(parts, vertices, meeting, links, first, judged, open_, labels)
    return out
