"""What lies around a point: facilities, polygons of land cover, and how much of its surroundings they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.geo import col, valid_coordinates
from emberline.operators import polygons as shapes
from emberline.operators.nearness import nearest
from emberline.operators.radius import radius_join
from emberline.session import stored

# The categories that count as industry, the kinds of polygons, and the radii that are counted.
INDUSTRIAL = ("refinery", "factory", "power_plant", "mine", "industrial_area", "oil_gas")
KINDS = {"forest": "inside_forest", "agriculture": "inside_agriculture", "urban": "inside_urban", "industrial": "inside_industrial_polygon"}
FRACTIONS = ("forest", "agriculture", "industrial")
RADII = ((0.5, "500m"), (1.0, "1km"), (5.0, "5km"))


def interior_point(rings) -> Column:
    """(lon, lat) inside a polygon: the middle of the longest stretch inside it along the line halfway between its lowest and the
    next higher corner, which no corner touches."""
    rings = col(rings)
    corners = F.flatten(rings)
    heights = F.array_sort(F.array_distinct(F.transform(corners, lambda p: p["lat"])))
    level = (F.element_at(heights, 1) + F.element_at(heights, 2)) / 2
    edges = F.flatten(F.transform(rings, lambda r: F.arrays_zip(F.slice(r, 1, F.size(r) - 1).alias("p"), F.slice(r, 2, F.size(r) - 1).alias("q"))))
    crossing = F.filter(edges, lambda e: (e["p"]["lat"] > level) != (e["q"]["lat"] > level))
    xs = F.array_sort(F.transform(crossing, lambda e: e["p"]["lon"] + (level - e["p"]["lat"]) / (e["q"]["lat"] - e["p"]["lat"]) * (e["q"]["lon"] - e["p"]["lon"])))
    spans = F.transform(F.sequence(F.lit(1), (F.size(xs) / 2).cast("int")), lambda k: F.struct((F.element_at(xs, 2 * k) - F.element_at(xs, 2 * k - 1)).alias("w"), ((F.element_at(xs, 2 * k) + F.element_at(xs, 2 * k - 1)) / 2).alias("lon")))
    return F.struct(F.array_max(spans)["lon"].alias("lon"), level.alias("lat"))


def event_spatial_features(events: DataFrame, facilities: DataFrame, polygons: DataFrame, coverage: DataFrame, available: tuple[str, ...] = ()) -> DataFrame:
    """The 20 spatial fields of each event (point_id, lat, lon); an event without valid coordinates has all of them null.

    ``facilities``: feature_id, ord, category, lat_r, lon_r. ``polygons``: feature_id, kind (of KINDS), rings, facility_type (null if it isn't said), landcover
    (whether it is a cell of a land-cover map instead of a facility's footprint). ``coverage``: kind, rings: where a kind was surveyed. ``available``: layers that
    exist though nothing is in them.

    Distances to places and to the nearest polygon of a kind have three decimals; a footprint of a category counts if it is nearer than that. Ids are compared
    as text. Counts are null without any layer of facilities. Only where a kind was surveyed does the absence of a polygon mean "outside", and only where the
    whole circle was is there a fraction; elsewhere these fields are null.
    """
    facilities = facilities.withColumn("feature_id", F.col("feature_id").cast("string"))
    polygons = polygons.filter(F.col("kind").isin(*KINDS)).select(F.col("feature_id").cast("string").alias("feature_id"), "kind", "rings", "facility_type", "landcover")
    polygons = stored(polygons, "polygons")
    footprint = (F.col("kind") == "industrial") & ~F.coalesce("landcover", F.lit(False))
    layers = {r[0] for r in facilities.select("category").distinct().filter(F.col("category").isin(*INDUSTRIAL)).collect()}
    layers |= {r[0] for r in polygons.select("kind").distinct().collect()} | set(available)
    has_footprints = not polygons.filter(footprint).isEmpty()
    kind = F.coalesce(F.when(footprint, F.coalesce("facility_type", F.lit("industrial_area"))), F.lit(""))
    named = polygons.select("feature_id", "rings", F.explode(F.array_compact(F.array(F.concat(F.lit("kind:"), "kind"), F.when(footprint, F.concat(F.lit("type:"), kind))))).alias("named"))
    to_polygon = shapes.nearest_polygon(events, named, "named")
    to_place = nearest(events, facilities, "category").select("point_id", F.col("category").alias("what"), F.round("distance_km", 3).alias("km"), "feature_id")
    to_footprint = to_polygon.filter("named like 'type:%'").select("point_id", F.substring("named", 6, 99).alias("what"), F.col("distance_km").alias("km"), "feature_id")
    reached = to_place.unionByName(to_footprint)
    fields = {"refinery": "dist_refinery_km", "factory": "dist_factory_km", "power_plant": "dist_powerplant_km", "mine": "dist_mine_km"}
    by_kind = lambda f, c: F.min(F.when(F.col("what").isin(*f), c))
    facts = reached.groupBy("point_id").agg(
        *[by_kind([c], F.col("km")).alias(name) for c, name in fields.items()],
        by_kind(["settlement"], F.col("km")).alias("dist_settlement_km"),
        by_kind(INDUSTRIAL, F.struct("km", "feature_id", "what")).alias("m"),
    )
    outlines = to_polygon.filter("named like 'kind:%'").select("point_id", F.substring("named", 6, 99).alias("what"), F.round("distance_km", 3).alias("km"))
    outlines = outlines.groupBy("point_id").agg(*[by_kind([c], F.col("km")).alias(f"_to_{c}") for c in FRACTIONS])
    points = radius_join(events, facilities.filter(F.col("category").isin(*INDUSTRIAL)), RADII[-1][0], RADII[-1][0]).select("point_id", "feature_id", "distance_km")
    near = points.unionByName(shapes.polygons_within(events, polygons.filter(footprint), RADII[-1][0]))
    counts = near.groupBy("point_id").agg(*[F.count_distinct(F.when(F.col("distance_km") <= km, F.col("feature_id"))).alias(f"_within_{name}") for km, name in RADII])
    pivot = lambda value, name, kinds: [F.max(F.when(F.col("kind") == k, F.col(value))).alias(f"{name}_{k}") for k in kinds]
    covered = shapes.cover(events, polygons.select("kind", "rings"), "kind").groupBy("point_id").agg(*pivot("inside", "_in", KINDS), *pivot("fraction", "_part", FRACTIONS))
    surveyed = shapes.cover(events, coverage.filter(F.col("kind").isin(*KINDS)).select("kind", "rings"), "kind").groupBy("point_id").agg(*pivot("inside", "_seen", KINDS), *pivot("fraction", "_whole", FRACTIONS))
    rows = events.select("point_id", valid_coordinates("lat", "lon").alias("_placed"))
    for part in (facts, outlines, counts, covered, surveyed):
        rows = rows.join(part, "point_id", "left")
    counted = bool(layers & set(INDUSTRIAL)) or has_footprints
    within = [F.when(F.col("_placed") & F.lit(counted), F.coalesce(f"_within_{name}", F.lit(0).cast("long"))).alias(f"industrial_count_{name}") for _, name in RADII]
    inside = [F.when(F.lit(k in layers), F.when(F.col(f"_in_{k}"), True).when(F.col(f"_seen_{k}"), False)).alias(name) for k, name in KINDS.items()]
    part = [F.when(F.col(f"_whole_{k}") >= 1 - 1e-9, F.coalesce(f"_part_{k}", F.lit(0.0))).alias(f"{k}_fraction_1km") for k in FRACTIONS]
    return rows.select(
        "point_id", F.least("m.km", "_to_industrial").alias("dist_nearest_industrial_km"), *fields.values(), "dist_settlement_km", F.col("m.feature_id").alias("nearest_facility_id"), F.col("m.what").alias("nearest_facility_type"),
        *within, F.col("_to_forest").alias("dist_forest_km"), F.col("_to_agriculture").alias("dist_agriculture_km"), *inside, *part,
    )


def reference_audit(events: DataFrame, areas: DataFrame, coverage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the reference layers say about each event (point_id, lat, lon): (point_id, kind, at_centroid, full_circle) for each kind that ``coverage`` (kind, rings) was
    surveyed for, and (point_id, feature_ids) of the areas (feature_id, rings) that it lies in, in order; an event in none has an empty list."""
    kinds = coverage.select("kind").distinct()
    seen = shapes.cover(events, coverage.select("kind", "rings"), "kind")
    asked = events.select("point_id").join(F.broadcast(kinds))  # a handful of kinds
    rows = asked.join(seen, ["point_id", "kind"], "left").select("point_id", "kind", F.coalesce("inside", F.lit(False)).alias("at_centroid"), F.coalesce(F.col("fraction") >= 1 - 1e-9, F.lit(False)).alias("full_circle"))
    within = shapes.covering(events.select("point_id", "lat", "lon"), shapes.index(areas.select("feature_id", "rings"))).groupBy("point_id").agg(F.array_sort(F.collect_set("feature_id")).alias("feature_ids"))
    empty = F.array().cast(within.schema["feature_ids"].dataType)
    return rows, events.select("point_id").join(within, "point_id", "left").select("point_id", F.coalesce("feature_ids", empty).alias("feature_ids"))
