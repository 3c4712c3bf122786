"""Reference layers: GeoJSON feature collections and Overpass exports as rows."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.geo import valid_coordinates
from emberline.operators.dataset import content_hash
from emberline.operators.spatial import interior_point
from emberline.sources.collections import FEATURE, feature_rows

# Tag rules in order, the first that holds gives the category; what each role of a layer may hold; categories that need
# polygons or lines; reasons of rejection.
TAG_RULES = (
    ("industrial", "refinery", "refinery"),
    ("industrial", "factory", "factory"),
    ("power", "plant", "power_plant"),
    ("man_made", "mine", "mine"),
    ("landuse", "industrial", "industrial_area"),
)
INDUSTRIAL = ("refinery", "factory", "power_plant", "mine", "industrial_area", "oil_gas")
ROLES = {
    "industrial": (*INDUSTRIAL, "industrial", "settlement"),
    "landcover": ("forest", "agriculture", "urban", "industrial", "water"),
    "administrative": ("administrative",),
    "transport": ("road", "railway", "pipeline"),
    "water": ("water",),
}
AREAS, LINES = ("forest", "agriculture", "urban", "industrial", "water", "administrative"), ("road", "railway", "pipeline")
UNKNOWN_TYPE, OPEN_WAY, NO_GEOMETRY = "UNKNOWN_FACILITY_TYPE", "OPEN_WAY_REQUIRES_EXPLICIT_GEOMETRY", "MISSING_OR_UNASSEMBLED_GEOMETRY"
NO_ID, DUPLICATE_ID, WRONG_CATEGORY, OUT_OF_SCOPE = "MISSING_STABLE_FEATURE_ID", "DUPLICATE_FEATURE_ID", "UNKNOWN_OR_WRONG_ROLE_CATEGORY", "EXPLICIT_OUT_OF_SCOPE_MAPPING"
MERCATOR_M = 20037508.342789244

OVERPASS = "elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,geometry:array<struct<lat:double,lon:double>>,tags:map<string,string>>>"


def to_degrees(x: Column, y: Column, crs: str) -> tuple[Column, Column]:
    """(lon, lat) from EPSG:4326 or EPSG:3857 coordinates."""
    if crs == "EPSG:4326":
        return x, y
    if crs == "EPSG:3857":
        lat = F.degrees(F.lit(2.0) * F.atan(F.exp(y / MERCATOR_M * F.pi())) - F.pi() / 2)
        return x / MERCATOR_M * 180.0, lat
    raise ValueError(f"unknown reference system: {crs}")


def geojson_points(spark: SparkSession, path: str, crs: str = "EPSG:4326") -> DataFrame:
    """(feature_id, category, name, lon, lat) of a collection's points; features of other shapes or without category are left out."""
    rows = feature_rows(spark, path)
    p = F.col("f.properties")
    xy = F.from_json("f.geometry.coordinates", "array<double>")
    lon, lat = to_degrees(F.get(xy, F.lit(0)), F.get(xy, F.lit(1)), crs)
    category = F.coalesce(p["category"], p["infra_type"], p["facility_type"])
    points = rows.filter(F.col("f.geometry.type") == "Point").select(F.coalesce(p["facility_id"], F.col("f.id")).alias("feature_id"), category.alias("category"), p["name"].alias("name"), lon.alias("lon"), lat.alias("lat"))
    return points.filter("category is not null and lat between -90 and 90 and lon between -180 and 180")


def overpass_rows(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of elements (type, id, lat, lon, center, geometry, tags).

    A closed way is a polygon; an open one is rejected, whatever centre it has. Else a place or, without geometry, a centre is a
    point. An element that no rule names is rejected first.
    """
    category = F.coalesce(*[F.when(F.col("tags")[key] == value, F.lit(name)) for key, value, name in TAG_RULES])
    line = F.col("geometry")
    drawn = F.coalesce(F.size(line) > 0, F.lit(False))
    way = drawn & (F.col("type") == "way")
    closed = way & (F.size(line) >= 4) & (F.get(line, F.lit(0)) == F.element_at(line, -1))
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    centred = F.col("center").isNotNull() & ~drawn
    reason = F.when(category.isNull(), UNKNOWN_TYPE).when(way & ~closed, OPEN_WAY).when(~way & ~placed & ~centred, NO_GEOMETRY)
    rows = elements.select(
        F.concat_ws("/", "type", F.col("id").cast("string")).alias("feature_id"),
        category.alias("category"),
        F.col("tags")["name"].alias("name"),
        F.when(closed, "Polygon").otherwise("Point").alias("shape"),
        F.when(~way, F.when(placed, F.col("lat")).otherwise(F.col("center.lat"))).alias("lat"),
        F.when(~way, F.when(placed, F.col("lon")).otherwise(F.col("center.lon"))).alias("lon"),
        (~way & ~placed & centred).alias("center_only"),
        F.when(closed, line).alias("ring"),
        reason.alias("reason"),
    )
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null").select("feature_id", "reason")


def overpass_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) elements of an Overpass export."""
    return overpass_rows(spark.read.schema(OVERPASS).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*"))


def geojson_features(spark: SparkSession, path: str, crs: str = "EPSG:4326") -> DataFrame:
    """(place, feature_id, category, name, shape, lon, lat, rings, properties) of a collection, in its order.

    A point has lon and lat, a polygon its rings (the outer one, then holes), each polygon of a MultiPolygon a row. A facility's
    polygon also has a point inside it as lon and lat. Lines have neither.
    """
    return geojson_rows(feature_rows(spark, path), crs)


def _corner(crs: str):
    def corner(q: Column) -> Column:
        lon, lat = to_degrees(F.get(q, F.lit(0)), F.get(q, F.lit(1)), crs)
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    return corner


def _polygons(kind: Column, text: Column) -> Column:
    """The polygons of a geometry, each as its rings of coordinates; null for other shapes."""
    return F.when(kind == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>"))).when(kind == "MultiPolygon", F.from_json(text, "array<array<array<array<double>>>>"))


def geojson_rows(rows: DataFrame, crs: str) -> DataFrame:
    p, kind, text = F.col("f.properties"), F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    polygons, corner = _polygons(kind, text), _corner(crs)
    xy = F.when(kind == "Point", F.from_json(text, "array<double>"))
    rings = F.transform("polygon", lambda ring: F.transform(ring, corner))
    category = F.coalesce(p["category"], p["infra_type"], p["facility_type"])
    each = rows.select("place", F.coalesce(F.col("f.id"), p["facility_id"], p["id"]).alias("feature_id"), category.alias("category"), p["name"].alias("name"), kind.alias("shape"), corner(xy).alias("at"), p.alias("properties"), F.explode_outer(polygons).alias("polygon"))
    each = each.withColumn("rings", rings).withColumn("inside", F.when(F.col("rings").isNotNull() & F.col("category").isin(*INDUSTRIAL), interior_point("rings")))
    lon, lat = (F.coalesce(F.col(f"at.{c}"), F.col(f"inside.{c}")) for c in ("lon", "lat"))
    return each.select("place", "feature_id", "category", "name", "shape", lon.alias("lon"), lat.alias("lat"), "rings", "properties")


def layer(spark: SparkSession, path: str, role: str, crs: str = "EPSG:4326") -> DataFrame:
    """The features of one role's file, as geojson_features has them: land cover, roads and lines, water, and so on.

    Without a file there are none. Features of other categories, or whose geometry can't be used, are left out.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return geojson_rows(spark.createDataFrame([], f"place int, f {FEATURE}"), crs)
    return geojson_features(spark, path, crs).filter(F.col("category").isin(*ROLES[role]) & geometry_problem().isNull())


def geometry_problem() -> Column:
    """Why a feature of geojson_features can't be used; null if it can."""
    corners = F.flatten("rings")
    outside = lambda lat, lon: ~valid_coordinates(lat, lon)
    area = F.col("shape").isin("Polygon", "MultiPolygon")
    broken = area & (F.col("rings").isNull() | F.exists("rings", lambda r: (F.size(r) < 4) | (F.get(r, F.lit(0)) != F.element_at(r, -1))))
    return (
        F.when(F.col("category").isNull(), WRONG_CATEGORY)
        .when(F.col("category").isin(*AREAS) & ~area, "POLYGON_REQUIRED")
        .when(F.col("category").isin(*LINES) & ~F.col("shape").isin("LineString", "MultiLineString"), "LINE_REQUIRED")
        .when(broken, "INVALID_GEOMETRY")
        .when((F.col("shape") == "Point") & outside("lat", "lon"), "OUT_OF_BOUNDS")
        .when(area & F.exists(corners, lambda p: outside(p["lat"], p["lon"])), "OUT_OF_BOUNDS")
    )


def reference_bundle(spark: SparkSession, layers: list[dict], read=geojson_features) -> tuple[DataFrame, DataFrame]:
    """(features, audit) of layers, each a dict with name, role, path, source, version, crs and perhaps category_property, category_map.

    A category is mapped first; one that is mapped to None is left out on purpose. Ids must be there, and unique in and across
    the layers (the first in order stands). ``audit``: (layer, feature_id, place, reason) of all that isn't taken.
    """
    seen, parts = set(), []
    for k, layer in enumerate(layers):
        missing = [c for c in ("name", "role", "path", "source", "version", "crs") if not str(layer.get(c) or "").strip()]
        if missing or layer["name"] in seen or layer["role"] not in ROLES:
            raise ValueError(f"layer {layer.get('name')}: needs a name of its own, a known role, and {', '.join(missing) or 'nothing else'}")
        seen.add(layer["name"])
        named = F.coalesce(F.col("properties")[layer.get("category_property", "category")], F.col("category"))
        category, gone = named, F.lit(False)
        for old, new in (layer.get("category_map") or {}).items():
            category, gone = F.when(named == old, F.lit(new)).otherwise(category), gone | (named == old if new is None else F.lit(False))
        rows = read(spark, layer["path"], layer["crs"]).withColumn("category", category)
        wrong = F.when(gone, OUT_OF_SCOPE).when(F.trim(F.coalesce("feature_id", F.lit(""))) == "", NO_ID).when(~F.coalesce(F.col("category").isin(*ROLES[layer["role"]]), F.lit(False)), WRONG_CATEGORY)
        tags = {"layer": layer["name"], "role": layer["role"], "source": layer["source"], "version": str(layer["version"])}
        parts.append(rows.withColumn("reason", wrong).withColumns({c: F.lit(v) for c, v in tags.items()}).withColumn("_k", F.lit(k)))
    rows = reduce(DataFrame.unionByName, parts)
    first = rows.filter("reason is null").groupBy("feature_id").agg(F.min(F.struct("_k", "place")).alias("first"))
    later = F.col("reason").isNull() & (F.struct("_k", "place") != F.col("first"))
    rows = rows.join(first, "feature_id", "left").withColumn("reason", F.when(later, DUPLICATE_ID).otherwise(F.coalesce("reason", geometry_problem())))
    return rows.filter("reason is null").drop("reason", "first", "_k"), rows.filter("reason is not null").select("layer", "feature_id", "place", "reason").distinct()


# All categories of points and of other geometries.
POINTS = (*INDUSTRIAL, "settlement")
GEOMETRIES = ("forest", "agriculture", "road", "railway", "pipeline", "industrial", "urban", "water", "administrative")
DECLARED = "available_categories array<string>, coverage map<string,struct<type:string,coordinates:string>>"


def geojson_coverage(spark: SparkSession, path: str, crs: str = "EPSG:4326") -> tuple[list[str], DataFrame]:
    """(the categories that a collection declares as surveyed, (kind, rings) of the areas where it says that they were; each polygon a row)."""
    document = spark.read.schema(DECLARED).option("multiLine", True).json(path)
    declared = sorted({c for r in document.select("available_categories").collect() for c in r[0] or ()})  # one document
    each = document.select(F.explode("coverage").alias("kind", "g"))
    rows = each.select("kind", F.explode_outer(_polygons(F.col("g.type"), F.col("g.coordinates"))).alias("polygon"))
    corner = _corner(crs)
    return declared, rows.select("kind", F.transform("polygon", lambda ring: F.transform(ring, corner)).alias("rings"))


@dataclass
class Bundle:
    """Layers as one reference: features and audit as reference_bundle has them; ``coverage`` (kind, rings), whose polygons of a kind are its union; the
    categories that exist; the layers' facts; and a hash of all of it."""

    features: DataFrame
    audit: DataFrame
    coverage: DataFrame
    available: list[str]
    layers: list[dict]
    sha256: str


def load_bundle(spark: SparkSession, layers: list[dict], strict: bool = True) -> Bundle:
    """The layers (as for reference_bundle) with their coverage. Each layer is named by the content hash of its features and coverage, whatever its file's
    layout; the bundle by these and by how they are read. With ``strict`` a feature that isn't taken, unless it is left out on purpose, refuses the bundle.
    """
    if not layers:
        raise ValueError("a bundle needs layers")
    features, audit = reference_bundle(spark, layers)
    wrong = audit.filter(F.col("reason") != OUT_OF_SCOPE).groupBy("layer", "reason").count().orderBy("layer", "reason").collect() if strict else []
    if wrong:
        raise ValueError("; ".join(f"{r['count']} in {r.layer}: {r.reason}" for r in wrong))
    available = {r[0] for r in features.select("category").distinct().collect()}  # a handful of known categories
    facts, parts = [], []
    for layer in layers:
        declared, coverage = geojson_coverage(spark, layer["path"], layer["crs"])
        kinds = sorted(r[0] for r in coverage.select("kind").distinct().collect())
        mine = {r[0] for r in features.filter(F.col("layer") == layer["name"]).select("category").distinct().collect()} | set(declared)
        if unknown := sorted((set(declared) | set(kinds)) - {*POINTS, *GEOMETRIES}):
            raise ValueError(f"layer {layer['name']}: unknown categories {', '.join(unknown)}")
        if missing := sorted(set(kinds) - mine):
            raise ValueError(f"layer {layer['name']}: coverage of categories that it doesn't have: {', '.join(missing)}")
        corners = F.flatten("rings")
        bad = F.col("rings").isNull() | F.exists("rings", lambda r: (F.size(r) < 4) | (F.get(r, F.lit(0)) != F.element_at(r, -1))) | F.exists(corners, lambda p: ~valid_coordinates(p["lat"], p["lon"]))
        if not coverage.filter(bad).isEmpty():
            raise ValueError(f"layer {layer['name']}: coverage must be polygons within bounds")
        available |= set(declared)
        digests = [content_hash(rows).first().digest for rows in (geojson_features(spark, layer["path"], layer["crs"]), coverage)]
        facts.append({**{k: v for k, v in layer.items() if k != "path"}, "coverage_categories": kinds, "sha256": hashlib.sha256("|".join(digests).encode()).hexdigest()})
        parts.append(coverage)
    digest = hashlib.sha256(json.dumps(facts, sort_keys=True).encode()).hexdigest()
    return Bundle(features, audit, reduce(DataFrame.unionByName, parts), sorted(available), facts, digest)
