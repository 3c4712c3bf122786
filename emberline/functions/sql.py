"""The scalar library as SQL functions: plain expressions that Catalyst inlines, so filters through them are pushed as far as their columns."""

from __future__ import annotations

from pyspark.sql import SparkSession

from emberline.functions import scoring
from emberline.functions.geo import EARTH_KM


def _cases(subject: str, pairs, default: str) -> str:
    return f"CASE {subject} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs) + f" ELSE {default} END"


def functions() -> dict[str, str]:
    """Each function's definition after its name."""
    half = "pow(sin(radians({b} - {a}) / 2), 2)"
    a = f"{half.format(a='lat1', b='lat2')} + cos(radians(lat1)) * cos(radians(lat2)) * {half.format(a='lon1', b='lon2')}"
    levels = " ".join(f"WHEN score BETWEEN {low} AND {high} THEN '{name}'" for name, low, high in scoring.LEVELS)
    day = "hour(ts) + minute(ts) / 60D"
    return {
        "haversine_km": f"(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN CASE WHEN lat1 IS NOT NULL AND lon1 IS NOT NULL AND lat2 IS NOT NULL AND lon2 IS NOT NULL THEN {2 * EARTH_KM!r}D * asin(sqrt(least(1D, greatest(0D, {a})))) END",
        "risk_level": f"(score DOUBLE) RETURNS STRING RETURN CASE {levels} ELSE 'LOW' END",
        "land_cover_code": f"(cover STRING) RETURNS DOUBLE RETURN {_cases('cover', [(name, f'{k}D') for k, name in enumerate(scoring.LAND_COVERS)], '5D')}",
        "satellite_score": f"(status STRING) RETURNS DOUBLE RETURN {_cases('status', [(k, f'{float(v)}D') for k, v in scoring.SATELLITE_SCORES], '0D')}",
        "time_of_day": f"(ts TIMESTAMP) RETURNS DOUBLE RETURN CASE WHEN ts IS NULL THEN 0.5D ELSE least(1D, greatest(0D, 1D - abs({day} - 12D) / 12D)) END",
    }


def overpass_table() -> str:
    """A table function over the text of an Overpass export: its elements as rows (type, id, lat, lon, tags)."""
    row = "type STRING, id BIGINT, lat DOUBLE, lon DOUBLE, tags MAP<STRING, STRING>"
    schema = "elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
    return f"""overpass_elements(document STRING) RETURNS TABLE({row}) RETURN SELECT e.type, e.id, coalesce(e.lat, e.center.lat), coalesce(e.lon, e.center.lon), e.tags
FROM (SELECT explode(from_json(document, '{schema}').elements) AS e)"""


def register(spark: SparkSession) -> list[str]:
    """Creates all of them for the session; gives back their names."""
    for name, body in functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {overpass_table()}")
    return [*functions(), "overpass_elements"]
