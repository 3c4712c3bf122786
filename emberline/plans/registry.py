"""Where the query modules enter their queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberline.plans import model
from emberline.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def enter(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return enter


_MADE: dict[tuple, str] = {}


def _state(spark: SparkSession, sf_dir: str) -> str:
    """Names, lengths and times of the input's files: other input under the same path has another state."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/*.parquet")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return ";".join(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in found)


def remembered(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries read, stored: made once a session and input, and again if the input or its own files changed."""
    key = (spark.sparkContext.applicationId, sf_dir, name, _state(spark, sf_dir))
    path = _MADE.get(key)
    if path is not None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            path = None
    if path is None:
        path = scratch_path(spark, name)
        make().write.parquet(path)
        _MADE[key] = path
    return spark.read.parquet(path)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored hotspots."""
    return remembered(spark, sf_dir, "scored", lambda: model.scored(spark, sf_dir))
