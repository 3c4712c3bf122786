"""Observation files: every column as text, with where each row came from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of lineage; a file that has one of them is refused.
LINEAGE = ("input_file", "input_row", "input_sha256", "source_row")
#: Files beyond this size, which Spark can't hand over whole, have no input_sha256.
HASHED_BYTES = 1 << 30


def observations(spark: SparkSession, paths: list[str], needed: tuple[str, ...] = ()) -> DataFrame:
    """CSV and Parquet files united by column names, all as text, with their lineage, in no particular order.

    input_row counts a file's rows from 2, as the lines of a CSV file with its header are; input_sha256 is the hash of the whole
    file. source_row orders all rows, by file name and row; it is unique, not consecutive. Paths are taken once. A file that lacks
    one of the ``needed`` columns (in any case, blanks around them aside), or brings a column of lineage, is an error.
    """
    paths, frames = sorted(set(paths)), []
    if not paths:
        raise ValueError("no files")
    for path in paths:
        if path.endswith(".csv"):
            rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
        elif path.endswith((".parquet", ".pq")):
            rows = spark.read.parquet(path)
        else:
            raise ValueError(f"neither CSV nor Parquet: {path}")
        names = list(rows.columns)
        plain = [c.strip().lower() for c in names]
        lacking, clashing = [c for c in needed if c not in plain], [c for c in LINEAGE if c in plain]
        if lacking or clashing:
            raise ValueError(f"{path}: lacks {lacking}" if lacking else f"{path}: has {clashing}")
        lineage = [F.col("_metadata.file_path").alias("input_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")]
        frames.append(rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names], *lineage))
    blocks, parts = [], []
    for frame in frames:
        # a block is read by one task, in order: the least number in it is its first row's
        blocks.append(frame.groupBy("input_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows")))
        parts.append(frame)
    block = reduce(DataFrame.unionByName, blocks)
    earlier = F.coalesce(F.sum("_rows").over(Window.partitionBy("input_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    block = block.withColumn("_earlier", earlier).drop("_rows")
    files = spark.read.format("binaryFile").load(paths).filter(F.col("length") <= HASHED_BYTES).select(F.col("path").alias("input_file"), F.sha2("content", 256).alias("input_sha256"))
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("_file", F.lit(k).cast("long")) for k, f in enumerate(parts)])
    rows = united.join(block, ["input_file", "_block"]).join(files, "input_file", "left")
    rows = rows.withColumn("input_row", F.col("_at") - F.col("_first") + F.col("_earlier") + 2)
    return rows.withColumn("source_row", F.shiftleft(F.col("_file"), 40) + F.col("input_row")).drop("_block", "_at", "_first", "_earlier", "_file")


def inline(feeds: DataFrame, key: str, body: str, names: tuple[str, ...], most: int = 32) -> DataFrame:
    """(key, line, names...) of feeds, each row of which holds a CSV text with its header, as text columns.

    The first line names a text's columns, in any order and case; those that aren't in ``names`` are dropped and those
    it lacks are null, as are empty and null texts' rows, of which there are none. ``line`` counts from 2. Fields may be quoted, but hold no
    line breaks. Of two columns of one name the first counts; columns beyond ``most`` aren't read.
    """
    schema = ", ".join(f"c{k} string" for k in range(most))
    lines = feeds.select(key, F.split(F.regexp_replace(F.ltrim(F.col(body), F.lit("\ufeff")), "\r\n?", "\n"), "\n").alias("_lines"))
    fields = lambda text: F.from_csv(text, schema)
    lines = lines.withColumn("_head", fields(F.get("_lines", F.lit(0))))
    head = F.transform(F.array(*[F.col(f"_head.c{k}") for k in range(most)]), lambda c: F.lower(F.trim(c)))
    rows = lines.withColumn("_head", head).select(key, "_head", F.posexplode("_lines").alias("line", "_text"))
    rows = rows.filter((F.col("line") > 0) & (F.trim("_text") != "")).withColumn("_row", fields(F.col("_text")))
    values = F.array(*[F.col(f"_row.c{k}") for k in range(most)])
    rows = rows.select(key, (F.col("line") + 1).alias("line"), "_head", values.alias("_values"))
    value = lambda name: F.get("_values", F.array_position("_head", F.lit(name)).cast("int") - 1)
    return rows.select(key, "line", *[F.when(F.array_contains(F.array_compact("_head"), name), value(name)).alias(name) for name in names])
