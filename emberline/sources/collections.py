"""Feature collections of any size as rows: one JSON document, cut into chunks that are read apart.

A chunk ends behind a brace, so no escape and no member name is cut. Whether a chunk starts inside a string, and how deep, follows from the quotes and brackets of
the chunks before it: running sums over one small row a chunk. Then each chunk is scanned by itself; objects that reach over chunks are put together from parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.session import stored

#: Documents up to this size are parsed by one task each.
WHOLE_BYTES = 16 << 20
#: A chunk holds at least this much, up to the next brace.
CHUNK_BYTES = 4 << 20

FEATURE = "struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
KEY = ["file", "block", "seq"]
NAMED = re.compile(rb'"features"[ \t\r\n]*:[ \t\r\n]*$')
#: What a row of a scanned chunk is: an object as a whole, the end, middle or start of one, or a mark that what was open is none.
WHOLE, END, MIDDLE, START, NONE = range(5)


def feature_rows(spark: SparkSession, path: str) -> DataFrame:
    """(place, f) of the objects in the array ``features`` of a GeoJSON document, in their order.

    A document of more than WHOLE_BYTES is read in chunks; there, elements that aren't objects are skipped and don't count for ``place``,
    and a document whose brackets don't close is an error. A folder's documents are read one by one.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength() > WHOLE_BYTES:
        return split_features(spark, path)
    texts = spark.read.schema("features array<string>").option("multiLine", True).json(path).select(F.posexplode("features").alias("place", "text"))
    return texts.select("place", F.from_json("text", FEATURE).alias("f"))  # as for chunks: nested values come out in one layout


def outside(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the brackets of a text that starts outside strings, which of them a string holds, and the text's number of quotes as an array."""
    quote = data == ord('"')
    slashes = np.flatnonzero(data == ord("\\"))
    if len(slashes):  # in a run of backslashes every second one is escaped; after an odd run, so is what follows
        heads = np.concatenate(([True], np.diff(slashes) > 1))
        head = np.maximum.accumulate(np.where(heads, slashes, 0))
        odd = slashes[(slashes - head) % 2 == 0] + 1
        quote[odd[odd < len(data)]] = False
    lower = data | 0x20  # [ and {, ] and } differ by this bit only
    at = np.flatnonzero((lower == ord("{")) | (lower == ord("}")))
    quotes = np.cumsum(quote)
    return at, (quotes[at] & 1).astype(bool), quotes[-1:]


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of pieces that end with a brace, with the parity of their quotes and by how much they change the depth if they start outside a string, or inside."""

    def row(source, seq, parts):
        body = b"".join(parts)
        data = np.frombuffer(body, np.uint8)
        at, held, quotes = outside(data)
        step = np.where((data[at] | 0x20) == ord("{"), 1, -1)
        values = [source[0], source[1], seq, body, int(quotes[0]) & 1 if len(quotes) else 0, int(step[~held].sum()), int(step[held].sum())]
        return pa.record_batch([pa.array([v], t) for v, t in zip(values, TYPES, strict=True)], names=[*KEY, "body", "parity", "plain", "inside"])

    source, seq, parts, size = None, 0, [], 0
    for batch in batches:
        for file, block, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if source != (file, block):
                if parts:
                    yield row(source, seq, parts)
                source, seq, parts, size = (file, block), 0, [], 0
            parts.append(piece)
            size += len(piece)
            if size >= CHUNK_BYTES:
                yield row(source, seq, parts)
                seq, parts, size = seq + 1, [], 0
    if parts:
        yield row(source, seq, parts)


TYPES = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64())


def scanned(body: bytes, in_string: bool, depth: int) -> tuple[list[tuple[int, bytes, int | None]], int | None]:
    """Rows (kind, text, whether in the features; None: as at the chunk's start) of a chunk that starts at ``depth``, and what its end lies in (None likewise)."""
    data = np.frombuffer(body, np.uint8)
    at, held, _ = outside(data)
    at = at[held == in_string]
    up = (data[at] | 0x20) == ord("{")
    level = depth + np.cumsum(np.where(up, 1, -1))
    events = (level == 2) | (up & (level == 3))
    rows, mine, start, open_ = [], None, None, depth > 2
    for place, opens, height in zip(at[events].tolist(), up[events].tolist(), level[events].tolist(), strict=True):
        brace = body[place] in b"{}"
        if height == 3:
            start = place if brace else -1
        elif opens:  # a member of the document begins
            mine = int(not brace and NAMED.search(body, max(0, place - 4096), place) is not None)
        else:
            if open_:
                rows.append((END, body[: place + 1], None) if brace else (NONE, b"", None))
            elif start is not None and start >= 0:
                rows.append((WHOLE, body[start : place + 1], mine))
            start, open_ = None, False
    if open_:
        rows.append((MIDDLE, body, None))
    elif start is not None:
        rows.append((START, body[start:], mine) if start >= 0 else (START, b"", 0))
    return rows, mine


def scan_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, block, seq, body, odd, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows, last = scanned(body, bool(odd), depth)
            rows.append((-1, b"", last))
            kinds, texts, mine = zip(*rows, strict=True)
            n = len(rows)
            yield pa.record_batch(
                [pa.array([file] * n), pa.array([block] * n), pa.array([seq] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(kinds, pa.int32()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(mine, pa.int32())],
                names=[*KEY, "k", "kind", "text", "mine"],
            )


def split_features(spark: SparkSession, path: str) -> DataFrame:
    pieces = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.encode(F.concat("value", F.lit("}")), "UTF-8").alias("piece"))
    chunks = stored(pieces.mapInArrow(chunk_rows, "file string, block long, seq int, body binary, parity int, plain long, inside long"), "chunks")
    by_file = Window.partitionBy("file").orderBy("block", "seq")  # one small row a chunk
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    states = chunks.drop("body").withColumn("odd", F.pmod(F.coalesce(F.sum("parity").over(earlier), F.lit(0)), F.lit(2)).cast("int"))
    states = states.withColumn("step", F.when(F.col("odd") == 0, F.col("plain")).otherwise(F.col("inside")))
    states = stored(states.withColumn("depth", F.coalesce(F.sum("step").over(earlier), F.lit(0)).cast("int")).select(*KEY, "odd", "depth", "step", "parity"), "states")
    # behind the last brace stands one that the reader added, unless the document ends with its own
    ends = states.groupBy("file").agg(F.sum("step").alias("depth"), F.pmod(F.sum("parity"), F.lit(2)).alias("odd"))
    if broken := ends.filter("depth not in (0, -1) or odd <> 0").select("file").first():
        raise ValueError(f"{broken.file}: not a whole document")
    rows = chunks.select(*KEY, "body").join(states.select(*KEY, "odd", "depth"), KEY)
    rows = stored(rows.mapInArrow(scan_chunks, "file string, block long, seq int, k int, kind int, text string, mine int"), "objects")
    within = rows.filter("kind = -1").select(*KEY, F.coalesce(F.last("mine", True).over(earlier), F.lit(0)).alias("before"))
    rows = rows.filter("kind >= 0").join(within, KEY).withColumn("mine", F.coalesce("mine", "before")).drop("before")
    parts = rows.filter(F.col("kind") != WHOLE)
    # keys alone are numbered: an object's parts follow the start that they belong to
    ordered = Window.partitionBy("file").orderBy("block", "seq", "k")
    owner = parts.select(*KEY, "k", F.sum(F.when(F.col("kind") == START, 1).otherwise(0)).over(ordered).alias("nth"))
    joined = parts.join(owner, [*KEY, "k"]).groupBy("file", "nth").agg(
        F.min(F.struct("block", "seq", "k", "mine")).alias("at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "k", "text"))), lambda p: p["text"]), "").alias("text"),
        F.bool_or(F.col("kind") == END).alias("ended"),
    )
    whole = rows.filter((F.col("kind") == WHOLE) & (F.col("mine") == 1)).select(*KEY, "k", "text")
    found = whole.unionByName(joined.filter("ended and at.mine = 1").select("file", "at.block", "at.seq", "at.k", "text"))
    found = stored(found, "features")
    counts = found.groupBy(*KEY).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    numbered = found.join(counts, KEY).withColumn("place", (F.col("before") + F.row_number().over(Window.partitionBy(*KEY).orderBy("k")) - 1).cast("int"))
    return numbered.select("place", F.from_json("text", FEATURE).alias("f"))
