"""Repeated windows of fixed length, found through groups of windows that share one sampled fingerprint.

A window is ``width`` consecutive units (bytes or words) of one document. Its *anchor* is the leftmost of
the windows' ``gram``-unit grams with the smallest hash, so equal windows have equal anchors at equal
places. Adjacent windows mostly share their anchor; a maximal run of them is a *group*: one row instead of
many. The groups of a document part its windows, and two windows can only be equal if the hashes of their
anchors (``fp``) are. ``ctx`` is a second hash, of all units that a group's windows cover and of the
anchor's place: groups equal in both are equal window by window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.blocks import BLANKS, ROLLING, SECOND, U64, find_words, map_batches, mix, ranges, text_blocks, word_hashes
from emberline.session import discard, free_shuffles, stored


@dataclass(frozen=True)
class Windows:
    width: int
    gram: int

    @property
    def reach(self) -> int:
        """Grams in a window."""
        return self.width - self.gram + 1


def _sliding_min(values: np.ndarray, reach: int) -> np.ndarray:
    span, out = 1, values
    while span * 2 <= reach:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (reach - span)], out[reach - span :]) if reach > span else out


@dataclass
class Groups:
    """Arrays with an entry for each group; ``start`` counts units of the block."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    fp: np.ndarray
    ctx: np.ndarray


class Hashed:
    """A block's units under both rolling hashes."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray, windows: Windows):
        self.symbols, self.offsets, self.windows = symbols, offsets, windows

    @cached_property
    def second(self) -> np.ndarray:
        plain = self.symbols.dtype == np.uint8
        return SECOND.prefix(self.symbols if plain else mix(self.symbols ^ U64(0x9E3779B97F4A7C15)))

    def window_hashes(self, starts: np.ndarray) -> np.ndarray:
        return mix(SECOND.spans(self.second, starts, starts + self.windows.width))

    def groups(self, contexts: bool = True) -> Groups:
        """``contexts``: whether ctx is wanted; else it's empty."""
        w, n = self.windows, len(self.symbols)
        rooms = np.maximum(np.diff(self.offsets) - w.width + 1, 0)
        at = ranges(self.offsets[:-1], rooms)
        if not len(at):
            empty = np.zeros(0, np.int64)
            return Groups(empty, empty, empty, empty.astype(U64), empty.astype(U64))
        spots = np.arange(n - w.gram + 1)
        grams = ROLLING.spans(ROLLING.prefix(self.symbols), spots, spots + w.gram)  # ordered by their high bits, which are mixed
        bits = U64(max(1, int(n).bit_length()))
        anchors = _sliding_min((grams >> bits << bits) | spots.astype(U64), w.reach)
        anchors = (anchors[at] & ((U64(1) << bits) - U64(1))).astype(np.int64)
        heads = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
        count = np.diff(np.append(heads, len(at)))
        start, anchors = at[heads], anchors[heads]
        row, fp = np.searchsorted(self.offsets, start, "right") - 1, mix(grams[anchors])
        if not contexts:
            return Groups(row, start, count, fp, fp[:0])
        place = (anchors - start).astype(U64) * U64(0x100000001B3) + count.astype(U64)
        ctx = mix(SECOND.spans(self.second, start, start + count - 1 + w.width) ^ mix(place))
        return Groups(row, start, count, fp, ctx)


# ---------------------------------------------------------------------------------------------------------
# Spark side. ``pos`` orders all places of the corpus: by doc_id, version and start.
# ---------------------------------------------------------------------------------------------------------

GROUP_SCHEMA = "fp long, ctx long, doc_id long, version long, start int, count int"
#: Contexts of one fingerprint that one task resolves; a fingerprint with more is split into salts.
CONTEXTS_A_TASK = 4096


#: Slots into which the doc_ids with several texts are hashed; bounds what is broadcast.
VERSION_SLOTS = 1 << 16


def with_versions(docs: DataFrame) -> DataFrame:
    """(doc_id, version, text): rows equal in doc_id and version are one document.

    Rows that repeat a doc_id with the same text share a version. Where a doc_id comes with several texts, each text is a
    document of its own: its version is a 64-bit hash of it, which also orders the texts of a doc_id. Others have version 0,
    but for some doc_ids that share a slot with such a one.
    """
    text_hash, slot = F.xxhash64(F.coalesce("text", F.lit(""))), F.pmod(F.xxhash64("doc_id"), F.lit(VERSION_SLOTS)).cast("int")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    ends = docs.filter("doc_id is not null").select("doc_id", text_hash.alias("h")).groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    slots = stored(ends.filter("a <> b").select(slot.alias("slot")).distinct(), "slots")
    if slots.isEmpty():
        return docs.select("doc_id", F.lit(0).cast("long").alias("version"), "text")
    marked = docs.withColumn("slot", slot).join(F.broadcast(slots.withColumn("several", F.lit(True))), "slot", "left")
    return marked.select("doc_id", F.when(F.col("several"), text_hash).otherwise(F.lit(0).cast("long")).alias("version"), "text")


def units_of(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and row offsets of a block: its bytes, or the hashes of its words."""
    if unit == "byte":
        return data, offsets
    starts, ends, offsets = find_words(data, offsets, BLANKS)
    return word_hashes(data, starts, ends), offsets


def group_rows(docs: DataFrame, unit: str, windows: Windows) -> DataFrame:
    """A row for each group of windows of each document; documents without doc_id have none."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            versions = batch.column(1).to_numpy()
            for lo, hi, data, offsets in text_blocks(batch.column(2)):
                symbols, offsets = units_of(data, offsets, unit)
                g = Hashed(symbols, offsets, windows).groups()
                yield pa.record_batch(
                    [
                        pa.array(g.fp.view(np.int64)),
                        pa.array(g.ctx.view(np.int64)),
                        pa.array(ids[lo:hi][g.row].astype(np.int64)),
                        pa.array(versions[lo:hi][g.row]),
                        pa.array((g.start - offsets[g.row]).astype(np.int32)),
                        pa.array(g.count.astype(np.int32)),
                    ],
                    names=["fp", "ctx", "doc_id", "version", "start", "count"],
                )

    rows = docs.select("doc_id", "version", "text").filter("doc_id is not null and text is not null")
    return map_batches(rows, run, GROUP_SCHEMA)


def fingerprints(docs: DataFrame, unit: str, windows: Windows) -> DataFrame:
    """(fp, n): how many groups have each fingerprint."""

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                fp, n = np.unique(Hashed(*units_of(data, offsets, unit), windows).groups(contexts=False).fp, return_counts=True)
                yield pa.record_batch([pa.array(fp.view(np.int64)), pa.array(n.astype(np.int64))], names=["fp", "n"])

    rows = map_batches(docs.filter("doc_id is not null and text is not null").select("text"), run, "fp long, n long")
    return rows.groupBy("fp").agg(F.sum("n").alias("n"))


def _pos() -> Column:
    return F.struct("doc_id", "version", "start")


def repeated_spans(
    docs: DataFrame, repeated_fps: DataFrame, unit: str, windows: Windows, resolve: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """(doc_id, version, start, stop) in units: covers all that lies in a window which also starts earlier. ``repeated_fps`` is discarded.

    ``docs`` has versions. ``repeated_fps`` (fp) holds every fingerprint of more than one group. Groups equal as a whole are settled by
    their hashes; where a fingerprint comes in several contexts, ``resolve`` compares those contexts window by
    window: it gets (fp, salt, salts, doc_id, version, start, count, units) and returns spans.
    """
    spark = docs.sparkSession
    hot = stored(group_rows(docs, unit, windows).join(repeated_fps.select("fp"), "fp", "left_semi"), "groups")
    free_shuffles(spark)
    firsts = stored(hot.groupBy("fp", "ctx").agg(F.min(_pos()).alias("first"), F.min("count").alias("count")), "firsts")
    free_shuffles(spark)
    later = (
        hot.join(firsts.select("fp", "ctx", "first"), ["fp", "ctx"])
        .filter(_pos() != F.col("first"))
        .select("doc_id", "version", "start", (F.col("start") + F.col("count") - 1 + windows.width).alias("stop"))
    )
    later = stored(later, "later")
    discard(hot, repeated_fps)
    free_shuffles(spark)
    # written before it is joined: adaptive execution then splits a fingerprint of very many contexts
    several = stored(firsts.groupBy("fp").agg(F.count("*").alias("m")).filter("m > 1"), "several")
    contexts = (
        firsts.join(several, "fp")
        .withColumn("salts", F.ceil(F.col("m") / CONTEXTS_A_TASK).cast("int"))
        .groupBy("first.doc_id", "first.version")
        .agg(F.collect_list(F.struct("fp", "salts", "first.start", "count")).alias("at"))
    )
    found = resolve(_context_units(docs, contexts, unit, windows))
    discard(firsts, several)
    return later.unionByName(found)


def _context_units(docs: DataFrame, contexts: DataFrame, unit: str, windows: Windows) -> DataFrame:
    """The units that each context covers, cut from one row of each document: bytes, or word hashes as bytes."""
    schema = "fp long, salt int, salts int, doc_id long, version long, start int, count int, units binary"

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            versions, at = batch.column(1).to_numpy(), batch.column(3)
            inner, bounds = at.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(at).to_numpy())))
            fps, salts, starts, counts = (inner.field(k).to_numpy() for k in ("fp", "salts", "start", "count"))
            for lo, hi, data, offsets in text_blocks(batch.column(2)):
                symbols, offsets = units_of(data, offsets, unit)
                raw, size = symbols.tobytes(), symbols.dtype.itemsize
                mine = slice(bounds[lo], bounds[hi])
                row = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
                begin = offsets[row] + starts[mine]
                end = begin + counts[mine] - 1 + windows.width
                cut = [raw[a * size : b * size] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                doc, version = ids[lo:hi][row].astype(np.int64), versions[lo:hi][row]
                # the place counts as well: one long document can have very many contexts of a fingerprint
                salt = (mix(doc.view(U64) ^ version.view(U64) ^ mix(starts[mine].astype(U64))) % salts[mine].astype(U64)).astype(np.int32)
                yield pa.record_batch(
                    [fps[mine], salt, salts[mine], doc, version, starts[mine], counts[mine], pa.array(cut, pa.binary())],
                    names=["fp", "salt", "salts", "doc_id", "version", "start", "count", "units"],
                )

    once = docs.filter("doc_id is not null and text is not null").groupBy("doc_id", "version").agg(F.first("text").alias("text"))
    rows = once.join(contexts, ["doc_id", "version"])
    return map_batches(rows, run, schema)


LOCAL_SCHEMA = "fp long, content binary, doc_id long, version long, start int, stop int, open boolean"


def resolve_by(classes: Callable, unit: str, windows: Windows) -> Callable[[DataFrame], DataFrame]:
    """Resolves contexts in tasks that hold all contexts of a (fingerprint, salt).

    ``classes(units, lengths, starts)`` numbers equal windows alike within a task. A window at another place than
    the first of its class in its task is a repeat. The firsts of fingerprints with several salts are compared once more,
    across salts, by all their units.
    """

    def local(table: pa.Table) -> Iterator[pa.RecordBatch]:
        fps, salts, docs, versions, starts, counts = (table.column(k).to_numpy() for k in ("fp", "salts", "doc_id", "version", "start", "count"))
        units = table.column("units").combine_chunks().cast(pa.large_binary())
        buffers = units.buffers()
        size = 1 if unit == "byte" else 8
        offsets = np.frombuffer(buffers[1], np.int64)[units.offset : units.offset + len(units) + 1]
        data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
        symbols, offsets = (data if size == 1 else data.view(U64)), (offsets - offsets[0]) // size
        at = ranges(offsets[:-1], counts)
        row = np.repeat(np.arange(len(counts)), counts)
        place = starts[row] + (at - offsets[row])
        names = classes(symbols, offsets, at, windows)
        order = np.lexsort((place, versions[row], docs[row], names))
        new = np.concatenate(([True], names[order[1:]] != names[order[:-1]]))
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        repeat = np.zeros(len(at), bool)
        repeat[order] = (place[order] != place[first]) | (docs[row[order]] != docs[row[first]]) | (versions[row[order]] != versions[row[first]])
        # adjacent repeats of a context become one span
        joined = repeat[1:] & repeat[:-1] & (row[1:] == row[:-1])
        heads = np.flatnonzero(repeat & ~np.concatenate(([False], joined)))
        tails = np.flatnonzero(repeat & ~np.concatenate((joined, [False])))
        none = np.zeros(len(heads), np.int64)
        yield _spans(none, [None] * len(heads), docs[row[heads]], versions[row[heads]], place[heads], place[tails] + windows.width, False)
        open_ = np.flatnonzero(~repeat & (salts[row] > 1))
        if len(open_):
            own, raw = row[open_], data.tobytes()
            content = [raw[a * size : (a + windows.width) * size] for a in at[open_].tolist()]
            yield _spans(fps[own], content, docs[own], versions[own], place[open_], place[open_] + windows.width, True)

    def chunks(rows: pa.Table, final: bool) -> tuple[list[pa.Table], pa.Table]:
        """``rows`` cut where fingerprint or salt change, into parts of little over RESOLVE_BYTES; and what may go on."""
        fp, salt = rows.column("fp").to_numpy(), rows.column("salt").to_numpy()
        sizes = np.concatenate(([0], np.cumsum(pc.binary_length(rows.column("units")).to_numpy())))
        parts, start = [], 0
        for cut in (np.flatnonzero((fp[1:] != fp[:-1]) | (salt[1:] != salt[:-1])) + 1).tolist():
            if sizes[cut] - sizes[start] >= RESOLVE_BYTES:
                parts.append(rows.slice(start, cut - start))
                start = cut
        if final and start < len(rows):
            parts.append(rows.slice(start))
            start = len(rows)
        return parts, rows.slice(start)

    def run(batches):
        rest = None
        for batch in batches:  # sorted by fingerprint and salt
            rows = pa.Table.from_batches([batch])
            parts, rest = chunks(rows if rest is None else pa.concat_tables([rest, rows]), False)
            for part in parts:
                yield from local(part)
        if rest is not None and len(rest):
            for part in chunks(rest, True)[0]:
                yield from local(part)

    def resolve(contexts: DataFrame) -> DataFrame:
        n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = contexts.repartition(n, "fp", "salt").sortWithinPartitions("fp", "salt")
        found = stored(map_batches(dealt, run, LOCAL_SCHEMA), "resolved")
        firsts = found.filter("open").withColumn("pos", _pos())
        least = firsts.groupBy("fp", "content").agg(F.min("pos").alias("first"), F.count("*").alias("k")).filter("k > 1")
        across = firsts.join(least, ["fp", "content"]).filter("pos <> first")
        return found.filter("not open").unionByName(across.select(*found.columns)).select("doc_id", "version", "start", "stop")

    return resolve


#: Bytes of contexts that are resolved together in a task.
RESOLVE_BYTES = 1 << 19


def _spans(fp, content, doc, version, start, stop, is_open: bool) -> pa.RecordBatch:
    return pa.record_batch(
        [
            pa.array(fp, pa.int64()),
            pa.array(content, pa.binary()),
            pa.array(doc, pa.int64()),
            pa.array(version, pa.int64()),
            pa.array(start.astype(np.int32)),
            pa.array(stop.astype(np.int32)),
            pa.array(np.full(len(doc), is_open)),
        ],
        names=["fp", "content", "doc_id", "version", "start", "stop", "open"],
    )


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text, spans): every document with the spans found in it, in any order."""
    by_doc = spans.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return docs.join(by_doc, ["doc_id", "version"], "left").select("doc_id", "text", "spans")


def covered(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """True for each of ``n`` units that lies in a span."""
    edge = np.bincount(np.minimum(starts, n), minlength=n + 1) - np.bincount(np.minimum(stops, n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0
