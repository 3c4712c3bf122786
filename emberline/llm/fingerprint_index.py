"""Incremental removal of repeated word windows, with a log-structured index of fingerprints.

The index is a list of immutable runs: tables of (fp, n), bucketed and sorted by fingerprint, so that a new batch's
fingerprints are merge-joined with each run without moving the run. After a batch, its fingerprints become a run;
when ``fan_in`` runs of a level exist, they are merged into one of the next level. A fingerprint stands for the
windows of ``width`` words whose smallest ``gram``-word gram it is (``repeats``). The index only says where to look: groups of windows are then settled by
two 64-bit hashes of all their words, and where those differ, windows are compared word hash by word hash.

Documents with null text have no words. A row without doc_id takes no part and loses nothing. Rows that repeat a
doc_id with the same text are the same document; with other texts they are documents of their own. Words are kept unchanged.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.blocks import BLANKS, find_words, map_batches, text_blocks
from emberline.llm.repeats import Hashed, Windows, covered, fingerprints, repeated_spans, resolve_by, with_spans, with_versions
from emberline.session import free_shuffles, scratch_path, stored

#: Words in a window, and in the grams whose smallest is its anchor.
WIDTH, GRAM = 20, 6
#: Batches that the whole-table operator feeds to the index.
BATCHES = 3
#: Runs of a level that are compacted into one of the next.
FAN_IN = 2


class FingerprintIndex:
    def __init__(self, spark: SparkSession, windows: Windows, fan_in: int = FAN_IN):
        self.spark, self.windows, self.fan_in = spark, windows, fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []

    def _write_run(self, level: int, rows: DataFrame) -> None:
        name = f"fingerprint_run_{uuid.uuid4().hex[:12]}"
        (
            rows.repartition(self.buckets, "fp")
            .write.bucketBy(self.buckets, "fp")
            .sortBy("fp")
            .option("path", scratch_path(self.spark, name))
            .saveAsTable(name)
        )
        self.runs.append((level, name))

    def append(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of documents; returns the fingerprints (fp) of it that occurred before or twice in it."""
        self._write_run(0, fingerprints(batch, "word", self.windows))
        new = self.spark.table(self.runs[-1][1])
        hits = new.filter("n > 1").select("fp")
        for _, run in self.runs[:-1]:
            hits = hits.unionByName(new.join(self.spark.table(run).hint("merge"), "fp", "left_semi").select("fp"))
        hits = stored(hits.distinct(), "hits")
        self._compact()
        return hits

    def _compact(self) -> None:
        while True:
            levels = [level for level, _ in self.runs]
            full = next((x for x in sorted(set(levels)) if levels.count(x) >= self.fan_in), None)
            if full is None:
                return
            old = [run for level, run in self.runs if level == full]
            rows = self.spark.table(old[0])
            for run in old[1:]:
                rows = rows.unionByName(self.spark.table(run))
            self.runs = [x for x in self.runs if x[0] != full]
            self._write_run(full + 1, rows.groupBy("fp").agg(F.sum("n").alias("n")))
            for run in old:
                self._drop(run)

    def _drop(self, run: str) -> None:
        location = self.spark.sql(f"describe formatted {run}").filter("col_name = 'Location'").first()["data_type"]
        self.spark.sql(f"drop table {run}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(location)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        for _, run in self.runs:
            self._drop(run)
        self.runs = []


def window_classes(symbols: np.ndarray, offsets: np.ndarray, at: np.ndarray, windows: Windows) -> np.ndarray:
    """Numbers equal windows of a task alike: in the order of their hashes, neighbours are compared word by word."""
    hashes = Hashed(symbols, offsets, windows).window_hashes(at)
    order = np.argsort(hashes)
    here, before = at[order[1:]], at[order[:-1]]
    new = hashes[order[1:]] != hashes[order[:-1]]
    for k in range(windows.width):
        new |= symbols[here + k] != symbols[before + k]
    names = np.empty(len(at), np.int64)
    names[order] = np.cumsum(np.concatenate(([True], new)))
    return names


def in_batches(docs: DataFrame, batches: int) -> list[DataFrame]:
    """Parts of ``docs`` by ranges of doc_id."""
    cuts = docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted({int(x) for x in cuts}), None]
    parts = []
    for low, high in zip(edges, edges[1:]):
        part = docs if low is None else docs.filter(F.col("doc_id") >= low)
        parts.append(part if high is None else part.filter(F.col("doc_id") < high))
    return parts


def deduplicate(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """Removes each word covered by a window of ``width`` words that also starts earlier in the corpus.

    Returns for each row of ``docs``: doc_id, n_units (its words), n_removed and kept (the words left, joined by a
    blank).
    """
    windows, spark = Windows(width, min(gram, width)), docs.sparkSession
    docs = with_versions(docs)
    index = FingerprintIndex(spark, windows)
    hits = None
    for part in in_batches(docs, batches):
        new = index.append(part)
        hits = new if hits is None else hits.unionByName(new)
        free_shuffles(spark)
    index.close()
    # written before it is joined: adaptive execution then splits a fingerprint that very many groups have
    hits = stored(hits.distinct(), "hits")
    found = stored(repeated_spans(docs, hits, "word", windows, resolve_by(window_classes, "word", windows)), "spans")
    free_shuffles(spark)
    return kept_words(with_spans(docs, found))


def kept_words(docs_spans: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            spans = batch.column(2)
            inner, bounds = spans.flatten(), np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy())))
            starts, stops = inner.field("start").to_numpy(), inner.field("stop").to_numpy()
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                begin, end, words = find_words(data, offsets, BLANKS)
                mine, each = slice(bounds[lo], bounds[hi]), np.diff(bounds[lo : hi + 1])
                base, top = np.repeat(words[:-1], each), np.repeat(words[1:], each)
                gone = covered(len(begin), np.minimum(base + starts[mine], top), np.minimum(base + stops[mine], top))
                # each kept word and one byte after it, which becomes a blank; a document's last word goes without
                left = np.concatenate(([0], np.cumsum(~gone)))[words]
                begin, length = begin[~gone], (end - begin)[~gone] + 1
                tail = np.append(data, np.uint8(0x20))
                out_end = np.concatenate(([0], np.cumsum(length)))
                spread = np.ones(int(out_end[-1]), np.int64)
                if len(begin):
                    spread[out_end[:-1]] = np.append(begin[:1], begin[1:] - (begin + length - 1)[:-1])
                    out = tail[np.cumsum(spread)]
                    out[out_end[1:] - 1] = 0x20
                else:
                    out = tail[:0]
                ends = out_end[left]
                keep = np.ones(len(out), bool)
                some = left[1:] > left[:-1]
                keep[ends[1:][some] - 1] = False
                ends = ends - np.concatenate(([0], np.cumsum(some)))
                kept = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out[keep]))
                removed = np.concatenate(([0], np.cumsum(gone)))[words]
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(words)), pa.array(np.diff(removed)), kept.cast(pa.string())],
                    names=["doc_id", "n_units", "n_removed", "kept"],
                )

    return map_batches(docs_spans, run, "doc_id long, n_units long, n_removed long, kept string")
