"""Suffix-array deduplication of byte strings, with the difference cover {1, 2} modulo 3.

Windows of ``width`` bytes that may repeat are gathered by fingerprint (``repeats``), so that all places of an
equal window meet in one task and no task holds more than a bounded share. There their suffixes are sorted:
triples at the sampled places (1 and 2 modulo 3) are sorted and named, names that aren't unique yet are sorted by
recursion on the names, the remaining suffixes are merged in by one symbol and a rank, and neighbours in the order
that agree in ``width`` bytes form a class. A symbol is eight bytes, so triples cover 24, 72, 216, ... bytes.

Documents with null text count as empty. A row without doc_id takes no part and loses nothing. Rows that repeat a
doc_id with the same text are the same document; with other texts they are documents of their own. Matches never cross documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.blocks import U64, map_batches, text_blocks
from emberline.llm.repeats import Windows, covered, fingerprints, repeated_spans, resolve_by, with_spans, with_versions
from emberline.session import free_shuffles, stored

#: Bytes in a repeated string that is removed.
WIDTH = 100
#: Bytes of the grams whose smallest is a window's anchor.
GRAM = 24


def _order(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``keys`` in order, first key first, and which rows of it differ from the one before. Where several keys are
    all under 2**21, three fit in one number and are sorted as such."""
    if len(keys) > 1 and max(int(k.max(initial=0)) for k in keys) >= 1 << 21:
        order = np.lexsort(keys[::-1])
        new = np.zeros(max(len(order) - 1, 0), bool)
        for k in keys:
            new |= k[order][1:] != k[order][:-1]
        return order, new
    key = keys[0].astype(U64)
    for more in keys[1:]:
        key = key << U64(21) | more.astype(U64)
    order = np.argsort(key)
    key = key[order]
    return order, key[1:] != key[:-1]


def dense(values: np.ndarray, least: int = 1) -> np.ndarray:
    """Values as ranks from ``least``; equal ones share a rank."""
    order, new = _order([values])
    out = np.empty(len(values), np.int64)
    if len(values):
        out[order[0]] = least
        out[order[1:]] = np.cumsum(new) + least
    return out


def suffix_ranks(text: np.ndarray, covers: int, depth: int) -> np.ndarray:
    """Ranks of all suffixes of ``text`` (numbers from 1 to its length), ordered by their first ``depth``
    original units at least.

    ``covers``: units that a symbol of ``text`` stands for. Suffixes that agree in ``depth`` units may come in any
    order among themselves.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(3, np.int64)))
    at = np.arange(n)
    sampled = np.concatenate((at[at % 3 == 1], at[at % 3 == 2]))
    order, new = _order([padded[sampled], padded[sampled + 1], padded[sampled + 2]])
    names = np.ones(len(sampled), np.int64)
    names[order[1:]] = np.cumsum(new) + 1
    if not new.all() and 3 * covers < depth:
        # The names at 1 modulo 3, then those at 2 modulo 3, parted by a symbol below all.
        ones = int((sampled % 3 == 1).sum())
        inner = suffix_ranks(np.concatenate((names[:ones], [0], names[ones:])) + 1, 3 * covers, depth)
        names = np.concatenate((inner[:ones], inner[ones + 1 :]))
        order = np.argsort(names)
    place = np.empty(len(sampled), np.int64)
    place[order] = np.arange(len(order))
    rank = np.zeros(n + 3, np.int64)
    rank[sampled] = names + 1
    zeros = at[at % 3 == 0]
    out = np.empty(n, np.int64)
    out[sampled] = place
    before = np.zeros(len(zeros), np.int64)
    for residue in (1, 2):
        others = at[at % 3 == residue]
        both = np.concatenate((zeros, others))
        keys = [padded[both], rank[both + 1]] if residue == 1 else [padded[both], padded[both + 1], rank[both + 2]]
        merged, _ = _order(keys)
        is_zero = merged < len(zeros)
        ahead = np.cumsum(is_zero)
        before[merged[is_zero]] += (np.arange(len(merged)) + 1 - ahead)[is_zero]
        out[both[merged[~is_zero]]] += ahead[~is_zero]
        if residue == 1:
            out[both[merged[is_zero]]] = np.arange(len(zeros))
    out[zeros] += before
    return out


#: Bytes of a symbol of the sorted string.
PACK = 8


def suffix_classes(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, windows: Windows) -> np.ndarray:
    """Numbers equal windows alike: by a suffix array of all strings of a task, whose neighbours are compared over the window's width."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(2 * PACK, np.uint8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, PACK)[:n]
    symbols = np.ascontiguousarray(eight).view(">u8").reshape(-1).astype(U64)
    # The places 0, 8, 16, ..., then 1, 9, 17, ...: a suffix of this string is a suffix of the bytes by eights.
    places = np.concatenate([np.arange(r, n, PACK) for r in range(PACK)])
    order_in = np.empty(n, np.int64)
    order_in[places] = np.arange(n)
    ranks = suffix_ranks(dense(symbols[places]), PACK, windows.width)[order_in]
    order = np.argsort(ranks[at])
    here, before = at[order[1:]], at[order[:-1]]
    new = np.zeros(len(here), bool)  # where a suffix and its neighbour differ within the window's width
    for k in (*range(0, windows.width - PACK, PACK), windows.width - PACK) if windows.width >= PACK else ():
        new |= symbols[here + k] != symbols[before + k]
    for k in range(windows.width if windows.width < PACK else 0):
        new |= data[here + k] != data[before + k]
    names = np.empty(len(at), np.int64)
    names[order] = np.cumsum(np.concatenate(([True], new)))
    return names


KEPT_SCHEMA = "doc_id long, n_units long, removed array<struct<start:int,stop:int>>, kept binary"


def kept_bytes(docs_spans: DataFrame, windows: Windows) -> DataFrame:
    """(doc_id, n_units, removed, kept): maximal removed runs of bytes, and what is left."""

    def run(batches):
        for batch in batches:
            spans = batch.column(2)
            inner, bounds = spans.flatten(), np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy())))
            starts, stops = inner.field("start").to_numpy(), inner.field("stop").to_numpy()
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                mine = slice(bounds[lo], bounds[hi])
                base = np.repeat(offsets[:-1], np.diff(bounds[lo : hi + 1]))
                ends = np.repeat(offsets[1:], np.diff(bounds[lo : hi + 1]))
                gone = covered(len(data), np.minimum(base + starts[mine], ends), np.minimum(base + stops[mine], ends))
                edge = gone[1:] != gone[:-1]
                cut = np.zeros(len(gone), bool)
                cut[1:] = edge
                heads = offsets[:-1][offsets[:-1] < len(data)]
                cut[heads] = True
                first = np.flatnonzero(gone & cut)
                after = np.append(np.flatnonzero(cut), len(gone))
                last = after[np.searchsorted(after, first, "right")] if len(first) else first
                row = np.searchsorted(offsets, first, "right") - 1
                runs = pa.StructArray.from_arrays(
                    [pa.array((x - offsets[row]).astype(np.int32)) for x in (first, last)], names=["start", "stop"]
                )
                kept_at = np.concatenate(([0], np.cumsum(~gone)))[offsets]
                kept = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), hi - lo, [None, pa.py_buffer(kept_at.astype(np.int64)), pa.py_buffer(data[~gone])]
                )
                yield pa.record_batch(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32), runs),
                        kept.cast(pa.binary()),
                    ],
                    names=["doc_id", "n_units", "removed", "kept"],
                )

    return map_batches(docs_spans, run, KEPT_SCHEMA)


def deduplicate(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Removes each byte covered by a ``width``-byte string that also starts earlier in the corpus.

    Returns for each row of ``docs``: doc_id, n_units (its bytes), removed (maximal runs) and kept (bytes).
    """
    windows = Windows(width, min(gram, width))
    spark = docs.sparkSession
    docs = with_versions(docs)
    hot = stored(fingerprints(docs, "byte", windows).filter("n > 1").select("fp"), "fingerprints")
    free_shuffles(spark)
    found = stored(repeated_spans(docs, hot, "byte", windows, resolve_by(suffix_classes, "byte", windows)), "spans")
    free_shuffles(spark)
    return kept_bytes(with_spans(docs, found), windows)
