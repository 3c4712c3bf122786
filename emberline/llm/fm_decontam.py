"""Benchmark decontamination by an FM-index of each training shard.

A benchmark item's phrases are its windows of ``width`` consecutive words (an item of fewer words is one phrase). A
shard is a batch of documents. Its words become numbers of the benchmark's vocabulary; stretches that can't hold a
phrase, because a word or a pair of adjacent words isn't in the benchmark, are left out, which loses no match. Over the
rest, strung together with separators, the Burrows-Wheeler transform is held in a wavelet matrix. Every phrase is
searched backward through its ranks, all phrases of a shard at once; places come from the suffix positions sampled,
and overlapping places merge into removal spans.

The benchmark reaches the tasks in portions of bounded size, one at a time; with several, the spans that each finds are
written and then merged. Null text has no words. An item without words or without item_id takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.blocks import LOWER, NON_ALNUM, U64, find_words, map_batches, mix, ranges, text_blocks, word_hashes
from emberline.llm.repeats import covered
from emberline.session import stored

WIDTH = 10
#: Words of the benchmark that are sent to the executors at once.
PORTION_WORDS = 200_000
#: Every so many suffix positions are sampled.
SAMPLED = 8


class WaveletMatrix:
    def __init__(self, values: np.ndarray, bits: int):
        self.levels, n = [], len(values)
        for level in reversed(range(bits)):
            bit = (values >> level & 1).astype(bool)
            ones = np.concatenate(([0], np.cumsum(bit)))
            self.levels.append((level, ones, n - int(ones[-1])))
            values = np.concatenate((values[~bit], values[bit]))

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``value`` stands before place ``at``."""
        first = np.zeros_like(at)
        for level, ones, zeros in self.levels:
            one = (value >> level & 1).astype(bool)
            at, first = (np.where(one, zeros + ones[x], x - ones[x]) for x in (at, first))
        return at - first

    def value(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at places, and how often each stands before."""
        value, first = np.zeros_like(at), np.zeros_like(at)
        for _, ones, zeros in self.levels:
            one = ones[at + 1] > ones[at]
            value = value * 2 + one
            at, first = (np.where(one, zeros + ones[x], x - ones[x]) for x in (at, first))
        return value, at - first


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By doubling; ``text`` ends with its only 0."""
    rank, step = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:] + 1
        keys = rank * (len(text) + 1) + after
        order = np.argsort(keys, kind="stable")
        sortd = keys[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.concatenate(([0], sortd[1:] != sortd[:-1])))
        step *= 2
        if rank[order[-1]] == len(text) - 1 or step >= len(text):
            return order


class FMIndex:
    def __init__(self, text: np.ndarray):
        """``text``: numbers over 0; a final 0 is added."""
        text = np.append(text, 0)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.n, top = len(text), int(text.max())
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        self.ranks = WaveletMatrix(bwt, max(1, top.bit_length()))
        marked = order % SAMPLED == 0
        self.marked, self.marks, self.samples = marked, np.concatenate(([0], np.cumsum(marked))), order[marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases, given as right-aligned rows of numbers."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for k in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > k) & (lo < hi))
            if not len(live):
                break
            c = phrases[live, -1 - k]
            known = c < len(self.before) - 1
            hi[live[~known]] = lo[live[~known]]
            live, c = live[known], c[known]
            for end in (lo, hi):
                end[live] = self.before[c] + self.ranks.rank(c, end[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, open_, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(open_):
            here = self.marked[rows]
            out[open_[here]] = self.samples[self.marks[rows[here]]] + steps
            open_, rows = open_[~here], rows[~here]
            value, count = self.ranks.value(rows)
            rows, steps = self.before[value] + count, steps + 1
        return out


@dataclass
class Phrases:
    """A portion of the benchmark: its vocabulary and pairs (hashes, sorted), phrases by number, and their items."""

    vocabulary: np.ndarray
    pairs: np.ndarray
    numbers: np.ndarray
    lengths: np.ndarray
    item_bounds: np.ndarray
    items: list[str]


def words_of(column: pa.Array):
    """(first row, end row, word hashes, row offsets into them) of blocks of a text column."""
    for lo, hi, data, offsets in text_blocks(column):
        data = LOWER[data]
        starts, ends, words = find_words(data, offsets, NON_ALNUM)
        yield lo, hi, word_hashes(data, starts, ends), words, starts, ends


def phrases_of(ids: list[str], texts: pa.Array, width: int) -> Phrases | None:
    owners, found, pairs = [], [], []
    for lo, _, hashes, words, _, _ in words_of(texts):
        for k, (a, b) in enumerate(zip(words[:-1].tolist(), words[1:].tolist(), strict=True)):
            pairs.append(_pairs(hashes[a:b]))
            for at in range(a, max(b - width, a) + 1) if b > a else ():
                found.append(hashes[at : min(at + width, b)])
                owners.append(ids[lo + k])
    if not found:
        return None
    vocabulary = np.unique(np.concatenate(found))
    by_phrase: dict[bytes, set[str]] = {}
    for phrase, owner in zip(found, owners, strict=True):
        by_phrase.setdefault(phrase.tobytes(), set()).add(owner)
    numbers, lengths = np.zeros((len(by_phrase), width), np.int64), np.zeros(len(by_phrase), np.int64)
    items, bounds = [], [0]
    for k, (phrase, owner) in enumerate(by_phrase.items()):
        n = len(phrase) // 8
        numbers[k, width - n :] = np.searchsorted(vocabulary, np.frombuffer(phrase, U64)) + 2
        lengths[k] = n
        items += sorted(owner)
        bounds.append(len(items))
    return Phrases(vocabulary, np.unique(np.concatenate(pairs)), numbers, lengths, np.array(bounds), items)


def _pairs(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] * U64(3) + mix(hashes[1:]))


def _member(values: np.ndarray, sortd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sortd, values)
    at[at == len(sortd)] = 0
    return at, (sortd[at] == values) if len(sortd) else np.zeros(len(values), bool)


def find_phrases(column: pa.Array, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard: (row, start word, end word, phrase) of every place, by its FM-index."""
    least = int(phrases.lengths.min())
    pieces, rows, firsts = [], [], []
    for lo, _, hashes, words, _, _ in words_of(column):
        number, known = _member(hashes, phrases.vocabulary)
        joined = np.zeros(len(hashes), bool)  # with the word before
        if len(hashes) > 1:
            joined[1:] = known[1:] & known[:-1] & _member(_pairs(hashes), phrases.pairs)[1]
        joined[words[:-1][words[:-1] < len(hashes)]] = False
        heads = np.flatnonzero(known & ~joined)
        after = np.append(np.flatnonzero(~joined), len(hashes))
        tails = after[np.searchsorted(after, heads, "right")]
        long = tails - heads >= least
        heads, tails = heads[long], tails[long]
        row = np.searchsorted(words, heads, "right") - 1
        for a, b, r in zip(heads.tolist(), tails.tolist(), row.tolist(), strict=True):
            pieces += [number[a:b] + 2, np.ones(1, np.int64)]
            rows.append(lo + r)
            firsts.append(a - int(words[r]))
    if not pieces:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    index = FMIndex(np.concatenate(pieces))
    low, high = index.search(phrases.numbers, phrases.lengths)
    count = np.maximum(high - low, 0)
    places = index.locate(ranges(low, count))
    phrase = np.repeat(np.arange(len(count)), count)
    starts = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))[:-2:2]
    piece = np.searchsorted(starts, places, "right") - 1
    start = np.array(firsts)[piece] + places - starts[piece]
    return np.array(rows)[piece], start, start + phrases.lengths[phrase], phrase


SPANS, ITEMS = "array<struct<start:int,stop:int>>", "array<string>"


def portions(benchmark: DataFrame, width: int) -> Iterator[Phrases]:
    """The benchmark in portions of about PORTION_WORDS words, one at a time; one fits all but very large ones."""
    rows = benchmark.select(F.col("item_id").cast("string"), "text").filter("item_id is not null and text is not null")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // (6 * PORTION_WORDS))
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow().combine_chunks()
        found = phrases_of(part.column(0).to_pylist(), part.column(1).combine_chunks(), width) if len(part) else None
        if found is not None:
            yield found


def hits_of(text: pa.Array, phrases: Phrases | None) -> tuple[np.ndarray, pa.Array, list[set[str]]]:
    """For each row of a shard: its number of words, its merged spans of hit words, and its items."""
    n = len(text)
    sizes, items = np.zeros(n, np.int64), [set() for _ in range(n)]
    for lo, hi, _, words, _, _ in words_of(text):
        sizes[lo:hi] = np.diff(words)
    row = start = stop = np.zeros(0, np.int64)
    if phrases is not None:
        row, start, stop, phrase = find_phrases(text, phrases)
        for doc, p in set(zip(row.tolist(), phrase.tolist(), strict=True)):
            items[doc].update(phrases.items[phrases.item_bounds[p] : phrases.item_bounds[p + 1]])
    # one more word for each row parts the spans of different rows
    base = np.concatenate(([0], np.cumsum(sizes + 1)))
    gone = covered(int(base[-1]), base[row] + start, base[row] + stop)
    edge = np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(base, first, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array((x - base[owner]).astype(np.int32)) for x in (first, last)], names=["start", "stop"])
    bounds = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return sizes, pa.ListArray.from_arrays(bounds, spans), items


def without_spans(text: pa.Array, hits: pa.Array) -> list[str | None]:
    """The texts without their spans, each cut from its first word's start to its last word's end."""
    out = text.to_pylist()
    for lo, hi, data, offsets in text_blocks(text):
        starts, ends, words = find_words(LOWER[data], offsets, NON_ALNUM)
        raw = data.tobytes()
        for k in range(lo, hi):
            spans = hits[k].as_py()
            if spans:
                at, kept = int(offsets[k - lo]), []
                for s in spans:
                    kept.append(raw[at : starts[words[k - lo] + s["start"]]])
                    at = int(ends[words[k - lo] + s["stop"] - 1])
                out[k] = b"".join((*kept, raw[at : offsets[k - lo + 1]])).decode()
    return out


def _search(docs: DataFrame, phrases: Phrases | None, cut: bool) -> DataFrame:
    """(rest, text, n_words, hits, items) from (rest, text), for one portion; the text without its hits where ``cut``."""
    kind = docs.schema["rest"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches):
        for batch in batches:
            text = batch.column(1)
            sizes, hits, items = hits_of(text, sent.value)
            if cut:
                text = pa.array(without_spans(text, hits), pa.string())
            columns = [batch.column(0), text, pa.array(sizes), hits, pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            found = pa.record_batch(columns, names=["rest", "text", "n_words", "hits", "items"])
            for k in range(0, len(found), 256):  # what goes back to Spark is small
                yield found.slice(k, 256)

    return map_batches(docs.select("rest", "text"), run, f"rest {kind}, text string, n_words long, hits {SPANS}, items {ITEMS}")


def _searched(docs: DataFrame, benchmark: DataFrame, width: int, cut: bool) -> DataFrame:
    """As _search(), for the whole benchmark. One portion is searched as the result is read. With more, what each finds is written
    by the text's SHA-256 before the next is made, and merged, so that neither the driver nor a plan holds more than one."""
    stream = portions(benchmark, width)
    first, second = next(stream, None), next(stream, None)
    if second is None:
        return _search(docs, first, cut)
    texts, found = docs.select(F.sha2("text", 256).alias("rest"), "text").filter("text is not null"), []
    for phrases in chain((first, second), stream):
        hits = _search(texts, phrases, False).filter(F.size("hits") > 0).select("rest", F.explode("hits").alias("span"), "items").distinct()
        found.append(stored(hits, "hits"))
    every = reduce(DataFrame.unionByName, found).groupBy(F.col("rest").alias("_name"))
    every = every.agg(F.collect_set("span").alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"))
    plain = _search(docs, None, False).drop("hits", "items").withColumn("_name", F.sha2("text", 256))
    joined = plain.join(every, "_name", "left")
    kind = docs.schema["rest"].dataType.simpleString()

    def merge(batches):
        for batch in batches:
            text, sizes = batch.column(1), batch.column(2).to_numpy()
            base = np.concatenate(([0], np.cumsum(sizes + 1)))
            inner = batch.column(3).flatten()
            row = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column(3)).to_numpy())
            gone = covered(int(base[-1]), *(base[row] + inner.field(k).to_numpy() for k in ("start", "stop")))
            edge = np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            owner = np.searchsorted(base, begin, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array((x - base[owner]).astype(np.int32)) for x in (begin, end)], names=["start", "stop"])
            hits = pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(len(batch) + 1)).astype(np.int32), spans)
            if cut:
                text = pa.array(without_spans(text, hits), pa.string())
            out = pa.record_batch([batch.column(0), text, batch.column(2), hits, batch.column(4)], names=["rest", "text", "n_words", "hits", "items"])
            for k in range(0, len(out), 256):
                yield out.slice(k, 256)

    rows = joined.select("rest", "text", "n_words", F.coalesce("_spans", F.array().cast(SPANS)), F.coalesce("_items", F.array().cast(ITEMS)))
    return map_batches(rows, merge, f"rest {kind}, text string, n_words long, hits {SPANS}, items {ITEMS}")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text, n_words, hits, items) for each row: merged spans of hit words, and the items (as text, sorted)."""
    found = _searched(docs.select(F.col("doc_id").cast("long").alias("rest"), "text"), benchmark, width, False)
    return found.withColumnRenamed("rest", "doc_id")


def cleaned(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with each hit span cut from the text, from its first word's start to its last word's end."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")
    found = _searched(docs.select(rest, "text"), benchmark, width, True)
    return found.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
