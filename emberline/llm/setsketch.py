"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct shingles of ``shingle`` words. Register i is floor(1 - log_b(x_i)), truncated to
0..q+1, where x_i is the smallest of the elements' exponential variates under hash function i. Registers merge by
maximum and agree with a probability close to the Jaccard similarity, so bands of them find candidates; the registers
of a candidate pair give a joint maximum-likelihood estimate, and pairs that it doesn't rule out are verified on their
whole sets.

Copies (equal sets) are one class and have one vertex. In a bucket all classes are compared with the smallest first;
the components that this leaves apart are compared with each other by registers, in blocks of bounded size, whatever the
bucket's size, so that no link between different texts depends on which class a bucket happens to start with. Texts are
fetched only for members with a likely partner.

Null text has no words; a document without words links with nothing. A row without doc_id links with nothing and is
kept. Rows that repeat a doc_id are one document: what links one of their texts links all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.blocks import BLANKS, LOWER, U64, find_words, map_batches, mix, ranges, text_blocks, word_hashes
from emberline.operators.graph import components
from emberline.session import discard, free_shuffles, stored


@dataclass(frozen=True)
class Sketch:
    """Registers: ``bands`` times ``rows``. A pair at similarity s misses all bands with probability (1 - s**rows)**bands."""

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 4
    b: float = 1.001
    a: float = 20.0
    q: int = (1 << 16) - 2
    seed: int = 11

    @property
    def m(self) -> int:
        return self.bands * self.rows

    @property
    def doubtful(self) -> float:
        """Estimates below this rule a pair out: five standard errors under the similarity asked for."""
        return self.similarity - 5 * (self.similarity * (1 - self.similarity) / self.m) ** 0.5

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return tuple(rng.integers(0, 1 << 32, self.m, dtype=np.uint32) | np.uint32(k) for k in (1, 0))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a block; fewer words than a shingle count as one."""
    data = LOWER[data]
    starts, ends, words = find_words(data, offsets, BLANKS)
    hashes = word_hashes(data, starts, ends)
    mixed = np.zeros(max(len(hashes) - shingle + 1, 0), U64)
    for k in range(shingle):
        mixed += hashes[k : k + len(mixed)] * U64(0x9E3779B97F4A7C15 + 2 * k * 0x51ED2701)
        mixed = mix(mixed) if len(mixed) else mixed
    out = []
    for lo, hi in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        if hi - lo >= shingle:
            out.append(np.unique(mixed[lo : hi - shingle + 1]))
        elif hi > lo:
            value = np.array([hi - lo], U64)
            for k in range(lo, hi):
                value = mix(value * U64(31) ^ hashes[k : k + 1])
            out.append(value)
        else:
            out.append(np.zeros(0, U64))
    return out


def registers(values: np.ndarray, sketch: Sketch, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The m registers of a set of 64-bit hashes."""
    low = np.full(sketch.m, np.iinfo(np.uint32).max, np.uint32)
    high = (values >> U64(32)).astype(np.uint32)
    for at in range(0, len(high), 4096):
        each = np.multiply.outer(multiply, high[at : at + 4096])
        each += add[:, None]
        np.minimum(low, each.min(axis=1), out=low)
    x = -np.log1p(-(low + 0.5) / 2.0**32) / sketch.a
    return np.clip(np.floor(1 - np.log(x) / np.log(sketch.b)), 0, sketch.q + 1).astype(np.uint16)


def likely_similarity(n_a: np.ndarray, n_b: np.ndarray, above: np.ndarray, below: np.ndarray, sketch: Sketch) -> np.ndarray:
    """The Jaccard similarity of greatest joint likelihood, given set sizes and how many registers are above, below."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.minimum(np.linspace(0, 1, 101)[None, :], np.minimum(u / v, v / u))
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (sketch.b - 1) / sketch.b) / np.log(sketch.b)
    up, down = p(u - v * grid), p(v - u * grid)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    equal = sketch.m - above - below
    fit = above[:, None] * log(up) + below[:, None] * log(down) + equal[:, None] * log(1 - up - down)
    return grid[np.arange(len(u)), fit.argmax(axis=1)]


def sketches(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """(doc_id, n, set_a, set_b, regs): set size, two hashes of the set, and its registers."""

    def run(batches):
        multiply, add = sketch.functions()
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                sets = shingle_sets(data, offsets, sketch.shingle)
                regs = [registers(s, sketch, multiply, add).tobytes() if len(s) else b"" for s in sets]
                sums = np.array([[s.sum(dtype=U64), mix(s ^ U64(77)).sum(dtype=U64)] for s in sets], U64).view(np.int64)
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array(regs, pa.binary())],
                    names=["doc_id", "n", "set_a", "set_b", "regs"],
                )

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n long, set_a long, set_b long, regs binary")


def band_keys(classes: DataFrame, sketch: Sketch) -> DataFrame:
    """(key, band, rep): a row for each band of each class."""

    def run(batches):
        salt = mix(np.arange(1, sketch.bands + 1, dtype=U64))
        for batch in batches:
            if not len(batch):
                continue
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(batch), sketch.bands, sketch.rows)
            keys = np.broadcast_to(salt, regs.shape[:2]).copy()
            for k in range(sketch.rows):
                keys = mix(keys * U64(0x9E3779B97F4A7C15) + regs[:, :, k])
            reps = np.repeat(batch.column(0).to_numpy(), sketch.bands)
            band = np.tile(np.arange(sketch.bands, dtype=np.int32), len(batch))
            yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)), pa.array(band), pa.array(reps)], names=["key", "band", "rep"])

    return map_batches(classes.select("rep", "regs"), run, "key long, band int, rep long")


def likely(pairs: DataFrame, classes: DataFrame, sketch: Sketch) -> DataFrame:
    """The pairs (a, b) that their registers don't rule out."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(len(batch), -1) for k in ("regs_a", "regs_b"))
            n_a, n_b = (batch.column(k).to_numpy() for k in ("n_a", "n_b"))
            keep = likely_similarity(n_a, n_b, (a > b).sum(axis=1), (a < b).sum(axis=1), sketch) >= sketch.doubtful
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    for end in ("a", "b"):
        side = classes.select(F.col("rep").alias(end), F.col("n").alias(f"n_{end}"), F.col("regs").alias(f"regs_{end}"))
        pairs = pairs.join(side, end)
    return map_batches(pairs, run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, sketch: Sketch) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; ``texts``: doc_id, text."""
    percent = round(sketch.similarity * 100)

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                sets = []
                for name in ("text_a", "text_b"):
                    sets.append([s for _, _, data, offsets in text_blocks(part.column(name)) for s in shingle_sets(data, offsets, sketch.shingle)])
                keep = []
                for x, y in zip(*sets, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.record_batch([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    for end in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("doc_id").alias(end), F.col("text").alias(f"text_{end}")), end)
    return map_batches(pairs, run, "a long, b long")


#: Members and shingles of a block; pairs of a meeting that are looked at in one step.
BLOCK, SHINGLES, PAIRS = 128, 1 << 20, 1 << 16
MEETING = ("key", "i", "j")


def meetings(members: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, band, i, j, mine, rep, component, n, regs): who meets in the buckets that still hold several components.

    The members of the head's component never meet each other; they go to blocks of their own, and the others to others. Each
    block of the others meets all blocks, so a member is copied by how many the others are, not by the bucket's size.
    """
    known = labels.select(F.col("id").alias("rep"), "component")
    placed = members.join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = stored(placed.join(classes.select("rep", "n", "regs"), "rep"), "placed")
    heads = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max(F.when(F.col("rep") == F.col("head"), F.col("component"))).alias("core"))
    heads = stored(heads.filter("x <> y").select("key", "core"), "heads")
    rows = placed.join(heads, "key").withColumn("core", F.col("component") == F.col("core"))
    blocks = lambda core: F.greatest(
        F.ceil(F.count_if(F.col("core") == core) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(F.col("core") == core, F.col("n"))), F.lit(0)) / SHINGLES)
    ).cast("int")
    mixed = stored(rows.groupBy("key").agg(blocks(True).alias("inner"), blocks(False).alias("outer")), "mixed")
    drawn = F.xxhash64("rep")
    mine = F.when(F.col("core"), F.col("outer") + F.pmod(drawn, F.greatest("inner", F.lit(1)))).otherwise(F.pmod(drawn, F.greatest("outer", F.lit(1)))).cast("int")
    last = F.col("outer") + F.when(F.col("core"), 0).otherwise(F.col("inner")) - 1
    return (
        rows.join(mixed.filter("outer > 0"), "key")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        .select("key", "band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "component", "n", "regs")
    )


def likely_pairs(rows: pa.Table, sketch: Sketch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs in whole meetings (sorted, those of block i before those of block j) that lie in different components, share
    no earlier band, and that sizes and registers don't rule out; the likeliest of each step first."""
    key, i, j, mine, band, comp, n = (rows.column(c).to_numpy() for c in (*MEETING, "mine", "band", "component", "n"))
    percent = round(sketch.similarity * 100)
    regs = np.frombuffer(b"".join(rows.column("regs").to_pylist()), np.uint16).reshape(len(rows), sketch.m)
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    head, meeting = np.flatnonzero(new), np.cumsum(new) - 1
    end = np.append(head[1:], len(rows))[meeting]
    at = np.arange(len(rows))
    lefts = head + np.add.reduceat((mine == i).astype(np.int64), head)
    first = np.where(i == j, at + 1, lefts[meeting])
    count = np.where(mine == i, end - first, 0)
    total, start = np.cumsum(count), 0
    while start < len(rows):
        stop = max(int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS, "right")), start + 1)
        p, q = np.repeat(at[start:stop], count[start:stop]), ranges(first[start:stop], count[start:stop])
        start = stop
        ok = (comp[p] != comp[q]) & (100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q]))
        p, q = p[ok], q[ok]
        if len(p):
            equal = regs[p] == regs[q]
            ok = equal.reshape(len(p), sketch.bands, sketch.rows).all(axis=2).argmax(axis=1) == band[p]
            ok &= equal.sum(axis=1) >= sketch.m * (sketch.doubtful - 0.1)
            p, q = p[ok], q[ok]
        if len(p):
            s = likely_similarity(n[p], n[q], (regs[p] > regs[q]).sum(axis=1), (regs[p] < regs[q]).sum(axis=1), sketch)
            order = np.argsort(-s, kind="stable")
            order = order[s[order] >= sketch.doubtful]
            yield p[order], q[order]


def in_meetings(rows: DataFrame, run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` over tables of whole meetings, each dealt to one task."""

    def batched(batches):
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            key, i, j = (rows.column(c).to_numpy() for c in MEETING)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            whole = int(cuts[-1]) if len(cuts) else 0
            if whole:
                yield from run(rows.slice(0, whole))
            rest = rows.slice(whole)
        if rest is not None and len(rest):
            yield from run(rest)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(rows.repartition(n, *MEETING).sortWithinPartitions(*MEETING, "mine"), batched, schema)


def linked_in_buckets(members: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, sketch: Sketch) -> DataFrame:
    """Verified links (a, b) between different components that meet in a bucket: enough to join all that any pair there joins.

    Blocks first meet with registers only; texts go to those members of a meeting that have a likely partner in it. There
    pairs are verified on whole sets, likeliest first, and only while their ends are still apart; a pair never leaves its task
    unless it is a link.
    """
    percent = round(sketch.similarity * 100)
    meet = stored(meetings(members, labels, classes), "meetings")
    columns = meet.columns
    kinds = ", ".join(f"{c} {meet.schema[c].dataType.simpleString()}" for c in columns)

    def hopeful(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        some = np.zeros(len(rows), bool)
        for p, q in likely_pairs(rows, sketch):
            some[p] = some[q] = True
        yield from rows.filter(pa.array(some)).select(columns).to_batches()

    def linked(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        comp, rep, text, n = (*(rows.column(c).to_numpy() for c in ("component", "rep")), rows.column("text"), rows.column("n").to_numpy())
        root: dict[int, int] = {}
        sets: dict[int, np.ndarray] = {}
        links = []

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        def set_of(k: int) -> np.ndarray:
            if k not in sets:
                _, _, data, offsets = next(text_blocks(pa.array([text[k].as_py()])))
                sets[k] = shingle_sets(data, offsets, sketch.shingle)[0]
            return sets[k]

        for ps, qs in likely_pairs(rows, sketch):
            for p, q in zip(ps.tolist(), qs.tolist(), strict=True):
                u, v = find(int(comp[p])), find(int(comp[q]))
                if u != v:
                    both = len(np.intersect1d(set_of(p), set_of(q), assume_unique=True))
                    if 100 * both >= percent * (len(sets[p]) + len(sets[q]) - both):
                        root[max(u, v)] = min(u, v)
                        links.append(sorted((rep[p], rep[q])))
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    hope = stored(in_meetings(meet, hopeful, kinds), "hopeful")
    discard(meet)
    return in_meetings(hope.join(texts.withColumnRenamed("doc_id", "rep"), "rep"), linked, "a long, b long")


def near_duplicates(docs: DataFrame, sketch: Sketch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``; kept: one document of each component."""
    sketch = sketch or Sketch()
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    each = stored(sketches(docs, sketch), "sketches")
    classes = (
        each.filter("n > 0 and doc_id is not null").groupBy("n", "set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("regs").alias("regs"))
    )
    classes = stored(classes, "classes")
    bands = band_keys(classes, sketch)
    shared = bands.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("k")).filter("k > 1").select("key", "head")
    members = stored(bands.join(shared, "key"), "members")
    free_shuffles(spark)
    star = members.filter("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    star = stored(likely(star, classes, sketch), "candidates")
    texts = stored(docs.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")
    free_shuffles(spark)
    links = stored(verified(star, texts, sketch), "links")
    more = stored(linked_in_buckets(members, components(links), classes, texts, sketch), "links")
    discard(members, star, texts)
    rows = stored(each.select("doc_id", "n", "set_a", "set_b").join(classes.drop("regs"), ["n", "set_a", "set_b"], "left").select("doc_id", "n", "rep"), "rows")
    discard(each, classes)
    named = rows.filter("doc_id is not null and rep is not null")
    several = named.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("doc_id", "a")
    same = named.join(several, "doc_id").select("a", F.col("rep").alias("b"))
    labels = components(links.unionByName(more).unionByName(same))
    free_shuffles(spark)
    found = labels.select(F.col("id").alias("rep"), F.col("component").alias("component_id"))
    return rows.join(found, "rep", "left").withColumn("component_id", F.coalesce("component_id", "rep")).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.col("doc_id").eqNullSafe(F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))).alias("kept"),
    )
