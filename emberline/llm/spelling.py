"""Spelling variants: words one edit apart, by composing the vocabulary's minimised acceptor with a one-edit transducer and itself.

A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. Two words are near if they differ by one
inserted, deleted or replaced code point. A pair has one place, the length of the common prefix, where it parts; before it
and after the edit both words are the same. So the product of acceptor, transducer and acceptor falls into parts: a part is
the length of the shorter word, a window of places, and the code points before and after the window, which all words of the
part share. Each pair lies in exactly one part. Parts start with a word's halves as windows; a part of too many words
halves its window, as a Spark job, down to one place, where a part holds at most as many shorter words as there are letters and
as many longer ones as there are pairs of letters. A task then builds the minimal acceptor of its parts' words, whose
initial states are (part, shorter or longer), and walks the product from each pair of initial states.

The walk keeps the number of accepted words before it on either side, so what comes out are the numbers of two words, never
their letters. Of the pairs only sums leave a task: how many words are near to a word, and which of them is the most frequent.

Null text has no words. Rows of equal doc_id count each on their own, as do rows without doc_id. Words of any length take
part. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.blocks import LOWER, U64, byte_set, find_words, map_batches, mix, ranges, text_blocks
from emberline.session import discard, stored

#: A part of more words is split as long as its window has more than one place.
PART_WORDS = 4096
#: Letters (words times the longest of them) of the parts that share an acceptor; a single part may have more.
CHUNK_LETTERS = 1 << 20

_ASCII = byte_set((0x41, 0x5A), (0x61, 0x7A))
_OUTSIDE = byte_set((0, 0))
#: Runs beyond this many bytes are hashed one by one.
_TABLED = 48


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of each span, carried on from the crc32 ``before`` it."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    places, state = starts[order], before[order] ^ np.uint32(0xFFFFFFFF)
    active = np.searchsorted(-sizes[order], -np.arange(min(_TABLED, int(sizes.max(initial=0)))), "left")
    for k, n in enumerate(active):
        state[:n] = _CRC[(state[:n] ^ data[places[:n] + k]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(sizes), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(sizes > _TABLED):
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(before[k]))
    return out


def word_counts(docs: DataFrame, min_length: int = 6, min_count: int = 5, drop_every: int | None = None) -> DataFrame:
    """(word, n): the words of at least ``min_length`` code points and their occurrences, if ``min_count`` or more.

    With ``drop_every``, misspellings are planted for a test: a run loses code point h % length if ``drop_every`` divides h, the crc32
    of ``<doc_id>:<run>`` (a missing doc_id is empty there).
    """

    def run(batches):
        for batch in batches:
            found = []
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                data = LOWER[data]
                lead = data == 0xC3
                inside = _ASCII[data] | lead
                inside[1:] |= lead[:-1]
                starts, ends, rows = find_words(inside.view(np.uint8), offsets, _OUTSIDE)
                letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                length = letters[ends] - letters[starts]
                whole = length >= min_length
                if drop_every is not None:
                    ids = ["" if x is None else str(x) for x in batch.column(0).slice(lo, hi - lo).to_pylist()]
                    prefix = np.array([zlib.crc32(f"{x}:".encode()) for x in ids], np.uint32)
                    at = np.flatnonzero(whole)
                    row = np.repeat(np.arange(hi - lo), np.diff(rows))[at]
                    h = crc32s(data, starts[at], ends[at], prefix[row])
                    hit = h % np.uint32(drop_every) == 0
                    whole[at[hit]] = False
                    cut = []
                    for k, x in zip(at[hit], h[hit], strict=True):
                        if length[k] > min_length:
                            word = data[starts[k] : ends[k]].tobytes().decode()
                            gone = int(x) % len(word)
                            cut.append(word[:gone] + word[gone + 1 :])
                    found.append(pa.array(cut, pa.string()))
                starts, sizes = starts[whole], (ends - starts)[whole]
                ends_ = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                found.append(pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends_), pa.py_buffer(data[ranges(starts, sizes)])))
            if found:
                counts = pc.value_counts(pa.chunked_array(found))
                yield pa.record_batch([counts.field("values"), counts.field("counts")], names=["word", "n"])

    counted = map_batches(docs.select("doc_id", "text"), run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class Acceptor:
    """The minimal acyclic acceptor of groups of sorted, distinct words, each group of words of one length and with an initial state of its own.

    ``codes``: a padded row of code points for each word; ``length``; ``first``: whether the word is its group's first.
    States of equal height (letters up to the end) and equal transitions are one. ``count``: how many words a state accepts. A
    transition's ``before``: how many words the state accepts through smaller labels.
    """

    def __init__(self, codes: np.ndarray, length: np.ndarray, first: np.ndarray):
        n, width = codes.shape
        common = np.zeros(n, np.int64)  # letters shared with the word before
        unequal = codes[1:] != codes[:-1]
        common[1:] = np.where(unequal.any(axis=1), unequal.argmax(axis=1), width)
        common[first] = -1
        at = np.zeros(n, np.int64)  # the state that each word's suffix of the present height leads from
        labels, targets, before = [], [], []
        low, count, made, edges = [np.zeros(1, np.int64)], [np.ones(1, np.int64)], 1, 0
        self.initial = np.zeros(n, np.int64)
        for height in range(1, int(length.max(initial=0)) + 1):
            word = np.flatnonzero(length >= height)
            depth = length[word] - height
            node = common[word] < depth
            child = np.flatnonzero(common[word] <= depth)
            label, target = codes[word[child], depth[child]].astype(np.int64), at[word[child]]
            parent = (np.cumsum(node) - 1)[child]
            first_edge = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
            degree = np.diff(np.concatenate((first_edge, [len(parent)])))
            signature = np.add.reduceat(mix((label.astype(U64) << U64(40)) ^ target.astype(U64)), first_edge) + degree.astype(U64)
            _, representative, kind = np.unique(signature, return_index=True, return_inverse=True)
            # equal signatures: compare with the representative, edge by edge; a state that differs stays on its own
            owner = np.repeat(np.arange(len(degree)), degree)
            rank = np.arange(len(parent)) - first_edge[owner]
            twin = np.minimum(first_edge[representative[kind[owner]]] + rank, len(parent) - 1)
            odd = np.logical_or.reduceat((label[twin] != label) | (target[twin] != target), first_edge) | (degree != degree[representative[kind]])
            if odd.any():
                kind = np.where(odd, len(representative) + np.cumsum(odd) - 1, kind)
                representative = np.concatenate((representative, np.flatnonzero(odd)))
            picked = ranges(first_edge[representative], degree[representative])
            counts = np.concatenate(count)
            weight = counts[target[picked]]
            upto = np.concatenate(([0], np.cumsum(weight)))
            bounds = np.concatenate(([0], np.cumsum(degree[representative])))
            labels.append(label[picked])
            targets.append(target[picked])
            before.append(upto[:-1] - np.repeat(upto[bounds[:-1]], degree[representative]))
            low.append(edges + bounds[:-1])
            count = [counts, np.diff(upto[bounds])]
            at[word] = made + kind[np.cumsum(node) - 1]
            made += len(representative)
            edges += len(picked)
            done = word[depth == 0]
            self.initial[done] = at[done]
        self.low = np.concatenate([*low, [edges]])
        self.count = np.concatenate(count)
        self.label, self.target, self.before = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (labels, targets, before))
        self.state = np.repeat(np.arange(made), np.diff(self.low))
        self.key = (self.state << 21) | self.label

    def edges(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``states``, transition) for each transition of each state."""
        degree = self.low[states + 1] - self.low[states]
        return np.repeat(np.arange(len(states)), degree), ranges(self.low[states], degree)

    def matched(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, transition, transition) of equal labels for each row's two states."""
        row, edge = self.edges(left)
        other, found = self.step(right[row], self.label[edge])
        return row[found], edge[found], other[found]

    def step(self, states: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The transition by each label, and whether there is one."""
        key = (states << 21) | labels
        place = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        return place, (self.key[place] == key) if len(self.key) else np.zeros(len(key), bool)


def near_pairs(acceptor: Acceptor, shorter: np.ndarray, longer: np.ndarray, base: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of each pair that parts at a place in [lo, hi), for parts given by the numbers of their groups' first words.

    ``shorter``, ``longer``: the group's first word, or -1 without such words; ``base``: the initial state of a word's group.
    """
    a, out = acceptor, []
    one, two = np.flatnonzero(shorter >= 0), np.flatnonzero((shorter >= 0) & (longer >= 0))
    same = (base[shorter[one]], shorter[one], one)  # state, number, part
    both = (base[shorter[two]], base[longer[two]], shorter[two], longer[two], two)
    after: tuple[np.ndarray, ...] = tuple(np.zeros(0, np.int64) for _ in range(4))
    depth = 0
    while len(same[0]) or len(both[0]) or len(after[0]):
        grown = [after]
        # replaced: two transitions of one state
        state, number, part = same
        inside = (depth >= lo[part]) & (depth < hi[part])
        row, edge = a.edges(state[inside])
        rest = a.low[state[inside][row] + 1] - edge - 1
        other, first = ranges(edge + 1, rest), np.repeat(edge, rest)
        start = np.repeat(number[inside][row], rest)
        grown.append((a.target[first], a.target[other], start + a.before[first], start + a.before[other]))
        # inserted: a transition of the longer word that the shorter one doesn't take
        p, q, i, j, part = both
        inside = (depth >= lo[part]) & (depth < hi[part])
        p_, q_, i_, j_ = (x[inside] for x in (p, q, i, j))
        row, edge = a.edges(q_)
        p_, i_, j_, r = p_[row], i_[row], j_[row] + a.before[edge], a.target[edge]
        ended = a.low[p_ + 1] == a.low[p_]
        out.append((i_[ended], j_[ended]))
        label = a.label[edge]
        row, left, right = a.matched(p_, r)
        onward = a.label[left] != label[row]
        row, left, right = row[onward], left[onward], right[onward]
        inserted = (a.target[left], a.target[right], i_[row] + a.before[left], j_[row] + a.before[right])
        # no edit yet: one letter on
        state, number, part = (x[depth + 1 < hi[same[2]]] for x in same)
        row, edge = a.edges(state)
        same = (a.target[edge], number[row] + a.before[edge], part[row])
        p, q, i, j, part = (x[depth + 1 < hi[both[4]]] for x in both)
        row, left, right = a.matched(p, q)
        both = (a.target[left], a.target[right], i[row] + a.before[left], j[row] + a.before[right], part[row])
        # after the edit: the same letters, which equal states accept all at once
        p, q, i, j = (np.concatenate(x) for x in zip(*grown, inserted, strict=True))
        equal = p == q
        n = a.count[p[equal]]
        out.append((ranges(i[equal], n), ranges(j[equal], n)))
        p, q, i, j = (x[~equal] for x in (p, q, i, j))
        row, left, right = a.matched(p, q)
        after = (a.target[left], a.target[right], i[row] + a.before[left], j[row] + a.before[right])
        depth += 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def _nearest(words: pa.Array, n: np.ndarray, size: np.ndarray, longer: np.ndarray, lo: np.ndarray, hi: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
    """(word, n_near, near_n, near) of a chunk of whole parts; a word appears once for each part that it has near words in."""
    length = size + longer
    codes = np.zeros((len(words), int(length.max())), np.uint32)
    codes[np.arange(codes.shape[1]) < length[:, None]] = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    first = new | np.concatenate(([True], longer[1:] != longer[:-1]))
    acceptor = Acceptor(codes, length, first)
    part = np.cumsum(new) - 1
    heads = np.flatnonzero(first)
    ends = [np.full(int(part[-1]) + 1, -1, np.int64) for _ in range(2)]
    for k in (0, 1):
        mine = heads[longer[heads] == k]
        ends[k][part[mine]] = mine
    i, j = near_pairs(acceptor, *ends, acceptor.initial, lo[new], hi[new])
    i, j = np.concatenate((i, j)), np.concatenate((j, i))
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    order = np.lexsort((rank[j], -n[j], i))
    i, j = i[order], j[order]
    best = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.zeros(0, np.int64)
    n_near = np.diff(np.concatenate((best, [len(i)])))
    return pa.record_batch([words.take(pa.array(i[best])), pa.array(n_near), pa.array(n[j[best]]), words.take(pa.array(j[best]))], names=["word", "n_near", "near_n", "near"])


_PART = ("size", "lo", "hi", "around")


def _keyed(rows: DataFrame) -> DataFrame:
    """With ``around``, a hash of the code points before and after the window. Where hashes meet by chance, a part only has more words."""
    before, after = F.substring("word", F.lit(1), F.col("lo")), F.right("word", F.greatest(F.col("size") - F.col("hi"), F.lit(0)))
    return rows.withColumn("around", F.xxhash64(before, F.lit(0), after))


def _split(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))
    return _keyed(rows.select("word", "n", "size", "longer", F.explode(halves).alias("w")).select("word", "n", "size", "longer", "w.lo", "w.hi"))


def _parts(words: DataFrame, part_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """(word, n, size, longer, lo, hi, around), and the tables it reads."""
    length = F.length("word")
    roles = F.array(F.struct(length.alias("size"), F.lit(0).alias("longer")), F.struct((length - 1).alias("size"), F.lit(1).alias("longer")))
    whole = words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.size", "r.longer").filter("size > 0")
    open_ = _split(whole.select("*", F.lit(0).alias("lo"), (F.col("size") + 1).alias("hi"))).filter("lo < hi")
    settled, read = None, []
    while True:
        large = stored(open_.groupBy(*_PART).count().filter((F.col("count") > part_words) & (F.col("hi") - F.col("lo") > 1)).drop("count"), "parts")
        read.append(large)
        some = not large.isEmpty()
        small = open_.join(large, list(_PART), "left_anti") if some else open_
        settled = small if settled is None else settled.unionByName(small)
        if not some:
            return settled, read
        open_ = stored(_split(open_.join(large, list(_PART), "left_semi")), "parts")
        read.append(open_)


def near_words(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(word, n_near, near_n, near) for each word of ``words`` (word, n; distinct) with a word one edit away: their number, and the most frequent
    of them (ties: the smallest) with its n."""
    spark = words.sparkSession
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), words.count() // 60_000 + 1)
    parts, read = _parts(words, part_words)

    def run(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            held = yield from chunks(held, False)
        if held is not None:
            yield from chunks(held, True)

    def chunks(table, last):
        """The results of whole parts, CHUNK_LETTERS at a time; what may go on in the next batch is given back."""
        table = table.combine_chunks()
        size, longer, lo, hi, around = (table.column(c).to_numpy() for c in ("size", "longer", "lo", "hi", "around"))
        new = np.ones(len(table), bool)
        new[1:] = (size[1:] != size[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (around[1:] != around[:-1])
        bounds = np.append(np.flatnonzero(new), len(table)) if last else np.flatnonzero(new)
        k = 0
        while k + 1 < len(bounds):
            longest = np.maximum.accumulate(np.maximum.reduceat(size[: bounds[-1]] + 1, bounds[k:-1]))
            letters = (bounds[k + 1 :] - bounds[k]) * longest
            m = k + max(1, int(np.searchsorted(letters, CHUNK_LETTERS, "right")))
            if m + 1 == len(bounds) and not last and letters[-1] <= CHUNK_LETTERS:
                break
            cut = slice(bounds[k], bounds[m])
            words_ = table.column("word").chunk(0).slice(bounds[k], bounds[m] - bounds[k])
            found = _nearest(words_, table.column("n").to_numpy()[cut], *(x[cut].astype(np.int64) for x in (size, longer, lo, hi)), new[cut])
            if len(found):
                yield found
            k = m
        return table.slice(bounds[k]) if k < len(bounds) and bounds[k] < len(table) else None

    sorted_ = parts.repartition(n_tasks, *_PART).sortWithinPartitions(*_PART, "longer", "word")
    found = map_batches(sorted_, run, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    out = stored(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("near_n"), "best.near"), "near")
    discard(*read)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): a form has a larger n than its word, so chains end. Each round doubles the steps that a word has gone."""
    reached = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(reached.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        going = not moved.filter("moved").isEmpty()
        discard(reached)
        reached = moved.drop("moved")
        reached.stored_at = moved.stored_at
        if not going:
            return reached


def variants(words: DataFrame, ratio: int = 5, part_words: int = PART_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``words`` (word, n; distinct): its form is the near word of largest n (ties: the
    smallest), if that is at least ``ratio`` times its own; the root ends the chain of forms, and is the word itself without a form."""
    near = near_words(words, part_words)
    counted = words.join(near, "word", "left")
    has = F.col("near_n") >= ratio * F.col("n")
    out = stored(
        counted.select("word", F.when(has, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("near_n")).alias("form_n")),
        "forms",
    )
    discard(near)
    roots = _roots(out.filter("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, drop_every: int | None = None) -> DataFrame:
    """``variants`` of the words of ``docs`` (doc_id, text)."""
    return variants(stored(word_counts(docs, min_length, min_count, drop_every), "words"), ratio)
