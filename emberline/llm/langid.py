"""Language identification by averaged hashed subword embeddings with a linear softmax.

Subwords are all runs of 3 and 4 bytes of the lower-cased text, each hashed to a bucket with an embedding. A document
is the mean of its subwords' embeddings, and a linear softmax over it gives the languages' probabilities. Both layers are
trained together by stochastic gradient descent in numpy, on about ``SAMPLE`` labelled documents: as many of each language
(``LEAST`` at least, or all it has), drawn by a hash of doc_id and text, so that a rare language is learned as well. A part of the
sample is held back to calibrate: one temperature makes the probability given to the predicted language match how often it
is right, each language counting by its share of all documents. Trained, the two layers fold into one table of a score for each bucket and
language, so that scoring adds up table rows over the whole text where the text lies.

At most ``LANGUAGES`` languages are learned, those with the most labelled documents (ties: the first by name): the model has a column for each. Labels
beyond that, such as the typing errors of a column, are never predicted; their texts are still scored.

A text that is null or has no letter is ``und`` with score 0, and so is every text if there was nothing to learn from.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.blocks import LOWER, ROLLING, U64, give_back, map_batches, mix, text_blocks

UNKNOWN = "und"
#: Labelled documents that are learned from, in expectation; a quarter of them calibrates. And the least of a language.
SAMPLE, LEAST, LANGUAGES = 2400, 60, 256
BUCKET_BITS, SIZE, EPOCHS, RATE, SEED = 15, 16, 6, 0.5, 5
GRAMS = (3, 4)
#: A calibrated probability under this rejects a document: it is likelier wrong than right.
REJECT = 0.5
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of doc_id as text is divisible by 5; a row without doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin letters that UTF-8 writes as C3 and a byte."""
    out = LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[capital] += 0x20
    return out


def subwords(data: np.ndarray, offsets: np.ndarray):
    """(buckets, offsets of rows into them) for each subword length."""
    prefix = ROLLING.prefix(lowered(data))
    for gram in GRAMS:
        at = np.arange(max(len(data) - gram + 1, 0))
        buckets = (mix(ROLLING.spans(prefix, at, at + gram) + U64(gram)) >> U64(64 - BUCKET_BITS)).astype(np.int32)
        yield buckets, gram


def row_ends(offsets: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end start of the subwords of each row; a shorter row has none."""
    return offsets[:-1], np.maximum(offsets[1:] - gram + 1, offsets[:-1])


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, count = np.zeros((len(offsets) - 1, len(self.languages))), np.zeros(len(offsets) - 1)
        for buckets, gram in subwords(data, offsets):
            a, b = row_ends(offsets, gram)
            a, b = np.minimum(a, len(buckets)), np.minimum(b, len(buckets))
            count += b - a
            sums = np.zeros(len(buckets) + 1)
            for k in range(len(self.languages)):
                np.cumsum(self.table[k][buckets], out=sums[1:], dtype=np.float64)
                total[:, k] += sums[b] - sums[a]
        return softmax(total / np.maximum(count, 1)[:, None] + self.bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def packed(buckets: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending buckets and their counts in a few bytes, as they go to the driver: the width of a count, then steps and counts compressed."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    steps = np.diff(buckets, prepend=0).astype("<u2")
    return bytes([kind.itemsize]) + zlib.compress(steps.tobytes() + counts.astype(kind.newbyteorder("<")).tobytes(), 1)


def unpacked(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets and counts of ``packed``, in the narrowest types that hold them."""
    width, raw = bag[0], zlib.decompress(bag[1:])
    n = len(raw) // (2 + width)
    return np.cumsum(np.frombuffer(raw, "<u2", n), dtype=np.uint16), np.frombuffer(raw, f"<u{width}", n, 2 * n)


def bags(docs: DataFrame) -> DataFrame:
    """(lang, drawn, bag) of each row of (lang, drawn, text): its buckets and their counts, packed."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(2)):
                parts = [(buckets, *row_ends(offsets, gram)) for buckets, gram in subwords(data, offsets)]
                held = [packed(*np.unique(np.concatenate([x[a[k] : b[k]] for x, a, b in parts]), return_counts=True)) for k in range(hi - lo)]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(held, pa.binary())], names=["lang", "drawn", "bag"])

    return map_batches(docs.select("lang", "drawn", "text"), run, "lang string, drawn long, bag binary")


def drawn_by_language(docs: DataFrame, sample: int) -> tuple[DataFrame, dict[str, int]]:
    """(lang, drawn, text) of about ``sample`` labelled documents, and how many each of the LANGUAGES learned has, on the driver; a text that repeats under one doc_id and language is drawn once."""
    known = docs.filter("lang is not null and text is not null").withColumn("drawn", F.xxhash64(F.lit(SEED), "doc_id", "text"))
    counted = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    sizes = {r["lang"]: r["n"] for r in counted.collect()}
    each = max(LEAST, -(-sample // max(len(sizes), 1)))
    share = F.lit(0.0)
    if sizes:
        one_in = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, max(1.0, n / each))])
        share = 1.0 / F.element_at(one_in, F.col("lang"))
    within = F.pmod("drawn", F.lit(1 << 30)) < share * F.lit(float(1 << 30))
    return known.filter(within).select("lang", "drawn", "text").dropDuplicates(["lang", "drawn"]), sizes


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """From (doc_id, text, lang); rows without lang or text teach nothing."""
    drawn, sizes = drawn_by_language(docs, sample)
    if not sizes:
        return None
    rows = bags(drawn).toArrow().sort_by([("drawn", "ascending"), ("lang", "ascending")])
    order = np.random.default_rng(SEED).permutation(len(rows))
    languages = sorted(set(rows.column(0).to_pylist()))
    if not languages:
        return None
    label = np.array([languages.index(x) for x in rows.column(0).to_pylist()])
    ids, counts = zip(*(unpacked(x.as_py()) for x in rows.column("bag")), strict=True)
    del rows
    order = [k for k in order.tolist() if len(ids[k])]
    held, learn = order[: len(order) // 4], order[len(order) // 4 :]
    # a language must not be held back whole
    missed = set(label[held].tolist()) - set(label[learn].tolist())
    learn, held = learn + [k for k in held if label[k] in missed], [k for k in held if label[k] not in missed]
    rng = np.random.default_rng(SEED)
    embed = rng.normal(0, 1 / SIZE, (1 << BUCKET_BITS, SIZE))
    weight, bias = np.zeros((SIZE, len(languages))), np.zeros(len(languages))
    steps = EPOCHS * max(len(learn), 1)
    for step in range(EPOCHS * len(learn)):
        if step % len(learn) == 0:
            rng.shuffle(learn)
        k, rate = learn[step % len(learn)], RATE * (1 - step / steps)
        share = counts[k] / counts[k].sum()
        mean = share @ embed[ids[k]]
        error = softmax(mean @ weight + bias)
        error[label[k]] -= 1
        back = weight @ error
        weight -= rate * np.outer(mean, error)
        bias -= 0.1 * rate * error
        # a document's buckets share its gradient; the factor makes up for how thinly a mean spreads it
        embed[ids[k]] -= rate * 20 * np.outer(np.minimum(share * len(share) / 20, 1), back)
    table = embed @ weight
    logits = np.array([(counts[k] / counts[k].sum()) @ table[ids[k]] + bias for k in held]).reshape(-1, len(languages))
    heat = 1.0
    if held:
        choices = np.geomspace(0.05, 20, 60)
        weights = (np.array([sizes[x] for x in languages]) / np.bincount(label[held], minlength=len(languages)).clip(1))[label[held]]
        loss = [-(weights * np.log(softmax(logits / t)[np.arange(len(held)), label[held]] + 1e-12)).sum() for t in choices]
        heat = choices[int(np.argmin(loss))]
    model = Model(languages, np.ascontiguousarray((table / heat).T.astype(np.float32)), bias / heat)
    del ids, counts, embed, table
    give_back()  # the driver's
    return model


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    count = np.concatenate(([0], np.cumsum(ASCII_LETTER[data])))[offsets]
    out = count[1:] > count[:-1]
    raw = data.tobytes()
    for k in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])).tolist():
        out[k] = any(c.isalpha() for c in raw[offsets[k] : offsets[k + 1]].decode())
    return out


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added; columns of these names are replaced."""
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rest = F.struct(*[F.col(c) for c in columns if c != text])
    packed = docs.select(F.col(text).alias("text"), rest.alias("rest"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets for each language

    def run(batches):
        model = sent.value
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(0)):  # what goes back is as small as a block, too
                letters = has_letter(data, offsets)
                if model is None:
                    letters[:] = False
                p = model.probabilities(data, offsets) if model is not None else np.zeros((len(letters), 1))
                best = p.argmax(axis=1)
                names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                scores = np.where(letters, p[np.arange(len(best)), best], 0.0)
                part = batch.slice(lo, hi - lo)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores)], names=["text", "rest", "lang_pred", "score"])

    kind = packed.schema["rest"].dataType.simpleString()
    found = map_batches(packed, run, f"text string, rest {kind}, lang_pred string, score double")
    return found.select(*[F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in columns], "lang_pred", "score")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learns from the rows of ``docs`` that aren't held out and predicts all: ``docs`` with held_out, lang_pred, score (columns
    of these names are replaced)."""
    model = train(docs.filter(~held_out()).select("doc_id", "text", "lang"), sample)
    return predict(docs.withColumn("held_out", held_out()), model)
