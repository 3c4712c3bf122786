"""Quality filtering by rules that vote, weighed without labels.

Each rule looks at statistics of the whole text and votes good or bad, or abstains. Nobody tells which documents are good:
expectation-maximisation over the counts of vote patterns (at most 3 to the number of rules, whatever the table's size)
estimates the share of good documents and, for each rule, how often it votes good on good ones and bad on bad ones. The votes
of a document then give the probability that it is good, compiled to one column expression. So a document that offends one
weak rule can stay, and one that several rules doubt goes.

A rule's bad votes are taken to be no rarer on bad documents than on good ones, which settles which of the two classes is the good
one; pseudo-counts of PRIOR_ROWS documents hold the estimates where rules hardly vote.

Null text counts as empty. Every row is judged on its own: rows of equal doc_id, or without one, get each their row. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.blocks import BLANKS, U64, byte_set, find_words, map_batches, mix, ranges, text_blocks

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER, _LOWER, _DIGIT = byte_set((0x41, 0x5A)), byte_set((0x61, 0x7A)), byte_set((0x30, 0x39))
_PUNCT = byte_set((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_END = np.zeros(256, bool)
_END[list(b".!?")] = True
_NEWLINE = byte_set((0x0A, 0x0A))

#: Counts of a text: words; code points in words; characters of #*$%&|<>; lines with a word, and those equal to an earlier line; words in a window
#: of three words that the text has twice or more; capital and small letters A-Z; words ending in one of .!? and in a mark doubled; words of marks only;
#: ASCII marks and digits; words of letters with at most one mark, at the end.
STATISTICS = "n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words n_upper n_lower n_ends n_doubled n_bare n_marks n_digits n_plain".split()


@dataclass(frozen=True)
class Rule:
    """SQL conditions over STATISTICS under which a document is doubted, or trusted; it abstains if neither (or both) hold."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 50", "n_words >= 100"),
    Rule("word length", "word_chars < 3 * n_words or word_chars > 10 * n_words", "word_chars >= 4 * n_words and word_chars <= 8 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    Rule("repeated lines", "10 * n_dup_lines > 3 * n_lines", "n_lines >= 3 and 20 * n_dup_lines <= n_lines"),
    Rule("repeated words", "10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words"),
    Rule("capitals", "n_upper > n_lower", "5 * n_upper <= n_lower"),
    Rule("sentences", "100 * n_ends < n_words or 10 * n_ends > 3 * n_words", "50 * n_ends >= n_words and 5 * n_ends <= n_words"),
    Rule("doubled marks", "10 * n_doubled > n_words", "100 * n_doubled <= n_words"),
    Rule("bare marks", "5 * n_bare > n_words", "50 * n_bare <= n_words"),
    Rule("marks", "8 * n_marks > word_chars", "12 * n_marks <= word_chars"),
    Rule("digits", "5 * n_digits > word_chars", "20 * n_digits <= word_chars"),
    Rule("plain words", "10 * n_plain < 6 * n_words", "10 * n_plain >= 9 * n_words"),
)


def _numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal spans, and only for these."""
    sizes = ends - starts
    upto = np.concatenate(([0], np.cumsum(sizes)))
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(data[ranges(starts, sizes)])])
    return pc.dictionary_encode(spans).indices.to_numpy().astype(np.int64)


def _repeated(keys: Sequence[np.ndarray]) -> np.ndarray:
    """Which rows of the keys occur twice or more. Rows are sorted by a hash; should different rows meet in it, by themselves."""
    h = np.zeros(len(keys[0]), U64)
    for key in keys:
        h = mix(h * U64(3) + key.astype(U64))
    order = np.argsort(h, kind="stable")
    if np.any((h[order][1:] == h[order][:-1]) & np.any([key[order][1:] != key[order][:-1] for key in keys], axis=0)):
        order = np.lexsort(keys)
    same = np.all([key[order][1:] == key[order][:-1] for key in keys], axis=0)
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def block_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each row of a block."""
    n = len(offsets) - 1

    def within(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask)))[bounds])

    starts, ends, words = find_words(data, offsets, BLANKS)
    n_words = np.diff(words)
    row = np.repeat(np.arange(n), n_words)
    inside = ~BLANKS[data]
    # windows of three words of one row, by where they start
    ids = _numbers(data, starts, ends)
    at = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    again = at[_repeated((ids[at + 2], ids[at + 1], ids[at], row[at]))] if len(at) else at
    covered = np.zeros(len(row), bool)
    for k in range(3):
        covered[again + k] = True
    # lines with a word; a line that equals an earlier one is one more than its kinds
    l_starts, l_ends, _ = find_words(data, offsets, _NEWLINE)
    seen = np.concatenate(([0], np.cumsum(inside)))
    full = seen[l_ends] > seen[l_starts]
    l_starts, l_ends = l_starts[full], l_ends[full]
    l_row = np.searchsorted(offsets, l_starts, "right") - 1
    kinds = np.unique(np.stack((l_row, _numbers(data, l_starts, l_ends))), axis=1)[0] if len(l_row) else l_row
    n_lines = np.bincount(l_row, minlength=n)
    size, marks, digits = ends - starts, *(np.concatenate(([0], np.cumsum(x[data]))) for x in (_PUNCT, _DIGIT))
    last, second = data[ends - 1], data[np.maximum(ends - 2, starts)]
    w_marks, w_digits = marks[ends] - marks[starts], digits[ends] - digits[starts]
    return np.stack(
        [
            n_words,
            within(inside & ((data & 0xC0) != 0x80), offsets),
            within(_SYMBOLS[data], offsets),
            n_lines,
            n_lines - np.bincount(kinds, minlength=n),
            within(covered, words),
            within(_UPPER[data], offsets),
            within(_LOWER[data], offsets),
            within(_END[last], words),
            within((size > 2) & _PUNCT[last] & (second == last), words),
            within(w_marks == size, words),
            within(_PUNCT[data], offsets),
            within(_DIGIT[data], offsets),
            within((w_marks == _PUNCT[last]) & (w_digits == 0) & (w_marks < size), words),
        ],
        axis=1,
    )


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, STATISTICS...) for each row of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                found = block_statistics(data, offsets).astype(np.int64)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), *(pa.array(x) for x in found.T)], names=["doc_id", *STATISTICS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in STATISTICS))


#: Documents that count as seen before the first: the share of good ones, of good votes on good ones, and of bad votes on bad ones. The last is low,
#: as a bad document seldom offends more than a few rules.
PRIOR_ROWS, START_SHARE, START_GOOD, START_BAD = 20.0, 0.8, 0.95, 0.4


@dataclass
class Weights:
    """The share of good documents; for each rule the share of good votes on good documents, and of bad votes on bad ones."""

    share: float
    good: np.ndarray
    bad: np.ndarray

    def odds(self) -> tuple[float, np.ndarray, np.ndarray]:
        """Logarithms of the odds of a good document: before any vote, and what each rule's good and bad vote add."""
        return float(np.log(self.share / (1 - self.share))), np.log(self.good / (1 - self.bad)), np.log((1 - self.good) / self.bad)

    def probability(self, votes: np.ndarray) -> np.ndarray:
        bias, up, down = self.odds()
        return 1 / (1 + np.exp(-(bias + (votes > 0) @ up + (votes < 0) @ down)))


def estimate(votes: np.ndarray, counts: np.ndarray, steps: int = 500) -> Weights:
    """By expectation-maximisation from vote patterns (1 good, -1 bad, 0 none) and how many documents have each."""
    n_rules = votes.shape[1]
    w = Weights(START_SHARE, np.full(n_rules, START_GOOD), np.full(n_rules, START_BAD))
    for _ in range(steps):
        p = w.probability(votes)
        good, bad = counts * p, counts * (1 - p)
        on_good = np.clip((good @ (votes > 0) + PRIOR_ROWS * START_GOOD) / (good @ (votes != 0) + PRIOR_ROWS), 1e-4, 1 - 1e-4)
        on_bad = np.clip((bad @ (votes < 0) + PRIOR_ROWS * START_BAD) / (bad @ (votes != 0) + PRIOR_ROWS), 1 - on_good, 1 - 1e-4)
        share = float(np.clip((good.sum() + PRIOR_ROWS * START_SHARE) / (counts.sum() + PRIOR_ROWS), 1e-4, 1 - 1e-4))
        new = Weights(share, on_good, on_bad)
        moved = max(abs(new.share - w.share), np.abs(new.good - w.good).max(initial=0), np.abs(new.bad - w.bad).max(initial=0))
        w = new
        if moved < 1e-9:
            break
    return w


def vote(rule: Rule) -> Column:
    bad, good = (F.coalesce(F.expr(x), F.lit(False)) for x in (rule.bad, rule.good))
    return F.when(bad & ~good, F.lit(-1)).when(good & ~bad, F.lit(1)).otherwise(F.lit(0))


def weigh(stats: DataFrame, rules: Sequence[Rule] = RULES) -> Weights:
    """The rules' weights from all rows of ``stats``."""
    patterns = stats.groupBy(*[vote(rule).alias(f"v{k}") for k, rule in enumerate(rules)]).count().collect()
    rows = np.array(sorted(tuple(r) for r in patterns), np.int64).reshape(-1, len(rules) + 1)
    return estimate(rows[:, :-1], rows[:, -1].astype(float))


def probability(weights: Weights, rules: Sequence[Rule] = RULES) -> Column:
    """The probability that a row of statistics is a good document."""
    bias, up, down = weights.odds()
    total = F.lit(bias)
    for rule, plus, minus in zip(rules, up, down, strict=True):
        total = total + F.when(vote(rule) > 0, F.lit(float(plus))).when(vote(rule) < 0, F.lit(float(minus))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def judged(stats: DataFrame, rules: Sequence[Rule] = RULES, least: float = 0.5) -> DataFrame:
    """``stats`` with ``probability`` and ``good`` (probability >= ``least``). ``stats`` is read twice: store it."""
    return stats.withColumn("probability", probability(weigh(stats, rules), rules)).withColumn("good", F.col("probability") >= least)
