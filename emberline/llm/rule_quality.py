"""A quality score by a sparse ensemble of rules over text statistics.

Statistics of the whole text are gathered in one pass. On at most about ``LABELLED`` labelled rows (drawn by a hash of
doc_id) shallow trees are grown by boosting; every path from a root to a node is a conjunctive rule; a logistic
regression with an L1 penalty, fitted by proximal gradient steps and with the penalty chosen on rows set aside, keeps
few of them; and what it keeps is compiled to one Spark column expression over the statistics.

Null text counts as empty. Of rows that repeat a doc_id one teaches, the least by its statistics; all are scored. With no labels of both kinds the score is the share of label 1, or 0.5 without labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.blocks import BLANKS, byte_set, find_words, map_batches, text_blocks, word_hashes

LABELLED = 20_000
TREES, DEPTH, BINS, SHRINK, SEED = 24, 3, 24, 0.3, 3
PENALTIES = (0.02, 0.005, 0.001, 0.0002)

_UPPER, _LOWER, _DIGIT = byte_set((0x41, 0x5A)), byte_set((0x61, 0x7A)), byte_set((0x30, 0x39))
_PUNCT = byte_set((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_SENTENCE = byte_set((0x2E, 0x2E), (0x21, 0x21), (0x3F, 0x3F))
STATISTICS = (
    "bytes words lines word_bytes words_a_line upper digit punct beyond_ascii blank bare_punct_words words_without_letters "
    "doubled_end sentence_end comma_end upper_words distinct_words again_words repeated_lines long_words short_words"
).split()


def block_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each row of a block."""
    n_bytes = np.diff(offsets)

    def count(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask)))[bounds])

    starts, ends, words = find_words(data, offsets, BLANKS)
    n_words = np.diff(words)
    hashes = word_hashes(data, starts, ends)
    punct = np.concatenate(([0], np.cumsum(_PUNCT[data])))
    letters = np.concatenate(([0], np.cumsum(_UPPER[data] | _LOWER[data] | (data >= 0x80))))
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    size, w_punct, w_letters, w_upper = ends - starts, *((x[ends] - x[starts] for x in (punct, letters, upper)))
    last = data[ends - 1]
    before = data[np.maximum(ends - 2, starts)]
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[words[:-1][words[:-1] < len(hashes)]] = False
    row = np.repeat(np.arange(len(n_words)), n_words)
    distinct = _distinct(row, hashes, len(n_words))
    l_starts, l_ends, lines = find_words(data, offsets, byte_set((0x0A, 0x0A)))
    n_lines = np.diff(lines)
    l_distinct = _distinct(np.repeat(np.arange(len(n_lines)), n_lines), word_hashes(data, l_starts, l_ends), len(n_lines))
    w, b, l_ = np.maximum(n_words, 1), np.maximum(n_bytes, 1), np.maximum(n_lines, 1)
    per_word = lambda mask: count(mask, words) / w
    return np.stack(
        [
            n_bytes, n_words, n_lines, count_sum(size, words) / w, n_words / l_, count(_UPPER[data], offsets) / b, count(_DIGIT[data], offsets) / b,
            count(_PUNCT[data], offsets) / b, count(data >= 0x80, offsets) / b, count(BLANKS[data], offsets) / b, per_word(w_punct == size),
            per_word(w_letters == 0), per_word((size > 2) & _PUNCT[last] & (before == last)), per_word(_SENTENCE[last]), per_word(last == 0x2C),
            per_word((w_upper > 1) & (w_upper >= w_letters - w_upper)), distinct / w, per_word(again), 1 - l_distinct / l_, per_word(size > 14), per_word(size < 3),
        ],
        axis=1,
    ).astype(float)


def count_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values)))[bounds])


def _distinct(row: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, row))
    r, h = row[order], hashes[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return np.bincount(r[new], minlength=n)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, STATISTICS...) for each row of ``docs``."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                found = block_statistics(data, offsets)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), *(pa.array(x) for x in found.T)], names=["doc_id", *STATISTICS])

    columns = ", ".join(f"{x} double" for x in STATISTICS)
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, f"doc_id long, {columns}")


#: A condition: number of the statistic, whether it must exceed, threshold. A rule holds if all of its conditions do.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class Rules:
    bias: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for feature, above, threshold in rule:
                x = F.col(STATISTICS[feature])
                holds = holds & (x > threshold if above else x <= threshold)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for feature, above, threshold in rule:
        out &= (x[:, feature] > threshold) == above
    return out


def grow(bins: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, weight: np.ndarray, features: np.ndarray) -> list[tuple[Rule, np.ndarray, float]]:
    """A tree's nodes below its root: the path as a rule, the rows there, and their Newton step; leaves have no split."""
    out, open_ = [], [((), np.arange(len(residual)), 0)]
    while open_:
        rule, rows, depth = open_.pop()
        best = None
        if depth < DEPTH and len(rows) >= 20:
            g, h = residual[rows], weight[rows]
            whole = g.sum() ** 2 / (h.sum() + 1)
            for f in features:
                gs, hs = (np.cumsum(np.bincount(bins[rows, f], v, BINS + 1))[:-1] for v in (g, h))
                n = np.cumsum(np.bincount(bins[rows, f], minlength=BINS + 1))[:-1]
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                gain[(n < 10) | (n > len(rows) - 10)] = -1
                k = int(gain.argmax())
                if gain[k] > 1e-6 and k < len(cuts[f]) and (best is None or gain[k] > best[0]):
                    best = gain[k], f, k
        if best is None:
            if rule:
                out.append((rule, rows, residual[rows].sum() / (weight[rows].sum() + 1)))
            continue
        _, f, k = best
        if rule:
            out.append((rule, rows, 0.0))
        low = bins[rows, f] <= k
        for side, above in ((rows[low], False), (rows[~low], True)):
            open_.append(((*rule, (int(f), above, float(cuts[f][k]))), side, depth + 1))
    return out


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty on all but the bias, by accelerated proximal gradient."""
    n, m = x.shape
    step = 4 * n / (np.linalg.norm(x, 2) ** 2 + n)
    beta, ahead, bias, t = np.zeros(m), np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(x @ ahead + bias))) - y
        new = ahead - step * (x.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        bias -= step * error.mean()
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, beta, t = new + (t - 1) / later * (new - beta), new, later
    return beta, bias


def fit(x: np.ndarray, y: np.ndarray) -> Rules:
    if len(y) == 0:
        return Rules(0.0, [])
    share = float(y.mean())
    if min(share, 1 - share) * len(y) < 2:
        return Rules(float(np.log((share + 1e-6) / (1 - share + 1e-6))), [])
    rng = np.random.default_rng(SEED)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    score, rules = np.full(len(y), np.log(share / (1 - share))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        features = rng.choice(x.shape[1], size=max(1, 2 * x.shape[1] // 3), replace=False)
        for rule, rows, value in grow(bins, cuts, y - p, p * (1 - p), features):
            rules[tuple(sorted(rule))] = None
            score[rows] += SHRINK * value
    rules = list(rules)
    if not rules:
        return Rules(float(np.log(share / (1 - share))), [])
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
    aside = rng.random(len(y)) < 0.25
    best, chosen = np.inf, PENALTIES[-1]
    for penalty in PENALTIES:
        beta, bias = lasso(z[~aside], y[~aside], penalty)
        p = np.clip(1 / (1 + np.exp(-(z[aside] @ beta + bias))), 1e-9, 1 - 1e-9)
        loss = -(y[aside] * np.log(p) + (1 - y[aside]) * np.log(1 - p)).mean() if aside.any() else 0.0
        if loss < best - 1e-4:
            best, chosen = loss, penalty
    beta, bias = lasso(z, y, chosen)
    return Rules(float(bias), [(r, float(b)) for r, b in zip(rules, beta, strict=True) if abs(b) > 1e-6])


def learn(stats: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Rules:
    """From statistics and (doc_id, label in 0, 1); rows without either teach nothing."""
    labels = labels.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    n = labels.count()
    drawn = labels.filter(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(max(n, 1))) < labelled)
    met = stats.join(drawn, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*STATISTICS)).alias("s"), F.first("label").alias("label"))
    rows = met.orderBy("doc_id").select("label", "s.*").toArrow()
    columns = [c.to_numpy() for c in rows.columns]
    return fit(np.stack(columns[1:], axis=1), columns[0])
