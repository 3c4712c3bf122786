"""Exact search for the k vectors of greatest inner product, by columnar branch and bound.

Vectors are held column by column, as blocks of dimensions. Block by block the partial products are accumulated;
what the dimensions left can still add is bounded by the product of the remaining norms, and pairs whose bound is
under a query's k-th best score so far are dropped, so later blocks see only the pairs compacted from earlier ones.
Queries go to the tasks in waves of bounded size, each over all candidates where they lie.

Components x become floor(scale * x). Vectors that are null or hold null or non-finite components, or components
beyond 2**62 after scaling, take no part, nor do rows without vec_id. Vectors are compared with those of their own
length only. Of rows that repeat a query's vec_id, the one that can take part and whose vector a hash puts first asks; as candidates all of them
count, but none for a query of their own vec_id. Scores beyond a long are clipped.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.blocks import map_batches
from emberline.session import stored

#: Bytes of query vectors that are sent to the executors at once.
WAVE_BYTES = 8 << 20
#: Dimensions in a block, candidates and queries compared at once.
DIMENSIONS, CANDIDATES, QUERIES = 16, 2048, 256


def vectors(ids: pa.Array, column: pa.Array, scale: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer matrix as doubles) for each vector length that occurs."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
    flat = pc.fill_null(column.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    known = np.asarray(ids.is_valid())
    ids = pc.fill_null(ids, 0).to_numpy()
    ends = np.cumsum(np.maximum(lengths, 0))
    out = []
    for n in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero((lengths == n) & known)
        if len(rows):
            x = np.floor(scale * flat[(ends[rows] - n)[:, None] + np.arange(n)])
            good = (np.isfinite(x) & (np.abs(x) < 2.0**62)).all(axis=1)
            out.append((ids[rows[good]], x[good]))
    return out


class Best:
    """The k best (score, vec_id) of each query so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.score = np.full((len(ids), k), -np.inf)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.cuts = [*range(0, x.shape[1], DIMENSIONS), x.shape[1]]
        self.rest = self.norms(x)
        self.exact: dict[tuple[int, int], int] = {}

    def norms(self, x: np.ndarray) -> np.ndarray:
        """Norm of what is left from each cut on; a little too large, never too small."""
        squares = np.stack([(x[:, a:] ** 2).sum(axis=1) for a in self.cuts], axis=1)
        return np.sqrt(squares) * (1 + 1e-9)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        rest = self.norms(x)
        columns = [np.ascontiguousarray(x[:, a:b].T) for a, b in zip(self.cuts, self.cuts[1:])]
        big = bool(len(self.ids) and len(ids)) and float(self.rest[:, 0].max()) * float(rest[:, 0].max()) >= 2.0**52
        for at in range(0, len(self.ids), QUERIES):
            self._block(slice(at, at + QUERIES), ids, x, rest, columns, big)

    def _block(self, part: slice, ids: np.ndarray, x: np.ndarray, rest: np.ndarray, columns: list[np.ndarray], big: bool) -> None:
        mine, limit = self.x[part], self.score[part, -1]
        if big:  # beyond what doubles add up exactly: whole numbers without bound
            whole = np.array([[int(v) for v in row] for row in mine], object) @ np.array([[int(v) for v in row] for row in x], object).T
            score = np.clip(whole, -(2**63), 2**63 - 1)
            q, c = np.nonzero(np.ones(score.shape, bool))
            s = score[q, c]
        elif not columns:
            q, c = np.nonzero(np.ones((len(mine), len(ids)), bool))
            s = np.zeros(len(q))
        else:
            sums = mine[:, self.cuts[0] : self.cuts[1]] @ columns[0]
            q, c = np.nonzero(sums + self.rest[part, 1][:, None] * rest[:, 1] >= limit[:, None])
            s = sums[q, c]
            for k in range(1, len(columns)):
                block = mine[:, self.cuts[k] : self.cuts[k + 1]]
                if len(q) * 8 > len(mine) * len(ids):
                    s = s + (block @ columns[k])[q, c]
                else:
                    s = s + np.einsum("dp,dp->p", block.T[:, q], columns[k][:, c])
                keep = s + self.rest[part, k + 1][q] * rest[c, k + 1] >= limit[q]
                q, c, s = q[keep], c[keep], s[keep]
        other = self.ids[part][q] != ids[c]
        q, c, s = q[other], c[other], s[other]
        if not len(q):
            return
        n = len(mine)
        q = np.concatenate((np.repeat(np.arange(n), self.k), q))
        s = np.concatenate((self.score[part].reshape(-1), s))
        v = np.concatenate((self.vec[part].reshape(-1), ids[c]))
        order = np.lexsort((v, -s, q)) if s.dtype != object else np.array(sorted(range(len(q)), key=lambda i: (q[i], -s[i], v[i])))
        q = q[order]
        first = np.searchsorted(q, np.arange(n))
        best = order[first[:, None] + np.arange(self.k)]
        if s.dtype == object and self.score.dtype != object:
            self.score = self.score.astype(object)
        self.score[part], self.vec[part] = s[best], v[best]


RESULT = "query_id long, rank int, vec_id long, score long"


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) from frames of (vec_id, embedding): the k best, ties to the smaller vec_id.

    Queries that fit in one wave are searched as the result is read. With more, each wave is searched and written before the
    next is gathered, so that the driver, the executors and a plan hold one wave whatever their number.
    """
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < 2.0**62))
    queries = queries.select(F.col("vec_id").cast("long"), "embedding").filter("vec_id is not null and embedding is not null").filter(usable)
    first = F.min(F.struct(F.xxhash64("embedding").alias("h"), "embedding")).alias("first")
    queries = queries.groupBy("vec_id").agg(first).select("vec_id", "first.embedding")
    size = queries.agg(F.sum(F.size("embedding") * 8 + 8)).first()[0] or 0
    waves = -(-size // WAVE_BYTES)
    if waves > 1:
        queries = stored(queries.withColumn("wave", F.pmod(F.xxhash64("vec_id"), F.lit(waves))).repartition("wave"), "queries")
    done = []
    for wave in range(waves):
        rows = (queries.filter(F.col("wave") == wave) if waves > 1 else queries).select("vec_id", "embedding").toArrow()
        for ids, x in vectors(rows.column(0).combine_chunks(), rows.column(1).combine_chunks(), scale) if len(rows) else ():
            found = _ranked(map_batches(candidates.select(F.col("vec_id").cast("long"), "embedding"), _search(ids, x, k, scale), "query_id long, vec_id long, score long"), k)
            done.append(stored(found, "wave") if waves > 1 else found)
    if not done:
        return candidates.sparkSession.createDataFrame([], RESULT)
    return reduce(DataFrame.unionByName, done)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(ids: np.ndarray, x: np.ndarray, k: int, scale: float):
    def run(batches):
        best = Best(ids, x, k)
        for batch in batches:
            for vec, rows in vectors(batch.column(0), batch.column(1), scale):
                if rows.shape[1] == x.shape[1]:
                    first = min(256, len(vec))  # a few candidates first, for a limit to prune by
                    for a, b in ((0, first), *((i, i + CANDIDATES) for i in range(first, len(vec), CANDIDATES))):
                        best.add(vec[a:b], rows[a:b])
        q, r = np.nonzero(best.vec != np.iinfo(np.int64).max)
        score = np.array([int(v) for v in best.score[q, r]], np.int64)
        yield pa.record_batch([pa.array(best.ids[q]), pa.array(best.vec[q, r]), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run
