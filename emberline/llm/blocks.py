"""Byte blocks of Arrow text columns, and vectorised word finding and hashing over them.

Text reaches Python as Arrow batches. A block is a few MB of adjacent rows' UTF-8 bytes, so that the
arrays made from it stay small however large a batch is; a row is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK_BYTES = 1 << 18
#: Bytes of an Arrow batch that goes to Python, unless the session sets another number; a longer row goes alone.
BATCH_BYTES, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
U64 = np.uint64


def give_back() -> None:
    """Returns a worker's freed memory to the system. Workers are used again by later stages and would keep the most they ever held."""
    for rolling in (ROLLING, SECOND):
        rolling.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches bounded by bytes; a worker gives its memory back when the task ends."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, None) is None:
        conf.set(BATCH_CONF, str(BATCH_BYTES))

    def bounded(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(bounded, schema)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into these bytes) for each block; a null row is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes between words: blank and the controls 9 to 13.
BLANKS = byte_set((0x20, 0x20), (0x09, 0x0D))
#: Bytes between alphanumeric words, after A-Z became a-z.
NON_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def find_words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words (maximal runs outside ``gaps`` within a row), and row offsets into them."""
    n = len(data)
    inside = ~gaps[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = inside[heads]
    tails = heads[heads > 0] - 1
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Rolling:
    """Hashes of spans in constant time each, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.letters = rng.integers(0, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
        self.base = U64(int(rng.integers(1 << 60, 1 << 62)) | 5)
        self.inverse = U64(pow(int(self.base), -1, 1 << 64))
        self.forget()

    def forget(self) -> None:
        self.powers = self.inverses = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            n = max(n, 2 * BLOCK_BYTES)
            for name, factor in (("powers", self.base), ("inverses", self.inverse)):
                values = np.full(n + 1, factor, U64)
                values[0] = 1
                setattr(self, name, np.cumprod(values))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """``values``: bytes, or 64-bit hashes of larger symbols."""
        self._grow(len(values))
        symbols = self.letters[values] if values.dtype == np.uint8 else values
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(symbols * self.powers[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(prefix))
        return (prefix[ends] - prefix[starts]) * self.inverses[starts]


ROLLING = Rolling(20240229)
SECOND = Rolling(7)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(ROLLING.spans(ROLLING.prefix(data), starts, ends) + (ends - starts).astype(U64))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
