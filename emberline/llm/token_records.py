"""Token ids in files of length-delimited records, with a separate offset index.

A record file ``part-NNNNN-KKKKK.rec`` (the task's partition and a count, since a new one is begun after FILE_BYTES) starts with the eight bytes ``TOKREC`` + width (2 or 4, bytes of an id) + 0. A record is

    length of the payload (8 bytes), masked crc32 of those 8 bytes (4), payload, masked crc32 of the payload (4)

little-endian throughout, and its payload is 1 byte (1: doc_id known, 0: null), doc_id (8 bytes), then the ids. A
checksum c is masked as ((c >> 15 | c << 17) + 0xA282EAD8) modulo 2**32, so that a checksum of data that holds
checksums stays sound. The ``.idx`` file of the same name has 24 bytes for each record: doc_id, offset of the record, number of
ids. It is the reader's table of work: ranges of about RANGE_BYTES of records are dealt to tasks, which seek to them. Parts
hold ascending ranges of doc_id, nulls first; rows of an equal or null doc_id spread over parts by a hash of the text.

Null text is empty. Every document ends with ``end_id``. Rows that repeat a doc_id each have a record, in the order of that
hash. A task that is run again writes the same bytes under a name of its own and moves them into place.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.blocks import BLANKS, ROLLING, U64, byte_set, map_batches, mix, ranges, text_blocks
from emberline.session import scratch_path, stored

MAGIC = b"TOKREC"
#: Bytes of records after which a new file is begun, and that a task reads at once.
FILE_BYTES, RANGE_BYTES = 64 << 20, 4 << 20
#: Pieces of text whose ids a worker remembers, with 8 ids each on average at most; bytes of text that it encodes at once.
REMEMBERED, ENCODED_BYTES = 2_000_000, 1 << 20
#: Bytes that end a letter or a digit (of two-byte letters those from U+00C0 to U+00FF, which begin with LATIN), and the symbols that no token joins to it.
ALNUM, LATIN = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)), 0xC3
LATIN_ENDS = byte_set((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))
SYMBOLS = byte_set((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
#: Bytes of Unicode white space outside ASCII, and ASCII separators that aren't blanks: these rows are encoded whole.
OTHER_SPACE = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80\xa8", b"\xe2\x80\xa9", b"\xe2\x80\xaf", b"\xe2\x81\x9f", b"\xe3\x80\x80"] + [
    b"\xe2\x80" + bytes([k]) for k in range(0x80, 0x8B)
]
OTHER_SPACE += [bytes([k]) for k in range(0x1C, 0x20)]


class Encoder:
    """Encodes blocks of texts with a tokenizer, piece by piece where that gives the same ids.

    A byte-level tokenizer with the usual splitting rule never joins what stands on the two sides of the place before
    a run of white space, or between a letter or digit and a symbol after it. So a text is cut there, and each distinct
    piece is encoded once and remembered: a word is learnt once whatever marks follow it.
    """

    def __init__(self, tokenizer_json: str):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        added = [t["content"] for t in spec.get("added_tokens") or []]  # one that holds white space might arise where pieces are strung together
        self.by_word &= self.tokenizer.token_to_id("\u010a") is not None and not any(c.isspace() for t in added for c in t)
        # Rows that hold one of these are encoded whole: they aren't split like other text.
        self.marks = OTHER_SPACE + [t.encode() for t in added if t]
        # Bytes of each id's token: a byte-level token has one character for each byte.
        self.lengths = np.zeros(max(self.tokenizer.get_vocab_size(), 1), np.int64)
        for token, id_ in self.tokenizer.get_vocab().items():
            self.lengths[id_] = len(token)
        self._forget()

    def _forget(self) -> None:
        # Hashes of the pieces, sorted, and for each its slot in start and count, which cut its ids out of flat.
        self.known, self.slot = np.zeros(0, U64), np.zeros(0, np.int32)
        self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat = np.zeros(0, f"u{self.width}")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, keys: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Encodes new pieces: strung together as one text, which is cut by the tokens' lengths, and those that end in white
        space one by one. In the string a line break, which is a token of its own there, stands before a piece without white space
        at its front, so that nothing joins it to the piece before."""
        alone = BLANKS[data[end - 1]]
        order = np.concatenate((np.flatnonzero(~alone), np.flatnonzero(alone)))
        keys, begin, end, n = keys[order], begin[order], end[order], int(len(keys) - alone.sum())
        sizes, breaks = (end - begin)[:n], (~BLANKS[data[begin]])[:n]
        strung = np.insert(data[ranges(begin[:n], sizes)], (np.cumsum(sizes) - sizes)[breaks], 0x0A)
        ids = self._ids(strung.tobytes().decode())
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes + breaks), "left") + 1
        starts = np.concatenate(([0], ends[:-1])) + breaks if n else ends
        single = [self._ids(data[a:b].tobytes().decode()) for a, b in zip(begin[n:].tolist(), end[n:].tolist(), strict=True)]
        more = np.array([len(x) for x in single], np.int64)
        starts, counts = np.concatenate((starts, len(ids) + np.cumsum(more) - more)), np.concatenate((ends - starts, more))
        ranked = np.argsort(keys)
        at = np.searchsorted(self.known, keys[ranked])
        self.known, self.slot = np.insert(self.known, at, keys[ranked]), np.insert(self.slot, at, (len(self.count) + ranked).astype(np.int32))
        self.start = np.concatenate((self.start, (len(self.flat) + starts).astype(np.int32)))
        self.count = np.concatenate((self.count, counts.astype(np.int32)))
        self.flat = np.concatenate((self.flat, *[x.astype(self.flat.dtype) for x in (ids, *single)]))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each row."""
        raw = data.tobytes()
        whole = np.zeros(len(offsets) - 1, bool)
        if not self.by_word:
            whole[:] = True
        else:
            held = np.bincount(data, minlength=256) > 0
            for mark in self.marks:
                at = raw.find(mark) if held[list(mark)].all() else -1
                while at >= 0:
                    row = int(np.searchsorted(offsets, at, "right")) - 1
                    whole[row] = True
                    at = raw.find(mark, int(offsets[row + 1]))
        blank = BLANKS[data]
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        alnum = ALNUM[data]
        alnum[1:] |= LATIN_ENDS[data[1:]] & (data[:-1] == LATIN)
        cut[1:] |= alnum[:-1] & SYMBOLS[data[1:]]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(data))
        if whole.any():
            pieces = ~whole[np.searchsorted(offsets, begin, "right") - 1]
            begin, end = begin[pieces], end[pieces]
        keys = mix(ROLLING.spans(ROLLING.prefix(data), begin, end) + (end - begin).astype(U64))
        distinct, first, each = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED or len(self.flat) + len(data) > 8 * REMEMBERED:
            self._forget()
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            self._learn(distinct[new], data, begin[first[new]], end[first[new]])
        slot = self.slot[np.searchsorted(self.known, distinct)]
        start, count = self.start[slot][each].astype(np.int64), self.count[slot][each].astype(np.int64)
        ids = self.flat[ranges(start, count)]
        bounds = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(begin, offsets)]
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for row in np.flatnonzero(whole).tolist():
            out[row] = self._ids(raw[offsets[row] : offsets[row + 1]].decode())
        return out


_ENCODERS: dict[int, Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    """One for each worker process and tokenizer."""
    key = hash(tokenizer_json)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer_json)
    return _ENCODERS[key]


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = len(payload).to_bytes(8, "little")
    return b"".join((head, masked(head).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def records(content: bytes, at: int = len(MAGIC) + 2):
    """(offset, payload) of each record of a file; raises where a checksum fails."""
    while at < len(content):
        head = content[at : at + 8]
        n = int.from_bytes(head, "little")
        payload = content[at + 12 : at + 12 + n]
        tail = content[at + 12 + n : at + 16 + n]
        if int.from_bytes(content[at + 8 : at + 12], "little") != masked(head) or len(tail) < 4 or int.from_bytes(tail, "little") != masked(payload):
            raise ValueError(f"damaged record at byte {at}")
        yield at, payload
        at += 16 + n


def write_records(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 0) -> DataFrame:
    """Writes ``docs`` (doc_id, text) to record files in ``out``; returns (part, n_docs, n_tokens) of the files."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)  # there even if no document is written
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    keyed = docs.select(F.col("doc_id").cast("long"), "text").withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(n, *order, "row").sortWithinPartitions(*order).select("doc_id", "text")

    def files(batches):
        """(frames, index) of the encoded blocks, each of little over FILE_BYTES at most; None where a file ends."""
        size, code = 0, encoder(tokenizer_json)
        for batch in batches:
            docs_, known = batch.column(0).fill_null(0).to_numpy(), np.asarray(batch.column(0).is_valid())
            for lo, hi, data, offsets in text_blocks(batch.column(1), ENCODED_BYTES):
                if size >= FILE_BYTES:
                    yield None
                    size = 0
                frames, index = [], np.zeros((hi - lo, 3), np.int64)
                for k, ids in enumerate(code.encode(data, offsets)):
                    ids = np.append(ids, np.uint32(end_id)).astype(f"<u{code.width}")
                    frames.append(framed(bytes([int(known[lo + k])]) + int(docs_[lo + k]).to_bytes(8, "little", signed=True) + ids.tobytes()))
                    index[k] = docs_[lo + k], len(MAGIC) + 2 + size, len(ids)
                    size += len(frames[-1])
                yield frames, index

    def run(batches):
        task, width = TaskContext.get().partitionId(), encoder(tokenizer_json).width
        store, root = pafs.FileSystem.from_uri(out)
        store.create_dir(root, recursive=True)
        blocks, more, k = files(batches), True, 0
        while more:
            mine, more = f"{root}/.{uuid.uuid4().hex}", False
            n_docs = n_tokens = 0
            with store.open_output_stream(f"{mine}.rec") as rec, store.open_output_stream(f"{mine}.idx") as idx:
                rec.write(MAGIC + bytes([width, 0]))
                for block in blocks:
                    if block is None:
                        more = True
                        break
                    frames, index = block
                    rec.write(b"".join(frames))
                    idx.write(index.astype("<i8").tobytes())
                    n_docs, n_tokens = n_docs + len(index), n_tokens + int(index[:, 2].sum())
            for kind in ("idx", "rec"):
                store.move(f"{mine}.{kind}", f"{root}/part-{task:05d}-{k:05d}.{kind}")
            yield pa.record_batch([pa.array([task << 32 | k]), pa.array([n_docs]), pa.array([n_tokens])], names=["part", "n_docs", "n_tokens"])
            k += 1

    return stored(map_batches(ordered, run, "part long, n_docs long, n_tokens long"), "parts")


def read_ranges(spark: SparkSession, out: str) -> DataFrame:
    """(part, name, at, stop, before, n): ranges of about RANGE_BYTES of records, from the index files. ``before`` counts the
    part's ids before a range, ``n`` its records; ``stop`` is null where the file's end is meant."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.idx").load(out)
    name = F.regexp_extract("path", r"(part-\d+-\d+)\.idx$", 1)
    number = lambda k: F.split_part(name, F.lit("-"), F.lit(k)).cast("long")
    names = ["part", "name", "at", "stop", "before", "n"]

    def run(batches):
        for batch in batches:
            for part, name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                index = np.frombuffer(content.as_buffer(), "<i8").reshape(-1, 3)
                if not len(index):
                    continue
                first = np.unique((index[:, 1] - index[0, 1]) // RANGE_BYTES, return_index=True)[1]
                at = index[first, 1]
                before = (np.cumsum(index[:, 2]) - index[:, 2])[first]
                columns = [pa.array(at), pa.array([*at[1:].tolist(), None], pa.int64()), pa.array(before), pa.array(np.diff(np.append(first, len(index))))]
                yield pa.record_batch([pa.array([part] * len(at), pa.int64()), pa.array([name] * len(at)), *columns], names=names)

    part = F.shiftleft(number(2), 32).bitwiseOR(number(3)).alias("part")
    return map_batches(files.select(part, name.alias("name"), "content"), run, "part long, name string, at long, stop long, before long, n long")


def read_records(spark: SparkSession, out: str) -> DataFrame:
    """(part, doc_id, before, n_tokens, ids) of every record: ``before`` counts the part's ids before it, ``ids`` are
    little-endian unsigned 32-bit integers."""

    def run(batches):
        store, root = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for part, name, at, stop, before, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{root}/{name}.rec") as rec:
                    head = rec.read_at(len(MAGIC) + 2, 0)
                    content = rec.read_at((stop or rec.size()) - at, at)
                if head[: len(MAGIC)] != MAGIC:
                    raise ValueError(f"{name} is no record file")
                kind, held = f"<u{head[len(MAGIC)]}", []
                for _, payload in records(content, 0):
                    ids = np.frombuffer(payload, kind, offset=9)
                    doc_id = int.from_bytes(payload[1:9], "little", signed=True) if payload[0] else None
                    held.append((part, doc_id, before, len(ids), ids.astype("<u4").tobytes()))
                    before += len(ids)
                if len(held) != n:
                    raise ValueError(f"{name} has {len(held)} records from byte {at}, its index {n}")
                yield _rows(held)

    ranges_ = read_ranges(spark, out).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return map_batches(ranges_, run, "part long, doc_id long, before long, n_tokens long, ids binary")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
    columns = list(zip(*held, strict=True)) if held else [[]] * 5
    return pa.record_batch([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=["part", "doc_id", "before", "n_tokens", "ids"])


def with_starts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` of read_records with ``start``: ids of all documents before. The window runs over one row a file."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))
    return rows.join(F.broadcast(first), "part").withColumn("start", F.col("first") + F.col("before"))


def round_trip(docs: DataFrame, tokenizer_path: str, out: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes ``docs`` and reads them back: (doc_id, start, n_tokens, ids)."""
    spark = docs.sparkSession
    out = out or scratch_path(spark, "records")
    parts = write_records(docs, tokenizer_path, out, end_id)
    return with_starts(read_records(spark, out), parts).select("doc_id", "start", "n_tokens", "ids")
