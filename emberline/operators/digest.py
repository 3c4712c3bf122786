"""SHA-256 over the ordered rows of a key, however many there are.

Rows are dealt by ranges of (key, order), so a key with many rows lies in several neighbouring tasks. A key that lies inside a task is
hashed there. Of others each task gives pieces of joined text of bounded size, and these, not the rows, are streamed key by key; a
task then holds one piece and the state of one hash.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.session import discard, stored

#: Bytes of a piece of text.
PIECE_BYTES = 1 << 20


def ordered_digests(rows: DataFrame, key: str, order: list[str], text: str, separator: str, prefix: str = "") -> DataFrame:
    """(key, n, digest): for each ``key`` the number of rows whose ``text`` isn't null, and the SHA-256 (lowercase hex) of ``prefix`` and these texts, joined by
    ``separator`` in ``order``. Rows equal in ``order`` should have equal texts. A null key is one key; a key without texts has no row."""
    kind = rows.schema[key].dataType.simpleString()
    by = [F.col(c).asc_nulls_first() for c in dict.fromkeys((key, *order))]
    sorted_ = rows.filter(F.col(text).isNotNull()).repartitionByRange(*by).sortWithinPartitions(*by)
    sep = separator.encode()

    def given(out, type_):
        names = ["key", "seq", "n", "body", "digest"]
        types = [type_, pa.int64(), pa.int64(), pa.large_binary(), pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def cut(batches):
        seq, at, opened, held, size, out, type_ = TaskContext.get().partitionId() << 32, cut, True, [], 0, [], None

        def close(as_piece):
            nonlocal seq, held, size
            body = sep.join(held)
            if as_piece:
                out.append((at, seq, len(held), body, None))
                seq += 1
            else:
                out.append((at, None, len(held), None, hashlib.sha256(prefix.encode() + body).hexdigest()))
            held, size = [], 0

        for batch in batches:
            type_ = batch.schema.field(0).type
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at is cut or k != at:
                    if held:
                        close(opened)
                    # the first key may have begun in an earlier task, and one that was given in part goes on
                    at, opened = k, at is cut
                held.append(value.encode())
                size += len(held[-1]) + len(sep)
                if size >= PIECE_BYTES:
                    close(True)
                    opened = True
            if out:
                yield given(out, type_)
                out = []
        if held:
            close(True)
        if out:
            yield given(out, type_)

    found = stored(sorted_.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(cut, f"key {kind}, seq long, n long, body binary, digest string"), "pieces")

    def finish(batches):
        at, n, state = finish, 0, None
        for batch in batches:
            type_ = batch.schema.field(0).type
            out = []
            for k, count, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is finish or k != at:
                    if state is not None:
                        out.append((at, n, state.hexdigest()))
                    at, n, state = k, 0, hashlib.sha256(prefix.encode())
                state.update(sep + body if n else body)
                n += count
            if out:
                yield ended(out, type_)
        if state is not None:
            yield ended([(at, n, state.hexdigest())], type_)

    def ended(out, type_):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (type_, pa.int64(), pa.string()), strict=True)], names=["key", "n", "digest"])

    parts = found.filter("seq is not null").repartition("key").sortWithinPartitions("key", "seq").select("key", "n", "body")
    whole = found.filter("seq is null").select("key", "n", "digest")
    out = stored(whole.unionByName(parts.mapInArrow(finish, f"key {kind}, n long, digest string")).withColumnRenamed("key", key), "digests")
    discard(found)
    return out
