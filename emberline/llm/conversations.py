"""Conversation repair: the cheapest edits that make a conversation's roles alternate, in one streamed pass over sorted turns.

Rows are dealt by ranges of (conversation, turn), so a conversation is streamed by one task or, if it is long, by several
neighbours. Equal rows are counted first, and of a text that a conversation has more than once the earliest turn is looked up by
a join, so no task needs a conversation's whole past. A task carries a conversation as one byte a row (what the role allows
and whether the text is cut off) with the texts beside it. A conversation that ends inside the task is solved there. One that
reaches an end of the task, or grows beyond CHUNK_ROWS rows or CHUNK_BYTES bytes, leaves in chunks. Their bytes are then
streamed backward, carrying from Arrow batch to Arrow batch what each of the four states of the pattern costs from there on, and
writing each row's cheapest choices, one byte a row, as the table that is streamed forward afterwards; last, each chunk's texts
meet the state that it is entered in. So memory is bounded by a chunk, and only a byte a row of a giant conversation passes
through one task.

The roles wanted are `(s?(ua)+)?` by their first letters. Keep costs 0, a new role 1, deleting 2, inserting an empty turn 5, and
leaving a text cut off 5 more. Blank and repeated turns are deleted. Of equally cheap edits the least in ASCII order of their
initials (D, I, K, R) are taken; going forward by the costs behind, the least letter on a cheapest way is the right one.

Null role or text is one space. A null turn comes before the others; rows of one turn are ordered by role and text. Rows without
conv_id are one conversation. No rows, no conversations; nothing is dropped for its size.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.blocks import map_batches
from emberline.session import discard, stored

#: A longer or larger conversation is handed on in chunks of this size.
CHUNK_ROWS, CHUNK_BYTES = 8192, 1 << 20
#: Bytes of results that a task gives back at once.
GIVEN_BYTES = 1 << 20

BLANKS = " \t\n\x0b\x0c\r"
KEEP, RENAME, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
_LETTERS = "DIKR"
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. The next role but a system's, and where it leads.
_NEXT, _ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: What is still to pay in each state when no row is left; inserted turns complete the pattern.
_END = (0, 2 * INSERT, INSERT, 0)
#: A row's byte: 0 must be deleted; else 1 + what its role is (0 other, 1 s, 2 u, 3 a) + 4 if its text is cut off.
_KIND = {"s": 1, "u": 2, "a": 3}


def _kept(state: int, kind: int) -> int | None:
    """The state that keeping a role leads to, if the pattern allows it."""
    return kind if kind and (state == 0 if kind == 1 else _NEXT[state] == kind) else None


@lru_cache(maxsize=None)
def _choice(code: int, ahead: tuple[int, ...]) -> tuple[int, tuple[int, ...], int]:
    """(two bits a state: the letter to take next, costs less their minimum, that minimum) before a row, from the costs after it."""
    kind, cut = (code - 1) & 3, CUT_OFF if code > 4 else 0
    ways = []
    for state in range(4):
        onward = _kept(state, kind)
        keep = KEEP + cut + ahead[onward] if onward is not None else None
        ways.append({"D": DELETE + ahead[state], "K": keep, "R": RENAME + cut + ahead[_NEXT[state]]})
    taken = [min(c for c in way.values() if c is not None) for way in ways]
    cost = list(taken)
    for state in (2, 3, 0, 1):  # state 2 may insert an assistant, all others a user
        cost[state] = min(taken[state], INSERT + (taken[3] if state == 2 else min(taken[2], INSERT + taken[3])))
    byte = 0
    for state in range(4):
        options = ways[state] | {"I": INSERT + cost[_NEXT[state]]}
        letter = next(k for k, x in enumerate(_LETTERS) if options[x] == cost[state])
        byte |= letter << (2 * state)
    least = min(cost)
    return byte, tuple(c - least for c in cost), least


def decide(codes: bytes, ahead: tuple[int, ...] = _END) -> tuple[bytes, tuple[int, ...]]:
    """(each row's choices, the states' costs before the first row), going backward. Rows that must go cost nothing here."""
    least = min(ahead)
    ahead = tuple(c - least for c in ahead)
    out = bytearray(len(codes))
    for k in range(len(codes) - 1, -1, -1):
        if codes[k]:
            out[k], ahead, more = _choice(codes[k], ahead)
            least += more
    return bytes(out), tuple(c + least for c in ahead)


def follow(codes: bytes, choices: bytes, state: int) -> int:
    """The state after the rows."""
    for code, choice in zip(codes, choices, strict=True):
        while code:
            letter = (choice >> (2 * state)) & 3
            if letter == 2:
                state = (code - 1) & 3
            elif letter:
                state = _NEXT[state]
            if letter != 1:
                break
    return state


def edited(codes: bytes, choices: bytes, gone: list[int], roles: list[str], texts: list[str], state: int, last: bool) -> tuple[str, list[str], list[str], int]:
    """(edits' initials, repaired roles, repaired texts, state): ``gone``: rows to be deleted at each row, itself included if its byte is 0;
    ``roles`` and ``texts`` of the other rows."""
    audit, out_roles, out_texts, row = [], [], [], 0
    for code, choice, dead in zip(codes, choices, gone, strict=True):
        while code:
            letter = (choice >> (2 * state)) & 3
            audit.append(_LETTERS[letter])
            if letter:
                out_roles.append(roles[row] if letter == 2 else _ROLE[state])
                out_texts.append("" if letter == 1 else texts[row])
                state = (code - 1) & 3 if letter == 2 else _NEXT[state]
            if letter != 1:
                row += 1
                break
        audit.append("D" * dead)
    while last and state in (1, 2):
        audit.append("I")
        out_roles.append(_ROLE[state])
        out_texts.append("")
        state = _NEXT[state]
    return "".join(audit), out_roles, out_texts, state


def _marked(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(conv_id, turn, role, text, copies, first), equal rows being one with their number; first: no earlier turn has its role and text."""
    space = F.lit(" ")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    hashed = rows.withColumn("h", F.xxhash64("role", "text"))
    again = stored(hashed.groupBy("conv_id", "h").count().filter("count > 1").select(F.col("conv_id").alias("c"), F.col("h").alias("k")), "again")
    joined = hashed.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h") == F.col("k")), "left")
    once = joined.filter("k is null").select("conv_id", "turn", "role", "text", F.lit(1).cast("long").alias("copies"), F.lit(True).alias("first"))
    several = stored(joined.filter("k is not null").groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")), "several")
    least = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("least")
    earliest = several.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t")).agg(least)
    met = several.join(earliest, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t")))
    several_ = met.select("conv_id", "turn", "role", "text", "copies", F.col("turn").eqNullSafe(F.col("least.turn")).alias("first"))
    return once.unionByName(several_), [again, several]


_COUNTS = ("low", "high", "n_turns", "blank", "duplicate", "truncated", "illegal", "cost")
_FIELDS = ("conv_id", "seq", "whole", *_COUNTS, "head", "tail", "audit", "codes", "gone", "roles", "texts")


class _Piece:
    """Rows of one conversation that a task holds."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.gone, self.roles, self.texts, self.bytes = conv_id, bytearray(), [], [], [], 0
        self.low = self.high = self.head = self.tail = None
        self.n_turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0

    def add(self, turn, role, text, copies, first, end) -> None:
        """``end``: the last character that isn't blank."""
        if turn is not None and turn != self.high:
            self.low, self.high, self.n_turns = turn if self.low is None else self.low, turn, self.n_turns + 1
        initial = role[:1]
        self.illegal += copies - 1 + (self.tail is not None and self.tail + initial not in ("su", "ua", "au"))
        self.head, self.tail = initial if self.head is None else self.head, initial
        code, dead = 0, copies
        if not end:
            self.blank += copies
        elif not first:
            self.duplicate += copies
        else:
            cut = end not in ".!?"
            code, dead = 1 + _KIND.get(initial, 0) + 4 * cut, copies - 1
            self.duplicate += dead
            self.truncated += cut
            self.roles.append(role)
            self.texts.append(text)
            self.bytes += len(text) + len(role)
        self.codes.append(code)
        self.gone.append(dead)
        self.cost += DELETE * dead

    def row(self, seq: int | None) -> tuple:
        """Solved if ``seq`` is missing, else as a chunk of that number."""
        counts = [getattr(self, c) for c in _COUNTS]
        codes = bytes(self.codes)
        if seq is not None:
            gone = np.array(self.gone, "<i8").tobytes()
            return (self.conv_id, seq, False, *counts, self.head, self.tail, None, codes, gone, self.roles, self.texts)
        choices, ahead = decide(codes)
        audit, roles, texts, _ = edited(codes, choices, self.gone, self.roles, self.texts, 0, True)
        counts[-1] += ahead[0]
        return (self.conv_id, 0, True, *counts, self.head, self.tail, audit, None, None, roles, texts)


def _schema(kind: str) -> str:
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return f"conv_id {kind}, seq long, whole boolean, {counts}, head string, tail string, audit string, codes binary, gone binary, roles array<string>, texts array<string>"


def _batch(rows: list[tuple], names: tuple[str, ...], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(column, kinds[name]) for name, column in zip(names, zip(*rows, strict=True), strict=True)], names=list(names))


_KINDS = {c: pa.int64() for c in (*_COUNTS, "seq", "state", "n_lines")} | {c: pa.string() for c in ("head", "tail", "audit", "repaired_sha256")}
_KINDS |= {c: pa.binary() for c in ("codes", "gone", "choices")} | {c: pa.bool_() for c in ("whole", "last")} | {c: pa.list_(pa.string()) for c in ("roles", "texts")}


def _pieces(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations solved inside a task, and chunks of the others, numbered in order."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    long = F.length("role") > 64
    bounds = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.left("role", F.lit(64)), long, F.when(long, "").otherwise(F.left("text", F.lit(64)))]
    sorted_ = rows.repartitionByRange(*bounds).sortWithinPartitions(*order)
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)).alias("end")

    def run(batches):
        seq, conv, piece, opened, out, size = TaskContext.get().partitionId() << 32, run, None, True, [], 0

        def give(number):
            nonlocal seq, size
            out.append(piece.row(seq if number else None))
            seq, size = seq + number, size + piece.bytes

        for batch in batches:
            kinds = _KINDS | {"conv_id": batch.schema.field("conv_id").type}
            for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv is run or conv_id != conv:
                    if piece is not None:
                        give(opened)
                    # what an earlier task may have begun is open, and so is what was given in part
                    conv, piece, opened = conv_id, None, conv is run
                if piece is None:
                    piece = _Piece(conv_id)
                piece.add(*row)
                if len(piece.codes) >= CHUNK_ROWS or piece.bytes >= CHUNK_BYTES:
                    give(True)
                    piece, opened = None, True
                if size >= GIVEN_BYTES:
                    yield _batch(out, _FIELDS, kinds)
                    out, size = [], 0
        if piece is not None:
            give(True)
        if out:
            yield _batch(out, _FIELDS, kinds)

    return map_batches(sorted_.select("conv_id", "turn", "role", "text", "copies", "first", end), run, _schema(kind))


def _decided(chunks: DataFrame, kind: str) -> DataFrame:
    """(conv_id, seq, codes, choices, cost): each chunk's choices, streamed from the last chunk of a conversation to its first; the cost from the chunk on."""
    names = ("conv_id", "seq", "codes", "choices", "cost")

    def run(batches):
        conv, ahead = run, _END
        for batch in batches:
            kinds, out = _KINDS | {"conv_id": batch.schema.field("conv_id").type}, []
            for conv_id, seq, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv is run or conv_id != conv:
                    conv, ahead = conv_id, _END
                choices, ahead = decide(codes, ahead)
                out.append((conv_id, seq, codes, choices, ahead[0]))
            if out:
                yield _batch(out, names, kinds)

    rows = chunks.select("conv_id", "seq", "codes").repartition("conv_id").sortWithinPartitions("conv_id", F.col("seq").desc())
    return map_batches(rows, run, f"conv_id {kind}, seq long, codes binary, choices binary, cost long")


def _entered(decided: DataFrame, kind: str) -> DataFrame:
    """(conv_id, seq, choices, state, last, cost): the state that each chunk is entered in; the cost of the edits, at a conversation's first chunk."""
    names = ("conv_id", "seq", "choices", "state", "last", "cost")

    def run(batches):
        held, state, kinds = None, 0, _KINDS
        for batch in batches:
            kinds, out = _KINDS | {"conv_id": batch.schema.field("conv_id").type}, []
            for conv_id, seq, codes, choices, cost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same = held is not None and held[0] == conv_id
                if held is not None:
                    out.append((*held[:4], not same, held[4]))
                state = state if same else 0
                held = (conv_id, seq, choices, state, 0 if same else cost)
                state = follow(codes, choices, state)
            if out:
                yield _batch(out, names, kinds)
        if held is not None:
            yield _batch([(*held[:4], True, held[4])], names, kinds)

    rows = decided.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return map_batches(rows, run, f"conv_id {kind}, seq long, choices binary, state long, last boolean, cost long")


def _edited(chunks: DataFrame, entered: DataFrame, kind: str) -> DataFrame:
    """The chunks with their edits."""
    entered = entered.select(F.col("conv_id").alias("c"), F.col("seq").alias("s"), "choices", "state", "last", F.col("cost").alias("more"))
    joined = chunks.join(entered, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seq") == F.col("s"))).drop("c", "s")

    def run(batches):
        for batch in batches:
            kinds = _KINDS | {"conv_id": batch.schema.field("conv_id").type}
            for row in batch.to_pylist():
                gone = np.frombuffer(row["gone"], "<i8").tolist()
                audit, roles, texts, _ = edited(row["codes"], row["choices"], gone, row["roles"], row["texts"], row["state"], row["last"])
                row |= {"cost": row["cost"] + row["more"], "audit": audit, "codes": None, "gone": None, "roles": roles, "texts": texts}
                yield _batch([tuple(row[f] for f in _FIELDS)], _FIELDS, kinds)

    return map_batches(joined, run, _schema(kind))


def repair(rows: DataFrame) -> DataFrame:
    """Repaired conversations from ``rows`` (conv_id, turn, role, text): a row each, or several of ascending ``seq`` for those not ``whole``.

    ``audit``: the edits' initials; ``roles`` and ``texts``: the repaired turns; ``cost`` of the edits; rows that are ``blank``, else ``duplicate``, else ``truncated``;
    ``illegal``: neighbouring roles that the pattern forbids; ``low``, ``high``, ``n_turns``: least, largest and number of different turns; ``head`` and ``tail``: the
    first letters of the first and last role. ``turns`` and ``summary`` read it.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    marked, read = _marked(rows)
    pieces = stored(_pieces(marked, kind), "pieces")
    chunks = pieces.filter("not whole")
    decided = stored(_decided(chunks, kind), "choices")
    entered = stored(_entered(decided, kind), "entered")
    discard(*read, decided)
    return pieces.filter("whole").unionByName(_edited(chunks, entered, kind)).drop("codes", "gone")


def turns(repaired: DataFrame) -> DataFrame:
    """(conv_id, seq, place, role, text): a row for each repaired turn, in the order of seq and place."""
    each = F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "turn")
    return repaired.select("conv_id", "seq", each).select("conv_id", "seq", "place", F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text"))


def summary(repaired: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation; the hash is that of `role:text` of the repaired
    turns, joined by newlines. A chunked conversation's chunks are streamed, holding the hash's state only (and the audit, which is a value of the result)."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    names = ("conv_id", "gaps", *counts, "audit", "repaired_sha256")
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0).cast("long")).alias("gaps")
    whole = repaired.filter("whole").select("conv_id", gaps, *counts, "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))

    def run(batches):
        conv, kinds, total = run, _KINDS, None

        def ended():
            gaps = total["high"] - total["low"] + 1 - total["n_turns"] if total["low"] is not None else 0
            row = (conv, gaps, *(total[c] for c in counts), "".join(total["audit"]), total["hash"].hexdigest())
            return _batch([row], names, kinds | {"gaps": pa.int64()})

        for batch in batches:
            kinds = _KINDS | {"conv_id": batch.schema.field("conv_id").type}
            for row in batch.to_pylist():
                if conv is run or row["conv_id"] != conv:
                    if conv is not run:
                        yield ended()
                    conv, total = row["conv_id"], dict.fromkeys((*counts, "n_turns", "n_lines"), 0) | {"low": None, "high": None, "tail": None, "audit": [], "hash": hashlib.sha256()}
                for c in (*counts, "n_turns"):
                    total[c] += row[c]
                if row["low"] is not None:
                    total["n_turns"] -= row["low"] == total["high"]
                    total["low"], total["high"] = row["low"] if total["low"] is None else total["low"], row["high"]
                total["illegal"] += total["tail"] is not None and total["tail"] + row["head"] not in ("su", "ua", "au")
                total["tail"] = row["tail"]
                total["audit"].append(row["audit"])
                if row["n_lines"]:
                    total["hash"].update(("\n" if total["n_lines"] else "").encode() + row["lines"].encode())
                    total["n_lines"] += row["n_lines"]
        if conv is not run:
            yield ended()

    parts = repaired.filter("not whole").select("conv_id", "seq", *_COUNTS, "head", "tail", "audit", F.size("roles").cast("long").alias("n_lines"), lines.alias("lines"))
    schema = f"conv_id {kind}, gaps long, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string"
    return whole.unionByName(map_batches(parts.repartition("conv_id").sortWithinPartitions("conv_id", "seq"), run, schema))


def damaged(rows: DataFrame) -> DataFrame:
    """Faults for a test, by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes its role user."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.filter("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times).drop("copy")
