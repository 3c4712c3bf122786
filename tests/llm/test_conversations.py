"""Conversation repair against a plain search over all edits of a conversation, whole and in chunks."""

import hashlib
import random
import zlib

import pytest
from emberline.llm import conversations, queries

BLANK = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def plain_repair(rows):
    """One conversation's (gaps, blank, duplicate, truncated, illegal, cost, audit, hash): the least (cost, audit) over all ways, from the front."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    known = [r[0] for r in rows if r[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    blank = duplicate = truncated = 0
    follows = {"": {"u": "u", "s": "s"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best, seen = {"": (0, "", ())}, set()

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, turns) in list(best.items()):
                for role in ("user", "assistant"):
                    if role[0] in follows[state]:
                        way = (cost + 5, audit + "I", (*turns, role + ":"))
                        if role[0] not in best or way[:2] < best[role[0]][:2]:
                            best[role[0]] = way
        return best

    best = inserted(best)
    for _, role, text in rows:
        body = text.strip(BLANK)
        forced, cut = False, 0
        if not body:
            blank, forced = blank + 1, True
        elif (role, text) in seen:
            duplicate, forced = duplicate + 1, True
        elif body[-1] not in ".!?":
            truncated, cut = truncated + 1, 5
        seen.add((role, text))
        after = {}
        for state, (cost, audit, turns) in best.items():
            ways = [(state, cost + 2, "D", None)]
            if not forced:
                if role[:1] in follows[state]:
                    ways.append((role[:1], cost + cut, "K", role))
                ways += [(r[0], cost + cut + 1, "R", r) for r in ("user", "assistant") if r[0] in follows[state]]
            for to, price, letter, kept in ways:
                way = (price, audit + letter, turns if kept is None else (*turns, f"{kept}:{text}"))
                if to not in after or way[:2] < after[to][:2]:
                    after[to] = way
        best = inserted(after)
    cost, audit, turns = min((best[s] for s in ("", "a") if s in best), key=lambda w: w[:2])
    roles = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()


def grouped(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append(rest)
    return out


def random_rows(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for _ in range(rng.choice([1, 2, 3, 5, 9, 14])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User", "x" * 70])
            text = rng.choice(["Yes.", "No", "why?", "hm \n", "", " \t", None, f"é{rng.randrange(4)}!", "z" * 80 + rng.choice(".a"), "1. 2"])
            rows.append((conv, rng.choice([None, *range(9)]), role, text))
    rows += [(500, k, ("user", "assistant")[k % 2], f"turn {k // 3}.") for k in range(300)]
    rows += [(501, None, None, None)] * 40 + [(501, 4, "user", "same.")] * 50 + [(502, 7, "user", "end.")]
    return rows


@pytest.mark.parametrize(("chunk", "partitions"), [(8192, "4"), (3, "4"), (1, "7"), (20, "1")])
def test_against_search(spark, monkeypatch, chunk, partitions):
    monkeypatch.setattr(conversations, "CHUNK_ROWS", chunk)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = random_rows(chunk)
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
        repaired = conversations.repair(df)
        got = {r.conv_id: tuple(r)[1:] for r in conversations.summary(repaired).collect()}
        want = {c: plain_repair([(t, " " if r is None else r, " " if x is None else x) for t, r, x in part]) for c, part in grouped(rows).items()}
        assert got == want
        turns = {}
        for r in sorted(conversations.turns(repaired).collect(), key=lambda r: (r.seq, r.place)):
            turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert {c: hashlib.sha256("\n".join(turns.get(c, [])).encode()).hexdigest() for c in want} == {c: w[-1] for c, w in want.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_query(spark, tmp_path):
    rows = random_rows(77)
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, seq string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()}
    want = dict.fromkeys(grouped(rows), (0, 0, 0, 0, 0, 0, "", EMPTY))
    want |= {c: plain_repair(part) for c, part in grouped(plain_damage(rows)).items()}
    assert got == want and len(want) == 154
    spark.read.parquet(f"{tmp_path}/conversations.parquet").limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.op13_conversation_repair(spark, f"{tmp_path}/none").collect() == []


def test_very_long_text(spark):
    rows = [(1, 0, "user", "long " * 400_000 + "."), (1, 1, "assistant", "short."), (1, 2, "user", "long " * 400_000 + ".")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = conversations.summary(conversations.repair(df)).collect()
    assert tuple(got)[1:] == plain_repair([r[1:] for r in rows])
