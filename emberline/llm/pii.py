"""Personal data by anchor expansion: an Aho-Corasick automaton finds cues, local parsers find the boundaries.

Cues are at-signs, scheme marks, digits and identifier words. At each, a deterministic parser expands to both sides
and validates: e-mail addresses, dotted IPv4 addresses, card numbers (Luhn), phone numbers, and beyond these base
kinds web addresses (``url``) and bank accounts (``account``: an IBAN with a valid checksum wherever it stands, or 6 to 20
digits after an account word). Two capitals and a digit are an IBAN's cue; of its possible ends the last with a valid checksum counts. Spans of one kind never overlap and are found leftmost first; a failing match is dropped and not
tried again inside.

Null text is empty. Spans count code points, end exclusive, and are ordered by start, then kind as listed in KINDS.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.blocks import map_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
SCHEMES = ("http", "https", "ftp")
ACCOUNT_CUES = ("account", "acct", "iban", "konto", "kontonummer", "compte", "cuenta")

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: All that a number in any of the three notations is made of.
NUMERIC = frozenset("0123456789 .()+-")
ISLAND = re.compile(r"[0-9 .()+-]*+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?::[0-9]{1,5}+)?(?:[/?#][A-Za-z0-9/?#&=_.~%+:@!$'()*,;-]*)?")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
AFTER_CUE = re.compile(r"[ \t:#.]{0,3}(?:n[ro]\.?|no\.?|number|nummer)?[ \t:#.]{0,3}([0-9](?:[ -]?[0-9]){5,19})(?![0-9])", re.I)


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("://", ("scheme", 3))
    for word in ACCOUNT_CUES:
        for form in {word, word.upper(), word.capitalize()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _iban_end(text: str, start: int) -> int:
    """The end of the longest IBAN with a valid checksum that starts at ``start``, or 0."""
    m = IBAN.match(text, start)
    if not m or not m[0].isascii():
        return 0
    for end in range(m.end(), start + 14, -1):
        whole = text[end - 1] != " " and not (end < len(text) and text[end].isascii() and text[end].isalnum())
        if whole and iban_valid(text[start:end]):
            return end
    return 0


def _numbers(text: str, at: int, low: int, spans: list[tuple[int, int, int]]) -> int:
    """The numbers of the island around ``at``; islands don't reach below ``low``. Returns the island's end."""
    start = at
    while start > low and text[start - 1] in NUMERIC:
        start -= 1
    end = ISLAND.match(text, at).end()
    if end - at == 1 and start == at:
        return end  # a lone digit is none of them
    for m in IP.finditer(text, start, end):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text, start, end):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text, start, end):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            spans.append((m.start(), 3, m.end()))
    return end


def find_spans(text: str, cues) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), in order."""
    spans: list[tuple[int, int, int]] = []
    island = email = url = account = 0
    for last, (what, length) in cues.iter(text):
        if what == "digit":
            if last - 2 >= account and "A" <= text[last - 1] <= "Z" and "A" <= text[last - 2] <= "Z":
                end = _iban_end(text, last - 2)
                if end:
                    spans.append((last - 2, 5, end))
                    account = end
            if last >= island:
                island = _numbers(text, last, island, spans)
        elif what == "at":
            start = last
            while start > email and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, last + 1) if start < last else None
            if m:
                email = m.end()
                spans.append((start, 0, email))
        elif what == "scheme":
            start = last - 2
            low = start
            while low > max(url, start - 6) and text[low - 1].isascii() and text[low - 1].isalpha():
                low -= 1
            scheme = next((s for s in sorted(SCHEMES, key=len, reverse=True) if text[low:start].lower().endswith(s)), None)
            m = URL.match(text, last + 1) if scheme else None
            if m:
                url = m.end()
                spans.append((start - len(scheme), 4, url))
        elif last >= account:
            m = AFTER_CUE.match(text, last + 1)
            if m:
                account = m.end(1)
                spans.append((m.start(1), 5, account))
    return sorted(spans)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): an array of (kind, start, end) for each row of ``docs``."""

    def run(batches):
        cues = automaton()
        names = pa.array(KINDS)
        for batch in batches:
            counts, rows = [0], []
            for text in batch.column(1):
                rows += find_spans(text.as_py() or "", cues)
                counts.append(len(rows))
            start, kind, end = zip(*rows, strict=True) if rows else ((), (), ())
            spans = pa.StructArray.from_arrays(
                [names.take(pa.array(kind, pa.int32())), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["kind", "start", "end"]
            )
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), spans)], names=["doc_id", "spans"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def joined(spans: Column) -> Column:
    """The spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
