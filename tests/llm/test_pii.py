import random
import re

from emberline.llm import pii
from emberline.llm.pii import automaton, find, find_spans, joined

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    pieces = ["@", ".", "a", "b.c", "é", " ", "-", "+", "(", ")", "1", "22", "255", "256", "4111 1111 1111 1111", "+49 30 1234567", "x@y.z", "10.0.0.1", "0001", "\n", "%", "٣"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_base_kinds():
    cues = automaton()
    for text in texts(1, 6000):
        assert [s for s in find_spans(text, cues) if s[1] < 4] == brute(text), repr(text)


def test_added_kinds():
    cues = automaton()
    found = lambda text: [(pii.KINDS[k], text[a:b]) for a, k, b in find_spans(text, cues) if k >= 4]
    assert found("see https://a.b-c.org/x?y=1, or ftp://h") == [("url", "https://a.b-c.org/x?y=1,"), ("url", "ftp://h")]
    assert found("IBAN DE89 3704 0044 0532 0130 00 and IBAN DE88 3704 0044 0532 0130 00") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert found("Account no. 1234 5678 90; konto: 12") == [("account", "1234 5678 90")]
    assert found("://x nothing://x") == []


def test_account_words_in_any_case():
    cues = pii.automaton()
    for text in ("Account Number: 12345678", "Account No: 12345678", "ACCOUNT NO: 12345678", "account number 12345678"):
        assert [(text[a:b], pii.KINDS[k]) for a, k, b in pii.find_spans(text, cues)] == [("12345678", "account")]


def test_ibans_anywhere():
    cues = automaton()
    found = lambda text: [text[a:b] for a, k, b in find_spans(text, cues) if k == 5]
    fr, de, gb = "FR76 3000 6000 0112 3456 7890 189", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    assert found(f"IBAN of the recipient: {fr}") == [fr]
    assert found("IBAN, as given by the recipient in the letter of the third of May: " + fr) == [fr]
    assert found(f"iban {de}, {gb} or {fr}") == [de, gb, fr]
    assert found(f"iban {de} {fr}") == [de, fr]
    assert found(f"IBAN DE88 3704 0044 0532 0130 00, rather {de}") == [de]
    assert found(f"IBAN {de} NOT LATER") == [de] and found(f"pay to {gb}") == [gb]
    assert found(f"x{gb} {gb}x A{de}") == []


def test_long_texts_are_linear():
    cues = automaton()
    for text in ("1" * 200_000, "a" * 200_000 + "@", "+1" * 100_000, "1." * 100_000, " " * 200_000 + "1", "@" * 200_000):
        find_spans(text, cues)


def test_frame(spark):
    rows = [(i, t, 0) for i, t in enumerate(texts(2, 50))] + [(None, "x@y.zz", 0), (77, None, 0), (77, "", 0)]
    got = find(spark.createDataFrame(rows, "doc_id long, text string, spans int"))
    got = got.select("doc_id", joined(got.spans).alias("s")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r.s for r in got}
    for doc_id, text, _ in rows[:50]:
        base = [s for s in by_id[doc_id].split(",") if s and s.split(":")[0] in pii.BASE_KINDS]
        assert base == [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute(text)]
    assert by_id[None] == "email:0:6" and by_id[77] == ""
