"""Personal data: base spans against the plain patterns, and what the trees add."""

import hashlib
import re

import pytest

from spotweave.llm import pii

TEXTS = [
    None, "", "write a.b+c@mail-1.example.com, or x@y", "a@b.c@d.e a@b.c_d@e.f @x.y a@@b.c.d", "ip 97.51.17.173 and 300.1.1.1 and 1.2.3.4.5 and 01.002.3.4",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 or 41111111111111111111111", "call +1 (487) 555-7209 or +49 30 1234567 or + 1 2", "é +33 1 23 45 67 89 é x@é.com",
    "ΩΩ 4111111111111111ΩΩ", "none here " * 4000 + "z@z.zz", "one two three 2.0 1998-2003", "+1 (017) 555-7713 190.137.223.204",
]


def plain(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


@pytest.fixture(scope="module")
def detector():
    return pii.Detector()


def test_base_spans():
    for t in TEXTS:
        assert pii.base_spans(t or "") == plain(t)


def test_documents(spark, detector):
    df = spark.createDataFrame([(i if i % 5 else None, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 1)], "doc_id long, text string, spans string, n_ip int")
    got = sorted(map(tuple, pii.find_pii(df, detector).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()), key=repr)
    want = []
    for i, t in [*enumerate(TEXTS), (3, TEXTS[3])]:
        s = plain(t)
        n = [sum(k == kind for k, *_ in s) for kind in pii.KINDS]
        want.append((i if i % 5 else None, *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert pii.find_pii(df.limit(0), detector).count() == 0


def test_trees_add_and_spare(detector):
    kinds = lambda t: {k for k, *_ in detector.spans(t)[1]}
    assert kinds("please call me at (212) 555-1234 today") == {"phone"}
    assert kinds("please mail jane.doe (at) example (dot) org today") == {"email"}
    assert kinds("the host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 is down") == {"ip"}
    for clean in ("order 1234567890123456 shipped", "ISBN 978-3-16-148410-0", "on 2021-03-04 10:20:30 we met", "we met at noon. dot com is a word", "Version 2.0, 1998-2003", "value 3.14159265358979"):
        assert kinds(clean) == set(), clean
    assert all(r >= 0.8 for r in detector.recall.values())


def test_masked_addresses_without_a_hint(detector):
    found = lambda t: [t[a:b] for k, a, b in detector.spans(t)[1] if k == "email"]
    assert found("please mail jane.doe at example.com today") == ["jane.doe at example.com"]
    assert found("please mail jane.doe AT example.com. Thanks") == ["jane.doe AT example.com"]
    assert found("jane at home. mail jane.doe at mail.example.org") == ["jane.doe at mail.example.org"]
    for clean in ("we met at noon. Sometimes it rains", "the end at home. Inside it was warm", "please look at example.com today"):
        assert found(clean) == [], clean
    assert pii.masked("mail ada at lab.de at once") == [(5, 18)]


def test_recall_counts_what_has_no_candidate(monkeypatch):
    monkeypatch.setattr(pii, "masked", lambda text: [])
    assert pii.Detector(n=400).recall["email"] == 0


def test_lists_of_numbers(detector):
    found = lambda t: [(k, t[a:b]) for k, a, b in detector.spans(t)[1]]
    assert found("call 212-555-1234, 212-555-9876 today") == [("phone", "212-555-1234"), ("phone", "212-555-9876")]
    assert found("(212) 555-1234 (646) 555-9876") == [("phone", "(212) 555-1234"), ("phone", "(646) 555-9876")]
    assert found("call 212.555.1234 2021-03-04") == [("phone", "212.555.1234")]
    assert found("+1 (487) 555-7209, 212-555-1234") == [("phone", "+1 (487) 555-7209"), ("phone", "212-555-1234")]
    for clean in ("12, 345, 6789, 12, 40, 5512, 7", "on 2021-03-04 2021-03-05 2021-03-06 we met", "1 2 3 4 5 6 7 8 9 10 11 12"):
        assert found(clean) == [], clean


def test_digit_spans_are_all_sequences_of_groups():
    text = "+123-4567, 89 (12345678901234567890) 1.2.3"
    got = {text[a:b] for a, b, _ in pii.digit_spans(text)}
    assert got == {"+123-4567", "+123-4567, 89"}
    assert {n for _, _, n in pii.digit_spans("1 " * 100)} == set(range(7, 20))


def test_spans_keep_base(detector):
    for t in TEXTS:
        base, every = detector.spans(t or "")
        assert set(base) <= set(every)


def test_redaction():
    assert pii.redacted("mail a@b.cd now", [("email", 5, 11)]) == "mail [EMAIL] now"
    assert pii.redacted("abcdef", [("ip", 0, 4), ("card", 2, 6)]) == "[IP]"
