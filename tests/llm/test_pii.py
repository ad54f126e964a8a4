"""Spans against the plain patterns, one text at a time."""

import random
import re

from pyspark.sql import functions as F

from helmline.llm import pii
from tests.llm.helpers import documents

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def expected(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                  "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def texts():
    rng = random.Random(4)
    bits = ["a@b.co", "x.y@d-e.org", "_q@", "@", ".", "-", " ", "\n", "é", "\U0001f600", "10.0.0.1", "256.1.1.1", "001.002.3.4",
            "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567", "+1", "12", "word", "\x01", "\x02", ".5", "99999999999"]
    out = ["a@b.c_x@d.e", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "+1 2345678 9 +", "0" * 40, "a" * 200 + "@x.y"]
    return out + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(400)]


def test_base_spans(spark):
    rows = list(enumerate(texts())) + [(None, "me@you.org"), (3, None), (4, ""), (4, "")]
    df = documents(spark, rows).withColumn("spans", F.lit(1))
    got = pii.find(df, out="spans").collect()
    assert len(got) == len(rows)
    for r in got:
        base = [(s.start, s.kind_no, s.kind, s.end) for s in r.spans if s.base]
        assert base == expected(r.text), r.text
    assert pii.find(df.limit(0)).count() == 0


def test_added_kinds_and_redaction(spark):
    rows = [(1, "IBAN: GB82 WEST 1234 5698 7654 32."), (2, "GB82 WEST 1234 5698 7654 33"), (3, "social security 123-45-6789"),
            (4, "part 123-45-6789"), (5, "call +49 30 1234567 or me@you.org"), (6, None), (7, "clean"),
            (8, "x " + "a@b.co " * 700 + "end")]
    got = {r.doc_id: r for r in pii.redact(pii.find(documents(spark, rows))).collect()}
    assert [s.kind for s in got[1].spans] == ["iban"] and got[1].text == "IBAN: [IBAN]."
    assert not got[2].spans and got[2].text == rows[1][1]
    assert [s.kind for s in got[3].spans] == ["national_id"] and not got[4].spans
    assert got[5].text == "call [PHONE] or [EMAIL]"
    assert got[6].text is None and got[7].text == "clean"
    assert len(got[8].spans) == 700 and got[8].text == "x " + "[EMAIL] " * 700 + "end"
