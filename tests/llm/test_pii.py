import hashlib
import re

import pytest

import pyarrow as pa

from tidemark.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and P.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


TRICKY = [
    "a@b.c@d.e x@y z.@q.r..s w@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 999999999999.1.1.1",
    "4111 1111-1111 1111 4111111111111112 0000 0000 0000 00", "+1 (743) 555-3824) +12345 ++49-30-1234567890-",
    "mail a.b@c.de+1 212 555 1234 1.1.1.1@x.y", "é@ü.de a@ü.de a@b", "@" * 50 + "a@b.cc" + "@" * 50, "",
]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans_on_tricky_texts(text):
    assert P.base_spans(text) == plain(text)


def test_base_spans_on_the_table(small):
    rows = {r.doc_id: r for r in P.find(small).collect()}
    for r in small.collect():
        want = plain(r.text)
        got = rows[r.doc_id]
        assert got.base_sha256 == hashlib.sha256(P.joined(want).encode()).hexdigest()
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        spans = got.spans.split(",") if got.spans else []
        assert set(P.joined(want).split(",")) - {""} <= set(spans)


def test_the_method_adds_loose_spans_and_leaves_numbers_alone(spark):
    docs = spark.createDataFrame(
        [(i, f"call me by phone at (212) 555-{1000 + i} or +1 212 555 {2000 + i} soon, mail x{i}@example.com") for i in range(60)]
        + [(100, "phone: 212-555-7788 please call"), (101, "invoice order 123-456-7890123 version 2.0.1, page 12"), (102, "nothing here")],
        "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in P.find(docs).collect()}
    assert rows[100] == "phone:7:19" and rows[101] == "" and rows[102] == ""
    assert rows[3].count("phone:") == 2


def test_reliabilities_follow_the_votes():
    rows = [(0, (1, 1, 1, 1, 0, 0), (1,) * 10, 500), (0, (-1, -1, 0, 0, -1, -1), (0,) * 10, 500), (0, (1, -1, 1, 0, 0, 0), (1, 0) * 5, 40)]
    m = P.fit_model(rows)
    assert m.reliability[1, 0, 2] > 0.9 and m.reliability[0, 0, 0] > 0.9
    assert m.probability((0, 0, 5), (1,) * 10) > 0.9 > 0.5 > m.probability((0, 0, 5), (0,) * 10)
    assert P.fit_model([]) is None


def test_edges_and_redaction(edge, nothing):
    rows = P.find(edge).collect()
    assert len(rows) == edge.count() and sum(r.n_email for r in rows) == 1 and sum(r.n_ip for r in rows) >= 1
    out = P.redact(edge)
    assert out.columns == edge.columns and out.dtypes == edge.dtypes
    texts = [r.text for r in out.collect()]
    assert texts.count(None) == 2 and not any(P.base_spans(t) for t in texts if t)
    assert any("<EMAIL>" in t for t in texts if t)
    assert P.find(nothing).count() == 0 and P.redact(nothing).count() == 0


def test_redaction_of_overlaps():
    assert P.redact_text("abcdefgh", [(1, 0, 4), (2, 1, 6), (7, 3, 8)]) == "a<EMAIL>g<PHONE>"


def test_redaction_hands_on_few_rows_at_a_time():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": ["mail a.b@example.com " + "x" * 100_000] * 40})
    out = list(P._redacted(None)([batch]))
    assert max(b.column("text").nbytes for b in out) <= 2 * P.STEP and len(out) > 4
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == list(range(40))
    assert all(t.startswith("mail <EMAIL> x") for b in out for t in b.column("text").to_pylist())
