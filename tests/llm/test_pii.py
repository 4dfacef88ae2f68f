import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echogrid.llm import pii

ANCHORS = pii.automaton()
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(body):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, body):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {
                "email": True, "ip": kind == "ip" and all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def base(body):
    return [s for s in pii.find(ANCHORS, body) if s[0] in pii.BASE_KINDS]


PARTS = [*"@.+-() 0123456789aZ_%é", "a@b.co", "1.2.3.4", "255", "4111111111111111", "+1 (555) 123-4567", "https://x.yz/", "account no: 123456", "IBAN ", "\n"]


@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join))
@settings(max_examples=2000, deadline=None)
def test_base_spans_equal_the_patterns(body):
    assert base(body) == brute(body)


def test_base_spans_on_the_documents():
    for body in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()[:3000]:
        assert base(body) == brute(body)


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("see https://user:pw@host.example.org/a?b=1.", [("email", 17, 36), ("url", 4, 42)]),
        ("IBAN: DE89 3704 0044 0532 0130 00 ok", [("iban", 6, 33)]),
        ("IBAN DE00 3704 0044 0532 0130 00", []),
        ("Account no: 12345678.", [("account", 12, 20)]),
        ("Kontonummer 1234567", [("account", 12, 19)]),
        ("on account of 12 men", []),
        ("discount 1234567", []),
        ("http://localhost", []),
        ("", []),
    ],
)
def test_added_kinds(body, want):
    assert sorted(pii.find(ANCHORS, body)) == sorted(want)


def plain_url(body, at):
    """The address read to its end before the host is judged."""
    start = at
    while start > 0 and at - start < 12 and body[start - 1] in pii.LETTERS:
        start -= 1
    if body[start:at].lower() not in pii.SCHEMES or (start and body[start - 1] in pii.LABEL):
        return None
    end = at + 3
    while end < len(body) and body[end] in pii.URL:
        end += 1
    while end > at + 3 and body[end - 1] in ".,;:!?'()[]&*":
        end -= 1
    host = re.split("[/?#]", body[at + 3 : end])[0].rpartition("@")[2].partition(":")[0]
    labels = host.split(".")
    return (start, end) if len(labels) > 1 and all(x and not set(x) - pii.LABEL for x in labels) else None


@given(st.lists(st.sampled_from([*"a.b/?#:@!)( -é", "http://", "://", "a.b", "x@y.z", "?!", "ftp://u:p@h.i"]), max_size=14).map("".join))
@settings(max_examples=2000, deadline=None)
def test_addresses_equal_plain_reading(body):
    for m in re.finditer("://", body):
        assert pii.url(body, m.start()) == plain_url(body, m.start())


@pytest.mark.parametrize("part", ["http://", "http://a", "http://a.b?!", "https://x@y:http://", "iban abcd ", "account 123456 a@b.cc 1.2.3.4 ", "+1(", "a@", "@a.", "1.", "1-", "http://a.b/))"])
def test_time_is_linear(part):
    def seconds(n):
        body, start = part * (n // len(part)), time.process_time()
        pii.find(ANCHORS, body)
        return time.process_time() - start

    seconds(1000)
    assert seconds(800_000) < 10 * max(0.1, seconds(200_000))


def test_five_megabytes_of_schemes_through_the_operator(spark):
    docs = spark.createDataFrame([(1, "http://" * 750_000), (2, "a.b http://c.d " * 100_000)], "doc_id long, text string")
    found = {r.doc_id: r.n for r in pii.spans(docs, ["doc_id"]).select("doc_id", F.size("spans").alias("n")).collect()}
    assert found == {1: 0, 2: 100_000}


def test_added_spans_give_way_to_base_spans():
    rng = np.random.default_rng(4)
    parts = ["account 4111111111111111 ", "acct 123456 ", "a@b.co ", "iban DE89370400440532013000 ", "1.2.3.4 ", "konto no 99999999 "]
    body = "".join(rng.choice(parts, 400))
    found = pii.find(ANCHORS, body)
    base_spans = [(a, b) for k, a, b in found if k in pii.BASE_KINDS]
    assert {"iban", "account", "card"} <= {k for k, _, _ in found}
    assert not any(a < d and c < b for k, a, b in found if k in ("iban", "account") for c, d in base_spans)


def test_clean_text_has_no_spans():
    rng = np.random.default_rng(1)
    body = " ".join("".join(rng.choice(list("aeinorst"), rng.integers(1, 9))) for _ in range(20_000))
    assert pii.find(ANCHORS, body) == []


def test_long_digits():
    assert base("1" * 100_000 + " " + "9." * 50_000) == brute("1" * 100_000 + " " + "9." * 50_000)


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, 3), (None, "", 4), (2, "é a@b.co", 5), (2, "é a@b.co", 5)], "doc_id long, text string, spans long")
    got = sorted((tuple(r) for r in pii.spans(docs, ["doc_id"]).select("doc_id", pii.listed(F.col("spans")), pii.count_of(F.col("spans"), "email")).collect()), key=str)
    assert got == [(1, "", 0), (2, "email:2:8", 1), (2, "email:2:8", 1), (None, "", 0)]
    assert pii.spans(docs.limit(0), ["doc_id"]).collect() == []
