import hashlib

import pytest
from pyspark.sql import functions as F

from echogrid.llm import exact_dedup

ROWS = [
    (1, "same", "en"), (5, "same", "fr"), (3, "same ", "en"), (2, "Same", "de"), (9, "", None), (8, None, "x"), (4, "é" * 40_000, "y"), (7, "é" * 40_000, "z"),
    (6, "alone", "w"), (6, "alone", "w"), (None, "same", "n"), (None, "nobody", "n"), (None, "nobody", "n"), *[(100 + i, "hot", "h") for i in range(400)],
]
SCHEMA = "doc_id long, text string, keep_id string"


def brute(rows):
    groups = {}
    for i, text, _ in rows:
        groups.setdefault(text or "", []).append(i)
    out = []
    for i, text, _ in rows:
        own = groups[text or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 5])
def test_marks_equal_plain_grouping(spark, parts):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(parts)
    assert sorted(map(tuple, exact_dedup.mark(docs).collect()), key=str) == brute(ROWS)


def test_survivors_are_the_kept_rows_with_their_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = exact_dedup.survivors(docs)
    assert got.columns == docs.columns
    want = {}
    for i, text, extra in ROWS:
        best = want.get(text or "")
        if best is None or (i is not None and (best[0] is None or i > best[0])):
            want[text or ""] = (i, text or "", extra)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.values(), key=str)


def test_texts_with_one_hash_are_told_apart_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "content_hash", lambda text: F.unhex(F.lit("00")))
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(map(tuple, exact_dedup.mark(docs).collect()), key=str) == brute(ROWS)


def test_no_rows_and_no_python(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.mark(docs).collect() == [] and exact_dedup.survivors(docs).collect() == []
    plan = exact_dedup.mark(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
