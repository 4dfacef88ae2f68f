import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from echogrid.llm import balance, resampling
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, longest):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, longest=1, buckets=10_000, least=20, percent=10, seed="2024"):
    """The contract, one document after the other."""
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for text in (x for _, x in rows):
        for f in grams(text, longest)[1]:
            s[place(f)] += 1
    for text in target:
        for f in grams(text, longest)[1]:
            t[place(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        words, found = grams(text, longest)
        weight = sum(gain[place(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[2], -r[3]))
    ranks = {}
    for k, r in enumerate(able[: len(able) * percent // 100]):
        ranks.setdefault(r, []).append(k + 1)
    return sorted(((*r, ranks[r].pop() if ranks.get(r) else None) for r in out), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    parts = np.array(["Été", "an", "THE", "x1", "or", "日本", "q\x00r", "a-b", "Ünter"])
    made = [(i, " ,.\n"[i % 4].join(rng.choice(parts, rng.integers(0, 60)))) for i in range(300)]
    same = [(None, "the an " * 12)] * 150
    return [*made, *same, (5, None), (7, ""), (8, " . "), (9, "w" * 300_000), (9, "été the " * 40_000), *made[:20], *made[:3]]


TARGET = ["the x1", "Été, THE! or", None, "", "日本 日本"]


@pytest.mark.parametrize(("longest", "least", "percent", "parts"), [(1, 20, 10, 1), (3, 5, 50, 4), (1, 20, 100, 3), (2, 10_000_000, 10, 2)])
def test_the_draw_equals_brute_force(spark, rows, longest, least, percent, parts):
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, id string, score double").repartition(parts)
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, salt int")
    got = resampling.resample(docs, target, longest=longest, buckets=97, least_words=least, percent=percent)
    want = brute(rows, TARGET, longest, 97, least, percent)
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    plain = lambda rs: sorted((r[:5] for r in rs), key=repr)
    drawn = lambda rs: sorted((r[5], r[:5]) for r in rs if r[5] is not None)
    assert plain(found) == plain(want) and drawn(found) == drawn(want)


def test_nothing_to_draw(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(empty, empty).collect() == []
    one = resampling.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), empty, percent=100, least_words=1).collect()
    assert [tuple(r)[:4] for r in one] == [(1, 2, 2, brute([(1, "a b")], [])[0][3])] and one[0]["rank"] == 1


def test_offsets_hold_for_any_bytes_and_any_block(monkeypatch):
    texts = ["Ab é", "", "x" * 50, "日本 日本-a", "\x00", "É"]
    column = pa.array([t.encode() for t in texts] + [b"ok \xff\xfe no", None], pa.binary())
    want = None
    for size in (1, 7, 1 << 18):
        monkeypatch.setattr(resampling, "BLOCK_BYTES", size)
        data, starts, ends, rows = resampling.Splitter()(column)
        got = [data[a:b].tobytes() for a, b in zip(starts, ends)]
        assert got == [w for t in texts for w in map(str.encode, WORD.findall("".join(c.lower() if c < "\x80" else c for c in t)))] + [b"ok", b"\xff\xfe", b"no"]
        assert rows[-1] == len(got) and (want is None or rows.tolist() == want)
        want = rows.tolist()


def test_a_text_of_many_megabytes(spark):
    size = 12 << 20
    docs = spark.createDataFrame([(1, "word the " * (size // 9)), (2, "y" * size)], "doc_id long, text string")
    got = {r.id: (r.n_words, r.n_features) for r in resampling.resample(docs, docs.limit(0)).collect()}
    assert got == {1: (2 * (size // 9), 2 * (size // 9)), 2: (1, 1)}


def test_numbers_follow_the_order(spark):
    rows = spark.range(0, 5_000, 1, 7).select((F.col("id") * 7919 % 5003).alias("v"))
    got = balance.numbered(rows, [F.desc("v")], "at").orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(5000)) and [r.v for r in got] == sorted((r.v for r in got), reverse=True)
    assert balance.numbered(rows.limit(0), [F.desc("v")], "at").collect() == []


def test_heavy_and_light_keys_meet_their_values(spark, monkeypatch):
    monkeypatch.setattr(balance, "HEAVY", 10)
    keys = [1] * 500 + [None] * 300 + list(range(2, 150))
    many = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    values = spark.createDataFrame([(k, -k) for k in range(1, 100)] + [(None, 5)], "k int, v int")
    for how in ("inner", "left"):
        want = [(k, i, -k if k and k < 100 else None) for i, k in enumerate(keys)]
        got = balance.attach(many, values, ["k"], how).select("k", "i", "v").collect()
        assert sorted(map(tuple, got), key=repr) == sorted((w for w in want if how == "left" or w[2] is not None), key=repr)
