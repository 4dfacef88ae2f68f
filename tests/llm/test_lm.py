import math
import zlib
from collections import Counter

import numpy as np
import pytest

from echogrid.llm import lm

END = "\n"


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [END]


def brute(rows, strength, order=3):
    """Scores by plain recursion over dictionaries of counts."""
    held = {i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i, _ in rows}
    counts = [Counter() for _ in range(order)]
    for i, text in rows:
        if not held[i]:
            t = tokens(text)
            for n in range(order):
                counts[n].update(tuple(t[k - n : k + 1]) for k in range(n, len(t)))
    total, words = sum(counts[0].values()), len(counts[0])

    def p(gram):
        if len(gram) == 1:
            return (counts[0][gram] + 0.1) / (total + 0.1 * (words + 1))
        k, context = strength[len(gram) - 2], counts[len(gram) - 2][gram[:-1]]
        return (counts[len(gram) - 1][gram] + k * p(gram[1:])) / (context + k)

    out = []
    for i, text in rows:
        t = tokens(text)
        score = sum(math.log10(p(tuple(t[max(0, k - order + 1) : k + 1]))) for k in range(len(t)))
        out.append((i, held[i], len(t), sum(counts[0][(w,)] > 0 for w in t), total, sum(math.log10(p((w,))) for w in t), score))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    words = ["The", "the", "É", "é", "a"] + [f"w{i}" for i in range(40)]
    made = [(i, " ".join(rng.choice(words, rng.integers(0, 200)))) for i in range(60)]
    return [*made, (100, None), (101, ""), (102, " \n"), (103, "never seen words"), (104, "a " * 20_000), (105, made[3][1]), (None, "the a")]


@pytest.mark.parametrize(("order", "block"), [(3, 1 << 20), (3, 3000), (2, 3000), (1, 3000), (4, 3000)])
def test_scores_equal_plain_recursion(spark, rows, order, block):
    strength = (5.0, 2.0, 1.0)
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    got = sorted((tuple(r) for r in lm.score(docs, order=order, strength=strength, block_bytes=block).collect()), key=str)
    want = sorted(brute(rows, strength, order), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_probabilities_after_a_context_sum_to_one(spark):
    rows = [(i, "a b a c b a b c c a") for i in range(1, 6)]
    probes = [(1000 + k, f"a b {w}".strip()) for k, w in enumerate(["a", "b", "c"])]
    plain = brute([*rows, *probes], (10_000.0, 20.0))
    got = {r.id: r.score for r in lm.score(spark.createDataFrame([*rows, *probes], "doc_id long, text string")).collect()}
    assert all(math.isclose(got[w[0]], w[6], rel_tol=1e-9) for w in plain)


def test_held_out_texts_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in lm.score(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    assert len({tuple(r) for r in lm.score(docs).collect()}) == 1 and lm.score(docs).count() == 2
    assert lm.score(docs.limit(0)).collect() == []
