import re
from collections import Counter

import numpy as np
import pytest

from echogrid.llm import collocations, quotient, text


def brute(rows, longest=3, least=10, share=50, top=2000):
    """The contract in plain loops."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    picked = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *words), a in picked.items():
        cuts = [(10**6 * a * a // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        hidden = any(100 * b >= share * a for (other, *w), b in picked.items() if other == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1)))
        if not hidden:
            out.append((lang, " ".join(words), a, f[lang, *words[:k]], f[lang, *words[k:]], n[lang], score))
    rows = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        rows += [(lang, k + 1, *r[1:]) for k, r in enumerate(own[:top])]
    return sorted(rows)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    words = np.array(["the", "New", "york", "Été", "a", "of", "a\x01", "日本", "x-y", '"q', "b\x00", "times"])
    joints = np.array([" ", "  ", "\t", " ", " ", ". ", ",", "\r\n", " - ", " "])
    made = []
    for i in range(400):
        chosen = rng.choice(words, rng.integers(0, 40), p=np.arange(12, 0, -1) / 78)
        made.append(("".join(w + rng.choice(joints) for w in chosen), [None, "en", "en", "fr", ""][i % 5]))
    made += [("New York Times is here. In New York Times", "en")] * 30 + [("rare only once", "xx"), (None, "en"), ("", None), (" ., ", "zz"), ("a a a a", "fr")]
    return made + made[:50]


@pytest.mark.parametrize(
    ("longest", "least", "top", "parts", "limits"),
    [(3, 10, 2000, 1, {}), (3, 10, 7, 4, {"run_bytes": 500}), (3, 3, 2000, 3, {"run_bytes": 300, "entries": 50, "fan_bits": 2}), (5, 4, 2000, 2, {"entries": 1 << 10}), (2, 2, 2000, 2, {})],
)
def test_phrases_equal_brute_force(spark, rows, longest, least, top, parts, limits):
    docs = spark.createDataFrame([(t, x, "c", 1) for t, x in rows], "text string, lang string, word string, n int").repartition(parts)
    got = collocations.collocations(docs, longest=longest, least=least, top=top, **limits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, longest, least, 50, top)


def test_no_rows(spark):
    for rows in ([], [(None, None), ("", "en"), ("once", "en")]):
        assert collocations.collocations(spark.createDataFrame(rows, "text string, lang string")).collect() == []


def test_a_text_of_many_megabytes(spark):
    size = 6 << 20
    docs = spark.createDataFrame([("one two " * (size // 8), "en"), ("one, " * 100 + "z" * size, "en")], "text string, lang string")
    found = [tuple(r) for r in collocations.collocations(docs).collect()]
    n = size // 8
    assert found[0][:4] in {("en", 1, "one two one", n - 1), ("en", 1, "two one two", n - 1)} and {r[6] for r in found} == {2 * n + 101}


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3 * 10**14 + 1, 4 * 10**14 + 3, 5 * 10**14 + 7
    grams = spark.createDataFrame([([1, 2], a)], "ids array<long>, a long")
    numbers = spark.createDataFrame([(1, left), (2, right)], "id long, f long")
    assert collocations.score_cuts(grams, numbers).first()["score"] == 10**6 * a * a // (left * right)


@pytest.mark.parametrize(("bits", "length"), [(1, 2), (5, 3), (17, 3), (21, 3), (22, 3), (31, 3), (40, 3), (24, 5)])
def test_keys_are_read_back_and_filters_merge(bits, length):
    rng = np.random.default_rng(bits)
    half = quotient.half_width(bits, length)
    columns = [rng.integers(0, 1 << bits, 900, dtype=np.uint64) for _ in range(length)]
    for c in columns:
        c[:3] = [0, (1 << bits) - 1, 1]
        c[-200:] = c[:200]
    key = quotient.pack(columns, bits, half)
    permuted = quotient.permute(*key, half)
    assert all((a == b).all() for a, b in zip(quotient.restore(*permuted, half), key))
    assert all((a == b).all() for a, b in zip(quotient.unpack(*key, bits, half, length), columns))
    want = Counter(zip(*(c.tolist() for c in columns)))
    shards = {}
    for at in range(0, 900, 250):  # four shards of the input, filters by the two top bits
        counted = quotient.count(*(p[at : at + 250] for p in permuted), half)
        for shard, part in counted.split(min(2, half)):
            shards.setdefault(shard, []).append(part.to_bytes(min(2, half)))
    got = Counter()
    for raws in shards.values():
        merged = quotient.merge([quotient.Packed(r).filter() for r in raws])
        again = quotient.Packed(merged.to_bytes(min(2, half)))
        assert (again.lookup(merged.left, merged.right) == merged.counts).all()
        assert sum(len(again.lookup(p[:0], p[:0])) for p in permuted) == 0
        ids = quotient.unpack(*quotient.restore(merged.left, merged.right, half), bits, half, length)
        got.update(dict(zip(zip(*(i.tolist() for i in ids)), merged.counts.tolist())))
    assert got == want
    first = quotient.count(*(p[:250] for p in permuted), half)
    packed, there = quotient.Packed(first.to_bytes()), set(zip(first.left.tolist(), first.right.tolist()))
    expect = [int(first.counts[k]) if (k := next((j for j, e in enumerate(zip(first.left.tolist(), first.right.tolist())) if e == pair), None)) is not None else 0 for pair in zip(*(p.tolist() for p in permuted))]
    assert packed.lookup(*permuted).tolist() == expect and there


def test_varints():
    values = np.array([0, 1, 127, 128, 300, 1 << 35, (1 << 63) + 5], np.uint64)
    assert (text.read_varints(text.varints(values)) == values).all() and len(text.varints(values[:3])) == 3
    assert text.varints(values[:0]) == b"" and len(text.read_varints(b"")) == 0
