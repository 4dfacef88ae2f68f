import hashlib
import re

import numpy as np
import pytest

from echogrid.llm import decontaminate, positions, text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=13):
    w = words(text)
    hit, owners = set(), set()
    for item, body in items:
        v = words(body)
        n = min(window, len(v))
        phrases = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in phrases:
                hit.update(range(i, i + n))
                owners.add(str(item))
    return len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def items():
    rng = np.random.default_rng(5)
    made = [(i, ", ".join(rng.choice(["an", "Été", "or", "x1", "the"], rng.integers(1, 40)))) for i in range(25)]
    return [*made, (30, None), (31, " -- "), (32, "the"), (33, made[3][1]), (9, made[4][1])]


@pytest.fixture(scope="module")
def texts(items):
    rng = np.random.default_rng(6)
    out = [None, "", "...", "the", "no hit here", "x" * 100_000, "an or " * 9_000]
    for _ in range(120):
        body = list(rng.choice(["an", "ÉTÉ", "or", "été", "X1", "the", "zz"], rng.integers(1, 120)))
        if rng.random() < 0.6:
            at = rng.integers(len(body))
            body[at:at] = [items[rng.integers(25)][1]]
        out.append(rng.choice([" ", "-", ".\n"]).join(body))
    return out + out[-5:]


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_judge_matches_brute_force(spark, items, texts, limit, monkeypatch):
    monkeypatch.setattr(positions, "BLOCK_BYTES", limit)
    monkeypatch.setattr(positions, "CANDIDATES", limit)
    monkeypatch.setattr(positions.matches, "__defaults__", (None, 2 << 20 if limit > 300 else 40))
    docs = spark.createDataFrame([(i if i != 4 else None, t, "n", i) for i, t in enumerate(texts)], "doc_id long, text string, body string, c0 long").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r)[1:] for r in decontaminate.judge(docs, bench, ["doc_id", "c0"]).collect())
    assert got == [(i, *brute(t, items)) for i, t in enumerate(texts)]


def test_spans_and_proximity(spark):
    docs = spark.createDataFrame([(1, "zz a b c d zz"), (2, "d x c x b x a"), (3, "a b"), (4, "c d a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.spans(docs, bench, window=4).collect()] == [(1, "7", [1], [5])]
    near = {r.id: r.item for r in decontaminate.spans(docs, bench, window=4, reach=6).collect()}
    assert near == {1: "7", 2: "7", 4: "7"}
    assert {r.id for r in decontaminate.spans(docs, bench, window=4, reach=2).collect()} <= {1, 4}


def test_phrases_stop_at_the_end_of_a_document(spark):
    docs = spark.createDataFrame([(1, "x a"), (2, "b a b"), (3, ""), (4, "b")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(7, "a b")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.spans(docs, bench, window=2).collect()] == [(2, "7", [1], [3])]


def test_another_benchmark_asks_the_index_and_reads_no_text(spark, items, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"zz {t} zz") for i, (_, t) in enumerate(items)], "doc_id long, text string").write.parquet(path)
    index = positions.build(spark.read.parquet(path), ["doc_id"])
    spark.createDataFrame([(0, "gone")], "doc_id long, text string").write.mode("overwrite").parquet(path)
    for some in (items[:9], items[9:]):
        bench = spark.createDataFrame(some, "item_id long, text string")
        got = sorted(map(tuple, decontaminate.judge_index(index, bench).collect()))
        assert got == [(i, *brute(f"zz {t} zz", some)) for i, (_, t) in enumerate(items)]


def test_postings_are_read_back(spark):
    texts = ["a b a", "", None, "b " * 300 + "a", "É-é é"]
    index = positions.build(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), ["doc_id"])
    assert [(r.ordinal, r.n_words, r.doc_id) for r in text.uncarried(index.texts, index.carried, "ordinal", "n_words").orderBy("ordinal").collect()] == [(0, 3, 0), (1, 0, 1), (2, 0, 2), (3, 301, 3), (4, 3, 4)]
    found = {}
    for r in index.postings.collect():
        found[bytes(r.term).decode()] = np.cumsum(text.read_varints(bytes(r.positions)).astype(int)).tolist()
        assert r.n == len(found[bytes(r.term).decode()])
    assert found == {"": [0, 4, 5, 6, 308], "a": [0, 2, 306], "b": [1, *range(6, 306)], "É": [308], "é": [309, 310]}


def test_proximity_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 30))) for _ in range(60)]
    bench = [(k, " ".join(rng.choice(list("abcdefgh"), 3))) for k in range(12)]
    index = positions.build(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), ["doc_id"])
    got = {(r.id, r.item): r.starts for r in decontaminate.spans(index, spark.createDataFrame(bench, "item_id long, text string"), window=3, reach=4).collect()}
    total = {c: sum(words(t).count(c) for t in texts) for c in "abcdefgh"}
    for i, t in enumerate(texts):
        w = words(t)
        for k, body in bench:
            terms = sorted(set(words(body)))
            least = min(terms, key=lambda c: (total[c], words(body).index(c)))
            near = [p for p, c in enumerate(w) if c == least and all(x in w[max(0, p - 4) : p + 5] for x in terms)]
            found = got.get((i, str(k)), [])
            ties = [c for c in terms if total[c] == total[least]]
            assert found == near or (len(ties) > 1 and bool(found) == bool(near))


def test_a_text_of_many_megabytes(spark):
    docs = spark.createDataFrame([(1, "aa bb cc " * 900_000 + "dd ee"), (2, "y" * (9 << 20))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "cc dd ee"), (2, "bb aa")], "item_id long, text string")
    assert sorted(tuple(r)[:4] for r in decontaminate.judge(docs, bench, ["doc_id"]).collect()) == [(1, 2_700_002, 3, 1), (2, 1, 0, 0)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert decontaminate.judge(empty, bench, ["doc_id"]).collect() == []
    assert [tuple(r)[:4] for r in decontaminate.judge(docs, bench, ["doc_id"]).collect()] == [(1, 1, 0, 0)]


def test_items_without_an_id_are_one_with_an_empty_id(spark):
    docs = spark.createDataFrame([(1, "a b zz"), (2, "zz zz"), (3, "c d")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b"), (None, "c d"), (4, "c d")], "item_id long, text string")
    want = [(i, *brute(t, [("", "a b"), ("", "c d"), (4, "c d")])) for i, t in ((1, "a b zz"), (2, "zz zz"), (3, "c d"))]
    assert sorted(map(tuple, decontaminate.judge(docs, bench, ["doc_id"]).collect())) == want
    assert sorted((r.id, r.item) for r in decontaminate.spans(docs, bench).collect()) == [(1, ""), (3, ""), (3, "4")]
