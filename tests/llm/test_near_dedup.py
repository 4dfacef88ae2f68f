import numpy as np
import pyarrow as pa
import pytest
import xxhash

from echogrid.llm import components, near_dedup


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    words = ["the", "Über", "ran", "a", "cat", "Ça", "of", "it"] + [f"w{i}" for i in range(60)]
    out = [None, "", " \t\n", "one", "ONE two", "a b c d", "a  b\tc d", "a b c d e"]
    for _ in range(60):
        body = list(rng.choice(words, rng.integers(4, 400)))
        out.append(" ".join(body))
        for _ in range(rng.integers(0, 3)):
            body[rng.integers(len(body))] = "changed"
            out.append(" ".join(body))
    return out + out[8:20] + ["x " * 30_000]


def test_fingerprints_match_brute_force(texts):
    assert near_dedup.fingerprints(pa.array(texts)).tolist() == [brute_print(t) for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_trie_join_keeps_every_component(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    noise = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (600, 3), dtype=np.uint64), axis=1)
    prints = np.unique(np.concatenate([[np.uint64(0)], rng.choice(centres, 600) ^ noise, centres]))
    whole = brute_groups([int(x) for x in prints])
    forest = components.Forest(len(prints))
    half = len(prints) // 3
    for found in (near_dedup.trie_links(prints[:half], None), near_dedup.trie_links(prints[half:], None), near_dedup.trie_links(prints[:half], prints[half:])):
        forest.join(np.searchsorted(prints, found[:, 0]), np.searchsorted(prints, found[:, 1]))
    tops = forest._tops(np.arange(len(prints)))
    assert tops.tolist() == whole


@pytest.mark.parametrize(("leaf", "bits"), [(300, 12), (40, 3), (1, 12), (10_000, 12)])
def test_top_of_the_trie_covers_every_close_pair(spark, monkeypatch, leaf, bits):
    monkeypatch.setattr(near_dedup, "TOP_BITS", bits)
    rng = np.random.default_rng(3)
    crowd = (np.uint64(0xABCDEF) << np.uint64(40)) | rng.integers(0, 1 << 9, 250, dtype=np.uint64)  # alike in 55 bits
    prints = np.unique(np.concatenate([rng.integers(0, 1 << 64, 700, dtype=np.uint64), crowd, np.array([0, 2**64 - 1], np.uint64)]))
    counts = near_dedup.top_counts(spark.createDataFrame([(int(v),) for v in prints.view(np.int64)], "fp long"), leaf)
    leaves, pairs = near_dedup.top_units(counts)
    home = near_dedup.homes(prints, leaves)
    assert all(n <= leaf for n in np.bincount(home)) and [counts[node] for node in leaves] == np.bincount(home, minlength=len(leaves)).tolist()
    assert all(int(v) >> (64 - leaves[h][0]) == leaves[h][1] for v, h in zip(prints.tolist(), home))
    held = {frozenset(p) for p in pairs}
    assert len(held) == len(pairs)
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    assert all(frozenset((home[i], home[j])) in held for i, j in zip(*np.nonzero(close)))


def test_small_leaves_change_no_group(spark, texts, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, near_dedup.groups(docs).collect()))
    monkeypatch.setattr(near_dedup.links, "__defaults__", (near_dedup.BUDGET, 3))
    assert sorted(map(tuple, near_dedup.groups(docs).collect())) == want


def test_no_task_is_far_above_the_others(spark):
    """A third of all rows equal, with a null id and an empty text: what names them is broadcast, not dealt by key."""
    rows = [(None, "")] * 3000 + [(i, f"words of their own {i} {i * 7} {i * 13} and {i % 97} more {i * 31}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = near_dedup.groups(docs)
    assert found.count() == 9000 and found.filter("fp = 0").count() == 3000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_groups_match_brute_force(spark, texts):
    rows = [(100 - i if i != 5 else None, t, "x", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, salt int").repartition(3)
    got = sorted(((r.id, r.fp % 2**64, r.component_id) for r in near_dedup.groups(docs).collect()), key=str)
    prints = [brute_print(t) for t in texts]
    tops = brute_groups(prints)
    least = {}
    for (doc, *_), top in zip(rows, tops, strict=True):
        if doc is not None:
            least[top] = min(doc, least.get(top, doc))
    assert got == sorted(((r[0], p, least.get(t)) for r, p, t in zip(rows, prints, tops, strict=True)), key=str)


def test_empty_table(spark):
    assert near_dedup.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 150), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in components.roots(edges).collect()} == {i: 0 for i in range(61)} | {200: 150, 150: 150}
