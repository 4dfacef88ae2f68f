import heapq
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echogrid.llm import segment

PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = segment.read_model(PATH)
ENCODER = segment.Encoder(PIECES)
BY_NAME = {n.decode(): (i, int(PIECES.scores[i])) for i, n in enumerate(PIECES.names) if PIECES.usable[i]}
WORST = int(PIECES.scores[PIECES.usable].min()) - int(segment.UNKNOWN_GAP * segment.SCALE)


def spaced(text):
    return " " + text.replace("▁", " ") if text else ""


def brute(text):
    """All segmentations of the whole text, as sorted (loss, ids), over the plain lattice without chunks."""
    body = spaced(text)
    ends = {0: [(0, ())]}
    for j in range(1, len(body) + 1):
        ways = []
        for i in range(max(0, j - 16), j):
            name = body[i:j]
            if name in BY_NAME:
                piece, score = BY_NAME[name]
                ways += [(t + score, (*ids, piece)) for t, ids in ends[i]]
            elif j == i + 1:
                ways += [(t + WORST, (*ids, *(PIECES.zero + b for b in name.encode()))) for t, ids in ends[i]]
        ends[j] = ways
    return sorted(ends[len(body)], key=lambda w: -w[0])


def changed(ids, edits):
    out = list(ids)
    for e in sorted(edits, key=lambda e: -e["at"]):
        out[e["at"] : e["at"] + e["drop"]] = e["ids"]
    return tuple(out)


PARTS = [*"aehot ▁\n", "é", "日", "😀", "the", "an", " in", "  "]


@given(st.lists(st.sampled_from(PARTS), max_size=6).map("".join))
@settings(max_examples=150, deadline=None)
def test_n_best_equal_all_segmentations(text):
    found = {k: v.to_pylist()[0] for k, v in ENCODER(pa.array([text])).items()}
    every = brute(text)
    want = [s for s, _ in every[: segment.BEST]]
    assert [round(s * segment.SCALE) for s in found["scores"]] == want
    scored = {ids: s for s, ids in every}
    given_ids = [changed(found["ids"], e) for e in found["changes"]]
    assert [scored[i] for i in given_ids] == want and len(set(given_ids)) == len(given_ids)
    assert tuple(found["ids"]) == given_ids[0]
    assert found["round_trip"] == ("▁" not in text)


@given(st.lists(st.sampled_from(["\r", "\n", ";", " {", ")", "}", "a", " "]), max_size=6).map("".join))
@settings(max_examples=150, deadline=None)
def test_n_best_over_carriage_returns(text):
    test_n_best_equal_all_segmentations.hypothesis.inner_test(text)


def test_a_piece_that_ends_in_a_carriage_return_is_found():
    assert BY_NAME[";\r"][0] in ENCODER(pa.array(["a;\r\nb"]))["ids"].to_pylist()[0]


def test_a_star_of_one_chunk_is_sorted_and_complete():
    packed = np.frombuffer(b" therein", np.uint8)
    lattice = segment.Lattice(packed, np.array([0, len(packed)]), ENCODER.trie, PIECES)
    found = lattice.n_best(0, 10_000)
    assert [s for s, _ in found] == [s for s, _ in brute("therein")]
    assert lattice.losses(lattice.best_paths()[0])[0] == found[0][0] - found[1][0]


def whole_paths(lattice, chunk, n):
    """The search with whole paths in its heap."""
    source, sink = int(lattice.sources[chunk]), int(lattice.sinks[chunk])
    heap, found = [(-int(lattice.score[sink]), (), sink, 0, ())], []
    while heap and len(found) < n:
        cost, path, node, behind, edges = heapq.heappop(heap)
        if node == source:
            found.append((-cost, list(edges[::-1])))
            continue
        low = int(lattice.first[node])
        for edge in range(low, low + int(lattice.count[node])):
            before, after = int(lattice.start[edge]), behind + int(lattice.weight[edge])
            heapq.heappush(heap, (-(int(lattice.score[before]) + after), (*path, before), before, after, (*edges, edge)))
    return found


@pytest.mark.parametrize("body", [" therein", " aaaaaaaaa", " ====", " \r\r\r;\r", " 日本語日本", " internationalization", " 000000000000"])
@pytest.mark.parametrize("n", [1, 4, 50])
def test_a_star_orders_ties_by_the_longest_last_pieces(body, n):
    packed = np.frombuffer(body.encode(), np.uint8)
    lattice = segment.Lattice(packed, np.array([0, len(packed)]), ENCODER.trie, PIECES)
    assert lattice.n_best(0, n) == whole_paths(lattice, 0, n)


@pytest.mark.parametrize("part", ["x", "therein"])
def test_a_long_text_without_blanks_takes_little_memory(part):
    body = (" " + part * 200_000)[:200_000].encode()
    lattice = segment.Lattice(np.frombuffer(body, np.uint8), np.array([0, len(body)]), ENCODER.trie, PIECES)
    tracemalloc.start()
    found = lattice.n_best(0, segment.BEST)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == segment.BEST and len({tuple(e) for _, e in found}) == segment.BEST and peak < 200 << 20
    assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)
    assert all(b"".join(bytes(lattice.packed[a:b]) for a, b in zip(lattice.start[e].tolist(), lattice.end[e].tolist(), strict=True)) == body for _, e in found)
    assert all(int(lattice.weight[e].astype(np.int64).sum()) == s for s, e in found)
    assert lattice.losses(lattice.best_paths()[0])[0] == found[0][0] - found[1][0]


def test_rows_do_not_depend_on_their_neighbours():
    texts = ["the end", "", None, "then  an\nend", "x" * 3000, "the end"]
    whole = [dict(zip(("i", "s", "c", "r"), v, strict=True)) for v in zip(*(c.to_pylist() for c in ENCODER(pa.array(texts)).values()), strict=True)]
    alone = [dict(zip(("i", "s", "c", "r"), (c.to_pylist()[0] for c in ENCODER(pa.array([t], pa.string())).values()), strict=True)) for t in texts]
    assert whole == alone


def test_results_do_not_depend_on_how_chunks_meet_in_lattices(monkeypatch):
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["the", "international", "x", "日本", "a\nb", "zzzz", "therein"], 40)) for _ in range(5)] + [None, "", "y" * 300]
    want = {k: v.to_pylist() for k, v in ENCODER(pa.array(texts)).items()}
    for limit in (1, 20, 200):
        monkeypatch.setattr(segment, "SLICE_BYTES", limit)
        assert {k: v.to_pylist() for k, v in segment.Encoder(PIECES)(pa.array(texts)).items()} == want


def test_twenty_megabytes_of_words_through_the_operator(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeinorstdlu"), rng.integers(2, 9))) for _ in range(150_000)]
    body = " ".join(rng.choice(words, 3_500_000))
    docs = spark.createDataFrame([(1, body)], "doc_id long, text string")
    row = segment.encode(docs, PIECES, ["doc_id"]).select(F.size("ids").alias("n"), F.size("scores").alias("s"), "round_trip").first()
    assert row.round_trip and row.s == segment.BEST and row.n > 3_500_000 and len(body) > 20_000_000


def test_memory_of_many_distinct_chunks_is_bounded():
    rng = np.random.default_rng(3)
    body = " ".join("".join(x) for x in rng.choice(list("aeinorst"), (400_000, 7)))
    encoder = segment.Encoder(PIECES)
    tracemalloc.start()
    encoder(pa.array([body]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 900 << 20, peak


def test_library_decodes_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    encoded = segment.encode(docs, PIECES, ["doc_id"])
    texts = {r.doc_id: r.text for r in docs.collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = encoded.collect()
    assert len(rows) == len(texts) and all(r.round_trip for r in rows)
    assert all(library.decode(r.ids) == texts[r.doc_id] for r in rows)
    assert {r.doc_id: r.text for r in segment.decode(encoded, PIECES, ["doc_id"]).collect()} == texts


@pytest.mark.parametrize("rows", [[], [(1, None, 2), (None, "a b", 3), (1, "a b", 3)]])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    back = segment.decode(segment.encode(docs, PIECES, ["doc_id"]), PIECES, ["doc_id"]).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((d, t or "") for d, t, _ in rows), key=str)
