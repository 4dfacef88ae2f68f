import time

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from echogrid.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNT = token_counts.Counter(*token_counts.read_tokenizer(PATH))


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


PARTS = [*"aestrvlmd'  \n!1é", "'ll", "'re", " '", "'s", " ", "　", "日本", "😀", "<|endoftext|>", "<|endof", "the ", "word"]


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), max_size=12))
@settings(max_examples=300, deadline=None)
def test_counts_equal_the_library(texts):
    assert COUNT(pa.array(texts, pa.string())).tolist() == library(texts)


def test_long_and_null_texts():
    texts = [None, "", " ", "x" * 50_000, "don't " * 30_000, "  \n" * 10_000, "<|endoftext|>" * 50, "a"]
    assert COUNT(pa.array(texts)).tolist() == library(texts)


def letters(n, seed=0, of="etaoinshrdlucmfwypvbgkjqxz"):
    return "".join(np.random.default_rng(seed).choice(list(of), n))


UNBROKEN = [letters(3000), letters(5000, 1, "ab"), "a" * 4097, letters(900, 2, "日本語é"), "=" * 70 + "-" * 999, "ha" * 700, letters(65), letters(64), "9" * 200, letters(2000, 3, "=!-_/"), "\n" * 300 + "x"]


def test_long_pieces_equal_the_library(monkeypatch):
    assert COUNT.merges.ordered
    assert COUNT(pa.array(UNBROKEN)).tolist() == library(UNBROKEN)
    monkeypatch.setattr(token_counts, "LONG_PIECE", 1)  # all pieces in the sweep
    monkeypatch.setattr(token_counts, "RANK_STEP", 7)
    texts = [*UNBROKEN, "the end", "", "don't"]
    assert COUNT(pa.array(texts)).tolist() == library(texts)


@given(st.lists(st.text("abcdeth 'x!", max_size=200), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_the_sweep_equals_the_rounds(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    sizes = np.array([len(t) for t in texts if t], np.int64)
    if len(sizes):
        assert COUNT.merges.sweep(data, sizes).tolist() == COUNT.merges.rounds(data, sizes).tolist()


def test_time_of_an_unbroken_text_is_linear():
    def seconds(n):
        start = time.process_time()
        COUNT(pa.array([letters(n)]))
        return time.process_time() - start

    seconds(1000)
    assert seconds(1_600_000) < 8 * max(1.0, seconds(400_000))


def test_a_text_of_many_megabytes_through_the_operator(spark):
    unbroken, words = letters(20_000) * 150, "some plain words, don't\n  you think? " * 250_000
    docs = spark.createDataFrame([(1, unbroken), (2, words)], "doc_id long, text string")
    got = {r.id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, PATH).collect()}
    assert got == {k + 1: (len(t), n) for k, (t, n) in enumerate(zip((unbroken, words), library([unbroken, words])))}


def test_blocks_cut_where_a_piece_begins():
    texts = ["it's  a\n\nlong 'll text <|endoftext|> of  words\t and " * 40, "x" * 200 + " y" * 50, "é " * 300, ""]
    for text in texts:
        parts = [b.to_pylist()[0] for b in token_counts.text.blocks(pa.array([text]), 50)]
        assert b"".join(parts) == text.encode()
        assert sum(int(COUNT(pa.array([p], pa.large_binary()))[0]) for p in parts) == library([text])[0]


def test_every_character_in_three_settings():
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000][::7]
    texts = [f"{x}{chr(p)}{y}" for p in points for x, y in (("a", "b"), ("1", "1"), ("!", "!"))]
    assert COUNT(pa.array(texts)).tolist() == library(texts)


def test_chunk_maps_compose_to_one_plain_run():
    after, emits = token_counts.transducer()
    kinds = np.random.default_rng(1).integers(0, 12, 3001).astype(np.uint8)
    state, plain = token_counts.FRESH, []
    for k in kinds:
        plain.append(emits[k, state])
        state = after[k, state]
    assert token_counts.emissions(kinds, after, emits).tolist() == plain


@pytest.mark.parametrize("rows", [[], [(1, None, 5), (1, "a b", 5), (None, "a b", 6)]])
def test_query_over_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted((tuple(r) for r in token_counts.count_tokens(docs, PATH).collect()), key=str)
    assert got == sorted(((d, len(t or ""), n) for (d, t, _), n in zip(rows, library([r[1] for r in rows]), strict=True)), key=str)
