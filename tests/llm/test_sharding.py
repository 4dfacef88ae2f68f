import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.llm import queries, sharding


def plain_jump(key, shards):
    """The published loop, one key at a time."""
    last, hop = -1, 0
    while hop < shards:
        last = hop
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        hop = int((last + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return last


@pytest.mark.parametrize("shards", [1, 2, 8, 9, 1000])
def test_jump_equals_the_plain_loop(shards):
    keys = np.random.default_rng(shards).integers(0, 1 << 64, 3000, dtype=np.uint64)
    keys[:3] = [0, 1, 2**64 - 1]
    before = keys.copy()
    assert sharding.jump(keys, shards).tolist() == [plain_jump(int(k), shards) for k in keys]
    assert (keys == before).all()


def test_a_new_shard_takes_its_share_and_nothing_else_moves():
    keys = np.random.default_rng(1).integers(0, 1 << 64, 90_000, dtype=np.uint64)
    old, new = sharding.jump(keys, 8), sharding.jump(keys, 9)
    moved = old != new
    assert (new[moved] == 8).all() and abs(moved.mean() - 1 / 9) < 0.01
    assert np.ptp(np.bincount(old)) < 0.1 * len(keys) / 8


ROWS = [(i, "é" * (i % 7), i) for i in range(500)] + [(None, None, 1), (None, "x", 2), (3, "again", 0), (3, "again", 0)]


@pytest.mark.parametrize("hot", [0, 900])
def test_slots_are_a_gapless_stable_order(spark, hot):
    rows = ROWS + [(None, "", 7)] * hot
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot long").repartition(4)
    rows = sharding.assign(docs, "doc_id", 8, [F.col("doc_id"), F.col("text")]).collect()
    key = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:16], 16)
    assert len(rows) == len(ROWS) + hot
    assert all(r.shard == plain_jump(key(r.doc_id), 8) and r.grown_shard == plain_jump(key(r.doc_id), 9) for r in rows)
    for shard in range(8):
        own = sorted((r.slot, key(r.doc_id), r.text or "") for r in rows if r.shard == shard)
        assert [s for s, _, _ in own] == list(range(len(own)))
        assert [k for _, k, _ in own] == sorted(k for _, k, _ in own)


def test_query_sizes_and_checksums(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op2_jump_shards(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts) and {r.law for r in rows} == {"key"}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.assign(docs, "doc_id", 8, [F.col("doc_id")]).collect() == []
