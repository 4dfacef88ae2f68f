import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from echogrid.llm import quality

SF = "/root/testdata/sf0.01"


def test_means_are_the_averages_of_counted_features():
    texts = pa.array([None, "", " ", "one", "one one one", "A b\nA b !!", "x" * 5000, "çà et là"])
    values = np.random.default_rng(1).normal(size=quality.BUCKETS)
    features = quality.Features(texts)
    row, bucket, share = features.counted()
    assert np.allclose(features.means(values), np.bincount(row, share * values[bucket], minlength=len(texts)))
    assert np.allclose(np.bincount(row, share)[3:], 1)


def test_features_of_a_row_do_not_depend_on_its_neighbours():
    values = np.random.default_rng(2).normal(size=quality.BUCKETS)
    texts = ["a b c", "c d", "", "d", "d d e"]
    alone = [quality.Features(pa.array([t])).means(values)[0] for t in texts]
    assert quality.Features(pa.array(texts)).means(values).tolist() == alone
    long = ["w" * k + " the of " * k for k in range(1, 60)]
    whole = quality.Features(pa.array(long)).means(values).tolist()
    assert whole == [quality.Features(pa.array([t])).means(values)[0] for t in long]


def plain_score(model, body):
    """Feature by feature in plain loops: words, their byte triples, neighbouring words."""
    m64, mix, same = 2**64 - 1, 0x9E3779B97F4A7C15, 0x5851F42D4C957F2D
    bucket = lambda h: (((h ^ (h >> 29)) * mix & m64) >> 48) % quality.BUCKETS
    spaced = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in (body or "").encode())
    words = [w for w in spaced.split(b" ") if w]
    found, hashes = [], []
    for w in words:
        marked, power, total = b"<" + w + b">", 1, 0
        for b in marked:
            power = power * 1_000_003 & m64
            total = total + (b + 1) * power & m64
        hashes.append(total)
        found.append(bucket(total))
        found += [bucket((marked[k] << 16 | marked[k + 1] << 8 | marked[k + 2]) ^ same) for k in range(len(marked) - 2)]
    for k in range(len(words) - 1):
        found.append(bucket(same if words[k] == words[k + 1] else hashes[k] * 31 & m64 ^ hashes[k + 1]))
    mean = np.mean([model.vectors[b].astype(float) for b in found], axis=0) if found else np.zeros(quality.WIDTH)
    scores = mean @ model.layer.astype(float) + model.bias
    return 1 / (1 + np.exp(scores[0] - scores[1]))


def test_scores_equal_plain_loops(spark, judged):
    model, sf = judged[1], "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.score(docs, model, ["doc_id"]).collect():
        assert abs(r.score - plain_score(model, texts[r.doc_id])) < 1e-6


def plain_descent(rows, seed=7):
    """Training with one scalar loop a feature."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / quality.WIDTH, 1 / quality.WIDTH, (quality.BUCKETS, quality.WIDTH)).astype(np.float32).astype(float)
    layer = rng.uniform(-1 / quality.WIDTH, 1 / quality.WIDTH, (quality.WIDTH, 2)).astype(np.float32).astype(float)
    bias, steps, done = np.zeros(2), quality.EPOCHS * len(rows), 0
    for _ in range(quality.EPOCHS):
        for k in rng.permutation(len(rows)):
            buckets, shares, label = rows[k]
            rate, done = quality.RATE * (1 - done / steps), done + 1
            mean = sum((s * vectors[b] for b, s in zip(buckets, shares)), np.zeros(quality.WIDTH))
            scores = mean @ layer + bias
            p = np.exp(scores) / np.exp(scores).sum()
            error = p - np.eye(2)[label]
            back = layer @ error
            layer = layer - rate * 0.1 * mean[:, None] * error[None, :]
            bias = bias - rate * 0.01 * error
            for b, s in zip(buckets, shares):
                vectors[b] = vectors[b] - rate * s * back
    return vectors, layer, bias


def test_training_equals_plain_descent():
    features = quality.Features(pa.array(["good words here", "bad junk junk", "good and fine", "junk bad", "words here"]))
    row, bucket, share = features.counted()
    rows = [(bucket[row == k], share[row == k].astype(np.float32), label) for k, label in enumerate((1, 0, 1, 0, 1))]
    model, (vectors, layer, bias) = quality.train(rows), plain_descent(rows)
    assert np.allclose(model.vectors, vectors, atol=1e-4) and np.allclose(model.layer, layer, atol=1e-4) and np.allclose(model.bias, bias, atol=1e-4)


def test_the_sample_counts_rows_and_rows_that_repeat_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows, seed=7: seen.append(len(rows)) or (_ for _ in ()).throw(ValueError(f"{len(rows)} rows")))
    docs = spark.createDataFrame([(i % 7, f"text {i % 40}") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")
    kept = [i for i in range(7) if zlib.crc32(str(i).encode()) % 5]
    for sample in (10, 10_000):
        with pytest.raises(Exception, match=f"{min(sample, 40 * len(kept))} rows"):
            quality.fit(docs, labels, sample=sample)


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    found = quality.score(docs, model, ["doc_id"]).withColumn("held_out", quality.held_out(F.col("doc_id")))
    return found.join(labels, "doc_id", "left").toPandas(), model


def test_held_out_accuracy(judged):
    rows, _ = judged
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    seen = rows[rows.held_out & rows.quality.notna()]
    assert (seen.predicted == seen.quality).mean() > 0.95
    assert (rows.predicted == (rows.score >= 0.3)).all()


def test_odd_rows(spark, judged):
    model = judged[1]
    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.1), (None, "a " * 50_000, 0.0), (2, "that it", None), (2, "that it", None)], "doc_id long, text string, score double")
    rows = quality.score(docs, model, ["doc_id"]).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[1]) == 1 and len(by[2]) == 1


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(5, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert [r.predicted for r in quality.score(docs, model, ["doc_id"]).collect()] == [1]
    assert quality.score(docs.limit(0), model, ["doc_id"]).collect() == []


def test_training_is_repeatable(spark, judged):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").repartition(5), spark.read.parquet(f"{SF}/labels.parquet")
    again = quality.fit(docs, labels)
    assert np.array_equal(again.vectors, judged[1].vectors)


def test_no_text_is_shuffled_to_choose_the_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = quality.sampled(docs, labels, "quality", "doc_id", "text", 20)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    blocks = rows._jdf.queryExecution().explainString(mode).split("\n\n")
    moved = [block for block in blocks if ") Exchange" in block]
    assert moved and not any("body#" in block or "text#" in block for block in moved)
    assert rows.count() == 20
