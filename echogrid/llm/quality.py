"""Quality classifier: hashed word and character n-gram vectors, averaged per document.

Every feature (a word, a pair of neighbouring words, three neighbouring bytes of
a word) hashes to a bucket with a learned vector.  A document is the mean of its
features' vectors; a softmax layer turns that into label probabilities.  Vectors
and layer are learned together by stochastic gradient descent in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

BUCKETS = 1 << 16
WIDTH = 12
EPOCHS = 6
RATE = 10.0
SAMPLE = 6_000  # labelled rows that training sees at most
THRESHOLD = 0.3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SAME = np.uint64(0x5851F42D4C957F2D)  # stands for the second word of a pair where it repeats the first


class Model(NamedTuple):
    """What training learns: bucket vectors, the softmax layer and its bias."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def logits(self) -> np.ndarray:
        """The layer is linear in the mean, so a bucket adds one number: the gap between the two labels."""
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float64)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (hashes ^ (hashes >> np.uint64(29))) * _MIX
    return (mixed >> np.uint64(64 - 16)).astype(np.int64) % BUCKETS


class Features:
    """Feature buckets of a run of rows: by distinct word (itself and its byte triples), and by pair of words."""

    def __init__(self, column: pa.Array):
        words = text.Words(column, text.CASED)
        self.rows = words.rows
        self.codes, vocabulary = words.coded()
        sizes = np.array([len(w) for w in vocabulary], np.int64) + 2
        marked = np.frombuffer(b"".join(b"<%b>" % w for w in vocabulary), np.uint8).astype(np.uint64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(len(marked)) - np.repeat(starts[:-1], sizes)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(sizes.max(initial=1)), 1_000_003, np.uint64))
            weighted = np.concatenate([[np.uint64(0)], np.cumsum((marked + np.uint64(1)) * powers[at])])
            self.hashes = weighted[starts[1:]] - weighted[starts[:-1]]
            triples = marked[:-2] << np.uint64(16) | marked[1:-1] << np.uint64(8) | marked[2:] if len(marked) else marked
        inside = np.flatnonzero(at[: len(triples)] < np.repeat(sizes, sizes)[: len(triples)] - 2)
        self.of_word = np.concatenate([_bucket(self.hashes), _bucket(triples[inside] ^ _SAME)])
        owner = np.concatenate([np.arange(len(sizes)), np.repeat(np.arange(len(sizes)), sizes)[inside]])
        order = np.argsort(owner, kind="stable")
        self.of_word = self.of_word[order]
        self.starts = np.searchsorted(owner[order], np.arange(len(sizes) + 1))
        first = self.hashes[self.codes]
        with np.errstate(over="ignore"):
            follows = np.where(self.codes[1:] == self.codes[:-1], _SAME, (first[:-1] * np.uint64(31)) ^ first[1:]) if len(first) else first
        self.pairs = _bucket(follows)
        self.paired = np.ones(max(0, len(self.codes) - 1), bool)
        edges = self.rows[1:-1] - 1
        self.paired[edges[(edges >= 0) & (edges < len(self.paired))]] = False  # no pair across two rows

    def means(self, values: np.ndarray) -> np.ndarray:
        """Mean of ``values[bucket]`` over each row's features; zero without features."""
        per_word = text.segment_sums(values[self.of_word], self.starts)
        totals = text.segment_sums(per_word[self.codes], self.rows)
        counts = text.row_sums(np.diff(self.starts)[self.codes], self.rows)
        pair = np.append(np.where(self.paired, values[self.pairs], 0.0), 0.0)[: len(self.codes)]
        totals = totals + text.segment_sums(pair, self.rows)
        counts = counts + text.row_sums(np.append(self.paired, False)[: len(self.codes)].astype(np.int64), self.rows)
        return totals / np.maximum(counts, 1)

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket, share) of the distinct buckets of every row."""
        width = np.diff(self.starts)[self.codes]
        row = np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))
        spot = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(self.starts[:-1][self.codes], width)
        held = np.flatnonzero(self.paired)
        keys = np.concatenate([np.repeat(row, width) * BUCKETS + self.of_word[spot], row[held] * BUCKETS + self.pairs[held]])
        found, n = np.unique(keys, return_counts=True)
        rows = found // BUCKETS
        return rows, found % BUCKETS, n / np.bincount(rows, n, minlength=1)[rows]


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """Stochastic gradient descent over (buckets, shares, label) rows; without rows the model is neutral."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer = rng.uniform(-1 / WIDTH, 1 / WIDTH, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            buckets, shares, label = rows[k]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = shares @ vectors[buckets] if len(buckets) else np.zeros(WIDTH, np.float32)
            scores = mean @ layer + bias
            error = np.exp(scores - scores.max())
            error /= error.sum()
            error[label] -= 1
            back = layer @ error
            layer -= rate * 0.1 * np.outer(mean, error)
            bias -= rate * 0.01 * error
            vectors[buckets] -= (rate * shares[:, None]) * back
    return Model(vectors, layer, bias)


def held_out(id_column: Column, folds: int = 5) -> Column:
    """Whether the CRC-32 of the id's text (null: empty) is divisible by ``folds``."""
    return F.crc32(F.encode(F.coalesce(id_column.cast("string"), F.lit("")), "UTF-8")) % folds == 0


def sampled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, sample: int) -> DataFrame:
    """(id, digest, label, body) of the rows training sees.

    Ids choose ids and digests choose rows: no text is shuffled but the chosen ones.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    ids = texts.select("id").join(known.hint("merge"), "id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    keyed = texts.join(F.broadcast(ids), "id").withColumn("digest", F.unhex(F.md5(F.coalesce("body", F.lit("")))))
    chosen = keyed.select("id", "digest").distinct().orderBy(F.xxhash64("id"), "id", "digest").limit(sample)
    return keyed.join(F.broadcast(chosen), ["id", "digest"]).groupBy("id", "digest", "label").agg(F.first("body").alias("body"))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` labelled rows that are not held out, chosen by a hash of their ids.

    An id labelled more than once counts with its largest label; null labels
    and ids are not learned from.  Texts that repeat an id are rows of their own,
    rows that repeat id and text are one.  Only the sampled rows' sparse features
    meet in one task, and only the model, whose size is fixed, reaches the driver.
    """
    rows = sampled(docs, labels, label_col, id_col, text_col, sample)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, "body", 1 << 20):
            n = part.num_rows
            row, bucket, share = Features(part.column("body")).counted()
            at = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(v, kind)) for v, kind in ((bucket, pa.int32()), (share, pa.float32()))]
            yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.string()), part.column("digest"), part.column("label"), *lists], ["id", "digest", "label", "buckets", "shares"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("digest", "ascending")])
        rows = [
            (np.array(b.values, np.int64), np.array(s.values, np.float32), int(y > 0))
            for b, s, y in zip(table["buckets"], table["shares"], table["label"].to_pylist(), strict=True)
        ]
        model = train(rows)
        return pa.table({"vectors": [model.vectors.tobytes()], "layer": [model.layer.tobytes()], "bias": [model.bias.tobytes()]})

    spelt = rows.mapInArrow(spell, "id string, digest binary, label int, buckets array<int>, shares array<float>")
    learned = spelt.groupBy(F.lit(0).alias("all")).applyInArrow(learn, "vectors binary, layer binary, bias binary").collect()
    if not learned:
        return train([])
    read = lambda raw, *shape: np.frombuffer(raw, np.float32).reshape(shape)
    return Model(read(learned[0].vectors, BUCKETS, WIDTH), read(learned[0].layer, WIDTH, 2), read(learned[0].bias, 2))


def score(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``carry`` columns of every row, then ``score`` (probability of label 1) and ``predicted``.

    Every whole text is read, and a score depends on nothing but the text and the
    model.  A text without words, null included, is scored by the bias alone;
    rows that repeat are scored each, an empty table gives no rows.
    """
    gap, base = model.logits(), float(model.bias[1] - model.bias[0])
    rows, names, fields = text.carried(docs, text_col, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, "body"):
            found = 1 / (1 + np.exp(-np.clip(Features(part.column("body")).means(gap) + base, -700, 700)))
            out = [*(part.column(names[c]) for c in carry), pa.array(found), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, [*names.values(), "score", "predicted"])

    scored = rows.mapInArrow(run, ", ".join([*fields, "score double, predicted int"]))
    return text.uncarried(scored, names, "score", "predicted")
