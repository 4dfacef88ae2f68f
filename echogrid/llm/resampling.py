"""Importance resampling of documents towards a target distribution.

A Regex Split pre-tokenizer, which nothing trains, cuts the lower-cased texts
into words with offsets.  Windows of neighbouring offset pairs are the features;
the CRC of a feature's bytes names its bucket.  The histograms of the source and
the target give every bucket a gain, a document's weight is the mean gain of its
features, and Gumbel noise that depends on its id alone makes the heaviest
scores a draw without replacement.

Texts are read once: what is kept of a document is its sparse histogram, in a
table of the shared folder.  The driver holds two histograms, whose length is a
parameter, and the number of documents at each whole score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import PreTokenizedString, Regex
from tokenizers.pre_tokenizers import Split

from . import text
from .balance import numbered, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST = 1  # words of the longest feature
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
BLOCK_BYTES = 1 << 18  # of text that is pre-tokenized in one call
SALTS = 1 << 12  # tell rows apart that repeat an id


class Splitter:
    """Offsets of the words of a run of rows."""

    def __init__(self):
        self.split = Split(Regex(WORD), "removed", invert=True)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes of all rows, a blank behind each; byte offsets where words start and end; the first word of each row."""
        data, rows = text.buffer(column)
        data = np.insert(text.SMALL[data], rows[1:], 32)
        rows = rows + np.arange(len(rows))
        gaps, raw = np.flatnonzero(text.ALPHANUMERIC[data] == 32), data.tobytes()
        found, at = [np.zeros((0, 2), np.int64)], 0
        while at < len(raw):  # blocks end behind a byte that is in no word
            fit = np.searchsorted(gaps, at + BLOCK_BYTES)
            end = int(gaps[fit - 1 if fit and gaps[fit - 1] >= at else fit]) + 1
            found.append(self.offsets(raw[at:end]) + at)
            at = end
        pairs = np.concatenate(found)
        return data, pairs[:, 0], pairs[:, 1], np.searchsorted(pairs[:, 0], rows)

    def offsets(self, block: bytes) -> np.ndarray:
        try:
            held, unit = PreTokenizedString(block.decode()), "byte"
        except UnicodeDecodeError:  # which bytes are in words is the same if each one is a character
            held, unit = PreTokenizedString(block.decode("latin-1")), "char"
        self.split.pre_tokenize(held)
        pairs = held.get_splits("original", unit)
        return np.fromiter((end for _, pair, _ in pairs for end in pair), np.int64, 2 * len(pairs)).reshape(-1, 2)


def features(splitter: Splitter, column: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row; and of all features, by row, the row and the bucket."""
    data, starts, ends, rows = splitter(column)
    words = np.diff(rows)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    packed = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts)])
    held = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
    codes, vocabulary = held.indices.to_numpy().astype(np.int64), held.dictionary.to_pylist()
    owner = np.repeat(np.arange(len(words)), words)
    sums = np.array([zlib.crc32(w) for w in vocabulary], np.int64)
    grams, found = codes, [(owner, sums[codes] % buckets)]
    for length in range(2, longest + 1):  # a window grows by the word behind it, and its CRC by that word's bytes
        open_ = np.flatnonzero(owner[: len(grams) - 1] == owner[length - 1 :])
        pair = np.full(max(0, len(grams) - 1), -1, np.int64)
        distinct, spot = np.unique(grams[open_] * len(vocabulary) + codes[open_ + length - 1], return_inverse=True)
        before = [(int(sums[p // len(vocabulary)]), vocabulary[p % len(vocabulary)]) for p in distinct.tolist()]
        sums = np.array([zlib.crc32(b" " + w, s) for s, w in before], np.int64)
        pair[open_] = spot
        found.append((owner[open_], sums[spot] % buckets))
        grams = np.where(pair < 0, 0, pair)
    return words, np.concatenate([o for o, _ in found]), np.concatenate([b for _, b in found])


def histograms(rows: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``id``, ``n_words``, ``n_features``, the ``buckets`` that a row's features fall in with their ``counts``, and a ``salt``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for part in text.slices(batches, "body"):
            words, owner, bucket = features(splitter, part.column("body"), longest, buckets)
            cells, counts = np.unique(owner * buckets + bucket, return_counts=True)
            cuts = pa.array(np.searchsorted(cells, np.arange(part.num_rows + 1) * buckets).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v.astype(np.int32))) for v in (cells % buckets, counts)]
            made = [words, np.bincount(owner, minlength=part.num_rows)]
            salt = np.arange(part.num_rows, dtype=np.int32) % SALTS
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(m.astype(np.int64)) for m in made), *lists, pa.array(salt)], ["id", "n_words", "n_features", "buckets", "counts", "salt"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_words long, n_features long, buckets array<int>, counts array<int>, salt int")


def totals(found: DataFrame, buckets: int) -> np.ndarray:
    """The histogram of all rows: summed in each task, then by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for part in batches:
            at, counts = (part.column(k).flatten().to_numpy() for k in (0, 1))
            held += np.bincount(at, counts, buckets).astype(np.int64)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["bucket", "n"])

    summed = found.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in summed.collect():  # at most one row a bucket
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, floored."""
    size, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = [(t + 1) * (s_all + size) / ((s + 1) * (t_all + size)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(h: int) -> int:
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(found: DataFrame, gain: np.ndarray, seed: str) -> DataFrame:
    """The floored mean gain of every row as ``weight``, and ``score``, which adds the noise of its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            at, counts = part.column("buckets"), part.column("counts").flatten().to_numpy().astype(np.int64)
            n = part.column("n_features").to_numpy()
            starts = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy())])
            weight = text.row_sums(gain[at.flatten().to_numpy()] * counts, starts) // np.maximum(n, 1)
            score = weight + np.array([noise(h) for h in part.column("h").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([part.column(k) for k in ("id", "n_words", "n_features")] + [pa.array(weight), pa.array(score), part.column("salt")], ["id", "n_words", "n_features", "weight", "score", "salt"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    hashed = found.withColumn("h", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"))
    return hashed.mapInArrow(run, f"id {dict(found.dtypes)['id']}, n_words long, n_features long, weight long, score long, salt int")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST,
    buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED,
) -> DataFrame:
    """``id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row of ``docs``.

    Of the rows with ``least_words`` words, the floored ``percent`` with the
    highest scores are drawn and ranked from 1, ties to the smaller id; the
    others have a null rank.  Features are runs of up to ``longest`` words.

    A null text has no words, and weight 0; a null id hashes as an empty one and
    loses ties.  Rows that repeat an id share its noise; each is drawn for
    itself, with more features first among equal scores.  Texts of any length are
    pre-tokenized in blocks.  Without target rows, or without rows at all,
    every bucket is as good as the shares say.  Other columns are not read.
    """
    found = stored(histograms(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), longest, buckets), "histograms")
    aimed = histograms(target.select(F.lit(0).alias("id"), F.col(text_col).alias("body")), longest, buckets)
    scored = stored(weigh(found, gains(totals(found, buckets), totals(aimed, buckets)), seed), "scored")
    able = F.col("n_words") >= least_words
    levels = scored.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()  # whole scores span some ten thousands
    quota, cut, above = sum(n for _, n in levels) * percent // 100, None, 0
    for score, n in sorted(levels, reverse=True):
        if above >= quota:
            break
        cut, above = score, above + n
    near = able & (F.col("score") >= cut) if cut is not None else F.lit(False)
    order = [F.desc("score"), F.asc_nulls_last("id"), F.desc("n_features"), F.desc("weight"), F.asc("salt")]
    ranked = numbered(scored.filter(near), order, "at").withColumn("rank", F.when(F.col("at") < quota, F.col("at") + 1))
    out = ["id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(out).unionByName(scored.filter(~near).withColumn("rank", F.lit(None).cast("long")).select(out))
