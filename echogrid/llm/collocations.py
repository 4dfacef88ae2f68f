"""Phrase collocations: n-grams of word numbers in counting quotient filters.

Texts become streams of word codes, run by run, with the run's own vocabulary
beside them; that table is written once.  Words frequent enough for a phrase get
gapless numbers over the whole corpus, in a sort; every run asks for the numbers
of its own words and counts its n-grams in filters by range of permuted keys.
Filters of a range are merged, over several levels where there are many, so a
row neither grows with the number of runs nor shrinks to a few entries.  Scores
and containment are joins over the phrases that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import quotient, text
from .balance import attach, numbered, stored

LONGEST = 3  # words of the longest phrase
LEAST = 10  # occurrences of a phrase
SHARE = 50  # hundredths of its occurrences that a longer phrase must hold to stand for it
TOP = 2_000  # phrases of a language
RUN_BYTES = 8 << 20  # of text that one vocabulary belongs to
ENTRIES = 2 << 20  # of a merged filter
FAN_BITS = 7  # a merge level has up to two to this many filters of a run

BREAKS = b".,;:!?\n\x0b\x0c\r"
BROKEN = np.array([b in BREAKS for b in range(256)])
SPACED = np.where(BROKEN | np.isin(np.arange(256), (32, 9)), 32, text.SMALL).astype(np.uint8)

RUN = "run long, lang string, n_words long, words array<binary>, counts array<long>, stream binary"


def pieces(column: pa.Array, limit: int) -> Iterator[pa.Array]:
    """The texts cut at the breaks, in arrays of about ``limit`` bytes; a longer piece stands alone."""
    data, rows = text.buffer(column)
    cuts = np.union1d(rows, np.flatnonzero(BROKEN[data]))
    start = 0
    while start < len(cuts) - 1:
        stop = max(start + 1, int(np.searchsorted(cuts, cuts[start] + limit, "right")) - 1)
        offsets = cuts[start : stop + 1].astype(np.int64)
        yield pa.Array.from_buffers(pa.large_binary(), stop - start, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        start = stop


def read_run(column: pa.Array) -> tuple[list[bytes], np.ndarray, bytes]:
    """Words of a run from the most frequent on, their counts, and the stream of their places from 1, 0 before each piece."""
    words = text.Words(column, SPACED)
    codes, vocabulary = words.coded()
    counts = np.bincount(codes, minlength=len(vocabulary))
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(1, len(order) + 1)
    starts = words.rows[:-1][np.diff(words.rows) > 0]
    return [vocabulary[k] for k in order], counts[order], text.varints(np.insert(place[codes], starts, 0))


def read_runs(rows: DataFrame, limit: int) -> DataFrame:
    """The texts in ``body`` as runs of one ``lang`` each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        schema = pa.schema([("run", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("stream", pa.binary())])
        for part in text.slices(batches, "body", limit):
            langs = part.column("lang").dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = part.column("body").filter(pa.array(langs.indices.to_numpy() == k))
                for held in pieces(own, limit):
                    words, counts, stream = read_run(held)
                    if words:
                        number += 1
                        yield pa.RecordBatch.from_pylist([{"run": number, "lang": lang, "n_words": int(counts.sum()), "words": words, "counts": counts.tolist(), "stream": stream}], schema)

    return rows.mapInArrow(run, RUN)


def run_grams(stream: bytes, places: np.ndarray, ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """All n-grams of two words on of a run, as one column of word numbers for each place; 0 behind a shorter one.

    A word without a number, like a break, is part of none.
    """
    number = np.zeros(int(places.max()) + 2, np.int64)
    number[places + 1] = ids
    read = text.read_varints(stream).astype(np.int64)
    at = np.where(read < len(number), number[np.minimum(read, len(number) - 1)], 0)
    columns = [[] for _ in range(longest)]
    whole = at > 0
    for length in range(2, longest + 1):
        whole = whole[:-1] & (at[length - 1 :] > 0)
        starts = np.flatnonzero(whole)
        for k in range(longest):
            columns[k].append(at[starts + k] if k < length else np.zeros(len(starts), np.int64))
    return [np.concatenate(c) for c in columns]


def rows_of(counted: quotient.Filter, bits: int, group: int) -> pa.Table:
    parts = counted.split(bits)
    return pa.table({"shard": pa.array([s for s, _ in parts], pa.int64()), "group": pa.array([group] * len(parts), pa.int64()), "held": pa.array([f.to_bytes(bits) for _, f in parts], pa.binary())})


FILTER = "shard long, `group` long, held binary"


def count_grams(runs: DataFrame, numbers: DataFrame, n_numbers: int, n_grams: int, n_runs: int, longest: int, least: int, entries: int, fan_bits: int) -> DataFrame:
    """``ids``, the word numbers of each n-gram that occurs ``least`` times, and ``a``, how often."""
    bits = max(1, n_numbers.bit_length())
    half = quotient.half_width(bits, longest)
    wanted = min(half, max(0, (n_grams // entries).bit_length()))
    levels = [min(wanted, fan_bits * (k + 1)) for k in range(max(1, -(-wanted // fan_bits)))]
    # a level's groups are such that each merges about as much as one run holds; the last merges all there is of a shard
    groups = [max(1, n_runs >> b) for b in levels[:-1]] + [1]

    def count(runs: pa.Table, asked: pa.Table) -> pa.Table:
        if not runs.num_rows or not asked.num_rows:
            return rows_of(quotient.count(*np.zeros((2, 0), np.uint64), half), levels[0], 0)
        columns = run_grams(runs.column("stream")[0].as_py(), asked.column("place").to_numpy(), asked.column("id").to_numpy(), longest)
        keys = quotient.permute(*quotient.pack(columns, bits, half), half)
        return rows_of(quotient.count(*keys, half), levels[0], hash(runs.column("run")[0].as_py()) % groups[0])

    def merged(rows: pa.Table) -> quotient.Filter:
        return quotient.merge([quotient.Packed(raw).filter() for raw in rows.column("held").to_pylist()])

    def level(k: int):
        return lambda rows: rows_of(merged(rows), levels[k], rows.column("group")[0].as_py() % groups[k])

    def final(rows: pa.Table) -> pa.Table:
        found = merged(rows)
        often = found.counts >= least
        ids = quotient.unpack(*quotient.restore(found.left[often], found.right[often], half), bits, half, longest)
        table = np.stack(ids, axis=1).astype(np.int64) if len(ids[0]) else np.zeros((0, longest), np.int64)
        cuts = np.concatenate([[0], np.cumsum((table > 0).sum(axis=1))]).astype(np.int32)
        return pa.table({"ids": pa.ListArray.from_arrays(pa.array(cuts), pa.array(table[table > 0])), "a": pa.array(found.counts[often])})

    words = runs.select(F.col("run").alias("of"), "lang", F.posexplode("words").alias("place", "word"))
    asked = words.join(numbers, ["lang", "word"]).select("of", "place", "id")
    held = runs.select("run", "stream").groupBy("run").cogroup(asked.groupBy("of")).applyInArrow(count, FILTER)
    for k in range(1, len(levels)):
        held = held.groupBy("shard", "group").applyInArrow(level(k), FILTER)
    return held.groupBy("shard").applyInArrow(final, "ids array<long>, a long")


def score_cuts(grams: DataFrame, numbers: DataFrame) -> DataFrame:
    """``grams`` with ``l``, ``r`` and ``score`` of the lowest-scoring cut, the first of equals."""
    counts = numbers.select(F.array("id").alias("part"), F.col("f").alias("part_f")).unionByName(grams.select(F.col("ids").alias("part"), F.col("a").alias("part_f")))
    size = F.size("ids")
    cuts = grams.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(True).alias("first"), F.slice("ids", 1, F.col("k")).alias("part")), F.struct(F.lit(False).alias("first"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("part")))
    met = attach(cuts.select("ids", "a", "k", F.inline(sides)), counts, ["part"])
    side = lambda is_first: F.max(F.when(F.col("first") == is_first, F.col("part_f")))
    whole = met.groupBy("ids", "a", "k").agg(side(True).alias("l"), side(False).alias("r"))
    exact = lambda c: f"cast({c} as decimal(18,0))"
    score = F.expr(f"cast(1000000 as decimal(7,0)) * ({exact('a')} * {exact('a')}) div ({exact('l')} * {exact('r')})")
    best = whole.groupBy("ids", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("ids", "a", "best.l", "best.r", "best.score")


def uncovered(scored: DataFrame, grams: DataFrame, longest: int, share: int) -> DataFrame:
    """The phrases that lie in no longer one with ``share`` hundredths of their occurrences."""
    if longest < 3:
        return scored
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("ids") - n + 1), lambda at: F.slice("ids", at, n))))
    windows = grams.filter(F.size("ids") > 2).select("a", F.explode(inside).alias("ids"))
    most = windows.groupBy("ids").agg(F.max("a").alias("longer"))
    return scored.join(most, "ids", "left").filter(F.coalesce(F.col("longer") * 100 < F.col("a") * share, F.lit(True))).drop("longer")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP,
    run_bytes: int = RUN_BYTES, entries: int = ENTRIES, fan_bits: int = FAN_BITS,
) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``longest`` words: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` how often the sides of
    its lowest-scoring cut do, ``n`` the words of the language.  Order: score,
    then ``a``, both falling, then the phrase's bytes.

    A null text is empty, a null language ``und``; rows that repeat count again.
    Texts of any length are cut at their breaks into runs, a piece without a
    break is never cut.  An empty table gives no rows.  Other columns are not read.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    runs = stored(read_runs(docs.select(F.col(text_col).alias("body"), lang.alias("lang")), run_bytes), "runs")
    spread = runs.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("e"))
    often = spread.groupBy("lang", F.col("e.words").alias("word")).agg(F.sum("e.counts").alias("f")).filter(F.col("f") >= least)
    numbers = stored(numbered(often, [F.asc("lang"), F.asc("word")], "at").select("lang", "word", "f", (F.col("at") + 1).alias("id")), "numbers")
    n_numbers, n_words = numbers.agg(F.count(F.lit(1)), F.coalesce(F.sum("f"), F.lit(0))).first()
    grams = stored(count_grams(runs, numbers, n_numbers, n_words * (longest - 1), runs.count(), longest, least, entries, fan_bits), "grams")
    kept = stored(uncovered(score_cuts(grams, numbers), grams, longest, share), "phrases")
    words = attach(kept.select("ids", "a", "l", "r", "score", F.posexplode("ids").alias("place", "id")), numbers.select("id", "lang", "word"), ["id"])
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.col("word").cast("string").alias("word")))), lambda w: w["word"]), " ")
    named = words.groupBy("ids", "lang", "a", "l", "r", "score").agg(said.alias("phrase"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = named.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top)
    sizes = runs.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
