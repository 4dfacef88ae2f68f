"""A positional inverted index over texts, stored in the shared folder.

Texts are indexed in blocks, of a few thousand documents each.  Within a block
words are numbered through, with one number left out behind every document, and
each term has one row: the block, the term itself, how often it occurs and its
ascending positions as variable-length differences.  The empty term, which no
word is, holds where the documents begin.  Rows of a second kind hold what is
known of a document itself.  A term's rows are as many as blocks that hold it,
and no row holds more than a block.

Queries are joins: phrases meet the index by their rarest term, which names the
blocks in question, and the other lists are intersected there, rarest first,
each moved by its term's place in the phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .balance import attach, stored

BLOCK_BYTES = 16 << 20
PART_PHRASES = 2 << 20  # distinct phrases that one task meets a block with
CANDIDATES = 2 << 20  # positions that are intersected together
MARK = b""  # the term of where documents begin


class Index(NamedTuple):
    """``postings`` (block, term, n, positions) and ``texts`` (block, ordinal, n_words and the carried columns)."""

    postings: DataFrame
    texts: DataFrame
    carried: dict[str, str]


def post(words: text.Words) -> pa.RecordBatch:
    """The postings of a block."""
    found = words.array().dictionary_encode()
    codes = found.indices.to_numpy()
    row = np.repeat(np.arange(len(words.rows) - 1), np.diff(words.rows))
    order = np.argsort(codes, kind="stable")
    counts = np.bincount(codes, minlength=len(found.dictionary))
    places = (np.arange(len(codes)) + row)[order]
    marks = words.rows[:-1] + np.arange(len(words.rows) - 1)
    places, counts = np.concatenate([places, marks]), np.append(counts, len(marks))
    ends = np.cumsum(counts)
    gaps = np.diff(places, prepend=0)
    gaps[(ends - counts)[counts > 0]] = places[(ends - counts)[counts > 0]]
    gaps = gaps.astype(np.uint64)
    bounds = np.concatenate([[0], np.cumsum(text.varint_sizes(gaps))])[np.concatenate([[0], ends])]
    held = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(text.varints(gaps))])
    terms = pa.concat_arrays([found.dictionary.cast(pa.binary()), pa.array([MARK], pa.binary())])
    return pa.RecordBatch.from_arrays([terms, pa.array(counts), held.cast(pa.binary())], ["term", "n", "positions"])


def build(docs: DataFrame, carry: list[str], text_col: str = "text") -> Index:
    """The index of all texts, in one pass over them; ``carry`` columns stay with the documents."""
    rows, names, fields = text.carried(docs, text_col, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        kept = list(names.values())
        for part in text.slices(batches, "body", BLOCK_BYTES):
            block += 1
            words, n = text.Words(part.column("body"), text.ALPHANUMERIC), part.num_rows
            posted = post(words)
            columns = [pa.array(np.full(len(posted), block)), *posted.columns, pa.nulls(len(posted), pa.int32()), pa.nulls(len(posted), pa.int64()), *(pa.nulls(len(posted), part.column(c).type) for c in kept)]
            yield pa.RecordBatch.from_arrays(columns, ["block", "term", "n", "positions", "ordinal", "n_words", *kept])
            own = [pa.array(np.full(n, block)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.diff(words.rows)), *(part.column(c) for c in kept)]
            yield pa.RecordBatch.from_arrays(own, ["block", "term", "n", "positions", "ordinal", "n_words", *kept])

    schema = ["block long", "term binary", "n long", "positions binary", "ordinal int", "n_words long", *fields]
    table = stored(rows.mapInArrow(run, ", ".join(schema)), "index")
    postings = table.filter("term IS NOT NULL").select("block", "term", "n", "positions")
    return Index(postings, table.filter("ordinal IS NOT NULL").select("block", "ordinal", "n_words", *names.values()), names)


class Block:
    """The lists of some terms in a block, as one ascending array of term number and position."""

    def __init__(self, terms: pa.Array, counts: np.ndarray, packed: bytes):
        self.terms, self.counts = terms, counts
        gaps = text.read_varints(packed).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        whole = np.concatenate([[0], np.cumsum(gaps)])
        self.places = whole[1:] - np.repeat(whole[self.starts[:-1]], counts)
        self.keys = (np.repeat(np.arange(len(counts)), counts) << 40) + self.places
        mark = pc.index(terms, pa.scalar(MARK, terms.type)).as_py()
        self.documents = self.places[self.starts[mark] : self.starts[mark + 1]] if mark >= 0 else np.zeros(0, np.int64)

    def number(self, terms: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(terms, self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = (term << 40) + place
        at = np.searchsorted(self.keys, key)
        return self.keys[np.minimum(at, len(self.keys) - 1)] == key

    def within(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the term stands anywhere from ``low`` to ``high``."""
        return np.searchsorted(self.keys, (term << 40) + low) < np.searchsorted(self.keys, (term << 40) + high, "right")

    def ordinal(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.documents, place, "right") - 1

    def exact(self, numbers: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of all matches of phrases whose terms stand in columns, the rarest first, -1 behind a short one."""
        phrase, start = self._expand(numbers[:, 0])
        start -= offsets[phrase, 0]
        phrase, start = phrase[start >= 0], start[start >= 0]
        for k in range(1, numbers.shape[1]):
            if not len(phrase):
                break
            term = numbers[phrase, k]
            good = (term < 0) | self.holds(np.maximum(term, 0), start + offsets[phrase, k])
            phrase, start = phrase[good], start[good]
        return phrase, start

    def near(self, numbers: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of each phrase's rarest term where all its others stand within ``reach`` words in the document."""
        phrase, place = self._expand(numbers[:, 0])
        own = self.ordinal(place)
        ends = np.append(self.documents[1:] - 1, np.int64(1 << 39))
        low, high = np.maximum(place - reach, self.documents[own]), np.minimum(place + reach, ends[own])
        for k in range(1, numbers.shape[1]):
            if not len(phrase):
                break
            term = numbers[phrase, k]
            good = (term < 0) | self.within(np.maximum(term, 0), low, high)
            phrase, place, low, high = phrase[good], place[good], low[good], high[good]
        return phrase, place

    def _expand(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.counts[term]
        phrase = np.repeat(np.arange(len(term)), size)
        return phrase, self.places[np.arange(len(phrase)) - np.repeat(np.cumsum(size) - size - self.starts[term], size)]


def matches(index: Index, phrases: DataFrame, reach: int | None = None, part_phrases: int = PART_PHRASES) -> DataFrame:
    """``block``, ``ordinal``, ``w``, ``size`` and the ascending word positions ``starts`` of every phrase in every document that holds it.

    ``phrases`` has ``w`` and ``terms``, no two alike.  With ``reach``, positions
    are those of the rarest term with all others that near, in any order.
    """
    parts = phrases.count() // part_phrases + 1
    listed = phrases.select("w", F.size("terms").alias("size"), F.posexplode(F.array_distinct("terms") if reach is not None else F.col("terms")).alias("at", "term"))
    asked = stored(listed.select("term").distinct().unionByName(phrases.sparkSession.createDataFrame([(MARK,)], "term binary")), "terms")
    lists = stored(index.postings.join(asked, "term", "left_semi"), "lists")
    totals = lists.groupBy("term").agg(F.sum("n").alias("total"))
    met = attach(listed, totals, ["term"], "left")
    plans = met.groupBy("w", "size").agg(F.sort_array(F.collect_list(F.struct("total", "at", "term"))).alias("plan"), F.count("total").alias("known"))
    plans = plans.filter(F.col("known") == F.size("plan")).select("w", "size", F.col("plan.at").alias("ats"), F.col("plan.term").alias("terms"))
    wanted = plans.withColumn("term", F.col("terms")[0]).join(lists.select("term", "block"), "term").withColumn("part", F.pmod("w", F.lit(parts)).cast("long"))
    given = lists.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).select(F.col("block").alias("in"), F.col("part").alias("of"), "term", "n", "positions")

    def run(lists: pa.Table, wanted: pa.Table) -> pa.Table:
        schema = pa.schema([("block", pa.int64()), ("ordinal", pa.int32()), ("w", pa.int64()), ("size", pa.int32()), ("starts", pa.list_(pa.int64()))])
        if not wanted.num_rows or not lists.num_rows:
            return schema.empty_table()
        packed, _ = text.buffer(lists.column("positions"))
        block = Block(lists.column("term").combine_chunks(), lists.column("n").to_numpy(), packed.tobytes())
        ats, terms = wanted.column("ats").combine_chunks(), wanted.column("terms").combine_chunks()
        widths = terms.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(widths)), widths)
        column = np.arange(len(row)) - np.repeat(np.cumsum(widths) - widths, widths)
        numbers, offsets = np.full((len(widths), int(widths.max())), -1), np.zeros((len(widths), int(widths.max())), np.int64)
        flat = block.number(terms.flatten())
        numbers[row, column], offsets[row, column] = np.where(flat < 0, -2, flat), ats.flatten().to_numpy()
        live = np.flatnonzero((numbers > -2).all(axis=1))  # the block holds every term
        ends = np.cumsum(block.counts[numbers[live, 0]])
        found, start = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        while start < len(live):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CANDIDATES, "right")))
            own = live[start:stop]
            phrase, place = block.exact(numbers[own], offsets[own]) if reach is None else block.near(numbers[own], reach)
            found.append((own[phrase], place))
            start = stop
        phrase, place = (np.concatenate(x) for x in zip(*found, strict=True))
        ordinal = block.ordinal(place)
        order = np.lexsort((place, phrase, ordinal))
        phrase, place, ordinal = phrase[order], place[order], ordinal[order]
        fresh = np.flatnonzero((np.diff(phrase, prepend=-1) != 0) | (np.diff(ordinal, prepend=-1) != 0))
        cuts = pa.array(np.append(fresh, len(phrase)).astype(np.int32))
        return pa.table(
            [
                pa.array(np.full(len(fresh), wanted.column("block")[0].as_py())), pa.array(ordinal[fresh].astype(np.int32)), wanted.column("w").combine_chunks().take(pa.array(phrase[fresh])),
                wanted.column("size").combine_chunks().take(pa.array(phrase[fresh])), pa.ListArray.from_arrays(cuts, pa.array(place - block.documents[ordinal] if len(place) else place)),
            ],
            schema=schema,
        )

    return given.groupBy("in", "of").cogroup(wanted.select("block", "part", "w", "size", "ats", "terms").groupBy("block", "part")).applyInArrow(run, "block long, ordinal int, w long, size int, starts array<long>")
