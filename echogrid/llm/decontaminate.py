"""Benchmark decontamination over a stored positional inverted index.

The index of the training texts is a table (``positions``): it is built once and
any number of benchmarks ask it.  A benchmark becomes distinct windows of words
with the items that own them; windows are looked up as phrases, or by proximity.
What a document holds of each window comes back as word positions; items are put
together once for each set of windows, not for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .balance import attach, stored
from .positions import Index, build, matches

WINDOW = 13
BATCH = 20_000  # windows of a batch

FINAL = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``w``, ``terms`` and ``items`` of the distinct windows, a table of the shared folder.

    A window is ``window`` neighbouring words; an item of fewer words, but not
    none, is one.  Item ids are text, a null id is an empty one; each window
    lists its items once, in order.
    """
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, "body"):
            words = text.Words(part.column("body"), text.ALPHANUMERIC)
            held, counts = words.array().cast(pa.binary()), np.diff(words.rows)
            per_item = np.where(counts > 0, np.maximum(counts - window + 1, 1), 0)
            owner = np.repeat(np.arange(part.num_rows), per_item)
            first = np.repeat(words.rows[:-1] - np.cumsum(per_item) + per_item, per_item) + np.arange(per_item.sum())
            size = np.minimum(window, counts[owner])
            for low in range(0, len(owner), BATCH):
                own, begin, n = owner[low : low + BATCH], first[low : low + BATCH], size[low : low + BATCH]
                cuts = np.concatenate([[0], np.cumsum(n)])
                spots = np.arange(cuts[-1]) - np.repeat(cuts[:-1] - begin, n)
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(own)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), held.take(pa.array(spots)))], ["item", "terms"])

    cut = rows.mapInArrow(run, "item string, terms array<binary>")
    owned = cut.groupBy("terms").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return stored(owned.withColumn("w", F.monotonically_increasing_id()), "windows")


def covered(found: DataFrame) -> DataFrame:
    """``block``, ``ordinal`` and ``n_hit``, the words of the document inside any match."""

    def run(rows: pa.Table) -> pa.Table:
        starts = rows.column("starts").combine_chunks()
        sizes = np.repeat(rows.column("size").to_numpy(), starts.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        ordinal = np.repeat(rows.column("ordinal").to_numpy(), starts.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        low = (ordinal << 40) + starts.flatten().to_numpy()
        order = np.argsort(low, kind="stable")
        low, high = low[order], (low + sizes)[order]
        reach = np.maximum.accumulate(high)
        before = np.concatenate([[np.int64(-1)], reach[:-1]])
        added = high - np.maximum(low, np.minimum(before, high))
        named, place = np.unique(low >> 40, return_inverse=True)
        block = rows.column("block")[0].as_py()
        return pa.table({"block": pa.array(np.full(len(named), block)), "ordinal": pa.array(named.astype(np.int32)), "n_hit": pa.array(np.bincount(place, added, len(named)).astype(np.int64))})

    return found.groupBy("block").applyInArrow(run, "block long, ordinal int, n_hit long")


def owners(found: DataFrame, held: DataFrame) -> DataFrame:
    """``block``, ``ordinal``, ``n_items`` and ``items_sha256`` of every document with a match.

    Windows with the same items are one set; documents with the same sets are
    answered together.
    """
    named = held.select("w", "items", F.sha2(F.to_json("items").cast("binary"), 256).alias("own"))
    pairs = attach(found.select("block", "ordinal", "w"), named.select("w", "own"), ["w"])
    documents = stored(pairs.groupBy("block", "ordinal").agg(F.sort_array(F.collect_set("own")).alias("sets")).withColumn("all", F.sha2(F.array_join("sets", ",").cast("binary"), 256)), "owners")
    distinct = documents.groupBy("all").agg(F.first("sets").alias("sets")).select("all", F.explode("sets").alias("own"))
    sets = named.groupBy("own").agg(F.first("items").alias("items"))
    listed = distinct.join(sets, "own").select("all", F.explode("items").alias("item"))
    answers = listed.groupBy("all").agg(F.sort_array(F.collect_set("item")).alias("items"))
    digests = answers.select("all", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return attach(documents.drop("sets"), digests, ["all"]).drop("all")


def judge_index(index: Index, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``judge`` for texts that are already indexed: no text is read."""
    held = windows(benchmark, window=window)
    found = stored(matches(index, held.select("w", "terms")), "matches")
    hits = covered(found).join(owners(found, held), ["block", "ordinal"])
    judged = index.texts.join(hits, ["block", "ordinal"], "left")
    hit, none = F.coalesce("n_hit", F.lit(0)), F.sha2(F.lit(b""), 256)
    verdict = (hit > 0) & (hit * 20 >= F.col("n_words"))
    out = judged.select(
        *index.carried.values(), "n_words", hit.cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"), verdict.alias("contaminated"),
    )
    return text.uncarried(out, index.carried, *FINAL)


def judge(docs: DataFrame, benchmark: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``carry`` columns of every row, then ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``.

    A row is contaminated if it has hit words and they are a twentieth of its
    words or more.  Null and empty texts have no words and are clean.  Items
    that share an id count once; null ids are one item with an empty id, and
    items without words match nothing.  Rows that repeat are judged each; an
    empty table gives no rows, an empty benchmark clean ones.  A text over a
    block is a block of its own.  Columns may have any names.
    """
    return judge_index(build(docs, carry, text_col), benchmark, window)


def spans(docs: DataFrame | Index, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, reach: int | None = None) -> DataFrame:
    """One row per document and item that it holds: ``id``, ``item`` and word positions ``starts`` and ``ends`` of the matches.

    Exact phrase matches of whole windows, or with ``reach`` proximity matches:
    the places of a window's rarest term that has all its other terms within that
    many words.  An index may be given, of which the id is the first carried column.
    """
    index = docs if isinstance(docs, Index) else build(docs, [id_col], text_col)
    held = windows(benchmark, window=window)
    found = matches(index, held.select("w", "terms"), reach)
    size = F.col("size") if reach is None else F.lit(1)
    pairs = attach(stored(found, "matches").select("block", "ordinal", "w", size.alias("size"), "starts"), held.select("w", "items"), ["w"])
    spread = pairs.withColumn("item", F.explode("items")).withColumn("a", F.explode("starts")).select("block", "ordinal", "item", "a", (F.col("a") + F.col("size")).alias("b"))
    listed = spread.distinct().groupBy("block", "ordinal", "item").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    own = next(iter(index.carried.values()))
    return listed.join(index.texts.select("block", "ordinal", F.col(own).alias("id")), ["block", "ordinal"]).select("id", "item", F.col("spans.a").alias("starts"), F.col("spans.b").alias("ends"))
