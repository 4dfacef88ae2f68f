"""Jump consistent hashing: keys to shards without a ring table.

A key's shard depends on the key and the number of shards alone.  With one
more shard, a key stays or moves into the new one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .balance import numbered, stored

MULTIPLIER = 2862933555777941757  # of the published jump-hash generator


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; all keys hop together until none is left."""
    if shards < 1:
        raise ValueError("at least one shard")
    keys = keys.astype(np.uint64, copy=True)
    last = np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    hop = np.zeros(len(keys), np.int64)
    with np.errstate(over="ignore"):
        while len(live):
            last[live] = hop
            keys[live] = keys[live] * np.uint64(MULTIPLIER) + np.uint64(1)
            step = float(1 << 31) / ((keys[live] >> np.uint64(33)).astype(np.float64) + 1)
            hop = ((last[live] + 1) * step).astype(np.int64)
            inside = hop < shards
            live, hop = live[inside], hop[inside]
    return last


def key_halves(key: Column) -> tuple[Column, Column]:
    """Two 32-bit halves of the stable key hash, the first 64 bits of the MD5 of the key's text (null: empty)."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")


def shard_of(high: Column, low: Column, shards: int) -> Column:
    """Shard number from the two halves of a key hash."""

    @F.pandas_udf("int")
    def place(high: pd.Series, low: pd.Series) -> pd.Series:
        keys = (high.to_numpy().astype(np.uint64) << np.uint64(32)) | low.to_numpy().astype(np.uint64)
        return pd.Series(jump(keys, shards).astype(np.int32))

    return place(high, low)


def assign(rows: DataFrame, key_col: str, shards: int, keep: list[Column]) -> DataFrame:
    """``keep`` columns plus ``shard``, ``grown_shard`` and the gapless ``slot`` in the shard.

    Slots follow the key hash, then the key, then the kept columns, so they are
    a stable shuffle of the shard.  All shards are numbered in one sort, whose
    ranges no shard and no key fills alone: rows that repeat a key, null ones
    too, share the shard and are told apart by their place in the written table.
    A null key hashes as an empty text; an empty table gives no rows.
    """
    high, low = key_halves(F.col(key_col))
    keyed = rows.select(F.struct(*keep).alias("kept"), F.col(key_col).alias("key"), high.alias("high"), low.alias("low"))
    placed = keyed.withColumn("shard", shard_of(F.col("high"), F.col("low"), shards)).withColumn("grown", shard_of(F.col("high"), F.col("low"), shards + 1))
    told = stored(placed.withColumn("apart", F.monotonically_increasing_id()), "shards")
    held = numbered(told, [F.col(c) for c in ("shard", "high", "low", "key", "kept", "apart")], "at")
    firsts = told.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))  # a row a shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = firsts.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return held.join(F.broadcast(starts), "shard").select("kept.*", "shard", (F.col("at") - F.col("start")).cast("long").alias("slot"), F.col("grown").alias("grown_shard"))
