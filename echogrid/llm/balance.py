"""Joins, numbering and stored tables that stay balanced whatever the keys hold."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.session import cut_lineage, shared_dir

HEAVY = 1_000  # a key is heavy from this fraction of the rows on, so there are at most that many


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: later jobs, and retries after a lost executor, start from the files."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def attach(many: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """Join values per key (one row a key) onto many rows a key, inner or left.

    Keys that hold a ``HEAVY``-th of the rows or more are at most ``HEAVY``, so
    their values are broadcast and their rows stay where they are; all others
    are shuffled, none with more than that share.  ``many`` is read once more to
    count its keys, so it should be a table or come cheaply from one, unless
    ``counted`` has the keys that can be heavy with their rows as ``_n``.  A null
    key meets nothing.
    """
    held = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if counted is None else counted
    total = held.agg(F.sum("_n").alias("_all"))
    heavy = cut_lineage(held.join(F.broadcast(total), F.col("_n") * HEAVY >= F.col("_all")).select(*[F.col(k).alias(f"_{k}") for k in keys]))
    if heavy.isEmpty():
        return many.join(per_key, list(keys), how)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    busy, rest = many.join(F.broadcast(heavy), same, "left_semi"), many.join(F.broadcast(heavy), same, "left_anti")
    values = F.broadcast(per_key.join(F.broadcast(heavy), same, "left_semi"))
    return busy.join(values, list(keys), how).unionByName(rest.join(per_key, list(keys), how))


def numbered(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with a gapless ``name`` from 0 in the given order.

    The sort cuts the rows into ranges; a row's number is its place in its range
    plus the sizes of the ranges before, of which there are as many as shuffle
    partitions.  Rows that are equal in ``order`` stay in one range: give it a
    last column that tells them apart.
    """
    placed = stored(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    return placed.withColumn("_part", part).join(starts, "_part").withColumn(name, F.col("_start") + place).drop("_part", "_start", "_at")
