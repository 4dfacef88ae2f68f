"""Connected components over edge tables, and reliable cuts of lineage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid.session import cut_lineage

from .balance import attach


def settle(df: DataFrame) -> DataFrame:
    """Write once to the shared checkpoint folder; later jobs read that."""
    return cut_lineage(df)


class Forest:
    """Disjoint sets over numbered nodes in memory; remembers the edges that joined two sets."""

    def __init__(self, nodes: int):
        self.parent = np.arange(nodes)
        self.kept: list[tuple[int, int]] = []

    def _tops(self, nodes: np.ndarray) -> np.ndarray:
        tops = self.parent[nodes]
        while True:
            up = self.parent[tops]
            if np.array_equal(up, tops):
                return tops
            tops = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link pairs; those already in one set cost one vector step."""
        while len(a):
            ta, tb = self._tops(a), self._tops(b)
            apart = ta != tb
            a, b, ta, tb = a[apart], b[apart], ta[apart], tb[apart]
            if not len(a):
                break
            low, high = np.minimum(ta, tb), np.maximum(ta, tb)
            # a root hangs below one other root per round, the least it meets
            order = np.lexsort((low, high))
            first = order[np.flatnonzero(np.diff(high[order], prepend=-1))]
            self.parent[high[first]] = low[first]
            self.kept.extend(zip(a[first].tolist(), b[first].tolist(), strict=True))
        self.parent = self.parent[self.parent]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.array(self.kept, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def roots(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of the edges.

    Alternates two steps until nothing changes: each node points all its larger
    neighbours to its smallest one, then its smaller ones.  Rounds grow with
    the logarithm of the longest path; every round is written to the shared folder.
    """
    pair = lambda x, y: F.struct(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    held = settle(edges.filter(F.col(a) != F.col(b)).select(pair(F.col(a), F.col(b)).alias("e")).select("e.*").distinct())
    before = None
    while True:
        both = held.select("u", "v").unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = attach(both, least, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        held = settle(small.filter("u > v").distinct())
        now = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return held.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
