"""SimHash near duplicates: a self-join of the binary trie of fingerprints.

Two nodes of the trie are walked together, their differing bits add up, and a
pair of nodes is dropped as soon as the sum exceeds the budget.  The top of the
trie is walked once on counts of prefixes; what survives there are units, pairs
of subtrees, each joined in a task of its own.  A unit hands on a spanning
forest of its links, so no link between different fingerprints is lost and a
group of copies never becomes all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, text
from .balance import attach

SHINGLE = 4
BUDGET = 4
TOP_BITS = 12
LEAF_ROWS = 16_384
LEAF_MOST = 1 << 20
LEAVES = 64
DIRECT = 100  # leaf pairs below which two nodes are compared at once
FRONTIER = 1 << 19
SLICE_BYTES = 2 << 20  # of text whose shingles are hashed at once


def fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each row: a bit is set if it is in over half of the row's shingle hashes.

    Shingles repeat as the text does.  A row of fewer words is one shingle, a
    row without words has fingerprint zero.
    """
    words = text.Words(column, text.SPACED)
    out = np.zeros(len(column), np.uint64)
    if not len(words):
        return out
    # one blank after each word: a shingle is then a run of bytes
    sizes = np.diff(words.offsets)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    spread = np.full(int(sizes.sum() + len(sizes)), 32, np.uint8)
    spread[np.arange(len(words.packed)) + np.repeat(np.arange(len(sizes)), sizes)] = words.packed
    ends = begins + sizes
    counts = np.diff(words.rows)
    per_row = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    starts = np.concatenate([[0], np.cumsum(per_row)])
    first = np.repeat(words.rows[:-1] - starts[:-1], per_row) + np.arange(starts[-1])
    last = first + np.repeat(np.minimum(counts, shingle), per_row) - 1
    data = spread.tobytes()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(data[a:b], 42) for a, b in zip(begins[first].tolist(), ends[last].tolist(), strict=True)], np.uint64)
    full = np.flatnonzero(per_row)
    for low in range(0, len(full), 4096):  # rows in runs, for a bounded bit matrix
        rows = full[low : low + 4096]
        out[rows] = _majority(hashes[starts[rows[0]] : starts[rows[-1] + 1]], starts[rows] - starts[rows[0]], per_row[rows])
    return out


def _majority(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ones = np.zeros((len(starts), 64), np.int64)
    step = 1 << 18
    for low in range(0, len(hashes), step):
        part = hashes[low : low + step]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        a, b = np.searchsorted(starts, low, "right") - 1, np.searchsorted(starts, low + len(part), "left")
        ones[a:b] += np.add.reduceat(bits, np.maximum(starts[a:b] - low, 0), axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > counts[:, None], axis=1)
    return packed.view(">u8").reshape(-1).astype(np.uint64)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id`` and ``fp`` (the fingerprint's bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, "body", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fingerprints(part.column("body"), shingle).view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, fp long")


Node = tuple[int, int]  # depth and prefix


def top_units(counts: dict[Node, int], budget: int = BUDGET) -> tuple[list[Node], list[tuple[int, int]]]:
    """The leaves of the top as (depth, prefix), and the pairs of them within budget.

    ``counts`` has the rows of every node of the top, down to the nodes that are
    taken whole; a node without any is not in it.
    """
    leaves: list[Node] = []
    pairs: list[tuple[int, int]] = []
    numbers: dict[Node, int] = {}

    def halves(node: Node) -> list[Node]:
        below = [(node[0] + 1, 2 * node[1]), (node[0] + 1, 2 * node[1] + 1)]
        return [x for x in below if x in counts] or [node]

    stack = [((0, 0), (0, 0))] if counts else []
    while stack:
        a, b = stack.pop()
        ways_a, ways_b = halves(a), halves(b)
        if ways_a == [a] and ways_b == [b]:
            for node in (a, b):
                if node not in numbers:
                    numbers[node] = len(leaves)
                    leaves.append(node)
            pairs.append((numbers[a], numbers[b]))
            continue
        for i, x in enumerate(ways_a):
            for j, y in enumerate(ways_b):
                if a == b and j < i:
                    continue
                depth = min(x[0], y[0])
                if ((x[1] >> (x[0] - depth)) ^ (y[1] >> (y[0] - depth))).bit_count() <= budget:
                    stack.append((x, y))
    return leaves, pairs


def top_counts(prints: DataFrame, leaf: int | None = None) -> dict[Node, int]:
    """Rows of each node of the trie's top, deep enough that none of its leaves has more than ``leaf``.

    Prefixes are counted some bits at a time, below the first level only where a
    node is too crowded, and no deeper than that calls for: what comes to the
    driver are some times as many nodes as rows divided by ``leaf``.
    """
    whole = prints.count()
    most = leaf or min(LEAF_MOST, max(LEAF_ROWS, whole // LEAVES))
    counts: dict[Node, int] = {(0, 0): whole} if whole else {}
    crowded, depth, bits = ([0] if whole > most else []), 0, TOP_BITS
    while crowded:
        inside = prints.filter(F.shiftrightunsigned("fp", 64 - depth).isin(crowded)) if depth else prints
        prefix = F.shiftrightunsigned("fp", 64 - depth - bits) if depth + bits < 64 else F.col("fp")
        found = inside.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n")).collect()
        level = {(depth + bits, int(p) & ((1 << (depth + bits)) - 1)): n for p, n in found}
        sums = dict(level)
        for d in range(depth + bits, depth + 1, -1):
            for (_, p), n in [(node, n) for node, n in sums.items() if node[0] == d]:
                sums[d - 1, p >> 1] = sums.get((d - 1, p >> 1), 0) + n
        # a node is there if what is above it is too crowded to be a leaf
        counts |= {(d, p): n for (d, p), n in sums.items() if d == depth + 1 or sums[d - 1, p >> 1] > most}
        depth += bits
        crowded = [p for (_, p), n in level.items() if n > most and depth < 64]
        if crowded:
            bits = min(TOP_BITS, 64 - depth, max(1, (max(level.values()) // most).bit_length() + 1))
    return counts


def trie_links(left: np.ndarray, right: np.ndarray | None, budget: int = BUDGET) -> np.ndarray:
    """A spanning forest (pairs of fingerprints) of the links within ``left``, or between ``left`` and ``right``.

    Both are sorted and distinct; a node is a range of them.  ``right`` None
    joins ``left`` with itself.
    """
    own = right is None
    other = left if own else right
    values = left if own else np.concatenate([left, other])
    shift = 0 if own else len(left)
    forest = components.Forest(len(values))
    stack = [(np.array([0]), np.array([len(left)]), np.array([0]), np.array([len(other)]), np.array([0]), 0)]
    while stack:
        la, lb, ra, rb, used, depth = stack.pop()
        if len(la) > FRONTIER:
            half = len(la) // 2
            stack.append((la[half:], lb[half:], ra[half:], rb[half:], used[half:], depth))
            stack.append((la[:half], lb[:half], ra[:half], rb[:half], used[:half], depth))
            continue
        small = ((lb - la) * (rb - ra) <= DIRECT) | (depth == 64)
        if small.any():
            _compare(left, other, la[small], lb[small], ra[small], rb[small], own, shift, forest, budget)
            la, lb, ra, rb, used = (x[~small] for x in (la, lb, ra, rb, used))
        if not len(la):
            continue
        lm, rm = _split(left, la, lb, depth), _split(other, ra, rb, depth)
        same = own & (la == ra) & (lb == rb)
        parts = [(la, lm, ra, rm, used, None), (lm, lb, rm, rb, used, None), (la, lm, rm, rb, used + 1, None), (lm, lb, ra, rm, used + 1, ~same)]
        ok = [((b > a) & (d > c) & (u <= budget) & (True if m is None else m)) for a, b, c, d, u, m in parts]
        stack.append((*(np.concatenate([p[k][o] for p, o in zip(parts, ok, strict=True)]) for k in range(5)), depth + 1))
    a, b = forest.edges()
    return np.stack([values[a], values[b]], axis=1) if len(a) else np.zeros((0, 2), np.uint64)


def _split(values: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Where bit ``depth`` (from the top) turns to one in each sorted range that shares the bits above."""
    bit = np.uint64(63 - depth)
    pivot = ((values[low] >> bit) | np.uint64(1)) << bit
    return np.clip(np.searchsorted(values, pivot), low, high)


def _compare(left, other, la, lb, ra, rb, own, shift, forest, budget) -> None:
    """All leaf pairs of small node pairs, in runs of bounded size."""
    sizes = (lb - la) * (rb - ra)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + (1 << 21), "right")))
        n = sizes[start:stop]
        which = np.repeat(np.arange(start, stop), n)
        at = np.arange(int(n.sum())) - np.repeat(ends[start:stop] - n - base, n)
        wide = (rb - ra)[which]
        i, j = la[which] + at // wide, ra[which] + at % wide
        near = np.bitwise_count(left[i] ^ other[j]) <= budget
        if own:
            near &= i < j
        forest.join(i[near], j[near] + shift)
        start = stop


def homes(values: np.ndarray, leaves: list[Node]) -> np.ndarray:
    """The leaf of each fingerprint; leaves are disjoint ranges that cover all of them."""
    lows = np.array([p << (64 - d) for d, p in leaves], np.uint64)
    order = np.argsort(lows)
    return order[np.searchsorted(lows[order], values, "right") - 1]


def links(prints: DataFrame, budget: int = BUDGET, leaf: int | None = None) -> DataFrame:
    """Edges (``a``, ``b``) between distinct fingerprints ``fp`` whose components are those of all links.

    Only counts by prefix reach the driver.  Each fingerprint is sent to the
    units of its subtree: a leaf has a ``LEAVES``-th of the rows, ``LEAF_MOST``
    at most, whatever their number and however crowded a prefix is.
    """
    leaves, pairs = top_units(top_counts(prints, leaf), budget)
    units: list[list[tuple[int, int]]] = [[] for _ in leaves]
    for unit, (a, b) in enumerate(pairs):
        units[a].append((unit, 0 if a == b else 1))
        if a != b:
            units[b].append((unit, 2))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            home = homes(values, leaves)
            order = np.argsort(home, kind="stable")
            values, home = values[order], home[order]
            edges = np.flatnonzero(np.diff(home, prepend=-1))
            rows = [(unit, side, values[a:b].tobytes()) for a, b in zip(edges, [*edges[1:], len(home)], strict=True) for unit, side in units[home[a]]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["unit", "side", "held"])

    def join(table: pa.Table) -> pa.Table:
        sides = table.column("side").to_numpy()
        held = table.column("held").to_pylist()
        take = lambda *want: np.unique(np.frombuffer(b"".join(h for h, s in zip(held, sides, strict=True) if s in want), np.uint64))
        found = trie_links(take(0), None, budget) if (sides == 0).any() else trie_links(take(1), take(2), budget)
        return pa.table({"a": found[:, 0].copy().view(np.int64), "b": found[:, 1].copy().view(np.int64)})

    return prints.mapInArrow(deal, "unit long, side int, held binary").groupBy("unit").applyInArrow(join, "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """``id``, ``fp`` and ``component_id`` of every row: the smallest id reachable over links.

    Null and empty texts share fingerprint zero and are linked like any other.
    A null id never is the smallest; rows are returned one for one, also those
    that repeat, and an empty table gives none.  Texts of any length are
    fingerprinted whole.
    """
    rows = components.settle(with_fingerprints(docs, id_col, text_col, shingle))
    prints = components.settle(rows.groupBy("fp").agg(F.min("id").alias("least")))
    edges = links(prints.select("fp"), budget)
    roots = components.roots(edges)
    named = components.settle(prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = attach(named.select("fp", "root"), least, ["root"]).select("fp", "component_id")
    return attach(rows, of_print, ["fp"]).select("id", "fp", "component_id")
