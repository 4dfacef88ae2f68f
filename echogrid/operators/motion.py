"""Motion between consecutive frames: block matching, tracking, cleaning, densifying.

Work that touches cells runs on tile groups; a frame's vectors are bounded by
the feature limit, so per-frame vector steps stay small.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.grid import coarse_size
from .skew import attach_by_key
from .nearest import nearest_points
from .neighbourhood import byte_levels
from .tiles import (
    DEFAULT_TILE, Window, cogrouped, column_array, double_field, frame_tiles, geometry, int_field, map_tiles_with, window_of, with_halo, with_keys,
)
from .warp import coarse_nodes, lead_differences, moved_cells, replicate_sample, resize_positions

# Outlier, declustering and interpolation defaults.
OUTLIER_STD = 3.0
OUTLIER_NEIGHBOURS = 30
DECLUSTER_SCALE = 20
IDW_NEIGHBOURS = 20
IDW_POWER = 0.5
IDW_OFFSET = 0.5

SEARCH_RADIUS = 10
COARSE = 4  # cells a side of the squares whose means are the bottom of the pyramid
COARSE_HALF = 4
WINDOW_HALF = 7
REFINE_STEPS = 5
MIN_EIGENVALUE = 1e-4
MISMATCH = 1.0  # mean squared difference of a match, as a share of the patch's variance, from which on it explains nothing


def frame_pairs(levels: DataFrame, order: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Put each frame beside its successor: columns ``prev`` and ``next`` per cell.

    ``order`` maps (keys, frame ``seq``) to ``pair`` ids in which the frame is
    first or second.  A frame joins at most two pairs, so each cell is copied at
    most twice and then met by one aggregate, without a self-join.
    """
    roles = order.select(
        *keys, F.explode(F.array(
            F.struct(F.col("first_seq").alias(seq), "pair", F.lit(True).alias("is_prev")),
            F.struct(F.col("second_seq").alias(seq), "pair", F.lit(False).alias("is_prev")),
        )).alias("_role"),
    )
    per_frame = roles.groupBy(*keys, F.col(f"_role.{seq}").alias(seq)).agg(F.collect_set(F.struct("_role.pair", "_role.is_prev")).alias("_roles"))
    routed = attach_by_key(levels.select(*keys, seq, "row", "col", "level", "valid"), per_frame, [*keys, seq], ["row", "col"])
    copies = routed.withColumn("_as", F.explode("_roles"))
    is_prev = F.col("_as.is_prev")
    return copies.groupBy(*keys, F.col("_as.pair").alias("pair"), "row", "col").agg(
        F.max(F.when(is_prev, F.col("level"))).alias("prev"),
        F.max(F.when(~is_prev, F.col("level"))).alias("next"),
        F.max(F.when(is_prev, F.col("valid"))).alias("prev_valid"),
    )


def _clamped(array: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    return array[np.clip(rows, 0, array.shape[0] - 1), np.clip(cols, 0, array.shape[1] - 1)]


def block_match(
    pairs: DataFrame, keys: Sequence[str], height: int, width: int, block: int, radius: int, tile: int = DEFAULT_TILE, frames: DataFrame | None = None
) -> DataFrame:
    """Best integer displacement of each ``block`` x ``block`` square of every pair.

    Minimises the mean squared difference over the cells whose displaced
    position stays in the grid; ties go to the shortest, then to the smallest
    (dr, dc).  ``tile`` must be a multiple of ``block``.  ``frames`` lists the
    pairs; without it they are read from the cells, which computes those twice.
    """
    if tile % block:
        raise ValueError("tile must be a multiple of block")
    moves = [(dr, dc) for dr in range(-radius, radius + 1) for dc in range(-radius, radius + 1)]
    moves.sort(key=lambda move: (move[0] ** 2 + move[1] ** 2, move))

    def fn(window: Window, table: pa.Table, known: dict) -> dict[str, np.ndarray]:
        row, col = column_array(table, "row"), column_array(table, "col")
        prev = window.dense(row, col, np.nan_to_num(column_array(table, "prev")), fill=0.0)
        nxt = window.dense(row, col, np.nan_to_num(column_array(table, "next")), fill=0.0)
        rows, cols = np.arange(window.r0, window.r1), np.arange(window.c0, window.c1)
        here = window.core(prev)
        starts_r = np.arange(0, len(rows), block)
        starts_c = np.arange(0, len(cols), block)
        cost = np.full((len(starts_r), len(starts_c)), np.inf)
        best_r = np.zeros(cost.shape, dtype=np.int32)
        best_c = np.zeros(cost.shape, dtype=np.int32)
        blocks = lambda a: np.add.reduceat(np.add.reduceat(a, starts_r, axis=0), starts_c, axis=1)
        for dr, dc in moves:
            rr, cc = rows + dr, cols + dc
            inside = np.outer((rr >= 0) & (rr < window.height), (cc >= 0) & (cc < window.width))
            moved = _clamped(nxt, *np.meshgrid(rr - window.top, cc - window.left, indexing="ij"))
            total = blocks(np.where(inside, (here - moved) ** 2, 0.0))
            count = blocks(inside.astype(np.float64))
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = np.where(count > 0, total / count, np.inf)
            better = mean < cost
            cost, best_r, best_c = np.where(better, mean, cost), np.where(better, dr, best_r), np.where(better, dc, best_c)
        br, bc = np.meshgrid((window.r0 + starts_r) // block, (window.c0 + starts_c) // block, indexing="ij")
        return {"block_r": br.ravel(), "block_c": bc.ravel(), "dr": best_r.ravel(), "dc": best_c.ravel(), "cost": cost.ravel()}

    tiled = with_halo(pairs.select(*keys, "row", "col", "prev", "next"), tile, radius, height, width)
    fields = [int_field("block_r"), int_field("block_c"), int_field("dr"), int_field("dc"), double_field("cost")]
    listed = (pairs if frames is None else frames).select(*keys).distinct()
    return map_tiles_with(tiled, listed, keys, tile, fn, fields, height, width, radius, empty_tiles=True)


def _bilinear(array: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sample at fractional positions; positions are clamped to the array."""
    y = np.clip(y, 0, array.shape[0] - 1)
    x = np.clip(x, 0, array.shape[1] - 1)
    y0, x0 = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
    fy, fx = y - y0, x - x0
    y1, x1 = np.minimum(y0 + 1, array.shape[0] - 1), np.minimum(x0 + 1, array.shape[1] - 1)
    upper = array[y0, x0] * (1 - fx) + array[y0, x1] * fx
    lower = array[y1, x0] * (1 - fx) + array[y1, x1] * fx
    return upper * (1 - fy) + lower * fy


def _halved(array: np.ndarray, top: int, left: int) -> np.ndarray:
    """Means of 2 x 2 cells that begin on even rows and columns of the whole grid; edges are repeated."""
    pad = [(start % 2, (size + start % 2) % 2) for start, size in zip((top, left), array.shape, strict=True)]
    even = np.pad(array, pad, mode="edge")
    return even.reshape(even.shape[0] // 2, 2, even.shape[1] // 2, 2).mean(axis=(1, 3))


def _patches(image: np.ndarray, r: np.ndarray, c: np.ndarray, half: int) -> np.ndarray:
    span = np.arange(-half, half + 1)
    return _clamped(image, r[:, None, None] + span[None, :, None], c[:, None, None] + span[None, None, :])


def _search(patch: np.ndarray, nxt: np.ndarray, r: np.ndarray, c: np.ndarray, start_r: np.ndarray, start_c: np.ndarray, radius: int, half: int):
    """Displacement of least mean squared difference from the patch within ``radius`` of the start; the shortest step wins a tie."""
    best = np.full(len(r), np.inf)
    dr, dc = start_r.copy(), start_c.copy()
    moves = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]
    for a, b in sorted(moves, key=lambda move: (move[0] ** 2 + move[1] ** 2, move)):
        cost = ((patch - _patches(nxt, r + start_r + a, c + start_c + b, half)) ** 2).mean(axis=(1, 2))
        better = cost < best
        best, dr, dc = np.where(better, cost, best), np.where(better, start_r + a, dr), np.where(better, start_c + b, dc)
    return dr, dc, best


def pyramid_depth(height: int, width: int, radius: int, block: int) -> int:
    """Halvings of an image of ``block`` x ``block`` means until a search of ``radius`` reaches across the grid."""
    depth = 0
    while radius * block << depth < max(height, width):
        depth += 1
    return depth


def coarse_starts(prev: np.ndarray, nxt: np.ndarray, r: np.ndarray, c: np.ndarray, depth: int, radius: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Displacement of each feature over whole images: searched on every halving and followed down, the best match at the bottom."""
    images = [(prev, nxt)]
    for _ in range(depth):
        images.append(tuple(_halved(image, 0, 0) for image in images[-1]))
    best = np.full(len(r), np.inf)
    dr = dc = np.zeros(len(r), np.int64)
    for top in range(depth + 1):
        far_r = far_c = np.zeros(len(r), np.int64)
        for level in range(top, -1, -1):
            a, b = images[level]
            far_r, far_c, cost = _search(_patches(a, r >> level, c >> level, half), b, r >> level, c >> level, 2 * far_r, 2 * far_c, radius if level == top else 2, half)
        better = cost < best
        best, dr, dc = np.where(better, cost, best), np.where(better, far_r, dr), np.where(better, far_c, dc)
    return dr, dc


def _gradients(wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Central differences (down, right) of patches that have one cell more on each side."""
    return (wide[:, 2:, 1:-1] - wide[:, :-2, 1:-1]) / 2, (wide[:, 1:-1, 2:] - wide[:, 1:-1, :-2]) / 2


def _trackable(wide: np.ndarray) -> np.ndarray:
    """Whether a patch changes in both directions, so that its match is one place."""
    gy, gx = _gradients(wide)
    xx, xy, yy = (gx * gx).sum((1, 2)), (gx * gy).sum((1, 2)), (gy * gy).sum((1, 2))
    smaller = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy**2)
    return smaller / gx[0].size > MIN_EIGENVALUE if len(wide) else np.zeros(0, dtype=bool)


def _refined(wide: np.ndarray, nxt: np.ndarray, r: np.ndarray, c: np.ndarray, dr: np.ndarray, dc: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Fractions of a cell by Gauss-Newton steps from an integer match; a solution that leaves its neighbourhood is not taken."""
    span = np.arange(-half, half + 1)
    wr, wc = r[:, None, None] + span[None, :, None], c[:, None, None] + span[None, None, :]
    gy, gx = _gradients(wide)
    xx, xy, yy = (gx * gx).sum((1, 2)), (gx * gy).sum((1, 2)), (gy * gy).sum((1, 2))
    det = xx * yy - xy * xy
    safe = np.where(det > 0, det, 1.0)
    fine_r, fine_c = dr.astype(float), dc.astype(float)
    for _ in range(REFINE_STEPS):
        diff = wide[:, 1:-1, 1:-1] - _bilinear(nxt, wr + fine_r[:, None, None], wc + fine_c[:, None, None])
        bx, by = (gx * diff).sum((1, 2)), (gy * diff).sum((1, 2))
        fine_c = np.where(det > 0, fine_c + (yy * bx - xy * by) / safe, fine_c)
        fine_r = np.where(det > 0, fine_r + (xx * by - xy * bx) / safe, fine_r)
    far = (np.abs(fine_r - dr) > 2) | (np.abs(fine_c - dc) > 2)
    return np.where(far, dr, fine_r), np.where(far, dc, fine_c)


def _levels(table: pa.Table, mine: np.ndarray, known: dict, role: int) -> np.ndarray:
    """Values of one image as byte levels; they are levels already if the frame has no range."""
    value = column_array(table, "value")[mine]
    low = known.get(f"low{role}")
    return np.nan_to_num(value) if low is None else byte_levels(value, low, known[f"high{role}"])


def _image(window: Window, table: pa.Table, known: dict, role: int) -> np.ndarray:
    mine = column_array(table, "role") == role
    row, col = column_array(table, "row")[mine], column_array(table, "col")[mine]
    return window.dense(row, col, _levels(table, mine, known, role), fill=0.0)


def matched_features(
    images: DataFrame, features: DataFrame, per_pair: DataFrame, keys: Sequence[str], height, width,
    radius: int, half: int, tile: int, coarse: bool = True,
) -> DataFrame:
    """Sparse vectors ``x, y, u, v`` of ``features`` (keys, row, col) between the images of each pair.

    ``images`` has (keys, role, row, col, value) with role 0 before and 1 after;
    ``per_pair`` one row per pair, with ``refine`` and, unless values are byte
    levels, the range of both frames.  Three steps, none of which sees a whole
    fine image: means of 4 x 4 cells of a pair meet in one group, where a pyramid
    as deep as the grid asks for gives each feature a start; the feature's tile
    cuts its patch; the patch travels to the tiles where it may lie, at its own
    place and at its start, and is matched there.  The better match counts; one
    that explains nothing of the patch is not found and is dropped.
    """
    names = list(keys)
    sized = per_pair.withColumns(geometry(height, width, 0)).drop("reach")
    marks = features.select(*names, "row", "col")
    if coarse:
        marks = _with_starts(images, marks, sized, names, radius)
    else:
        marks = marks.withColumns({"start_r": F.lit(0), "start_c": F.lit(0)})

    def cut(window: Window, table: pa.Table, known: dict) -> dict[str, np.ndarray]:
        row, col = column_array(table, "row"), column_array(table, "col")
        chosen = np.flatnonzero((column_array(table, "role") == 2) & window.is_core(row, col))
        chosen = chosen[np.lexsort((col[chosen], row[chosen]))]
        wide = _patches(_image(window, table, known, 0), row[chosen] - window.top, col[chosen] - window.left, half + 1)
        good = _trackable(wide)
        chosen, wide = chosen[good], wide[good]
        return {
            "from_r": row[chosen], "from_c": col[chosen], "start_r": column_array(table, "start_r")[chosen].astype(np.int64), "start_c": column_array(table, "start_c")[chosen].astype(np.int64),
            "patch": list(wide.reshape(len(chosen), (2 * half + 3) ** 2)), "spread": wide[:, 1:-1, 1:-1].var(axis=(1, 2)),
        }

    before = images.where(F.col("role") == 0).unionByName(marks.withColumns({"role": F.lit(2), "value": F.lit(0.0)}), allowMissingColumns=True)
    tiled = with_halo(before, tile, half + 1, height, width)
    fields = [*[int_field(name) for name in ("from_r", "from_c", "start_r", "start_c")], T.StructField("patch", T.ArrayType(T.DoubleType())), double_field("spread")]
    patches = map_tiles_with(tiled, sized.drop("grid_h", "grid_w"), names, tile, cut, fields, height, width, half + 1)

    start = lambda r, c: F.struct(r.alias("start_r"), c.alias("start_c"))
    own, far = start(F.lit(0), F.lit(0)), start(F.col("start_r"), F.col("start_c"))
    tried = patches.withColumn("_s", F.explode(F.when((F.col("start_r") == 0) & (F.col("start_c") == 0), F.array(own)).otherwise(F.array(own, far))))
    inside = lambda at, size: F.greatest(F.lit(0), F.least(at, (size if isinstance(size, Column) else F.lit(size)) - 1)).cast("int")
    asked = tried.select(
        *names, F.lit(2).alias("role"), inside(F.col("from_r") + F.col("_s.start_r"), height).alias("row"), inside(F.col("from_c") + F.col("_s.start_c"), width).alias("col"),
        "from_r", "from_c", "_s.start_r", "_s.start_c", "patch", "spread",
    )

    def match(window: Window, table: pa.Table, known: dict) -> dict[str, np.ndarray]:
        row, col = column_array(table, "row"), column_array(table, "col")
        chosen = np.flatnonzero((column_array(table, "role") == 2) & window.is_core(row, col))
        if not len(chosen):
            return {field.name: np.array([]) for field in found}
        from_r, from_c, start_r, start_c = (column_array(table, name)[chosen].astype(np.int64) for name in ("from_r", "from_c", "start_r", "start_c"))
        wide = table.column("patch").combine_chunks().take(pa.array(chosen)).flatten().to_numpy().reshape(len(chosen), 2 * half + 3, 2 * half + 3)
        nxt = _image(window, table, known, 1)
        r, c = from_r - window.top, from_c - window.left
        dr, dc, cost = _search(wide[:, 1:-1, 1:-1], nxt, r, c, start_r, start_c, radius, half)
        fine_r, fine_c = _refined(wide, nxt, r, c, dr, dc, half) if known["refine"] else (dr.astype(float), dc.astype(float))
        return {"from_r": from_r, "from_c": from_c, "cost": cost, "far": np.abs(start_r) + np.abs(start_c), "dr": fine_r, "dc": fine_c, "spread": column_array(table, "spread")[chosen]}

    found = [int_field("from_r"), int_field("from_c"), double_field("cost"), int_field("far"), double_field("dr"), double_field("dc"), double_field("spread")]
    reach = half + radius + 3
    after = images.where(F.col("role") == 1).unionByName(asked, allowMissingColumns=True)
    matches = map_tiles_with(with_halo(after, tile, reach, height, width), sized.drop("grid_h", "grid_w"), names, tile, match, found, height, width, reach)
    best = matches.groupBy(*names, "from_r", "from_c").agg(F.min(F.struct("cost", "far", "dr", "dc", "spread")).alias("_b"))
    kept = best.where(F.col("_b.cost") <= MISMATCH * F.col("_b.spread"))
    return kept.select(*names, F.col("from_c").cast("double").alias("x"), F.col("from_r").cast("double").alias("y"), F.col("_b.dc").alias("u"), F.col("_b.dr").alias("v"))


def _with_starts(images: DataFrame, marks: DataFrame, sized: DataFrame, names: list[str], radius: int) -> DataFrame:
    """``marks`` with ``start_r, start_c``, the displacement that a pair's coarse images give, in one group a pair of a sixteenth of its cells."""
    square = lambda name: F.floor(F.col(name) / COARSE).cast("int").alias(name)
    means = images.groupBy(*names, "role", square("row"), square("col")).agg(F.sum("value").alias("value"), F.count("value").alias("n"))
    rows = means.unionByName(marks.withColumns({"role": F.lit(2), "value": F.lit(0.0), "n": F.lit(0).cast("long")}))
    schema = T.StructType([*(marks.schema[name] for name in names), *[int_field(name) for name in ("row", "col", "start_r", "start_c")]])
    arrow = to_arrow_schema(schema)

    def run(group_key: tuple[pa.Scalar, ...], table: pa.Table, side: pa.Table) -> pa.Table:
        role = column_array(table, "role")
        row, col = (column_array(table, name)[role == 2] for name in ("row", "col"))
        if not len(row) or not side.num_rows:
            return arrow.empty_table()
        known = {name: side.column(name)[0].as_py() for name in side.schema.names}
        height, width = known["grid_h"], known["grid_w"]

        def image(part: int) -> np.ndarray:
            out, mine = np.zeros((-(-height // COARSE), -(-width // COARSE))), role == part
            total, low = column_array(table, "value")[mine], known.get(f"low{part}")
            if low is not None:
                span = known[f"high{part}"] - low
                total = (total - column_array(table, "n")[mine] * low) * (255 / span if span > 1e-8 else 1.0)
            out[column_array(table, "row")[mine], column_array(table, "col")[mine]] = total / COARSE**2
            return out

        depth = pyramid_depth(height, width, radius, COARSE)
        dr, dc = coarse_starts(image(0), image(1), row // COARSE, col // COARSE, depth, radius, COARSE_HALF)
        return with_keys(arrow, names, group_key, {"row": row, "col": col, "start_r": COARSE * dr, "start_c": COARSE * dc})

    return cogrouped(rows, sized, names).applyInArrow(run, schema)


def track_features(
    pairs: DataFrame,
    features: DataFrame,
    keys: Sequence[str],
    height,
    width,
    radius: int = SEARCH_RADIUS,
    half: int = WINDOW_HALF,
    refine: bool = True,
    tile: int = DEFAULT_TILE,
    coarse: bool = True,
    frames: DataFrame | None = None,
) -> DataFrame:
    """Sparse vectors ``x, y, u, v`` (columns and rows per frame step) of the features.

    ``features`` holds (keys, row, col) with keys ending in the pair, ``pairs``
    the byte levels ``prev`` and ``next``.  ``refine=False`` keeps the integer
    match, ``coarse=False`` looks no farther than ``radius``.  ``frames`` lists
    the pairs; without it they are read from the features.
    """
    both = F.array(F.struct(F.lit(0).alias("role"), F.col("prev").alias("value")), F.struct(F.lit(1).alias("role"), F.col("next").alias("value")))
    images = pairs.select(*keys, "row", "col", F.explode(both).alias("_i")).select(*keys, "_i.role", "row", "col", F.col("_i.value").cast("double").alias("value"))
    listed = (features if frames is None else frames).select(*keys).distinct()
    return matched_features(images.where("value IS NOT NULL"), features, listed.withColumn("refine", F.lit(refine)), keys, height, width, radius, half, tile, coarse)


def track_frames(
    opened: DataFrame,
    ranges: DataFrame,
    features: DataFrame,
    keys: Sequence[str],
    height,
    width,
    refine: Column,
    radius: int = SEARCH_RADIUS,
    half: int = WINDOW_HALF,
    tile: int = DEFAULT_TILE,
) -> DataFrame:
    """Sparse vectors between neighbouring frames of a history.

    ``opened`` has (keys, pos, last, row, col, value) with frames numbered
    ``pos`` = 1..``last``; pair p joins frames p and p + 1.  A frame's part in
    its pairs follows from its number, so frames meet without a join.  ``ranges``
    and ``features`` are keyed by (keys, pos).  Height and width may be columns
    among the keys; ``refine`` is a column over the ranges.
    """
    before = F.when(F.col("pos") < F.col("last"), F.struct(F.col("pos").alias("pair"), F.lit(0).alias("role")))
    after = F.when(F.col("pos") > 1, F.struct((F.col("pos") - 1).alias("pair"), F.lit(1).alias("role")))
    roles = F.explode(F.filter(F.array(before, after), lambda part: part.isNotNull()))
    images = opened.withColumn("_p", roles).select(*keys, F.col("_p.pair").alias("pair"), F.col("_p.role").alias("role"), "row", "col", "value")
    marks = features.select(*keys, F.col("pos").alias("pair"), "row", "col")
    pair_keys = [*keys, "pair"]
    spans = ranges.withColumns({"_p": roles, "refine": refine}).select(*keys, F.col("_p.pair").alias("pair"), F.col("_p.role").alias("role"), "low", "high", "refine")
    pick = lambda role, name: F.max(F.when(F.col("role") == role, F.col(name)))
    known_ranges = (
        spans.groupBy(*pair_keys)
        .agg(pick(0, "low").alias("low0"), pick(0, "high").alias("high0"), pick(1, "low").alias("low1"), pick(1, "high").alias("high1"), F.max("refine").alias("refine"))
        .where(F.col("low0").isNotNull() & F.col("low1").isNotNull())
    )
    return matched_features(images, marks, known_ranges, pair_keys, height, width, radius, half, tile)


def drop_outliers(vectors: DataFrame, keys: Sequence[str], std: float = OUTLIER_STD, neighbours: int = OUTLIER_NEIGHBOURS) -> DataFrame:
    """Drop vectors further than ``std`` deviations from their nearest neighbours.

    Distance is Mahalanobis with the neighbours' covariance.  Groups hold one
    frame set's vectors, bounded by the feature limit times the frame pairs.
    """
    names = list(keys)
    schema = T.StructType([*(vectors.schema[key] for key in names), *[double_field(name) for name in ("x", "y", "u", "v")]])
    arrow = to_arrow_schema(schema)

    def run(group_key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x, y, u, v = (column_array(table, name) for name in ("x", "y", "u", "v"))
        order = np.lexsort((v, u, x, y))
        x, y, u, v = x[order], y[order], u[order], v[order]
        keep = np.ones(len(x), dtype=bool)
        data = np.stack([u, v], axis=1)
        k = min(neighbours + 1, len(x))
        if k > 3:
            around = nearest_points(x, y, x, y, k - 1, np.arange(len(x)))
            for start in range(0, len(x), 4096):
                keep[start : start + 4096] = _close_to_neighbours(data, np.arange(start, min(start + 4096, len(x))), around[start : start + 4096], std)
        return with_keys(arrow, names, group_key, {"x": x[keep], "y": y[keep], "u": u[keep], "v": v[keep]})

    return vectors.groupBy(*names).applyInArrow(run, schema)


def _close_to_neighbours(data: np.ndarray, at: np.ndarray, near: np.ndarray, std: float) -> np.ndarray:
    """Whether the vectors ``at`` lie within ``std`` deviations of their nearest others."""
    around, count = data[near], near.shape[1]
    delta = data[at] - around.mean(axis=1)
    off = around - around.mean(axis=1, keepdims=True)
    covariance = np.einsum("npi,npj->nij", off, off) / (count - 1)
    a, b, c = covariance[:, 0, 0], covariance[:, 0, 1], covariance[:, 1, 1]
    det = a * c - b * b
    with np.errstate(divide="ignore", invalid="ignore"):
        distance = np.sqrt((c * delta[:, 0] ** 2 - 2 * b * delta[:, 0] * delta[:, 1] + a * delta[:, 1] ** 2) / det)
    spread = np.sqrt(np.maximum(np.stack([a, c], axis=1), 0.0))
    return np.where(det > 1e-12, distance <= std, np.all(np.abs(delta) <= std * spread + 1e-9, axis=1))


def decluster(vectors: DataFrame, keys: Sequence[str], scale: int = DECLUSTER_SCALE) -> DataFrame:
    """One median vector per ``scale`` x ``scale`` square."""
    by_square = vectors.groupBy(*keys, F.floor(F.col("x") / scale).alias("_cx"), F.floor(F.col("y") / scale).alias("_cy"))
    return by_square.agg(
        F.median("x").alias("x"), F.median("y").alias("y"), F.median("u").alias("u"), F.median("v").alias("v")
    ).drop("_cx", "_cy")


def pack_vectors(vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per frame set, its vectors as one sorted array.

    The array is bounded: at most the feature limit times the frame pairs
    before declustering, one per square after it.
    """
    packed = F.array_sort(F.collect_list(F.struct("x", "y", "u", "v")))
    return vectors.groupBy(*keys).agg(packed.alias("vectors"))


def idw_values(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, data: np.ndarray, mean_res: float, k: int = IDW_NEIGHBOURS, power: float = IDW_POWER, offset: float = IDW_OFFSET) -> np.ndarray:
    """Inverse-distance values at (x, y) from the nearest points; equal distances keep the point order."""
    if len(px) == 1 or data.max() == data.min():
        return np.broadcast_to(data[0], (len(x), data.shape[1])).copy()
    near = nearest_points(px, py, x, y, k)
    out = np.empty((len(x), data.shape[1]))
    for start in range(0, len(x), 4096):
        part = slice(start, start + 4096)
        own = near[part]
        distance = np.sqrt((x[part, None] - px[own]) ** 2 + (y[part, None] - py[own]) ** 2)
        weight = (distance / mean_res + offset) ** -power
        out[part] = (weight[:, :, None] * data[own]).sum(axis=1) / weight.sum(axis=1, keepdims=True)
    return out


def grid_tiles(grids: DataFrame, tile: int, height: Column, width: Column) -> DataFrame:
    """One row per tile of each grid, spread over the session's shuffle width."""
    parts = int(grids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = lambda size: F.floor((size - 1) / F.lit(tile)).cast("int")
    tiles = grids.withColumn("tile_r", F.explode(F.sequence(F.lit(0), last(height))))
    tiles = tiles.withColumn("tile_c", F.explode(F.sequence(F.lit(0), last(width))))
    return tiles.repartition(parts)


def idw_grid(
    grids: DataFrame, vectors: DataFrame, keys: Sequence[str], step: int = 1, upscale: bool = False, tile: int = DEFAULT_TILE
) -> DataFrame:
    """Velocity by inverse distance to the nearest vectors, at every ``step``-th cell.

    ``grids`` has one row per frame set with ``height`` and ``width``.  Tiles
    meet their frame's packed vectors by key and are filled task-locally, so no
    cell is shuffled.  Frame sets without vectors get zero motion.  Coarse node
    (i, j) sits at (i * step, j * step).  The result holds the coarse nodes, or
    with ``upscale`` every full cell, resized from the nodes its tile needs.
    """
    names = list(keys)
    coarse_h, coarse_w = coarse_size(F.col("height"), F.lit(step)), coarse_size(F.col("width"), F.lit(step))
    sized = grids.select(*names, "height", "width", coarse_h.alias("coarse_h"), coarse_w.alias("coarse_w"))
    edge = ("height", "width") if upscale else ("coarse_h", "coarse_w")
    tiles = grid_tiles(sized, tile, F.col(edge[0]), F.col(edge[1])).join(pack_vectors(vectors, names), names, "left")
    schema = T.StructType([*(sized.schema[key] for key in names), int_field("row"), int_field("col"), double_field("u"), double_field("v")])
    arrow = to_arrow_schema(schema)

    def nodes(rows: np.ndarray, cols: np.ndarray, packed: list | None) -> np.ndarray:
        r, c = (part.ravel() for part in np.meshgrid(rows, cols, indexing="ij"))
        if not packed:
            return np.zeros((len(rows), len(cols), 2))
        points = np.array([(p["x"], p["y"], p["u"], p["v"]) for p in packed])
        uv = idw_values(c * float(step), r * float(step), points[:, 0], points[:, 1], points[:, 2:], float(step))
        return uv.reshape(len(rows), len(cols), 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                line = {name: batch.column(name)[i] for name in batch.schema.names}
                packed = line["vectors"].as_py()
                top, left = line["tile_r"].as_py() * tile, line["tile_c"].as_py() * tile
                h, w = line[edge[0]].as_py(), line[edge[1]].as_py()
                rows, cols = np.arange(top, min(top + tile, h)), np.arange(left, min(left + tile, w))
                if upscale:
                    ch, cw = line["coarse_h"].as_py(), line["coarse_w"].as_py()
                    r0, r1 = coarse_nodes(rows[0], rows[-1], h, ch)
                    c0, c1 = coarse_nodes(cols[0], cols[-1], w, cw)
                    coarse = nodes(np.arange(r0, r1 + 1), np.arange(c0, c1 + 1), packed)
                    y, x = np.meshgrid(resize_positions(rows, ch, h), resize_positions(cols, cw, w), indexing="ij")
                    u, v = (replicate_sample(coarse[:, :, part], y, x, ch, cw, r0, c0) for part in (0, 1))
                else:
                    uv = nodes(rows, cols, packed)
                    u, v = uv[:, :, 0], uv[:, :, 1]
                r, c = (part.ravel() for part in np.meshgrid(rows, cols, indexing="ij"))
                keyed = [line[name] for name in names]
                yield from with_keys(arrow, names, keyed, {"row": r, "col": c, "u": u.ravel(), "v": v.ravel()}).to_batches()

    return tiles.mapInArrow(run, schema)


def zero_motion(grids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """No vectors at all: persistence."""
    return grids.select(*keys, *[F.lit(None).cast("double").alias(name) for name in ("x", "y", "u", "v")]).where(F.lit(False))


# Motion methods a forecast may name: whether matches are refined; None is no motion.
MOTION_METHODS: dict[str, bool | None] = {"lucas_kanade": True, "block_match": False, "zero": None}


def extrapolate_vectors(
    values: DataFrame,
    vectors: DataFrame,
    frames: DataFrame,
    keys: Sequence[str],
    leads: Sequence[float] | Column,
    height: int | Column,
    width: int | Column,
    motion_step: int | Column = 2,
    grid_step: int | Column = 2,
    tile: int = DEFAULT_TILE,
) -> DataFrame:
    """Extrapolation with velocities interpolated from vectors where they are used.

    Gives what ``extrapolate(values, idw_grid(vectors, upscale=True))`` gives.
    Each tile receives its frame's vectors (bounded, see :func:`pack_vectors`)
    and fills the velocities of its region itself, so no velocity is ever
    shuffled.  ``frames`` lists the frame sets; those without vectors stand still.
    Leads (ascending), grid and steps may be columns of ``frames``, so frame sets
    of many grids and lead lists share one plan.  Interpolated velocities are
    averages of vectors, so the fastest vector bounds the travel and with it the
    halo.  Both small sides should be written or checkpointed before, as they
    are read more than once.
    """
    names = list(keys)
    if not isinstance(leads, Column):
        lead_differences(list(leads))
        leads = F.array(*[F.lit(float(lead)) for lead in leads])
    as_column = lambda value: value if isinstance(value, Column) else F.lit(value)
    settings = {"_leads": leads.cast("array<double>"), "_motion": as_column(motion_step).cast("int"), "_step": as_column(grid_step).cast("int")}
    fastest = vectors.groupBy(*names).agg(F.max(F.greatest(F.abs("u"), F.abs("v"))).alias("speed"))
    listed = frames.withColumns(settings | geometry(height, width, 0)).select(*names, *settings, "grid_h", "grid_w")
    packed = listed.join(fastest, names, "left").join(pack_vectors(vectors, names), names, "left")
    farthest = F.coalesce(F.col("speed"), F.lit(0.0)) * F.coalesce(F.try_element_at("_leads", F.lit(-1)), F.lit(0.0))
    known = packed.withColumn("reach", F.ceil(farthest).cast("int") + 4 * F.greatest("_step", "_motion") + 2).drop("speed")
    reaches = known.select(*names, F.col("reach").alias("_reach"), F.col("grid_h").alias("_h"), F.col("grid_w").alias("_w"))
    routed = attach_by_key(values.where(F.col("value").isNotNull()).select(*names, "row", "col", "value"), reaches, names, ["row", "col"])
    tiled = with_halo(routed, tile, F.col("_reach"), F.col("_h"), F.col("_w")).select(*names, "tile_r", "tile_c", "row", "col", "value")
    schema = T.StructType([*(values.schema[key] for key in names), int_field("lead"), int_field("row"), int_field("col"), double_field("value")])
    arrow = to_arrow_schema(schema)

    def velocities(window: Window, packed_rows: list | None, step: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (window.rows, window.cols)
        if not packed_rows:
            return np.zeros(shape), np.zeros(shape)
        ch, cw = -(-window.height // step), -(-window.width // step)
        points = np.array([(p["x"], p["y"], p["u"], p["v"]) for p in packed_rows])
        r0, r1 = coarse_nodes(window.top, window.top + window.rows - 1, window.height, ch)
        c0, c1 = coarse_nodes(window.left, window.left + window.cols - 1, window.width, cw)
        r, c = np.meshgrid(np.arange(r0, r1 + 1), np.arange(c0, c1 + 1), indexing="ij")
        uv = idw_values(c.ravel() * float(step), r.ravel() * float(step), points[:, 0], points[:, 1], points[:, 2:], float(step))
        uv = uv.reshape(*r.shape, 2)
        y = resize_positions(np.arange(window.top, window.top + window.rows), ch, window.height)
        x = resize_positions(np.arange(window.left, window.left + window.cols), cw, window.width)
        y, x = np.meshgrid(y, x, indexing="ij")
        return tuple(replicate_sample(uv[:, :, part], y, x, ch, cw, r0, c0) for part in (0, 1))

    def run(group_key: tuple[pa.Scalar, ...], cells: pa.Table, side: pa.Table) -> pa.Table:
        if cells.num_rows == 0 or side.num_rows == 0:
            return arrow.empty_table()
        own = {name: side.column(name)[0].as_py() for name in ("reach", "grid_h", "grid_w", "vectors", "_leads", "_motion", "_step")}
        if not own["_leads"]:
            return arrow.empty_table()
        tile_r, tile_c = (int(part.as_py()) for part in group_key[len(names) :])
        window = window_of(tile_r, tile_c, tile, own["reach"], own["grid_h"], own["grid_w"])
        field = window.dense(column_array(cells, "row"), column_array(cells, "col"), column_array(cells, "value"))
        u, v = velocities(window, own["vectors"], own["_motion"])
        return with_keys(arrow, names, group_key[: len(names)], moved_cells(window, field, u, v, lead_differences(own["_leads"]), own["_step"]))

    return cogrouped(tiled, frame_tiles(known, tile), [*names, "tile_r", "tile_c"]).applyInArrow(run, schema)
