"""Morphology, corner scores and feature selection on tile groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .skew import attach_by_key
from ..functions import values as V
from .tiles import (
    DEFAULT_TILE, Window, bool_field, column_array, double_field, int_field, map_tiles, map_tiles_with, with_halo, with_keys,
)

# Feature selection defaults.
QUALITY_LEVEL = 0.01
MIN_DISTANCE = 10
MAX_CORNERS = 1000
BLOCK_SIZE = 5
NODATA_BUFFER = 5


def _shifted(array: np.ndarray, dr: int, dc: int, outside) -> np.ndarray:
    """``result[r, c] = array[r + dr, c + dc]``, with ``outside`` past the region."""
    out = np.full_like(array, outside)
    rows, cols = array.shape
    rs, re = max(0, -dr), min(rows, rows - dr)
    cs, ce = max(0, -dc), min(cols, cols - dc)
    if rs < re and cs < ce:
        out[rs:re, cs:ce] = array[rs + dr : re + dr, cs + dc : ce + dc]
    return out


_CROSS = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))


def _opened(mask: np.ndarray) -> np.ndarray:
    """3x3 cross opening; cells past the grid edge constrain nothing."""
    eroded = np.logical_and.reduce([_shifted(mask, dr, dc, True) for dr, dc in _CROSS])
    return np.logical_or.reduce([_shifted(eroded, dr, dc, False) for dr, dc in _CROSS])


def morph_open(filled: DataFrame, keys: Sequence[str], height, width, tile: int = DEFAULT_TILE) -> DataFrame:
    """Remove small isolated echoes: cells lost by the opening take the frame minimum.

    Input is the output of ``fill_missing``; cells absent from the table count
    as background.
    """

    def fn(window: Window, table: pa.Table) -> dict[str, np.ndarray]:
        row, col = column_array(table, "row"), column_array(table, "col")
        value, low = column_array(table, "value"), column_array(table, "frame_min")
        mask = window.dense(row, col, (value > low).astype(np.float64), fill=0.0) > 0
        lost = mask & ~_opened(mask)
        own = window.is_core(row, col)
        gone = lost[row - window.top, col - window.left]
        return {
            "row": row[own], "col": col[own], "frame_min": low[own],
            "value": np.where(gone, low, value)[own],
            "valid": column_array(table, "valid")[own].astype(bool),
            "removed": gone[own],
        }

    tiled = with_halo(filled.select(*keys, "row", "col", "value", "frame_min", "valid"), tile, 2, height, width)
    fields = [int_field("row"), int_field("col"), double_field("frame_min"), double_field("value"), bool_field("valid"), bool_field("removed")]
    return map_tiles(tiled, keys, tile, fn, fields)


def open_frames(cells: DataFrame, keys: Sequence[str], height, width, tile: int = DEFAULT_TILE, raw: bool = False) -> DataFrame:
    """Fill missing cells with the frame minimum and remove isolated echoes, in one shuffle.

    Same rows as ``morph_open(fill_missing(cells))`` without the join of the
    minimum onto the cells: ``(keys, row, col, value, valid)``, with ``raw`` also
    the value as it was.  Height and width may be columns among the keys.
    """
    echo = F.when(V.is_echo(F.col("value")), F.col("value"))
    floor = cells.groupBy(*keys).agg(F.min(echo).alias("low")).where(F.col("low").isNotNull())

    def fn(window: Window, table: pa.Table, known: dict) -> dict[str, np.ndarray]:
        row, col, value = (column_array(table, name) for name in ("row", "col", "value"))
        valid = np.isfinite(value)
        filled = np.where(valid, value, known["low"])
        mask = window.dense(row, col, (filled > known["low"]).astype(np.float64), fill=0.0) > 0
        gone = (mask & ~_opened(mask))[row - window.top, col - window.left]
        own = window.is_core(row, col)
        return {"row": row[own], "col": col[own], "value": np.where(gone, known["low"], filled)[own], "valid": valid[own], "raw": value[own]}

    tiled = with_halo(cells.select(*keys, "row", "col", "value"), tile, 2, height, width)
    fields = [int_field("row"), int_field("col"), double_field("value"), bool_field("valid"), *([double_field("raw")] if raw else [])]
    return map_tiles_with(tiled, floor, keys, tile, fn, fields, height, width, 2)


def level_range(opened: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest and largest value of each opened frame."""
    return opened.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"))


def byte_levels(value: np.ndarray, low: float, high: float) -> np.ndarray:
    """Values as truncated byte levels between the frame's extremes."""
    if high - low > 1e-8:
        return np.floor((value - low) / (high - low) * 255)
    return np.floor(value - low)


def frame_corners(
    opened: DataFrame, ranges: DataFrame, keys: Sequence[str], height, width,
    block_size: int = BLOCK_SIZE, buffer: int = NODATA_BUFFER, tile: int = DEFAULT_TILE, candidates: bool = False,
) -> DataFrame:
    """Corner scores straight from opened frames: levels are computed inside the tile.

    ``candidates`` returns only cells with a positive score, which leaves out
    the empty part of every frame.
    """
    half, pad = block_size // 2, buffer // 2
    halo = max(half + 1, pad)

    def fn(window: Window, table: pa.Table, known: dict) -> dict[str, np.ndarray]:
        levels = byte_levels(column_array(table, "value"), known["low"], known["high"])
        scored = _scored(window, table, levels, half, pad)
        if candidates:
            keep = scored["score"] > 0
            return {name: values[keep] for name, values in scored.items()}
        return scored

    tiled = with_halo(opened.select(*keys, "row", "col", "value", "valid"), tile, halo, height, width)
    return map_tiles_with(tiled, ranges, keys, tile, fn, SCORE_FIELDS, height, width, halo)


def dilate_nodata(cells: DataFrame, keys: Sequence[str], height, width, buffer: int = NODATA_BUFFER, tile: int = DEFAULT_TILE) -> DataFrame:
    """Mark cells (``blocked``) with a missing cell in the ``buffer`` x ``buffer`` square around them.

    ``valid`` tells observed cells; cells absent from the table are missing.
    """
    half = buffer // 2

    def fn(window: Window, table: pa.Table) -> dict[str, np.ndarray]:
        row, col = column_array(table, "row"), column_array(table, "col")
        valid = column_array(table, "valid").astype(bool)
        missing = window.dense(row, col, (~valid).astype(np.float64), fill=1.0) > 0
        blocked = _box_any(missing, half)
        own = window.is_core(row, col)
        return {"row": row[own], "col": col[own], "valid": valid[own], "blocked": blocked[row - window.top, col - window.left][own]}

    tiled = with_halo(cells.select(*keys, "row", "col", "valid"), tile, half, height, width)
    return map_tiles(tiled, keys, tile, fn, [int_field("row"), int_field("col"), bool_field("valid"), bool_field("blocked")])


def _box_any(mask: np.ndarray, half: int) -> np.ndarray:
    span = range(-half, half + 1)
    rows = np.logical_or.reduce([_shifted(mask, d, 0, False) for d in span])
    return np.logical_or.reduce([_shifted(rows, 0, d, False) for d in span])


def _reflect(index: np.ndarray, size: int) -> np.ndarray:
    """Mirror indices at the grid edge without repeating the edge cell."""
    if size == 1:
        return np.zeros_like(index)
    period = 2 * (size - 1)
    folded = np.mod(index, period)
    return np.where(folded >= size, period - folded, folded)


def corner_scores(level: np.ndarray, window: Window, half: int) -> np.ndarray:
    """Smaller eigenvalue of the gradient matrix for each cell of the tile.

    ``level`` covers the region; mirrored borders apply at grid edges only.
    Sums are unnormalised: thresholds are relative to the frame maximum.
    """
    # Products are needed on the tile plus the box, gradients one cell further.
    pr = np.arange(max(0, window.r0 - half), min(window.height, window.r1 + half))
    pc = np.arange(max(0, window.c0 - half), min(window.width, window.c1 + half))

    def at(dr: int, dc: int) -> np.ndarray:
        rows = _reflect(pr + dr, window.height) - window.top
        cols = _reflect(pc + dc, window.width) - window.left
        return level[np.ix_(rows, cols)]

    gx = (at(-1, 1) - at(-1, -1)) + 2 * (at(0, 1) - at(0, -1)) + (at(1, 1) - at(1, -1))
    gy = (at(1, -1) - at(-1, -1)) + 2 * (at(1, 0) - at(-1, 0)) + (at(1, 1) - at(-1, 1))

    def box(product: np.ndarray) -> np.ndarray:
        total = np.zeros((window.r1 - window.r0, window.c1 - window.c0))
        rows, cols = np.arange(window.r0, window.r1), np.arange(window.c0, window.c1)
        for dr in range(-half, half + 1):
            line = _reflect(rows + dr, window.height) - pr[0]
            for dc in range(-half, half + 1):
                total += product[np.ix_(line, _reflect(cols + dc, window.width) - pc[0])]
        return total

    sxx, sxy, syy = box(gx * gx), box(gx * gy), box(gy * gy)
    return (sxx + syy) / 2 - np.sqrt(((sxx - syy) / 2) ** 2 + sxy**2)


def corner_score(levels: DataFrame, keys: Sequence[str], height, width, block_size: int = BLOCK_SIZE, buffer: int = NODATA_BUFFER, tile: int = DEFAULT_TILE) -> DataFrame:
    """Corner score of every observed cell, with ``blocked`` near missing data.

    Input has ``level`` (0..255) and ``valid``; absent cells are level 0 and
    missing.  One shuffle serves gradients, sums and the mask.
    """
    half, pad = block_size // 2, buffer // 2
    halo = max(half + 1, pad)
    # Mirrored reads near an edge reach the same distance inside the grid.

    def fn(window: Window, table: pa.Table) -> dict[str, np.ndarray]:
        return _scored(window, table, column_array(table, "level"), half, pad)

    tiled = with_halo(levels.select(*keys, "row", "col", "level", "valid"), tile, halo, height, width)
    return map_tiles(tiled, keys, tile, fn, SCORE_FIELDS)


SCORE_FIELDS = [int_field("row"), int_field("col"), double_field("score"), bool_field("blocked")]


def _scored(window: Window, table: pa.Table, levels: np.ndarray, half: int, pad: int) -> dict[str, np.ndarray]:
    row, col = column_array(table, "row"), column_array(table, "col")
    valid = column_array(table, "valid").astype(bool)
    level = window.dense(row, col, levels, fill=0.0)
    missing = window.dense(row, col, (~valid).astype(np.float64), fill=1.0) > 0
    score = corner_scores(level, window, half)
    own = window.is_core(row, col)
    r, c = row[own], col[own]
    return {
        "row": r, "col": c, "score": score[r - window.r0, c - window.c0],
        "blocked": _box_any(missing, pad)[r - window.top, c - window.left],
    }


def _spaced_peaks(row: np.ndarray, col: np.ndarray, score: np.ndarray, free: np.ndarray, spacing: float, limit: int) -> np.ndarray:
    """Indices of free local maxima, best first, each at least ``spacing`` cells from those before it."""
    r0, c0 = row.min(), col.min()
    field = np.full((row.max() - r0 + 3, col.max() - c0 + 3), -np.inf)
    field[row - r0 + 1, col - c0 + 1] = score
    around = np.max([_shifted(field, dr, dc, -np.inf) for dr in (-1, 0, 1) for dc in (-1, 0, 1)], axis=0)
    left = np.flatnonzero(free & (score >= around[row - r0 + 1, col - c0 + 1]))
    left = left[np.lexsort((col[left], row[left], -score[left]))]
    kept = []
    while len(left) and len(kept) < limit:
        best = left[0]
        kept.append(best)
        left = left[(row[left] - row[best]) ** 2 + (col[left] - col[best]) ** 2 >= spacing * spacing]
    return np.array(kept, np.int64)


def select_features(
    scores: DataFrame,
    keys: Sequence[str],
    height,
    width,
    quality: float = QUALITY_LEVEL,
    spacing: int = MIN_DISTANCE,
    limit: int = MAX_CORNERS,
) -> DataFrame:
    """Corners above a share of the frame's best free score, best first, no two closer than ``spacing``; ``limit`` per frame.

    A corner is a free inner cell that no neighbour, blocked or not, exceeds.
    The frame's best score is an aggregate; only cells above the share meet in
    one pass per frame, which the grid's size bounds.
    """
    h = F.lit(height) if isinstance(height, int) else height
    w = F.lit(width) if isinstance(width, int) else width
    inner = (F.col("row") > 0) & (F.col("row") < h - 1) & (F.col("col") > 0) & (F.col("col") < w - 1)
    top = scores.where(~F.col("blocked")).groupBy(*keys).agg(F.max("score").alias("frame_max"))
    ranked = attach_by_key(scores.where(F.col("score") > 0), top, keys, ["row", "col"])
    strong = ranked.where(F.col("score") >= quality * F.col("frame_max")).select(*keys, "row", "col", "score", (inner & ~F.col("blocked")).alias("free"))
    names = list(keys)
    schema = T.StructType([*(strong.schema[key] for key in names), int_field("row"), int_field("col"), double_field("score"), int_field("rank")])
    arrow = to_arrow_schema(schema)

    def pick(group_key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        row, col, score = (column_array(table, name) for name in ("row", "col", "score"))
        best = _spaced_peaks(row, col, score, column_array(table, "free").astype(bool), spacing, limit)
        return with_keys(arrow, names, group_key, {"row": row[best], "col": col[best], "score": score[best], "rank": np.arange(1, len(best) + 1)})

    return strong.groupBy(*names).applyInArrow(pick, schema)
