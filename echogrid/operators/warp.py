"""Bilinear resizing, sampling at displaced positions, semi-Lagrangian extrapolation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .skew import attach_by_key
from .tiles import DEFAULT_TILE, Window, cogrouped, column_array, double_field, int_field, window_of, with_halo, with_keys


def _taps(position: Column, size: Column) -> tuple[Column, Column, Column]:
    """Lower tap, upper tap and fraction of a clamped position."""
    clamped = F.least(F.greatest(position, F.lit(0.0)), (size - 1).cast("double"))
    low = F.floor(clamped).cast("int")
    return low, F.least(low + 1, size - 1).cast("int"), clamped - low


def resize_bilinear(cells: DataFrame, keys: Sequence[str], columns: Sequence[str], source: tuple[Column, Column], target: tuple[Column, Column]) -> DataFrame:
    """Resize a dense grid with half-pixel centres and clamped edges.

    Each source cell is sent to the target cells that tap it, whose range is a
    closed form, and the weighted taps are summed: one shuffle of partial sums,
    no target grid and no join.
    """
    sh, sw = source
    th, tw = target

    def reached(index: str, s: Column, t: Column) -> Column:
        # Targets whose clamped position lies within one cell of the source cell.
        scale = s / t
        low = F.ceil((F.col(index) - F.lit(1) + F.lit(0.5)) / scale - F.lit(0.5) - F.lit(1e-9))
        high = F.floor((F.col(index) + F.lit(1) + F.lit(0.5)) / scale - F.lit(0.5) + F.lit(1e-9))
        low = F.when(F.col(index) == 0, F.lit(0)).otherwise(low)
        high = F.when(F.col(index) == s - 1, t - 1).otherwise(high)
        low, high = F.greatest(low, F.lit(0)).cast("int"), F.least(high, t - 1).cast("int")
        return F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")))

    def weight(index: str, target_index: str, s: Column, t: Column) -> Column:
        low, high, fraction = _taps((F.col(target_index) + 0.5) * s / t - 0.5, s)
        lower = F.when(F.col(index) == low, 1 - fraction).otherwise(0.0)
        return lower + F.when(F.col(index) == high, fraction).otherwise(0.0)

    sized = cells.select(*keys, "row", "col", *columns, sh.alias("_sh"), sw.alias("_sw"), th.alias("_th"), tw.alias("_tw"))
    spread = sized.withColumn("_r", reached("row", F.col("_sh"), F.col("_th"))).withColumn("_c", reached("col", F.col("_sw"), F.col("_tw")))
    w = weight("row", "_r", F.col("_sh"), F.col("_th")) * weight("col", "_c", F.col("_sw"), F.col("_tw"))
    weighted = spread.withColumn("_w", w).where(F.col("_w") > 0)
    return (
        weighted.groupBy(*keys, F.col("_r").alias("row"), F.col("_c").alias("col"))
        .agg(*[F.sum(F.col(name) * F.col("_w")).alias(name) for name in columns])
    )


def sample_bilinear(
    points: DataFrame,
    cells: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    height: Column,
    width: Column,
    replicate: bool,
) -> DataFrame:
    """Sample ``cells`` at the ``sx, sy`` of ``points`` (one row per keys, row, col).

    ``replicate`` clamps positions to the grid (velocities).  Otherwise a tap
    with positive weight that is missing, clear sky or outside makes the result
    missing (values).  Taps are equi-keys, so this is one shuffle join and one
    aggregate for any displacement.
    """
    if replicate:
        r0, r1, fr = _taps(F.col("sy"), height)
        c0, c1, fc = _taps(F.col("sx"), width)
    else:
        r0, c0 = F.floor("sy").cast("int"), F.floor("sx").cast("int")
        r1, c1, fr, fc = r0 + 1, c0 + 1, F.col("sy") - F.floor("sy"), F.col("sx") - F.floor("sx")
    tap = lambda r, c, w: F.struct(r.alias("r"), c.alias("c"), w.alias("w"))
    four = F.array(
        tap(r0, c0, (1 - fr) * (1 - fc)), tap(r0, c1, (1 - fr) * fc), tap(r1, c0, fr * (1 - fc)), tap(r1, c1, fr * fc)
    )
    spread = (
        points.withColumn("_tap", F.explode(four))
        .where(F.col("_tap.w") > 0)
        .select(*points.columns, F.col("_tap.r").alias("_r"), F.col("_tap.c").alias("_c"), F.col("_tap.w").alias("_w"))
    )
    right = cells.select(*keys, F.col("row").alias("_r"), F.col("col").alias("_c"), *[F.col(name).alias(f"_in_{name}") for name in columns])
    joined = spread.join(right, [*keys, "_r", "_c"], "left")
    finite = lambda name: F.col(name).isNotNull() & (F.abs(F.col(name)) != float("inf"))
    sums = []
    for name in columns:
        ok = F.min(finite(f"_in_{name}"))
        total = F.sum(F.when(finite(f"_in_{name}"), F.col(f"_in_{name}") * F.col("_w")))
        sums.append(F.when(ok, total).alias(name))
    return joined.groupBy(*[c for c in points.columns if c not in ("sx", "sy")]).agg(*sums)


def replicate_sample(array: np.ndarray, y: np.ndarray, x: np.ndarray, height: int, width: int, top: int, left: int) -> np.ndarray:
    """Sample a region array at whole-grid positions clamped to the grid."""
    y, x = np.clip(y, 0, height - 1), np.clip(x, 0, width - 1)
    y0, x0 = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
    fy, fx = y - y0, x - x0
    a, b = y0 - top, np.minimum(y0 + 1, height - 1) - top
    c, d = x0 - left, np.minimum(x0 + 1, width - 1) - left
    return (array[a, c] * (1 - fx) + array[a, d] * fx) * (1 - fy) + (array[b, c] * (1 - fx) + array[b, d] * fx) * fy


WHOLE = 1e-9  # of a cell; a position that close to a cell's centre is that cell, so rounding loses none at the edge of data


def _sample_values(array: np.ndarray, y: np.ndarray, x: np.ndarray, top: int, left: int) -> np.ndarray:
    """Sample values at whole-grid positions; any missing tap with weight makes NaN."""
    y, x = (np.where(np.abs(at - np.rint(at)) < WHOLE, np.rint(at), at) for at in (y, x))
    y0, x0 = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
    fy, fx = y - y0, x - x0
    total = np.zeros(y.shape)
    for dr, dc, w in ((0, 0, (1 - fy) * (1 - fx)), (0, 1, (1 - fy) * fx), (1, 0, fy * (1 - fx)), (1, 1, fy * fx)):
        r, c = y0 + dr - top, x0 + dc - left
        inside = (r >= 0) & (r < array.shape[0]) & (c >= 0) & (c < array.shape[1])
        tap = np.where(inside, array[np.clip(r, 0, array.shape[0] - 1), np.clip(c, 0, array.shape[1] - 1)], np.nan)
        tap = np.where(np.isfinite(tap), tap, np.nan)
        total = total + np.where(w > 0, tap * w, 0.0)
    return total


def lead_differences(leads: Sequence[float]) -> list[float]:
    if not leads:
        raise ValueError("at least one lead is needed")
    if list(leads) != sorted(leads) or leads[0] <= 0:
        raise ValueError("leads must be positive and ascending")
    return [b - a for a, b in zip([0.0, *leads], leads)]


def trajectories(vel_u, vel_v, rows, cols, steps, sample):
    """Midpoint-rule displacement (x, y) at the given nodes after each lead.

    ``sample(array, y, x)`` reads velocities at whole-grid positions.  The
    displacement is carried from lead to lead.
    """
    dx, dy = np.zeros(rows.shape), np.zeros(rows.shape)
    inc_x, inc_y = sample(vel_u, rows, cols) * steps[0], sample(vel_v, rows, cols) * steps[0]
    for step in steps:
        mid_y, mid_x = rows + dy - inc_y / 2, cols + dx - inc_x / 2
        inc_x, inc_y = sample(vel_u, mid_y, mid_x) * step, sample(vel_v, mid_y, mid_x) * step
        dx, dy = dx - inc_x, dy - inc_y
        inc_x, inc_y = sample(vel_u, rows + dy, cols + dx) * step, sample(vel_v, rows + dy, cols + dx) * step
        yield dx.copy(), dy.copy()


def coarse_nodes(first: int, last: int, size: int, coarse: int) -> tuple[int, int]:
    """Coarse nodes tapped when resizing to full cells ``first..last``."""
    low = np.floor((first + 0.5) * coarse / size - 0.5)
    high = np.floor((last + 0.5) * coarse / size - 0.5) + 1
    return int(np.clip(low, 0, coarse - 1)), int(np.clip(high, 0, coarse - 1))


def resize_positions(index: np.ndarray, size_in: int, size_out: int) -> np.ndarray:
    return (index + 0.5) * size_in / size_out - 0.5


def extrapolate(
    values: DataFrame,
    velocity: DataFrame,
    keys: Sequence[str],
    leads: Sequence[float],
    height: int | Column,
    width: int | Column,
    grid_step: int = 1,
    tile: int = DEFAULT_TILE,
    speed: DataFrame | None = None,
) -> DataFrame:
    """Move ``values`` along ``velocity`` (``u, v`` cells per step) to each lead.

    Returns keys, ``lead`` (position in ``leads``), row, col, value for cells that
    come out finite; all others are missing.

    The farthest any cell can travel is the frame's largest speed times the last
    lead.  It becomes the halo of the tiles, so the whole trajectory and the
    final sampling of every lead run in one group and need a single shuffle.
    ``speed`` (keys, speed) is a known bound on ``u`` and ``v``; without it the
    bound is aggregated from the velocity.  ``grid_step`` > 1 integrates on a
    coarser grid.
    """
    names = list(keys)
    steps = lead_differences(list(leads))
    total = float(leads[-1])
    if speed is None:
        speed = velocity.groupBy(*names).agg(F.max(F.greatest(F.abs("u"), F.abs("v"))).alias("speed"))
    # Coarse steps and the interpolation taps reach a few cells further.
    reach = (F.ceil(F.col("speed") * F.lit(total)) + F.lit(4 * grid_step + 2)).cast("int")
    bounds = speed.select(*names, reach.alias("_reach"))

    def tiled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        sized = df.select(*names, "row", "col", *columns, *[c.alias(n) for c, n in zip(size, ("_h", "_w"))])
        joined = attach_by_key(sized, bounds, names, ["row", "col"])
        return with_halo(joined, tile, F.col("_reach"), F.col("_h"), F.col("_w")).drop("_h", "_w", "_reach")

    size = [part if isinstance(part, Column) else F.lit(part) for part in (height, width)]
    left = tiled(values.where(F.col("value").isNotNull()), ["value"])
    right = tiled(velocity, ["u", "v"])
    schema = T.StructType(
        [*(values.schema[key] for key in names), int_field("lead"), int_field("row"), int_field("col"), double_field("value")]
    )
    arrow = to_arrow_schema(schema)
    n_keys = len(names)
    step = max(1, int(grid_step))

    def run(group_key: tuple[pa.Scalar, ...], cells: pa.Table, motion: pa.Table) -> pa.Table:
        keyed = group_key[:n_keys]
        if cells.num_rows == 0 or motion.num_rows == 0:
            return arrow.empty_table()
        tile_r, tile_c = (int(part.as_py()) for part in group_key[n_keys:])
        h, w = int(motion.column("grid_h")[0].as_py()), int(motion.column("grid_w")[0].as_py())
        window = window_of(tile_r, tile_c, tile, int(motion.column("reach")[0].as_py()), h, w)
        field = window.dense(column_array(cells, "row"), column_array(cells, "col"), column_array(cells, "value"))
        mr, mc = column_array(motion, "row"), column_array(motion, "col")
        u = window.dense(mr, mc, column_array(motion, "u"), fill=0.0)
        v = window.dense(mr, mc, column_array(motion, "v"), fill=0.0)
        return with_keys(arrow, names, keyed, moved_cells(window, field, u, v, steps, step))

    grouping = [*names, "tile_r", "tile_c"]
    return cogrouped(left, right, grouping).applyInArrow(run, schema)


def moved_cells(window: Window, field: np.ndarray, u: np.ndarray, v: np.ndarray, steps: Sequence[float], step: int) -> dict[str, np.ndarray]:
    """Finite cells of the tile at every lead, from its region's values and velocities."""
    h, w = window.height, window.width
    rows, cols = np.meshgrid(np.arange(window.r0, window.r1), np.arange(window.c0, window.c1), indexing="ij")
    ch, cw = -(-h // step), -(-w // step)
    if step > 1 and ch >= 2 and cw >= 2:
        moves = _coarse_moves(u, v, window, rows, cols, steps, step, ch, cw)
    else:
        sample = lambda a, y, x: replicate_sample(a, y, x, h, w, window.top, window.left)
        moves = trajectories(u, v, rows, cols, steps, sample)
    parts: dict[str, list[np.ndarray]] = {name: [] for name in ("lead", "row", "col", "value")}
    for number, (dx, dy) in enumerate(moves):
        moved = _sample_values(field, rows + dy, cols + dx, window.top, window.left)
        keep = np.isfinite(moved)
        for name, found in zip(parts, (np.full(int(keep.sum()), number), rows[keep], cols[keep], moved[keep])):
            parts[name].append(found)
    return {name: np.concatenate(found) for name, found in parts.items()}


def _coarse_moves(u, v, window, rows, cols, steps, step, ch, cw):
    """Trajectories on the coarse grid, resized to the tile's cells."""
    h, w = window.height, window.width
    # Coarse velocities whose two taps lie in the region.
    full_y, full_x = resize_positions(np.arange(ch), h, ch), resize_positions(np.arange(cw), w, cw)
    has = lambda p, size, low, n: (np.floor(np.clip(p, 0, size - 1)) >= low) & (np.minimum(np.floor(np.clip(p, 0, size - 1)) + 1, size - 1) < low + n)
    ok_r, ok_c = np.flatnonzero(has(full_y, h, window.top, window.rows)), np.flatnonzero(has(full_x, w, window.left, window.cols))
    gy, gx = np.meshgrid(full_y[ok_r], full_x[ok_c], indexing="ij")
    cu = replicate_sample(u, gy, gx, h, w, window.top, window.left) / step
    cv = replicate_sample(v, gy, gx, h, w, window.top, window.left) / step
    top, left = int(ok_r[0]), int(ok_c[0])
    r_low, r_high = coarse_nodes(window.r0, window.r1 - 1, h, ch)
    c_low, c_high = coarse_nodes(window.c0, window.c1 - 1, w, cw)
    nr, nc = np.meshgrid(np.arange(r_low, r_high + 1), np.arange(c_low, c_high + 1), indexing="ij")
    sample = lambda a, y, x: replicate_sample(a, y, x, ch, cw, top, left)
    at_y, at_x = resize_positions(rows, ch, h), resize_positions(cols, cw, w)
    for dx, dy in trajectories(cu, cv, nr, nc, steps, sample):
        full_dx = replicate_sample(dx, at_y, at_x, ch, cw, r_low, c_low) * step
        full_dy = replicate_sample(dy, at_y, at_x, ch, cw, r_low, c_low) * step
        yield full_dx, full_dy
