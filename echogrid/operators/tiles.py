"""Bounded tile groups with a halo, for operators that look at neighbouring cells.

A frame is cut into square tiles.  Every cell goes to its own tile and to each
tile whose halo reaches it, so one shuffle gives each task all it needs and no
group holds more than ``(tile + 2 * halo) ** 2`` cells, however large the frame.
Input must hold one row per (keys, row, col).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

DEFAULT_TILE = 256


def _tiles_reached(index: str, halo: Column, size: Column, tile: int) -> Column:
    low = F.floor(F.greatest(F.col(index) - halo, F.lit(0)) / F.lit(tile)).cast("int")
    high = F.floor(F.least(F.col(index) + halo, size - 1) / F.lit(tile)).cast("int")
    return F.explode(F.sequence(low, high))


def geometry(height: int | Column, width: int | Column, halo: int | Column) -> dict[str, Column]:
    """The columns that say how large a row's grid is and how far a tile of it reads."""
    sized = {"grid_h": height, "grid_w": width, "reach": halo}
    return {name: (size if isinstance(size, Column) else F.lit(size)).cast("int") for name, size in sized.items()}


def with_halo(cells: DataFrame, tile: int, halo: int | Column, height: int | Column, width: int | Column) -> DataFrame:
    """One row per (cell, tile that reads it), with ``tile_r`` and ``tile_c``."""
    sized = cells.withColumns(geometry(height, width, halo))
    by_row = sized.withColumn("tile_r", _tiles_reached("row", F.col("reach"), F.col("grid_h"), tile))
    return by_row.withColumn("tile_c", _tiles_reached("col", F.col("reach"), F.col("grid_w"), tile))


@dataclass(frozen=True)
class Window:
    """The part of a grid one tile group sees, in whole-grid coordinates.

    ``r0, r1, c0, c1`` bound the tile itself; ``top, left`` and the array shape
    bound the readable region (tile plus halo, clipped to the grid).
    """

    r0: int
    r1: int
    c0: int
    c1: int
    top: int
    left: int
    rows: int
    cols: int
    height: int
    width: int

    def dense(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, fill: float = np.nan) -> np.ndarray:
        """Scatter cell values into the region array."""
        out = np.full((self.rows, self.cols), fill, dtype=np.float64)
        out[row - self.top, col - self.left] = value
        return out

    def core(self, array: np.ndarray) -> np.ndarray:
        """The tile's own part of a region array."""
        return array[self.r0 - self.top : self.r1 - self.top, self.c0 - self.left : self.c1 - self.left]

    def is_core(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        return (row >= self.r0) & (row < self.r1) & (col >= self.c0) & (col < self.c1)


def window_of(tile_r: int, tile_c: int, tile: int, halo: int, height: int, width: int) -> Window:
    r0, c0 = tile_r * tile, tile_c * tile
    r1, c1 = min(r0 + tile, height), min(c0 + tile, width)
    top, left = max(0, r0 - halo), max(0, c0 - halo)
    bottom, right = min(height, r1 + halo), min(width, c1 + halo)
    return Window(r0, r1, c0, c1, top, left, bottom - top, right - left, height, width)


def column_array(table: pa.Table, name: str) -> np.ndarray:
    """A column as numpy; NULL in a floating column becomes NaN."""
    return table.column(name).to_numpy()


# A tile function maps (window, group table) to named output columns of equal length.
TileFunction = Callable[[Window, pa.Table], dict[str, np.ndarray]]


def map_tiles(
    tiled: DataFrame,
    keys: Sequence[str],
    tile: int,
    fn: TileFunction,
    fields: Sequence[T.StructField],
) -> DataFrame:
    """Run ``fn`` once per (keys, tile) and return keys plus its columns."""
    schema = T.StructType([*(tiled.schema[key] for key in keys), *fields])
    arrow = to_arrow_schema(schema)
    names = list(keys)

    def run(group_key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        values = group_key[: len(names)]
        tile_r, tile_c = (int(part.as_py()) for part in group_key[len(names) :])
        window = window_of(
            tile_r, tile_c, tile,
            int(table.column("reach")[0].as_py()), int(table.column("grid_h")[0].as_py()), int(table.column("grid_w")[0].as_py()),
        )
        return with_keys(arrow, names, values, fn(window, table))

    return tiled.groupBy(*names, "tile_r", "tile_c").applyInArrow(run, schema)


def map_tiles_with(
    tiled: DataFrame,
    per_frame: DataFrame,
    keys: Sequence[str],
    tile: int,
    fn: Callable[[Window, pa.Table, dict], dict[str, np.ndarray]],
    fields: Sequence[T.StructField],
    height: int | Column,
    width: int | Column,
    halo: int | Column,
    empty_tiles: bool = False,
) -> DataFrame:
    """Like :func:`map_tiles`, with the frame's row of ``per_frame`` as a dict.

    Per-frame values meet the tiles by cogrouping one small row per tile, so the
    cells need no join, and no shuffle, beyond the one that builds the tiles.
    Frames without a row are left out.  Tiles without a cell are too, unless
    ``empty_tiles`` asks for them.  Height, width and halo may be columns of
    ``per_frame``, so that frames of many grids share one plan; the tiles must
    have been made with the same.
    """
    schema = T.StructType([*(tiled.schema[key] for key in keys), *fields])
    arrow = to_arrow_schema(schema)
    names = list(keys)
    extra = [name for name in per_frame.columns if name not in names]

    def run(group_key: tuple[pa.Scalar, ...], table: pa.Table, side: pa.Table) -> pa.Table:
        if side.num_rows == 0 or (table.num_rows == 0 and not empty_tiles):
            return arrow.empty_table()
        tile_r, tile_c = (int(part.as_py()) for part in group_key[len(names) :])
        sized = [int(side.column(name)[0].as_py()) for name in ("reach", "grid_h", "grid_w")]
        window = window_of(tile_r, tile_c, tile, *sized)
        known = {name: side.column(name)[0].as_py() for name in extra}
        return with_keys(arrow, names, group_key[: len(names)], fn(window, table, known))

    grouping = [*names, "tile_r", "tile_c"]
    sides = frame_tiles(per_frame.withColumns(geometry(height, width, halo)), tile)
    slim = tiled.drop("reach", "grid_h", "grid_w")
    return cogrouped(slim, sides, grouping).applyInArrow(run, schema)


def cogrouped(left: DataFrame, right: DataFrame, grouping: Sequence[str]):
    """Cogroup on equal keys; the right side's are renamed, so both may stem from one table."""
    renamed = right.select(*[F.col(name).alias(f"_side_{name}" if name in grouping else name) for name in right.columns])
    return left.groupBy(*grouping).cogroup(renamed.groupBy(*[f"_side_{name}" for name in grouping]))


def frame_tiles(per_frame: DataFrame, tile: int) -> DataFrame:
    """One row per tile of each frame row, whose grid is ``grid_h`` by ``grid_w``."""
    last = lambda name: F.floor((F.col(name) - 1) / F.lit(tile)).cast("int")
    rows, cols = F.explode(F.sequence(F.lit(0), last("grid_h"))), F.explode(F.sequence(F.lit(0), last("grid_w")))
    return per_frame.withColumn("tile_r", rows).withColumn("tile_c", cols)


def with_keys(arrow: pa.Schema, names: Sequence[str], values: Sequence[pa.Scalar], columns: dict[str, np.ndarray]) -> pa.Table:
    """An Arrow table of the output schema: repeated key values, then the columns."""
    size = len(next(iter(columns.values()))) if columns else 0
    arrays = []
    for field in arrow:
        if field.name in names:
            scalar = values[names.index(field.name)]
            arrays.append(pa.repeat(scalar, size).cast(field.type))
        else:
            arrays.append(pa.array(columns[field.name], type=field.type, from_pandas=True))
    return pa.Table.from_arrays(arrays, schema=arrow)


def double_field(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


def int_field(name: str) -> T.StructField:
    return T.StructField(name, T.IntegerType())


def bool_field(name: str) -> T.StructField:
    return T.StructField(name, T.BooleanType())
