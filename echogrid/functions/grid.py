"""Grid arithmetic as Column expressions: centres, sizes, window indices, sampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kilometres per degree used for rough pixel sizes.
KM_PER_DEGREE_LON = 111.32
KM_PER_DEGREE_LAT = 110.54


def column_centre(col: Column, x_min: Column, px: Column) -> Column:
    return x_min + (col + 0.5) * px


def row_centre(row: Column, y_max: Column, py: Column) -> Column:
    return y_max - (row + 0.5) * py


def extent_size(low: Column, high: Column, resolution: Column) -> Column:
    """Cells covering an extent; the small slack keeps float noise from adding one."""
    return F.greatest(F.lit(1), F.ceil((high - low) / resolution - F.lit(1e-6))).cast("int")


def nearest_column(x: Column, x_min: Column, px: Column) -> Column:
    return F.rint((x - x_min) / px - 0.5)


def nearest_row(y: Column, y_max: Column, py: Column) -> Column:
    return F.rint((y_max - y) / py - 0.5)


def pooled_size(size: Column, factor: Column) -> Column:
    """Cells left after pooling by a (fractional) factor, ties to even, at least one."""
    pooled = F.greatest(F.lit(1), F.rint(size / factor).cast("int"))
    return F.when(factor <= 1, size).otherwise(pooled).cast("int")


def window_index(index: Column, size: Column, pooled: Column) -> Column:
    """Pooling window of a cell, in integers only.

    Windows start at the half-even rounding of ``w * size / pooled``.  A start
    on an exact half goes to the even neighbour, which moves odd indices back.
    """
    position = (2 * index.cast("bigint") + 1) * pooled
    width = 2 * size.cast("bigint")
    whole = F.floor(position / width).cast("int")
    tie = (position % width == 0) & (index % 2 == 1)
    return F.least(F.when(tie, whole - 1).otherwise(whole), pooled - 1).cast("int")


def motion_step(step: Column, height: Column, width: Column, grid_max: Column) -> Column:
    """Coarsening step after the optional cap on the longest coarse edge."""
    capped = F.ceil(F.greatest(height, width) / grid_max).cast("int")
    wanted = F.greatest(F.lit(1), step)
    return F.when(grid_max > 0, F.greatest(wanted, capped)).otherwise(wanted)


def coarse_size(size: Column, step: Column) -> Column:
    return F.ceil(size / step).cast("int")


def km_per_pixel(west: Column, east: Column, south: Column, north: Column, width: Column, height: Column) -> Column:
    """``STRUCT<lon, lat, mean>`` of rough kilometres per pixel."""
    lon = (east - west) * KM_PER_DEGREE_LON / width
    lat = (north - south) * KM_PER_DEGREE_LAT / height
    return F.struct(lon.alias("lon"), lat.alias("lat"), ((lon + lat) / 2).alias("mean"))


def tile_of(index: Column, tile: int) -> Column:
    return F.floor(index / F.lit(tile)).cast("int")
