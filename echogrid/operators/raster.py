"""Target grids, nearest sampling, pooling, variants and palette classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid
from ..functions import values as V
from ..functions.projection import WEB_MERCATOR, Crs, forward, inverse, project
from .cells import max_cells, target_cells

EDGE_SAMPLES = 64
LATTICE_SAMPLES = 128


def perimeter_bbox(frames: DataFrame, keys: Sequence[str], source: Crs, target: Crs = WEB_MERCATOR) -> DataFrame:
    """Projected bounding box of each grid from 64 samples on each edge."""
    step = F.explode(F.sequence(F.lit(0), F.lit(EDGE_SAMPLES - 1)))
    edge = F.explode(F.array(*[F.lit(name) for name in ("south", "north", "west", "east")]))
    x_max = F.col("x_min") + F.col("width") * F.col("px")
    y_min = F.col("y_max") - F.col("height") * F.col("py")
    share = F.col("_step") / F.lit(EDGE_SAMPLES - 1)
    along_x = F.col("x_min") + (x_max - F.col("x_min")) * share
    along_y = y_min + (F.col("y_max") - y_min) * share
    points = (
        frames.withColumn("_step", step)
        .withColumn("_edge", edge)
        .withColumn("_x", F.when(F.col("_edge") == "west", F.col("x_min")).when(F.col("_edge") == "east", x_max).otherwise(along_x))
        .withColumn("_y", F.when(F.col("_edge") == "south", y_min).when(F.col("_edge") == "north", F.col("y_max")).otherwise(along_y))
    )
    placed = project(points, F.col("_x"), F.col("_y"), source, target, ("_mx", "_my"))
    return placed.groupBy(*keys).agg(
        F.min("_mx").alias("x_low"), F.min("_my").alias("y_low"), F.max("_mx").alias("x_high"), F.max("_my").alias("y_high")
    )


def finest_cell(frames: DataFrame, keys: Sequence[str], source: Crs, target: Crs = WEB_MERCATOR) -> DataFrame:
    """Smallest projected edge of one source cell over a lattice of at most 128 x 128 cells."""

    def lattice(size: str) -> Column:
        n = F.least(F.lit(LATTICE_SAMPLES), F.col(size))
        steps = F.sequence(F.lit(0), n - 1)
        return F.transform(steps, lambda i: F.when(n > 1, i * (F.col(size) - 1) / (n - 1)).otherwise(F.lit(0.0)))

    points = frames.withColumn("_c", F.explode(lattice("width"))).withColumn("_r", F.explode(lattice("height")))
    x = grid.column_centre(F.col("_c"), F.col("x_min"), F.col("px"))
    y = grid.row_centre(F.col("_r"), F.col("y_max"), F.col("py"))
    points = points.withColumns({"_x": x, "_y": y})
    placed = project(points, F.col("_x"), F.col("_y"), source, target, ("_mx", "_my"))
    placed = project(placed, F.col("_x") + F.col("px"), F.col("_y"), source, target, ("_ex", "_ey"))
    placed = project(placed, F.col("_x"), F.col("_y") - F.col("py"), source, target, ("_sx", "_sy"))
    east = F.hypot(F.col("_ex") - F.col("_mx"), F.col("_ey") - F.col("_my"))
    south = F.hypot(F.col("_sx") - F.col("_mx"), F.col("_sy") - F.col("_my"))
    return placed.groupBy(*keys).agg(F.min(F.least(east, south)).alias("resolution"))


def target_grid(extents: DataFrame) -> DataFrame:
    """Grid specification from ``x_low, y_low, x_high, y_high, resolution`` columns."""
    return extents.withColumns(
        {
            "x_min": F.col("x_low"),
            "y_max": F.col("y_high"),
            "px": F.col("resolution"),
            "py": F.col("resolution"),
            "width": grid.extent_size(F.col("x_low"), F.col("x_high"), F.col("resolution")),
            "height": grid.extent_size(F.col("y_low"), F.col("y_high"), F.col("resolution")),
        }
    )


def union_extent(extents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of input extents and finest of their resolutions, per group."""
    return extents.groupBy(*keys).agg(
        F.min("x_low").alias("x_low"), F.min("y_low").alias("y_low"),
        F.max("x_high").alias("x_high"), F.max("y_high").alias("y_high"),
        F.min("resolution").alias("resolution"),
    )


def bounds_extent(products: DataFrame, target: Crs = WEB_MERCATOR) -> DataFrame:
    """Requested lon/lat bounds of products as a projected extent."""
    placed = forward(products, F.col("west"), F.col("south"), target, ("_x1", "_y1"))
    placed = forward(placed, F.col("east"), F.col("north"), target, ("_x2", "_y2"))
    return placed.withColumns(
        {
            "x_low": F.least("_x1", "_x2"), "y_low": F.least("_y1", "_y2"),
            "x_high": F.greatest("_x1", "_x2"), "y_high": F.greatest("_y1", "_y2"),
        }
    ).drop("_x1", "_y1", "_x2", "_y2")


def lonlat_bounds(grids: DataFrame, crs: Crs = WEB_MERCATOR) -> DataFrame:
    """Adds ``west, south, east, north`` in degrees for grids given in ``crs``."""
    low = inverse(grids, F.col("x_min"), F.col("y_max") - F.col("height") * F.col("py"), crs, ("west", "south"))
    return inverse(low, F.col("x_min") + F.col("width") * F.col("px"), F.col("y_max"), crs, ("east", "north"))


def sampling_index(
    targets: DataFrame,
    sources: DataFrame,
    source_crs: Mapping[str, Crs],
    keys: Sequence[str],
    target_crs: Crs = WEB_MERCATOR,
) -> DataFrame:
    """Source cell seen by each target cell, one row per covered target cell.

    ``targets`` has one grid per ``keys``; ``sources`` has one grid per
    ``input_id`` plus the ``keys`` it serves.  The index depends on grids only,
    never on frames, so its size does not grow with the archive.
    """
    x = grid.column_centre(F.col("col"), F.col("x_min"), F.col("px"))
    y = grid.row_centre(F.col("row"), F.col("y_max"), F.col("py"))
    geo = sources.select(
        *keys, "input_id",
        F.col("x_min").alias("_sx0"), F.col("y_max").alias("_sy0"), F.col("px").alias("_spx"), F.col("py").alias("_spy"),
        F.col("width").alias("_sw"), F.col("height").alias("_sh"),
    )
    # Grids meet the inputs they use before they are spread into cells; inputs of one projection share a branch.
    by_crs: dict[Crs, list[str]] = {}
    for input_id, crs in source_crs.items():
        by_crs.setdefault(crs, []).append(input_id)
    parts = []
    for crs, input_ids in by_crs.items():
        served = target_cells(targets.join(geo.where(F.col("input_id").isin(*input_ids)), list(keys)))
        placed = project(served.withColumns({"_tx": x, "_ty": y}), F.col("_tx"), F.col("_ty"), target_crs, crs, ("_sx", "_sy"))
        parts.append(
            placed.withColumn("_col", grid.nearest_column(F.col("_sx"), F.col("_sx0"), F.col("_spx")))
            .withColumn("_row", grid.nearest_row(F.col("_sy"), F.col("_sy0"), F.col("_spy")))
        )
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    inside = (
        (F.col("_col") >= 0) & (F.col("_col") < F.col("_sw")) & (F.col("_row") >= 0) & (F.col("_row") < F.col("_sh"))
    )
    return merged.where(inside).select(
        *keys, "row", "col", "input_id", F.col("_row").cast("int").alias("src_row"), F.col("_col").cast("int").alias("src_col")
    )


def resample_nearest(cells: DataFrame, index: DataFrame) -> DataFrame:
    """Carry source values to target cells by equi-join on the computed source cell.

    All frames share the index.  Adaptive execution broadcasts it if its
    measured bytes allow; else both sides shuffle on (input, row, col), which
    spreads a hot input over its own cells.  Target cells outside the source
    have no row (missing).
    """
    source = cells.withColumnsRenamed({"row": "src_row", "col": "src_col"})
    return source.join(index, ["input_id", "src_row", "src_col"]).drop("src_row", "src_col")


def pool_max(cells: DataFrame, keys: Sequence[str], factor: Column, height: Column, width: Column) -> DataFrame:
    """Maximum pooling by a fractional factor; carries ``out_height`` and ``out_width``."""
    out_h, out_w = grid.pooled_size(height, factor), grid.pooled_size(width, factor)
    pooled = cells.withColumns({"out_height": out_h, "out_width": out_w})
    pooled = pooled.withColumns(
        {
            "row": F.when(factor <= 1, F.col("row")).otherwise(grid.window_index(F.col("row"), height, F.col("out_height"))),
            "col": F.when(factor <= 1, F.col("col")).otherwise(grid.window_index(F.col("col"), width, F.col("out_width"))),
        }
    )
    return pooled.groupBy(*keys, "out_height", "out_width", "row", "col").agg(F.max("value").alias("value"))


def variants(cells: DataFrame, keys: Sequence[str], specs: Sequence[tuple[str, float]], height: Column, width: Column) -> DataFrame:
    """All size variants in one plan: each cell is copied per variant, then pooled once."""
    if not specs:
        raise ValueError("at least one variant is needed")
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(factor)).alias("factor")) for name, factor in specs])
    copies = cells.withColumn("_v", F.explode(rows)).select("*", F.col("_v.name").alias("variant"), F.col("_v.factor").alias("_factor")).drop("_v")
    return pool_max(copies, [*keys, "variant"], F.col("_factor"), height, width)


def classify(
    cells: DataFrame,
    levels: Sequence[float],
    quantity: str = "DBZH",
    nodata_fill: bool = False,
) -> DataFrame:
    """Add the palette index ``idx`` for one palette known when the plan is made.

    A cell of another quantity (where the table has a ``quantity`` column) is an
    error, never silently coloured.  Evenly spaced levels become plain
    arithmetic that stays inside code generation.
    """
    n_colors = len(levels) - 1
    slot = n_colors + 1 if nodata_fill else n_colors
    checked = cells
    if "quantity" in cells.columns:
        same = F.assert_true(F.col("quantity") == quantity, f"palette is for {quantity}")
        checked = cells.where(same.isNull())
    step = levels[1] - levels[0]
    if all(high - low == step for low, high in zip(levels, levels[1:])):
        idx = V.even_palette_index(F.col("value"), levels[0], step, n_colors, slot)
    else:
        idx = V.palette_index(F.col("value"), F.array(*map(F.lit, levels)), F.lit(n_colors), F.lit(slot))
    return checked.withColumn("idx", idx)


def classify_by_palette(cells: DataFrame, palettes: DataFrame, nodata_fill: Column | None = None) -> DataFrame:
    """Classify rows that name their palette in a ``palette`` column.

    The palette table is a fixed dimension of a few rows; ``nodata_fill`` is a
    boolean column saying whether missing cells get their own slot.
    """
    dim = palettes.select(F.col("name").alias("palette"), F.col("levels").alias("_levels"), F.size("colors").alias("_n"))
    joined = cells.join(F.broadcast(dim), "palette")
    own = F.lit(False) if nodata_fill is None else nodata_fill
    slot = F.when(own, F.col("_n") + 1).otherwise(F.col("_n"))
    return joined.withColumn("idx", V.palette_index(F.col("value"), F.col("_levels"), F.col("_n"), slot)).drop("_levels", "_n")


def composite_to_grid(
    cells: DataFrame,
    targets: DataFrame,
    sources: DataFrame,
    source_crs: Mapping[str, Crs],
    keys: Sequence[str] = ("product_id",),
    frame: Sequence[str] = ("frame_ts",),
) -> DataFrame:
    """Resample every input onto the product grid and keep the maximum."""
    index = sampling_index(targets, sources, source_crs, keys)
    return max_cells(resample_nearest(cells, index), [*keys, *frame])
