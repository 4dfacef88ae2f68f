"""Observed and forecast frames to classified variants, tiles and sidecars."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import registry
from ..functions import grid, names
from ..operators import raster as R
from ..sinks.overlay import encode_tiles


def classify_variants(
    merged: DataFrame,
    keys: Sequence[str],
    levels: Sequence[float] = registry.STANDARD_LEVELS,
    specs: Sequence[tuple[str, float]] = registry.DEFAULT_VARIANTS,
    nodata_fill: bool = False,
) -> DataFrame:
    """Variants of merged cells (with ``height, width``), classified: the shared tail of every frame."""
    sized = R.variants(merged, keys, specs, F.col("height"), F.col("width"))
    return R.classify(sized, levels, nodata_fill=nodata_fill)


class RenderPipeline(NamedTuple):
    """How a product's frames become classified variants: from the one input it has, or from the maximum over several."""

    single: Callable[..., DataFrame]
    composite: Callable[..., DataFrame]


def _framed(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per cell with its frame's size."""
    return cells.groupBy(*keys, "height", "width", "row", "col").agg(F.max("value").alias("value"))


def classify_single(cells: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """The product's only input as it is, on its own grid."""
    return classify_variants(cells.drop("input_id"), keys, **options)


def classify_composite(cells: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """The largest value over the product's inputs, which share a grid by now."""
    return classify_variants(_framed(cells, keys), keys, **options)


# Pipelines that a product may name.
RENDER_PIPELINES: dict[str, RenderPipeline] = {"default": RenderPipeline(classify_single, classify_composite)}


def check_pipeline(pipeline: str, pipelines: Mapping[str, RenderPipeline]) -> None:
    if pipeline not in pipelines:
        raise ValueError(f"unknown pipeline {pipeline!r}; known: {sorted(pipelines)}")


def render_products(
    cells: DataFrame, products: DataFrame, product_inputs: DataFrame, keys: Sequence[str] = ("frame_ts",), pipelines: Mapping[str, RenderPipeline] | None = None, **options
) -> DataFrame:
    """Classified variants of all products, each by the pipeline that its row names: ``product_id``, keys, ``variant, out_height, out_width, row, col, idx``.

    ``cells`` has (input_id, keys, row, col, value, height, width); ``products``
    names a ``pipeline`` (NULL: default), and how many inputs a product has says
    which of the pipeline's two ways it takes.  The plan has one branch for each
    way in use, all on one schema; a name that is not known is an error.
    """
    known = RENDER_PIPELINES if pipelines is None else pipelines
    named = F.coalesce("pipeline", F.lit("default"))
    several = product_inputs.groupBy("product_id").agg((F.count(F.lit(1)) > 1).alias("_several"))
    routes = product_inputs.select("product_id", "input_id").join(products.select("product_id", named.alias("_pipeline")), "product_id").join(several, "product_id")
    branches = []
    for name, pipeline in known.items():
        for several_, way in ((False, pipeline.single), (True, pipeline.composite)):
            own = routes.where((F.col("_pipeline") == name) & (F.col("_several") == several_)).select("product_id", "input_id")
            classes = way(cells.join(own, "input_id"), ["product_id", *keys], **options)
            branches.append(classes.select("product_id", *keys, "variant", "out_height", "out_width", "row", "col", "idx"))
    # the rows of products that no branch takes are an error, of which nothing can be filtered away
    astray = routes.where(~F.col("_pipeline").isin(list(known)))
    error = F.raise_error(F.concat(F.lit("unknown pipeline "), F.col("_pipeline")))
    out = astray.select(*[error.cast(field.dataType).alias(field.name) for field in branches[0].schema.fields])
    for branch in branches:
        out = out.unionByName(branch)
    return out


def render_tiles(
    merged: DataFrame,
    keys: Sequence[str],
    pipeline: str = "default",
    colors: Sequence[str] = registry.STANDARD_COLORS,
    nodata_rgba: tuple[int, int, int, float] | None = None,
    tile: int = 256,
    geobox: Column | None = None,
    **options,
) -> DataFrame:
    """PNG tiles of every frame and variant through a registered pipeline; ``geobox`` is a text over the keys."""
    check_pipeline(pipeline, RENDER_PIPELINES)
    classes = RENDER_PIPELINES[pipeline].single(merged, keys, nodata_fill=nodata_rgba is not None, **options)
    described = classes if geobox is None else classes.withColumn("geobox", geobox)
    return encode_tiles(described, [*keys, "variant"], colors, nodata_rgba, tile)


def variant_manifest(frames: DataFrame, specs: Sequence[tuple[str, float]] = registry.DEFAULT_VARIANTS) -> DataFrame:
    """File name and size of each variant of frames ``(base, height, width)``."""
    if not specs:
        raise ValueError("at least one variant is needed")
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(f)).alias("factor")) for n, f in specs])
    spread = frames.withColumn("_v", F.explode(rows))
    return spread.select(
        "base", F.col("_v.name").alias("variant"),
        F.concat("base", F.lit("_"), "_v.name", F.lit(".png")).alias("file"),
        grid.pooled_size(F.col("width"), F.col("_v.factor")).alias("width"),
        grid.pooled_size(F.col("height"), F.col("_v.factor")).alias("height"),
    )


def named_frames(frames: DataFrame, products: DataFrame, builder: str = "timestamped") -> DataFrame:
    """Adds the output ``base`` of each (product, timestamp) by a registered name builder."""
    build = names.BASE_NAME_BUILDERS[builder]
    config = F.broadcast(products.select("product_id", "base_prefix"))
    return frames.join(config, "product_id").withColumn("base", build(F.col("base_prefix"), F.col("frame_ts"))).drop("base_prefix")
