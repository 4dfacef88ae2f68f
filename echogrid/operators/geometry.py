"""Polygons as vertex tables: areas, largest ring, buffered bounds, feature lookup.

A vertex table has (feature, ring, seq, lon, lat) with ``seq`` counted from 0 in
each ring.  Neighbouring vertices meet by an equi-join on ``seq``, so a ring of
any length is spread over tasks.  Vertices, rings and features grow with the
input and the planner cannot tell how many come out of a generator, so every
join here shuffles both sides and nothing is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.projection import laea_forward_at, laea_inverse_at
from .skew import attach_by_key

RING = ["feature", "ring"]
BEARINGS = 64


def ring_edges(vertices: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """Each vertex with the next one of its ring (the last meets the first)."""
    sizes = vertices.groupBy(*RING).agg((F.max("seq") + 1).alias("_n"))
    sized = attach_by_key(vertices, sizes, RING, ["seq"], few_keys=False)
    following = sized.withColumn("_at", F.pmod(F.col("seq") - 1 + F.col("_n"), F.col("_n")).cast("int")).select(
        *RING, F.col("_at").alias("seq"), F.col(x).alias("next_x"), F.col(y).alias("next_y")
    )
    here = vertices.select(*RING, F.col("seq").cast("int").alias("seq"), F.col(x).alias("x"), F.col(y).alias("y"))
    return here.hint("merge").join(following, [*RING, "seq"])


def _cross() -> Column:
    return F.col("x") * F.col("next_y") - F.col("next_x") * F.col("y")


def feature_centres(vertices: DataFrame) -> DataFrame:
    """Area centroid of each feature in degrees, over all its rings."""
    edges = ring_edges(vertices)
    sums = edges.groupBy("feature").agg(
        F.sum(_cross()).alias("a"),
        F.sum((F.col("x") + F.col("next_x")) * _cross()).alias("mx"),
        F.sum((F.col("y") + F.col("next_y")) * _cross()).alias("my"),
    )
    return sums.select(
        "feature", F.try_divide(F.col("mx"), 3 * F.col("a")).alias("lon0"), F.try_divide(F.col("my"), 3 * F.col("a")).alias("lat0")
    )


def ring_areas(vertices: DataFrame, centres: DataFrame) -> DataFrame:
    """Projected area of each ring, in an equal-area plane about its feature's centre."""
    placed = attach_by_key(vertices, centres, ["feature"], ["ring", "seq"], few_keys=False)
    projected = laea_forward_at(placed, F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0"), ("px", "py"))
    return ring_edges(projected, "px", "py").groupBy(*RING).agg((F.abs(F.sum(_cross())) / 2).alias("area"))


def largest_rings(areas: DataFrame) -> DataFrame:
    """The ring of largest area per feature; equal areas go to the lower ring number."""
    return areas.groupBy("feature").agg(
        F.max_by("ring", F.struct(F.col("area"), -F.col("ring"))).alias("ring"), F.max("area").alias("area")
    )


def buffered_bounds(vertices: DataFrame, buffer_km: float, bearings: int = BEARINGS) -> DataFrame:
    """Lon/lat bounds of each feature's largest ring, grown by a distance.

    Every vertex sends out points at the buffer distance in all bearings; their
    extent bounds the buffered polygon up to the bearing step.
    """
    centres = feature_centres(vertices)
    largest = largest_rings(ring_areas(vertices, centres)).join(centres.hint("merge"), "feature").drop("area")
    chosen = attach_by_key(vertices, largest, RING, ["seq"], few_keys=False)
    placed = laea_forward_at(chosen, F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0"), ("px", "py"))
    placed = placed.select("feature", "lon0", "lat0", "px", "py")
    turned = placed.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(bearings - 1))))
    angle = F.col("_i") * F.lit(2 * math.pi / bearings)
    grown = laea_inverse_at(
        turned, F.col("px") + buffer_km * 1000 * F.cos(angle), F.col("py") + buffer_km * 1000 * F.sin(angle),
        F.col("lon0"), F.col("lat0"), ("lon", "lat"),
    )
    return grown.groupBy("feature").agg(
        F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north")
    )


def match_features(specs: DataFrame, features: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """First feature (smallest ``ord``) matching a spec by any of the rules.

    ``rules`` pairs a spec column with a feature column.  Features are reduced to
    the first per value before each equi-join, so no match is ever multiplied.
    Specs without a match keep a NULL ``ord``; see :func:`require_matches`.
    """
    found = None
    for spec_column, feature_column in rules:
        first = features.where(F.col(feature_column).isNotNull()).groupBy(F.col(feature_column).alias(spec_column)).agg(F.min("ord").alias("ord"))
        hits = specs.join(first, spec_column).select("spec_id", "ord")
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy("spec_id").agg(F.min("ord").alias("ord"))
    return specs.select("spec_id").join(best, "spec_id", "left")


def require_matches(matched: DataFrame) -> DataFrame:
    """The same rows; a spec without a feature is an error."""
    check = F.assert_true(F.col("ord").isNotNull(), F.concat(F.lit("no feature for "), F.col("spec_id").cast("string")))
    return matched.where(check.isNull())
