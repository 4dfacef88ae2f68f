"""Tile operators give the same rows whatever the tile, and match direct computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.operators import cells as C
from echogrid.operators import neighbourhood as N

from test_raster import cells_of


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def raster():
    rng = np.random.default_rng(11)
    array = np.cumsum(np.cumsum(rng.normal(size=(37, 45)), axis=0), axis=1)
    array[rng.random(array.shape) < 0.04] = np.nan
    array[:6, :9] = np.nan
    return array


@pytest.fixture(scope="module")
def filled(spark, raster):
    return C.fill_missing(cells_of(spark, raster), ["k"])


def test_opening_removes_only_what_no_cross_fits_into(spark):
    array = np.zeros((9, 9))
    array[1, 1] = 5.0  # an isolated cell
    array[4:7, 4:7] = 7.0  # a block that holds a cross
    out = {(r.row, r.col): r.value for r in N.morph_open(C.fill_missing(cells_of(spark, array), ["k"]), ["k"], 9, 9, tile=4).collect()}
    assert out[(1, 1)] == 0.0 and out[(5, 5)] == 7.0
    assert out[(4, 4)] == 0.0, "block corners are outside every cross"


@pytest.mark.parametrize("tile", [5, 16, 64])
def test_opening_does_not_depend_on_the_tile(spark, filled, tile):
    high = filled.withColumn("value", F.when(F.col("value") > 0, F.col("value")).otherwise(F.col("frame_min")))
    assert rows(N.morph_open(high, ["k"], 37, 45, tile=tile)) == rows(N.morph_open(high, ["k"], 37, 45, tile=256))


@pytest.mark.parametrize("tile", [7, 16])
def test_scores_and_masks_do_not_depend_on_the_tile(spark, filled, tile):
    levels = C.rescale_to_byte(filled, ["k"])
    assert rows(N.corner_score(levels, ["k"], 37, 45, tile=tile)) == rows(N.corner_score(levels, ["k"], 37, 45, tile=256))
    assert rows(N.dilate_nodata(filled, ["k"], 37, 45, tile=tile)) == rows(N.dilate_nodata(filled, ["k"], 37, 45, tile=256))


def test_dilation_matches_numpy(spark, raster, filled):
    missing = np.isnan(raster)
    padded = np.pad(missing, 2)
    expected = np.zeros_like(missing)
    for dr in range(5):
        for dc in range(5):
            expected |= padded[dr : dr + missing.shape[0], dc : dc + missing.shape[1]]
    got = {(r.row, r.col): r.blocked for r in N.dilate_nodata(filled, ["k"], 37, 45, tile=16).collect()}
    assert all(got[(r, c)] == expected[r, c] for r, c in got)


def test_levels_span_the_byte_range(spark, filled):
    low, high = C.rescale_to_byte(filled, ["k"]).agg(F.min("level"), F.max("level")).first()
    assert (low, high) == (0, 255)


def test_features_keep_their_distance_classes_and_limit(spark, filled):
    scores = N.corner_score(C.rescale_to_byte(filled, ["k"]), ["k"], 37, 45, tile=16)
    found = N.select_features(scores, ["k"], 37, 45).collect()
    apart = [(a.row - b.row) ** 2 + (a.col - b.col) ** 2 for a in found for b in found if a.rank < b.rank]
    assert len(found) > 2 and min(apart) >= 100
    assert [r.score for r in sorted(found, key=lambda r: r.rank)] == sorted((r.score for r in found), reverse=True)
    assert N.select_features(scores, ["k"], 37, 45, limit=2).count() == 2


def test_frames_without_an_echo_are_left_out(spark):
    df = cells_of(spark, [[np.nan, np.nan]], 1).union(cells_of(spark, [[np.nan, 3.0]], 2))
    assert {r.k for r in C.fill_missing(df, ["k"]).collect()} == {2}
    assert [r.k for r in C.empty_frames(df, ["k"]).collect()] == [1]


@pytest.mark.parametrize("tile", [9, 64])
def test_fused_opening_and_scores_equal_the_single_steps(spark, raster, filled, tile):
    opened = N.open_frames(cells_of(spark, raster), ["k"], 37, 45, tile)
    single = N.morph_open(filled, ["k"], 37, 45, tile=tile)
    assert rows(opened) == rows(single.select(*opened.columns))
    fused = N.frame_corners(opened, N.level_range(opened, ["k"]), ["k"], 37, 45, tile=tile)
    assert rows(fused) == rows(N.corner_score(C.rescale_to_byte(single, ["k"]), ["k"], 37, 45, tile=tile))


def test_candidates_give_the_same_features(spark, raster):
    opened = N.open_frames(cells_of(spark, raster), ["k"], 37, 45, 16)
    ranges = N.level_range(opened, ["k"])
    every, some = (N.frame_corners(opened, ranges, ["k"], 37, 45, tile=16, candidates=flag) for flag in (False, True))
    assert some.count() < every.count()
    assert rows(N.select_features(some, ["k"], 37, 45)) == rows(N.select_features(every, ["k"], 37, 45))


def test_a_busy_block_keeps_more_than_one_corner(spark):
    cells = [(1, 9, 9, 5.0), (1, 10, 10, 4.0), (1, 0, 30, 9.0), (1, 19, 9, 3.0), (1, 12, 24, 2.0), (1, 12, 25, 2.5), (1, 30, 30, 0.01)]
    df = spark.createDataFrame([(*c, (c[1], c[2]) == (12, 25)) for c in cells], "k int, row int, col int, score double, blocked boolean")
    found = sorted((r.rank, r.row, r.col) for r in N.select_features(df, ["k"], 40, 40).collect())
    assert found == [(1, 9, 9), (2, 19, 9)], "(10, 10) is too near, (12, 24) has a higher blocked neighbour, (0, 30) is on the edge"
