"""Grids, pooling, compositing, projection and resampling."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.functions import grid
from echogrid.functions import projection as P
from echogrid.operators import cells as C
from echogrid.operators import raster as R

CELL = "k int, row int, col int, value double"
GRID_DDL = "product_id string, input_id string, x_min double, y_max double, px double, py double, width int, height int"


def cells_of(spark, array, k=0):
    rows = [(k, int(r), int(c), None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(np.asarray(array, dtype=float))]
    return spark.createDataFrame(rows, CELL)


def array_of(df, height, width, name="value"):
    out = np.full((height, width), np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[r["row"], r["col"]] = r[name]
    return out


def pooled(array, factor):
    """Pooling straight from its definition."""
    h, w = array.shape
    oh, ow = max(1, round(h / factor)), max(1, round(w / factor))
    rb, cb = np.rint(np.arange(oh) * h / oh).astype(int), np.rint(np.arange(ow) * w / ow).astype(int)
    return np.fmax.reduceat(np.fmax.reduceat(array, rb, axis=0), cb, axis=1)


@pytest.mark.parametrize("shape, factor", [((4, 4), 2.0), ((6, 6), 1.5), ((7, 13), 1.5), ((9, 5), 2.5), ((3, 3), 10.0)])
def test_pooling_matches_its_definition(spark, shape, factor):
    rng = np.random.default_rng(3)
    array = rng.normal(size=shape)
    array[rng.random(shape) < 0.3] = np.nan
    got = R.pool_max(cells_of(spark, array), ["k"], F.lit(factor), F.lit(shape[0]), F.lit(shape[1]))
    first = got.first()
    expected = pooled(array, factor)
    assert (first.out_height, first.out_width) == expected.shape
    np.testing.assert_array_equal(array_of(got, *expected.shape), expected)


def test_pooling_keeps_peaks_and_missing_blocks(spark):
    array = np.zeros((4, 4))
    array[1, 1] = 45.0
    array[2:, 2:] = np.nan
    out = array_of(R.pool_max(cells_of(spark, array), ["k"], F.lit(2.0), F.lit(4), F.lit(4)), 2, 2)
    assert out[0, 0] == 45.0 and np.isnan(out[1, 1])


def test_window_index_is_exact_for_many_sizes(spark):
    sizes = [(n, f) for n in range(1, 200, 7) for f in (1.1, 1.5, 2.0, 2.5, 3.7)]
    df = spark.createDataFrame(sizes, "n int, f double").withColumn("out", grid.pooled_size(F.col("n"), F.col("f")))
    df = df.where("f > 1").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = df.select("n", "f", "out", "i", grid.window_index(F.col("i"), F.col("n"), F.col("out")).alias("w")).collect()
    for r in rows:
        bounds = np.rint(np.arange(r.out) * r.n / r.out)
        assert r.w == np.searchsorted(bounds, r.i, side="right") - 1, r


def test_composite_takes_the_strongest_echo(spark):
    a = cells_of(spark, [[10, np.nan], [np.nan, 5]])
    b = cells_of(spark, [[3, 7], [np.nan, 8]])
    for both in (a.union(b), b.union(a)):
        np.testing.assert_array_equal(array_of(C.max_cells(both, ["k"]), 2, 2), [[10, 7], [np.nan, 8]])


def test_clear_sky_loses_to_any_echo_and_wins_over_missing(spark):
    df = spark.createDataFrame([(0, 0, 0, float("-inf")), (0, 0, 0, -30.0), (0, 0, 1, float("-inf")), (0, 0, 1, None)], CELL)
    got = {r.col: r.value for r in C.max_cells(df, ["k"]).collect()}
    assert got == {0: -30.0, 1: float("-inf")}


def test_mixed_timestamps_are_an_error(spark):
    df = spark.createDataFrame([("g", "2026-06-05 00:00:00"), ("g", "2026-06-05 00:05:00")], "g string, t string").select("g", F.col("t").cast("timestamp_ntz").alias("frame_ts"))
    with pytest.raises(Exception, match="share a timestamp"):
        C.check_single_timestamp(df, ["g"]).collect()
    assert C.mixed_timestamp_groups(df, ["g"]).count() == 1


def test_variants_need_a_specification(spark):
    with pytest.raises(ValueError, match="variant"):
        R.variants(cells_of(spark, [[1.0]]), ["k"], (), F.lit(1), F.lit(1))


def test_centres_and_bounds(spark):
    grids = spark.createDataFrame([(0.0, 0.0, 1555.7, 1555.7, 20, 16)], "x_min double, y_max double, px double, py double, width int, height int")
    corner = P.inverse(grids, F.col("x_min") + 1254222.15, F.col("y_max") + 6702777.85, P.WEB_MERCATOR).first()
    assert abs(corner.lon - 11.2669) < 0.02 and abs(corner.lat - 51.4584) < 0.02


@pytest.mark.parametrize(
    "crs",
    [
        P.Crs("merc", x0=-1254222.15, y0=-6702777.85),
        P.Crs("laea", f=P.WGS84_FLATTENING, lat0=55.0, lon0=10.0, x0=1950000.0, y0=-2100000.0),
        P.Crs("laea", lat0=50.0, lon0=5.0),
        P.Crs("tmerc", f=P.WGS84_FLATTENING, lat0=42.0, lon0=12.5),
    ],
)
def test_projection_round_trip(spark, crs):
    places = spark.createDataFrame([(float(lon), float(lat)) for lon in range(-10, 35, 5) for lat in range(35, 72, 6)], "lon double, lat double")
    there = P.forward(places, F.col("lon"), F.col("lat"), crs)
    back = P.inverse(there, F.col("x"), F.col("y"), crs, ("lon2", "lat2"))
    worst = back.select(F.max(F.greatest(F.abs(F.col("lon") - F.col("lon2")), F.abs(F.col("lat") - F.col("lat2")))).alias("e")).first().e
    assert worst * 111_320 < 1e-6


def test_known_projected_coordinates(spark):
    # Zone 33 north: the central meridian's false easting, and the length of the
    # meridian quadrant to 45 degrees (4984944.378 m) scaled by 0.9996.
    utm = P.Crs("tmerc", f=P.WGS84_FLATTENING, lon0=15.0, k=0.9996, x0=500000.0)
    row = P.forward(spark.range(1), F.lit(15.0), F.lit(45.0), utm).first()
    assert row.x == pytest.approx(500000.0, abs=1e-6)
    assert row.y == pytest.approx(4984944.378 * 0.9996, abs=1e-2)
    # The European equal-area grid: its origin, and a published test point.
    laea = P.Crs("laea", a=6378137.0, f=1 / 298.257222101, lat0=52.0, lon0=10.0, x0=4321000.0, y0=3210000.0)
    row = P.forward(spark.range(1), F.lit(5.0), F.lit(50.0), laea).first()
    assert (row.x, row.y) == (pytest.approx(3962799.45, abs=0.01), pytest.approx(2999718.85, abs=0.01))


def test_proj4_text():
    crs = P.parse_proj4("+proj=laea +lat_0=55 +lon_0=10 +x_0=1950000 +y_0=-2100000 +ellps=WGS84 +units=m")
    assert (crs.kind, crs.lat0, crs.x0, crs.f) == ("laea", 55.0, 1950000.0, P.WGS84_FLATTENING)
    merc = P.parse_proj4("+proj=merc +a=6378137 +b=6378137 +x_0=-1254222.15 +y_0=-6702777.85")
    assert (merc.kind, merc.f, merc.y0) == ("merc", 0.0, -6702777.85)
    with pytest.raises(ValueError, match="unsupported"):
        P.parse_proj4("+proj=ortho +lat_0=0")


def test_mercator_source_reproduces_its_grid(spark):
    crs = P.Crs("merc", x0=-1254222.15, y0=-6702777.85)
    frames = spark.createDataFrame([("p", "i", 0.0, 0.0, 1555.7, 1555.7, 20, 16)], GRID_DDL)
    box = R.perimeter_bbox(frames, ["product_id"], crs)
    spec = R.target_grid(box.join(R.finest_cell(frames, ["product_id"], crs), "product_id")).first()
    assert (spec.height, spec.width) == (16, 20)
    assert spec.px == pytest.approx(1555.7, rel=1e-9)


def test_plate_carree_source_gains_rows(spark):
    frames = spark.createDataFrame([("p", "i", 0.0, 60.0, 0.1, 0.1, 100, 200)], GRID_DDL)
    box = R.perimeter_bbox(frames, ["product_id"], P.LONLAT)
    spec = R.target_grid(box.join(R.finest_cell(frames, ["product_id"], P.LONLAT), "product_id")).first()
    assert abs(spec.width - 100) <= 2 and spec.height > 200


def test_cells_out_of_the_source_domain_are_missing(spark):
    crs = P.Crs("laea", lat0=0.0, lon0=0.0)
    sources = spark.createDataFrame([("p", "i", -6.0e6, 6.0e6, 6.0e5, 6.0e5, 20, 20)], GRID_DDL)
    targets = spark.createDataFrame([("p", -2.0e7, 2.0e7, 1.0e6, 1.0e6, 40, 40)], "product_id string, x_min double, y_max double, px double, py double, width int, height int")
    share = R.sampling_index(targets, sources, {"i": crs}, ["product_id"]).count() / 1600
    assert 0 < share < 0.5


def test_resampling_matches_numpy(spark):
    """Nearest sampling of two frames from an equal-area source against a direct computation."""
    rng = np.random.default_rng(5)
    frames = {k: rng.normal(size=(30, 40)) for k in (0, 1)}
    lat0, lon0 = 50.0, 10.0
    crs = P.Crs("laea", lat0=lat0, lon0=lon0)
    sources = spark.createDataFrame([("p", "i", -400000.0, 300000.0, 20000.0, 20000.0, 40, 30)], GRID_DDL)
    targets = spark.createDataFrame([("p", 600000.0, 6900000.0, 25000.0, 25000.0, 45, 50)], "product_id string, x_min double, y_max double, px double, py double, width int, height int")
    cells = cells_of(spark, frames[0], 0).union(cells_of(spark, frames[1], 1)).withColumn("input_id", F.lit("i"))
    got = R.composite_to_grid(cells, targets, sources, {"i": crs}, ["product_id"], ["k"])
    x = 600000.0 + (np.arange(45) + 0.5) * 25000.0
    y = 6900000.0 - (np.arange(50) + 0.5) * 25000.0
    xx, yy = np.meshgrid(x, y)
    lam, phi = xx / 6378137.0, np.pi / 2 - 2 * np.arctan(np.exp(-yy / 6378137.0))
    p0, l0 = math.radians(lat0), math.radians(lon0)
    b = 6378137.0 * np.sqrt(2 / (1 + np.sin(p0) * np.sin(phi) + np.cos(p0) * np.cos(phi) * np.cos(lam - l0)))
    sx = b * np.cos(phi) * np.sin(lam - l0)
    sy = b * (np.cos(p0) * np.sin(phi) - np.sin(p0) * np.cos(phi) * np.cos(lam - l0))
    c, r = np.rint((sx + 400000.0) / 20000.0 - 0.5).astype(int), np.rint((300000.0 - sy) / 20000.0 - 0.5).astype(int)
    inside = (c >= 0) & (c < 40) & (r >= 0) & (r < 30)
    assert 0.1 < inside.mean() < 0.99
    for k in (0, 1):
        expected = np.where(inside, frames[k][np.clip(r, 0, 29), np.clip(c, 0, 39)], np.nan)
        np.testing.assert_allclose(array_of(got.where(F.col("k") == k), 50, 45), expected)


def test_frame_statistics(spark):
    array = np.array([[1.0, 2.0, np.nan], [4.0, 4.0, 9.5]])
    extra = spark.createDataFrame([(0, 5, 5, float("-inf"))], CELL)
    row = C.frame_stats(cells_of(spark, array).union(extra), ["k"], 20).first()
    finite = array[np.isfinite(array)]
    assert (row.cells, row.echoes, row.finite_fraction) == (7, 5, 0.25), "absent rows are cells without a value"
    close = spark.createDataFrame([(0, 0, 0, 1e8), (0, 0, 1, 1e8 + 0.001)], CELL)
    assert C.frame_stats(close, ["k"], 4).first().stdev_value == pytest.approx(0.001 / 2**0.5, rel=1e-3)
    assert row.median_value == np.median(finite)
    assert row.stdev_value == pytest.approx(finite.std(ddof=1))
