"""Motion, interpolation, warping and nowcasts against direct computations."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.operators import cells as C
from echogrid.operators import motion as M
from echogrid.operators import nearest as Nn
from echogrid.operators import warp as Wp
from echogrid.plans import nowcast as Now

from test_raster import array_of, cells_of


def blob(row, col, height=96, width=120, sigma=8.0):
    r, c = np.mgrid[0:height, 0:width]
    return 45.0 * np.exp(-((r - row) ** 2 + (c - col) ** 2) / (2 * sigma**2))


def stamped(spark, frames, key="f"):
    parts = None
    for i, frame in enumerate(frames):
        df = cells_of(spark, frame, i).select(
            F.lit(key).alias("forecast_id"), F.timestamp_add("MINUTE", F.lit(5 * i), F.lit("2026-06-05 00:00:00").cast("timestamp_ntz")).alias("frame_ts"), "row", "col", "value"
        )
        parts = df if parts is None else parts.unionByName(df)
    return parts


@pytest.fixture(scope="module")
def moving(spark):
    cells = stamped(spark, [blob(40 + 3 * i, 40 + 6 * i) for i in range(3)]).cache()
    return cells, cells.select("forecast_id", "frame_ts").distinct()


@pytest.mark.parametrize("method", ["lucas_kanade", "block_match"])
def test_vectors_follow_a_moving_blob(spark, moving, method):
    cells, history = moving
    rows = Now.motion_vectors(cells, history, ["forecast_id"], 96, 120, method, tile=64).collect()
    assert rows
    assert abs(np.median([r.u for r in rows]) - 6) < 0.5
    assert abs(np.median([r.v for r in rows]) - 3) < 0.5


def test_nowcast_moves_the_blob_on(spark, moving):
    cells, history = moving
    out = Now.nowcast(cells, history, ["forecast_id"], 96, 120, (10, 5, 10), floor=1.0, tile=64)
    assert {(r.lead_min, str(r.valid_ts)) for r in out.select("lead_min", "valid_ts").distinct().collect()} == {
        (5, "2026-06-05 00:15:00"), (10, "2026-06-05 00:20:00")
    }
    for lead, steps in ((5, 1), (10, 2)):
        got = array_of(out.where(F.col("lead_min") == lead), 96, 120)
        truth = blob(46 + 3 * steps, 52 + 6 * steps)
        both = np.isfinite(got)
        assert both.sum() > 500
        assert np.sqrt(np.mean((got[both] - truth[both]) ** 2)) < 3.0
    assert out.where("value <= 1.0").count() == 0


def test_coarse_motion_stays_close_to_full(spark, moving):
    cells, history = moving
    args = (cells, history, ["forecast_id"], 96, 120, (10,))
    full = array_of(Now.nowcast(*args, motion_grid_step=1, warp_grid_step=1, tile=64), 96, 120)
    coarse = array_of(Now.nowcast(*args, motion_grid_step=2, warp_grid_step=2, tile=64), 96, 120)
    both = np.isfinite(full) & np.isfinite(coarse)
    assert np.sqrt(np.mean((full[both] - coarse[both]) ** 2)) < 0.5


def test_persistence_keeps_values_in_place(spark, moving):
    cells, history = moving
    out = array_of(Now.nowcast(cells, history, ["forecast_id"], 96, 120, (10,), method="zero", tile=64), 96, 120)
    np.testing.assert_allclose(out, blob(46, 52), atol=1e-9)


def test_empty_newest_frame_gives_no_cells_but_all_frames(spark):
    empty = np.full((20, 20), np.nan)
    cells = stamped(spark, [blob(8, 8, 20, 20, 3), empty])
    history = cells.select("forecast_id", "frame_ts").distinct()
    assert Now.nowcast(cells, history, ["forecast_id"], 20, 20, (10, 20)).count() == 0
    listed = Now.forecast_frames(history, ["forecast_id"], (20, 10)).collect()
    assert sorted((r.lead_min, r.lead_steps) for r in listed) == [(10, 2.0), (20, 4.0)]


def test_history_errors(spark):
    one = stamped(spark, [np.ones((2, 2))]).select("forecast_id", "frame_ts").distinct()
    with pytest.raises(Exception, match="at least 2 history frames"):
        Now.history_steps(one, ["forecast_id"]).collect()
    with pytest.raises(Exception, match="increasing timestamps"):
        Now.history_steps(one.union(one), ["forecast_id"]).collect()
    with pytest.raises(ValueError, match="positive"):
        Now.lead_minutes((10, 0))
    assert Now.lead_minutes(()) == []
    with pytest.raises(ValueError, match="unknown motion method"):
        Now.motion_vectors(one, one, ["forecast_id"], 2, 2, "other")


def test_lead_steps_of_an_odd_spacing(spark):
    frames = spark.createDataFrame([("f", "2026-06-05 00:00:00"), ("f", "2026-06-05 00:07:00")], "forecast_id string, t string")
    history = frames.select("forecast_id", F.col("t").cast("timestamp_ntz").alias("frame_ts"))
    got = {r.lead_min: r.lead_steps for r in Now.forecast_frames(history, ["forecast_id"], (20, 10)).collect()}
    assert got == {10: pytest.approx(10 / 7), 20: pytest.approx(20 / 7)}


def test_two_issues_with_different_spacings_in_one_plan(spark):
    a = stamped(spark, [blob(20 + i, 20, 60, 60, 5) for i in range(2)], "a")
    b = stamped(spark, [blob(20 + i, 20, 60, 60, 5) for i in range(2)], "b").withColumn(
        "frame_ts", F.when(F.col("frame_ts") > F.lit("2026-06-05 00:00:00").cast("timestamp_ntz"), F.lit("2026-06-05 00:10:00").cast("timestamp_ntz")).otherwise(F.col("frame_ts"))
    )
    cells = a.unionByName(b)
    out = Now.nowcast(cells, cells.select("forecast_id", "frame_ts").distinct(), ["forecast_id"], 60, 60, (10,), floor=1.0)
    peak = {r.forecast_id: r.row for r in out.groupBy("forecast_id").agg(F.max_by("row", "value").alias("row")).collect()}
    assert abs(peak["a"] - 23) <= 1 and abs(peak["b"] - 22) <= 1


def brute_idw(points, xs, ys, mean_res, k=20):
    out = np.empty((len(ys), len(xs), 2))
    for i, y in enumerate(ys):
        for j, x in enumerate(xs):
            d = np.hypot(points[:, 0] - x, points[:, 1] - y)
            near = np.argsort(d, kind="stable")[:k]
            w = (d[near] / mean_res + 0.5) ** -0.5
            out[i, j] = (w[:, None] * points[near, 2:]).sum(0) / w.sum()
    return out


def test_interpolation_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    points = np.column_stack([rng.uniform(0, 200, (60, 2)), rng.normal(size=(60, 2))])
    vectors = spark.createDataFrame([("a", *map(float, p)) for p in points], "f string, x double, y double, u double, v double")
    grids = spark.createDataFrame([("a", 160, 200), ("none", 8, 8)], "f string, height int, width int")
    out = M.idw_grid(grids, vectors, ["f"], step=4, tile=16)
    expected = brute_idw(points, np.arange(0, 200, 4), np.arange(0, 160, 4), 4.0)
    for part, name in enumerate("uv"):
        np.testing.assert_allclose(array_of(out.where("f = 'a'"), 40, 50, name), expected[:, :, part], atol=1e-9)
    assert out.where("f = 'none' and u = 0 and v = 0").count() == 4


@pytest.mark.parametrize("kind", ["spread", "grid", "line", "clump", "same"])
def test_nearest_points_equal_brute_force(kind):
    rng = np.random.default_rng(4)
    n = 700
    px, py = {
        "spread": lambda: rng.uniform(0, 500, (2, n)), "grid": lambda: rng.integers(0, 25, (2, n)) * 4.0, "line": lambda: np.stack([rng.uniform(0, 300, n), np.full(n, 7.0)]),
        "clump": lambda: np.concatenate([rng.normal(0, 1, (2, n - 5)), rng.uniform(900, 1000, (2, 5))], axis=1), "same": lambda: np.full((2, n), 3.0),
    }[kind]()
    x, y = np.concatenate([rng.uniform(-100, 1100, (2, 300)), np.stack([px[:50], py[:50]]), rng.integers(0, 25, (2, 50)) * 4.0], axis=1)
    squared = (x[:, None] - px) ** 2 + (y[:, None] - py) ** 2
    for k in (1, 20, 699, 900):
        assert (Nn.Bins(px, py).nearest(x, y, k) == np.argsort(squared, axis=1, kind="stable")[:, :k]).all()
    own = (px[:, None] - px) ** 2 + (py[:, None] - py) ** 2
    np.fill_diagonal(own, np.inf)
    assert (Nn.Bins(px, py).nearest(px, py, 30, np.arange(n)) == np.argsort(own, axis=1, kind="stable")[:, :30]).all()


def test_the_cost_of_nearest_points_is_nearly_linear():
    def seconds(n):
        px, py = np.random.default_rng(1).uniform(0, 1000, (2, n))
        start = time.process_time()
        Nn.Bins(px, py).nearest(px, py, 20)
        return time.process_time() - start

    seconds(500)
    assert seconds(16_000) < 10 * max(seconds(4_000), 0.02)


def test_one_vector_and_equal_vectors_are_constant(spark):
    grids = spark.createDataFrame([("a", 4, 4), ("b", 4, 4)], "f string, height int, width int")
    rows = [("a", 1.0, 1.0, 2.0, 3.0), ("b", 0.0, 0.0, 5.0, 5.0), ("b", 3.0, 3.0, 5.0, 5.0)]
    out = M.idw_grid(grids, spark.createDataFrame(rows, "f string, x double, y double, u double, v double"), ["f"])
    assert {(r.f, r.u, r.v) for r in out.collect()} == {("a", 2.0, 3.0), ("b", 5.0, 5.0)}


def resize(array, h, w):
    sh, sw = array.shape
    y = np.clip((np.arange(h) + 0.5) * sh / h - 0.5, 0, sh - 1)[:, None]
    x = np.clip((np.arange(w) + 0.5) * sw / w - 0.5, 0, sw - 1)[None, :]
    return sample(array, *np.broadcast_arrays(y, x))


def sample(array, y, x):
    h, w = array.shape
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = y - y0, x - x0
    return (array[y0, x0] * (1 - fx) + array[y0, x1] * fx) * (1 - fy) + (array[y1, x0] * (1 - fx) + array[y1, x1] * fx) * fy


@pytest.mark.parametrize("shape, target", [((6, 5), (12, 10)), ((6, 5), (13, 11)), ((9, 8), (4, 3)), ((1, 4), (3, 4))])
def test_resizing_matches_numpy(spark, shape, target):
    array = np.random.default_rng(4).normal(size=shape)
    out = Wp.resize_bilinear(cells_of(spark, array), ["k"], ["value"], tuple(map(F.lit, shape)), tuple(map(F.lit, target)))
    np.testing.assert_allclose(array_of(out, *target), resize(array, *target), atol=1e-9)


def sample_values(array, y, x):
    h, w = array.shape
    out = np.zeros(y.shape)
    for (i, j), _ in np.ndenumerate(y):
        y0, x0 = int(np.floor(y[i, j])), int(np.floor(x[i, j]))
        fy, fx = y[i, j] - y0, x[i, j] - x0
        total = 0.0
        for r, c, wt in ((y0, x0, (1 - fy) * (1 - fx)), (y0, x0 + 1, (1 - fy) * fx), (y0 + 1, x0, fy * (1 - fx)), (y0 + 1, x0 + 1, fy * fx)):
            if wt > 0:
                total += wt * array[r, c] if 0 <= r < h and 0 <= c < w and np.isfinite(array[r, c]) else np.nan
        out[i, j] = total
    return out


def brute_extrapolate(values, u, v, leads, step):
    """The whole scheme on whole grids."""
    h, w = values.shape
    ch, cw = -(-h // step), -(-w // step)
    if step > 1:
        u, v = resize(u, ch, cw) / step, resize(v, ch, cw) / step
    rows, cols = np.mgrid[0 : u.shape[0], 0 : u.shape[1]].astype(float)
    dx, dy = np.zeros(u.shape), np.zeros(u.shape)
    diffs = np.diff([0.0, *leads])
    ix, iy = u * diffs[0], v * diffs[0]
    out = []
    for d in diffs:
        my, mx = rows + dy - iy / 2, cols + dx - ix / 2
        ix, iy = sample(u, my, mx) * d, sample(v, my, mx) * d
        dx, dy = dx - ix, dy - iy
        ix, iy = sample(u, rows + dy, cols + dx) * d, sample(v, rows + dy, cols + dx) * d
        fx, fy = (resize(dx, h, w) * step, resize(dy, h, w) * step) if step > 1 else (dx, dy)
        fr, fc = np.mgrid[0:h, 0:w].astype(float)
        out.append(sample_values(values, fr + fy, fc + fx))
    return out


@pytest.mark.parametrize("step, tile", [(1, 16), (2, 16), (2, 64), (3, 20)])
def test_extrapolation_matches_whole_grid_scheme(spark, step, tile):
    h, w = 41, 53
    rng = np.random.default_rng(7)
    values = rng.normal(20, 5, size=(h, w))
    values[rng.random((h, w)) < 0.05] = np.nan
    r, c = np.mgrid[0:h, 0:w]
    u, v = 0.02 * (r - h / 2) * 3 + 1.3, -0.02 * (c - w / 2) * 3 - 0.4
    leads = [1.0, 2.5, 4.0]
    velocity = spark.createDataFrame([(0, int(i), int(j), float(u[i, j]), float(v[i, j])) for i in range(h) for j in range(w)], "k int, row int, col int, u double, v double")
    out = Wp.extrapolate(cells_of(spark, values), velocity, ["k"], leads, h, w, grid_step=step, tile=tile)
    for number, expected in enumerate(brute_extrapolate(values, u, v, leads, step)):
        np.testing.assert_allclose(array_of(out.where(F.col("lead") == number), h, w), expected, atol=1e-9)


@pytest.mark.parametrize("tile", [16, 64])
def test_vectors_extrapolate_as_their_velocity_field_does(spark, tile):
    h, w = 41, 53
    rng = np.random.default_rng(8)
    values = cells_of(spark, rng.normal(20, 5, size=(h, w)))
    rows = [(0, float(x), float(y), float(rng.normal(2, 1)), float(rng.normal(-1, 1))) for x in range(5, 53, 12) for y in range(4, 41, 9)]
    vectors = spark.createDataFrame(rows, "k int, x double, y double, u double, v double")
    grids = spark.createDataFrame([(0, h, w)], "k int, height int, width int")
    velocity = M.idw_grid(grids, vectors, ["k"], step=2, upscale=True, tile=tile)
    whole = Wp.extrapolate(values, velocity, ["k"], [1.0, 3.0], h, w, grid_step=2, tile=tile)
    local = M.extrapolate_vectors(values, vectors, grids.select("k"), ["k"], [1.0, 3.0], h, w, 2, 2, tile)
    for lead in (0, 1):
        a, b = (array_of(df.where(F.col("lead") == lead), h, w) for df in (whole, local))
        np.testing.assert_allclose(a, b, atol=1e-9)


def test_extrapolation_leads_must_ascend(spark):
    df = cells_of(spark, [[1.0]])
    with pytest.raises(ValueError, match="ascending"):
        Wp.extrapolate(df, df, ["k"], [2.0, 1.0], 1, 1)


def test_outliers_go_and_neighbours_stay(spark):
    rng = np.random.default_rng(9)
    rows = [("a", float(x), float(y), 5 + rng.normal(0, 0.1), 2 + rng.normal(0, 0.1)) for x in range(6) for y in range(6)]
    rows.append(("a", 2.5, 2.5, 60.0, -40.0))
    kept = M.drop_outliers(spark.createDataFrame(rows, "f string, x double, y double, u double, v double"), ["f"]).collect()
    assert len(kept) >= 33 and all(r.u < 10 for r in kept)


def test_decluster_takes_medians(spark):
    rows = [("a", 1.0, 1.0, 1.0, 0.0), ("a", 3.0, 5.0, 3.0, 0.0), ("a", 5.0, 9.0, 9.0, 0.0), ("a", 25.0, 1.0, 7.0, 1.0)]
    got = M.decluster(spark.createDataFrame(rows, "f string, x double, y double, u double, v double"), ["f"]).collect()
    assert {(r.x, r.y, r.u, r.v) for r in got} == {(3.0, 5.0, 3.0, 0.0), (25.0, 1.0, 7.0, 1.0)}


def test_motion_step_rules():
    assert Now.motion_step(100, 200, 2) == 2
    assert Now.motion_step(100, 1000, 2, grid_max=250) == 4
    assert Now.motion_step(3, 200, 4) == 1, "a grid under two coarse rows stays full"


def test_masked_rmse(spark):
    a, b = cells_of(spark, [[1.0, 2.0, np.nan]]), cells_of(spark, [[2.0, 2.0, 5.0]])
    row = C.masked_rmse(a, b, ["k"]).first()
    assert (row.cells, row.rmse, row.differing) == (2, pytest.approx(np.sqrt(0.5)), 0.5)


MOVES = [(0, 25), (-31, 12), (3, -4), (0, 0), (50, 0), (0, -80), (-50, 62), (39, 39), (97, 30)]


@pytest.mark.parametrize("tile", [64, 256])
def test_fast_and_slow_blobs_are_tracked(spark, tile):
    y, x = np.mgrid[0:260, 0:300]
    spot = lambda r, c: 200 * np.exp(-(((y - r) / 4.0) ** 2 + ((x - c) / 6.0) ** 2))
    rows = []
    for pair, (dy, dx) in enumerate(MOVES):
        prev, nxt = spot(120, 150), spot(120 + dy, 150 + dx)
        r, c = np.nonzero((prev > 1e-3) | (nxt > 1e-3))
        rows += [(pair, int(i), int(j), float(prev[i, j]), float(nxt[i, j])) for i, j in zip(r, c)]
    pairs = spark.createDataFrame(rows, "pair int, row int, col int, prev double, next double")
    marks = spark.createDataFrame([(p, r, c) for p in range(len(MOVES)) for r, c in ((120, 150), (118, 153))], "pair int, row int, col int")
    got = M.track_features(pairs, marks, ["pair"], 260, 300, tile=tile).collect()
    assert len(got) == 2 * len(MOVES)
    for r in got:
        assert (r.v, r.u) == pytest.approx(MOVES[r.pair], abs=0.1)


def test_what_is_gone_is_not_tracked(spark):
    rng = np.random.default_rng(5)
    r, c = np.mgrid[0:80, 0:90]
    prev, noise = 200 * np.exp(-(((r - 40) / 4.0) ** 2 + ((c - 45) / 6.0) ** 2)), rng.normal(100, 40, (80, 90))
    cells = [(k, int(i), int(j), float(prev[i, j]), v) for i in range(80) for j in range(90) for k, v in ((0, 0.0), (1, float(noise[i, j])), (2, float(prev[i, j])))]
    pairs = spark.createDataFrame(cells, "pair int, row int, col int, prev double, next double")
    marks = spark.createDataFrame([(k, 40, 45) for k in range(3)], "pair int, row int, col int")
    assert [(v.pair, v.u, v.v) for v in M.track_features(pairs, marks, ["pair"], 80, 90).collect()] == [(2, 0.0, 0.0)]


def test_the_pyramid_reaches_across_the_grid():
    for size in (10, 41, 400, 2000):
        depth = M.pyramid_depth(size, size // 2, M.SEARCH_RADIUS, M.COARSE)
        assert M.SEARCH_RADIUS * M.COARSE << depth >= size and (depth == 0 or M.SEARCH_RADIUS * M.COARSE << depth - 1 < size)


def test_settings_of_each_issue_are_their_own(spark):
    frames = {"a": [blob(20 + i, 20, 60, 60, 5) for i in range(2)], "b": [blob(30 + 2 * i, 40 - i, 90, 70, 5) for i in range(3)], "c": [blob(8, 8, 20, 24, 3)] * 2, "d": [blob(8, 8, 20, 24, 3)] * 2}
    cells = None
    for key, some in frames.items():
        df = stamped(spark, some, key)
        cells = df if cells is None else cells.unionByName(df)
    settings = spark.createDataFrame(
        [("a", 60, 60, 1.0, "lucas_kanade", [10, 5, 10], 2, 2), ("b", 90, 70, 20.0, "block_match", [15], 1, 2), ("c", 20, 24, None, "zero", [5, 60], 2, 2)],
        "forecast_id string, height int, width int, floor double, method string, leads array<int>, motion_grid_step int, warp_grid_step int",
    )
    history = cells.select("forecast_id", "frame_ts").distinct()
    got = Now.nowcast_all(cells, history, settings, ["forecast_id"], tile=64).cache()
    assert {(r.forecast_id, r.lead_min) for r in got.select("forecast_id", "lead_min").distinct().collect()} == {("a", 5), ("a", 10), ("b", 15), ("c", 5), ("c", 60)}
    for key, height, width, minutes, floor, method, steps in (("a", 60, 60, (5, 10), 1.0, "lucas_kanade", (2, 2)), ("b", 90, 70, (15,), 20.0, "block_match", (1, 2)), ("c", 20, 24, (5, 60), None, "zero", (2, 2))):
        own = [df.where(F.col("forecast_id") == key) for df in (cells, history, got)]
        alone = Now.nowcast(own[0], own[1], ["forecast_id"], height, width, minutes, floor, method, *steps, tile=64)
        rows = lambda df: sorted((r.lead_min, str(r.valid_ts), r.row, r.col, r.value) for r in df.collect())
        assert rows(own[2]) == rows(alone) and rows(alone)
        assert floor is None or all(v[4] > floor for v in rows(alone))
    got.unpersist()


@pytest.mark.parametrize(("field", "value", "message"), [("method", "other", "unknown motion method other"), ("leads", [10, 0], "positive")])
def test_settings_are_checked(spark, field, value, message):
    cells = stamped(spark, [np.ones((4, 4))] * 2)
    row = {"forecast_id": "f", "height": 4, "width": 4, "floor": None, "method": "zero", "leads": [5], "motion_grid_step": 1, "warp_grid_step": 1} | {field: value}
    settings = spark.createDataFrame([tuple(row.values())], "forecast_id string, height int, width int, floor double, method string, leads array<int>, motion_grid_step int, warp_grid_step int")
    with pytest.raises(Exception, match=message):
        Now.nowcast_all(cells, cells.select("forecast_id", "frame_ts").distinct(), settings, ["forecast_id"]).collect()
