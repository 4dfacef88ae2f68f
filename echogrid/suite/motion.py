"""Queries over motion, interpolation, warping and nowcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid
from ..functions import values as V
from ..operators import cells as C
from ..operators import motion as M
from ..operators import neighbourhood as N
from ..operators import warp as Wp
from ..plans import nowcast as Now
from ..session import cut_lineage
from . import query
from .raster import _LEVELS, TILE, prepared
from .views import AXIS, GRID, OBS, SCAN, scan, table


def pair_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans with an echo whose successor has one too."""
    frames = scan(spark, sf_dir).where(V.is_echo(F.col("value"))).select(F.lit(1).alias("all"), "k").distinct()
    return frames.join(frames.select("all", (F.col("k") - 1).alias("k")), ["all", "k"]).select(
        "all", F.col("k").alias("pair"), F.col("k").alias("first_seq"), (F.col("k") + 1).alias("second_seq")
    )


def level_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scan beside the next one, as byte levels."""
    levels = C.rescale_to_byte(prepared(spark, sf_dir), ["k"]).withColumn("all", F.lit(1))
    return M.frame_pairs(levels, pair_order(spark, sf_dir), ["all"], "k").drop("all")


_PAIRS = _LEVELS + """, img AS (SELECT low.k, a.i AS r, b.i AS c, coalesce(l.level, 0) AS level
  FROM low CROSS JOIN axis a CROSS JOIN axis b LEFT JOIN lev l ON l.k = low.k AND l.r = a.i AND l.c = b.i)"""


@query(
    "block_match",
    f"""WITH {_PAIRS}, off AS (SELECT CAST(i AS INTEGER) AS d FROM range(-2, 3) t(i)),
    costs AS (SELECT p.k AS pair, p.r // 8 AS br, p.c // 8 AS bc, a.d AS dr, b.d AS dc, avg(pow(CAST(p.level - n.level AS DOUBLE), 2)) AS cost
      FROM img p CROSS JOIN off a CROSS JOIN off b JOIN img n ON n.k = p.k + 1 AND n.r = p.r + a.d AND n.c = p.c + b.d GROUP BY ALL)
    SELECT pair, CAST(br AS INTEGER) AS block_r, CAST(bc AS INTEGER) AS block_c, dr, dc, round(cost, 6) AS cost FROM costs
    QUALIFY row_number() OVER (PARTITION BY pair, br, bc ORDER BY cost, dr * dr + dc * dc, dr, dc) = 1""",
)
def block_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = M.block_match(level_pairs(spark, sf_dir), ["pair"], GRID, GRID, block=8, radius=2, tile=TILE, frames=pair_order(spark, sf_dir))
    return best.withColumn("cost", F.round("cost", 6))


def features_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = C.rescale_to_byte(prepared(spark, sf_dir), ["k"])
    scores = N.corner_score(levels, ["k"], GRID, GRID, tile=TILE)
    return N.select_features(scores, ["k"], GRID, GRID).withColumnRenamed("k", "pair")


@query("track_features")
def track_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse vectors of the selected features of every scan pair."""
    vectors = M.track_features(level_pairs(spark, sf_dir), features_of_pairs(spark, sf_dir), ["pair"], GRID, GRID, radius=4, half=3, tile=TILE, frames=pair_order(spark, sf_dir))
    return vectors.select("pair", *[F.round(name, 6).alias(name) for name in ("x", "y", "u", "v")])


def cell_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One made-up vector per echo cell, a function of the cell and its value."""
    source = scan(spark, sf_dir).where("value > -100")
    return source.select(
        "k", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"),
        ((F.col("value") + F.col("row")) / 16).alias("u"), ((F.col("value") - F.col("col")) / 32).alias("v"),
    )


_VECTORS = SCAN + """, vec AS (SELECT k, CAST("col" AS DOUBLE) AS x, CAST("row" AS DOUBLE) AS y, (value + "row") / 16 AS u, (value - "col") / 32 AS v
  FROM scan WHERE value > -100)"""
_DECLUSTERED = _VECTORS + """, dec AS (SELECT k, median(x) AS x, median(y) AS y, median(u) AS u, median(v) AS v FROM vec GROUP BY k, floor(x / 4), floor(y / 4))"""


@query("decluster_median", f"WITH {_DECLUSTERED} SELECT k, x, y, u, v FROM dec")
def decluster_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.decluster(cell_vectors(spark, sf_dir), ["k"], scale=4)


@query(
    "vector_outliers",
    f"""WITH {_DECLUSTERED}, n AS (SELECT k, count(*) AS n FROM dec GROUP BY k),
    near AS (SELECT a.*, b.u AS bu, b.v AS bv, row_number() OVER (PARTITION BY a.k, a.x, a.y ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.y, b.x, b.u, b.v) AS pos
      FROM dec a JOIN dec b ON a.k = b.k AND (a.x <> b.x OR a.y <> b.y)),
    m AS (SELECT k, x, y, u, v, u - avg(bu) AS du, v - avg(bv) AS dv, var_samp(bu) AS a, covar_samp(bu, bv) AS b, var_samp(bv) AS c
      FROM near JOIN n USING (k) WHERE n > 3 AND pos <= least(13, n) - 1 GROUP BY k, x, y, u, v)
    SELECT k, x, y, u, v FROM m WHERE CASE WHEN a * c - b * b > 1e-12 THEN c * du * du - 2 * b * du * dv + a * dv * dv <= 4 * (a * c - b * b)
      ELSE abs(du) <= 2 * sqrt(a) + 1e-9 AND abs(dv) <= 2 * sqrt(c) + 1e-9 END
    UNION ALL SELECT k, x, y, u, v FROM dec JOIN n USING (k) WHERE n <= 3""",
)
def vector_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declustered vectors without those far from their neighbours."""
    return M.drop_outliers(M.decluster(cell_vectors(spark, sf_dir), ["k"], scale=4), ["k"], std=2.0, neighbours=12)


def scan_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).select("k").distinct().withColumns({"height": F.lit(GRID), "width": F.lit(GRID)})


_IDW = _DECLUSTERED + """, node AS (SELECT k, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM (SELECT DISTINCT k FROM scan), range(16) a(r), range(16) b(c)),
near AS (SELECT node.k, r, c, u, v, sqrt(pow(x - 2 * c, 2) + pow(y - 2 * r, 2)) AS d, row_number() OVER (PARTITION BY node.k, r, c ORDER BY pow(x - 2 * c, 2) + pow(y - 2 * r, 2), x, y, u, v) AS pos
  FROM node JOIN dec USING (k)),
idw AS (SELECT k, r, c, sum(u * pow(d / 2 + 0.5, -0.5)) / sum(pow(d / 2 + 0.5, -0.5)) AS u, sum(v * pow(d / 2 + 0.5, -0.5)) / sum(pow(d / 2 + 0.5, -0.5)) AS v FROM near WHERE pos <= 20 GROUP BY ALL)"""


@query("idw_grid", f"""WITH {_IDW} SELECT k, r AS "row", c AS "col", round(u, 6) AS u, round(v, 6) AS v FROM idw""")
def idw_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocity on every second cell from the declustered vectors."""
    dense = M.idw_grid(scan_grids(spark, sf_dir), M.decluster(cell_vectors(spark, sf_dir), ["k"], scale=4), ["k"], step=2, tile=TILE // 2)
    return dense.withColumns({"u": F.round("u", 6), "v": F.round("v", 6)})


_TAPS = """SELECT CAST(t AS INTEGER) AS t, CAST(floor(p) AS INTEGER) AS lo, least(CAST(floor(p) AS INTEGER) + 1, 15) AS hi, p - floor(p) AS f
  FROM (SELECT t, least(greatest((t + 0.5::DOUBLE) * 16 / 32 - 0.5, 0), 15) AS p FROM range(32) x(t))"""
_RESIZED = _IDW + f""", tap AS ({_TAPS}), tw AS (SELECT t, lo AS s, 1 - f AS w FROM tap UNION ALL SELECT t, hi, f FROM tap),
big AS (SELECT k, a.t AS r, b.t AS c, sum(u * a.w * b.w) AS u, sum(v * a.w * b.w) AS v FROM idw JOIN tw a ON a.s = idw.r JOIN tw b ON b.s = idw.c GROUP BY ALL)"""


@query("bilinear_resize", f"""WITH {_RESIZED} SELECT k, r AS "row", c AS "col", round(u, 6) AS u, round(v, 6) AS v FROM big""")
def bilinear_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarse velocity resized to full cells as a table operator."""
    dense = M.idw_grid(scan_grids(spark, sf_dir), M.decluster(cell_vectors(spark, sf_dir), ["k"], scale=4), ["k"], step=2, tile=TILE)
    full = Wp.resize_bilinear(dense, ["k"], ["u", "v"], (F.lit(16), F.lit(16)), (F.lit(GRID), F.lit(GRID)))
    return full.withColumns({"u": F.round("u", 6), "v": F.round("v", 6)})


@query("idw_upscaled", f"""WITH {_RESIZED} SELECT k, r AS "row", c AS "col", round(u, 6) AS u, round(v, 6) AS v FROM big""")
def idw_upscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same field, interpolated and resized without moving a cell between tasks."""
    dense = M.idw_grid(scan_grids(spark, sf_dir), M.decluster(cell_vectors(spark, sf_dir), ["k"], scale=4), ["k"], step=2, upscale=True, tile=TILE)
    return dense.withColumns({"u": F.round("u", 6), "v": F.round("v", 6)})


def displaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling positions off every cell, some past the grid edge."""
    return scan(spark, sf_dir).select(
        "k", "row", "col", (F.col("row") + (F.col("k") % 5) / 4.0 - 0.75).alias("sy"), (F.col("col") - (F.col("k") % 7) / 4.0 + 0.5).alias("sx")
    )


_POINTS = SCAN + """, pts AS (SELECT k, "row" AS r, "col" AS c, "row" + (k % 5) / 4.0::DOUBLE - 0.75 AS sy, "col" - (k % 7) / 4.0::DOUBLE + 0.5 AS sx FROM scan)"""


@query(
    "warp_values",
    f"""WITH {_POINTS}, four AS (SELECT k, r, c, CAST(floor(sy) AS INTEGER) + dr AS rr, CAST(floor(sx) AS INTEGER) + dc AS cc,
      CASE dr WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END * CASE dc WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END AS w FROM pts, (VALUES (0,0),(0,1),(1,0),(1,1)) d(dr, dc))
    SELECT four.k, r AS "row", c AS "col", CASE WHEN bool_and(coalesce(isfinite(s.value), false)) THEN round(sum(CASE WHEN isfinite(s.value) THEN s.value * w END), 6) END AS value
    FROM four LEFT JOIN scan s ON s.k = four.k AND s."row" = rr AND s."col" = cc WHERE w > 0 GROUP BY ALL""",
)
def warp_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at displaced positions: any missing tap with weight makes the result missing."""
    warped = Wp.sample_bilinear(displaced(spark, sf_dir), scan(spark, sf_dir), ["k"], ["value"], F.lit(GRID), F.lit(GRID), replicate=False)
    return warped.withColumn("value", F.round("value", 6))


@query(
    "warp_velocity",
    f"""WITH {_POINTS}, {AXIS}, fld AS (SELECT k, a.i AS r, b.i AS c, (a.i * 3 + b.i + k) / 8.0::DOUBLE AS u FROM (SELECT DISTINCT k FROM scan), axis a, axis b),
    cl AS (SELECT k, r, c, least(greatest(sy, 0), 31) AS sy, least(greatest(sx, 0), 31) AS sx FROM pts),
    four AS (SELECT k, r, c, least(CAST(floor(sy) AS INTEGER) + dr, 31) AS rr, least(CAST(floor(sx) AS INTEGER) + dc, 31) AS cc,
      CASE dr WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END * CASE dc WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END AS w FROM cl, (VALUES (0,0),(0,1),(1,0),(1,1)) d(dr, dc))
    SELECT four.k, four.r AS "row", four.c AS "col", round(sum(u * w), 6) AS u FROM four JOIN fld ON fld.k = four.k AND fld.r = rr AND fld.c = cc WHERE w > 0 GROUP BY ALL""",
)
def warp_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A velocity field at displaced positions, clamped to the grid."""
    field = C.target_cells(scan_grids(spark, sf_dir)).select("k", "row", "col", ((F.col("row") * 3 + F.col("col") + F.col("k")) / 8.0).alias("u"))
    warped = Wp.sample_bilinear(displaced(spark, sf_dir), field, ["k"], ["u"], F.lit(GRID), F.lit(GRID), replicate=True)
    return warped.withColumn("u", F.round("u", 6))


@query(
    "extrapolate_uniform",
    f"""WITH {SCAN}, pts AS (SELECT k, l.lead, l.t, r.i AS r, c.i AS c, r.i - 0.5::DOUBLE * l.t AS sy, c.i - (-0.25::DOUBLE) * l.t AS sx
      FROM (SELECT DISTINCT k FROM scan), (SELECT CAST(i AS INTEGER) AS i FROM range({GRID}) a(i)) r, (SELECT CAST(i AS INTEGER) AS i FROM range({GRID}) b(i)) c, (VALUES (0, 2.0), (1, 4.0), (2, 7.0)) l(lead, t)),
    four AS (SELECT k, lead, r, c, CAST(floor(sy) AS INTEGER) + dr AS rr, CAST(floor(sx) AS INTEGER) + dc AS cc,
      CASE dr WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END * CASE dc WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END AS w FROM pts, (VALUES (0,0),(0,1),(1,0),(1,1)) d(dr, dc))
    SELECT four.k, lead, r AS "row", c AS "col", round(sum(s.value * w), 6) AS value FROM four LEFT JOIN scan s ON s.k = four.k AND s."row" = rr AND s."col" = cc
    WHERE w > 0 GROUP BY ALL HAVING bool_and(coalesce(isfinite(s.value), false))""",
)
def extrapolate_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extrapolation under a uniform motion, whose result is a plain shift."""
    values = scan(spark, sf_dir)
    velocity = C.target_cells(scan_grids(spark, sf_dir)).select("k", "row", "col", F.lit(-0.25).alias("u"), F.lit(0.5).alias("v"))
    moved = Wp.extrapolate(values, velocity, ["k"], [2.0, 4.0, 7.0], GRID, GRID, grid_step=1, tile=TILE)
    return moved.withColumn("value", F.round("value", 6))


def scan_history(spark: SparkSession, sf_dir: str, frames: int = 3) -> DataFrame:
    """Non-overlapping runs of scans as forecast histories, five minutes apart."""
    stamped = scan(spark, sf_dir).select("k").distinct()
    return stamped.select(F.floor(F.col("k") / frames).cast("int").alias("forecast"), frame_time(F.col("k")).alias("frame_ts"))


def frame_time(k):
    return F.timestamp_add("MINUTE", k * 5, F.lit("2026-06-05 00:00:00").cast("timestamp_ntz"))


@query("extrapolate_vectors")
def extrapolate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans moved along velocities interpolated from the declustered vectors, three leads."""
    vectors = cut_lineage(M.decluster(cell_vectors(spark, sf_dir), ["k"], scale=4))
    frames = cut_lineage(scan(spark, sf_dir).select("k").distinct())
    moved = M.extrapolate_vectors(scan(spark, sf_dir), vectors, frames, ["k"], [0.5, 1.0, 2.0], GRID, GRID, 2, 2, TILE)
    return moved.withColumn("value", F.round("value", 6))


@query(
    "extrapolate_packed",
    f"""WITH {SCAN}, pts AS (SELECT k, l.lead, r.i AS r, c.i AS c, r.i - (0.25::DOUBLE * (k % 3)) * l.t AS sy, c.i - (-0.5::DOUBLE) * l.t AS sx
      FROM (SELECT DISTINCT k FROM scan), (SELECT CAST(i AS INTEGER) AS i FROM range({GRID}) a(i)) r, (SELECT CAST(i AS INTEGER) AS i FROM range({GRID}) b(i)) c, (VALUES (0, 2.0), (1, 6.0)) l(lead, t)),
    four AS (SELECT k, lead, r, c, CAST(floor(sy) AS INTEGER) + dr AS rr, CAST(floor(sx) AS INTEGER) + dc AS cc,
      CASE dr WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END * CASE dc WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END AS w FROM pts, (VALUES (0,0),(0,1),(1,0),(1,1)) d(dr, dc))
    SELECT four.k, lead, r AS "row", c AS "col", round(sum(s.value * w), 6) AS value FROM four LEFT JOIN scan s ON s.k = four.k AND s."row" = rr AND s."col" = cc
    WHERE w > 0 GROUP BY ALL HAVING bool_and(coalesce(isfinite(s.value), false))""",
)
def extrapolate_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans moved along packed vectors that are the same all over a scan, which is a plain shift."""
    places = M.decluster(cell_vectors(spark, sf_dir), ["k"], scale=4)
    vectors = cut_lineage(places.select("k", "x", "y", F.lit(-0.5).alias("u"), (F.col("k") % 3 * 0.25).cast("double").alias("v")))
    frames = cut_lineage(scan(spark, sf_dir).select("k").distinct())
    moved = M.extrapolate_vectors(scan(spark, sf_dir), vectors, frames, ["k"], [2.0, 6.0], GRID, GRID, 1, 1, TILE)
    return moved.withColumn("value", F.round("value", 6))


@query("nowcast")
def nowcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full nowcast of every run of three scans, six leads."""
    return run_nowcast(spark, sf_dir, "lucas_kanade")


@query(
    "nowcast_persistence",
    f"""WITH {SCAN}, h AS (SELECT CAST(k // 3 AS INTEGER) AS forecast, max(k) AS k FROM scan GROUP BY k // 3 HAVING count(DISTINCT k) >= 2)
    SELECT forecast, CAST(m AS INTEGER) AS lead_min, "row", "col", value, TIMESTAMP '2026-06-05' + INTERVAL 5 MINUTE * k AS issue_ts,
      TIMESTAMP '2026-06-05' + INTERVAL 5 MINUTE * k + INTERVAL 1 MINUTE * m AS valid_ts
    FROM h JOIN scan USING (k), (VALUES (10), (20), (30), (40), (50), (60)) l(m) WHERE value > 4""",
)
def nowcast_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without motion: the newest scan at every lead."""
    return run_nowcast(spark, sf_dir, "zero")


def run_nowcast(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    cells = scan(spark, sf_dir).select(
        F.floor(F.col("k") / 3).cast("int").alias("forecast"), frame_time(F.col("k")).alias("frame_ts"), "row", "col", "value"
    )
    history = whole_runs(scan_history(spark, sf_dir))
    out = Now.nowcast(cells, history, ["forecast"], GRID, GRID, (10, 20, 30, 40, 50, 60), floor=4.0, method=method, tile=TILE)
    return out.withColumn("value", F.round("value", 6))


# Scans laid into grids of their own, moving by whole cells: by remainder of the scan's number the grid,
# where the scan's corner lies, cells down and right a frame, method, floor and leads.
MOVING = (
    (0, 32, 32, 0, 0, 0, 0, "zero", 4.0, (10, 20, 30, 40, 50, 60), 2),
    (1, 72, 80, 16, 20, 1, 2, "lucas_kanade", 8.0, (20, 5, 10, 5), 1),
    (2, 96, 72, 30, 20, -2, 1, "block_match", None, (30, 10), 1),
)
_MOVING = ", ".join(f"({k}, {h}, {w}, {r}, {c}, {dr}, {dc}, {'NULL' if low is None else low}::DOUBLE, [{', '.join(map(str, sorted(set(leads))))}])" for k, h, w, r, c, dr, dc, _, low, leads, _ in MOVING)


@query(
    "nowcast_grids",
    f"""WITH {SCAN}, {AXIS}, kind(of, h, w, r0, c0, dr, dc, low, leads) AS (VALUES {_MOVING}),
    full_scan AS (SELECT f.k, a.i AS r, b.i AS c, CASE WHEN isfinite(s.value) THEN s.value ELSE CAST((a.i * a.i * 7 + b.i * b.i * 13 + a.i * b.i * 3 + f.k) % 45 AS DOUBLE) END AS value
      FROM (SELECT DISTINCT k FROM scan) f CROSS JOIN axis a CROSS JOIN axis b LEFT JOIN scan s ON s.k = f.k AND s."row" = a.i AND s."col" = b.i),
    moved AS (SELECT k, m, h, w, low, r + r0 + dr * m // 5 AS r, c + c0 + dc * m // 5 AS c, value FROM full_scan JOIN kind ON of = k % 3, unnest(leads) l(m))
    SELECT k AS forecast, CAST(m AS INTEGER) AS lead_min, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS "col", round(value, 6) AS value,
      TIMESTAMP '2026-06-05' + INTERVAL 5 MINUTE * k AS issue_ts, TIMESTAMP '2026-06-05' + INTERVAL 5 MINUTE * k + INTERVAL 1 MINUTE * m AS valid_ts
    FROM moved WHERE r BETWEEN 0 AND h - 1 AND c BETWEEN 0 AND w - 1 AND (low IS NULL OR value > low)""",
)
def nowcast_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plan over three grids, methods, floors and lead lists; scans that move by whole cells are found and carried on."""
    settings, history, cells = moving_scans(spark, sf_dir)
    out = Now.nowcast_all(cells, history, settings, ["forecast"], tile=TILE)
    return out.withColumn("value", F.round("value", 6))


def moving_scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Settings, history and cells of one forecast a scan: the scan is the newest of three frames, each moved on from the one before."""
    schema = "of int, height int, width int, r0 int, c0 int, dr int, dc int, method string, floor double, leads array<int>, warp_grid_step int"
    kinds = spark.createDataFrame([(*row[:9], list(row[9]), row[10]) for row in MOVING], schema)
    forecasts = scan(spark, sf_dir).select("k").distinct().withColumn("of", F.col("k") % 3).join(kinds, "of").withColumnRenamed("k", "forecast")
    settings = forecasts.select("forecast", "height", "width", "floor", "method", "leads", F.col("warp_grid_step").alias("motion_grid_step"), "warp_grid_step")
    axis = C.target_cells(scan_grids(spark, sf_dir)).select("k", "row", "col")
    made = ((F.col("row") * F.col("row") * 7 + F.col("col") * F.col("col") * 13 + F.col("row") * F.col("col") * 3 + F.col("k")) % 45).cast("double")
    whole = axis.join(scan(spark, sf_dir), ["k", "row", "col"], "left").select(F.col("k").alias("forecast"), "row", "col", F.when(V.is_echo(F.col("value")), F.col("value")).otherwise(made).alias("value"))
    ago = forecasts.withColumn("ago", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("frame_ts", frame_time(F.col("forecast") - F.col("ago")))
    placed = whole.join(ago.select("forecast", "ago", "frame_ts", "r0", "c0", "dr", "dc"), "forecast").select(
        "forecast", "frame_ts", (F.col("row") + F.col("r0") - F.col("ago") * F.col("dr")).cast("int").alias("row"), (F.col("col") + F.col("c0") - F.col("ago") * F.col("dc")).cast("int").alias("col"), "value"
    )
    return settings, ago.select("forecast", "frame_ts"), placed


def whole_runs(history: DataFrame) -> DataFrame:
    """Histories with at least two frames."""
    enough = history.groupBy("forecast").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return history.join(enough.drop("n"), "forecast")


@query(
    "forecast_frames",
    f"""WITH {OBS}, f AS (SELECT DISTINCT CAST(k // 18 AS INTEGER) AS forecast, TIMESTAMP '2026-06-05' + INTERVAL 5 MINUTE * (k // 6) AS frame_ts FROM obs),
    h AS (SELECT forecast, CAST(count(*) AS INTEGER) AS frames, max(frame_ts) AS issue_ts, list(frame_ts ORDER BY frame_ts DESC)[2] AS prev FROM f GROUP BY forecast HAVING count(*) >= 2),
    s AS (SELECT *, CAST(date_diff('second', prev, issue_ts) AS DOUBLE) / 60 AS dt_min FROM h)
    SELECT forecast, issue_ts, frames, dt_min, CAST(m AS INTEGER) AS lead_min, round(m / dt_min, 6) AS lead_steps, issue_ts + INTERVAL 1 MINUTE * m AS valid_ts FROM s, (VALUES (10), (20), (30)) l(m)""",
)
def forecast_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue, step count and valid time of every lead; repeated leads count once."""
    frames = Now.forecast_frames(whole_runs(scan_history(spark, sf_dir)), ["forecast"], (20, 10, 20, 30))
    return frames.withColumn("lead_steps", F.round("lead_steps", 6))


@query(
    "motion_grid_steps",
    """WITH p AS (SELECT p_partkey, p_size * 40 AS height, p_size * 55 AS width, 1 + p_partkey % 3 AS step, CASE p_partkey % 4 WHEN 0 THEN NULL ELSE 200 + p_partkey % 7 * 50 END AS grid_max FROM part),
    s AS (SELECT *, CASE WHEN grid_max > 0 THEN greatest(step, CAST(ceil(greatest(height, width)::DOUBLE / grid_max) AS INTEGER)) ELSE step END AS used FROM p)
    SELECT p_partkey, CAST(used AS INTEGER) AS used, CAST(ceil(height::DOUBLE / used) AS INTEGER) AS coarse_h, CAST(ceil(width::DOUBLE / used) AS INTEGER) AS coarse_w,
    ceil(height::DOUBLE / used) >= 2 AND ceil(width::DOUBLE / used) >= 2 AS usable FROM s""",
)
def motion_grid_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    grid_max = F.when(key % 4 == 0, F.lit(None)).otherwise(200 + key % 7 * 50).cast("int")
    sized = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_size") * 40).alias("h"), (F.col("p_size") * 55).alias("w"), (1 + key % 3).cast("int").alias("s"), grid_max.alias("m")
    )
    used = sized.withColumn("used", grid.motion_step(F.col("s"), F.col("h"), F.col("w"), F.col("m")))
    coarse = used.withColumns({"coarse_h": grid.coarse_size(F.col("h"), F.col("used")), "coarse_w": grid.coarse_size(F.col("w"), F.col("used"))})
    return coarse.select("p_partkey", "used", "coarse_h", "coarse_w", ((F.col("coarse_h") >= 2) & (F.col("coarse_w") >= 2)).alias("usable"))
