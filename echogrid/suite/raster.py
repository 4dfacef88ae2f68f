"""Queries over cells: decode, composite, pool, classify, statistics, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry
from ..functions import grid
from ..functions import values as V
from ..operators import cells as C
from ..operators import neighbourhood as N
from ..operators import raster as R
from . import query
from .views import AXIS, CELLS, GRID, OBS, SCAN, SETTLED, obs, scan, settled, table

FRAME = ["input_id", "k"]
SIZE = F.lit  # grid edge as a column
TILE = 16  # smaller than the grid, so halos and seams are exercised

POOLED = """least(CASE WHEN ((2*{i}+1)*{o}) % (2*{n}) = 0 AND {i} % 2 = 1 THEN ((2*{i}+1)*{o}) // (2*{n}) - 1
              ELSE ((2*{i}+1)*{o}) // (2*{n}) END, {o} - 1)"""


def _pooled(index: str, out: int, size: int = GRID) -> str:
    return POOLED.format(i=index, o=out, n=size)


@query(
    "palette_histogram",
    f"""WITH {OBS}, comp AS (SELECT k, "row", "col", max(value) AS value FROM obs GROUP BY ALL),
    pooled AS (SELECT k, {_pooled('"row"', 21)} AS r2, {_pooled('"col"', 21)} AS c2, max(value) AS value FROM comp GROUP BY ALL),
    cls AS (SELECT k, CASE WHEN value IS NULL THEN 16 WHEN value < 4 THEN 15 ELSE CAST(least(floor((value - 4) / 4), 14) AS INTEGER) END AS idx FROM pooled)
    SELECT k, CAST(idx AS SMALLINT) AS idx, count(*) AS n FROM cls GROUP BY ALL""",
)
def palette_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite over inputs, pool by 1.5, classify with a missing-data slot, count per frame and bin.

    Composite and pooling are both maxima, so one aggregate does both.
    """
    pooled = R.pool_max(obs(spark, sf_dir), ["k"], F.lit(1.5), F.lit(GRID), F.lit(GRID))
    classes = R.classify(pooled, registry.STANDARD_LEVELS, nodata_fill=True)
    return classes.groupBy("k", "idx").agg(F.count(F.lit(1)).alias("n"))


@query(
    "linear_decode",
    f"""WITH raw AS (SELECT l_orderkey, l_linenumber, l_quantity * 3 AS raw FROM lineitem),
    v AS (SELECT l_orderkey, l_linenumber, CASE WHEN raw = 3 THEN CAST('-Infinity' AS DOUBLE) WHEN raw = 150 THEN NULL
                 ELSE raw * CAST(0.5 AS DOUBLE) - 32 END AS value FROM raw)
    SELECT l_orderkey, l_linenumber, {SETTLED} FROM v""",
)
def linear_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    value = V.linear_decode(F.col("l_quantity") * 3, 0.5, -32.0, nodata=150.0, undetect=3.0)
    return settled(source.select("l_orderkey", "l_linenumber", value.alias("value")))


@query(
    "linear_decode_fixed_undetect",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 3 = 3 THEN -32.0::DOUBLE WHEN l_quantity * 3 = 150 THEN NULL
              ELSE l_quantity * 3 * CAST(0.5 AS DOUBLE) - 32 END AS value FROM lineitem""",
)
def linear_decode_fixed_undetect(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    value = V.linear_decode(F.col("l_quantity") * 3, 0.5, -32.0, 150.0, 3.0, undetect_value=-32.0)
    return source.select("l_orderkey", "l_linenumber", value.alias("value"))


_RATE = "CASE WHEN l_discount = 0 THEN NULL WHEN l_tax = 0 THEN 0 ELSE l_quantity * l_tax END"


@query(
    "rain_to_dbz",
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, {_RATE} AS rate FROM lineitem),
    v AS (SELECT l_orderkey, l_linenumber, CASE WHEN rate IS NULL THEN NULL WHEN rate <= 0 THEN CAST('-Infinity' AS DOUBLE)
                 ELSE 10 * log10(CAST(200 AS DOUBLE)) + 16 * log10(rate) END AS value FROM r)
    SELECT l_orderkey, l_linenumber, {SETTLED} FROM v""",
)
def rain_to_dbz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(_rates(spark, sf_dir).withColumn("value", V.rain_to_dbz(F.col("rate"))).drop("rate"))


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "lineitem")
    rate = F.when(F.col("l_discount") == 0, F.lit(None).cast("double")).when(F.col("l_tax") == 0, 0.0).otherwise(F.col("l_quantity") * F.col("l_tax"))
    return source.select("l_orderkey", "l_linenumber", rate.alias("rate"))


@query(
    "store_encode",
    f"""WITH {OBS} SELECT input_id, k, CASE WHEN value IS NULL THEN CAST(-9999 AS DOUBLE) WHEN value = CAST('-Infinity' AS DOUBLE) THEN -8888 ELSE value END AS raw,
    count(*) AS n FROM obs GROUP BY ALL""",
)
def store_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = V.store_encode(F.col("value"))
    return obs(spark, sf_dir).select(*FRAME, raw.alias("raw")).groupBy(*FRAME, "raw").agg(F.count(F.lit(1)).alias("n"))


@query(
    "value_masks",
    f"""WITH {CELLS} SELECT input_id, k, count(CASE WHEN value >= 4 THEN 1 END) AS standard, count(CASE WHEN value >= -12 THEN 1 END) AS extended,
    count(CASE WHEN value > 4 THEN 1 END) AS forecast, count(*) AS n FROM cells GROUP BY ALL""",
)
def value_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three floors: strict for the two observed overlays, inclusive for forecasts."""
    value = F.col("value")
    return C.max_cells(obs(spark, sf_dir), FRAME).groupBy(*FRAME).agg(
        F.count(V.mask_below(value, 4.0)).alias("standard"),
        F.count(V.mask_below(value, -12.0)).alias("extended"),
        F.count(V.mask_at_or_below(value, 4.0)).alias("forecast"),
        F.count(F.lit(1)).alias("n"),
    )


@query("composite_max", f"""WITH {OBS}, m AS (SELECT k, "row", "col", max(value) AS value FROM obs GROUP BY ALL) SELECT k, "row", "col", {SETTLED} FROM m""")
def composite_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(C.max_cells(obs(spark, sf_dir), ["k"]))


@query(
    "composite_products",
    f"""WITH {OBS}, b AS (SELECT unnest(string_split('de pl sk at be ch dk ee fi fr gb hr hu ie is it lv lt md mt nl no pt ro rs es se si', ' ')) AS product_id, 'opera_dbzh' AS input_id
      UNION ALL VALUES ('cz', 'cz_maxz'), ('it', 'it_sri_arco')),
    m AS (SELECT product_id, k, "row", "col", max(value) AS value FROM obs JOIN b USING (input_id) GROUP BY ALL)
    SELECT product_id, k, "row", "col", {SETTLED} FROM m""",
)
def composite_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product's inputs merged by maximum."""
    return settled(C.composite_inputs(obs(spark, sf_dir), registry.product_inputs(spark), ["k"]))


@query(
    "composite_preconditions",
    f"""WITH {OBS}, f AS (SELECT DISTINCT input_id, k, k // 2 AS grp FROM obs)
    SELECT CAST(grp AS INTEGER) AS grp, min(k) AS first_k, count(*) AS fields, min(k) = max(k) AS shared FROM f GROUP BY grp""",
)
def composite_preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of frames proposed for one composite, and whether they share a timestamp."""
    frames = obs(spark, sf_dir).select(*FRAME).distinct().withColumns(
        {"grp": F.floor(F.col("k") / 2).cast("int"), "frame_ts": F.col("k")}
    )
    mixed = C.mixed_timestamp_groups(frames, ["grp"]).select("grp", F.lit(False).alias("shared"))
    counted = frames.groupBy("grp").agg(F.min("k").alias("first_k"), F.count(F.lit(1)).alias("fields"))
    return counted.join(mixed, "grp", "left").withColumn("shared", F.coalesce("shared", F.lit(True)))


@query(
    "pool_fractional",
    f"""WITH {CELLS}, p AS (SELECT input_id, k, 21 AS out_height, 21 AS out_width, {_pooled('"row"', 21)} AS r, {_pooled('"col"', 21)} AS c, max(value) AS value FROM cells GROUP BY ALL)
    SELECT input_id, k, out_height, out_width, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS "col", {SETTLED} FROM p""",
)
def pool_fractional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(R.pool_max(obs(spark, sf_dir), FRAME, F.lit(1.5), F.lit(GRID), F.lit(GRID)))


@query(
    "pool_integer",
    f"""WITH {CELLS}, p AS (SELECT input_id, k, 16 AS out_height, 16 AS out_width, CAST("row" // 2 AS INTEGER) AS r, CAST("col" // 2 AS INTEGER) AS c, max(value) AS value FROM cells GROUP BY ALL)
    SELECT input_id, k, out_height, out_width, r AS "row", c AS "col", {SETTLED} FROM p""",
)
def pool_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(R.pool_max(obs(spark, sf_dir), FRAME, F.lit(2.0), F.lit(GRID), F.lit(GRID)))


@query(
    "pooled_geometry",
    """WITH g AS (SELECT p_partkey, p_size + 1 AS size, f.factor FROM part, (VALUES (CAST(1.0 AS DOUBLE)), (1.5), (2.0), (2.5)) f(factor)),
    o AS (SELECT *, CASE WHEN factor <= 1 THEN size ELSE greatest(1, CAST(round_even(size / factor, 0) AS INTEGER)) END AS pooled FROM g)
    SELECT p_partkey, factor, CAST(size AS INTEGER) AS size, CAST(pooled AS INTEGER) AS pooled, round(1000.0 * size / pooled, 6) AS px FROM o""",
)
def pooled_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled sizes and the pixel size that keeps the extent."""
    sizes = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 1).alias("size"))
    spread = sizes.withColumn("factor", F.explode(F.array(*map(F.lit, (1.0, 1.5, 2.0, 2.5)))))
    pooled = spread.withColumn("pooled", grid.pooled_size(F.col("size"), F.col("factor")))
    return pooled.withColumn("px", F.round(F.lit(1000.0) * F.col("size") / F.col("pooled"), 6))


_STANDARD = "CASE WHEN value IS NULL THEN {nodata} WHEN value < 4 THEN 15 ELSE CAST(least(floor((value - 4) / 4), 14) AS INTEGER) END"
_EXTENDED = "CASE WHEN value IS NULL THEN 19 WHEN value < -12 THEN 19 ELSE CAST(least(floor((value + 12) / 4), 18) AS INTEGER) END"


@query("classify_standard", f"""WITH {CELLS} SELECT input_id, k, "row", "col", CAST({_STANDARD.format(nodata=15)} AS SMALLINT) AS idx FROM cells""")
def classify_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = C.max_cells(obs(spark, sf_dir), FRAME).withColumn("quantity", F.lit("DBZH"))
    return R.classify(cells, registry.STANDARD_LEVELS).drop("value", "quantity")


@query("classify_nodata_slot", f"""WITH {CELLS} SELECT input_id, k, "row", "col", CAST({_STANDARD.format(nodata=16)} AS SMALLINT) AS idx FROM cells""")
def classify_nodata_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.classify(C.max_cells(obs(spark, sf_dir), FRAME), registry.STANDARD_LEVELS, nodata_fill=True).drop("value")


@query(
    "classify_by_palette",
    f"""WITH {CELLS} SELECT 'dbzh' AS palette, k, "row", "col", CAST({_STANDARD.format(nodata=15)} AS SMALLINT) AS idx FROM cells WHERE input_id = 'cz_maxz'
    UNION ALL SELECT 'dbzh_extended', k, "row", "col", CAST({_EXTENDED} AS SMALLINT) FROM cells WHERE input_id = 'opera_dbzh'
    UNION ALL SELECT 'dbzh_extended', k, "row", "col", CAST({_EXTENDED} AS SMALLINT) FROM cells WHERE input_id = 'it_sri_arco'""",
)
def classify_by_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = C.max_cells(obs(spark, sf_dir), FRAME).withColumn("palette", F.when(F.col("input_id") == "cz_maxz", "dbzh").otherwise("dbzh_extended"))
    return R.classify_by_palette(cells, registry.palettes(spark)).drop("value", "input_id")


@query(
    "variant_cells",
    f"""WITH {OBS}, comp AS (SELECT k, "row", "col", max(value) AS value FROM obs GROUP BY ALL),
    v AS (SELECT k, 'overlay' AS variant, {GRID} AS out_height, {GRID} AS out_width, "row" AS r, "col" AS c, value FROM comp
      UNION ALL SELECT k, 'overlay_small', 21, 21, CAST({_pooled('"row"', 21)} AS INTEGER), CAST({_pooled('"col"', 21)} AS INTEGER), max(value) FROM comp GROUP BY ALL)
    SELECT k, variant, out_height, out_width, r AS "row", c AS "col", CAST({_STANDARD.format(nodata=15)} AS SMALLINT) AS idx FROM v""",
)
def variant_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = R.variants(obs(spark, sf_dir).drop("input_id"), ["k"], registry.DEFAULT_VARIANTS, F.lit(GRID), F.lit(GRID))
    return R.classify(sized, registry.STANDARD_LEVELS).drop("value")


@query(
    "cell_colours",
    f"""WITH {CELLS}, i AS (SELECT input_id, k, {_STANDARD.format(nodata=15)} AS idx FROM cells),
    p(colors) AS (VALUES ({list(registry.STANDARD_COLORS)!r}))
    SELECT input_id, k, colors[idx + 1] AS color, CAST(('0x' || substr(colors[idx + 1], 2, 2)) AS INTEGER) AS r,
           CAST(('0x' || substr(colors[idx + 1], 4, 2)) AS INTEGER) AS g, CAST(('0x' || substr(colors[idx + 1], 6, 2)) AS INTEGER) AS b,
           CAST(255 AS INTEGER) AS a, count(*) AS n FROM i, p WHERE idx < 15 GROUP BY ALL""",
)
def cell_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opaque palette cells by colour channel, counted per frame."""
    classes = R.classify(C.max_cells(obs(spark, sf_dir), FRAME), registry.STANDARD_LEVELS)
    colours = F.array(*map(F.lit, registry.STANDARD_COLORS))
    counted = classes.where(F.col("idx") < len(registry.STANDARD_COLORS)).groupBy(*FRAME, F.get(colours, F.col("idx")).alias("color")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumns(
        {
            **{name: V.hex_channel(F.col("color"), channel) for channel, name in enumerate("rgb")},
            "a": V.alpha_byte(F.lit(1.0)),
        }
    )


@query(
    "palette_validation",
    f"""WITH {OBS}, p AS (SELECT input_id, k, list(DISTINCT floor(value / 4) * 4 ORDER BY floor(value / 4) * 4) AS levels FROM obs WHERE isfinite(value) GROUP BY ALL)
    SELECT input_id, k, CAST(len(levels) AS INTEGER) AS n_levels, len(levels) = 15 + 1 AS valid_asc, len(levels) <= 1 AND len(levels) = 15 + 1 AS valid_desc FROM p""",
)
def palette_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 4 dBZ steps a frame reaches taken as palette levels: the check on them, and on their reverse."""
    colours = F.array(*map(F.lit, registry.STANDARD_COLORS))
    levels = obs(spark, sf_dir).where(V.is_echo(F.col("value"))).groupBy(*FRAME).agg(F.sort_array(F.collect_set(F.floor(F.col("value") / 4) * 4.0)).alias("levels"))
    return levels.select(
        *FRAME, F.size("levels").alias("n_levels"),
        V.palette_is_valid(F.col("levels"), colours).alias("valid_asc"),
        V.palette_is_valid(F.reverse("levels"), colours).alias("valid_desc"),
    )


@query(
    "pixel_centres",
    f"""WITH {CELLS} SELECT input_id, k, "row", "col", CAST(-1200000 AS DOUBLE) + ("col" + 0.5) * CAST(2000 AS DOUBLE) AS x,
    CAST(6600000 AS DOUBLE) - ("row" + 0.5) * CAST(1500 AS DOUBLE) AS y FROM cells
    WHERE -1200000 + ("col" + 0.5) * 2000 BETWEEN -1190000 AND -1150000 AND 6600000 - ("row" + 0.5) * 1500 BETWEEN 6560000 AND 6590000""",
)
def pixel_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell centres and a crop on them."""
    placed = C.with_centres(C.max_cells(obs(spark, sf_dir), FRAME), F.lit(-1200000.0), F.lit(6600000.0), F.lit(2000.0), F.lit(1500.0))
    return C.crop(placed, F.lit(-1190000.0), F.lit(6560000.0), F.lit(-1150000.0), F.lit(6590000.0)).drop("value")


@query(
    "dense_grid",
    f"""WITH {CELLS}, {AXIS}, f AS (SELECT DISTINCT input_id, k FROM obs)
    SELECT input_id, k, r.i AS "row", c.i AS "col", CASE WHEN value IS NULL THEN 'nodata' WHEN value = CAST('-Infinity' AS DOUBLE) THEN 'undetect' ELSE 'echo' END AS state,
    CASE WHEN isfinite(value) THEN round(value, 6) END AS value
    FROM f CROSS JOIN axis r CROSS JOIN axis c LEFT JOIN cells ON f.input_id = cells.input_id AND f.k = cells.k AND cells."row" = r.i AND cells."col" = c.i""".replace(
        "SELECT input_id, k, r.i", "SELECT f.input_id, f.k, r.i"
    ),
)
def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = C.max_cells(obs(spark, sf_dir), FRAME)
    grids = cells.select(*FRAME).distinct().withColumns({"height": F.lit(GRID), "width": F.lit(GRID)})
    return settled(C.densify(cells, grids, FRAME))


@query(
    "grid_resolution",
    """SELECT s_suppkey, round(11.27 * 0 + w.lon_range * 111.32 / size, 6) AS lon_km, round(w.lat_range * 110.54 / size, 6) AS lat_km,
    round((w.lon_range * 111.32 / size + w.lat_range * 110.54 / size) / 2, 6) AS mean_km
    FROM (SELECT s_suppkey, CAST(100 + s_suppkey AS DOUBLE) AS size, CAST(s_nationkey + 1 AS DOUBLE) AS lon_range, CAST(s_nationkey + 2 AS DOUBLE) / 2 AS lat_range FROM supplier) w""",
)
def grid_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "supplier")
    size = (F.col("s_suppkey") + 100).cast("double")
    lon_range, lat_range = (F.col("s_nationkey") + 1).cast("double"), (F.col("s_nationkey") + 2).cast("double") / 2
    km = grid.km_per_pixel(F.lit(0.0), lon_range, F.lit(0.0), lat_range, size, size)
    return source.select("s_suppkey", km.alias("km")).select(
        "s_suppkey", *[F.round(F.col(f"km.{name}"), 6).alias(f"{name}_km") for name in ("lon", "lat", "mean")]
    )


@query(
    "frame_stats",
    f"""WITH {CELLS} SELECT input_id, k, count(*) AS cells, count(CASE WHEN isfinite(value) THEN 1 END) AS echoes,
    round(count(CASE WHEN isfinite(value) THEN 1 END) / {GRID * GRID}.0, 6) AS finite_fraction, min(CASE WHEN isfinite(value) THEN value END) AS min_value,
    median(CASE WHEN isfinite(value) THEN value END) AS median_value, round(avg(CASE WHEN isfinite(value) THEN value END), 6) AS mean_value,
    round(stddev_samp(CASE WHEN isfinite(value) THEN value END), 6) AS stdev_value, max(CASE WHEN isfinite(value) THEN value END) AS max_value
    FROM cells GROUP BY ALL""",
)
def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = C.frame_stats(C.max_cells(obs(spark, sf_dir), FRAME), FRAME, GRID * GRID)
    return stats.withColumns({name: F.round(F.col(name), 6) for name in ("finite_fraction", "mean_value", "stdev_value")})


@query(
    "masked_rmse",
    f"""WITH {CELLS}, a AS (SELECT * FROM cells WHERE isfinite(value)), j AS (
      SELECT a.k, a.value AS x, b.value AS y FROM a JOIN a b ON a.k = b.k AND a."row" = b."row" AND a."col" = b."col" WHERE a.input_id = 'opera_dbzh' AND b.input_id = 'cz_maxz')
    SELECT k, count(*) AS cells, round(sqrt(avg(pow(x - y, 2))), 6) AS rmse, round(avg(CASE WHEN x <> y THEN 1.0 ELSE 0.0 END), 6) AS differing FROM j GROUP BY k""",
)
def masked_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = C.max_cells(obs(spark, sf_dir), FRAME)
    score = C.masked_rmse(cells.where(F.col("input_id") == "opera_dbzh"), cells.where(F.col("input_id") == "cz_maxz"), ["k"])
    return score.withColumns({name: F.round(F.col(name), 6) for name in ("rmse", "differing")})


@query(
    "frame_preparation",
    f"""WITH {CELLS}, m AS (SELECT input_id, k, min(CASE WHEN isfinite(value) THEN value END) AS frame_min FROM cells GROUP BY ALL HAVING frame_min IS NOT NULL)
    SELECT input_id, k, "row", "col", frame_min, coalesce(isfinite(value), false) AS valid, CASE WHEN isfinite(value) THEN value ELSE frame_min END AS value
    FROM cells JOIN m USING (input_id, k)""",
)
def frame_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fill_missing(C.max_cells(obs(spark, sf_dir), FRAME), FRAME)


@query(
    "empty_frames",
    f"""WITH {OBS}, f AS (SELECT input_id, k * 1024 + "row" * 32 + "col" AS frame, value FROM obs)
    SELECT input_id, CAST(frame AS INTEGER) AS frame FROM f GROUP BY ALL HAVING count(CASE WHEN isfinite(value) THEN 1 END) = 0""",
)
def empty_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames without an echo; each cell series is read as a tiny frame so that some exist."""
    frames = obs(spark, sf_dir).select("input_id", (F.col("k") * 1024 + F.col("row") * 32 + F.col("col")).alias("frame"), "value")
    return C.empty_frames(frames, ["input_id", "frame"])


# --- neighbourhoods over the dense scan ---

_FILLED = SCAN + """, low AS (SELECT k, min(value) AS frame_min FROM scan WHERE isfinite(value) GROUP BY k),
filled AS (SELECT k, "row" AS r, "col" AS c, frame_min, coalesce(isfinite(value), false) AS valid,
                  CASE WHEN isfinite(value) THEN value ELSE frame_min END AS value FROM scan JOIN low USING (k))"""
_DENSE = AXIS + """, dense AS (SELECT low.k, a.i AS r, b.i AS c, f.value, coalesce(f.valid, false) AS valid
  FROM low CROSS JOIN axis a CROSS JOIN axis b LEFT JOIN filled f ON f.k = low.k AND f.r = a.i AND f.c = b.i)"""
_OPENING = """mask AS (SELECT d.k, d.r, d.c, coalesce(d.value > low.frame_min + {t}, false) AS m FROM dense d JOIN low USING (k)),
cross5(dr, dc) AS (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)),
eroded AS (SELECT m.k, m.r, m.c, bool_and(n.m) AS m FROM mask m CROSS JOIN cross5 JOIN mask n ON n.k = m.k AND n.r = m.r + dr AND n.c = m.c + dc GROUP BY ALL),
opened AS (SELECT m.k, m.r, m.c, bool_or(n.m) AS m FROM eroded m CROSS JOIN cross5 JOIN eroded n ON n.k = m.k AND n.r = m.r + dr AND n.c = m.c + dc GROUP BY ALL)"""


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fill_missing(scan(spark, sf_dir), ["k"])


def thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared frames whose values under 20 dBZ sink to the minimum, so that echoes are islands."""
    return prepared(spark, sf_dir).withColumn("value", F.when(F.col("value") >= 20, F.col("value")).otherwise(F.col("frame_min")))


_THIN = _FILLED.replace("CASE WHEN isfinite(value) THEN value ELSE frame_min END", "CASE WHEN isfinite(value) AND value >= 20 THEN value ELSE frame_min END")


@query(
    "morph_open",
    f"""WITH {_THIN}, {_DENSE}, {_OPENING.format(t=0)}
    SELECT f.k, f.r AS "row", f.c AS "col", f.frame_min, f.valid, CASE WHEN f.value > f.frame_min AND NOT o.m THEN f.frame_min ELSE f.value END AS value,
    f.value > f.frame_min AND NOT o.m AS removed FROM filled f JOIN opened o ON o.k = f.k AND o.r = f.r AND o.c = f.c""",
)
def morph_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.morph_open(thinned(spark, sf_dir), ["k"], GRID, GRID, tile=TILE)


@query(
    "mask_dilate",
    f"""WITH {_FILLED}, {_DENSE}, off AS (SELECT CAST(i AS INTEGER) AS d FROM range(-2, 3) t(i)),
    bad AS (SELECT DISTINCT d.k, d.r + a.d AS r, d.c + b.d AS c FROM dense d CROSS JOIN off a CROSS JOIN off b WHERE NOT d.valid)
    SELECT f.k, f.r AS "row", f.c AS "col", f.valid, bad.k IS NOT NULL AS blocked FROM filled f LEFT JOIN bad ON bad.k = f.k AND bad.r = f.r AND bad.c = f.c""",
)
def mask_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.dilate_nodata(prepared(spark, sf_dir), ["k"], GRID, GRID, tile=TILE)


@query(
    "rescale_255",
    f"""WITH {_FILLED}, hi AS (SELECT k, max(value) AS frame_max FROM filled GROUP BY k)
    SELECT k, r AS "row", c AS "col", CAST(floor(CASE WHEN frame_max - frame_min > 1e-8 THEN (value - frame_min) / (frame_max - frame_min) * 255 ELSE value - frame_min END) AS INTEGER) AS level
    FROM filled JOIN hi USING (k)""",
)
def rescale_255(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rescale_to_byte(prepared(spark, sf_dir), ["k"]).select("k", "row", "col", "level")


_LEVELS = _FILLED + """, hi AS (SELECT k, max(value) AS frame_max FROM filled GROUP BY k),
lev AS (SELECT k, r, c, valid, CAST(floor(CASE WHEN frame_max - frame_min > 1e-8 THEN (value - frame_min) / (frame_max - frame_min) * 255 ELSE value - frame_min END) AS INTEGER) AS level
        FROM filled JOIN hi USING (k)), """ + AXIS
_MIRROR = "CASE WHEN {x} < 0 THEN -({x}) WHEN {x} > 31 THEN 62 - ({x}) ELSE {x} END"
_SCORES = _LEVELS + f""", img AS (SELECT low.k, a.i AS r, b.i AS c, coalesce(l.level, 0) AS level, coalesce(l.valid, false) AS valid
  FROM low CROSS JOIN axis a CROSS JOIN axis b LEFT JOIN lev l ON l.k = low.k AND l.r = a.i AND l.c = b.i),
kern(dr, dc, wx, wy) AS (VALUES (-1,-1,-1,-1),(-1,0,0,-2),(-1,1,1,-1),(0,-1,-2,0),(0,1,2,0),(1,-1,-1,1),(1,0,0,2),(1,1,1,1)),
grad AS (SELECT p.k, p.r, p.c, sum(wx * n.level) AS gx, sum(wy * n.level) AS gy FROM img p CROSS JOIN kern
  JOIN img n ON n.k = p.k AND n.r = {_MIRROR.format(x='p.r + dr')} AND n.c = {_MIRROR.format(x='p.c + dc')} GROUP BY ALL),
off AS (SELECT CAST(i AS INTEGER) AS d FROM range(-2, 3) t(i)),
boxed AS (SELECT p.k, p.r, p.c, CAST(sum(n.gx * n.gx) AS DOUBLE) AS xx, CAST(sum(n.gx * n.gy) AS DOUBLE) AS xy, CAST(sum(n.gy * n.gy) AS DOUBLE) AS yy
  FROM img p CROSS JOIN off a CROSS JOIN off b JOIN grad n ON n.k = p.k AND n.r = {_MIRROR.format(x='p.r + a.d')} AND n.c = {_MIRROR.format(x='p.c + b.d')} GROUP BY ALL),
bad AS (SELECT DISTINCT d.k, d.r + a.d AS r, d.c + b.d AS c FROM img d CROSS JOIN off a CROSS JOIN off b WHERE NOT d.valid),
score AS (SELECT l.k, l.r, l.c, (xx + yy) / 2 - sqrt(pow((xx - yy) / 2, 2) + pow(xy, 2)) AS score, bad.k IS NOT NULL AS blocked
  FROM lev l JOIN boxed USING (k, r, c) LEFT JOIN bad ON bad.k = l.k AND bad.r = l.r AND bad.c = l.c)"""


def scored(spark: SparkSession, sf_dir: str, buffer: int = 5) -> DataFrame:
    levels = C.rescale_to_byte(prepared(spark, sf_dir), ["k"])
    return N.corner_score(levels, ["k"], GRID, GRID, buffer=buffer, tile=TILE)


@query("corner_score", f"""WITH {_SCORES} SELECT k, r AS "row", c AS "col", round(score, 3) AS score, blocked FROM score""")
def corner_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumn("score", F.round("score", 3))


@query(
    "feature_selection",
    f"""WITH RECURSIVE {_SCORES.replace("score AS (SELECT", "exact AS (SELECT")},
    score AS (SELECT k, r, c, round(score, 3) AS score, blocked FROM exact),
    top AS (SELECT k, max(score) AS frame_max FROM score WHERE NOT blocked GROUP BY k),
    cand AS (SELECT s.* FROM score s JOIN top USING (k) WHERE NOT blocked AND r > 0 AND r < 31 AND c > 0 AND c < 31 AND score > 0 AND score >= 0.01 * frame_max
      AND NOT EXISTS (SELECT 1 FROM score n WHERE n.k = s.k AND n.r BETWEEN s.r - 1 AND s.r + 1 AND n.c BETWEEN s.c - 1 AND s.c + 1 AND n.score > s.score)),
    g AS (SELECT k, 0 AS n, CAST([] AS STRUCT(s DOUBLE, r BIGINT, c BIGINT)[]) AS acc FROM (SELECT DISTINCT k FROM cand)
      UNION ALL
      SELECT g.k, g.n + 1, list_append(any_value(g.acc), CAST(max({{'s': score, 'r': -r, 'c': -c}}) AS STRUCT(s DOUBLE, r BIGINT, c BIGINT)))
      FROM g JOIN cand ON cand.k = g.k WHERE len(list_filter(g.acc, lambda a: (a.r + cand.r) * (a.r + cand.r) + (a.c + cand.c) * (a.c + cand.c) < 100)) = 0 GROUP BY g.k, g.n)
    SELECT k, -e.r AS "row", -e.c AS "col", e.s AS score, CAST(n AS INTEGER) AS rank FROM (SELECT k, n, acc[n] AS e FROM g WHERE n > 0)""",
)
def feature_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of every frame, best first, ten cells apart; scores are rounded first, so that equal ones tie."""
    return N.select_features(scored(spark, sf_dir).withColumn("score", F.round("score", 3)), ["k"], GRID, GRID)
