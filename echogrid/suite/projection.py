"""Queries over projections, target grids, resampling and polygons."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import projection as P
from ..operators import geometry as G
from ..operators import raster as R
from ..plans import nowcast as Now
from . import query
from .views import OBS, SETTLED, obs, settled, table

RADIUS = "6378137.0::DOUBLE"
_LON = "(-10 + (c_custkey % 400) / 10.0::DOUBLE)"
_LAT = "(36 + (c_custkey % 330) / 10.0::DOUBLE)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places over Europe, one per customer."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        (F.lit(-10.0) + (F.col("c_custkey") % 400) / 10.0).alias("lon"),
        (F.lit(36.0) + (F.col("c_custkey") % 330) / 10.0).alias("lat"),
    )


def laea_sql(lon: str, lat: str, lon0: str, lat0: str) -> tuple[str, str]:
    """Ellipsoidal equal-area coordinates as SQL text."""
    f = P.WGS84_FLATTENING
    e = math.sqrt(f * (2 - f))
    q = lambda s: f"((1 - {e * e!r}) * ({s} / (1 - {e * e!r} * {s} * {s}) - ln((1 - {e!r} * {s}) / (1 + {e!r} * {s})) / (2 * {e!r})))"
    qp = q("1.0::DOUBLE")
    sb, s0 = f"({q(f'sin(radians({lat}))')} / {qp})", f"({q(f'sin(radians({lat0}))')} / {qp})"
    cb, c0 = f"sqrt(1 - {sb} * {sb})", f"sqrt(1 - {s0} * {s0})"
    rad = f"({RADIUS} * sqrt({qp} / 2))"
    d = f"({RADIUS} * cos(radians({lat0})) / (sqrt(1 - {e * e!r} * pow(sin(radians({lat0})), 2)) * {rad} * {c0}))"
    turn = f"radians({lon} - {lon0})"
    b = f"({rad} * sqrt(2 / (1 + {s0} * {sb} + {c0} * {cb} * cos({turn}))))"
    return f"({b} * {d} * {cb} * sin({turn}))", f"({b} / {d} * ({c0} * {sb} - {s0} * {cb} * cos({turn})))"


def tmerc_sql(lon: str, lat: str, lon0: float, lat0: float) -> tuple[str, str]:
    """Ellipsoidal transverse Mercator coordinates as SQL text, by the series in the third flattening to its fourth power."""
    f = P.WGS84_FLATTENING
    n, e = f / (2 - f), math.sqrt(f * (2 - f))
    radius = P.EARTH_RADIUS / (1 + n) * (1 + n * n / 4 + n**4 / 64)
    # The published coefficients of the series.
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    s = f"sin(radians({lat}))"
    t = f"sinh(atanh({s}) - {e!r} * atanh({e!r} * {s}))"
    xi, eta = f"atan2({t}, cos(radians({lon} - {lon0})))", f"atanh(sin(radians({lon} - {lon0})) / sqrt(1 + pow({t}, 2)))"
    north = " + ".join([xi, *(f"{a!r} * sin({2 * j + 2} * {xi}) * cosh({2 * j + 2} * {eta})" for j, a in enumerate(alpha))])
    east = " + ".join([eta, *(f"{a!r} * cos({2 * j + 2} * {xi}) * sinh({2 * j + 2} * {eta})" for j, a in enumerate(alpha))])
    s0 = math.sin(math.radians(lat0))
    xi0 = math.atan(math.sinh(math.atanh(s0) - e * math.atanh(e * s0)))
    origin = xi0 + sum(a * math.sin((2 * j + 2) * xi0) for j, a in enumerate(alpha))
    return f"({radius!r} * ({east}))", f"({radius!r} * ({north} - {origin!r}))"


_LX, _LY = laea_sql("lon", "lat", "10.0::DOUBLE", "55.0::DOUBLE")
_TX, _TY = tmerc_sql("lon", "lat", 12.5, 42.0)


@query(
    "project_points",
    f"""WITH p AS (SELECT c_custkey, {_LON} AS lon, {_LAT} AS lat FROM customer)
    SELECT c_custkey, round({RADIUS} * radians(lon), 3) AS merc_x, round({RADIUS} * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS merc_y,
    round({_LX}, 3) AS laea_x, round({_LY}, 3) AS laea_y, round({_TX}, 1) AS tmerc_x, round({_TY}, 1) AS tmerc_y, true AS merc_back, true AS laea_back, true AS tmerc_back FROM p""",
)
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward coordinates, and whether inverting each returns within a micrometre."""
    out = points(spark, sf_dir)
    kinds = {
        "merc": P.WEB_MERCATOR,
        "laea": P.Crs("laea", f=P.WGS84_FLATTENING, lat0=55.0, lon0=10.0, x0=1950000.0, y0=-2100000.0),
        "tmerc": P.Crs("tmerc", f=P.WGS84_FLATTENING, lat0=42.0, lon0=12.5),
    }
    for name, crs in kinds.items():
        out = P.forward(out, F.col("lon"), F.col("lat"), crs, (f"{name}_x", f"{name}_y"))
        out = P.inverse(out, F.col(f"{name}_x"), F.col(f"{name}_y"), crs, ("_lon", "_lat"))
        close = F.greatest(F.abs(F.col("_lon") - F.col("lon")), F.abs(F.col("_lat") - F.col("lat"))) * 111320.0 < 1e-6
        out = out.withColumn(f"{name}_back", close)
    return out.select(
        "c_custkey", F.round("merc_x", 3).alias("merc_x"), F.round("merc_y", 3).alias("merc_y"),
        F.round(F.col("laea_x") - 1950000.0, 3).alias("laea_x"), F.round(F.col("laea_y") + 2100000.0, 3).alias("laea_y"),
        F.round("tmerc_x", 1).alias("tmerc_x"), F.round("tmerc_y", 1).alias("tmerc_y"), "merc_back", "laea_back", "tmerc_back",
    )


GRID_COLUMNS = ["s_suppkey"]


def lonlat_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small longitude-latitude grid per supplier."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_nationkey",
        (key % 40 - 10).cast("double").alias("x_min"), (F.lit(45.0) + key % 20).alias("y_max"),
        F.lit(0.1).alias("px"), F.lit(0.05).alias("py"),
        (F.lit(20) + key % 13).cast("int").alias("width"), (F.lit(15) + key % 7).cast("int").alias("height"),
    )


_GRIDS = """g AS (SELECT s_suppkey, s_nationkey, CAST(s_suppkey % 40 - 10 AS DOUBLE) AS x_min, CAST(45 + s_suppkey % 20 AS DOUBLE) AS y_max,
  CAST(0.1 AS DOUBLE) AS px, CAST(0.05 AS DOUBLE) AS py, CAST(20 + s_suppkey % 13 AS INTEGER) AS width, CAST(15 + s_suppkey % 7 AS INTEGER) AS height FROM supplier)"""
_MX = lambda lon: f"({RADIUS} * radians({lon}))"
_MY = lambda lat: f"({RADIUS} * ln(tan(pi() / 4 + radians({lat}) / 2)))"
_BBOX = _GRIDS + f""", edge AS (SELECT s_suppkey, unnest([x_min, x_min + width * px]) AS lon, y_max, y_max - height * py AS y_min FROM g),
box AS (SELECT s_suppkey, min({_MX('lon')}) AS x_low, min({_MY('y_min')}) AS y_low, max({_MX('lon')}) AS x_high, max({_MY('y_max')}) AS y_high FROM edge GROUP BY ALL)"""


@query("perimeter_bbox", f"WITH {_BBOX} SELECT s_suppkey, round(x_low, 3) AS x_low, round(y_low, 3) AS y_low, round(x_high, 3) AS x_high, round(y_high, 3) AS y_high FROM box")
def perimeter_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected extent of a grid from samples on its perimeter; here the corners decide it."""
    box = R.perimeter_bbox(lonlat_grids(spark, sf_dir), GRID_COLUMNS, P.LONLAT)
    return box.select("s_suppkey", *[F.round(name, 3).alias(name) for name in ("x_low", "y_low", "x_high", "y_high")])


_FINEST = _GRIDS + f""", lat AS (SELECT s_suppkey, px, py, x_min + (c + 0.5) * px AS x, y_max - (r + 0.5) * py AS y
  FROM (SELECT *, unnest(range(width)) AS c FROM g) a, LATERAL (SELECT unnest(range(a.height)) AS r) b),
res AS (SELECT s_suppkey, min(least(sqrt(pow({_MX('x + px')} - {_MX('x')}, 2) + 0), abs({_MY('y - py')} - {_MY('y')}))) AS resolution FROM lat GROUP BY ALL)"""


@query("finest_cell", f"WITH {_FINEST} SELECT s_suppkey, round(resolution, 3) AS resolution FROM res")
def finest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.finest_cell(lonlat_grids(spark, sf_dir), GRID_COLUMNS, P.LONLAT).withColumn("resolution", F.round("resolution", 3))


@query(
    "target_grid_union",
    f"""WITH {_BBOX}, {_FINEST.removeprefix(_GRIDS + ", ")}, u AS (SELECT s_nationkey, min(x_low) AS x_low, min(y_low) AS y_low, max(x_high) AS x_high, max(y_high) AS y_high, min(resolution) AS resolution
      FROM g JOIN box USING (s_suppkey) JOIN res USING (s_suppkey) GROUP BY ALL)
    SELECT s_nationkey, round(x_low, 3) AS x_min, round(y_high, 3) AS y_max, round(resolution, 3) AS px,
    CAST(greatest(1, ceil((x_high - x_low) / resolution - 1e-6)) AS INTEGER) AS width, CAST(greatest(1, ceil((y_high - y_low) / resolution - 1e-6)) AS INTEGER) AS height FROM u""",
)
def target_grid_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target grid of each nation's inputs: union extent at the finest resolution."""
    grids = lonlat_grids(spark, sf_dir)
    extents = R.perimeter_bbox(grids, GRID_COLUMNS, P.LONLAT).join(R.finest_cell(grids, GRID_COLUMNS, P.LONLAT), GRID_COLUMNS)
    keyed = extents.join(grids.select("s_suppkey", "s_nationkey"), GRID_COLUMNS)
    spec = R.target_grid(R.union_extent(keyed, ["s_nationkey"]))
    return spec.select("s_nationkey", *[F.round(name, 3).alias(name) for name in ("x_min", "y_max", "px")], "width", "height")


@query(
    "target_grid_bounds",
    f"""WITH b AS (SELECT c_custkey, {_LON} AS west, {_LAT} AS south, {_LON} + 2 AS east, {_LAT} + 1 AS north FROM customer),
    e AS (SELECT c_custkey, {_MX('west')} AS x1, {_MY('south')} AS y1, {_MX('east')} AS x2, {_MY('north')} AS y2 FROM b),
    g AS (SELECT *, CAST(greatest(1, ceil((x2 - x1) / 1500 - 1e-6)) AS INTEGER) AS width, CAST(greatest(1, ceil((y2 - y1) / 1500 - 1e-6)) AS INTEGER) AS height FROM e)
    SELECT c_custkey, width, height, round(degrees(x1 / {RADIUS}), 6) AS west, round(degrees(pi() / 2 - 2 * atan(exp(-(y2 - height * 1500) / {RADIUS}))), 6) AS south,
    round(degrees((x1 + width * 1500) / {RADIUS}), 6) AS east, round(degrees(pi() / 2 - 2 * atan(exp(-y2 / {RADIUS}))), 6) AS north FROM g""",
)
def target_grid_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid covering requested bounds, and the bounds that grid really has."""
    asked = points(spark, sf_dir).select(
        "c_custkey", F.col("lon").alias("west"), F.col("lat").alias("south"), (F.col("lon") + 2).alias("east"), (F.col("lat") + 1).alias("north")
    )
    spec = R.target_grid(R.bounds_extent(asked).withColumn("resolution", F.lit(1500.0)))
    real = R.lonlat_bounds(spec)
    return real.select("c_custkey", "width", "height", *[F.round(name, 6).alias(name) for name in ("west", "south", "east", "north")])


# Source grids of the three inputs: two shifted Mercators and a plate carree.
SOURCE_CRS = {
    "cz_maxz": P.Crs("merc", x0=-1254222.15, y0=-6702777.85),
    "opera_dbzh": P.LONLAT,
    "it_sri_arco": P.Crs("merc", x0=-1250000.0, y0=-6700000.0),
}
SOURCE_GRIDS = [
    ("cz", "cz_maxz", 0.0, 0.0, 1555.7, 1555.7, 32, 32),
    ("mix", "cz_maxz", 0.0, 0.0, 1555.7, 1555.7, 32, 32),
    ("mix", "opera_dbzh", 11.0, 51.5, 0.03, 0.02, 32, 32),
    ("mix", "it_sri_arco", -3000.0, 2000.0, 1801.3, 1702.9, 32, 32),
]
TARGET_GRIDS = [("cz", 1254500.0, 6702000.0, 1500.0, 1500.0, 34, 33), ("mix", 1240000.0, 6710000.0, 2100.0, 2100.0, 40, 41)]


def sampling_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    targets = spark.createDataFrame(TARGET_GRIDS, "product_id string, x_min double, y_max double, px double, py double, width int, height int")
    sources = spark.createDataFrame(
        SOURCE_GRIDS, "product_id string, input_id string, x_min double, y_max double, px double, py double, width int, height int"
    )
    return targets, sources


_VALUES = lambda rows: ", ".join("(" + ", ".join(repr(v) if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) for v in row) + ")" for row in rows)


def resampled_sql(targets: list[tuple], sources: list[tuple], x: str, y: str) -> str:
    """Observations merged on target grids; ``x`` and ``y`` are a place in the projection of source ``s``."""
    return OBS + f""", t(product_id, x_min, y_max, px, py, width, height) AS (VALUES {_VALUES(targets)}),
s(product_id, input_id, x_min, y_max, px, py, width, height) AS (VALUES {_VALUES(sources)}),
tc AS (SELECT product_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS "col", x_min + (c + 0.5) * px AS x, y_max - (r + 0.5) * py AS y
  FROM (SELECT *, unnest(range(width)) AS c FROM t) a, LATERAL (SELECT unnest(range(a.height)) AS r) b),
ll AS (SELECT *, degrees(x / {RADIUS}) AS lon, degrees(pi() / 2 - 2 * atan(exp(-y / {RADIUS}))) AS lat FROM tc),
src AS (SELECT ll.product_id, "row", "col", s.input_id, s.x_min, s.y_max, s.px, s.py, s.width, s.height, {x} AS sx, {y} AS sy FROM ll JOIN s USING (product_id)),
idx AS (SELECT product_id, "row", "col", input_id, CAST(round_even((sx - x_min) / px - 0.5, 0) AS INTEGER) AS sc, CAST(round_even((y_max - sy) / py - 0.5, 0) AS INTEGER) AS sr, width, height FROM src),
hit AS (SELECT * FROM idx WHERE sc >= 0 AND sc < width AND sr >= 0 AND sr < height),
one AS (SELECT input_id, k, "row" AS sr, "col" AS sc, max(value) AS value FROM obs GROUP BY ALL),
merged AS (SELECT product_id, k, hit."row", hit."col", max(value) AS value FROM one JOIN hit USING (input_id, sr, sc) GROUP BY ALL)"""


_RESAMPLED = resampled_sql(
    TARGET_GRIDS, SOURCE_GRIDS,
    f"CASE s.input_id WHEN 'opera_dbzh' THEN lon WHEN 'cz_maxz' THEN -1254222.15 + {_MX('lon')} ELSE -1250000.0 + {_MX('lon')} END",
    f"CASE s.input_id WHEN 'opera_dbzh' THEN lat WHEN 'cz_maxz' THEN -6702777.85 + {_MY('lat')} ELSE -6700000.0 + {_MY('lat')} END",
)


@query("sampling_index", f"""WITH {_RESAMPLED}, n AS (SELECT input_id, count(*) AS seen FROM obs GROUP BY ALL) SELECT product_id, "row", "col", input_id, sr AS src_row, sc AS src_col, seen FROM hit JOIN n USING (input_id)""")
def sampling_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source cell of every covered target cell, with the rows its input has."""
    targets, sources = sampling_tables(spark)
    index = R.sampling_index(targets, sources, SOURCE_CRS, ["product_id"])
    return index.join(obs(spark, sf_dir).groupBy("input_id").agg(F.count(F.lit(1)).alias("seen")), "input_id")


@query("resample_composite", f"""WITH {_RESAMPLED} SELECT product_id, k, "row", "col", {SETTLED} FROM merged""")
def resample_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reproject every input onto the product grids and merge by maximum."""
    targets, sources = sampling_tables(spark)
    return settled(R.composite_to_grid(obs(spark, sf_dir), targets, sources, SOURCE_CRS, ["product_id"], ["k"]))


@query(
    "history_cells",
    f"""WITH {_RESAMPLED}, h AS (SELECT DISTINCT s.product_id, k FROM obs JOIN s USING (input_id) QUALIFY dense_rank() OVER (PARTITION BY s.product_id ORDER BY k DESC) <= 3)
    SELECT product_id, k, "row", "col", {SETTLED} FROM merged JOIN h USING (product_id, k)""",
)
def history_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest frames of each product on its grid, as a nowcast reads them."""
    targets, sources = sampling_tables(spark)
    known = obs(spark, sf_dir).select("input_id", "k").distinct().join(F.broadcast(sources.select("product_id", "input_id")), "input_id")
    order = W.partitionBy("product_id").orderBy(F.col("k").desc())
    history = known.select("product_id", "k").distinct().withColumn("n", F.row_number().over(order)).where("n <= 3").drop("n")
    return settled(Now.history_cells(obs(spark, sf_dir), history, targets, sources, SOURCE_CRS, ["product_id"], "k"))


CURVED_TARGETS = [("eu", 1000000.0, 7000000.0, 20000.0, 20000.0, 40, 60)]
CURVED_SOURCES = [
    ("eu", "cz_maxz", 0.0, 0.0, 15557.0, 15557.0, 32, 32), ("eu", "opera_dbzh", 1900000.0, -2000000.0, 15000.0, 15000.0, 32, 32), ("eu", "it_sri_arco", -250000.0, 900000.0, 16000.0, 16000.0, 32, 32),
]
_CURVED = resampled_sql(
    CURVED_TARGETS, CURVED_SOURCES,
    f"CASE s.input_id WHEN 'opera_dbzh' THEN 1950000.0 + {_LX} WHEN 'cz_maxz' THEN -1254222.15 + {_MX('lon')} ELSE {_TX} END",
    f"CASE s.input_id WHEN 'opera_dbzh' THEN -2100000.0 + {_LY} WHEN 'cz_maxz' THEN -6702777.85 + {_MY('lat')} ELSE {_TY} END",
)


@query("resample_ellipsoidal", f"""WITH {_CURVED} SELECT product_id, k, "row", "col", {SETTLED} FROM merged""")
def resample_ellipsoidal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with an equal-area and a transverse Mercator source beside the Mercator one."""
    crs = {
        "cz_maxz": SOURCE_CRS["cz_maxz"],
        "opera_dbzh": P.Crs("laea", f=P.WGS84_FLATTENING, lat0=55.0, lon0=10.0, x0=1950000.0, y0=-2100000.0),
        "it_sri_arco": P.Crs("tmerc", f=P.WGS84_FLATTENING, lat0=42.0, lon0=12.5),
    }
    schema = "product_id string, x_min double, y_max double, px double, py double, width int, height int"
    targets = spark.createDataFrame(CURVED_TARGETS, schema)
    sources = spark.createDataFrame(CURVED_SOURCES, schema.replace("product_id string", "product_id string, input_id string"))
    return settled(R.composite_to_grid(obs(spark, sf_dir), targets, sources, crs, ["product_id"], ["k"]))


# --- polygons: star-shaped rings around places, three rings a feature ---

VERTICES = 24


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of 24 vertices, one per customer; ten customers make a feature."""
    key, i = F.col("c_custkey"), F.col("seq")
    spread = points(spark, sf_dir).withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(VERTICES - 1))))
    radius = F.lit(0.2) + ((key * 7 + i * 13) % 17) / 34.0
    angle = i * F.lit(2 * math.pi / VERTICES)
    centre = F.floor(key / 10)
    return spread.select(
        centre.alias("feature"), (key % 10).cast("int").alias("ring"), "seq",
        (F.lit(-5.0) + centre % 30 + (key % 10) / 4.0 + radius * F.cos(angle)).alias("lon"),
        (F.lit(40.0) + centre % 20 + (key % 10) / 5.0 + radius * F.sin(angle)).alias("lat"),
    )


_RINGS = f"""v AS (SELECT c_custkey // 10 AS feature, CAST(c_custkey % 10 AS INTEGER) AS ring, CAST(i AS INTEGER) AS seq,
  -5.0 + (c_custkey // 10) % 30 + (c_custkey % 10) / 4.0::DOUBLE + (0.2::DOUBLE + ((c_custkey * 7 + i * 13) % 17) / 34.0::DOUBLE) * cos(i * {2 * math.pi / VERTICES!r}::DOUBLE) AS lon,
  40.0 + (c_custkey // 10) % 20 + (c_custkey % 10) / 5.0::DOUBLE + (0.2::DOUBLE + ((c_custkey * 7 + i * 13) % 17) / 34.0::DOUBLE) * sin(i * {2 * math.pi / VERTICES!r}::DOUBLE) AS lat
  FROM customer, range({VERTICES}) t(i)),
e AS (SELECT a.feature, a.ring, a.lon AS x, a.lat AS y, b.lon AS nx, b.lat AS ny FROM v a JOIN v b ON a.feature = b.feature AND a.ring = b.ring AND b.seq = (a.seq + 1) % {VERTICES}),
ctr AS (SELECT feature, sum((x + nx) * (x * ny - nx * y)) / (3 * sum(x * ny - nx * y)) AS lon0, sum((y + ny) * (x * ny - nx * y)) / (3 * sum(x * ny - nx * y)) AS lat0 FROM e GROUP BY feature)"""
_AX, _AY = laea_sql("lon", "lat", "lon0", "lat0")


@query(
    "largest_polygon",
    f"""WITH {_RINGS}, p AS (SELECT v.feature, ring, seq, {_AX} AS x, {_AY} AS y FROM v JOIN ctr USING (feature)),
    a AS (SELECT a.feature, a.ring, abs(sum(a.x * b.y - b.x * a.y)) / 2 AS area FROM p a JOIN p b ON a.feature = b.feature AND a.ring = b.ring AND b.seq = (a.seq + 1) % {VERTICES} GROUP BY ALL)
    SELECT feature, CAST(max(area) / 1e6 AS BIGINT) AS area_km2 FROM a GROUP BY feature""",
)
def largest_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = vertices(spark, sf_dir)
    areas = G.ring_areas(shapes, G.feature_centres(shapes))
    return G.largest_rings(areas).select("feature", F.rint(F.col("area") / 1e6).cast("bigint").alias("area_km2"))


_E2 = P.WGS84_FLATTENING * (2 - P.WGS84_FLATTENING)
_E1 = math.sqrt(_E2)
_QP = 1 - (1 - _E2) / (2 * _E1) * math.log((1 - _E1) / (1 + _E1))
_RQ = P.EARTH_RADIUS * math.sqrt(_QP / 2)
_Q_OF = "(1 - {e2!r}::DOUBLE) * (sin(t) / (1 - {e2!r}::DOUBLE * sin(t) * sin(t)) - ln((1 - {e!r}::DOUBLE * sin(t)) / (1 + {e!r}::DOUBLE * sin(t))) / (2 * {e!r}::DOUBLE))".format(e2=_E2, e=_E1)
# Latitude from the authalic q by Newton steps, written out.
_NEWTON = "t + (1 - {e2!r}::DOUBLE * sin(t) * sin(t)) ** 2 / (2 * cos(t)) * (q / (1 - {e2!r}::DOUBLE) - sin(t) / (1 - {e2!r}::DOUBLE * sin(t) * sin(t)) + ln((1 - {e!r}::DOUBLE * sin(t)) / (1 + {e!r}::DOUBLE * sin(t))) / (2 * {e!r}::DOUBLE))".format(e2=_E2, e=_E1)


def _newton(source: str, steps: int) -> str:
    for _ in range(steps):
        source = f"SELECT * REPLACE ({_NEWTON} AS t) FROM ({source})"
    return source


@query(
    "buffered_bounds",
    f"""WITH {_RINGS}, p AS (SELECT v.feature, ring, seq, lon0, lat0, {_AX} AS x, {_AY} AS y FROM v JOIN ctr USING (feature)),
    a AS (SELECT a.feature, a.ring, abs(sum(a.x * b.y - b.x * a.y)) / 2 AS area FROM p a JOIN p b ON a.feature = b.feature AND a.ring = b.ring AND b.seq = (a.seq + 1) % {VERTICES} GROUP BY ALL),
    best AS (SELECT feature, max({{'a': area, 'r': -ring}}) AS b FROM a GROUP BY feature),
    g AS (SELECT p.feature, radians(lon0) AS l0, radians(lat0) AS t, x + 80000 * cos(i * {2 * math.pi / 64!r}::DOUBLE) AS gx, y + 80000 * sin(i * {2 * math.pi / 64!r}::DOUBLE) AS gy
      FROM p JOIN best ON p.feature = best.feature AND p.ring = -best.b.r, range(64) k(i)),
    c AS (SELECT *, asin({_Q_OF} / {_QP!r}::DOUBLE) AS b1, {P.EARTH_RADIUS!r}::DOUBLE * cos(t) / sqrt(1 - {_E2!r}::DOUBLE * sin(t) * sin(t)) / ({_RQ!r}::DOUBLE * cos(asin({_Q_OF} / {_QP!r}::DOUBLE))) AS d FROM g),
    r AS (SELECT *, sqrt(gx * gx / (d * d) + d * d * gy * gy) AS rho FROM c), s AS (SELECT *, 2 * asin(rho / (2 * {_RQ!r}::DOUBLE)) AS ce FROM r),
    w AS (SELECT feature, degrees(l0 + atan2(gx * sin(ce), d * rho * cos(b1) * cos(ce) - d * d * gy * sin(b1) * sin(ce))) AS lon,
      {_QP!r}::DOUBLE * (cos(ce) * sin(b1) + d * gy * sin(ce) * cos(b1) / rho) AS q FROM s),
    z AS ({_newton("SELECT feature, lon, q, asin(q / 2) AS t FROM w", 6)})
    SELECT feature, round(min(lon), 6) AS west, round(min(degrees(t)), 6) AS south, round(max(lon), 6) AS east, round(max(degrees(t)), 6) AS north FROM z GROUP BY feature""",
)
def buffered_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the largest ring of each feature, grown by 80 km."""
    grown = G.buffered_bounds(vertices(spark, sf_dir), buffer_km=80.0)
    return grown.select("feature", *[F.round(side, 6).alias(side) for side in ("west", "south", "east", "north")])


@query(
    "feature_match",
    """WITH f AS (SELECT c_custkey AS ord, CASE WHEN c_custkey % 3 = 0 THEN '-99' ELSE 'N' || c_nationkey END AS iso, 'N' || (c_nationkey + 10) AS iso_eh, 'S' || (c_custkey % 100) AS admin FROM customer),
    s AS (SELECT s_suppkey AS spec_id, 'N' || (s_nationkey + 5) AS iso, 'S' || (s_suppkey % 200) AS admin FROM supplier)
    SELECT spec_id, min(f.ord) AS ord FROM s LEFT JOIN f ON f.iso = s.iso OR f.iso_eh = s.iso OR f.admin = s.admin GROUP BY spec_id""",
)
def feature_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First feature of each spec by code, by alternate code or by name."""
    nation, key = F.col("c_nationkey"), F.col("c_custkey")
    features = table(spark, sf_dir, "customer").select(
        key.alias("ord"),
        F.when(key % 3 == 0, "-99").otherwise(F.concat(F.lit("N"), nation.cast("string"))).alias("iso_a2"),
        F.concat(F.lit("N"), (nation + 10).cast("string")).alias("iso_a2_eh"),
        F.concat(F.lit("S"), (key % 100).cast("string")).alias("admin_name"),
    )
    specs = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("spec_id"),
        F.concat(F.lit("N"), (F.col("s_nationkey") + 5).cast("string")).alias("iso"),
        F.concat(F.lit("S"), (F.col("s_suppkey") % 200).cast("string")).alias("admin"),
    )
    return G.match_features(specs, features, [("iso", "iso_a2"), ("iso", "iso_a2_eh"), ("admin", "admin_name")])
