"""Raster cells, file catalogs and notifications derived from the test tables.

Each view exists twice: as a DataFrame and as the text of a SQL common table
expression with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID = 32
GROUP_SIZE = 6  # source frames merged into one dense scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster observations: several rows may fall in one cell."""
    source = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_shipdate", "l_partkey", "l_suppkey", "l_discount", "l_quantity"
    )
    days = F.datediff(F.col("l_shipdate"), F.lit("1995-01-01").cast("date"))
    value = (
        F.when(F.col("l_discount") == 0, F.lit(None).cast("double"))
        .when(F.col("l_discount") >= 0.095, F.lit(float("-inf")))
        .otherwise(F.col("l_quantity") * 3 * 0.5 - 32.0)
    )
    return source.select(
        F.when(F.col("l_returnflag") == "A", "cz_maxz").when(F.col("l_returnflag") == "N", "opera_dbzh").otherwise("it_sri_arco").alias("input_id"),
        F.floor(days / 30).cast("int").alias("k"),
        (F.col("l_partkey") % GRID).cast("int").alias("row"),
        (F.col("l_suppkey") % GRID).cast("int").alias("col"),
        value.alias("value"),
    )


OBS = f"""obs AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'cz_maxz' WHEN 'N' THEN 'opera_dbzh' ELSE 'it_sri_arco' END AS input_id,
         CAST(floor(date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) / 30) AS INTEGER) AS k,
         CAST(l_partkey % {GRID} AS INTEGER) AS "row", CAST(l_suppkey % {GRID} AS INTEGER) AS "col",
         CASE WHEN l_discount = 0 THEN CAST(NULL AS DOUBLE)
              WHEN l_discount >= 0.095 THEN CAST('-Infinity' AS DOUBLE)
              ELSE l_quantity * 3 * CAST(0.5 AS DOUBLE) - CAST(32.0 AS DOUBLE) END AS value
  FROM lineitem)"""

# One row per cell and input frame.
CELLS = OBS + """, cells AS (SELECT input_id, k, "row", "col", max(value) AS value FROM obs GROUP BY ALL)"""


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense frames: all inputs of six consecutive source frames, largest value per cell."""
    return (
        obs(spark, sf_dir)
        .groupBy(F.floor(F.col("k") / GROUP_SIZE).cast("int").alias("k"), "row", "col")
        .agg(F.max("value").alias("value"))
    )


SCAN = OBS + f""", scan AS (
  SELECT CAST(k // {GROUP_SIZE} AS INTEGER) AS k, "row", "col", max(value) AS value FROM obs GROUP BY ALL)"""

# Number columns of a dense grid, for oracles that need every cell.
AXIS = f"""axis AS (SELECT CAST(i AS INTEGER) AS i FROM range({GRID}) t(i))"""


def settled(df: DataFrame) -> DataFrame:
    """Value as a state plus a number that is NULL unless finite, so hashes are stable."""
    from ..functions.values import cell_state, is_echo

    return df.withColumns(
        {"state": cell_state(F.col("value")), "value": F.when(is_echo(F.col("value")), F.round(F.col("value"), 6))}
    )


SETTLED = """CASE WHEN value IS NULL THEN 'nodata' WHEN value = CAST('-Infinity' AS DOUBLE) THEN 'undetect' ELSE 'echo' END AS state,
       CASE WHEN isfinite(value) THEN round(value, 6) END AS value"""


NOW = "2024-01-31 00:00:00"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File catalog with gaps, wrong suffixes, partial and empty files."""
    source = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    floor_ts = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 300) * 300).cast("timestamp_ntz")
    suffix = F.when(F.col("event_id") % 7 == 0, ".txt").when(F.col("event_id") % 11 == 0, ".hdf.part").otherwise(".hdf")
    name = F.concat("event_type", F.lit("_"), F.date_format(floor_ts, "yyyyMMddHHmmss"), suffix)
    return source.select(
        F.col("event_type").alias("input_id"),
        floor_ts.alias("slot_ts"),
        name.alias("filename"),
        F.concat(F.lit("/data/"), F.col("event_type"), F.lit("/"), name).alias("path"),
        (F.col("event_id") % 5).alias("length"),
        F.col("ts").alias("modified"),
        "event_id",
        "user_id",
    )


FILES = """files AS (
  SELECT event_type AS input_id, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2000-01-01') AS slot_ts,
         event_type || '_' || strftime(time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2000-01-01'), '%Y%m%d%H%M%S') ||
           CASE WHEN event_id % 7 = 0 THEN '.txt' WHEN event_id % 11 = 0 THEN '.hdf.part' ELSE '.hdf' END AS filename,
         event_id % 5 AS length, ts AS modified, event_id, user_id
  FROM events)"""

# Files the catalog scan keeps, without a retention cutoff.
GOOD_FILES = FILES + """, good AS (
  SELECT input_id, slot_ts AS frame_ts, '/data/' || input_id || '/' || filename AS path, filename, length, modified, event_id, user_id
  FROM files WHERE filename LIKE '%.hdf')"""


def catalog_inputs(spark: SparkSession, retention_s: int | None = 7200) -> DataFrame:
    """Input configuration for the file view."""
    from .. import schema

    rows = [
        (name, f"src_{'a' if name in ('click', 'view') else 'b'}", "http_directory", None, "DBZH", [".hdf", ".h5"], "compact", retention_s, 30, 300, True)
        for name in ("click", "error", "purchase", "signup", "view")
    ]
    return spark.createDataFrame(rows, schema.INPUTS)


# Two products: one over a single input, one over two.
PRODUCT_ROWS = [
    ("solo", "Solo radar", 5.0, 45.0, 15.0, 50.0, 47.0, 10.0, 260, 5, 7200, "radar_solo", "dbzh", [("overlay", 1.0), ("overlay_small", 1.5)], None, True, True),
    ("duo", "Duo radar", 0.0, 40.0, 12.0, 48.0, 44.0, 6.0, 480, 10, 7200, "radar_duo", "dbzh", [("overlay", 1.0), ("overlay_small", 1.5)], (0, 0, 0, 0.15), True, True),
    ("off", "Off radar", 0.0, 40.0, 12.0, 48.0, 44.0, 6.0, 260, 20, 7200, "radar_off", "dbzh", [("overlay", 1.0)], None, True, False),
]
BRIDGE_ROWS = [("solo", "purchase", 0), ("duo", "click", 0), ("duo", "view", 1), ("off", "view", 0)]


def products(spark: SparkSession) -> DataFrame:
    from .. import schema

    return spark.createDataFrame(PRODUCT_ROWS, schema.PRODUCTS)


def product_inputs(spark: SparkSession) -> DataFrame:
    from .. import schema

    return spark.createDataFrame(BRIDGE_ROWS, schema.PRODUCT_INPUTS)


BRIDGE = """bridge(product_id, input_id, ord, prefix, priority, n) AS (VALUES
  ('solo','purchase',0,'radar_solo',5,1), ('duo','click',0,'radar_duo',10,2), ('duo','view',1,'radar_duo',10,2))"""

READY = GOOD_FILES + ", " + BRIDGE + """, slots AS (SELECT DISTINCT input_id, frame_ts FROM good),
ready AS (
  SELECT product_id, prefix, priority, frame_ts FROM bridge JOIN slots USING (input_id)
  GROUP BY product_id, prefix, priority, n, frame_ts HAVING count(*) = n)"""


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output files already written: image and sidecar names of some frames."""
    from ..functions.names import base_name

    source = files(spark, sf_dir)
    prefix = F.when(F.col("input_id") == "purchase", "radar_solo").otherwise("radar_duo")
    base = base_name(prefix, F.col("slot_ts"))
    kind = F.col("user_id") % 4
    names = F.when(
        kind == 0, F.array(F.concat(base, F.lit(".json")), F.concat(base, F.lit("_overlay.png")), F.concat(base, F.lit("_overlay_small.png")))
    ).when(kind == 1, F.array(F.concat(base, F.lit("_overlay.png"))))
    return (
        source.where(kind <= 1)
        .select(F.explode(names).alias("name"), F.col("event_id").alias("size"), F.col("modified"))
        .groupBy("name").agg(F.max("size").alias("size"), F.max("modified").alias("modified"))
    )


OUTPUTS = """outs AS (
  SELECT name, max(event_id) AS size, max(modified) AS modified FROM (
    SELECT unnest(CASE user_id % 4 WHEN 0 THEN [base || '.json', base || '_overlay.png', base || '_overlay_small.png'] ELSE [base || '_overlay.png'] END) AS name,
           event_id, modified
    FROM (SELECT *, CASE WHEN input_id = 'purchase' THEN 'radar_solo' ELSE 'radar_duo' END || '_' || strftime(slot_ts, '%Y%m%d_%H%M') AS base
          FROM files WHERE user_id % 4 <= 1)) GROUP BY name)"""


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements: topic, JSON payload with one link, event time.

    Payloads are many times larger than the events they are made from, so the
    events are spread before: the file's splits say nothing about the work.
    """
    source = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type").repartition("event_id")
    return source.select(*notification_columns(), "event_id", "user_id")


# A good link stands beside entries that are none, or twelve coverages deep, now and then twenty thousand.
_JUNK_BEFORE = '{"links":["x",null,7,{"type":"application/x-odim","href":5},{"type":"text/html","href":"https://h/a@0@DBZH.h5"},'
_DEEP_BEFORE = '{"links":[],"coverages":["y",' * 12 + '{"links":['
_DEEP_AFTER = "]}" + "]}" * 12


def notification_columns():
    floor_ts = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 300) * 300)
    location = F.when(F.col("user_id") % 3 == 0, "0-20010-0-OPERA").otherwise("0-20000-0-OTHER")
    quantity = F.when(F.col("event_type") == "error", "RATE").otherwise("DBZH")
    href = F.concat(
        F.lit("https://store.example/"), F.col("event_type"), F.lit("@"), F.date_format(floor_ts, "yyyyMMdd'T'HHmm"),
        F.lit("@0@"), quantity, F.when(F.col("event_id") % 7 == 0, ".txt").otherwise(".h5"),
    )
    link = F.concat(
        F.lit('{"href":"'), href, F.lit('","type":"application/x-odim","title":"t'), (F.col("event_id") % 3).cast("string"),
        F.lit('","length":"'), (F.col("event_id") % 100).cast("string"), F.lit('"}'),
    )
    payload = (
        F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("["), link, F.lit("]")))
        .when(F.col("event_id") % 17 == 0, F.lit("not json"))
        .when(F.col("event_id") % 2 == 0, F.concat(F.lit(_JUNK_BEFORE), link, F.lit("]}")))
        .when(F.col("event_id") % 499 == 0, F.concat(F.repeat(F.lit('{"coverages":['), F.lit(20_000)), F.lit('{"links":['), link, F.lit("]}"), F.repeat(F.lit("]}"), F.lit(20_000))))
        .otherwise(F.concat(F.lit(_DEEP_BEFORE), link, F.lit(_DEEP_AFTER)))
    )
    topic = F.concat(F.lit("ORD/eu.eumetnet/"), location, F.lit("/"), quantity)
    topic = F.when(F.col("event_id") % 19 == 0, F.concat(topic, F.lit("/extra"))).otherwise(topic)
    return topic.alias("topic"), payload.alias("payload"), F.col("ts").cast("timestamp").alias("ts")


NOTES = """notes AS (
  SELECT event_id, user_id, ts, topic, link, loc, qty,
         CASE WHEN event_id % 13 = 0 THEN '[' || link || ']' WHEN event_id % 17 = 0 THEN 'not json'
              ELSE '{}' END AS payload, href
  FROM (SELECT *, 'ORD/eu.eumetnet/' || loc || '/' || qty || CASE WHEN event_id % 19 = 0 THEN '/extra' ELSE '' END AS topic,
               '{"href":"' || href || '","type":"application/x-odim","title":"t' || (event_id % 3) || '","length":"' || (event_id % 100) || '"}' AS link
        FROM (SELECT *, 'https://store.example/' || event_type || '@' ||
                     strftime(time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2000-01-01'), '%Y%m%dT%H%M') || '@0@' || qty ||
                     CASE WHEN event_id % 7 = 0 THEN '.txt' ELSE '.h5' END AS href
              FROM (SELECT *, CASE WHEN user_id % 3 = 0 THEN '0-20010-0-OPERA' ELSE '0-20000-0-OTHER' END AS loc,
                           CASE WHEN event_type = 'error' THEN 'RATE' ELSE 'DBZH' END AS qty FROM events))))"""
