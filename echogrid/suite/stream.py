"""Queries whose work is done by a stream, their batch twins, and the sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import registry
from ..functions import values as V
from ..operators import cells as C
from ..operators import warp as Wp
from ..plans import nowcast as Now
from ..plans import render
from ..session import shared_dir
from ..sinks import forecast_store, overlay, sidecar
from ..streaming import frames as Fr
from ..streaming import notifications as No
from ..streaming import state as St
from . import query
from .jobs import _TASKS
from .motion import _POINTS, frame_time, scan_grids, scan_history, whole_runs
from .raster import _pooled
from .views import AXIS, BRIDGE, CELLS, FILES, GOOD_FILES, GRID, NOTES, NOW, OBS, OUTPUTS, SCAN, catalog_inputs, files, notification_columns, obs, outputs, product_inputs, products, scan, table

_EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    return spark.readStream.schema(_EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all there is and return what its batches emitted, with ``batch_id``."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch_id={batch_id}")

    running = (
        stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.schema(schema).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")


@query(
    "stream_announced_files",
    f"""WITH {NOTES} SELECT DISTINCT 'opera_dbzh' AS input_id, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2000-01-01') AS frame_ts, href AS url, list_last(string_split(href, '/')) AS filename FROM notes
    WHERE event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0 AND loc = '0-20010-0-OPERA' AND qty = 'DBZH' AND href LIKE '%.h5'""",
)
def stream_announced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements streamed through topic match, link extraction and deduplication."""
    messages = event_stream(spark, sf_dir).select(*notification_columns())
    found = No.announced_file_stream(messages, registry.inputs(spark))
    return drained(found.select("input_id", "frame_ts", "url", "filename"), "append").drop("batch_id")


_COUNTS = "SELECT event_type AS input_id, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2000-01-01') AS frame_ts, count(*) AS n FROM events GROUP BY ALL"


@query("frame_window_counts", _COUNTS)
def frame_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fr.frame_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("input_id"), "ts"), "ts")


@query("stream_window_counts", _COUNTS)
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from a stream in update mode: the last update of each window."""
    arrivals = event_stream(spark, sf_dir).select(F.col("event_type").alias("input_id"), F.col("ts").cast("timestamp").alias("ts"))
    updates = drained(Fr.frame_counts(arrivals, "ts", "2 hours"), "update")
    newest = updates.groupBy("input_id", "frame_ts").agg(F.max_by("n", "batch_id").alias("n"))
    return newest.withColumn("frame_ts", F.col("frame_ts").cast("timestamp_ntz"))


@query(
    "stream_readiness",
    f"""WITH {FILES}, {BRIDGE}, slots AS (SELECT DISTINCT input_id, slot_ts AS frame_ts FROM files) SELECT product_id, frame_ts FROM bridge JOIN slots USING (input_id) GROUP BY product_id, n, frame_ts HAVING count(*) = n""",
)
def stream_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products become ready as their inputs arrive on the stream."""
    slot = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 300) * 300)
    arrivals = event_stream(spark, sf_dir).select(F.col("event_type").alias("input_id"), slot.alias("frame_ts"))
    bridge = product_inputs(spark).where("product_id <> 'off'")
    ready = drained(Fr.ready_stream(arrivals, bridge), "update").drop("batch_id").distinct()
    return ready.withColumn("frame_ts", F.col("frame_ts").cast("timestamp_ntz"))


@query("stream_latest_issue", f"WITH {_TASKS} SELECT forecast_id, issue_ts, seq FROM t QUALIFY row_number() OVER (PARTITION BY forecast_id ORDER BY issue_ts DESC, seq DESC) = 1")
def stream_latest_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest issue of each forecast held in keyed state."""
    tasks = event_stream(spark, sf_dir).select(
        F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string")).alias("forecast_id"),
        F.timestamp_add("MINUTE", ((F.col("event_id") * 7) % 9000 * 5).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("issue_ts"),
        F.col("event_id").alias("seq"),
    )
    updates = drained(St.newest_issue_stream(tasks), "update")
    newest = updates.groupBy("forecast_id").agg(F.max_by(F.struct("issue_ts", "seq"), "batch_id").alias("_s"))
    return newest.select("forecast_id", F.col("_s.issue_ts").cast("timestamp_ntz").alias("issue_ts"), F.col("_s.seq").alias("seq"))


_READY = f"""WITH {GOOD_FILES}, {BRIDGE}, {OUTPUTS}, slots AS (SELECT DISTINCT input_id, frame_ts FROM good),
    ready AS (SELECT product_id, prefix, frame_ts FROM bridge JOIN slots USING (input_id) GROUP BY product_id, prefix, n, frame_ts HAVING count(*) = n),
    e AS (SELECT product_id, frame_ts, unnest([b || '.json', b || '_overlay.png', b || '_overlay_small.png']) AS name FROM (SELECT *, prefix || '_' || strftime(frame_ts, '%Y%m%d_%H%M') AS b FROM ready))"""


@query("stream_refresh", f"{_READY} SELECT DISTINCT product_id, frame_ts FROM e WHERE name NOT IN (SELECT name FROM outs)")
def stream_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File arrivals grow the catalog batch by batch; each batch writes the jobs it makes pending."""
    return spark.read.parquet(f"{refreshed(spark, sf_dir)}/jobs").select("product_id", "frame_ts").distinct()


@query(
    "output_notices",
    f"""{_READY} SELECT DISTINCT product_id, frame_ts, CASE WHEN minute(frame_ts) = 35 THEN 'ValueError: no room for ' || product_id END AS error FROM e WHERE name NOT IN (SELECT name FROM outs)""",
)
def output_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listener, which fails at one minute of the hour, made of each pending output."""

    def listener(output: dict) -> None:
        if output["frame_ts"].minute == 35:
            raise ValueError(f"no room for {output['product_id']}")

    return spark.read.parquet(f"{refreshed(spark, sf_dir, listener)}/reports").select("product_id", "frame_ts", "error").distinct()


def refreshed(spark: SparkSession, sf_dir: str, on_output=None) -> str:
    """The folder of a refresh over all file arrivals."""
    slot = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 300) * 300)
    suffix = F.when(F.col("event_id") % 7 == 0, ".txt").when(F.col("event_id") % 11 == 0, ".hdf.part").otherwise(".hdf")
    name = F.concat("event_type", F.lit("_"), F.date_format(slot, "yyyyMMddHHmmss"), suffix)
    arrivals = event_stream(spark, sf_dir).select(
        F.col("event_type").alias("input_id"), F.concat(F.lit("/data/"), "event_type", F.lit("/"), name).alias("path"), name.alias("filename")
    )
    folder = f"{shared_dir(spark)}/refresh-{uuid.uuid4().hex}"
    Fr.refresh_on_arrival(
        arrivals, catalog_inputs(spark, retention_s=None), products(spark), product_inputs(spark), lambda: outputs(spark, sf_dir), folder, f"{folder}/checkpoint", on_output=on_output
    ).awaitTermination()
    return folder


_PERIODS = 5
_SPOKEN = f"""WITH m AS (SELECT 'c' || (event_id % 997) AS conn, ts, CAST(least({_PERIODS}, 1 + (day(ts) - 1) // 6) AS INTEGER) AS p FROM events),
    spoken AS (SELECT conn, p, max(ts) AS last_ts FROM m GROUP BY ALL), heard AS (SELECT p, max(ts) AS newest FROM m GROUP BY p),
    w AS (SELECT conn, p, last_ts, lead(p) OVER (PARTITION BY conn ORDER BY p) AS again FROM spoken)"""


@query(
    "stream_staleness",
    f"""{_SPOKEN} SELECT conn, last_ts, false AS stale FROM spoken
    UNION ALL SELECT w.conn, w.last_ts, true FROM w WHERE EXISTS (SELECT 1 FROM heard h WHERE h.p >= w.p AND h.p < coalesce(w.again, {_PERIODS + 1}) - CASE WHEN w.again IS NULL THEN 0 ELSE 1 END AND epoch_ms(w.last_ts) + 600000 <= epoch_ms(h.newest))""",
)
def stream_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections that speak, fall silent and speak again, heard in five micro-batches by the time of their messages."""
    folder = f"{shared_dir(spark)}/spoken-{uuid.uuid4().hex}"
    period = F.least(F.lit(_PERIODS), F.lit(1) + F.floor((F.dayofmonth("ts") - 1) / 6))
    messages = table(spark, sf_dir, "events").select(F.concat(F.lit("c"), (F.col("event_id") % 997).cast("string")).alias("conn"), F.col("ts").cast("timestamp").alias("ts"), period.alias("p"))
    for p in range(1, _PERIODS + 1):  # a file is a micro-batch
        messages.where(F.col("p") == p).drop("p").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    heard = spark.readStream.schema("conn STRING, ts TIMESTAMP").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    rows = drained(St.staleness_stream(heard, "conn", event_time=True), "update")
    return rows.select("conn", F.timestamp_micros("last_us").cast("timestamp_ntz").alias("last_ts"), "stale")


@query(
    "late_frames",
    f"WITH {FILES} SELECT DISTINCT input_id, slot_ts AS frame_ts FROM files WHERE slot_ts >= TIMESTAMP '{NOW}' - INTERVAL 3 DAY",
)
def late_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames not older than the retention, boundary included."""
    frames = files(spark, sf_dir).select("input_id", F.col("slot_ts").alias("frame_ts")).distinct()
    return Fr.recent_frames(frames, NOW, 3 * 86400)


# --- sinks ---


_TILED = f"""{OBS}, {AXIS}, comp AS (SELECT k, "row", "col", max(value) AS value FROM obs GROUP BY ALL),
  dense AS (SELECT f.k, a.i AS r, b.i AS c, comp.value FROM (SELECT DISTINCT k FROM obs) f CROSS JOIN axis a CROSS JOIN axis b LEFT JOIN comp ON comp.k = f.k AND comp."row" = a.i AND comp."col" = b.i),
  v AS (SELECT k, 'overlay' AS variant, {GRID} AS size, r, c, value FROM dense
    UNION ALL SELECT k, 'overlay_small', 21, CAST({_pooled('r', 21)} AS INTEGER), CAST({_pooled('c', 21)} AS INTEGER), max(value) FROM dense GROUP BY ALL),
  shown AS (SELECT k, variant, CAST(r // 16 AS INTEGER) AS tile_r, CAST(c // 16 AS INTEGER) AS tile_c, size, CASE WHEN value IS NULL THEN 16 WHEN value < 4 THEN 15 ELSE CAST(least(floor((value - 4) / 4), 14) AS INTEGER) END AS idx FROM v),
  pal AS (SELECT CAST(i - 1 AS INTEGER) AS idx, lower(colors[i]) || 'ff' AS rgba FROM (SELECT {list(registry.STANDARD_COLORS)!r} AS colors), range(1, 16) t(i) UNION ALL VALUES (15, '#00000000'), (16, '#00000026'))"""


@query(
    "overlay_tiles",
    f"""WITH {_TILED} SELECT k, variant, tile_r, tile_c, CAST(least(16, size - tile_r * 16) AS INTEGER) AS height, CAST(least(16, size - tile_c * 16) AS INTEGER) AS width, CAST(idx AS INTEGER) AS idx, rgba, count(*) AS n,
      11.25 + k AS west, 48.0625::DOUBLE AS south, 19.5 + k AS east, 51.5::DOUBLE AS north, NULL::VARCHAR AS error FROM shown JOIN pal USING (idx) GROUP BY ALL""",
)
def overlay_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG tiles of every frame and variant, read back: cells by palette entry, size and the bounds in the comment."""
    merged = C.max_cells(obs(spark, sf_dir), ["k"]).withColumns({"height": F.lit(GRID), "width": F.lit(GRID)})
    grids = merged.select("k").distinct().withColumns({"height": F.lit(GRID), "width": F.lit(GRID)})
    dense = C.densify(merged, grids, ["k"]).withColumns({"height": F.lit(GRID), "width": F.lit(GRID)})
    bounds = overlay.geobox_text(F.lit(11.25) + F.col("k"), F.lit(48.0625), F.lit(19.5) + F.col("k"), F.lit(51.5))
    tiles = render.render_tiles(dense, ["k"], nodata_rgba=registry.NODATA_TINT, tile=16, geobox=bounds)
    shown = overlay.read_tiles(tiles, ["k", "variant", "tile_r", "tile_c"])
    return shown.withColumns(overlay.geobox_numbers(F.col("comment"))).drop("comment")


@query(
    "render_pipelines",
    f"""WITH {CELLS}, route(product_id, input_id, several, small) AS (VALUES ('cz', 'cz_maxz', false, false), ('it', 'opera_dbzh', true, false), ('it', 'it_sri_arco', true, false), ('md', 'opera_dbzh', false, true), ('xx', 'cz_maxz', true, true), ('xx', 'opera_dbzh', true, true)),
    m AS (SELECT product_id, small, k, "row" AS r, "col" AS c, max(value) AS value FROM cells JOIN route USING (input_id) GROUP BY ALL),
    v AS (SELECT product_id, k, 'overlay' AS variant, {GRID} AS size, r, c, value FROM m WHERE NOT small
      UNION ALL SELECT product_id, k, 'overlay_small', 21, CAST({_pooled('r', 21)} AS INTEGER), CAST({_pooled('c', 21)} AS INTEGER), max(value) FROM m WHERE NOT small GROUP BY ALL
      UNION ALL SELECT product_id, k, 'thumb', 8, CAST(r // 4 AS INTEGER), CAST(c // 4 AS INTEGER), max(value) FROM m WHERE small GROUP BY ALL)
    SELECT product_id, k, variant, CAST(size AS INTEGER) AS out_height, CAST(CASE WHEN value IS NULL OR value < 4 THEN 15 ELSE least(floor((value - 4) / 4), 14) END AS SMALLINT) AS idx, count(*) AS n FROM v GROUP BY ALL""",
)
def render_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four products through two pipelines, with one input and with several, counted by palette entry."""
    chosen = spark.createDataFrame([("cz", None), ("it", "default"), ("md", "thumbs"), ("xx", "thumbs")], "product_id string, pipeline string")
    inputs = spark.createDataFrame([("cz", "cz_maxz"), ("it", "opera_dbzh"), ("it", "it_sri_arco"), ("md", "opera_dbzh"), ("xx", "cz_maxz"), ("xx", "opera_dbzh")], "product_id string, input_id string")
    small = (("thumb", 4.0),)
    thumbs = render.RenderPipeline(lambda cells, keys: render.classify_single(cells, keys, specs=small), lambda cells, keys: render.classify_composite(cells, keys, specs=small))
    cells = C.max_cells(obs(spark, sf_dir), ["input_id", "k"]).withColumns({"height": F.lit(GRID), "width": F.lit(GRID)})
    classes = render.render_products(cells, chosen, inputs, ["k"], render.RENDER_PIPELINES | {"thumbs": thumbs})
    return classes.groupBy("product_id", "k", "variant", "out_height", "idx").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sidecar_documents",
    f"""WITH {GOOD_FILES}, g AS (SELECT DISTINCT input_id, frame_ts, filename, 'radar_' || input_id || '_' || strftime(frame_ts, '%Y%m%d_%H%M') AS base FROM good)
    SELECT base, strftime(any_value(frame_ts), '%Y-%m-%dT%H:%M:%S') AS timestamp, string_agg(filename, ',' ORDER BY filename) AS sources, '{GRID}' AS width, '21' AS small_width, base || '_overlay_small.png' AS small_file, '11.27' AS west FROM g GROUP BY base""",
)
def sidecar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read back from the sidecar of every catalog frame."""
    from .catalog import full_catalog
    from ..functions.names import base_name

    index = full_catalog(spark, sf_dir).withColumn("base", base_name(F.concat(F.lit("radar_"), "input_id"), F.col("frame_ts")))
    frames = index.select("base", "frame_ts").distinct().withColumns(
        {"quantity": F.lit("DBZH"), "palette": F.lit("dbzh"), "crs": F.lit("EPSG:3857"), "west": F.lit(11.27), "south": F.lit(48.05), "east": F.lit(19.62),
         "north": F.lit(51.46), "height": F.lit(GRID), "width": F.lit(GRID)}
    )
    sources = index.select("base", F.lit(0).alias("ord"), F.col("filename").alias("name"))
    documents = sidecar.sidecars(frames.drop("height", "width"), sources, render.variant_manifest(frames))
    field = lambda path: F.get_json_object("sidecar", path)
    names_ = F.array_join(F.from_json(field("$.sources"), "array<string>"), ",")
    return documents.select(
        "base", field("$.timestamp").alias("timestamp"), names_.alias("sources"), field("$.variants.overlay.width").alias("width"),
        field("$.variants.overlay_small.width").alias("small_width"), field("$.variants.overlay_small.file").alias("small_file"), field("$.bounds.west").alias("west"),
    )


_BRIDGE_VALUES = ", ".join(
    f"('{row[0]}', '{inp}')" for row in registry.product_rows() for inp in registry.PRODUCT_INPUTS.get(row[0], ("opera_dbzh",))
)


@query(
    "variant_manifest",
    f"""WITH {OBS}, p(product_id, input_id) AS (VALUES {_BRIDGE_VALUES}),
    b AS (SELECT DISTINCT 'radar_' || product_id || '_' || strftime(TIMESTAMP '2026-06-05' + INTERVAL 5 MINUTE * k, '%Y%m%d_%H%M') AS base FROM obs JOIN p USING (input_id))
    SELECT base, variant, base || '_' || variant || '.png' AS file, CAST(size AS INTEGER) AS width, CAST(size AS INTEGER) AS height FROM b, (VALUES ('overlay', {GRID}), ('overlay_small', 21)) v(variant, size)""",
)
def variant_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and sizes of every product frame's variants."""
    frames = obs(spark, sf_dir).select("input_id", frame_time(F.col("k")).alias("frame_ts")).distinct()
    routed = frames.join(F.broadcast(registry.product_inputs(spark)), "input_id").select("product_id", "frame_ts").distinct()
    named = render.named_frames(routed, registry.products(spark))
    return render.variant_manifest(named.withColumns({"height": F.lit(GRID), "width": F.lit(GRID)}))


@query(
    "forecast_store",
    f"""WITH {SCAN}, h AS (SELECT CAST(k // 3 AS INTEGER) AS forecast_id, max(k) AS k FROM scan GROUP BY k // 3 HAVING count(DISTINCT k) >= 2)
    SELECT 'f' || forecast_id AS forecast_id, TIMESTAMP '2026-06-05' + INTERVAL 5 MINUTE * h.k AS issue_ts, CAST(m AS INTEGER) AS lead_min, "row", "col", CAST(value AS DOUBLE) AS value FROM h JOIN scan USING (k), (VALUES (10), (20)) l(m) WHERE value > 4""",
)
def forecast_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistence forecasts written twice to the store and read back: the newer issue replaces the older."""
    return forecast_store.read_fields(spark, filled_store(spark, sf_dir)).select("forecast_id", "issue_ts", "lead_min", "row", "col", F.col("value").cast("double").alias("value"))


@query(
    "stored_minutes",
    f"""WITH {SCAN}, h AS (SELECT CAST(k // 3 AS INTEGER) AS forecast_id, max(k) AS k FROM scan GROUP BY k // 3 HAVING count(DISTINCT k) >= 2)
    SELECT 'f' || forecast_id AS forecast_id, TIMESTAMP '2026-06-05' + INTERVAL 5 MINUTE * k AS issue_ts, CAST(m AS INTEGER) AS lead_min FROM h, (VALUES (10), (20)) l(m)""",
)
def stored_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads that the store lists for each forecast's issue, read without a cell."""
    return forecast_store.read_frames(spark, filled_store(spark, sf_dir)).select("forecast_id", "issue_ts", "lead_min")


def filled_store(spark: SparkSession, sf_dir: str) -> str:
    """A store that received every forecast's oldest issue, then its newest."""
    history = whole_runs(scan_history(spark, sf_dir))
    cells = scan(spark, sf_dir).select(F.floor(F.col("k") / 3).cast("int").alias("forecast"), frame_time(F.col("k")).alias("frame_ts"), "row", "col", "value")
    folder = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    newest = history.groupBy("forecast").agg(F.max("frame_ts").alias("issue_ts"))
    oldest = history.groupBy("forecast").agg(F.min("frame_ts").alias("issue_ts"))
    for issues in (oldest, newest):
        listed = issues.withColumn("lead_min", F.explode(F.array(F.lit(10), F.lit(20)))).select(
            F.concat(F.lit("f"), F.col("forecast").cast("string")).alias("forecast_id"), "issue_ts", "lead_min", F.timestamp_add("MINUTE", F.col("lead_min"), F.col("issue_ts")).alias("valid_ts")
        )
        latest = cells.withColumnRenamed("frame_ts", "issue_ts").join(issues, ["forecast", "issue_ts"]).where(V.mask_at_or_below(F.col("value"), 4.0).isNotNull())
        stamped = latest.withColumn("forecast_id", F.concat(F.lit("f"), F.col("forecast").cast("string"))).drop("forecast").join(listed, ["forecast_id", "issue_ts"])
        forecast_store.write_fields(stamped, listed, folder)
    return folder
