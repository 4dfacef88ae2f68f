"""Queries over readiness, jobs, history, gaps and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import names
from ..plans import jobs, readiness
from ..sources import discovery
from . import query
from .catalog import NOON, full_catalog
from .views import FILES, GOOD_FILES, NOW, OUTPUTS, READY, catalog_inputs, files, outputs, product_inputs, products, table


def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.ready_timestamps(full_catalog(spark, sf_dir), products(spark), product_inputs(spark))


@query("ready_timestamps", f"WITH {READY} SELECT product_id, frame_ts FROM ready")
def ready_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark, sf_dir)


@query(
    "product_budget",
    f"""WITH {READY}, r(input_id, budget) AS (VALUES ('click', 26), ('error', 26), ('purchase', 290), ('signup', NULL), ('view', 2882)),
    b AS (SELECT product_id, max(budget) AS budget FROM bridge JOIN r USING (input_id) GROUP BY ALL), n AS (SELECT product_id, count(*) AS ready FROM ready GROUP BY ALL)
    SELECT product_id, CAST(budget AS INTEGER) AS budget, ready FROM b JOIN n USING (product_id)""",
)
def product_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to look for per product, the most that one of its inputs keeps, beside its ready frames."""
    keep = F.when(F.col("input_id") == "purchase", 86400).when(F.col("input_id") == "signup", F.lit(None)).when(F.col("input_id") == "view", 864000).otherwise(7200)
    budgets = jobs.product_budget(catalog_inputs(spark).withColumn("retention_s", keep.cast("int")), product_inputs(spark))
    return budgets.join(ready(spark, sf_dir).groupBy("product_id").agg(F.count(F.lit(1)).alias("ready")), "product_id")


@query("job_files", f"WITH {READY} SELECT DISTINCT r.product_id, r.frame_ts, CAST(b.ord AS INTEGER) AS ord, g.input_id, g.path FROM ready r JOIN bridge b USING (product_id) JOIN good g ON g.input_id = b.input_id AND g.frame_ts = r.frame_ts")
def job_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every ready job with their input order."""
    return readiness.job_files(ready(spark, sf_dir), full_catalog(spark, sf_dir), product_inputs(spark))


_EXPECTED = READY + """, want AS (SELECT product_id, frame_ts, priority, prefix || '_' || strftime(frame_ts, '%Y%m%d_%H%M') AS base FROM ready),
expect AS (SELECT *, unnest([base || '.json', base || '_overlay.png', base || '_overlay_small.png']) AS name FROM want)"""
_PENDING = _EXPECTED + ", " + OUTPUTS + ", pending AS (SELECT DISTINCT product_id, frame_ts, priority FROM expect WHERE name NOT IN (SELECT name FROM outs))"


@query("expected_outputs", f"WITH {_EXPECTED} SELECT product_id, frame_ts, base, name FROM expect")
def expected_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.expected_outputs(ready(spark, sf_dir), products(spark))


@query("pending_jobs", f"WITH {_PENDING} SELECT product_id, frame_ts FROM pending")
def pending_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready frames whose sidecar or any variant is missing."""
    return readiness.pending_jobs(ready(spark, sf_dir), products(spark), outputs(spark, sf_dir))


@query("job_order", f"WITH {_PENDING} SELECT product_id, frame_ts, CAST(priority AS INTEGER) AS priority FROM pending ORDER BY priority, frame_ts DESC, product_id")
def job_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending jobs by priority, newest first."""
    return jobs.job_order(pending_jobs(spark, sf_dir), products(spark))


@query(
    "history_frames",
    f"""WITH {READY}, r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY frame_ts DESC) AS n, count(*) OVER (PARTITION BY product_id) AS have, max(frame_ts) OVER (PARTITION BY product_id) AS issue_ts FROM ready)
    SELECT product_id, issue_ts, CAST(4 - n AS INTEGER) AS pos, frame_ts FROM r WHERE n <= 3 AND have >= 3""",
)
def history_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.history_frames(ready(spark, sf_dir), 3)


@query(
    "history_asof",
    f"""WITH {READY}, k AS (SELECT * FROM ready WHERE frame_ts <= TIMESTAMP '{NOON}'),
    r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY frame_ts DESC) AS n, count(*) OVER (PARTITION BY product_id) AS have, max(frame_ts) OVER (PARTITION BY product_id) AS issue_ts FROM k)
    SELECT product_id, issue_ts, CAST(5 - n AS INTEGER) AS pos, frame_ts FROM r WHERE n <= 4 AND have >= 4""",
)
def history_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last four ready frames at or before an issue time."""
    return jobs.history_frames(ready(spark, sf_dir), 4, issue=NOON)


@query(
    "history_steps",
    f"""WITH {READY}, r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY frame_ts DESC) AS n FROM ready)
    SELECT product_id, CAST(count(*) AS INTEGER) AS frames, max(frame_ts) AS issue_frame, CAST(date_diff('second', max(CASE WHEN n = 2 THEN frame_ts END), max(frame_ts)) AS DOUBLE) / 60 AS dt_min FROM r WHERE n <= 3 GROUP BY product_id""",
)
def history_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes between the two newest frames of each history."""
    from ..plans.nowcast import history_steps as steps

    return steps(jobs.history_frames(ready(spark, sf_dir), 3), ["product_id"])


def forecasts(spark: SparkSession) -> DataFrame:
    rows = [(f"{name}_forecast", name, "lucas_kanade", [20, 10, 30, 10], 3, 1010, 2, None, 2, True) for name in ("solo", "duo")]
    return spark.createDataFrame(rows, schema.FORECASTS)


@query(
    "wanted_forecasts",
    f"""WITH {READY}, {OUTPUTS}, r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY frame_ts DESC) AS n, max(frame_ts) OVER (PARTITION BY product_id) AS issue_ts FROM ready)
    SELECT product_id || '_forecast' AS forecast_id, product_id, issue_ts, CAST(4 - n AS INTEGER) AS pos, frame_ts FROM r WHERE n <= 3""",
)
def wanted_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories of forecasts with at least one output missing (here: all of them)."""
    history = jobs.history_frames(ready(spark, sf_dir), 3)
    return jobs.wanted_forecasts(history, forecasts(spark), products(spark), outputs(spark, sf_dir))


def stored_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored forecast fields of every file's slot; some have no readable metadata."""
    return files(spark, sf_dir).select(
        F.when(F.col("input_id") == "purchase", "solo_forecast").otherwise("duo_forecast").alias("forecast_id"),
        F.when(F.col("event_id") % 9 != 0, F.col("slot_ts")).alias("issue_ts"),
        (F.col("user_id") % 3 * 10 + 10).cast("int").alias("lead_min"), "user_id",
    )


_FIELDS = FILES + """, fld AS (SELECT CASE input_id WHEN 'purchase' THEN 'solo' ELSE 'duo' END AS p, slot_ts AS issue_ts, CAST(user_id % 3 * 10 + 10 AS INTEGER) AS lead_min, user_id FROM files WHERE event_id % 9 <> 0),
fb AS (SELECT *, 'radar_' || p || '_' || strftime(issue_ts, '%Y%m%d_%H%M') || '_fct' || lead_min AS base FROM fld),
done AS (SELECT DISTINCT unnest(CASE user_id % 5 WHEN 0 THEN [base || '.json', base || '_overlay.png', base || '_overlay_small.png'] WHEN 1 THEN [base || '.json'] ELSE [] END) AS name FROM fb)"""


@query(
    "forecast_render_units",
    f"""WITH {_FIELDS}, e AS (SELECT *, unnest([base || '.json', base || '_overlay.png', base || '_overlay_small.png']) AS name FROM fb)
    SELECT DISTINCT p || '_forecast' AS forecast_id, issue_ts, lead_min, base FROM e WHERE name NOT IN (SELECT name FROM done)""",
)
def forecast_render_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored fields whose outputs are incomplete."""
    fields = stored_fields(spark, sf_dir)
    named = readiness.expected_forecast_outputs(fields.where(F.col("issue_ts").isNotNull()), forecasts(spark), products(spark))
    kind = F.col("user_id") % 5
    done = named.where((kind == 0) | ((kind == 1) & F.endswith("name", F.lit(".json")))).select("name").distinct()
    return readiness.forecast_render_units(fields.drop("user_id"), forecasts(spark), products(spark), done)


@query("missing_files", f"WITH {FILES} SELECT DISTINCT input_id, filename FROM files WHERE (input_id, filename) NOT IN (SELECT (input_id, filename) FROM files WHERE length > 0 AND user_id % 2 = 0)")
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announced files without a non-empty local copy."""
    remote = files(spark, sf_dir).select("input_id", "filename").distinct()
    return readiness.missing_files(remote, files(spark, sf_dir).where("user_id % 2 = 0"))


@query(
    "wanted_downloads",
    f"""WITH {GOOD_FILES} SELECT DISTINCT input_id, frame_ts, filename FROM good WHERE frame_ts >= TIMESTAMP '{NOON}' - INTERVAL 2 HOUR
    AND (input_id, filename) NOT IN (SELECT (input_id, filename) FROM files WHERE length > 0 AND user_id % 2 = 0)""",
)
def wanted_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, for frames inside retention only."""
    remote = full_catalog(spark, sf_dir).select("input_id", "frame_ts", "filename")
    return discovery.wanted_downloads(remote, files(spark, sf_dir).where("user_id % 2 = 0"), catalog_inputs(spark), NOON).select("input_id", "frame_ts", "filename").distinct()


_UPLOADS = """img AS (SELECT name AS path, size, epoch_us(modified) * 1000 AS mtime_ns FROM outs), st AS (
  SELECT CASE WHEN size % 5 = 0 THEN 'gone_' || path ELSE path END AS path, size + CASE WHEN size % 7 = 0 THEN 1 ELSE 0 END AS size, mtime_ns + CASE WHEN size % 3 = 0 THEN 1 ELSE 0 END AS mtime_ns FROM img WHERE path LIKE '%.png' AND size % 2 = 0)"""


def uploads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Output images and an upload record that disagrees with some of them."""
    images = outputs(spark, sf_dir).select(F.col("name").alias("path"), "size", (F.unix_micros(F.col("modified").cast("timestamp")) * 1000).alias("mtime_ns"))
    size = F.col("size")
    state = images.where((size % 2 == 0) & F.endswith("path", F.lit(".png"))).select(
        F.when(size % 5 == 0, F.concat(F.lit("gone_"), F.col("path"))).otherwise(F.col("path")).alias("path"),
        (size + F.when(size % 7 == 0, 1).otherwise(0)).alias("size"),
        (F.col("mtime_ns") + F.when(size % 3 == 0, 1).otherwise(0)).alias("mtime_ns"),
    )
    return images, state


@query("upload_reconcile", f"WITH {FILES}, {OUTPUTS}, {_UPLOADS} SELECT path, size, mtime_ns FROM img WHERE path LIKE '%.png' AND (path, size, mtime_ns) NOT IN (SELECT (path, size, mtime_ns) FROM st)")
def upload_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose upload record is missing or does not match."""
    return readiness.pending_uploads(*uploads(spark, sf_dir))


@query("state_prune", f"WITH {FILES}, {OUTPUTS}, {_UPLOADS} SELECT path, size, mtime_ns FROM st WHERE path IN (SELECT path FROM img WHERE path LIKE '%.png')")
def state_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload records whose image still exists."""
    images, state = uploads(spark, sf_dir)
    return readiness.pruned_state(state, images)


def overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlays of the single-product layout written for some slots."""
    source = files(spark, sf_dir)
    ts, key = F.col("slot_ts"), F.col("event_id")
    some = F.filter(
        F.array(
            F.when(key % 2 == 0, names.overlay_name(ts, F.lit("overlay"))),
            F.when(key % 3 == 0, names.overlay_name(ts, F.lit("overlay_extended"))),
            F.when(key % 5 == 0, names.overlay_name(ts, F.lit("overlay2x_extended"))),
        ),
        lambda name: name.isNotNull(),
    )
    return source.select(F.explode(some).alias("name")).distinct()


_OVERLAYS = """ov AS (SELECT DISTINCT unnest([CASE WHEN event_id % 2 = 0 THEN 'radar_' || s || '_overlay.png' END, CASE WHEN event_id % 3 = 0 THEN 'radar_' || s || '_overlay_extended.png' END,
  CASE WHEN event_id % 5 = 0 THEN 'radar_' || s || '_overlay2x_extended.png' END]) AS name FROM (SELECT event_id, strftime(slot_ts, '%Y%m%d_%H%M') AS s FROM files)),
ls AS (SELECT DISTINCT input_id AS source_id, slot_ts AS frame_ts, filename, strftime(slot_ts, '%Y%m%d_%H%M') AS s FROM files WHERE filename LIKE '%.hdf')"""


def listing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(F.endswith("filename", F.lit(".hdf"))).select(F.col("input_id").alias("source_id"), "filename").distinct()


@query(
    "overlay_backlog",
    f"""WITH {FILES}, {_OVERLAYS}, r AS (SELECT * FROM ls QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY filename DESC) <= 40)
    SELECT source_id, filename, frame_ts, 'radar_' || s || '_overlay.png' AS name FROM r WHERE name NOT IN (SELECT name FROM ov WHERE name IS NOT NULL)""",
)
def overlay_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest forty names of each source that have no overlay."""
    return readiness.overlay_backlog(listing_names(spark, sf_dir), overlays(spark, sf_dir), 40).orderBy("frame_ts")


@query(
    "extended_backlog",
    f"""WITH {FILES}, {_OVERLAYS} SELECT source_id, filename, frame_ts FROM ls WHERE 'radar_' || s || '_overlay.png' IN (SELECT name FROM ov)
    AND NOT ('radar_' || s || '_overlay_extended.png' IN (SELECT name FROM ov WHERE name IS NOT NULL) AND 'radar_' || s || '_overlay2x_extended.png' IN (SELECT name FROM ov WHERE name IS NOT NULL))
    AND filename IN (SELECT filename FROM files WHERE user_id % 2 = 1)""",
)
def extended_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with a standard overlay, an extended one missing, and the input at hand."""
    return readiness.extended_backlog(listing_names(spark, sf_dir), overlays(spark, sf_dir), files(spark, sf_dir).where("user_id % 2 = 1"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast tasks in arrival order; a task may carry an older issue than one before it."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string")).alias("forecast_id"),
        F.timestamp_add("MINUTE", ((F.col("event_id") * 7) % 9000 * 5).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("issue_ts"),
        F.col("event_id").alias("seq"),
    )


_TASKS = "t AS (SELECT 'f' || (user_id % 40) AS forecast_id, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * ((event_id * 7) % 9000 * 5) AS issue_ts, event_id AS seq FROM events)"


@query("latest_issue", f"WITH {_TASKS} SELECT forecast_id, issue_ts, seq FROM t QUALIFY row_number() OVER (PARTITION BY forecast_id ORDER BY seq DESC) = 1")
def latest_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pending task per forecast: the one set last."""
    return jobs.latest_wanted(tasks(spark, sf_dir), "forecast_id", "seq")


@query("superseded_filter", f"WITH {_TASKS} SELECT forecast_id, issue_ts, seq FROM t WHERE issue_ts = (SELECT max(issue_ts) FROM t u WHERE u.forecast_id = t.forecast_id)")
def superseded_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drop_superseded(tasks(spark, sf_dir), "forecast_id", "issue_ts")


@query("unique_tasks", f"WITH {_TASKS} SELECT forecast_id, issue_ts, min(seq) AS seq FROM t GROUP BY ALL")
def unique_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task key is admitted once, at its first arrival."""
    return jobs.unique_tasks(tasks(spark, sf_dir), ["forecast_id", "issue_ts"], "seq")


@query(
    "gap_detection",
    f"""WITH {GOOD_FILES}, slots AS (SELECT DISTINCT input_id, frame_ts FROM good), g AS (SELECT input_id, unnest(generate_series(min(frame_ts), max(frame_ts), INTERVAL 5 MINUTE)) AS frame_ts FROM slots GROUP BY input_id)
    SELECT input_id, frame_ts, date_diff('second', frame_ts, TIMESTAMP '{NOW}') AS age_s, date_diff('second', frame_ts, TIMESTAMP '{NOW}') > 3600 AS overdue FROM g ANTI JOIN slots USING (input_id, frame_ts)""",
)
def gap_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid times without a file, with their age."""
    return jobs.expected_gaps(full_catalog(spark, sf_dir), NOW)


@query(
    "publish_latency",
    f"""WITH {GOOD_FILES}, l AS (SELECT input_id, CASE input_id WHEN 'click' THEN 10 WHEN 'view' THEN 200 ELSE 260 END AS publish_delay_s, CAST(floor(epoch(modified) - epoch(frame_ts)) AS BIGINT) AS s FROM good)
    SELECT input_id, CAST(publish_delay_s AS INTEGER) AS publish_delay_s, count(*) AS files, count(CASE WHEN s > publish_delay_s THEN 1 END) AS late, CAST(median(s) AS DOUBLE) AS median_s, max(s) AS max_s FROM l GROUP BY ALL""",
)
def publish_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay from frame time to file time against the declared delay."""
    found = files(spark, sf_dir).where(F.endswith("filename", F.lit(".hdf"))).withColumnRenamed("slot_ts", "frame_ts")
    delay = F.when(F.col("input_id") == "click", 10).when(F.col("input_id") == "view", 200).otherwise(260)
    return jobs.publish_latency(found, catalog_inputs(spark).select("input_id", delay.alias("publish_delay_s")), ["input_id"])


@query("duplicate_bases", f"WITH {FILES} SELECT input_id || '_' || strftime(slot_ts, '%Y%m%d_%H%M') AS base, count(*) AS claims FROM files GROUP BY ALL HAVING count(*) > 1")
def duplicate_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.duplicate_bases(files(spark, sf_dir).select(names.base_name(F.col("input_id"), F.col("slot_ts")).alias("base")))


@query(
    "sync_rollup",
    f"""WITH {FILES} SELECT CASE WHEN input_id IN ('click', 'view') THEN 'src_a' ELSE 'src_b' END AS source_id, input_id, count(*) AS files, CAST(sum(CASE WHEN length > 0 THEN 1 ELSE 0 END) AS BIGINT) AS downloaded,
    bool_or(length > 0) AS has_new FROM files GROUP BY ROLLUP (1, 2)""",
)
def sync_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and downloads per source and input, with subtotals."""
    source = F.when(F.col("input_id").isin("click", "view"), "src_a").otherwise("src_b")
    return discovery.sync_summary(files(spark, sf_dir).select(source.alias("source_id"), "input_id", (F.col("length") > 0).alias("downloaded")))


@query(
    "sync_errors",
    """WITH a AS (SELECT user_id AS input_id, event_id % 5 > 0 AS downloaded, event_id % 11 = 0 AS skipped, CASE WHEN event_id % 997 = 0 THEN 'rate limited' END AS error FROM events)
    SELECT CAST(input_id AS VARCHAR) AS input_id, bool_or(error IS NOT NULL) AS failed, min(error) AS error, CASE WHEN bool_or(error IS NOT NULL) THEN 0 ELSE count(CASE WHEN NOT skipped THEN 1 END) END AS files,
    CASE WHEN bool_or(error IS NOT NULL) THEN 0 ELSE count(CASE WHEN NOT skipped AND downloaded THEN 1 END) END AS downloaded FROM a GROUP BY input_id""",
)
def sync_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per input: a failure hides its own files only; skipped files are left out."""
    attempts = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("input_id"), (F.col("event_id") % 5 > 0).alias("downloaded"), (F.col("event_id") % 11 == 0).alias("skipped"),
        F.when(F.col("event_id") % 997 == 0, "rate limited").alias("error"),
    )
    return discovery.sync_status(attempts)


@query("staleness", f"SELECT user_id, max(ts) AS last_ts, max(ts) < TIMESTAMP '{NOW}' - INTERVAL 600 SECOND AS stale FROM events GROUP BY user_id")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections whose last message is more than ten minutes old."""
    return jobs.stale_connections(table(spark, sf_dir, "events"), ["user_id"], NOW)
