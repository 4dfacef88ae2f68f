"""Queries over file catalogs: scan, names, retention, sinks' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry
from ..functions import names
from ..plans import retention
from ..sources import catalog as Cat
from . import query
from .views import FILES, GOOD_FILES, OUTPUTS, catalog_inputs, files, outputs, products, table

NOON = "2024-01-15 12:00:00"


@query(
    "catalog_scan",
    f"""WITH {GOOD_FILES}, r(input_id, s) AS (VALUES ('click', 7200), ('error', 7200), ('purchase', 86400), ('signup', NULL), ('view', 864000))
    SELECT DISTINCT input_id, frame_ts, path, filename FROM good JOIN r USING (input_id) WHERE s IS NULL OR frame_ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 1 SECOND * s""",
)
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable files inside each input's retention, one row per path."""
    keep = F.when(F.col("input_id") == "purchase", 86400).when(F.col("input_id") == "signup", F.lit(None)).when(F.col("input_id") == "view", 864000).otherwise(7200)
    config = catalog_inputs(spark).withColumn("retention_s", keep.cast("int"))
    return Cat.scan_catalog(files(spark, sf_dir), config, NOON)


def full_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index with unbounded retention."""
    return Cat.scan_catalog(files(spark, sf_dir), catalog_inputs(spark, retention_s=None), NOON)


@query("catalog_build", f"WITH {GOOD_FILES} SELECT input_id, frame_ts, count(DISTINCT path) AS files, min(path) AS first_path, max(path) AS last_path FROM good GROUP BY ALL")
def catalog_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_catalog(spark, sf_dir).groupBy("input_id", "frame_ts").agg(
        F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path"), F.max("path").alias("last_path")
    )


@query(
    "catalog_lookup",
    f"""WITH {GOOD_FILES}, t AS (SELECT max(frame_ts) AS ts FROM good WHERE input_id = 'click')
    SELECT 'file' AS kind, frame_ts, path FROM (SELECT DISTINCT frame_ts, path FROM good WHERE input_id = 'click' AND frame_ts = TIMESTAMP '2024-01-10 00:00:00')
    UNION ALL SELECT DISTINCT 'timestamp', frame_ts, NULL FROM good WHERE input_id = 'view'""",
)
def catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one input and time, and the times of another."""
    index = full_catalog(spark, sf_dir)
    found = Cat.files_for(index, "click", "2024-01-10 00:00:00").select(F.lit("file").alias("kind"), "frame_ts", "path")
    times = Cat.timestamps_for(index, "view").select(F.lit("timestamp").alias("kind"), "frame_ts", F.lit(None).cast("string").alias("path"))
    return found.unionByName(times)


@query(
    "name_timestamps",
    """WITH n AS (SELECT event_id, ts, CASE event_id % 6 WHEN 0 THEN 'A_' || strftime(ts, '%Y%m%d%H%M%S') || '.hdf' WHEN 1 THEN 'B@' || strftime(ts, '%Y%m%dT%H%M') || '@0@DBZH.h5'
      WHEN 2 THEN 'C@' || strftime(ts, '%Y%m%dT%H%M%S') || '@0.h5' WHEN 3 THEN 'T_' || strftime(ts, '%Y%m%d.%H%M') || '.ft60s10.tar' WHEN 4 THEN 'bad_2024139925619999.hdf' ELSE 'none.hdf' END AS name FROM events)
    SELECT event_id, name, CASE WHEN event_id % 6 = 0 THEN date_trunc('second', ts) END AS compact,
    CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('second', ts) END AS dated,
    CASE WHEN event_id % 6 = 3 THEN date_trunc('minute', ts) END AS bundle FROM n""",
)
def name_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three name patterns on names of every kind; unreadable digits give NULL."""
    ts, kind = F.col("ts"), F.col("event_id") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("A_"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit(".hdf")))
        .when(kind == 1, F.concat(F.lit("B@"), F.date_format(ts, "yyyyMMdd'T'HHmm"), F.lit("@0@DBZH.h5")))
        .when(kind == 2, F.concat(F.lit("C@"), F.date_format(ts, "yyyyMMdd'T'HHmmss"), F.lit("@0.h5")))
        .when(kind == 3, F.concat(F.lit("T_"), F.date_format(ts, "yyyyMMdd.HHmm"), F.lit(".ft60s10.tar")))
        .when(kind == 4, "bad_2024139925619999.hdf").otherwise("none.hdf")
    )
    named = table(spark, sf_dir, "events").select("event_id", text.alias("name"))
    return named.select(
        "event_id", "name", names.compact_timestamp(F.col("name")).alias("compact"),
        names.dated_name_timestamp(F.col("name")).alias("dated"), names.bundle_timestamp(F.col("name")).alias("bundle"),
    )


@query(
    "output_names",
    """WITH e AS (SELECT event_id, date_trunc('minute', ts) AS ts, user_id % 60 AS lead FROM events),
    b AS (SELECT *, 'radar_cz_' || strftime(ts, '%Y%m%d_%H%M') AS base FROM e)
    SELECT event_id, base, base || '_fct' || lead AS forecast_base, 'radar_' || strftime(ts, '%Y%m%d_%H%M') || '_overlay.png' AS overlay,
    'radar_' || strftime(ts, '%Y%m%d_%H%M') || '_forecast_fct' || lpad(CAST(lead AS VARCHAR), 2, '0') || '_overlay2x.png' AS forecast_overlay,
    base || '.json,' || base || '_overlay.png,' || base || '_overlay_small.png' AS outputs, ts AS back, ts AS forecast_back FROM b""",
)
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base names, output files and the way back from a name to its time."""
    source = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 60).cast("int").alias("lead"))
    prefix = F.lit("radar_cz")
    named = source.withColumns(
        {"base": names.base_name(prefix, F.col("ts")), "forecast_base": names.forecast_base_name(prefix, F.col("ts"), F.col("lead"))}
    )
    return named.select(
        "event_id", "base", "forecast_base", names.overlay_name(F.col("ts"), F.lit("overlay")).alias("overlay"),
        names.overlay_name(F.col("ts"), F.lit("overlay2x"), F.col("lead")).alias("forecast_overlay"),
        F.array_join(names.output_file_names(F.col("base"), F.array(F.lit("overlay"), F.lit("overlay_small"))), ",").alias("outputs"),
        names.base_timestamp(F.col("base"), prefix).alias("back"), names.forecast_base_timestamp(F.col("forecast_base"), prefix).alias("forecast_back"),
    )


@query(
    "publish_grid_next",
    """SELECT event_id, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2000-01-01') + INTERVAL 5 MINUTE AS next_5min,
    date_trunc('day', ts) + INTERVAL 1 SECOND * (CAST(floor(date_diff('second', date_trunc('day', ts), date_trunc('second', ts)) / 420.0) AS BIGINT) * 420 + 420) AS next_7min FROM events""",
)
def publish_grid_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next expected publication for a period that divides the day and one that does not."""
    return table(spark, sf_dir, "events").select(
        "event_id", names.next_publish(F.col("ts"), F.lit(300)).alias("next_5min"), names.next_publish(F.col("ts"), F.lit(420)).alias("next_7min")
    )


@query(
    "retention_prune",
    f"""WITH {GOOD_FILES}, c AS (SELECT input_id, TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 1 SECOND * CASE input_id WHEN 'view' THEN 86400 ELSE 7200 END AS cutoff FROM (SELECT DISTINCT input_id FROM files))
    SELECT f.event_id, f.input_id, f.filename, g.frame_ts < c.cutoff IS TRUE AS deleted FROM files f JOIN c USING (input_id) LEFT JOIN good g ON g.event_id = f.event_id""",
)
def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with whether retention deletes it; unreadable and partial ones stay."""
    config = catalog_inputs(spark).withColumn("retention_s", F.when(F.col("input_id") == "view", 86400).otherwise(7200))
    source = files(spark, sf_dir)
    gone = retention.expired_inputs(source, config, NOON).select("event_id", F.lit(True).alias("deleted"))
    flagged = source.join(gone, "event_id", "left")
    return flagged.select("event_id", "input_id", "filename", F.coalesce("deleted", F.lit(False)).alias("deleted"))


@query(
    "retention_outputs",
    f"""WITH {FILES}, {OUTPUTS}, j AS (SELECT regexp_replace(name, '\\.json$', '') AS stem FROM outs WHERE name LIKE '%.json'),
    t AS (SELECT stem, strptime(right(stem, 13), '%Y%m%d_%H%M') AS frame_ts FROM j),
    old AS (SELECT stem, frame_ts FROM t WHERE frame_ts < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 2 HOUR),
    gone AS (SELECT frame_ts, unnest([stem || '.json', stem || '_overlay.png', stem || '_overlay_small.png']) AS name FROM old)
    SELECT split_part(outs.name, '_', 2) AS product_id, outs.name, frame_ts FROM outs JOIN gone USING (name)""",
)
def retention_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars past retention and the variants that go with them."""
    written = outputs(spark, sf_dir).select(F.element_at(F.split("name", "_"), 2).alias("product_id"), "name")
    return retention.expired_outputs(written, products(spark), NOON)


@query(
    "retention_fields",
    f"""WITH {FILES}, f AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE slot_ts END AS issue_ts, modified, filename LIKE '%.part' AS part FROM files)
    SELECT event_id FROM f WHERE CASE WHEN part THEN modified < TIMESTAMP '2024-01-15 11:00:00' ELSE issue_ts IS NULL OR issue_ts < TIMESTAMP '2024-01-15 10:00:00' END""",
)
def retention_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored forecast fields to delete: old, unreadable, or stale partial files."""
    fields = files(spark, sf_dir).select(
        "event_id", F.col("filename").alias("path"), "modified", F.when(F.col("event_id") % 9 != 0, F.col("slot_ts")).alias("issue_ts")
    )
    return retention.expired_fields(fields, 7200, NOON).select("event_id")


@query(
    "count_retention",
    f"""WITH {FILES}, n AS (SELECT DISTINCT input_id, 'radar_' || strftime(slot_ts, '%Y%m%d_%H%M') AS stem, event_id % 3 AS v FROM files),
    o AS (SELECT DISTINCT input_id, stem, unnest(CASE v WHEN 0 THEN ['_overlay.png', '_overlay2x.png'] WHEN 1 THEN ['_overlay2x.png'] ELSE ['_overlay.png'] END) AS s FROM n),
    kept AS (SELECT input_id, stem FROM o WHERE s = '_overlay.png' QUALIFY row_number() OVER (PARTITION BY input_id ORDER BY stem DESC) <= 600)
    SELECT o.input_id, o.stem || o.s AS name FROM o JOIN kept USING (input_id, stem)""",
)
def count_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 600 frames of each input by their main overlay, with the variants that follow them."""
    stub = F.date_format("slot_ts", "yyyyMMdd_HHmm")
    kind = F.col("event_id") % 3
    variant = F.explode(
        F.when(kind == 0, F.array(F.lit("overlay"), F.lit("overlay2x"))).when(kind == 1, F.array(F.lit("overlay2x"))).otherwise(F.array(F.lit("overlay")))
    )
    written = files(spark, sf_dir).select("input_id", stub.alias("stub"), variant.alias("variant")).distinct()
    named = written.select("input_id", F.concat(F.lit("radar_"), "stub", F.lit("_"), "variant", F.lit(".png")).alias("name"))
    return retention.newest_frames(named, ["input_id"], 600)


@query(
    "count_retention_names",
    f"""WITH {FILES} SELECT input_id, filename AS name FROM (SELECT DISTINCT input_id, filename FROM files WHERE filename LIKE '%.hdf') QUALIFY row_number() OVER (PARTITION BY input_id ORDER BY filename DESC) <= 12""",
)
def count_retention_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = files(spark, sf_dir).where(F.endswith("filename", F.lit(".hdf"))).select("input_id", F.col("filename").alias("name")).distinct()
    return retention.newest_by_name(named, ["input_id"], 12)


@query(
    "upload_manifest",
    f"""WITH {FILES} SELECT event_id, 'maps/live/' || input_id || '/' || filename AS key, CASE WHEN filename LIKE '%.hdf' THEN 'application/x-hdf' ELSE 'application/octet-stream' END AS content_type FROM files""",
)
def upload_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.readiness import upload_manifest as manifest

    written = files(spark, sf_dir).select("event_id", F.concat_ws("/", "input_id", "filename").alias("path"))
    return manifest(written, "/maps/live/").drop("path")


@query(
    "retry_schedule",
    f"""WITH {FILES}, c AS (SELECT user_id, count(*) AS attempts, max(slot_ts) AS last_ts FROM files WHERE length = 0 GROUP BY user_id),
    d AS (SELECT *, least(5 * pow(2.0, least(greatest(attempts - 1, 0), 10)), 300) AS delay_s FROM c)
    SELECT CAST(user_id AS VARCHAR) AS path, attempts, last_ts, CAST(delay_s AS DOUBLE) AS delay_s, last_ts + INTERVAL 1 SECOND * CAST(delay_s AS BIGINT) AS next_ts FROM d""",
)
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each failed path may be tried again."""
    from ..plans.readiness import next_attempts

    failures = files(spark, sf_dir).where("length = 0").select(F.col("user_id").cast("string").alias("path"), F.col("slot_ts").alias("ts"))
    return next_attempts(failures)


@query(
    "product_registry",
    "WITH o AS (SELECT CASE l_returnflag WHEN 'A' THEN 'cz_maxz' WHEN 'N' THEN 'opera_dbzh' ELSE 'it_sri_arco' END AS input_id, count(*) AS n FROM lineitem GROUP BY ALL), p(product_id, label, west, north, lon, publish_delay_s, input_id) AS (VALUES "
    + ", ".join(
        f"('{row[0]}', '{row[1]}', {row[2]}::DOUBLE, {row[5]}::DOUBLE, {row[7]}::DOUBLE, {row[8]}, '{inp}')"
        for row in registry.product_rows()
        for inp in registry.PRODUCT_INPUTS.get(row[0], ("opera_dbzh",))
    )
    + ") SELECT product_id, label, west, north, lon, CAST(publish_delay_s AS INTEGER) AS publish_delay_s, CAST(sum(n) AS BIGINT) AS observations FROM p JOIN o USING (input_id) GROUP BY ALL",
)
def product_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry export rows with the observations each product draws on."""
    from ..sinks.registry_export import product_documents
    from .views import obs

    counted = obs(spark, sf_dir).groupBy("input_id").agg(F.count(F.lit(1)).alias("n"))
    used = registry.product_inputs(spark).join(counted, "input_id").groupBy("product_id").agg(F.sum("n").alias("observations"))
    documents = product_documents(registry.products(spark))
    return documents.select(
        F.col("id").alias("product_id"), "label", "bounds.west", "bounds.north", F.col("center.longitude").alias("lon"), F.col("publishDelaySeconds").alias("publish_delay_s")
    ).join(used, "product_id")


@query(
    "frame_budget",
    f"""WITH {GOOD_FILES}, r(input_id, s, budget) AS (VALUES ('click', 7200, 26), ('error', 7200, 26), ('purchase', 86400, 290), ('signup', NULL, 12), ('view', 864000, 2882)),
    slots AS (SELECT DISTINCT input_id, frame_ts FROM good)
    SELECT input_id, CAST(budget AS INTEGER) AS budget, count(CASE WHEN (s IS NULL OR frame_ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 1 SECOND * s) AND frame_ts <= TIMESTAMP '2024-01-15 12:00:00' THEN 1 END) AS held FROM slots JOIN r USING (input_id) GROUP BY ALL""",
)
def frame_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames held against the budget of each input's retention."""
    from ..plans.jobs import completeness

    keep = F.when(F.col("input_id") == "purchase", 86400).when(F.col("input_id") == "signup", F.lit(None)).when(F.col("input_id") == "view", 864000).otherwise(7200)
    kind = F.when(F.col("input_id") == "signup", "arco_zarr").otherwise(F.col("source_kind"))
    config = catalog_inputs(spark).withColumns({"retention_s": keep.cast("int"), "source_kind": kind})
    return completeness(full_catalog(spark, sf_dir), config, NOON)
