"""Frame arrivals as streams: lateness, five-minute counts, readiness, refresh."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans import readiness
from ..sources.catalog import as_time, usable_files
from .batch_log import MERGE_AFTER, BatchLog

LOG = logging.getLogger(__name__)
RETENTION = "2 hours"
CATALOG = "input_id STRING, frame_ts TIMESTAMP_NTZ, path STRING, filename STRING, batch_id BIGINT, frame_date DATE"


def recent_frames(frames: DataFrame, now, retention_s: int = 7200) -> DataFrame:
    """Frames on or after ``now`` less the retention; the boundary is kept."""
    return frames.where(F.col("frame_ts") >= F.timestamp_add("SECOND", F.lit(-retention_s), as_time(now)))


def frame_counts(frames: DataFrame, ts: str, watermark: str | None = None) -> DataFrame:
    """Rows per input in tumbling five-minute windows, in batch or as a stream."""
    timed = frames.withWatermark(ts, watermark) if watermark else frames
    counted = timed.groupBy(F.window(ts, "5 minutes").alias("_w"), "input_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("input_id", F.col("_w.start").alias("frame_ts"), "n")


def ready_stream(arrivals: DataFrame, product_inputs: DataFrame, horizon: str = RETENTION) -> DataFrame:
    """(product_id, frame_ts) once every input of the product has arrived.

    ``arrivals`` has (input_id, frame_ts TIMESTAMP).  Arrivals are deduplicated,
    so each group counts its inputs and state is a number; any number of inputs
    will do.  Run it in update mode.
    """
    once = arrivals.withWatermark("frame_ts", horizon).dropDuplicatesWithinWatermark(["input_id", "frame_ts"])
    pairs = product_inputs.select("product_id", "input_id").distinct()
    needed = pairs.groupBy("product_id").agg(F.count(F.lit(1)).alias("_all"))
    routed = once.join(pairs.join(needed, "product_id"), "input_id")
    seen = routed.groupBy("product_id", "frame_ts", "_all").agg(F.count(F.lit(1)).alias("_seen"))
    return seen.where(F.col("_seen") == F.col("_all")).select("product_id", "frame_ts")


def paired_stream(left: DataFrame, right: DataFrame, horizon: str = RETENTION) -> DataFrame:
    """Ready times of a two-input product as a stream-stream join on the exact time."""
    a = left.withWatermark("frame_ts", horizon).alias("a")
    b = right.withWatermark("frame_ts", horizon).alias("b")
    return a.join(b, F.expr("a.frame_ts = b.frame_ts")).select(F.col("a.frame_ts").alias("frame_ts"))


def notified(outputs: DataFrame, listener: Callable[[dict], None]) -> DataFrame:
    """``outputs`` with ``error``: each row is handed to the listener, in the task that holds it, and what it raises is kept."""
    schema = T.StructType([*outputs.schema.fields, T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for row in batch.to_pylist():
                try:
                    listener(row)
                    errors.append(None)
                except Exception as problem:  # a listener must not stop the others
                    errors.append(f"{type(problem).__name__}: {problem}")
            yield batch.append_column("error", pa.array(errors, pa.string()))

    return outputs.mapInArrow(run, schema)


def refresh_on_arrival(
    arrivals: DataFrame,
    inputs: DataFrame,
    products: DataFrame,
    product_inputs: DataFrame,
    outputs: Callable[[], DataFrame],
    folder: str,
    checkpoint: str,
    on_ready: Callable[[DataFrame, int], None] | None = None,
    available_now: bool = True,
    on_output: Callable[[dict], None] | None = None,
    merge_after: int = MERGE_AFTER,
) -> StreamingQuery:
    """Grow the catalog with each batch of files and write the jobs it makes pending.

    The catalog is a batch log: a batch that runs again after a restart is not
    added twice, and its jobs overwrite their own folder.  Only timestamps
    touched by the batch are looked at.  ``on_ready`` is called with the pending
    jobs, ``on_output`` with each of them as a row.  What listeners raise is kept
    under ``reports`` beside the jobs that they heard of, and does not stop the
    stream; how many were heard and failed is observed while that is written.
    """
    jobs_path, reports_path = f"{folder}/jobs", f"{folder}/reports"

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = BatchLog(spark, f"{folder}/catalog", CATALOG, "frame_date", merge_after)
        fresh = usable_files(batch, inputs).select("input_id", "frame_ts", "path", "filename", F.to_date("frame_ts").alias("frame_date"))
        log.append(fresh, batch_id)
        days = [str(r[0]) for r in fresh.select("frame_date").distinct().collect()]  # a batch's days are few
        catalog = log.read(days)
        added = catalog.where(F.col("batch_id") == batch_id).select("frame_date", "frame_ts").distinct()
        touched = catalog.join(added, ["frame_date", "frame_ts"], "left_semi")
        ready = readiness.ready_timestamps(touched, products, product_inputs)
        pending = readiness.pending_jobs(ready, products, outputs())
        pending.write.mode("overwrite").parquet(f"{jobs_path}/batch_id={batch_id}")
        jobs = spark.read.schema(pending.schema).parquet(f"{jobs_path}/batch_id={batch_id}")
        if on_output is not None:
            heard = Observation()
            told = notified(jobs, on_output).observe(heard, F.count(F.lit(1)).alias("outputs"), F.count("error").alias("failed"))
            told.write.mode("overwrite").parquet(f"{reports_path}/batch_id={batch_id}")
            LOG.info("batch %d: %s", batch_id, heard.get)
        if on_ready is not None:
            try:
                on_ready(jobs, batch_id)
            except Exception as problem:  # a listener must not stop the stream
                LOG.warning("output listener failed on batch %d: %s", batch_id, problem)
                error = F.lit(f"{type(problem).__name__}: {problem}")
                jobs.withColumn("error", error).write.mode("overwrite").parquet(f"{reports_path}/listener/batch_id={batch_id}")

    writer = arrivals.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
