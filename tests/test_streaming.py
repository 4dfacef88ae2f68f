"""Streams over several batches: deduplication, readiness, refresh, state."""

import time

import pytest
from pyspark.sql import functions as F

from echogrid import registry, schema
from echogrid.streaming import frames as Fr
from echogrid.streaming.batch_log import BatchLog
from echogrid.streaming import notifications as No
from echogrid.streaming import state as St


class Source:
    """A folder read as a stream, one file per batch."""

    def __init__(self, spark, folder, ddl):
        self.spark, self.folder, self.ddl, self.count = spark, str(folder), ddl, 0

    def add(self, rows):
        df = self.spark.createDataFrame(rows, self.ddl.replace("TIMESTAMP", "STRING"))
        stamps = [part.split()[0] for part in self.ddl.split(", ") if part.endswith("TIMESTAMP")]
        df = df.withColumns({name: F.col(name).cast("timestamp") for name in stamps}) if stamps else df
        df.coalesce(1).write.mode("append").parquet(self.folder)
        time.sleep(0.05)

    def stream(self):
        return self.spark.readStream.schema(self.ddl).option("maxFilesPerTrigger", 1).parquet(self.folder)


def run(stream, mode, folder, into):
    def keep(batch, batch_id):
        into.extend(tuple(r) for r in batch.collect())

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    query.awaitTermination()


def message(name, topic="ORD/eu.eumetnet/0-20010-0-OPERA/DBZH"):
    return topic, f'{{"links":[{{"href":"https://h/{name}","type":"application/x-odim","title":"t"}}]}}'


def test_each_announced_file_comes_once(spark, tmp_path):
    source = Source(spark, tmp_path / "in", "topic STRING, payload STRING, ts TIMESTAMP")
    a = "OPERA@20260605T2100@0@DBZH.h5"
    source.add([(*message(a), "2026-06-05 21:01:00"), ("ORD/x", "{}", "2026-06-05 21:01:00"), ("ORD/eu.eumetnet/0-20010-0-OPERA/DBZH", "broken", "2026-06-05 21:01:00")])
    source.add([(*message(a), "2026-06-05 21:03:00"), (*message(a, "ORD/eu.eumetnet/0-1-2-X/DBZH"), "2026-06-05 21:03:00")])
    source.add([(*message("OPERA@20260605T2105@0@DBZH.h5"), "2026-06-05 21:06:00")])
    seen = []
    run(No.announced_file_stream(source.stream(), registry.inputs(spark)).select("input_id", "filename"), "append", tmp_path / "c", seen)
    assert sorted(seen) == [("opera_dbzh", a), ("opera_dbzh", "OPERA@20260605T2105@0@DBZH.h5")]


BRIDGE = [("solo", "a", 0), ("duo", "a", 0), ("duo", "b", 1)]


def test_products_get_ready_across_batches(spark, tmp_path):
    source = Source(spark, tmp_path / "in", "input_id STRING, frame_ts TIMESTAMP")
    source.add([("a", "2026-06-05 21:05:00"), ("a", "2026-06-05 21:10:00")])
    source.add([("a", "2026-06-05 21:05:00"), ("b", "2026-06-05 21:05:00")])
    seen = []
    bridge = spark.createDataFrame(BRIDGE, schema.PRODUCT_INPUTS)
    run(Fr.ready_stream(source.stream(), bridge).select("product_id", F.date_format("frame_ts", "HHmm")), "update", tmp_path / "c", seen)
    assert sorted(seen) == [("duo", "2105"), ("solo", "2105"), ("solo", "2110")]


def test_two_streams_meet_on_the_exact_time(spark, tmp_path):
    left, right = (Source(spark, tmp_path / n, "frame_ts TIMESTAMP") for n in "ab")
    left.add([("2026-06-05 21:05:00",), ("2026-06-05 21:10:00",)])
    right.add([("2026-06-05 21:05:00",)])
    right.add([("2026-06-05 21:15:00",)])
    seen = []
    run(Fr.paired_stream(left.stream(), right.stream()).select(F.date_format("frame_ts", "HHmm")), "append", tmp_path / "c", seen)
    assert seen == [("2105",)]


def test_window_counts_drop_what_is_too_late(spark, tmp_path):
    source = Source(spark, tmp_path / "in", "input_id STRING, ts TIMESTAMP")
    source.add([("a", "2026-06-05 21:04:59"), ("a", "2026-06-05 21:05:00"), ("a", "2026-06-05 23:59:00")])
    source.add([("a", "2026-06-05 21:06:00"), ("a", "2026-06-06 03:00:00")])
    source.add([("a", "2026-06-05 21:07:00"), ("a", "2026-06-06 03:01:00")])
    seen = []
    run(Fr.frame_counts(source.stream(), "ts", "2 hours").select("input_id", F.date_format("frame_ts", "ddHHmm"), "n"), "append", tmp_path / "c", seen)
    counts = {row[1]: row[2] for row in seen}
    # The watermark of one batch filters the batch after the next: 21:06 still
    # counts, 21:07 does not.
    assert counts["052100"] == 1 and counts["052105"] == 2


PRODUCTS = [(n, n, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 260, 10, 7200, f"radar_{n}", "dbzh", [("overlay", 1.0)], None, True, True) for n in ("solo", "duo")]


def test_refresh_restarts_without_repeating_itself(spark, tmp_path):
    source = Source(spark, tmp_path / "in", "input_id STRING, path STRING, filename STRING")
    inputs = spark.createDataFrame([(n, "s", "http_directory", None, "DBZH", [".hdf"], "compact", 7200, 30, 300, True) for n in "ab"], schema.INPUTS)
    bridge, products = spark.createDataFrame(BRIDGE, schema.PRODUCT_INPUTS), spark.createDataFrame(PRODUCTS, schema.PRODUCTS)
    done = ["radar_solo_20260605_2105.json", "radar_solo_20260605_2105_overlay.png"]
    outputs = lambda: spark.createDataFrame([(n,) for n in done], "name string")
    heard = []

    def listener(jobs, batch_id):
        heard.append(batch_id)
        raise RuntimeError("listener trouble")

    def refresh():
        Fr.refresh_on_arrival(source.stream(), inputs, products, bridge, outputs, str(tmp_path / "out"), str(tmp_path / "c"), listener).awaitTermination()

    name = lambda i, hhmm: (i, f"/d/{i}/{i}_20260605{hhmm}00.hdf", f"{i}_20260605{hhmm}00.hdf")
    source.add([name("a", "2105"), name("a", "2110")])
    refresh()
    source.add([name("b", "2105"), ("b", "/d/b/x.part", "x.part")])
    refresh()
    refresh()
    rows = spark.read.parquet(str(tmp_path / "out/jobs")).select("batch_id", "product_id", F.date_format("frame_ts", "HHmm").alias("t")).collect()
    assert sorted(tuple(r) for r in rows) == [(0, "solo", "2110"), (1, "duo", "2105")]
    assert heard == [0, 1], "a failing listener does not stop the stream"


def test_newest_issue_state(spark, tmp_path):
    source = Source(spark, tmp_path / "in", "forecast_id STRING, issue_ts TIMESTAMP, seq BIGINT")
    source.add([("f", "2026-06-05 21:05:00", 1), ("g", "2026-06-05 21:00:00", 2)])
    source.add([("f", "2026-06-05 21:00:00", 3)])
    source.add([("f", "2026-06-05 21:10:00", 4)])
    seen = []
    run(St.newest_issue_stream(source.stream()).select("forecast_id", "seq"), "update", tmp_path / "c", seen)
    assert [row for row in seen if row[0] == "f"] == [("f", 1), ("f", 1), ("f", 4)]


def test_silent_connections_turn_stale(spark, tmp_path):
    source = Source(spark, tmp_path / "in", "conn STRING, ts TIMESTAMP")
    source.add([("x", "2026-06-05 21:05:00")])
    seen = []

    def keep(batch, batch_id):
        seen.extend(tuple(r) for r in batch.select("conn", "stale").collect())

    stream = St.staleness_stream(source.stream(), "conn", stale_after_ms=500)
    query = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        deadline = time.time() + 60
        while ("x", True) not in seen and time.time() < deadline:
            time.sleep(0.2)
    finally:
        query.stop()
    assert seen[0] == ("x", False) and ("x", True) in seen


def test_a_key_that_falls_silent_and_speaks_again(spark, tmp_path):
    source = Source(spark, tmp_path / "in", "conn STRING, ts TIMESTAMP")
    source.add([("x", "2026-06-05 21:05:00"), ("x", "2026-06-05 21:04:00"), ("y", "2026-06-05 21:05:00")])
    source.add([("y", "2026-06-05 21:10:00")])
    source.add([("y", "2026-06-05 21:16:00")])
    source.add([("y", "2026-06-05 21:16:30")])  # by now time has come past what x had
    source.add([("x", "2026-06-05 21:17:00"), ("y", "2026-06-05 21:18:00")])
    source.add([("z", "2026-06-05 21:29:00")])
    seen = []
    stream = St.staleness_stream(source.stream(), "conn", event_time=True)
    run(stream.select("conn", F.date_format(F.timestamp_micros("last_us"), "HHmm"), "stale"), "update", tmp_path / "c", seen)
    assert [r for r in seen if r[0] == "x"] == [("x", "2105", False), ("x", "2105", True), ("x", "2117", False), ("x", "2117", True)]
    assert [r[1:] for r in seen if r[0] == "y"] == [("2105", False), ("2110", False), ("2116", False), ("2116", False), ("2118", False), ("2118", True)]
    assert [r for r in seen if r[0] == "z"] == [("z", "2129", False)]


def rows_of(spark, batch_id, day):
    return spark.createDataFrame([(f"i{batch_id}", f"2026-06-{day:02d} 00:00:00", "p", "f")], "input_id string, t string, path string, filename string").select(
        "input_id", F.col("t").cast("timestamp_ntz").alias("frame_ts"), "path", "filename", F.to_date(F.col("t")).alias("frame_date")
    )


def test_a_log_of_many_batches_has_few_folders(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "log"), Fr.CATALOG, "frame_date", merge_after=5)
    pinned = None
    for batch in range(60):
        assert log.append(rows_of(spark, batch, 1 + batch // 30), batch)
        assert not log.append(rows_of(spark, batch, 1), batch), "a batch that runs again is not added"
        segments = log.manifest()["segments"]
        folders = list((tmp_path / "log/data").glob("*/segment=*"))
        assert len(segments) <= 5 and len(folders) <= 2 * (5 + 2) and len(list((tmp_path / "log/manifest").glob("0*"))) <= 5 + 3
        if batch == 57:
            pinned = log.manifest()["version"]
    assert sorted(r.batch_id for r in log.read().collect()) == list(range(60))
    assert sorted(r.input_id for r in log.read(["2026-06-02"]).collect()) == sorted(f"i{b}" for b in range(30, 60)) and log.read(["2026-07-01"]).count() == 0
    assert sorted(r.batch_id for r in log.read(version=pinned).collect()) == list(range(58)), "a reader pinned to a version sees that one"
    again = BatchLog(spark, str(tmp_path / "log"), Fr.CATALOG, "frame_date", merge_after=5)
    assert not again.append(rows_of(spark, 59, 1), 59) and again.append(rows_of(spark, 60, 2), 60) and again.read().count() == 61


def test_listeners_hear_every_output_and_failures_are_kept(spark):
    def listener(row):
        if row["id"] % 3 == 0:
            raise ValueError(f"no {row['id']}")

    got = {r.id: r.error for r in Fr.notified(spark.range(10), listener).collect()}
    assert got == {k: f"ValueError: no {k}" if k % 3 == 0 else None for k in range(10)}


def test_recent_frames_keep_the_boundary(spark):
    df = spark.createDataFrame([("2026-06-05 19:05:00",), ("2026-06-05 19:04:59",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("frame_ts"))
    assert Fr.recent_frames(df, "2026-06-05 21:05:00").count() == 1


def test_readiness_of_seventy_inputs(spark, tmp_path):
    source = Source(spark, tmp_path / "in", "input_id STRING, frame_ts TIMESTAMP")
    source.add([(f"i{k}", "2026-06-05 21:05:00") for k in range(69)] + [(f"i{k}", "2026-06-05 21:10:00") for k in range(70)])
    seen = []
    bridge = spark.createDataFrame([("wide", f"i{k}", k % 7) for k in range(70)], schema.PRODUCT_INPUTS)
    run(Fr.ready_stream(source.stream(), bridge).select("product_id", F.date_format("frame_ts", "HHmm")), "update", tmp_path / "c", seen)
    assert seen == [("wide", "2110")]
