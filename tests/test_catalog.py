"""Catalog, readiness, retention and job rules on small known inputs."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from echogrid import registry, schema
from echogrid.plans import jobs, readiness, retention
from echogrid.sources import bundles, catalog, chunks, discovery, links, listing, rasters

NOW = "2026-06-05 21:05:00"


def ts(text):
    return datetime.fromisoformat(text)


def frame(spark, rows, ddl, *stamps):
    df = spark.createDataFrame(rows, ddl)
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in stamps}) if stamps else df


@pytest.fixture(scope="module")
def inputs(spark):
    rows = [(name, "src", "http_directory", None, "DBZH", [".h5", ".hdf"], "compact", keep, 30, 300, True) for name, keep in (("a", 7200), ("b", 7200), ("c", None))]
    return spark.createDataFrame(rows, schema.INPUTS)


@pytest.fixture(scope="module")
def products(spark):
    base = lambda name, on: (name, name, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 260, 10, 7200, f"radar_{name}", "dbzh", [("overlay", 1.0), ("overlay_small", 1.5)], None, True, on)
    return spark.createDataFrame([base("one", True), base("two", True), base("none", True), base("off", False)], schema.PRODUCTS)


@pytest.fixture(scope="module")
def bridge(spark):
    return spark.createDataFrame([("one", "a", 0), ("two", "a", 0), ("two", "b", 1), ("off", "a", 0)], schema.PRODUCT_INPUTS)


FILES = ["T_PABV23_C_OKPR_20260605180500.hdf", "T_PABV23_C_OKPR_20260605190500.hdf", "T_PABV23_C_OKPR_20260605185500.HDF", "T_20260605200000.hdf.part", "unknown.hdf", "x_20260605200000.txt"]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(name, f"/d/{name}/{f}", f, 1, None) for name in ("a", "c") for f in FILES], "input_id string, path string, filename string, length bigint, modified timestamp_ntz")


def test_scan_keeps_the_boundary_and_drops_the_rest(files, inputs):
    kept = {(r.input_id, r.frame_ts) for r in catalog.scan_catalog(files, inputs, NOW).collect()}
    assert kept == {("a", ts("2026-06-05 19:05")), ("c", ts("2026-06-05 18:05")), ("c", ts("2026-06-05 18:55")), ("c", ts("2026-06-05 19:05"))}


def test_expired_inputs_are_only_readable_old_files(files, inputs):
    gone = {(r.input_id, r.filename) for r in retention.expired_inputs(files, inputs, NOW).collect()}
    assert gone == {("a", FILES[0]), ("a", FILES[2])}


def test_files_are_listed_without_their_contents(spark, tmp_path):
    for name in ("in_20260605190500.hdf", "in_20260605190500.hdf.part"):
        (tmp_path / name).write_bytes(b"12345")
    listed = catalog.list_folders(spark, {"a": str(tmp_path)}, "*.hdf")
    assert [(r.input_id, r.filename, r.length) for r in listed.collect()] == [("a", "in_20260605190500.hdf", 5)]
    scan = listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema:")[1].splitlines()[0]
    assert "content" not in scan


def slots(spark, *pairs):
    return frame(spark, [(i, t, f"/{i}/{t}", f"{i}{t}") for i, t in pairs], "input_id string, frame_ts string, path string, filename string", "frame_ts")


def test_ready_needs_every_input(spark, products, bridge):
    index = slots(spark, ("a", "2026-06-05 21:05:00"), ("b", "2026-06-05 21:05:00"), ("a", "2026-06-05 21:10:00"))
    got = {(r.product_id, r.frame_ts) for r in readiness.ready_timestamps(index, products, bridge).collect()}
    assert got == {("one", ts("2026-06-05 21:05")), ("one", ts("2026-06-05 21:10")), ("two", ts("2026-06-05 21:05"))}


def test_job_files_follow_the_input_order(spark, products, bridge):
    index = slots(spark, ("a", "2026-06-05 21:05:00"), ("b", "2026-06-05 21:05:00"))
    ready = readiness.ready_timestamps(index, products, bridge)
    two = readiness.job_files(ready, index, bridge).where("product_id = 'two'").orderBy("ord", "path").collect()
    assert [r.input_id for r in two] == ["a", "b"]


def test_partial_outputs_stay_pending(spark, products):
    ready = frame(spark, [("one", "2026-06-05 21:05:00"), ("one", "2026-06-05 21:10:00")], "product_id string, frame_ts string", "frame_ts")
    full = [f"radar_one_20260605_2105{end}" for end in (".json", "_overlay.png", "_overlay_small.png")]
    partial = ["radar_one_20260605_2110.json", "radar_one_20260605_2110_overlay.png"]
    done = spark.createDataFrame([(n,) for n in full + partial], "name string")
    assert [r.frame_ts for r in readiness.pending_jobs(ready, products, done).collect()] == [ts("2026-06-05 21:10")]
    assert readiness.pending_jobs(ready, products, done, include_existing=True).count() == 2


def test_history_needs_enough_frames(spark):
    ready = frame(spark, [("p", f"2026-06-05 21:{m:02d}:00") for m in (0, 5, 10, 15)] + [("q", "2026-06-05 21:00:00")] * 1, "product_id string, frame_ts string", "frame_ts")
    got = [(r.product_id, r.pos, r.frame_ts.minute) for r in jobs.history_frames(ready, 3).orderBy("pos").collect()]
    assert got == [("p", 1, 5), ("p", 2, 10), ("p", 3, 15)]
    asof = [(r.pos, r.frame_ts.minute) for r in jobs.history_frames(ready, 2, issue="2026-06-05 21:07:00").orderBy("pos").collect()]
    assert asof == [(1, 0), (2, 5)]
    assert jobs.history_frames(ready, 5).count() == 0
    with pytest.raises(ValueError):
        jobs.history_frames(ready, 1)


def test_job_order(spark, products):
    pending = frame(spark, [("two", "2026-06-05 21:05:00"), ("one", "2026-06-05 21:05:00"), ("one", "2026-06-05 21:10:00"), ("fast", "2026-06-05 20:00:00")], "product_id string, frame_ts string", "frame_ts")
    priorities = spark.createDataFrame([("one", 10), ("two", 10), ("fast", 0)], "product_id string, priority int")
    got = [(r.product_id, r.frame_ts.strftime("%H%M")) for r in jobs.job_order(pending, priorities).collect()]
    assert got == [("fast", "2000"), ("one", "2110"), ("one", "2105"), ("two", "2105")]


def test_last_set_task_wins_and_older_results_are_superseded(spark):
    tasks = frame(spark, [("f", "2026-06-05 21:05:00", 1), ("f", "2026-06-05 21:10:00", 2), ("f", "2026-06-05 21:00:00", 3)], "forecast_id string, issue_ts string, seq int", "issue_ts")
    row = jobs.latest_wanted(tasks, "forecast_id", "seq").first()
    assert (row.issue_ts, row.seq) == (ts("2026-06-05 21:00"), 3), "the last one set, though an older issue"
    assert [r.seq for r in jobs.drop_superseded(tasks, "forecast_id", "issue_ts").collect()] == [2]


def test_uploads_compare_path_size_and_time(spark):
    ddl = "path string, size bigint, mtime_ns bigint"
    outputs = spark.createDataFrame([("a.png", 1, 1), ("b.png", 1, 1), ("c.png", 2, 1), ("d.json", 1, 1)], ddl)
    state = spark.createDataFrame([("a.png", 1, 1), ("c.png", 1, 1), ("gone.png", 1, 1)], ddl)
    assert sorted(r.path for r in readiness.pending_uploads(outputs, state).collect()) == ["b.png", "c.png"]
    assert sorted(r.path for r in readiness.pruned_state(state, outputs).collect()) == ["a.png", "c.png"]


def test_output_retention_takes_variants_with_their_sidecar(spark, products):
    written = [("one", n) for n in (
        "radar_one_20260605_1855.json", "radar_one_20260605_1855_overlay.png", "radar_one_20260605_1905.json",
        "radar_one_20260605_1800_overlay.png", "radar_one_x.json",
    )]
    outputs = spark.createDataFrame(written, "product_id string, name string")
    gone = retention.expired_outputs(outputs, products, NOW)
    assert sorted(r.name for r in gone.collect()) == ["radar_one_20260605_1855.json", "radar_one_20260605_1855_overlay.png"]
    assert retention.survivors(outputs, gone, ["product_id", "name"]).count() == 3
    forecasts = spark.createDataFrame([("one", "radar_one_20260605_1855_fct10.json"), ("one", "radar_one_20260605_1855.json")], "product_id string, name string")
    assert [r.name for r in retention.expired_outputs(forecasts, products, NOW, forecasts=True).collect()] == ["radar_one_20260605_1855_fct10.json"]


def test_field_retention(spark):
    rows = [("old", "2026-06-05 18:00:00", NOW), ("kept", "2026-06-05 20:00:00", NOW), ("unreadable", None, NOW), ("edge", "2026-06-05 19:05:00", NOW),
            ("x.part", None, "2026-06-05 20:00:00"), ("y.part", None, "2026-06-05 20:30:00")]
    fields = frame(spark, rows, "path string, issue_ts string, modified string", "issue_ts", "modified")
    assert sorted(r.path for r in retention.expired_fields(fields, 7200, NOW).collect()) == ["old", "unreadable", "x.part"]
    assert retention.expired_fields(fields, None, NOW).count() == 0


def test_count_retention_follows_the_main_overlay(spark):
    names = ["radar_20260605_1800_overlay.png", "radar_20260605_1800_overlay2x.png", "radar_20260605_1805_overlay.png", "radar_20260605_1810_overlay2x.png", "notes.png"]
    df = spark.createDataFrame([("p", n) for n in names], "k string, name string")
    kept = sorted(r.name for r in retention.newest_frames(df, ["k"], 1).collect())
    assert kept == ["notes.png", "radar_20260605_1805_overlay.png"]
    assert retention.newest_frames(df, ["k"], 0).count() == 5


def test_gaps_and_age(spark):
    index = slots(spark, ("a", "2026-06-05 20:00:00"), ("a", "2026-06-05 20:15:00"))
    got = [(r.frame_ts.minute, r.age_s, r.overdue) for r in jobs.expected_gaps(index, NOW).orderBy("frame_ts").collect()]
    assert got == [(5, 3600, False), (10, 3300, False)]


def test_sync_errors_do_not_spread(spark):
    attempts = spark.createDataFrame(
        [("a", "x", True, False, None), ("a", "y", False, True, None), ("b", "z", True, False, "boom"), ("b", "w", True, False, None)],
        "input_id string, filename string, downloaded boolean, skipped boolean, error string",
    )
    got = {r.input_id: (r.failed, r.files, r.downloaded) for r in discovery.sync_status(attempts).collect()}
    assert got == {"a": (False, 1, 1), "b": (True, 0, 0)}


def test_connection_staleness(spark):
    rows = [(False, None), (True, None), (True, "2026-06-05 21:00:00"), (True, "2026-06-05 20:54:59"), (True, "2026-06-05 20:55:00")]
    df = frame(spark, rows, "connected boolean, last_ts string", "last_ts")
    assert [r.s for r in df.select(jobs.connection_stale(F.col("connected"), F.col("last_ts"), F.lit(NOW).cast("timestamp_ntz")).alias("s")).collect()] == [True, False, False, True, False]


def test_frontier_is_clamped_to_the_axis(spark):
    axis = frame(spark, [("s", i, f"2026-06-05 17:{m}:00") for i, m in enumerate((50, 55))] + [("s", 2, "2026-06-05 18:00:00")], "store_id string, idx int, axis_ts string", "axis_ts")
    def at(last):
        stores = frame(spark, [("s", "in", "https://h/radar.zarr", "RR", last)], "store_id string, input_id string, store_url string, variable string, last_valid string", "last_valid")
        return chunks.store_frames(axis, stores, F.lit(2)).orderBy(F.col("frame_ts").desc()).collect()
    newest = at("2026-06-05 18:00:00")
    assert [r.frame_ts.strftime("%H%M") for r in newest] == ["1800", "1755"]
    assert newest[0].url == "https://h/radar.zarr/RR/2.0.0" and newest[0].filename == "in_20260605180000.h5"
    assert [r.frame_ts.strftime("%H%M") for r in at("2026-06-05 19:00:00")] == ["1800", "1755"]
    assert [r.frame_ts.strftime("%H%M") for r in at("2026-06-05 17:57:00")] == ["1755", "1750"]
    assert [r.frame_ts.strftime("%H%M") for r in at("2026-06-05 10:00:00")] == ["1750"]
    assert at(None) == []


def test_metadata_without_its_groups_is_an_error(spark):
    good = '{"metadata":{"crs/.zattrs":{"proj4":"+proj=tmerc","where_xsize":3,"where_ysize":2,"where_xscale":1.0,"where_yscale":1.0,"where_UL_lon":4.5,"where_UL_lat":47.8},"RR/.zarray":{"dtype":"<f4"}}}'
    row = chunks.georeference(spark.createDataFrame([("s", good)], "store_id string, zmetadata string")).first()
    assert (row.projdef, row.xsize, row.ul_lon, row.dtype) == ("+proj=tmerc", 3, 4.5, "<f4")
    with pytest.raises(Exception, match="metadata lacks"):
        chunks.georeference(spark.createDataFrame([("s", '{"metadata":{}}')], "store_id string, zmetadata string")).collect()


def test_chunk_to_reflectivity(spark):
    from echogrid.functions.values import rain_to_dbz

    nan = float("nan")
    df = spark.createDataFrame([("s", 3, [0.0, 2.5, nan, nan, 10.0, 0.0])], "k string, xsize int, data array<double>")
    got = {(r.row, r.col): r.v for r in chunks.chunk_cells(df, ["k"]).withColumn("v", rain_to_dbz(F.col("raw"))).collect()}
    assert got[(0, 0)] == float("-inf") and got[(0, 2)] is None and got[(0, 1)] == pytest.approx(29.377, abs=1e-3) and got[(1, 1)] == pytest.approx(39.010, abs=1e-3)


def test_dataset_selection(spark):
    rows = [("f", "dataset10", "DBZH", "PPI"), ("f", "dataset2", "DBZH", "PPI"), ("g", "dataset1", "DBZH", "PPI"), ("g", "dataset2", "DBZH", "COMP"), ("g", "dataset3", "TH", "MAX")]
    ddl = "file string, dataset string, quantity string, product string"
    got = {r.file: r.dataset for r in rasters.select_dataset(spark.createDataFrame(rows, ddl), ["file"], "DBZH").collect()}
    assert got == {"f": "dataset10", "g": "dataset2"}
    with pytest.raises(Exception, match="available: TH,VRAD"):
        bad = spark.createDataFrame([("h", "dataset1", "VRAD", "X"), ("h", "dataset2", "TH", "X")], ddl)
        rasters.select_dataset(bad, ["file"], "DBZH").collect()


def link(name, kind="application/x-odim"):
    return f'{{"href":"https://h/{name}","type":"{kind}","title":"t","length":3}}'


def nested(depth, inner):
    return inner if depth == 0 else f'{{"links":[],"coverages":[{nested(depth - 1, inner)}]}}'


@pytest.mark.parametrize("text", ['{}', '[]', ' [1, -2.5e3 , "a\\u00e9\\"b", true,false , null, NaN, -Infinity] ', '{"a": {"b": [[], {}, [{"c": 1}]]}, "a": 2}', '"x"', "7", "[1,]", "[1 2]", "{1: 2}", '{"a" 1}', '{"a": }', "", "[", "]", "{", '{"a": 1]', "[1] 2", "nul", "01", '"a\nb"', "[1, 2", '{"a": 1,}', "1" * 5000])
def test_the_stack_parser_reads_what_the_library_reads(text):
    try:
        want = json.loads(text)
    except ValueError:
        with pytest.raises(ValueError):
            links.parse_deep(text)
    else:
        assert repr(links.parse_deep(text)) == repr(want)


def test_deep_texts_are_parsed_in_pieces(monkeypatch):
    from echogrid.functions import nested as whole

    monkeypatch.setattr(whole, "LEVELS", 2)
    for text in ('[[[[NaN]],{"a":[["N\\"]"]]}]]', '[{"a":[-Infinity,[NaN,[]]],"a":[[1e400]]}]', " [[[ ]]] ", "NaN", '{"[":{"\\\\":{"é":[]}}}'):
        assert repr(whole.parse_deep(text)) == repr(json.loads(text))
    for text in ("[[[]]", "[[[}]]", "[[]]]", "NNN", "[[NaNaN]]", '[["]]', "[[[]]]x", "", "[[[1 [2]]]]"):
        with pytest.raises(ValueError):
            whole.parse_deep(text)


def test_announcements_are_spread_before_they_are_parsed(spark):
    from echogrid.suite.views import notifications

    text = notifications(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(event_id" in text and text.index("payload") < text.index("Exchange")


def test_links_a_hundred_thousand_deep(spark):
    payloads = [(d, '{"coverages":[' * d + f'{{"links":[{link("a")}]}}' + "]}" * d) for d in (0, 900, 3000, 20_000, 100_000)]
    payloads += [(-1, "[" * 50_000), (-2, '{"links":[' + '{"type":"application/x-odim","href":"https://h/t","title":' + "[" * 50_000 + "]" * 50_000 + "}]}"), (-3, '{"links":[{"type":"application\\/x\\u002dodim","href":"https://h/e"}]}')]
    got = links.payload_links(spark.createDataFrame(payloads, "id int, payload string")).collect()
    assert sorted((r.id, r.href.rsplit("/", 1)[1]) for r in got if r.id >= 0) == [(d, "a") for d in (0, 900, 3000, 20_000, 100_000)]
    assert sorted((r.id, r.href.rsplit("/", 1)[1]) for r in got if r.id < 0) == [(-3, "e"), (-2, "t")]


def test_links_at_any_depth(spark):
    payloads = [(0, f'{{"links":[{link("a")},{link("b", "text/html")}]}}'), (1, "[]"), (2, "not json"), (3, nested(3, f'{{"links":[{link("deep3")}]}}')), (4, nested(20, f'{{"links":[{link("deep20")}]}}'))]
    df = spark.createDataFrame(payloads, "id int, payload string")
    assert sorted((r.id, r.href.rsplit("/", 1)[1]) for r in links.payload_links(df).collect()) == [(0, "a"), (3, "deep3"), (4, "deep20")]


def test_junk_beside_a_link_is_passed_over(spark):
    odd = f'{{"links":["x",null,3,[],{{"type":"application/x-odim","href":5}},{link("good")}],"coverages":[1,null,{{"links":{{}},"coverages":3}},{{"links":[{link("below")}]}}]}}'
    df = spark.createDataFrame([(1, odd), (2, None), (3, "{}"), (4, '"text"')], "id int, payload string")
    assert [(r.id, r.pos, r.href, r.length) for r in links.payload_links(df).collect()] == [(1, 0, "https://h/good", "3"), (1, 1, "https://h/below", "3")]


def test_link_files_need_quantity_suffix_and_time(spark):
    names = ["OPERA@20260604T0220@0@DBZH.h5", "OPERA@20260604T0220@0@DBZH@1.h5", "OPERA@20260604T0220@0@RATE.h5", "OPERA@20260604T0220@0@DBZH.txt", "OPERA@0@DBZH.h5", "OPERA@20260604T0220@0@DBZH.h5"]
    df = spark.createDataFrame([("opera_dbzh", i, f"https://h/{n}", "application/x-odim", f"t{i}", None) for i, n in enumerate(names)], "input_id string, pos int, href string, type string, title string, length string")
    rows = links.link_files(df, registry.inputs(spark)).collect()
    assert sorted(r.filename for r in rows) == names[:2]
    first = next(r for r in rows if r.filename == names[0])
    assert first.metadata["title"] == "t5" and first.pos.pos == 0, "last values, first position"


def test_older_listing_rule(spark):
    html = '<a href="x_20260605180000.tar">\n<a href="d/a_20260605180500.hdf"> <a href="skip.hdf">\n<a HREF="b_20260605181000.HDF">\n<a href="n.txt">'
    rows = listing.first_href_per_line(spark.createDataFrame([("s", html)], "source string, html string"))
    got = [r.filename for r in listing.newest_names(rows, ["source"], 2).orderBy("rank").collect()]
    assert got == ["x_20260605180000.tar", "b_20260605181000.HDF"]


def test_bundle_members(spark):
    bundle = "T_PABV23_C_OKPR_20250928.2225.ft60s10.tar"
    members = ["T_20250928223500_ft10.hdf", "T_20250928222000_ft00.hdf", "T_20250928224500.hdf", "T_20250928224530_ft20.hdf", "x_ft10.hdf"]
    df = spark.createDataFrame([(bundle, m) for m in members], "bundle string, member string")
    assert sorted((r.member, r.offset_min) for r in bundles.bundle_members(df).collect()) == [(members[0], 10), (members[3], 20)]
    done = spark.createDataFrame([("radar_20250928_2225_forecast_fct10_overlay.png",), ("radar_20250928_2225_forecast_fct20_overlay.png",), ("radar_20250928_2225_forecast_fct20_overlay2x.png",)], "name string")
    assert [r.member for r in bundles.bundle_backlog(df, done).collect()] == [members[0]]


def test_backlog_needs_every_variant_of_the_very_name(spark):
    bundle = "T_PABV23_C_OKPR_20250928.2225.ft60s10.tar"
    members = [f"T_202509282{m}00_ft{n}.hdf" for m, n in (("235", "10"), ("245", "20"), ("255", "30"), ("305", "40"))]
    df = spark.createDataFrame([(k, bundle, m) for m in members for k in (1, 1, 2)], "k int, bundle string, member string")
    done = [f"radar_20250928_2225_forecast_fct{n}_{v}.png" for n, v in ((10, "overlay"), (10, "overlay2x"), (20, "overlay"), (20, "overlay"), (30, "a_overlay"), (30, "overlay2x"), (40, "overlay2x"))]
    written = spark.createDataFrame([(n,) for n in [*done, "old/" + done[0][:-11] + "overlay.png", "radar_20250928_2225_forecast_fct40_overlay.PNG", "_overlay.png", "", None]], "name string")
    got = bundles.bundle_backlog(df, written)
    assert sorted((r.k, r.member) for r in got.collect()) == [(k, m) for k in (1, 2) for m in members[1:]], "equal members once, none for each variant"
    assert got.columns == ["k", "bundle", "member", "bundle_ts", "member_ts", "label", "offset_min"]


def test_names_with_broken_times_give_no_member(spark):
    rows = [("b_20251328.2225.tar", "m_20250928223500_ft10.hdf"), ("b_20250928.2225.tar", "m_20250928226100_ft10.hdf"), ("b_2025.tar", "m_2025_ft10.hdf"), ("", ""), (None, None), ("b_20250928.2225.tar", "m_20250928223500_ft99999999999.hdf")]
    assert bundles.bundle_members(spark.createDataFrame(rows, "bundle string, member string")).collect() == []


def test_discovery_skips_disabled_inputs_and_limits_each(spark, inputs):
    rows = [("a", f"2026-06-05 21:{m:02d}:00", f"u{m}", f"f{m}", {}) for m in (0, 5, 10)] + [("b", "2026-06-05 21:00:00", "v", "g", {})]
    remote = frame(spark, rows, "input_id string, frame_ts string, url string, filename string, metadata map<string,string>", "frame_ts")
    config = inputs.withColumn("enabled", F.col("input_id") != "b")
    assert sorted(r.url for r in discovery.discover([remote], config, 2).collect()) == ["u10", "u5"]


def test_registry(spark):
    rows = {r.product_id: r for r in registry.products(spark).collect()}
    assert len(rows) == 29 and registry.forecasts(spark).count() == 29
    assert [p for p, r in rows.items() if not r.optimize] == ["fi", "no", "se"]
    assert [p for p, r in rows.items() if r.nodata_rgba] == ["it", "md"]
    assert (rows["cz"].priority, rows["sk"].priority, rows["de"].priority) == (0, 5, 10)
    assert registry.product_inputs(spark).where("product_id = 'it'").count() == 2


def test_staleness_counts_fractions_of_a_second(spark):
    rows = frame(spark, [("a", "2026-06-05 20:55:00"), ("b", "2026-06-05 20:54:59.5"), ("c", "2026-06-05 20:54:59")], "conn string, ts string", "ts")
    got = {r.conn: r.stale for r in jobs.stale_connections(rows, ["conn"], "2026-06-05 21:05:00").collect()}
    assert got == {"a": False, "b": True, "c": True}
