"""PNG tiles, sidecars, raster files and the forecast store."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid import registry
from echogrid.operators import cells as C
from echogrid.plans import render
from echogrid.sinks import forecast_store, overlay, registry_export, sidecar
from echogrid.sinks.folders import Folders
from echogrid.sources import rasters

from test_raster import cells_of


def read_png(blob):
    assert blob.startswith(overlay.PNG_MAGIC)
    chunks, at = {}, 8
    while at < len(blob):
        (size,) = struct.unpack(">I", blob[at : at + 4])
        kind, body = blob[at + 4 : at + 8], blob[at + 8 : at + 8 + size]
        assert struct.unpack(">I", blob[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + body)
        chunks[kind] = body
        at += 12 + size
    w, h, depth, colour = struct.unpack(">IIBB", chunks[b"IHDR"][:10])
    assert (depth, colour) == (8, 3)
    lines = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), dtype=np.uint8).reshape(h, w + 1)
    return chunks, lines[:, 1:]


@pytest.mark.parametrize("tint", [None, (0, 0, 0, 0.15)])
def test_tiles_hold_the_classes(spark, tint):
    array = np.random.default_rng(1).uniform(-10, 70, size=(20, 37))
    array[3, 5] = np.nan
    merged = cells_of(spark, array).withColumns({"height": F.lit(20), "width": F.lit(37)})
    tiles = render.render_tiles(merged, ["k"], nodata_rgba=tint, tile=16, specs=(("overlay", 1.0),)).collect()
    whole = np.zeros((20, 37), dtype=int)
    for t in tiles:
        chunks, indices = read_png(bytes(t.png))
        assert indices.shape == (t.height, t.width)
        whole[t.tile_r * 16 : t.tile_r * 16 + t.height, t.tile_c * 16 : t.tile_c * 16 + t.width] = indices
        alphas = list(chunks[b"tRNS"])
        assert alphas[:16] == [255] * 15 + [0]
        assert alphas[16:] == ([] if tint is None else [round(0.15 * 255)])
        assert chunks[b"PLTE"][:3] == bytes.fromhex("390071")
    expected = np.clip(np.floor((array - 4) / 4), None, 14)
    expected[array < 4] = 15
    expected[np.isnan(array)] = 15 if tint is None else 16
    np.testing.assert_array_equal(whole, expected.astype(int))


def test_the_bounds_comment(spark):
    text = spark.range(1).select(overlay.geobox_text(F.lit(11.27), F.lit(48.05), F.lit(19.62), F.lit(51.46)).alias("t")).first().t
    assert text == "GeoBox=11.27,48.05,19.62,51.46"
    chunks, _ = read_png(overlay.paletted_png(np.zeros((2, 2), dtype=np.uint8), [(1, 2, 3)], [255], text))
    assert chunks[b"tEXt"] == b"Comment\x00GeoBox=11.27,48.05,19.62,51.46"


def test_pipeline_names_are_checked(spark):
    with pytest.raises(ValueError, match="unknown pipeline"):
        render.render_tiles(cells_of(spark, [[1.0]]), ["k"], pipeline="other")
    with pytest.raises(ValueError, match="at most"):
        overlay.encode_tiles(cells_of(spark, [[1.0]]), ["k"], [], tile=512)


def test_sidecar(spark):
    frames = spark.createDataFrame([("b", "2026-06-05 14:40:00", "DBZH", "dbzh", "EPSG:3857", 1.5, 2.5, 3.5, 4.5, 16, 20)], "base string, t string, quantity string, palette string, crs string, west double, south double, east double, north double, height int, width int")
    frames = frames.withColumn("frame_ts", F.col("t").cast("timestamp_ntz"))
    sources = spark.createDataFrame([("b", 1, "two.h5"), ("b", 0, "zero.h5")], "base string, ord int, name string")
    document = json.loads(sidecar.sidecars(frames, sources, render.variant_manifest(frames)).first().sidecar)
    assert document == {
        "timestamp": "2026-06-05T14:40:00", "quantity": "DBZH", "palette": "dbzh", "crs": "EPSG:3857",
        "bounds": {"west": 1.5, "south": 2.5, "east": 3.5, "north": 4.5}, "sources": ["zero.h5", "two.h5"],
        "variants": {"overlay": {"file": "b_overlay.png", "width": 20, "height": 16}, "overlay_small": {"file": "b_overlay_small.png", "width": 13, "height": 11}},
    }


def header(**changes):
    made = {"date": "20260605", "time": "144000", "projdef": "+proj=merc +a=6378137 +b=6378137", "xsize": 3, "ysize": 5, "xscale": 10.0, "yscale": 10.0, "UL_lon": 0.0, "UL_lat": 0.0, "packing": "raw"}
    own = {"name": "dataset1", "product": "PPI", "quantity": "DBZH", "gain": 0.5, "offset": -32.0, "nodata": 255.0, "undetect": 0.0, "dtype": "|u1"}
    made["datasets"] = [own, own | {"name": "dataset2", "product": "COMP"}, own | {"name": "dataset3", "quantity": "TH", "product": "COMP"}]
    return json.dumps(made | changes)


def parts_of(spark, files):
    """Files of a 5 x 3 raster 1..15 in dataset2, in blocks of two rows, with ``changes`` to the header or blocks."""
    rows = []
    for name, head, cut in files:
        rows.append((name, 0, None, None, None, head.encode()))
        for d, dataset in enumerate(("dataset1", "dataset2", "dataset3")):
            for k, first in enumerate((0, 2, 4)):
                n = min(2, 5 - first)
                data = bytes(range(1 + 3 * first, 1 + 3 * (first + n))) if d == 1 else b"\x07" * (3 * n)
                rows.append((name, 1 + 3 * d + k, dataset, first, n, data[: len(data) - cut] if d == 1 and k == 2 else data))
    return spark.createDataFrame(rows, "name string, part int, dataset string, first_row int, n_rows int, content binary")


def test_raster_files_give_frames_and_cells(spark):
    merc = "+proj=merc +a=6378137 +b=6378137"
    files = [("good", header(), 0), ("short", header(), 1), ("other", header(datasets=json.loads(header())["datasets"][2:]), 0), ("bad", "{", 0), ("far", header(projdef="+proj=xyz"), 0), ("when", header(date="x"), 0)]
    decoded = rasters.decode_rasters(parts_of(spark, files), ["name"], "DBZH", [merc])
    frames = {r.name: r for r in decoded.frames.collect()}
    assert {n: r.error for n, r in frames.items()} == {
        "good": None, "short": "ValueError: expected 1x3 values, found 2", "other": "no dataset with quantity DBZH; available: TH", "bad": "incomplete header",
        "far": "no place for projection +proj=xyz", "when": "incomplete header",
    }
    good = frames["good"]
    assert (good.dataset, good.gain, good.xsize, good.ysize, str(good.frame_ts)) == ("dataset2", 0.5, 3, 5, "2026-06-05 14:40:00") and abs(good.x_min) < 1e-6 and abs(good.y_max) < 1e-6
    cells = decoded.cells.collect()
    assert {r.name for r in cells} == {"good"} and sorted((r.row, r.col, r.raw, r.value) for r in cells) == [(k // 3, k % 3, k + 1.0, (k + 1) * 0.5 - 32) for k in range(15)]


def test_packed_rasters_decode_again(spark):
    cells = spark.createDataFrame([(k, d, 3 * k, 1, 9.0 + k) for k in (0, 1) for d in ("dataset1", "dataset2", "dataset3")], "k int, dataset string, row int, col int, raw double")
    heads = header(packing="deflate", datasets=[x | {"dtype": "<f4"} for x in json.loads(header())["datasets"]])
    frames = spark.createDataFrame([(0, heads), (1, heads)], "k int, header string").withColumns({"xsize": F.lit(3), "ysize": F.lit(5)}).withColumn("datasets", F.from_json("header", "datasets array<struct<name:string,dtype:string,nodata:double>>").datasets)
    parts = rasters.pack_rasters(cells, frames, ["k"], 2)
    assert parts.count() == 2 * (1 + 3 * 3) and sorted(r.part for r in parts.where("k = 0").collect()) == list(range(10))
    decoded = rasters.decode_rasters(parts, ["k"], "DBZH", ["+proj=merc +a=6378137 +b=6378137"])
    assert sorted((r.k, r.row, r.col, r.raw) for r in decoded.cells.where("value is not null").collect()) == [(0, 0, 1, 9.0), (1, 3, 1, 10.0)] and decoded.cells.count() == 30


def test_files_are_split_into_parts(spark):
    head = header().encode()

    def splitter(content):
        if content == b"bad":
            raise ValueError("no raster")
        yield {"part": 0, "dataset": None, "first_row": None, "n_rows": None, "content": head}
        for first in range(5):
            yield {"part": first + 1, "dataset": "dataset2", "first_row": first, "n_rows": 1, "content": content[3 * first : 3 * first + 3]}

    files = spark.createDataFrame([("a", bytes(range(1, 16))), ("b", b"bad")], "name string, content binary")
    decoded = rasters.decode_rasters(rasters.split_files(files, ["name"], splitter), ["name"], "DBZH", ["+proj=merc +a=6378137 +b=6378137"])
    assert {(r.name, r.error) for r in decoded.frames.collect()} == {("a", None), ("b", "incomplete header")} and decoded.cells.count() == 15


def filtered(indices, kinds):
    """Scanlines of an image under the given filter types."""
    height, width = indices.shape
    wide = np.zeros((height + 1, width + 1), np.int64)
    wide[1:, 1:] = indices
    lines = np.zeros((height, width + 1), np.uint8)
    for y in range(1, height + 1):
        kind = kinds[(y - 1) % len(kinds)]
        left, above, corner = wide[y, :-1], wide[y - 1, 1:], wide[y - 1, :-1]
        near = left + above - corner
        paeth = np.where((abs(near - left) <= abs(near - above)) & (abs(near - left) <= abs(near - corner)), left, np.where(abs(near - above) <= abs(near - corner), above, corner))
        lines[y - 1, 0] = kind
        lines[y - 1, 1:] = (wide[y, 1:] - (0, left, above, (left + above) // 2, paeth)[kind]) & 255
    return lines


def test_images_are_read_whatever_their_filters():
    rng = np.random.default_rng(3)
    for kinds in ((0,), (1,), (2,), (3,), (4,), (4, 1, 3, 0, 2)):
        indices = rng.integers(0, 17, (9, 13)).astype(np.uint8)
        assert (overlay.unfiltered(filtered(indices, kinds)) == indices).all()
    png = overlay.paletted_png(indices, [(1, 2, 3)] * 17, [255, 0], "GeoBox=1.0,2.0,3.0,4.0")
    image = overlay.read_png(png)
    assert (image.indices == indices).all() and image.palette == [(1, 2, 3)] * 17 and image.alphas == [255, 0] and image.comments == {"Comment": "GeoBox=1.0,2.0,3.0,4.0"}


def test_tiles_that_cannot_be_read_say_so(spark):
    png = overlay.paletted_png(np.array([[0, 1], [1, 1]], np.uint8), [(255, 0, 16), (0, 0, 0)], [255, 38], "GeoBox=1.5,-2,3,x")
    broken = png[:40] + bytes([png[40] ^ 1]) + png[41:]
    tiles = spark.createDataFrame([("ok", png), ("cut", png[:60]), ("no", b"x"), ("sum", broken)], "name string, png binary")
    shown = overlay.read_tiles(tiles, ["name"]).withColumns(overlay.geobox_numbers(F.col("comment"))).collect()
    assert sorted((r.idx, r.rgba, r.n, r.west, r.south, r.east, r.north) for r in shown if r.name == "ok") == [(0, "#ff0010ff", 1, 1.5, -2.0, 3.0, None), (1, "#00000026", 3, 1.5, -2.0, 3.0, None)]
    assert all("ValueError" in r.error and r.idx is None for r in shown if r.name != "ok") and len(shown) == 5


def test_products_choose_their_pipeline(spark):
    cells = spark.createDataFrame([("a", 0, 0, 5.0, 1, 2), ("a", 0, 1, None, 1, 2), ("b", 0, 0, 9.0, 1, 2)], "input_id string, row int, col int, value double, height int, width int").withColumn("k", F.lit(1))
    inputs = spark.createDataFrame([("one", "a"), ("two", "a"), ("two", "b")], "product_id string, input_id string")
    products = spark.createDataFrame([("one", None), ("two", "default")], "product_id string, pipeline string")
    got = {(r.product_id, r.variant, r.col): r.idx for r in render.render_products(cells, products, inputs, ["k"], specs=(("overlay", 1.0),)).collect()}
    assert got == {("one", "overlay", 0): 0, ("one", "overlay", 1): 15, ("two", "overlay", 0): 1, ("two", "overlay", 1): 15}
    with pytest.raises(Exception, match="unknown pipeline other"):
        render.render_products(cells, products.withColumn("pipeline", F.lit("other")), inputs, ["k"]).collect()


def fields(spark, rows):
    frames = spark.createDataFrame(rows, "forecast_id string, issue string, lead_min int").select(
        "forecast_id", F.col("issue").cast("timestamp_ntz").alias("issue_ts"), "lead_min",
        F.timestamp_add("MINUTE", F.col("lead_min"), F.col("issue").cast("timestamp_ntz")).alias("valid_ts"),
    )
    cells = frames.withColumns({"row": F.lit(1), "col": F.lit(2), "value": F.lit(9.5)})
    return cells, frames


def test_store_replaces_one_forecast_and_keeps_the_other(spark, tmp_path):
    path = str(tmp_path / "store")
    forecast_store.write_fields(*fields(spark, [("a", "2026-06-05 21:00:00", 10), ("a", "2026-06-05 21:00:00", 20), ("b", "2026-06-05 21:00:00", 10)]), path)
    forecast_store.write_fields(*fields(spark, [("a", "2026-06-05 21:05:00", 20)]), path)
    stored = {(r.forecast_id, str(r.issue_ts), r.lead_min) for r in forecast_store.read_fields(spark, path).collect()}
    assert stored == {("a", "2026-06-05 21:05:00", 20), ("b", "2026-06-05 21:00:00", 10)}
    assert [r.lead_min for r in forecast_store.existing_minutes(spark, path, "a", "2026-06-05 21:05:00").collect()] == [20]
    # A new issue without any echo hides the old one.
    cells, frames = fields(spark, [("b", "2026-06-05 21:10:00", 10)])
    forecast_store.write_fields(cells.where("false"), frames, path)
    assert forecast_store.read_fields(spark, path, "b").count() == 0
    assert forecast_store.read_fields(spark, path, "a").count() == 1


@pytest.mark.parametrize("name", ["007", "7", "2024-01-01", "2024-01-01 00:00:00", "1e3", "true", "a=b/c%"])
def test_ids_that_look_like_other_types_stay_text(spark, tmp_path, name):
    path = str(tmp_path / "store")
    for issue in ("2026-06-05 21:00:00", "2026-06-05 21:05:00"):
        forecast_store.write_fields(*fields(spark, [(name, issue, 10), ("b", issue, 10)]), path)
    assert sorted((r.forecast_id, str(r.issue_ts)) for r in forecast_store.read_fields(spark, path).collect()) == sorted((f, "2026-06-05 21:05:00") for f in (name, "b"))
    assert forecast_store.read_fields(spark, path, name, 10).count() == forecast_store.existing_minutes(spark, path, name, "2026-06-05 21:05:00").count() == 1


def test_two_writers_of_one_forecast_lose_no_listed_cell(spark, tmp_path):
    path = str(tmp_path / "store")
    old, one, two = (fields(spark, [("a", f"2026-06-05 21:{m}:00", 10), ("b", f"2026-06-05 21:{m}:00", 10)]) for m in ("00", "05", "10"))
    read = lambda: sorted((r.forecast_id, r.issue_ts.strftime("%H%M"), r.row) for r in forecast_store.read_fields(spark, path).collect())
    forecast_store.write_fields(*old, path)
    for first, second, last in ((one, two, "2110"), (two, one, "2105")):
        forecast_store.write_cells(first[0], path, "first" + last)
        forecast_store.write_cells(second[0], path, "second" + last)
        forecast_store.write_frames(first[1], path, "first" + last)
        forecast_store.write_frames(second[1], path, "second" + last)
        assert read() == [("a", last, 1), ("b", last, 1)], "the last to commit is read, whole"
        assert sorted(r.issue_ts.strftime("%H%M") for r in forecast_store.read_frames(spark, path).collect()) == [last, last]
    forecast_store.write_cells(one[0], path, "open")
    forecast_store.write_fields(*two, path)
    forecast_store.write_frames(one[1], path, "open")
    assert read() == [("a", "2105", 1), ("b", "2105", 1)], "cells written before another's commit are still there"
    assert len(list((tmp_path / "store/commits/forecast_id=a").glob("0*"))) == 1


def test_a_commit_number_is_taken_once(spark, tmp_path):
    folders = Folders(spark, str(tmp_path))
    target = folders.at("commits", "forecast_id=a", "000000000001")
    assert folders.put(target, "x") and not folders.put(target, "y")
    assert (tmp_path / "commits/forecast_id=a/000000000001").read_text() == "x" and not list((tmp_path / "drafts").glob("[!.]*"))
    assert forecast_store.commit(spark, str(tmp_path), "a", "z") == 2


def test_a_failure_between_cells_and_frames_leaves_the_old_issue(spark, tmp_path):
    path = str(tmp_path / "store")
    forecast_store.write_fields(*fields(spark, [("a", "2026-06-05 21:00:00", 10)]), path)
    cells, frames = fields(spark, [("a", "2026-06-05 21:05:00", 10)])
    forecast_store.write_cells(cells, path)
    read = lambda **only: [(r.issue_ts.strftime("%H%M"), r.lead_min) for r in forecast_store.read_fields(spark, path, **only).collect()]
    assert read() == [("2100", 10)]
    forecast_store.write_fields(cells, frames, path)
    assert read() == read(forecast_id="a", lead_min=10) == [("2105", 10)] and read(lead_min=20) == []
    assert [p.name for p in (tmp_path / "store/cells/forecast_id=a").iterdir()] == ["issue=20260605210500"], "the old issue is gone"


def test_registry_documents(spark, tmp_path):
    path = str(tmp_path / "products")
    registry_export.write_product_documents(registry.products(spark), path)
    documents = {d["id"]: d for d in map(json.loads, (r.value for r in spark.read.text(path).collect()))}
    assert documents["cz"] == {
        "id": "cz", "label": "Czechia radar", "center": {"latitude": 49.8, "longitude": 15.47},
        "bounds": {"west": 11.27, "south": 48.05, "east": 19.62, "north": 51.46}, "publishDelaySeconds": 10,
    }
    assert documents["it"]["publishDelaySeconds"] == 480 and len(documents) == 29
