"""Names, times, topics, URLs and keys."""

from datetime import datetime
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from echogrid.functions import names
from echogrid.sources import listing


def texts(spark, values, *expressions):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [tuple(r)[1:] for r in df.select("i", *expressions).orderBy("i").collect()]




def test_timestamps(spark):
    got = texts(
        spark,
        ["T_PABV23_C_OKPR_20260605180500.hdf", "OPERA@20260604T0220@0@DBZH.h5", "X@20260604T022011@0.h5", "T_PABV23_C_OKPR_20250928.2225.ft60s10.tar", "unknown.hdf", "bad_20261399250099.hdf"],
        names.compact_timestamp(F.col("s")), names.dated_name_timestamp(F.col("s")), names.bundle_timestamp(F.col("s")),
    )
    assert got == [
        (datetime(2026, 6, 5, 18, 5), datetime(2026, 6, 5, 18, 5), None),
        (None, datetime(2026, 6, 4, 2, 20), None),
        (None, datetime(2026, 6, 4, 2, 20, 11), None),
        (None, None, datetime(2025, 9, 28, 22, 25)),
        (None, None, None),
        (None, None, None),
    ]


def test_base_names_and_back(spark):
    prefix = F.lit("radar_cz")
    got = texts(
        spark,
        ["radar_cz_20260605_1805", "radar_cz_20260605_180511", "radar_cz_20260605_1805_fct10", "radar_cz_20260605_1805_fctx", "radar_czx_20260605_1805", "radar_cz_", "other"],
        names.base_timestamp(F.col("s"), prefix), names.forecast_base_timestamp(F.col("s"), prefix),
    )
    at = datetime(2026, 6, 5, 18, 5)
    assert got == [(at, None), (datetime(2026, 6, 5, 18, 5, 11), None), (None, at), (None, None), (None, None), (None, None), (None, None)]


def test_next_publication_is_strictly_later(spark):
    got = texts(
        spark, ["2026-06-05 18:05:00", "2026-06-05 18:04:59.9", "2026-06-05 23:57:00"],
        names.next_publish(F.col("s").cast("timestamp_ntz"), F.lit(300)), names.next_publish(F.col("s").cast("timestamp_ntz"), F.lit(420)),
    )
    assert [r[0] for r in got] == [datetime(2026, 6, 5, 18, 10), datetime(2026, 6, 5, 18, 5), datetime(2026, 6, 6)]
    assert got[2][1] == datetime(2026, 6, 6, 0, 2), "a period that does not divide the day runs past midnight"


def test_topics_and_payloads(spark):
    got = texts(spark, ["ORD/eu.eumetnet/0-20010-0-OPERA/DBZH", "ORD/a/b", "XYZ/a/b/c", "ORD/a/b/c/d"], names.topic_parts(F.col("s")))
    assert tuple(got[0][0]) == ("eu.eumetnet", "0-20010-0-OPERA", "DBZH")
    assert [r[0] for r in got[1:]] == [None, None, None]
    assert [r[0] for r in texts(spark, ['{"a":1}', "[1]", "nope", "3", "{}"], names.is_json_object(F.col("s")))] == [True, False, False, False, True]


def test_objects_at_any_depth_are_objects(spark):
    deep = '{"a":[' * 20_000 + "]}" * 20_000
    given = [deep, "[" + deep + "]", deep + "x", deep[:-1], '{"a":NaN}', '{"a":1} x', ' \n{"a":"}"}\t', "\u00a0{}", "", None]
    got = texts(spark, given, names.is_json_object(F.col("s")))
    assert [r[0] for r in got] == [True, False, False, False, True, False, True, False, False, False]


def test_keys_types_and_delays(spark):
    got = texts(spark, ["a/b.png", "c.json", "d.bin"], names.object_key(F.lit("/maps/"), F.col("s")), names.object_key(F.lit(""), F.col("s")), names.content_type(F.col("s")))
    assert got == [("maps/a/b.png", "a/b.png", "image/png"), ("maps/c.json", "c.json", "application/json"), ("maps/d.bin", "d.bin", "application/octet-stream")]
    delays = spark.createDataFrame([(n,) for n in (0, 1, 2, 6, 7, 50)], "n int").select(names.retry_delay(F.col("n")).alias("d"))
    assert [r.d for r in delays.collect()] == [5, 5, 10, 160, 300, 300]


def test_frame_budget(spark):
    df = spark.createDataFrame([(7200, 300), (None, 300), (10, 0)], "keep int, period int")
    assert [r.b for r in df.select(names.frame_budget(F.col("keep"), F.col("period")).alias("b")).collect()] == [26, None, 12]


BASES = ["https://h.example/a/b/c.html?x=1#f", "https://h.example", "http://h.example/dir/"]
HREFS = ["d.hdf", "/root.hdf", "../up.hdf", "./here.hdf", "../../../far.hdf", "?q=2", "#top", "//other.example/z", "https://o.example/y", "e/../f/./g.hdf?k=v#w", "..", ".", "mailto:a@b"]


@pytest.mark.parametrize("base", BASES)
def test_urls_resolve_as_in_the_standard_library(spark, base):
    got = [r[0] for r in texts(spark, HREFS, listing.resolve_url(F.lit(base), F.col("s")))]
    expected = [urljoin(base, href) for href in HREFS]
    # A bare host has the root path here.
    same = lambda url: url.replace("h.example?", "h.example/?").replace("h.example#", "h.example/#")
    assert list(map(same, got)) == list(map(same, expected))


def test_query_parameters_merge_as_a_dictionary(spark):
    urls = ["https://h/x?a=1&b=2&a=3#f", "https://h/x", "https://h/x?b=&c=a%20b+c"]
    got = [r[0] for r in texts(spark, urls, listing.merge_query(F.col("s"), {"b": "new", "z": "5,6"}))]
    for url, result in zip(urls, got):
        parts = urlsplit(url)
        merged = dict(parse_qsl(parts.query, keep_blank_values=True)) | {"b": "new", "z": "5,6"}
        assert result == urlunsplit((parts.scheme, parts.netloc, parts.path, urlencode(merged), parts.fragment))


def test_anchors_only_outside_scripts_and_comments(spark):
    html = """<p><A class="x" HREF='one.hdf'>1</a><!-- <a href="no.hdf"> --><script>"<a href='no2.hdf'>"</script>
    <a href=two.hdf>2</a><a name="n">n</a><link href="css"><a href="q?a=1&amp;b=2">3</a>"""
    assert texts(spark, [html], listing.anchor_hrefs(F.col("s")))[0][0] == ["one.hdf", "two.hdf", "q?a=1&b=2"]
