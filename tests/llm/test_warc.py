import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from echogrid.llm import warc

ROWS = [
    (1, "http://a/1", "x" * 100), (2, "http://a/2", "x" * 100), (3, "u", "x" * 99), (4, "u", "x" * 99), (5, None, None), (6, "", ""), (7, "http://a/é b\r\nX: y", "é" * 50),
    (0, "late", "é" * 50), (None, "n", "é" * 50), (None, "n", "only null ids " * 20), (None, "m", "only null ids " * 20), (8, "r", "again" * 40), (8, "r", "again" * 40), (9, "r", "again" * 40),
    (10, "crlf", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" * 9), (11, "big", "0123456789" * 70_000), (12, "big", "0123456789" * 70_000), *[(100 + i, "hot", "hot page " * 30) for i in range(300)],
]
SCHEMA = "page_id long, url string, html string, id string, record int"


def brute(rows):
    groups = {}
    for i, _, body in rows:
        if len((body or "").encode()) >= 100 and i is not None:
            groups[body] = min(groups.get(body, i), i)
    out = []
    for i, _, body in rows:
        raw = (body or "").encode()
        first = groups.get(body) if len(raw) >= 100 else None
        revisit = first is not None and i != first
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("parts", "chunk", "size"), [(1, 1 << 20, 1 << 28), (4, 1000, 5_000)])
def test_pages_come_back(spark, tmp_path, parts, chunk, size):
    pages = spark.createDataFrame([(*r, "c", 1) for r in ROWS], SCHEMA).repartition(parts)
    folder = f"file:{tmp_path}/warc"
    files = warc.write_archives(warc.chunked(pages, chunk_bytes=chunk), folder, size)
    assert files.agg(F.sum("n_records")).first()[0] == len(ROWS) and (parts == 1 or files.count() > 4)
    back = warc.records(warc.read_chunks(files, folder, content=False, chunk_bytes=chunk))
    got = [(None if r.id is None else int(r.id), r.n_bytes, r.digest, r.type, None if r.refers_to is None else int(r.refers_to)) for r in back.collect()]
    assert sorted(got, key=repr) == brute(ROWS) and back.filter("NOT intact").count() == 0


def test_chunks_make_up_the_payload_and_carry_its_digest(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "c", 1) for r in ROWS], SCHEMA)
    folder = str(tmp_path / "warc")
    files = warc.write_archives(warc.chunked(pages, chunk_bytes=1 << 16), folder)
    rows = warc.read_chunks(files, folder, chunk_bytes=10_000).filter("id = '11'").orderBy("chunk").collect()
    assert [r.chunk for r in rows] == list(range(70)) and [r.last for r in rows] == [False] * 69 + [True]
    body = b""
    for r in rows:
        body += bytes(r.content)
        assert (r.n_bytes, r.digest) == (len(body), hashlib.sha256(body).hexdigest())
    assert body == b"0123456789" * 70_000
    text = gzip.decompress((tmp_path / "warc" / files.first().archive.rsplit("/", 1)[1]).read_bytes())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.endswith(b"\r\n\r\n") and b"\r\nX: y" not in text


def test_no_pages(spark, tmp_path):
    files = warc.write_archives(warc.chunked(spark.createDataFrame([], SCHEMA)), str(tmp_path))
    assert files.collect() == [] and warc.records(warc.read_chunks(files, str(tmp_path))).collect() == []


def test_a_payload_of_many_megabytes(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab c" * (5 << 20)), (2, "v", "")], "page_id long, url string, html string")
    files = warc.write_archives(warc.chunked(pages), str(tmp_path))
    got = {r.id: (r.n_bytes, r.digest) for r in warc.records(warc.read_chunks(files, str(tmp_path), content=False)).collect()}
    assert got["1"] == (20 << 20, hashlib.sha256(b"ab c" * (5 << 20)).hexdigest()) and got["2"][0] == 0


def record(kind, body, length=None, **fields):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{len(body)}>\r\n{head}Content-Length: {len(body) if length is None else length}\r\n\r\n".encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("zipped", [False, True])
def test_archives_of_others(zipped):
    raw = [record("warcinfo", b"a: b\r\n"), record("request", b"GET /\r\n\r\n"), record("response", b"plain", Content_Type="text/html"), record("response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody", Content_Type="application/http;msgtype=response"), record("response", b"")]
    data = b"".join(map(gzip.compress, raw)) if zipped else b"".join(raw)
    rows = list(warc.chunks_of(io.BytesIO(data), 3))
    assert [(r["number"], r["content"], r["last"]) for r in rows] == [(3, b"pla", False), (3, b"in", True), (4, b"bod", False), (4, b"y", True), (5, b"", True)]


@pytest.mark.parametrize(("data", "error"), [(b"no header at all", "no record header"), (record("response", b"abc", 9)[:-4], "ends within a record"), (record("response", b"HTTP/1.1", Content_Type="application/http"), "no answer header"), (gzip.compress(record("response", b"a" * 90_000))[:60], "no record header")])
def test_broken_archives_say_so(data, error):
    good = record("response", b"fine")
    rows = list(warc.chunks_of(io.BytesIO(good + data if data[:2] != b"\x1f\x8b" else gzip.compress(good) + data), 1 << 20))
    assert rows[0]["content"] == b"fine" and rows[0]["last"] and rows[-1].get("error") and not rows[-1]["last"]
    assert error in ("no record header", rows[-1]["error"])
