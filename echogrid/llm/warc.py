"""WARC archives written from and read into a chunked record table.

Payloads travel as rows of (record, chunk number, bytes), in order: the writer
streams them into gzip members, one a record, and the reader streams members
back into rows.  A row carries the digest of the payload through its chunk, so
the last one has the digest of the whole, and no task ever holds a record.
Equal payloads are stored once; the other records are revisits that refer to the
stored one and get its length and digest when the table is read.

Archives are files of the shared folder, reached through its URI.  A retried
task writes files of new names, and only files that a finished task reported
are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .balance import attach, stored

LEAST_BYTES = 100  # of a payload that others may revisit
CHUNK_BYTES = 1 << 20
FILE_BYTES = 256 << 20  # of payload after which a task begins another archive
HEADER_BYTES = 1 << 20  # of a header, beyond which an archive is taken for broken
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "archive string, n_records long, n_bytes long"
ROWS = pa.schema([
    ("archive", pa.string()), ("number", pa.int64()), ("record", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("id", pa.string()), ("refers", pa.string()),
    ("claimed", pa.string()), ("chunk", pa.int32()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("last", pa.bool_()), ("content", pa.binary()), ("error", pa.string()),
])
TABLE = "archive string, number long, record string, type string, uri string, id string, refers string, claimed string, chunk int, n_bytes long, digest string, last boolean, content binary, error string"


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, or of a plain path, and the path in it."""
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", uri):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def record_id(kind: str, key: Column, digest: Column) -> Column:
    """A URN that follows from a record's kind, id and payload digest."""
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(key.cast("string"), F.lit("")), digest).cast("binary"))
    return F.concat_ws("-", F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8)), *[F.substring(h, a, n) for a, n in ((9, 4), (13, 4), (17, 4), (21, 12))])


def chunked(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", text_col: str = "html", least: int = LEAST_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk rows of one record a page, those of a record behind each other.

    Of equal payloads of at least ``least`` bytes the smallest id is a response,
    the others revisits without bytes.  A null payload is empty; a null id
    revisits any other, and a class of null ids only, or rows that repeat the
    smallest id, are all responses.
    """
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), body.alias("body")).select("*", F.sha2("body", 256).alias("claimed"), F.octet_length("body").cast("long").alias("size"))
    large = F.col("size") >= least
    classes = rows.filter(large).groupBy("claimed").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("_n"))
    repeated = stored(classes.filter("_n > 1 AND first IS NOT NULL"), "repeated")
    met = attach(rows.filter(large), repeated.drop("_n"), ["claimed"], "left", repeated.select("claimed", "_n"))
    typed = met.unionByName(rows.filter(~large).withColumn("first", F.lit(None).cast(dict(rows.dtypes)["id"])))
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    kind = F.when(revisit, "revisit").otherwise("response")
    named = typed.select(
        F.when(revisit, record_id("revisit", F.col("id"), F.concat_ws("|", "claimed", "uri"))).otherwise(record_id("response", F.col("id"), F.col("claimed"))).alias("record"),
        kind.alias("type"), "uri", F.col("id").cast("string").alias("id"), F.when(revisit, record_id("response", F.col("first"), F.col("claimed"))).alias("refers"), "claimed", "size", "body",
    )
    chunks = F.when(F.col("type") == "revisit", F.lit(0)).otherwise(F.floor((F.greatest("size", F.lit(1)) - 1) / chunk_bytes)).cast("int")
    cut = named.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks)))
    content = F.when(F.col("type") == "response", F.substring("body", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes)))
    return cut.select("record", "type", "uri", "id", "refers", "claimed", "size", "chunk", content.alias("content"))


class Archive:
    """A file of gzip members, one a record."""

    def __init__(self, system: fs.FileSystem, path: str, date: str):
        self.path, self.date, self.records, self.payload = path, date, 0, 0
        self.file = system.open_output_stream(path, compression=None)
        self.member = None
        about = b"software: echogrid\r\nformat: WARC File Format 1.1\r\n"
        self.begin({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "Content-Type": "application/warc-fields"}, len(about))
        self.add(about)

    def add(self, data: bytes) -> None:
        self.file.write(self.member.compress(data))

    def end(self) -> None:
        if self.member is not None:
            self.add(b"\r\n\r\n")
            self.file.write(self.member.flush())
            self.member = None

    def begin(self, fields: dict[str, str], size: int) -> None:
        self.end()
        self.member = zlib.compressobj(6, zlib.DEFLATED, 31)
        lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items()), f"WARC-Date: {self.date}", f"Content-Length: {size}"]
        self.add("".join(f"{line}\r\n" for line in [*lines, ""]).encode())

    def record(self, row: dict) -> None:
        """Open a record: its header, and the header of the answer that held the payload."""
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
        fields = {"WARC-Type": row["type"], "WARC-Record-ID": f"<{row['record']}>", "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha256:{row['claimed']}"}
        if row["id"] is not None:
            fields["X-Record-Key"] = quote(row["id"], safe="")
        if row["uri"]:
            fields["WARC-Target-URI"] = quote(row["uri"], safe=":/?#[]@!$&'()*+,;=%-._~")
        if row["refers"] is not None:
            fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{row['refers']}>"}
        self.begin(fields, len(http) + (row["size"] if row["type"] == "response" else 0))
        self.add(http)
        self.records += 1

    def close(self) -> dict:
        self.end()
        self.file.close()
        return {"archive": self.path, "n_records": self.records, "n_bytes": self.payload}


def write_archives(chunks: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write chunk rows as archives; one row per finished file, in a table of the shared folder.

    A task writes files of about ``file_bytes`` of payload, a longer record
    alone.  An empty table gives no file.
    """
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(folder)
        stem, archive, done = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", None, []
        for batch in batches:
            heads, contents = batch.drop_columns(["content"]).to_pylist(), batch.column("content")
            for k, row in enumerate(heads):
                if row["chunk"] == 0:
                    if archive is not None and archive.payload >= file_bytes:
                        done.append(archive.close())
                        archive = None
                    if archive is None:
                        system.create_dir(root, recursive=True)
                        archive = Archive(system, f"{root}/{stem}-{len(done):05d}.warc.gz", date)
                    archive.record(row)
                if contents[k].is_valid:
                    data = contents[k].as_buffer()
                    archive.add(data)
                    archive.payload += data.size
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_pylist(done, pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return stored(chunks.mapInArrow(run, FILES), "archives")


class Source:
    """Decompressed bytes of an archive, handed out as far as they are asked for."""

    def __init__(self, file, block: int = 1 << 18):
        self.file, self.block, self.held = file, block, b""
        self.raw = file.read(block)
        self.unzip = zlib.decompressobj(31) if self.raw[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        """Read on; False at the end, also where a member is cut short or damaged."""
        while True:
            if not self.raw:
                self.raw = self.file.read(self.block)
                if not self.raw:
                    return False
            if self.unzip is None:
                out, self.raw = self.raw, b""
            else:
                try:
                    out = self.unzip.decompress(self.raw, self.block)
                except zlib.error:
                    return False
                self.raw = self.unzip.unconsumed_tail
                if self.unzip.eof:
                    self.raw, self.unzip = self.unzip.unused_data, zlib.decompressobj(31)
            if out:
                self.held += out
                return True

    def some(self, most: int) -> bytes:
        """Between one and ``most`` bytes; none at the end."""
        while not self.held:
            if not self.more():
                return b""
        out, self.held = self.held[:most], self.held[most:]
        return out

    def header(self, most: int) -> bytes | None:
        """All before the next empty line, which has to lie within ``most`` bytes; None if it does not."""
        while (at := self.held.find(b"\r\n\r\n", 0, most)) < 0:
            if len(self.held) >= most or not self.more():
                return None
        out, self.held = self.held[:at], self.held[at + 4 :]
        return out


def fields_of(header: bytes) -> dict[str, str]:
    """Field values by lower-case name; folded lines belong to the field before."""
    lines = re.sub(r"\r\n[ \t]+", " ", header.decode("utf-8", "replace")).split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def chunks_of(file, chunk_bytes: int, header_bytes: int = HEADER_BYTES) -> Iterator[dict]:
    """The chunk rows of all responses and revisits of one archive, whole or not; the last row of a broken one has an error."""
    source, number = Source(file), 0
    while True:
        while not source.held.strip(b"\r\n"):  # between records
            source.held = b""
            if not source.more():
                return
        source.held = source.held.lstrip(b"\r\n")
        header = source.header(header_bytes)
        fields = fields_of(header) if header and header.startswith(b"WARC/") else {}
        if not fields.get("content-length", "").isdigit():
            yield {"number": number, "last": False, "error": "no record header"}
            return
        left, kind = int(fields["content-length"]), fields.get("warc-type")
        known, number = kind in ("response", "revisit"), number + 1
        inner = lambda name: fields[name].strip("<>") if name in fields else None
        row = {
            "number": number, "record": inner("warc-record-id"), "type": kind, "uri": fields.get("warc-target-uri"), "refers": inner("warc-refers-to"),
            "id": unquote(fields["x-record-key"]) if "x-record-key" in fields else None, "claimed": fields.get("warc-payload-digest", "").partition(":")[2] or None,
        }
        if known and fields.get("content-type", "").startswith("application/http"):
            http = source.header(min(left, header_bytes))
            if http is None:
                yield row | {"last": False, "error": "no answer header"}
                return
            left -= len(http) + 4
        chunk, size, digest = 0, 0, hashlib.sha256()
        while True:
            held, room = [], min(chunk_bytes, left)
            while room and (data := source.some(room)):
                held.append(data)
                room -= len(data)
            content = b"".join(held)
            left -= len(content)
            size += len(content)
            digest.update(content)
            if room:
                yield row | {"chunk": chunk, "n_bytes": size, "digest": digest.hexdigest(), "content": content, "last": False, "error": "ends within a record"}
                return
            if known:
                yield row | {"chunk": chunk, "n_bytes": size, "digest": digest.copy().hexdigest(), "content": content, "last": left == 0}
            chunk += 1
            if not left:
                break


def read_chunks(files: DataFrame, folder: str, content: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk rows of the archives that ``files`` names, each streamed by one task.

    ``n_bytes`` and ``digest`` cover the payload through the row's chunk.
    Without ``content`` the bytes are digested and dropped.  An archive that is
    damaged gives the rows before the damage, then one with an ``error``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = located(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                with system.open_input_stream(path, compression=None) as file:
                    for row in chunks_of(file, chunk_bytes):
                        held.append(row | {"archive": path} if content else row | {"archive": path, "content": None})
                        size += len(row.get("content") or b"") + 500
                        if size > 4 * chunk_bytes:
                            yield pa.RecordBatch.from_pylist(held, ROWS)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, ROWS)

    # a given number of partitions is kept, where adaptive execution would put the few short rows into one task
    return files.select("archive").repartition(max(1, files.count())).mapInArrow(run, TABLE)


def records(chunks: DataFrame) -> DataFrame:
    """One row per whole record: ``id``, ``record``, ``type``, ``n_bytes``, ``digest``, ``refers_to`` and ``intact``.

    A revisit has the length and digest of the response it refers to, and that
    one's id as ``refers_to``; all three are null if no archive holds it.
    ``intact``: the digest is the one that the record's header claims.
    """
    ends = stored(chunks.filter("last").select("archive", "number", "record", "type", "id", "refers", "claimed", "n_bytes", "digest"), "records")
    kept = ends.filter("type = 'response'")
    by_record = kept.groupBy(F.col("record").alias("refers")).agg(F.max(F.struct("id", "n_bytes", "digest")).alias("held"))
    revisits = attach(ends.filter("type = 'revisit'").drop("n_bytes", "digest"), by_record, ["refers"], "left")
    met = revisits.select("*", "held.n_bytes", "held.digest", F.col("held.id").alias("refers_to")).drop("held")
    both = kept.withColumn("refers_to", F.lit(None).cast("string")).unionByName(met)
    return both.select("id", "record", "type", "n_bytes", "digest", "refers_to", F.coalesce(F.col("digest") == F.col("claimed"), F.lit(False)).alias("intact"))
