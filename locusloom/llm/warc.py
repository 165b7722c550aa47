"""WARC archives as a Spark data source, and an archive of pages with revisit records.

``spark.read.format("warc")`` lists files on the driver and plans one partition for each file, or several byte ranges
of a large ``.gz`` file: a range owns the gzip members that begin in it and finds the first by its signature. A plain file
is one partition, as its payloads may hold what looks like a record. Each record is a gzip
member (plain files are read too). A record's headers are parsed first, from the first few KB of the member; pushed
predicates on headers (``=``, ``in``, ``<``, ``<=``, ``>``, ``>=``, ``like 'x%'``, null tests on record_id,
record_type, target_uri, refers_to, payload_digest, content_length) are judged on them, and the payload of a rejected
record, or any payload with option ``payload`` = false, is not decoded: members written here carry their own
compressed length in a gzip extra field, so the reader leaps to the next one. Members without that field are inflated
and dropped.

``df.write.format("warc")`` takes record_id, record_type, target_uri, refers_to, payload_digest (bare hex SHA-1),
payload_length and payload, one file for each task, under a name of its own that is moved into place when the job
commits; an aborted or lost task leaves nothing that a reader sees.

Edge cases: null payloads are empty; null headers are left out and read back null; a revisit holds the HTTP headers
and no payload, and its payload_length is the HTTP Content-Length; empty tables give empty archives; empty files and
trailing bytes that are no record are passed over; extra columns are ignored by :func:`archive`.
"""

from __future__ import annotations

import base64
import binascii
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringStartsWith, WriterCommitMessage

from .common import filesystem, work_path

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, content_length long, payload_length long, payload binary"
SPLIT = 64 << 20
EXTRA = "<2sHI"  # subfield id, its length, length of the member
STATIC = b"WARC-Date: 1970-01-01T00:00:00Z\r\n"
PROFILE = b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
HEADERS = {"warc-record-id": "record_id", "warc-type": "record_type", "warc-target-uri": "target_uri", "warc-refers-to": "refers_to", "warc-payload-digest": "payload_digest", "content-length": "content_length"}


def _clean(value: str) -> bytes:
    return value.replace("\r", " ").replace("\n", " ").encode("utf-8", "replace")


def member(record: bytes, level: int = 3) -> bytes:
    """A gzip member whose extra field tells its own length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 12 + struct.calcsize(EXTRA) + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", struct.calcsize(EXTRA)) + struct.pack(EXTRA, b"sl", 4, size) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(record_id: str, kind: str, uri: str | None, refers_to: str | None, digest: str | None, length: int | None, payload: bytes | None) -> bytes:
    """The bytes of one record."""
    payload = b"" if kind == "revisit" else payload or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (len(payload) if length is None else length)
    block = http + payload if kind in ("response", "revisit") else payload
    head = b"WARC/1.1\r\nWARC-Type: " + _clean(kind) + b"\r\nWARC-Record-ID: <" + _clean(record_id) + b">\r\n" + STATIC
    if uri is not None:
        head += b"WARC-Target-URI: " + _clean(uri) + b"\r\n"
    if digest is not None:
        head += b"WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)) + b"\r\n"
    if refers_to is not None:
        head += b"WARC-Refers-To: <" + _clean(refers_to) + b">\r\n" + PROFILE
    if kind in ("response", "revisit"):
        head += b"Content-Type: application/http; msgtype=response\r\n"
    return head + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict:
    """The header columns of a record from its header lines."""
    out: dict = dict.fromkeys(HEADERS.values())
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if column := HEADERS.get(name.strip().lower().decode("latin-1")):
            out[column] = value.strip().decode("utf-8", "replace")
    for c in ("record_id", "refers_to"):
        if out[c]:
            out[c] = out[c].strip("<>")
    if out["content_length"] is not None:
        out["content_length"] = int(out["content_length"])
    if (d := out["payload_digest"]) and d.lower().startswith("sha1:"):
        d = d[5:]
        try:
            out["payload_digest"] = base64.b32decode(d.upper()).hex() if len(d) == 32 else d.lower()
        except binascii.Error:
            pass
    return out


@dataclass
class Test:
    """A pushed predicate on a header."""

    column: str
    kind: str
    value: object

    def holds(self, row: dict) -> bool:
        x = row[self.column]
        if self.kind in ("null", "not null"):
            return (x is None) == (self.kind == "null")
        if x is None:
            return False
        v = self.value
        return {"=": lambda: x == v, "in": lambda: x in v, "<": lambda: x < v, "<=": lambda: x <= v, ">": lambda: x > v, ">=": lambda: x >= v, "starts": lambda: x.startswith(v), "!=": lambda: x != v}[self.kind]()


KINDS = {EqualTo: "=", In: "in", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">=", StringStartsWith: "starts", IsNull: "null", IsNotNull: "not null"}


def as_test(f) -> Test | None:
    column = getattr(f, "attribute", None)
    if isinstance(f, Not):
        inner = as_test(f.child)
        return Test(inner.column, "!=", inner.value) if inner and inner.kind == "=" else None
    if type(f) not in KINDS or len(column) != 1 or column[0] not in HEADERS.values():
        return None
    value = getattr(f, "value", None)
    if column[0] != "content_length" and KINDS[type(f)] in ("<", "<=", ">", ">="):
        return None  # Spark orders strings by bytes
    return Test(column[0], KINDS[type(f)], value)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class Window:
    """A growing view of a file from some place on."""

    def __init__(self, source, at: int, step: int = 1 << 17):
        self.source, self.at, self.step, self.data, self.done = source, at, step, b"", False

    def more(self) -> bool:
        if self.done:
            return False
        self.source.seek(self.at + len(self.data))
        got = self.source.read(self.step)
        self.done = not got
        self.data += got
        return bool(got)

    def need(self, n: int) -> bool:
        while len(self.data) < n and self.more():
            pass
        return len(self.data) >= n

    def leap(self, n: int) -> None:
        self.data, self.at = (self.data[n:] if n <= len(self.data) else b""), self.at + n


def _first(view: Window, end: int) -> bool:
    """Move to the first gzip member that begins before ``end`` and holds a record.

    Plain records are read from the start of a file on, never searched for: a payload may hold what looks like one.
    """
    if view.at == 0 and view.need(7) and view.data.startswith(b"WARC/1."):
        return True
    while view.at < end:
        if not view.need(4):
            return False
        at = view.data.find(b"\x1f\x8b\x08")
        if at < 0:
            view.leap(max(1, len(view.data) - 2))
            continue
        view.leap(at)
        if view.at >= end:
            return False
        view.need(1 << 12)
        try:
            if zlib.decompressobj(31).decompress(view.data, 16).startswith(b"WARC/"):
                return True
        except zlib.error:
            pass
        view.leap(1)
    return False


def records(source, start: int, end: int, tests: list[Test], payload: bool) -> Iterator[dict]:
    """The records that begin in a byte range and pass the tests."""
    view = Window(source, start)
    if not _first(view, end):
        return
    if view.data.startswith(b"WARC/1."):
        end = 1 << 62  # a plain file is one range
    while view.at < end and view.need(4):
        if view.data.startswith(b"\x1f\x8b\x08"):
            inflate, text, used = zlib.decompressobj(31), b"", 0
            while b"\r\n\r\n" not in text and not inflate.eof:
                if used >= len(view.data) and not view.more():
                    break
                piece = view.data[used : used + 4096]
                text += inflate.decompress(piece)
                used += len(piece) - len(inflate.unused_data)
            head, _, rest = text.partition(b"\r\n\r\n")
            row = parse_headers(head)
            wanted = all(t.holds(row) for t in tests)
            http = row["record_type"] in ("response", "revisit")
            whole = wanted and (payload or (http and b"\r\n\r\n" not in rest))
            size = 0
            if view.data[3] & 4 and view.need(12 + struct.calcsize(EXTRA)):
                name, n, size = struct.unpack_from(EXTRA, view.data, 12)
                size = size if (name, n) == (b"sl", 4) else 0
            if whole or not size:
                parts = [rest]
                while not inflate.eof:
                    if used >= len(view.data) and not view.more():
                        break
                    piece = view.data[used : used + (1 << 16)]
                    out = inflate.decompress(piece)
                    used += len(piece) - len(inflate.unused_data)
                    if whole:
                        parts.append(out)
                rest, size = b"".join(parts), used
        else:
            while (at := view.data.find(b"\r\n\r\n")) < 0 and view.more():
                pass
            if at < 0:
                return
            row = parse_headers(view.data[:at])
            size = at + 4 + (row["content_length"] or 0) + 4
            wanted = all(t.holds(row) for t in tests)
            if wanted:
                view.need(size if payload else min(size, at + 4 + 4096))
                rest = view.data[at + 4 : size]
        if wanted:
            rest = rest[: row["content_length"] or 0]
            row["payload_length"], row["payload"] = None, None
            if row["record_type"] in ("response", "revisit"):
                http_head, _, rest = rest.partition(b"\r\n\r\n")
                for line in http_head.split(b"\r\n"):
                    if line[:15].lower() == b"content-length:":
                        row["payload_length"] = int(line[15:])
            else:
                row["payload_length"] = row["content_length"]
            if payload:
                row["payload"] = rest
            yield row
        view.leap(size)
        while view.need(1) and view.data[:1] in (b"\r", b"\n"):
            view.leap(1)
        if view.need(4) and not view.data.startswith((b"\x1f\x8b\x08", b"WARC")) and not _first(view, end):
            return


ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("content_length", pa.int64()), ("payload_length", pa.int64()), ("payload", pa.binary())])


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.payload, self.tests = options.get("payload", "true").lower() != "false", []

    def pushFilters(self, filters):
        for f in filters:
            if test := as_test(f):
                self.tests.append(test)
            else:
                yield f

    def partitions(self):
        fs, folder = filesystem(self.path)
        found = fs.get_file_info(folder)
        files = [found] if found.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        files = sorted((f.path, f.size) for f in files if f.type == pafs.FileType.File and f.size and not f.base_name.startswith(("_", ".")))
        prefix = self.path[: len(self.path) - len(folder)] if self.path.endswith(folder) else self.path.split("://")[0] + "://" if "://" in self.path else ""
        ranges = [Range(prefix + p, a, min(a + s, n)) for p, n in files for s in [self.split if p.endswith(".gz") else n] for a in range(0, n, s)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        fs, where = filesystem(partition.path)
        with fs.open_input_file(where) as source:
            rows, size = [], 0
            for row in records(source, partition.start, partition.end, self.tests, self.payload):
                rows.append(row)
                size += len(row["payload"] or b"") + 200
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, ARROW)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.level = options["path"], int(options.get("level", 3))
        self.pending = f"_pending-{uuid.uuid4().hex}"  # this job's own

    def write(self, iterator):
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        fs, folder = filesystem(self.path)
        fs.create_dir(f"{folder}/{self.pending}", recursive=True)
        some = False
        with fs.open_output_stream(f"{folder}/{self.pending}/{name}", compression=None) as sink:
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_length", "payload")]
                for i in range(batch.num_rows):
                    some = True
                    sink.write(member(record(*[c[i].as_py() for c in columns]), self.level))
        if not some:
            fs.delete_file(f"{folder}/{self.pending}/{name}")
        return Written(name if some else None)

    def commit(self, messages):
        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        for m in messages:
            if m and m.name:
                fs.move(f"{folder}/{self.pending}/{m.name}", f"{folder}/{m.name}")
        self.abort(messages)

    def abort(self, messages):
        fs, folder = filesystem(self.path)
        if fs.get_file_info(f"{folder}/{self.pending}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{folder}/{self.pending}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("urn:page:"), page_id.cast("string"))


def _page(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, r"^urn:page:(-?\d+)$", 1), F.lit("")).cast("long")


def archive(pages: DataFrame, path: str, min_revisit_bytes: int = 1000) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html).

    Among rows with equal payloads (same SHA-1 and length) of at least ``min_revisit_bytes``, those with the largest
    page_id are responses and the others revisit it; rows with a null page_id are responses of their own.
    """
    register(pages.sparkSession)
    rows = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    # only payloads that repeat need a partner; texts don't take part in finding them
    shared = rows.where((F.col("bytes") >= min_revisit_bytes) & F.col("page_id").isNotNull()).groupBy(F.col("digest").alias("d"), F.col("bytes").alias("b")).agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("low")).where("low < keeper").drop("low")
    rows = rows.join(shared, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    revisit = F.col("page_id") < F.col("keeper")
    out = rows.select(
        F.coalesce(_urn(F.col("page_id")), F.concat(F.lit("urn:uuid:"), F.uuid())).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, _urn(F.col("keeper"))).alias("refers_to"),
        F.col("digest").alias("payload_digest"),
        F.lit(0).cast("long").alias("content_length"),
        F.col("bytes").alias("payload_length"),
        F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").option("path", path).save()


def load(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, from archives written and read back."""
    spark = pages.sparkSession
    path = work_path(spark, "warc")
    archive(pages, path)
    full = load(spark, path).where(F.col("record_type") == "response")
    full = full.select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    bare = load(spark, path, payload=False).where(F.col("record_type") == "revisit")
    bare = bare.select("record_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return full.unionByName(bare).select(_page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page(F.col("refers_to")).alias("refers_to"))
