"""WARC records in ZIP-packaged archives: writer, and a reader by ranges.

An archive is a ZIP file with two stored members, ``archive/data.warc.gz`` (one
gzip member a record) and ``indexes/index.cdx`` (offset and length of each
record). The reader parses the end record, the ZIP64 records and the central
directory from the file's tail, locates the stored members, and reads records by
their ranges; nothing is extracted and no whole archive is loaded.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope.llm.shared import n_parts, need, new_path, saved

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Bytes of an archive's records that one reading task gets at once.
RANGE_BYTES = 8 << 20
#: Bytes of records after which the writer begins the next archive.
ARCHIVE_BYTES = 256 << 20

#: Pages with one payload from which on it is marked by broadcast, and the most such
#: payloads (48 bytes each); the least number of pages is raised until they fit.
HOT, MAX_HOT = 1 << 12, 1 << 16

# fixed values: the ZIP format's signatures and sizes
_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


class BadArchive(ValueError):
    """The file is not a ZIP archive that this reader can serve by ranges."""


@dataclass
class Member:
    name: str
    method: int
    flags: int
    packed: int
    size: int
    header: int
    crc: int


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path; Hadoop's names for object stores are understood."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def _open(path: str):
    where, inner = _file_system(path)
    return where.open_input_file(inner)


def _read(f, at: int, n: int) -> bytes:
    if at < 0 or n < 0:
        raise BadArchive(f"range {at}+{n} is outside the file")
    got = f.read_at(n, at) if hasattr(f, "read_at") else (f.seek(at), f.read(n))[1]
    if len(got) != n:
        raise BadArchive(f"range {at}+{n} ends early")
    return got


def central_directory(f, size: int) -> list[Member]:
    """Members of the archive in a random-access file of this size."""
    tail_at = max(0, size - 65557)
    tail = _read(f, tail_at, size - tail_at)
    end = len(tail)
    while True:
        end = tail.rfind(_END, 0, end)
        if end < 0:
            raise BadArchive("no end of central directory")
        if end + 22 <= len(tail) and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail):
            break
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    end_at = tail_at + end
    if end_at >= 20 and (locator := _read(f, end_at - 20, 20))[:4] == _LOCATOR64:
        at64 = struct.unpack_from("<Q", locator, 8)[0]
        record = _read(f, at64, 56)
        if record[:4] != _END64:
            raise BadArchive("the ZIP64 locator points elsewhere")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    elif 0xFFFFFFFF in (length, start) or count == 0xFFFF:
        raise BadArchive("ZIP64 records are missing")
    if start + length > end_at:
        raise BadArchive("the central directory overlaps its end record")
    table, at, out = _read(f, start, length), 0, []
    for _ in range(count):
        if table[at : at + 4] != _ENTRY or at + 46 > len(table):
            raise BadArchive("broken central directory entry")
        flags, method = struct.unpack_from("<HH", table, at + 8)
        crc, packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIIHHH", table, at + 16)
        header = struct.unpack_from("<I", table, at + 42)[0]
        name = table[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = table[at + 46 + n_name : at + 46 + n_name + n_extra]
        wide = _zip64_extra(extra)
        values = []
        for v in (full, packed, header):
            if v == 0xFFFFFFFF:
                if len(wide) < 8:
                    raise BadArchive(f"{name}: ZIP64 sizes are missing")
                v, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
            values.append(v)
        out.append(Member(name, method, flags, values[1], values[0], values[2], crc))
        at += 46 + n_name + n_extra + n_note
    return out


def _zip64_extra(extra: bytes) -> bytes:
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return extra[at + 4 : at + 4 + n]
        at += 4 + n
    return b""


def stored_start(f, m: Member) -> int:
    """Where a stored member's bytes begin; raises if it is packed or encrypted."""
    if m.method or m.flags & 1 or m.packed != m.size:
        raise BadArchive(f"{m.name} isn't a plain stored member")
    head = _read(f, m.header, 30)
    if head[:4] != _LOCAL:
        raise BadArchive(f"{m.name} has no local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return m.header + 30 + n_name + n_extra


def archive_index(f, size: int) -> list[tuple[int, int]]:
    """(offset in the file, length) of every record, from the archive's own index."""
    members = {m.name: m for m in central_directory(f, size)}
    if DATA not in members or INDEX not in members:
        raise BadArchive("the archive has no records or no index")
    data, index = members[DATA], members[INDEX]
    base = stored_start(f, data)
    text = _read(f, stored_start(f, index), index.size)
    if zlib.crc32(text) != index.crc:
        raise BadArchive("the index is damaged")
    out = []
    for line in text.splitlines():
        offset, length = map(int, line.split(b" ")[:2])
        if offset < 0 or length < 0 or offset + length > data.size:
            raise BadArchive("the index points outside the records")
        out.append((base + offset, length))
    return out


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit that leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:{f'uuid:{uuid.uuid4()}' if page_id is None else f'page:{page_id}'}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record: type, ids, url, digest, payload length and payload."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise BadArchive("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise BadArchive("the record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)^content-length: (\d+)\r?$", http, re.M)[1])
    revisit = fields["warc-type"] == "revisit"
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != length or payload_digest(payload) != digest):
        raise BadArchive("the payload doesn't match its digest")
    of = lambda x: int(x[len("<urn:page:") : -1]) if x and x.startswith("<urn:page:") else None
    return {"page_id": of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload_digest": digest, "payload_bytes": length, "refers_to": of(fields.get("warc-refers-to")), "payload": None if revisit else payload}


class _Writer:
    """One archive; the index is kept until the records are written."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.zip"
        where, inner = _file_system(self.path)
        where.create_dir(inner.rpartition("/")[0], recursive=True)
        self.file = where.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index, self.at, self.n = io.BytesIO(), 0, 0

    def add(self, page_id: int | None, raw: bytes) -> None:
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = pack.compress(raw) + pack.flush()
        self.data.write(packed)
        self.index.write(f"{self.at} {len(packed)} {'-' if page_id is None else page_id}\n".encode())
        self.at, self.n = self.at + len(packed), self.n + 1

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), self.index.getvalue())
        self.zip.close()
        self.file.close()
        return self.path, self.n


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write every page and return the archives written: (path, n_records).

    Of pages with equal payloads of at least ``least`` bytes, the smallest id is
    the response and the others revisit it; smaller payloads, and rows that repeat
    the response's id, are all responses. Null html is an empty payload. Rows
    without id (or with one that is no integer) are responses with a record id of
    their own, which no page revisits, and read back without id. A task that is
    tried again writes new files; only files of tasks that ended are returned. The
    folder is one that all executors share.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    base = need(pages, id_col, url_col, html_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(f"`{html_col}`", F.lit("")).alias("html"))
    keyed = base.where("id is not null").select("id", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    keyed = keyed.where(F.col("size") >= least)
    groups = saved(keyed.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "warc-groups")
    # Payloads that very many pages have are marked by broadcast, not in one task each.
    least_hot = HOT
    while groups.where(F.col("n") >= least_hot).count() > MAX_HOT:
        least_hot *= 2
    hot = F.broadcast(groups.where(F.col("n") >= least_hot).select("digest", "first"))
    cold = groups.where(F.col("n") < least_hot).select("digest", "first")
    rare = keyed.join(hot, "digest", "left_anti").join(cold, "digest")
    revisits = rare.unionByName(keyed.join(hot, "digest")).where("id > first").select("id", "digest", "first").distinct()
    marked = base.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).join(revisits, ["id", "digest"], "left").select("id", "url", "html", "first")
    out = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, int]] = []
        w = None
        for b in batches:
            for i, url, html, first in zip(*(c for c in b.columns), strict=True):
                if w is None:
                    w = _Writer(folder)
                payload = html.as_py().encode()
                w.add(i.as_py(), record(i.as_py(), url.as_py(), payload, payload_digest(payload), first.as_py()))
                if w.at >= ARCHIVE_BYTES:
                    done.append(w.close())
                    w = None
        if w is not None:
            done.append(w.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], out.names)

    return saved(marked.mapInArrow(write, out), "warc-list")


_RANGES = T.StructType([T.StructField("path", T.StringType()), T.StructField("start", T.LongType()), T.StructField("lengths", T.ArrayType(T.LongType()))])
RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def read_archives(archives: DataFrame, payloads: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row a record (``RECORD``) of the archives listed in the column ``path``.

    Directories and indexes are read first; the records are then dealt out in
    ranges of about ``range_bytes``, each read in one request, so that one large
    archive is read by many tasks. Damaged archives raise ``BadArchive``. Empty lists give no rows.
    """
    spark: SparkSession = archives.sparkSession

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                with _open(path) as f:
                    records = archive_index(f, f.size())
                parts: list[tuple[int, list[int]]] = []
                end, room = -1, 0
                for offset, length in sorted(records):
                    if room <= 0 or offset != end:
                        parts.append((offset, []))
                        room = range_bytes
                    parts[-1][1].append(length)
                    end, room = offset + length, room - length
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(parts), pa.string()), pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.list_(pa.int64()))], _RANGES.names)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, lengths in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with _open(path) as f:
                    data, at, rows = memoryview(_read(f, start, sum(lengths))), 0, []
                for length in lengths:
                    r = parse_record(zlib.decompress(data[at : at + length], 31))
                    rows.append(r if payloads else r | {"payload": None})
                    at += length
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    ranges = archives.select("path").repartition(n_parts(spark), "path").mapInArrow(locate, _RANGES)
    return ranges.repartition(n_parts(spark)).mapInArrow(fetch, RECORD)


_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
