"""WARC records in ZIP packages: distributed writer, directory parser and range reader.

Each write task packs its records into one ZIP package in the shared folder: a stored
member ``archive/data.warc.gz`` (one gzip member per WARC record) and a stored member
``indexes/index.jsonl`` with each record's offset and length in it. The package's path is
returned as a row and written to a manifest, so a task that ran twice leaves an unnamed
file behind and no repeated rows.

The reader never extracts a package. It reads the package's tail, finds the end-of-central-
directory record and, where sizes or counts overflow, the ZIP64 locator and record; parses
the central directory with its ZIP64 extra fields; finds the stored members through their
local headers; reads the index; and then reads byte ranges of the archive member, records
that lie together in one read of bounded size.

Of pages with equal payloads of ``least`` bytes or more, the one with the largest id is
written as a response; the others are revisits that name it and carry no payload. Equality
is by SHA-256 of the whole payload; the records carry its SHA-1 in base32.

Defined cases: null html is an empty payload; a null url is an empty target; rows that
repeat an id are pages of their own, ordered by their hash, as are null ids, which count as
smallest; a very long html is a payload like any other, written and read whole; an empty table
gives no packages and no records; extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, identified, partitions, read_table, small, with_ids

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
READ_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"     # fixed, so that reruns write the same bytes
_URN = "urn:page:"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a local, HDFS, S3 (also by Hadoop's names s3a and s3n), GCS or ABFS address."""
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Sink(io.RawIOBase):
    """Forward-only stream, as object stores have: the ZIP writer then uses data descriptors."""

    def __init__(self, out):
        super().__init__()
        self.out, self.n = out, 0

    def writable(self):
        return True

    def write(self, b):
        self.out.write(bytes(b))
        self.n += len(b)
        return len(b)

    def tell(self):
        return self.n


def warc_record(page: int, url: str, payload: bytes, refers_to: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    body = b"" if refers_to is not None else payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{page}>",
            f"WARC-Date: {DATE}", "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest}",
            f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_URN}{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def write_packages(rows: DataFrame, root: str, zip64: bool = False) -> DataFrame:
    """Pack rows (uid, url, payload, refers_to); returns (path, records)."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        fs, base = _open(root)
        fs.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.zip"
        entries: list[str] = []
        with fs.open_output_stream(f"{base}/{name}") as out, \
                zipfile.ZipFile(_Sink(out), "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            at = 0
            with z.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as member:
                batch = first
                while batch is not None:
                    for page, url, payload, ref in zip(*(c.to_pylist() for c in batch.columns)):
                        raw = gzip.compress(warc_record(page, url or "", payload or b"", ref), 3, mtime=0)
                        member.write(raw)
                        entries.append(json.dumps({"offset": at, "length": len(raw)}))
                        at += len(raw)
                    batch = next((b for b in batches if b.num_rows), None)
            with z.open(zipfile.ZipInfo(INDEX), "w", force_zip64=zip64) as member:
                member.write("\n".join(entries).encode())
        yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{name}"]), pa.array([len(entries)], pa.int64())],
                                         names=["path", "records"])
    return rows.select("uid", "url", "payload", "refers_to").mapInArrow(pack, "path string, records long")


def central_directory(f, size: int) -> dict[str, tuple[int, int, int]]:
    """Stored members of a ZIP: name -> (data offset, length, crc), from its directories alone."""
    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    eocd = tail.rfind(b"PK\x05\x06")
    if eocd < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    count, length, at = struct.unpack("<HII", tail[eocd + 10:eocd + 20])
    locator = tail_at + eocd - 20
    if locator >= 0 and (mark := read(locator, 20))[:4] == b"PK\x06\x07":
        z64 = read(struct.unpack("<Q", mark[8:16])[0], 56)
        if z64[:4] != b"PK\x06\x06":
            raise ValueError("broken ZIP64 end of central directory")
        count, length, at = struct.unpack("<QQQ", z64[32:56])
    directory, i, out = read(at, length), 0, {}
    for _ in range(count):
        if directory[i:i + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", directory[i + 10:i + 12])
        crc, packed, full, n, m, k = struct.unpack("<IIIHHH", directory[i + 16:i + 34])
        header, = struct.unpack("<I", directory[i + 42:i + 46])
        name = directory[i + 46:i + 46 + n].decode("utf-8", "replace")
        extra, j = directory[i + 46 + n:i + 46 + n + m], 0
        while j + 4 <= len(extra):
            tag, width = struct.unpack("<HH", extra[j:j + 4])
            if tag == 1:      # ZIP64: 8 bytes for each field that overflowed, in this order
                wide, p = extra[j + 4:j + 4 + width], 0
                if full == 0xFFFFFFFF:
                    full, p = struct.unpack("<Q", wide[p:p + 8])[0], p + 8
                if packed == 0xFFFFFFFF:
                    packed, p = struct.unpack("<Q", wide[p:p + 8])[0], p + 8
                if header == 0xFFFFFFFF:
                    header, p = struct.unpack("<Q", wide[p:p + 8])[0], p + 8
            j += 4 + width
        if method == 0:
            local = read(header, 30)
            a, b = struct.unpack("<HH", local[26:30])
            out[name] = (header + 30 + a + b, packed, crc)
        i += 46 + n + m + k
    return out


def locate(paths: DataFrame) -> DataFrame:
    """(path, at, length) of every record in the packages, from directories and indexes."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, p = _open(path)
                with fs.open_input_file(p) as f:
                    members = central_directory(f, f.size())
                    base, (at, n, _) = members[ARCHIVE][0], members[INDEX]
                    f.seek(at)
                    rows = [json.loads(x) for x in f.read(n).decode().split("\n") if x]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(rows), pa.string()), pa.array([base + r["offset"] for r in rows], pa.int64()),
                     pa.array([r["length"] for r in rows], pa.int64())], names=["path", "at", "length"])
    return paths.select("path").mapInArrow(scan, "path string, at long, length long")


_RECORD = "uid long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def parse_record(raw: bytes) -> tuple:
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    payload = body[:int(h["content-length"])]
    kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {h['warc-record-id']} does not have its digest")
    number = lambda x: int(x.strip("<>").removeprefix(_URN))
    ref = h.get("warc-refers-to")
    return (number(h["warc-record-id"]), h["warc-target-uri"], kind, int(h["x-payload-length"]), digest,
            number(ref) if ref else None, payload)


def read_records(located: DataFrame) -> DataFrame:
    """Range-read located records; neighbours are read together, up to READ_BYTES at once."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, opened = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            i = 0
            while i < len(rows):
                path, at, length = rows[i]
                j, end = i + 1, at + length
                while j < len(rows) and rows[j][0] == path and rows[j][1] == end and end - at < READ_BYTES:
                    end += rows[j][2]
                    j += 1
                if path != opened:
                    if f is not None:
                        f.close()
                    fs, p = _open(path)
                    f, opened = fs.open_input_file(p), path
                f.seek(at)
                block = f.read(end - at)
                got = [parse_record(gzip.decompress(block[a - at:a - at + n])) for _, a, n in rows[i:j]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*got), (pa.int64(), pa.string(), pa.string(), pa.int64(),
                                                                pa.string(), pa.int64(), pa.binary()))],
                    names=["uid", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])
                i = j
        if f is not None:
            f.close()
    n = partitions(located.sparkSession)
    dealt = located.repartitionByRange(n, "path", "at").sortWithinPartitions("path", "at")
    return dealt.mapInArrow(scan, _RECORD)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            least: int = 0) -> tuple[DataFrame, DataFrame, bool]:
    """Write all pages into packages and read them back: (records, rows, rekeyed)."""
    ws = Workspace(pages.sparkSession, "warc")
    rows, rekeyed = identified(ws, pages, id_col, {
        "url": F.col(url_col), "payload": F.coalesce(F.col(html_col), F.lit("")).cast("binary")})
    known = rows.select("uid", F.unhex(F.sha2("payload", 256)).alias("d"), F.octet_length("payload").alias("n"))
    known = ws.save(known, "digests")
    winners = (known.filter(F.col("n") >= least).groupBy("d").agg(F.max("uid").alias("refers_to"), F.count(F.lit(1)).alias("c"))
               .filter("c > 1").select("d", "refers_to"))
    revisits = ws.save(known.filter(F.col("n") >= least).join(winners, "d").filter("uid < refers_to")
                       .select("uid", "refers_to"), "revisits")
    packed = write_packages(rows.join(small(revisits), "uid", "left"), ws.path("packages"))
    return read_records(locate(ws.save(packed, "manifest"))), rows, rekeyed


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` through packages and back."""
    out, rows, rekeyed = archive(read_table(spark, sf_dir, "pages"))
    out = out.select("uid", "payload_bytes", "payload_digest", "record_type", "refers_to")
    if rekeyed:
        out = out.join(rows.select(F.col("uid").alias("refers_to"), F.col("_id").alias("_ref")), "refers_to", "left") \
            .drop("refers_to").withColumnRenamed("_ref", "refers_to")
    out = with_ids(out, rows, rekeyed)
    return out.select(F.col("_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
