"""Legacy archive converter: ARC 1 and 2 to WARC 1.1, and a WARC writer and reader over Spark's own file sinks.

An ARC file starts with a version block whose body names the version ("1 0 ..." or "2 0 ...") and the fields of
every header line; a record is one header line, of 5 or 10 fields, and as many bytes as its last field
declares. From these the converter synthesises WARC records: a stable UUID, an ISO timestamp from the 14 digits, a
type (warcinfo for the version block, response for HTTP, revisit for a payload met before, resource
otherwise), media types and SHA-256 digests of block and payload. A revisit keeps the HTTP header and drops
the payload; its payload digest and the header's Content-Length are those of the full payload.

Archives are `.warc.gz` files of about ARCHIVE_BYTES: a warcinfo record, then a gzip member for each record. A task makes whole archives, a
row each, and Spark's text sink writes a file a row, so commits, retries and every store that Spark writes work; what
the sink sets behind a row is an empty gzip member. They are read as whole files, unzipped as a stream, by declared lengths.

A page's record id is a UUID of version 8 (RFC 9562): 48 bits of a digest of its payload, and the page's id. So reading takes a page's id
from WARC-Record-ID, and the page that a revisit refers to from WARC-Refers-To. Other records' ids are name-based.

Defined cases: a null page is an empty payload; a null id stays null, and such a row is never a revisit; rows that repeat the
smallest id of a payload are responses all; spaces in addresses are percent-encoded, a null address is "about:blank"; a page larger than
ARCHIVE_BYTES is an archive of its own (up to 2 GB of it compressed, Spark's limit of a value).
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from multiprocessing.pool import ThreadPool
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livgrid.llm.skew import join_unique
from livgrid.llm.storage import Work
from livgrid.llm.wordhash import chunks

#: Fixed values of the two formats.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
CRLF = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are always stored; compressed bytes of an archive; when the pages count as archived.
LEAST_REVISIT, ARCHIVE_BYTES, ARCHIVED = 100, 32 << 20, "20000101000000"
#: A gzip member of nothing, as text of single bytes.
EMPTY_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")
_SPACE = re.compile(r"[\x00-\x20\x7f]+")


class ArcRecord(NamedTuple):
    fields: dict[str, str]
    body: bytes
    offset: int


def write_arc(records: Iterable[tuple[str, str, str, str, bytes]], version: int = 1, name: str = "pages.arc") -> bytes:
    """An ARC file of (url, ip, date, type, body); version 2 adds result code, checksum, location, offset and file name."""
    out = io.BytesIO()
    body = f"{version} 0 livgrid\n{' '.join(ARC_FIELDS[version])}\n\n".encode()

    def line(url: str, ip: str, date: str, kind: str, body: bytes) -> bytes:
        head = [_SPACE.sub(lambda m: "".join(f"%{ord(c):02X}" for c in m[0]), url) or "about:blank", ip, date, kind]
        if version == 2:
            code = body[9:12].decode() if body.startswith(b"HTTP/") else "-"
            head += [code, hashlib.md5(body, usedforsecurity=False).hexdigest(), "-", str(out.tell()), name]
        return " ".join([*head, str(len(body))]).encode() + b"\n"

    for url, ip, date, kind, block in [("filedesc://" + name, "0.0.0.0", ARCHIVED, "text/plain", body), *records]:
        out.write(line(url, ip, date, kind, block))
        out.write(block)
        out.write(b"\n")
    return out.getvalue()


def read_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """The records of an ARC file, the version block first. A header line that doesn't fit its version, or a body cut short, is a ValueError."""
    names: tuple[str, ...] = ()
    at = 0
    while line := stream.readline():
        start, at = at, at + len(line)
        if not line.strip():  # records end with a line feed
            continue
        text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
        if not names:
            parts = text.split(" ")
            if len(parts) not in (5, 10) or not parts[0].startswith("filedesc:"):
                raise ValueError("no version block at the start")
            parts = [*parts[:4], parts[-1]]
        else:
            parts = text.rsplit(" ", len(names) - 1)  # a URL with blanks keeps them
            if len(parts) != len(names):
                raise ValueError(f"{len(parts)} fields in the header line at byte {start}; the version has {len(names)}")
        if not parts[-1].isdigit():
            raise ValueError(f"no length in the header line at byte {start}")
        body = stream.read(int(parts[-1]))
        if len(body) < int(parts[-1]):
            raise ValueError(f"the record at byte {start} declares {parts[-1]} bytes and has {len(body)}")
        at += len(body)
        if names:
            yield ArcRecord(dict(zip(names, parts, strict=True)), body, start)
            continue
        version = body[:1].decode("latin-1")
        if version not in ("1", "2"):
            raise ValueError(f"unknown version {version!r}")
        yield ArcRecord(dict(zip(ARC_FIELDS[1], parts, strict=True)), body, start)
        names = ARC_FIELDS[int(version)]


class WarcRecord(NamedTuple):
    headers: dict[str, str]
    block: bytes

    def to_bytes(self) -> bytes:
        """The record without the separator that follows it."""
        head = "".join(f"{k}: {v}\r\n" for k, v in (self.headers | {"Content-Length": str(len(self.block))}).items())
        return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogateescape") + CRLF + self.block


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, parts)))}>"


def page_record_id(page_id: int | None, payload_digest: str, url: str = "") -> str:
    """The record id of a page; without an id, one that the payload and the address name."""
    if page_id is None:
        return record_id("page", payload_digest, url)
    low = page_id & (1 << 64) - 1
    head = int(hashlib.sha256(b"page\0" + payload_digest.encode()).hexdigest()[:12], 16)
    return f"<urn:uuid:{uuid.UUID(int=head << 80 | 8 << 76 | (low >> 62) << 64 | 2 << 62 | low & (1 << 62) - 1)}>"


def page_of(record: str | None) -> int | None:
    """The page that a record id names, if it is a page's."""
    if record is None or not record.startswith("<urn:uuid:"):
        return None
    value = uuid.UUID(record[len("<urn:uuid:") : -1]).int
    if value >> 76 & 15 != 8:
        return None
    low = (value >> 64 & 3) << 62 | value & (1 << 62) - 1
    return low - (1 << 64) if low >> 63 else low


def timestamp(digits: str) -> str:
    """2000-01-01T00:00:00Z of 14 digits; missing ones are the least that they can be."""
    if not re.fullmatch(r"\d{4,14}", digits):
        raise ValueError(f"not a date: {digits!r}")
    d = digits + "00000101000000"[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP header, with the empty line that ends it, and the payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(CRLF + CRLF)
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (block, b"")


def http_field(header: bytes, name: str) -> str | None:
    m = re.search(rf"(?im)^{re.escape(name)}:[ \t]*([^\r\n]*)", header.decode("latin-1"))
    return m[1].strip() if m else None


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def to_warc(record: ArcRecord, own_id: str | None = None, refers_to: str | None = None) -> WarcRecord:
    """The WARC record of an ARC record. own_id: its record id, if given; refers_to: that of the response with the same payload, for a revisit."""
    f = record.fields
    head, payload = split_http(record.body)
    common = {"WARC-Record-ID": own_id or record_id(f["URL"], f["Archive-date"], record.offset), "WARC-Date": timestamp(f["Archive-date"])}
    if f["URL"].startswith("filedesc:"):
        return WarcRecord({"WARC-Type": "warcinfo", **common, "WARC-Filename": f["URL"].removeprefix("filedesc://"), "Content-Type": "application/warc-fields", "WARC-Block-Digest": digest(record.body)}, record.body)
    common |= {"WARC-Target-URI": f["URL"], "WARC-IP-Address": f["IP-address"]}
    if not head:
        return WarcRecord({"WARC-Type": "resource", **common, "Content-Type": f["Content-type"], "WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(payload)}, payload)
    common |= {"Content-Type": "application/http; msgtype=response", "WARC-Identified-Payload-Type": f["Content-type"], "WARC-Payload-Digest": digest(payload)}
    if refers_to is not None:
        return WarcRecord({"WARC-Type": "revisit", **common, "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": refers_to, "WARC-Block-Digest": digest(head)}, head)
    return WarcRecord({"WARC-Type": "response", **common, "WARC-Block-Digest": digest(record.body)}, record.body)


def member(record: WarcRecord) -> bytes:
    """A record and its separator as one gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record.to_bytes() + CRLF + CRLF) + packer.flush()


def read_warc(stream: BinaryIO) -> Iterator[WarcRecord]:
    """The records of a WARC stream, by declared lengths; a record cut short is a ValueError."""
    while line := stream.readline():
        if line == CRLF:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should start: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (CRLF, b""):
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            headers[k.strip()] = v.strip()
        block = stream.read(n := int(headers["Content-Length"]))
        if len(block) < n:
            raise ValueError(f"a record declares {n} bytes and has {len(block)}")
        yield WarcRecord(headers, block)


def first_copies(pages: DataFrame, work: Work, page_id: str, payload: str) -> DataFrame:
    """page_id, payload_digest, first: the pages that repeat an earlier one's payload of LEAST_REVISIT bytes or more. A payload of very many pages
    is no hot key: its first page is found by pre-aggregated minima and goes back by a broadcast."""
    body = F.coalesce(F.col(payload), F.lit(""))
    large = pages.filter((F.octet_length(body) >= LEAST_REVISIT) & F.col(page_id).isNotNull())
    large = work.write(large.select(F.col(page_id).cast("bigint").alias("page_id"), F.sha2(body, 256).alias("payload_digest")), "payloads")
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").drop("last")
    return join_unique(large, work.write(first, "firsts"), ["payload_digest"], work, "copies").filter("page_id > first").distinct()


def write_archives(pages: DataFrame, work: Work, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", version: int = 1) -> None:
    """WARC archives of pages in the folder path. Every page goes through an ARC record: written, parsed and converted."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), body.alias("body"), F.sha2(body, 256).alias("payload_digest"))
    rows = rows.join(first_copies(pages, work, page_id, payload), ["page_id", "payload_digest"], "left").select("page_id", "url", "body", "first")
    most = ARCHIVE_BYTES

    def converted(batch: pa.RecordBatch) -> Iterator[WarcRecord]:
        """The version block's record, then those of a batch of pages."""
        ids, urls, bodies, firsts = (c.to_pylist() for c in batch.columns)
        records, digests = [], []
        for u, b in zip(urls, bodies, strict=True):
            data = b.encode()
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n"
            records.append((u or "", "0.0.0.0", ARCHIVED, "text/html", head.encode() + data))
            digests.append(digest(data))
        arc = read_arc(io.BytesIO(write_arc(records, version)))
        yield to_warc(next(arc))
        for r, i, f, d in zip(arc, ids, firsts, digests, strict=True):
            yield to_warc(r, page_record_id(i, d, r.fields["URL"]), None if f is None else page_record_id(f, d))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chunks(batches, "body"):
            info, *records = converted(batch)
            for made in map(member, records):
                if size and size + len(made) > most:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])
                    held, size = [], 0
                if not held:
                    held.append(member(info))
                held.append(made)
                size += len(made)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])

    made = rows.mapInArrow(archives, "archive binary").select(F.col("archive").cast("string").alias("value"))
    # bytes go through the sink as they are; its separator is encoded as the option says
    made.write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER).option("maxRecordsPerFile", 1).text(path)
    _named(pages.sparkSession, path)


def _named(spark: SparkSession, path: str) -> None:
    """Gives the sink's files the ending of compressed WARC files: a call of the store for each archive."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().endswith(".txt")]
    with ThreadPool(16) as pool:
        done = pool.map(lambda p: fs.rename(p, p.suffix(".warc.gz")), old)
    if not all(done):
        raise OSError(f"archives in {path} couldn't be renamed")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_id, record_type, payload_bytes, payload_digest, refers_to of the records, but warcinfo, of a folder of `.warc.gz` files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        rows: list[tuple] = []
        for batch in batches:
            for content in batch.column(0):
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as zipped, io.BufferedReader(zipped, 1 << 20) as stream:
                    for h, block in read_warc(stream):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        head, payload = split_http(block)
                        if h["WARC-Type"] == "revisit":
                            size, value = int(http_field(head, "Content-Length") or 0), h["WARC-Payload-Digest"]
                        else:
                            size, value = len(payload), digest(payload)
                            if value != h["WARC-Payload-Digest"]:
                                raise ValueError(f"the payload of {h['WARC-Record-ID']} doesn't have the digest that its header gives")
                        rows.append((page_of(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Record-ID"], h["WARC-Type"], size, value.removeprefix("sha256:"), page_of(h.get("WARC-Refers-To"))))
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(parse, "page_id long, url string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long")


def archive_and_read(pages: DataFrame, work: Work, **columns: str) -> DataFrame:
    """Pages written as archives in the shared folder, and read back."""
    write_archives(pages, work, at := f"{work.path}/warc", **columns)
    return read_archives(pages.sparkSession, at)
