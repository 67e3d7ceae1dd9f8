"""Conversion of legacy ARC archives to WARC, and reading and writing of WARC archives.

ARC: a version block, then records of one header line and a body of the length that the
line declares. The version block says which fields a header line has; fields are
matched by name, from the right, because only the URL may hold spaces. Each record gets the WARC
identifier, date, type, content type and digests that a WARC writer would have given it;
all of these follow from the record, so a conversion repeats exactly.

Archives are written by Spark's text sink: a WARC record ends in CRLF CRLF, which is the
sink's line separator, so a part file is a WARC archive (gzip on request). They are read
as whole files of a bounded number of records and cut by declared lengths only: a payload may hold any bytes that
look like a header.

Null payload counts as empty. Rows of one page id and equal payload are one page: all are
the response if theirs is the smallest id. A null id is never the smallest; if a payload
has no other id, its rows are responses. Null URLs become `urn:page:<id>`. An empty table
gives no archive rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entloom.llm.common import scratch

# The header lines of the two versions of the format.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

END = b"\r\n\r\n"


class ArcRecord(NamedTuple):
    fields: dict[str, str]
    body: bytes
    version: int


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# -- ARC -----------------------------------------------------------------------------


def arc_version_block(name: str, date: str, version: int = 1) -> bytes:
    body = f"{version} 0 Archive\n{' '.join(ARC_FIELDS[version])}\n".encode()
    extra = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body + b"\n"


def arc_record(url: str, ip: str, date: str, kind: str, body: bytes, version: int = 1, name: str = "-") -> bytes:
    extra = f" 200 {hashlib.md5(body).hexdigest()} - 0 {name}" if version == 2 else ""
    return f"{url} {ip} {date} {kind}{extra} {len(body)}\n".encode() + body + b"\n"


def _header(line: bytes, names: list[str]) -> dict[str, str]:
    """A header line by its fields' names; what is left over on the left belongs to the URL."""
    parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
    if len(parts) < len(names):
        raise ValueError(f"ARC header of {len(parts)} fields, {len(names)} declared: {line[:200]!r}")
    cut = len(parts) - len(names) + 1
    return dict(zip(names, [" ".join(parts[:cut]), *parts[cut:]], strict=True))


def read_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """Records of an ARC archive, the version block first. A body shorter than declared raises EOFError."""
    names, version = ARC_FIELDS[1], 1
    while line := stream.readline():
        if not line.strip():
            continue
        first = line.startswith(b"filedesc://")
        if first:  # its own line has the fields of the version that the block below declares
            length = int(line.rsplit(b" ", 1)[1])
            body = stream.read(length)
            intro, _, listed = body.partition(b"\n")
            version = int(intro.split(b" ", 1)[0])
            names = listed.partition(b"\n")[0].decode().split() or ARC_FIELDS[version]
            fields = _header(line, names)
        else:
            fields = _header(line, names)
            length = int(fields["Archive-length"])
            body = stream.read(length)
        if len(body) != length:
            raise EOFError(f"{fields.get('URL')}: {len(body)} of {length} bytes")
        yield ArcRecord(fields, body, version)


# -- ARC to WARC ---------------------------------------------------------------------


def warc_date(arc_date: str) -> str:
    """`YYYYMMDDhhmmss`, or a part of it, as an ISO 8601 time; missing parts are the first."""
    digits = re.sub(r"\D", "", arc_date)[:14]
    d = digits + "19700101000000"[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_parts(block: bytes) -> tuple[bytes, bytes] | None:
    """Head (with its blank line) and payload of an HTTP response; None if it is none."""
    if not block.startswith(b"HTTP/"):
        return None
    ends = [(at, n) for sep, n in ((b"\r\n\r\n", 4), (b"\n\n", 2)) if (at := block.find(sep)) >= 0]
    at, n = min(ends, default=(len(block), 0))
    return block[: at + n], block[at + n :]


def record_id(url: str, date: str, digest: str, salt: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((url, date, digest, salt)))}>"


def to_warc(record: ArcRecord, salt: str = "") -> tuple[dict[str, str], bytes]:
    """WARC header and block of an ARC record. `salt` tells apart records that are equal otherwise."""
    f = record.fields
    url, date, kind = f["URL"], warc_date(f.get("Archive-date", "")), f.get("Content-type", "application/octet-stream")
    parts = http_parts(record.body)
    payload = parts[1] if parts else record.body
    digest = base32_sha1(payload)
    head = {"WARC-Type": "response", "WARC-Record-ID": record_id(url, date, digest, salt), "WARC-Date": date, "WARC-Target-URI": url}
    if ip := f.get("IP-address", "").strip("-"):
        head["WARC-IP-Address"] = ip
    if url.startswith("filedesc://"):
        head |= {"WARC-Type": "warcinfo", "WARC-Filename": url.removeprefix("filedesc://"), "Content-Type": "text/plain"}
        del head["WARC-Target-URI"]
    elif parts:
        head["Content-Type"] = "application/http; msgtype=response"
        head["WARC-Payload-Digest"] = "sha1:" + digest
    else:
        head |= {"WARC-Type": "resource", "Content-Type": kind, "WARC-Payload-Digest": "sha1:" + digest}
    head["WARC-Block-Digest"] = "sha1:" + base32_sha1(record.body)
    return head, record.body


def to_revisit(head: dict[str, str], block: bytes, refers_to: str) -> tuple[dict[str, str], bytes]:
    """The record as a revisit of an equal payload: the payload goes, HTTP head and digest stay."""
    parts = http_parts(block)
    kept = parts[0] if parts else b""
    out = head | {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": refers_to, "WARC-Block-Digest": "sha1:" + base32_sha1(kept)}
    return out, kept


def warc_bytes(head: dict[str, str], block: bytes) -> bytes:
    """A record without the CRLF CRLF that ends it."""
    clean = (f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in head.items())
    return ("WARC/1.0\r\n" + "".join(clean) + f"Content-Length: {len(block)}\r\n\r\n").encode() + block


def read_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record, cut by declared lengths."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:80]!r}")
        head = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode().partition(":")
            head[key] = value.strip()
        block = stream.read(length := int(head["Content-Length"]))
        if len(block) != length or stream.read(4) != END:
            raise EOFError(f"{head.get('WARC-Record-ID')}: cut short")
        yield head, block


# -- tables --------------------------------------------------------------------------


def page_urn(page_id: int, head: dict[str, str]) -> str:
    """Identifier of a page's record; a revisit has the digest of its response, so it can name it without looking it up."""
    return f"<urn:page:{page_id}:{head['WARC-Payload-Digest'].removeprefix('sha1:')}>"


def _page_to_warc(page_id, url, html, first_id, date: str, version: int) -> str:
    """One page, framed as an ARC record, converted; a revisit unless it is the first of its payload."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    target = re.sub(r"\s", "%20", url) if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    arc = arc_version_block("pages.arc", date, version) + arc_record(target, "0.0.0.0", date, "text/html", http, version, "pages.arc")
    _, record = read_arc(io.BytesIO(arc))
    head, block = to_warc(record, str(page_id))
    if page_id is not None:
        head |= {"WARC-Record-ID": page_urn(page_id, head), "X-Page-ID": str(page_id)}
    if first_id is not None and page_id != first_id:
        head, block = to_revisit(head, block, page_urn(first_id, head))
    return warc_bytes(head, block).decode("utf-8", "surrogatepass")


def write_pages(pages: DataFrame, path: str, *, min_payload: int = 0, version: int = 1, date: str = "20200101000000", records_per_file: int = 2048, file_bytes: int = 1 << 30, compression: str = "gzip") -> None:
    """Write pages (page_id, url, html) as WARC archives under `path`.

    Of rows with equal payloads of at least `min_payload` bytes, the smallest page_id's is the
    response and the others revisit it. The first page of each payload is found on digests alone (partial sums before
    the shuffle); pages then join it on the digest, where a hot payload is split by AQE. No archive holds more than `file_bytes` of payloads,
    unless a single page does.
    """
    src = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    src = src.withColumn("__sha", F.sha1(F.coalesce("html", F.lit("")).cast("binary"))).withColumn("__len", F.coalesce(F.octet_length("html"), F.lit(0)))
    first = src.groupBy("__sha", "__len").agg(F.min("page_id").alias("__first")).where(F.col("__len") >= min_payload)
    # Archives of some thousand pages, also where the shuffle has many small partitions; of large pages as many as `file_bytes` hold.
    spark = pages.sparkSession
    rows, most = src.agg(F.count(F.lit(1)), F.max("__len")).first()
    files = max(2 * spark.sparkContext.defaultParallelism, rows // (2 * records_per_file))
    joined = src.join(first, ["__sha", "__len"], "left").select("page_id", "url", "html", "__first", "__len")
    large = file_bytes // records_per_file

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                cols = [c.to_pylist() for c in batch.slice(start, 256).columns]
                yield pa.RecordBatch.from_arrays([pa.array([_page_to_warc(*row, date, version) for row in zip(*cols, strict=True)], pa.string())], names=["value"])

    def write(part: DataFrame, name: str, records: int) -> None:
        writer = part.drop("__len").mapInArrow(run, "value string").write.option("lineSep", END.decode()).option("maxRecordsPerFile", records)
        writer.option("compression", compression).text(f"{path}/{name}")

    write(joined.where(F.col("__len") <= large).coalesce(files), "pages", records_per_file)
    if (most or 0) > large:
        write(joined.where(F.col("__len") > large), "large", max(1, file_bytes // most))


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the WARC archives under `path`: page_id, type, target, date, payload, its length and digest, refers_to.

    Without `payloads` they are checked against their digests but not returned.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def rows(data: bytes):
        stream = io.BytesIO(data)
        if data[:2] == b"\x1f\x8b":
            stream = gzip.GzipFile(fileobj=stream)
        for head, block in read_warc(io.BufferedReader(stream, 1 << 20) if isinstance(stream, gzip.GzipFile) else stream):
            kind = head["WARC-Type"]
            if kind == "warcinfo":
                continue
            http = http_parts(block)
            payload = http[1] if http else block
            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
            refers = None
            if kind == "revisit":
                length = int(re.search(rb"(?mi)^content-length:\s*(\d+)", http[0])[1]) if http else 0
                refers = int(head["WARC-Refers-To"].split(":")[2])
                payload = None
            else:
                length = len(payload)
                if base32_sha1(payload) != digest:
                    raise ValueError(f"{head['WARC-Record-ID']}: payload and digest differ")
                payload = payload if payloads else None
            page = head.get("X-Page-ID")
            yield None if page is None else int(page), kind, head.get("WARC-Target-URI"), head["WARC-Date"], payload, length, digest, refers

    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target", pa.string()), ("date", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                some = []
                for row in rows(data.as_py()):
                    some.append(row)
                    if len(some) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)
                        some = []
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)

    return files.mapInArrow(run, "page_id long, record_type string, target string, date string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def archive_digest(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder, read them back, and return a row per record without its payload."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_pages(pages, path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
