"""Web archives: legacy ARC records converted to WARC, written, and read back.

An ARC record is a header line and as many bytes as it declares. The filedesc record at
the head of a file names the version: version 1 lines hold URL, IP, date, type, length;
version 2 lines hold URL, IP, date, type, result code, checksum, location, offset, file
name, length. Each record becomes a WARC record with a name-based record identifier, an
ISO timestamp, a type (by the URL's scheme: warcinfo for the filedesc record, resource for
dns and ftp, else response) and a SHA-1 payload digest of its own.

Archives are text files whose records end in two line ends, so Spark's own writers and
readers reach any store that Spark does. A file holds at most about `file_bytes` (one
record at least) and is read whole, record by declared length.

Defined cases: a null payload is empty; a null url is written as `-`; a record that
repeats an earlier one's payload is a revisit without payload that carries its digest and
length; broken tails (a declared length beyond the end) raise ValueError; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, scratch_path, slices

END = b"\r\n\r\n"
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "file", "length"),
}
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # for names that are URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, warc_type string, target_uri string, date string, content_type string, refers_to string, refers_to_page long, payload_digest string, payload_bytes long, page_id long, payload binary"


def arc_field(value: str) -> str:
    """A field of an ARC header line holds no white space and is not empty."""
    return re.sub(r"\s", "%20", value) or "-"


def arc_header(version: int, url: str, date: str, mime: str, length: int, code: int = 200, checksum: str = "-", offset: int = 0, file: str = "pages.arc", ip: str = "0.0.0.0") -> bytes:
    known = {"url": arc_field(url), "ip": ip, "date": date, "type": mime, "code": code, "checksum": checksum, "location": "-", "offset": offset, "file": file, "length": length}
    return " ".join(str(known[f]) for f in FIELDS[version]).encode() + b"\n"


def arc_filedesc(version: int, name: str, date: str) -> bytes:
    """The record at the head of an ARC file."""
    body = f"{version} 0 cellweave\n".encode() + {1: b"URL IP-address Archive-date Content-type Archive-length\n", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"}[version] + b"\n"
    return arc_header(version, f"filedesc://{name}", date, "text/plain", len(body)) + body


def parse_arc(data: bytes, version: int | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of the records of an ARC file; version: for data without a filedesc record."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line has no end")
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        declared = int(parts[-1])
        body = data[end + 1 : end + 1 + declared]
        if len(body) < declared:
            raise ValueError("an ARC record is shorter than it declares")
        if parts[0].startswith("filedesc://"):
            version = int(body.split(b" ", 1)[0])
            yield {"url": parts[0], "date": parts[2], "type": "application/warc-fields"}, body
        elif len(parts) != len(FIELDS[version or 1]):
            raise ValueError(f"an ARC version {version or 1} header line has {len(parts)} fields")
        else:
            yield dict(zip(FIELDS[version or 1], parts)), body
        at = end + 1 + declared


def warc_type(url: str) -> str:
    scheme = url.partition(":")[0].lower()
    return {"filedesc": "warcinfo", "dns": "resource", "ftp": "resource"}.get(scheme, "response")


def record_id(url: str, date: str, digest: str, page: str = "") -> str:
    """The identifier of a record, from its URL, ARC date, base-32 payload digest and page."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join((url, date, digest, page)))}>"


def warc_record(fields: dict[str, str], body: bytes, page: str = "", original: tuple[str, str] | None = None, kind: str | None = None) -> bytes:
    """A WARC record for an ARC record, without the line ends that close it.

    page: an identifier of the caller, kept in a header. original: (record identifier,
    page) of the record that a revisit refers to. kind: the type, if the scheme does not tell.
    """
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    date = datetime.strptime(fields["date"], "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    kind = "revisit" if original else kind or warc_type(fields["url"])
    lines = {"WARC-Type": kind, "WARC-Record-ID": record_id(fields["url"], fields["date"], digest, page), "WARC-Date": date}
    lines |= {"WARC-Filename": fields["url"].removeprefix("filedesc://")} if kind == "warcinfo" else {"WARC-Target-URI": fields["url"]}
    lines |= {"WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(len(body)), "Content-Type": fields["type"]}
    if page:
        lines["X-Page-ID"] = page
    if original:
        lines |= {"WARC-Profile": PROFILE, "WARC-Refers-To": original[0], "X-Refers-To-Page-ID": original[1]}
        body = b""
    lines["Content-Length"] = str(len(body))
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines.items()) + b"\r\n" + body


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, payload) of the records of a WARC file, by declared length."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            if data[at : at + 2] == b"\r\n":
                at += 2
                continue
            raise ValueError("a WARC record has no version line")
        end = data.find(END, at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        declared = int(headers["content-length"])
        payload = data[end + 4 : end + 4 + declared]
        if end < 0 or len(payload) < declared:
            raise ValueError("a WARC record is shorter than it declares")
        yield headers, payload
        at = end + 4 + declared


def unzipped(data: bytes) -> bytes:
    """Data as it is, or the members of a gzip file one after another."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        data = z.unused_data
    return b"".join(out)


def repeated_payloads(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(digest, first_page, first_url) of the payloads of at least least_bytes that several pages have."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.where(F.octet_length("html") >= least_bytes).select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("-")).alias("url"), F.sha1(payload).alias("digest"))
    most = rows.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return most.select("digest", F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url")).where("first_page is not null")


def write_archives(pages: DataFrame, path: str, date: str = "20240101000000", least_bytes: int = 1000, file_bytes: int = 64 << 20) -> None:
    """Each row of pages (page_id, url, html) as an ARC record, converted to a WARC record, in files under path.

    Even and odd pages take ARC versions 1 and 2. The repeated payloads are written to a
    table first: both sides of the join with the pages are then dealt anew, so that Spark
    can split a payload that very many pages have.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("-")).alias("url"), payload.alias("html"), F.when(F.octet_length("html") >= least_bytes, F.sha1(payload.cast("binary"))).alias("digest"))
    full = rows.join(saved(repeated_payloads(pages, least_bytes), "repeated"), "digest", "left").select("page_id", "url", "html", "first_page", "first_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        volume = filled = 0
        for b in slices(batches):
            out, volumes = [], []
            for page_id, url, html, first_page, first_url in zip(*(c.to_pylist() for c in b.columns)):
                body = html.encode("utf-8", "surrogatepass")
                version = 1 + (page_id or 0) % 2
                arc = arc_header(version, url, date, "text/html", len(body)) + body
                for fields, got in parse_arc(arc, version):
                    original = None
                    if first_page is not None and first_page != page_id:
                        digest = base64.b32encode(hashlib.sha1(got).digest()).decode()
                        original = record_id(arc_field(first_url), date, digest, str(first_page)), str(first_page)
                    record = warc_record(fields, got, "-" if page_id is None else str(page_id), original, "response")
                    if filled and filled + len(record) > file_bytes:
                        volume, filled = volume + 1, 0
                    filled += len(record)
                    out.append(record.decode("utf-8", "surrogatepass"))
                    volumes.append(volume)
            yield pa.record_batch([pa.array(out, pa.string()), pa.array(volumes, pa.int32())], names=["value", "volume"])

    files = full.mapInArrow(run, "value string, volume int").write.partitionBy("volume")
    files.option("lineSep", END.decode()).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of WARC and ARC files, plain or gzip, under path; ARC records are converted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in RECORD.split(", "))])
        for b in batches:
            for data in b.column(0):
                data = unzipped(data.as_py())
                records = parse_warc(data) if data[:5] == b"WARC/" else (next(parse_warc(warc_record(f, body))) for f, body in parse_arc(data))
                rows, size = [], 0
                for h, body in records:
                    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex() if "warc-payload-digest" in h else None
                    if body and digest != hashlib.sha1(body).hexdigest():
                        raise ValueError(f"the payload of {h.get('warc-record-id')} does not match its digest")
                    page = h.get("x-page-id", "-")
                    rows.append(dict(record_id=h.get("warc-record-id"), warc_type=h.get("warc-type"), target_uri=h.get("warc-target-uri"), date=h.get("warc-date"), content_type=h.get("content-type"), refers_to=h.get("warc-refers-to"), refers_to_page=int(h["x-refers-to-page-id"]) if "x-refers-to-page-id" in h else None, payload_digest=digest, payload_bytes=int(h.get("x-payload-length", len(body))), page_id=None if page == "-" else int(page), payload=body if payloads else None))
                    size += len(body)
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("content").mapInArrow(run, RECORD)


def archived_pages(pages: DataFrame) -> DataFrame:
    """pages written to archives in the shared folder and read back: a row per page."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    back = read_archives(pages.sparkSession, path, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.col("refers_to_page").alias("refers_to"), "record_id", F.col("refers_to").alias("refers_to_id"), "target_uri")
