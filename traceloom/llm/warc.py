"""Legacy ARC archives as WARC.

An ARC file opens with a version block whose lines say which fields its record
headers have: version 1 has five, version 2 ten, and the last is the length of
the block that follows. Records are read by these lengths, never by looking for
the next header. For each an equivalent WARC record is made: identifier (a name
UUID of address, time and digest), time, type and digests. Records with the same
payload as an earlier one can be revisits without it.

WARC files are written by Spark's text writer with the record end as its line
separator, so commits, retries and remote stores are Spark's, and are read again
by their declared lengths. Rows are dealt to as many tasks as keep a task's file at
about FILE_BYTES, so that files are bounded by bytes, however long pages are.

Defined results: a null payload is empty, with the digest of no bytes; a null
address becomes a urn; rows that repeat get a record each, of its own identifier,
and all that carry the group's smallest id are responses, of which revisits refer
to one; an empty table gives no record; further columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm.shared import cut, map_arrow, scratch_path

#: Field names of a record header by ARC version (fixed values).
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
RECORD_END = "\r\n\r\n"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # URLs, RFC 4122
#: Bytes of payloads that a file holds about.
FILE_BYTES = 32 << 20
#: Payloads under this many bytes are stored again rather than referred to.
LEAST_REVISIT = 100
UNSAFE = re.compile(r"[\x00-\x20\x7f\x85\xa0  ]")


class ArchiveError(ValueError):
    """An archive whose headers or lengths do not hold."""


@dataclass
class ArcRecord:
    """One record of an ARC file: header fields by name, and the block."""

    fields: dict[str, str]
    block: bytes
    version: int


def safe_url(url: str | None, fallback: str) -> str:
    """The address without white space or controls, which would part header fields."""
    if not url:
        return fallback
    return UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def arc_version_block(name: str, date: str, version: int) -> bytes:
    body = f"{version} 0 traceloom\n{' '.join(FIELDS[version])}\n\n".encode()
    rest = {1: "text/plain", 2: "text/plain 200 - - 0 " + name}[version]
    return f"filedesc://{name} 0.0.0.0 {date} {rest} {len(body)}\n".encode() + body + b"\n"


def arc_record(url: str, date: str, mime: str, block: bytes, version: int, name: str = "-") -> bytes:
    rest = {1: mime, 2: f"{mime} 200 {hashlib.md5(block).hexdigest()} - 0 {name}"}[version]
    return f"{url} 0.0.0.0 {date} {rest} {len(block)}\n".encode() + block + b"\n"


def read_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """Records of an ARC stream, its version block first; only one block is held at a time."""
    version: int | None = None
    while True:
        line = stream.readline()
        while line in (b"\n", b"\r\n"):
            line = stream.readline()
        if not line:
            return
        parts = line.rstrip(b"\r\n").decode("utf-8", "surrogateescape").split(" ")
        if version is None:
            if not parts[0].startswith("filedesc:"):
                raise ArchiveError("no version block")
            fields = FIELDS[1 if len(parts) == 5 else 2]
        else:
            fields = FIELDS[version]
        if len(parts) < len(fields) or not parts[-1].isdigit():
            raise ArchiveError(f"bad record header: {line[:200]!r}")
        # Old crawlers left spaces in addresses and types: the outer fields are fixed.
        if len(parts) > len(fields):
            tail = len(fields) - 1
            parts = [" ".join(parts[: len(parts) - tail]), *parts[len(parts) - tail :]]
        length = int(parts[-1])
        block = stream.read(length)
        if len(block) < length:
            raise ArchiveError(f"{length} bytes declared, {len(block)} there")
        if version is None:
            first = block.split(b"\n", 1)[0].split(b" ")
            if first[0] not in (b"1", b"2"):
                raise ArchiveError(f"unknown version {first[0]!r}")
            version = int(first[0])
        yield ArcRecord(dict(zip(fields, parts)), block, version)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head, with its blank line, and payload; the whole block is payload if there is no head."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(i, n) for sep in (b"\r\n\r\n", b"\n\n") if (i := block.find(sep)) >= 0 for n in (len(sep),)]
    if not ends:
        return block, b""
    at, n = min(ends)
    return block[: at + n], block[at + n :]


def warc_date(arc_date: str) -> str:
    d = re.sub(r"\D", "", arc_date).ljust(14, "0")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


@dataclass
class WarcRecord:
    """Headers in order, and the block."""

    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def to_bytes(self) -> bytes:
        """The record without its end, which the writer adds."""
        head = "".join(f"{k}: {v}\r\n" for k, v in self.headers)
        return f"WARC/1.1\r\n{head}\r\n".encode("utf-8", "surrogateescape") + self.block


def record_id(url: str, date: str, digest: str, salt: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{url} {date} {digest} {salt}')}>"


def convert(record: ArcRecord, salt: str = "", revisit_of: str | None = None, extra: Iterable[tuple[str, str]] = ()) -> WarcRecord:
    """The WARC record of an ARC record.

    The version block becomes a warcinfo record, an HTTP answer a response and
    all else a resource. revisit_of makes an HTTP answer a revisit of the record
    with that identifier: its payload is left out, its digest kept.
    """
    f = record.fields
    head, payload = split_http(record.block)
    digest, date = hashlib.sha256(payload).hexdigest(), warc_date(f["Archive-date"])
    kind = "warcinfo" if f["URL"].startswith("filedesc:") else "response" if head else "resource"
    mime = {"warcinfo": "application/warc-fields", "response": "application/http; msgtype=response"}.get(kind, f["Content-type"])
    block = record.block
    if kind == "warcinfo":
        block = f"format: WARC File Format 1.1\r\nconvertedFrom: ARC/{record.version}\r\nfilename: {f['URL'][11:]}\r\n".encode()
    more: list[tuple[str, str]] = []
    if kind == "response" and revisit_of:
        kind, block = "revisit", head
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", revisit_of)]
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(f["URL"], date, digest, salt)), ("WARC-Date", date)]
    if kind != "warcinfo":
        headers += [("WARC-Target-URI", f["URL"]), ("WARC-IP-Address", f["IP-address"]), ("WARC-Payload-Digest", f"sha256:{digest}")]
    headers += [*more, *extra, ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("Content-Type", mime), ("Content-Length", str(len(block)))]
    return WarcRecord(headers, block)


def read_warc(stream: BinaryIO) -> Iterator[WarcRecord]:
    """Records of a WARC stream by their declared lengths; only one block is held at a time."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ArchiveError(f"no record here: {line[:80]!r}")
        headers: list[tuple[str, str]] = []
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers.append((name, value.strip(" \r\n\t")))
        record = WarcRecord(headers, b"")
        length = int(record.get("Content-Length") or -1)
        if length < 0:
            raise ArchiveError("a record without a length")
        record.block = stream.read(length)
        if len(record.block) < length:
            raise ArchiveError(f"{length} bytes declared, {len(record.block)} there")
        yield record


def arc_to_warc(stream: BinaryIO, salt: str = "") -> Iterator[WarcRecord]:
    """Convert a whole ARC stream; records are told apart by their place."""
    for k, record in enumerate(read_arc(stream)):
        yield convert(record, f"{salt}{k}")


def payloads(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = LEAST_REVISIT) -> tuple[DataFrame, int]:
    """(id, digest, n, holder) of each payload of each id, and the bytes of all rows.

    n counts its rows; holder is the smallest id with a payload of `least` bytes or
    more that several ids have. No payload is shuffled.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.octet_length(payload).cast("bigint").alias("bytes"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    each = cut(spark, rows.groupBy("id", "digest").agg(F.count("*").alias("n"), F.first("bytes").alias("bytes")), "payloads")
    held = each.where((F.col("bytes") >= least) & F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("holder"), F.count("*").alias("ids"))
    total = each.agg(F.sum(F.col("n") * F.col("bytes"))).first()[0] or 0
    return each.drop("bytes").join(held.where("ids > 1").drop("ids"), "digest", "left"), total


def write_archive(
    spark: SparkSession, pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    date: str = "20240101000000", records_per_file: int = 20_000,
) -> None:
    """Store pages as ARC records, convert these, and write the WARC files to path.

    Rows of odd and even tasks take the two ARC versions. A row whose payload an
    earlier id holds becomes a revisit of that id's record. Rows of one id and
    payload meet in one task, which names the first of them as that record.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    held, total = payloads(spark, pages, id_col, html_col)
    rows = rows.repartition(1 + total // FILE_BYTES, "id", "digest").join(held, ["id", "digest"], "left").select("id", "url", "html", "holder", "n", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        task = context.partitionId() if context else 0
        version, name, opened, k = 1 + task % 2, f"part-{task:05d}.arc", False, -1
        named: set = set()
        for batch in batches:
            out: list[bytes] = []
            for i, url, html, holder, n, digest in zip(*(c.to_pylist() for c in batch.columns)):
                k += 1
                body = html.encode("utf-8", "surrogatepass")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                arc = arc_version_block(name, date, version) + arc_record(safe_url(url, f"urn:page:{i}"), date, "text/html", head + body, version, name)
                info, record = read_arc(io.BytesIO(arc))
                if not opened:
                    out.append(convert(info, name).to_bytes())
                    opened = True
                refers = holder is not None and i is not None and i != holder
                extra = [] if i is None else [("X-Source-ID", str(i))]
                extra += [("X-Payload-Length", str(len(body)))] + ([("X-Refers-To-Source-ID", str(holder))] if refers else [])
                target = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'source {holder} {digest}')}>" if refers else None
                made = convert(record, f"{name} {k}", target, extra)
                if i is not None and not refers and (i, digest) not in named:
                    if n > 1:
                        named.add((i, digest))
                    made.headers = [(h, f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'source {i} {digest}')}>" if h == "WARC-Record-ID" else v) for h, v in made.headers]
                out.append(made.to_bytes())
                if len(out) >= 64:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    written = map_arrow(rows, run, "value binary").select(F.col("value").cast("string").alias("value"))
    written.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def read_archive(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of every page record under path.

    A response's length and digest are those of the payload read; a digest that
    differs from the declared one is an error. A revisit's are the declared ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out: tuple[list, list, list, list, list] = ([], [], [], [], [])
                raw = content.as_py()
                stream = gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
                for r in read_warc(stream):
                    kind = r.get("WARC-Type")
                    if kind not in ("response", "revisit"):
                        continue
                    declared = (r.get("WARC-Payload-Digest") or "").partition(":")[2]
                    size = int(r.get("X-Payload-Length") or 0)
                    if kind == "response":
                        payload = split_http(r.block)[1]
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if declared and digest != declared:
                            raise ArchiveError(f"{r.get('WARC-Record-ID')}: its payload is not the declared one")
                        declared = digest
                    for c, v in zip(out, (r.get("X-Source-ID"), size, declared, kind, r.get("X-Refers-To-Source-ID"))):
                        c.append(v)
                types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, types)], names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                )

    files = spark.read.format("binaryFile").load(path).select("content")
    found = map_arrow(files, run, "id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("id", "refers_to")})


def archive_round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Write pages to WARC files in the shared folder and read them again."""
    path = scratch_path(spark, "warc")
    write_archive(spark, pages, path, id_col)
    return read_archive(spark, path, dict(pages.dtypes)[id_col])
