"""Legacy ARC archives converted to WARC.

:func:`read_arc` reads version 1 and version 2 archives: the version block
says which fields a header line has, and the declared length says where the
next header begins. :func:`convert` gives each record what WARC asks for and
ARC lacks: an identifier, a date in ISO form, a type and digests of block and
payload. :func:`mark_revisits` turns equal payloads into revisits of one
record. :func:`write_warc` writes archives of gzip members, one a record, and
:func:`read_warc` reads such archives back.

Archives pass through Spark's own readers and writers (``binaryFile``, and
``text`` with raw bytes as lines), so they may lie wherever Spark reaches. Each
is bounded by ``ARCHIVE_BYTES``, or holds one larger record.

Defined results: a null payload is empty; a null url becomes ``urn:unknown``;
a null key is kept as none and is the last among equals; what is no header line
or is cut short gives a row of the kind ``error``, not a failure; of equal rows with
equal payloads one is the response; an empty table gives an empty result;
further columns are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import small, work_path, written

ARCHIVE_BYTES = 8 << 20
#: Payloads below this length are never revisits.
LEAST_SHARED = 100
BROADCAST_ROWS = 200_000

#: The fields of a header line by version of the archive, as its version block names them.
FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result", "checksum", "location", "offset", "filename", "length"),
}
HEADINGS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_GAP = re.compile(rb"\r?\n\r?\n")
#: What Spark's writers put into file names at random.
_RANDOM = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
#: Fixed value: an empty gzip member, which ends each archive.
END = gzip.compress(b"", 1, mtime=0)


@dataclass
class ArcRecord:
    """``error`` says why a stretch of an archive could not be read."""

    version: int
    fields: dict[str, str]
    block: bytes
    offset: int
    error: str = ""


def unzipped(content: bytes) -> bytes:
    """The bytes of any number of gzip members, or ``content`` if it is none."""
    if content[:2] != b"\x1f\x8b":
        return content
    return b"".join(members(content))


def members(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members in order. Input is fed in steps, so that what follows
    a member is not copied over and over."""
    view, at = memoryview(content), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut short")
            part = view[at : at + step]
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        yield b"".join(out)


def _header(line: bytes, version: int) -> dict[str, str] | None:
    """The fields of a header line, or None if it is none. Urls may hold
    spaces: the other fields are counted from the end of the line."""
    names = FIELDS[version]
    values = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
    return dict(zip(names, values)) if len(values) == len(names) and values[-1].isdigit() and values[2].isdigit() else None


def parse_arc(content: bytes) -> Iterator[ArcRecord]:
    """The records of an archive after its version block; an archive that
    cannot be read throughout is a ValueError."""
    for record in read_arc(content):
        if record.error:
            raise ValueError(f"{record.error} at {record.offset}")
        yield record


def read_arc(content: bytes) -> Iterator[ArcRecord]:
    """The records of an archive after its version block. What cannot be read
    gives one record with an error, and reading goes on at the next line that
    is a header; an archive without a version block gives its error alone."""
    try:
        data = unzipped(content)
    except (ValueError, zlib.error) as e:
        yield ArcRecord(0, {}, b"", 0, f"not readable: {e}")
        return
    end = data.find(b"\n")
    opening = data[: end if end >= 0 else len(data)].rstrip(b"\r")
    length = opening.rsplit(b" ", 1)[-1]
    block = data[end + 1 : end + 1 + int(length)] if end >= 0 and length.isdigit() else b""
    number = block.split(b" ", 1)[0]
    if not opening.startswith(b"filedesc:") or not number.isdigit() or int(number) not in FIELDS:
        yield ArcRecord(0, {}, b"", 0, "no version block that is known")
        return
    version, at, lost = int(number), end + 1 + int(length), False
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].rstrip(b"\r")
        fields = _header(line, version) if line else None
        if fields:
            block = data[end + 1 : end + 1 + int(fields["length"])]
            short = len(block) < int(fields["length"])
            yield ArcRecord(version, fields, block, at, "shorter than declared" if short else "")
            at, lost = end + 1 + int(fields["length"]), False
        else:
            if line and not lost:
                lost = True
                yield ArcRecord(version, {}, b"", at, "no header line")
            at = end + 1


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its empty line) and payload of an HTTP response; no head if
    there is none. The first empty line ends the head, however lines end."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    gap = _GAP.search(block)
    return (block[: gap.end()], block[gap.end() :]) if gap else (block, b"")


def iso_date(arc_date: str) -> str:
    """``20240102030405`` as ``2024-01-02T03:04:05Z``; missing digits are those
    of the earliest moment."""
    d = re.sub(r"\D", "", arc_date)
    d += "00000101000000"[len(d) :] if len(d) < 14 else ""
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def header_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)\r?$", head)
    return m[1].decode("utf-8", "replace") if m else None


def page_key(head: bytes) -> str | None:
    """The page key that a head carries, as text; None if it is no integer."""
    found = header_field(head, "X-Page-Id")
    return found if found and re.fullmatch(r"-?\d{1,18}|-?[1-8]\d{18}|9[01]\d{17}|922\d{16}", found) else None


#: Keys pass as text: pandas would turn numbers beside nulls into floats.
RECORD = "record_id string, url string, warc_date string, kind string, mime string, page_id string, payload_bytes long, payload_digest string, block_digest string"


def convert(arcs: DataFrame, with_block: bool = True) -> DataFrame:
    """WARC records of ARC archives (``archive``, ``content``): HTTP captures
    are responses, all else resources; ``head`` and ``payload`` if asked for.
    What could not be read is a row of the kind ``error`` with its place and
    reason as ``url`` and ``mime``.

    The identifier is a name-based UUID of archive (without what Spark's writer
    adds at random), offset, url, date and payload, so every run gives the same one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in RECORD.split(", ")] + (["head", "payload"] if with_block else [])
        for batch in batches:
            for archive, content in zip(batch["archive"], batch["content"]):
                rows, held, stable = [], 0, _RANDOM.sub("", archive or "")
                for r in read_arc(content or b""):
                    f = r.fields
                    if r.error:
                        rows.append((f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{stable} {r.offset}')}>", f"{stable}@{r.offset}", None, "error", r.error, None, 0, None, None) + ((b"", b"") if with_block else ()))
                        continue
                    head, payload = split_http(r.block)
                    digest = hashlib.sha256(payload).hexdigest()
                    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{stable} {r.offset} {f['url']} {f['date']} {digest}")
                    block = base64.b32encode(hashlib.sha1(r.block).digest()).decode() if with_block else None
                    row = (f"<urn:uuid:{name}>", f["url"], iso_date(f["date"]), "response" if head else "resource", f["content_type"], page_key(head), len(payload), digest, block)
                    rows.append(row + ((head, payload) if with_block else ()))
                    held += len(r.block)
                    if with_block and held > ARCHIVE_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    return arcs.mapInPandas(run, RECORD + (", head binary, payload binary" if with_block else "")).withColumn("page_id", F.col("page_id").cast("long"))


def mark_revisits(records: DataFrame) -> DataFrame:
    """``record_id`` of each revisit with the ``url``, date and identifier of
    the response that it repeats: the record of the smallest page key among
    those of equal digest and at least ``LEAST_SHARED`` bytes."""
    shared = records.filter(F.col("payload_bytes") >= LEAST_SHARED)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "url", "warc_date")
    first = shared.groupBy("payload_digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = first.select(F.col("payload_digest").alias("_digest"), "first")
    joined = shared.select("record_id", "payload_digest").join(first, F.col("payload_digest") == F.col("_digest"))
    return joined.filter(F.col("record_id") != F.col("first.record_id")).select(
        F.col("record_id").alias("_again"), F.col("first.record_id").alias("to_id"), F.col("first.url").alias("to_url"), F.col("first.warc_date").alias("to_date")
    )


def _warc_record(r) -> bytes:
    """A whole record; a revisit keeps the HTTP head alone."""
    revisit = isinstance(r.to_id, str)
    block = r.head if revisit else r.head + r.payload
    kind = "application/http; msgtype=response" if r.kind == "response" else r.mime
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else r.kind}", f"WARC-Record-ID: {r.record_id}", f"WARC-Date: {r.warc_date}",
        f"WARC-Target-URI: {r.url}", f"WARC-Payload-Digest: sha256:{r.payload_digest}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {r.to_id}", f"WARC-Refers-To-Target-URI: {r.to_url}", f"WARC-Refers-To-Date: {r.to_date}",
            f"X-Payload-Length: {r.payload_bytes}",
        ]
    else:
        lines.append(f"WARC-Block-Digest: sha1:{r.block_digest}")
    lines += [f"Content-Type: {kind}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(records: DataFrame, path: str) -> None:
    """Writes records with ``head``, ``payload``, ``to_id``, ``to_url`` and
    ``to_date`` as archives below ``path``; rows of errors are no records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                record = _warc_record(r)
                if out and held + len(record) > ARCHIVE_BYTES:
                    yield pd.DataFrame({"content": [b"".join(out)]})
                    out, held = [], 0
                out.append(gzip.compress(record, 1, mtime=0))
                held += len(record)
        if out:
            yield pd.DataFrame({"content": [b"".join(out)]})

    write_archives(records.filter("kind <> 'error'").mapInPandas(run, "content binary"), path)


def write_archives(archives: DataFrame, path: str) -> None:
    """One file for each row's ``content``. The text writer ends a line by
    ``lineSep``, here the bytes of an empty gzip member."""
    lines = archives.select(F.col("content").cast("string").alias("value"))
    lines.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", END.decode("latin-1")).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``archive``, ``content`` of the files below ``path``."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


WARC_ROW = "record_id string, record_type string, url string, warc_date string, payload_digest string, payload_bytes long, page_id string, to_id string"


def parse_warc(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of one WARC record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below ``path``; a response's payload is
    measured anew and held against its digest, a revisit's length is the one
    that the converter put down (or, from elsewhere, that in its HTTP head)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in WARC_ROW.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for member in members(content):
                    if not member:
                        continue
                    f, block = parse_warc(member)
                    head, payload = split_http(block)
                    revisit = f["warc-type"] == "revisit"
                    digest = f["warc-payload-digest"].partition(":")[2]
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{f['warc-record-id']}: the payload does not have its digest")
                    declared = f.get("x-payload-length") or header_field(head, "Content-Length") or ""
                    n = (int(declared) if declared.isdigit() else 0) if revisit else len(payload)
                    rows.append((f["warc-record-id"], f["warc-type"], f["warc-target-uri"], f["warc-date"], digest, n, page_key(head), f.get("warc-refers-to")))
                yield pd.DataFrame(rows, columns=names)

    return read_archives(spark, path).mapInPandas(run, WARC_ROW).withColumn("page_id", F.col("page_id").cast("long"))


def pages_to_arc(pages: DataFrame, captured: str = "20240102030405", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``content`` of legacy archives that hold ``pages`` (``page_id``, ``url``,
    ``html``) as HTTP captures; by turns of version 1 and 2, gzip members."""

    def head_of(page_id: str | None, payload: bytes) -> bytes:
        own = f"X-Page-Id: {page_id}\r\n" if page_id else ""
        return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode()

    def opening(version: int) -> bytes:
        block = f"{version} 0 axisframe\n{HEADINGS[version]}\n\n".encode()
        middle = "" if version == 1 else "200 - - 0 pages.arc "
        return f"filedesc://pages.arc 0.0.0.0 {captured} text/plain {middle}{len(block)}\n".encode() + block

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        version, out, held = 1, [], 0
        for batch in batches:
            for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"]):
                payload = (html or "").encode("utf-8", "surrogatepass")
                block = head_of(page_id, payload) + payload
                clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:unknown"
                middle = "" if version == 1 else f"200 {zlib.crc32(payload):08x} - {held} pages.arc "
                record = f"{clean} 0.0.0.0 {captured} text/html {middle}{len(block)}\n".encode("utf-8", "replace") + block + b"\n"
                if out and held + len(record) > archive_bytes:
                    yield pd.DataFrame({"content": [b"".join(out)]})
                    version, out, held = 3 - version, [], 0
                    record = f"{clean} 0.0.0.0 {captured} text/html {'' if version == 1 else f'200 {zlib.crc32(payload):08x} - 0 pages.arc '}{len(block)}\n".encode("utf-8", "replace") + block + b"\n"
                if not out:
                    out.append(gzip.compress(opening(version), 1, mtime=0))
                out.append(gzip.compress(record, 1, mtime=0))
                held += len(record)
        if out:
            yield pd.DataFrame({"content": [b"".join(out)]})

    return pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(run, "content binary")


def report(pages: DataFrame) -> DataFrame:
    """A row per page, read back from WARC archives that were converted from
    legacy archives of ``pages``."""
    spark = pages.sparkSession
    legacy, modern = work_path(spark, "arc"), work_path(spark, "warc")
    write_archives(pages_to_arc(pages), legacy)
    arcs = read_archives(spark, legacy)
    known = written(convert(arcs, with_block=False), "arc-records")
    again = small(written(mark_revisits(known), "revisits"), BROADCAST_ROWS)
    write_warc(convert(arcs).join(again, F.col("record_id") == F.col("_again"), "left").drop("_again"), modern)
    back = written(read_warc(spark, modern), "warc-records")
    targets = back.filter("record_type = 'revisit'").select(F.col("to_id").alias("_to")).distinct()
    named = back.join(small(targets, BROADCAST_ROWS), F.col("record_id") == F.col("_to")).select("_to", F.col("page_id").alias("refers_to"))
    out = back.join(small(named, BROADCAST_ROWS), F.col("to_id") == F.col("_to"), "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
