"""WARC archives: a writer of one gzip member per record and a salvaging reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtrail.llm.common import new_folder, slices

#: Payloads below this many bytes are always stored in full.
REVISIT_BYTES = 100
#: An empty gzip member; the text writer puts one after each record.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER_START = re.compile(rb"\x1f\x8b\x08")
ANY_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ENTRY = pa.schema(
    [
        ("archive", pa.string()),
        ("kind", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("reason", pa.string()),
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("target_uri", pa.string()),
        ("refers_to", pa.string()),
        ("declared_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)


def _line(value: str | None) -> str:
    """A header value: control characters are percent-encoded, so a value stays one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def record_id(page_id) -> str:
    return "" if page_id is None else f"<urn:page:{page_id}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One response or revisit record; a revisit keeps the HTTP header, not the payload."""
    revisit = refers_to is not None
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def mark_revisits(pages: DataFrame) -> DataFrame:
    """Columns page_id, url, html, digest, refers_to of ``pages``.

    Only digests that occur more than once take part in the join, and Spark splits a
    digest that holds much of the table. Of equal payloads the rows with the smallest
    page_id (all of them, if repeated) are responses. A null page_id never is a target:
    such a row revisits its group's smallest id, or is a response if there is none.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html")).select(
        "*", F.sha2(F.col("html"), 256).alias("digest")
    )
    firsts = (
        rows.filter(F.octet_length("html") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & F.col("first").isNotNull())
        .select("digest", "first")
    )
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))
    return rows.join(firsts, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(F.col("first").isNotNull() & other, F.col("first")).alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str | None = None, *, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write one WARC record per row of ``pages`` (page_id, url, html) and return the folder.

    Every record is a gzip member of its own; each task's output is one archive. The
    files are written by Spark, so failed tasks leave nothing behind. Null html is an empty
    payload, null url an empty target; other columns are ignored; no rows give no records.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            out = [
                gzip.compress(record(page, url, html.encode(), digest, first, date), 4, mtime=0)
                for page, url, html, digest, first in rows
            ]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    marked = mark_revisits(pages)
    # The writer takes strings but writes their bytes as they are.
    (
        marked.mapInArrow(members, "member binary")
        .select(F.col("member").cast("string").alias("value"))
        .write.option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .text(folder)
    )
    return folder


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    if not VERSION_LINE.match(data, at):
        return None
    # A header may have any length, but a version line before its end is the next record's:
    # this header was cut off.
    following = VERSION_LINE.search(data, at + 1)
    end = data.find(b"\r\n\r\n", at, following.start() if following else len(data))
    if end < 0:
        return None
    found: dict[str, str] = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        key = name.strip().lower().decode("latin-1")
        if not colon or key in found and key in ("warc-type", "warc-record-id", "content-length"):
            return None
        found[key] = value.strip().decode("utf-8", "replace")
    return found, end + 4


def _digest_matches(declared: str | None, data: bytes) -> bool:
    algorithm, _, value = (declared or "").partition(":")
    algorithm = algorithm.lower().replace("-", "")
    if not value or algorithm not in ("sha256", "sha1", "md5"):
        return True
    made = hashlib.new(algorithm, data)
    return value.lower() == made.hexdigest() or value.upper().rstrip("=") == base64.b32encode(made.digest()).decode().rstrip("=")


def parse_record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record at ``at``, where it ends, and what is wrong with it.

    The end is ``at`` itself if the framing cannot be trusted.
    """
    head = _headers(data, at)
    if head is None:
        return None, at, "header"
    fields, start = head
    size = fields.get("content-length", "")
    if not size.isdigit() or "warc-type" not in fields:
        return None, at, "header"
    end = start + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "length"
    block = data[start:end]
    if not _digest_matches(fields.get("warc-block-digest"), block):
        return None, end + 4, "block digest"
    http, payload, length = b"", block, None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        found = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
        length = int(found[1]) if found else None
    revisit = fields["warc-type"] == "revisit"
    if not revisit and not _digest_matches(fields.get("warc-payload-digest"), payload):
        return None, end + 4, "payload digest"
    return (
        {
            "record_id": fields.get("warc-record-id"),
            "record_type": fields["warc-type"],
            "target_uri": fields.get("warc-target-uri"),
            "refers_to": fields.get("warc-refers-to"),
            "declared_digest": fields.get("warc-payload-digest"),
            "payload_bytes": length if revisit else len(payload),
            "payload_digest": None if revisit else hashlib.sha256(payload).hexdigest(),
            "payload": None if revisit else payload,
        },
        end + 4,
        "",
    )


def _member(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at ``at`` and its end; None if it is damaged."""
    inflate = zlib.decompressobj(31)
    out, step, place = [], 1 << 16, at
    try:
        while not inflate.eof:
            if place >= len(data):
                return None
            out.append(inflate.decompress(data[place : place + step]))
            place += step
    except zlib.error:
        return None
    return b"".join(out), min(place, len(data)) - len(inflate.unused_data)


def _unit(data: bytes, at: int) -> tuple[list[dict], int, str]:
    """Entries of the member or record at ``at`` and its end; ``at`` itself if none is valid there."""
    if MEMBER_START.match(data, at):
        member = _member(data, at)
        if member is None:
            return [], at, "member"
        content, end = member
        if content and not VERSION_LINE.match(content):
            return [], at, "member content"
        return [x | {"offset": at, "length": end - at} for x in salvage(content)], end, ""
    if VERSION_LINE.match(data, at):
        found, end, reason = parse_record(data, at)
        entry = found | {"kind": "record"} if found else {"kind": "gap", "reason": reason}
        return [entry | {"offset": at, "length": end - at}] if end > at else [], end, reason
    return [], at, "no record"


def salvage(data: bytes) -> Iterator[dict]:
    """Every good record of an archive, in order, and every gap between them.

    Reads gzip members and plain records, also mixed. After a failed check the bytes up to
    the next place where a member inflates and starts with a record, or where a version
    line starts a soundly framed record, are one gap with the first failure's reason. A
    record with sound framing but a wrong digest is a gap of its own, as is a damaged
    record inside a sound member. Empty members and line ends between records are no gaps.
    """
    at, gap, why = 0, None, ""
    while at < len(data):
        entries, end, reason = _unit(data, at)
        if end > at:
            if gap is not None:
                yield {"kind": "gap", "offset": gap, "length": at - gap, "reason": why}
                gap = None
            yield from entries
            at = end
            continue
        if gap is None:
            if data[at : at + 2] == b"\r\n":
                at += 2
                continue
            gap, why = at, reason
        following = ANY_START.search(data, at + 1)
        at = following.start() if following else len(data)
    if gap is not None:
        yield {"kind": "gap", "offset": gap, "length": len(data) - gap, "reason": why}


def read_archives(spark: SparkSession, folder: str, *, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives below ``folder``, one row each (columns of ``ENTRY``).

    An archive is read whole by one task, so its size is the memory bound; archives are at
    most a gigabyte by convention. Rows of kind ``gap`` log quarantined bytes: offset,
    length and reason. Offsets count bytes of the file; records of one member share them. An
    empty or unreadable archive gives no record and one gap over its bytes, if it has any.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            name, data = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            found, held = [], 0
            for entry in salvage(data):
                if not payloads:
                    entry.pop("payload", None)
                found.append(entry | {"archive": name})
                held += len(entry.get("payload") or b"") + len(entry.get("target_uri") or "") + 500
                if held > 4_000_000:
                    yield pa.RecordBatch.from_pylist(found, ENTRY)
                    found, held = [], 0
            if found:
                yield pa.RecordBatch.from_pylist(found, ENTRY)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    schema = ", ".join(
        f"{f.name} {'binary' if f.type == pa.binary() else 'long' if f.type == pa.int64() else 'string'}" for f in ENTRY
    )
    return files.select("path", "content").mapInArrow(entries, schema)


def page_digests(entries: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of archived pages.

    A revisit's figures are those of the response that it names, as read; if that record
    was lost, the revisit's own header fields stand in.
    """
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    rows = entries.filter("kind = 'record'").select(
        page(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        F.coalesce("payload_digest", F.regexp_extract("declared_digest", "^sha256:(.*)$", 1)).alias("payload_digest"),
        "record_type",
        page(F.col("refers_to")).alias("refers_to"),
    )
    targets = (
        rows.filter("record_type = 'response' and page_id is not null")
        .groupBy(F.col("page_id").alias("refers_to"))
        .agg(F.min(F.struct("payload_bytes", "payload_digest")).alias("target"))
    )
    revisits = (
        rows.filter("record_type = 'revisit'")
        .join(targets, "refers_to", "left")
        .select(
            "page_id",
            F.coalesce("target.payload_bytes", "payload_bytes").alias("payload_bytes"),
            F.coalesce("target.payload_digest", "payload_digest").alias("payload_digest"),
            "record_type",
            "refers_to",
        )
    )
    return rows.filter("record_type <> 'revisit'").unionByName(revisits)
