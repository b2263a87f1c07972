"""WARC archives: pages written as records with revisits for equal payloads, and a reader that salvages what is sound.

Writing. Payloads are grouped by SHA-256; the counting shuffle carries digests and ids only, and just payloads that occur
more than once come back, as a small table that is joined to the pages, so pages move only if that table is large. The
page with the smallest id of a group becomes a ``response``, the others become ``revisit`` records that name it. Every
record is a gzip member of its own, made where its page is read, and Spark's text writer puts the members into files of
about ``ARCHIVE_BYTES`` of payload. What separates lines there is an empty gzip member, so every file is a sequence of
complete members and can be read by any tool for compressed WARC.

Reading. A task reads whole archives, one at a time, as gzip members or plain records, mixed as they come. Checked are
the checksum of a member, the version line, the headers, whether a record ends where its length says, and its block
and payload digests. After a failed check the reader looks for the next gzip member or version line that passes, goes
on from there, and reports the bytes between as a quarantined gap. Members of several records are salvaged inside.

Defined results: NULL as ``html`` is an empty payload, NULL as ``url`` is no target. A NULL ``page_id`` is larger than any
other; where all ids of a group are NULL, or equal to the smallest, each of these rows is a response. Ids of records
follow page ids and are unique if those are. Extra columns are ignored. No pages give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mrkit.session import Generations, checkpoint, shared_folder

# Bytes of payload that an archive should have, and that a task sends on at once.
ARCHIVE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20

# Records at once as Python objects.
ROWS_AT_ONCE = 256

# Bytes that the headers of a record may take, and that are decompressed first.
HEADER_BYTES = 1 << 20
FIRST_READ = 1 << 12

# Pages do not say when they were fetched.
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the formats.
VERSION = b"WARC/1.1\r\n"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
END_OF_RECORD = END_OF_HEADERS = b"\r\n\r\n"
MEMBER = b"\x1f\x8b\x08"
HTTP = "application/http; msgtype=response"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_WINDOW = 31

PAGE = re.compile(r"<urn:page:(-?\d+)>")

READ = (
    "archive string, start long, length long, problem string, record_type string, record_id string, refers_to string, "
    "target string, payload_bytes long, payload_digest string, payload binary"
)


class Damaged(Exception):
    """What stands at a place is no sound record or member."""


class Found(NamedTuple):
    """A record, or a gap if there is a problem, in ``[start, end)``."""

    start: int
    end: int
    problem: str | None = None
    headers: dict[str, str] | None = None
    block: bytes = b""


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    """A gzip member without a time, so that a task that runs again writes the same bytes."""
    packer = zlib.compressobj(wbits=GZIP_WINDOW)
    return packer.compress(data) + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The record of a page; a revisit, with the headers of the response but no payload, if it refers to another."""
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload)
    block = http + END_OF_HEADERS + (payload if refers_to is None else b"")
    headers = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": name(page_id), "WARC-Date": DATE}
    if url is not None:
        # Control characters and spaces would end the header or the URI.
        headers["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if refers_to is not None:
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": name(refers_to)}
    headers |= {"Content-Type": HTTP, "WARC-Payload-Digest": f"sha1:{sha1(payload)}"}
    headers |= {"WARC-Block-Digest": f"sha1:{sha1(block)}", "Content-Length": str(len(block))}
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers.items()).encode()
    return VERSION + lines + b"\r\n" + block + END_OF_RECORD


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes ``pages(page_id, url, html)`` as WARC archives, gzip members in files, into a new ``folder``.

    Pages whose payloads have at least ``least_bytes`` bytes and are equal to that of a page with a smaller id become
    revisits of it.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    size = F.octet_length("payload")
    average = max(1, int(rows.agg(F.avg(size)).first()[0] or 0))
    keys = rows.where(size >= least_bytes).groupBy("key").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    with Generations(pages.sparkSession) as state:
        # Written, so that the join is planned by the size of the table and may split a group that is large.
        copies = state.keep(keys.where("n > 1").select("key", "first"))
        other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
        marked = rows.join(copies, "key", "left").select("page_id", "url", "payload", F.when(other, F.col("first")).alias("refers_to"))
        members = marked.mapInArrow(_members, "member binary")
        writer = members.select(F.col("member").cast("string")).write.option("maxRecordsPerFile", max(1, archive_bytes // average))
        # One character is one byte of what separates lines; the members are written as they are.
        writer.option("encoding", "ISO-8859-1").option("lineSep", member(b"").decode("latin-1")).text(folder)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            rows = batch.slice(start, ROWS_AT_ONCE).to_pylist()
            members = [member(page_record(r["page_id"], r["url"], r["payload"], r["refers_to"])) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """``READ`` rows of all records in the archives of a folder (or a file or glob), and of the gaps between them.

    ``start`` and ``length`` are bytes of the archive: of the record, of the gzip member that holds it, or of a gap.
    Gaps have a ``problem`` and nothing else; ``select`` by it for the log. ``payload_bytes`` and ``payload_digest`` of a
    revisit are those of the payload that it refers to. Without ``payloads`` that column is NULL.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    schema = pa.schema([(name, _TYPES[kind]) for name, kind in (field.split() for field in READ.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                archive = batch.column("path")[i].as_py()
                for found in salvage(batch.column("content")[i].as_py()):
                    rows.append({"archive": archive} | _row(found, payloads))
                    held += 256 + len(rows[-1].get("payload") or b"")
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(read, READ)


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _row(found: Found, payloads: bool) -> dict:
    row = {"start": found.start, "length": found.end - found.start, "problem": found.problem}
    if found.problem is not None:
        return row
    headers, (http, payload) = found.headers, _payload(found.headers, found.block)
    row |= {"record_type": headers.get("warc-type"), "record_id": headers.get("warc-record-id")}
    row |= {"refers_to": headers.get("warc-refers-to"), "target": headers.get("warc-target-uri")}
    if headers.get("warc-type") == "revisit":
        size = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        return row | {"payload_bytes": int(size[1]) if size else None, "payload_digest": digest}
    row |= {"payload_bytes": len(payload), "payload_digest": sha1(payload)}
    return row | {"payload": payload} if payloads else row


def _payload(headers: dict[str, str], block: bytes) -> tuple[bytes, bytes]:
    """The HTTP headers of a block and what follows them; other blocks are all payload."""
    if not headers.get("content-type", "").startswith("application/http"):
        return b"", block
    http, end, payload = block.partition(END_OF_HEADERS)
    return (http, payload) if end else (b"", block)


def salvage(data: bytes, members: bool = True) -> Iterator[Found]:
    """The sound records of an archive in their order, and the gaps between them; together they cover all its bytes
    but empty members and line ends between records."""
    at, bad, problem, search = 0, None, "", _Search(data, members)
    while at < len(data):
        if bad is None and data[at] in END_OF_RECORD:
            at += 1
            continue
        try:
            end, found = _member(data, at) if members and data.startswith(MEMBER, at) else _record(data, at)
        except Damaged as error:
            if bad is None:
                bad, problem = at, str(error)
            at = search.after(at)
            continue
        if bad is not None:
            yield Found(bad, at, problem)
            bad = None
        yield from found
        at = end
    if bad is not None:
        yield Found(bad, len(data), problem)


class _Search:
    """The next place that looks like a member or like a version line; every byte is looked at once per kind."""

    def __init__(self, data: bytes, members: bool):
        self.data, self.next = data, {b"WARC/1.": -1} | ({MEMBER: -1} if members else {})

    def after(self, at: int) -> int:
        for sign, place in self.next.items():
            if place <= at:
                place = self.data.find(sign, at + 1)
                self.next[sign] = place if place >= 0 else len(self.data)
        return min(self.next.values())


def _member(data: bytes, at: int) -> tuple[int, list[Found]]:
    """The end of a gzip member and its records; gaps inside have the place of the member."""
    unpacker, view, parts, read, step = zlib.decompressobj(GZIP_WINDOW), memoryview(data), [], at, FIRST_READ
    try:
        while not unpacker.eof and read < len(data):
            parts.append(unpacker.decompress(view[read : read + step]))
            read, step = min(read + step, len(data)), step * 2
    except zlib.error as error:
        raise Damaged(f"gzip member: {error}") from None
    if not unpacker.eof:
        raise Damaged("gzip member: it is cut off")
    end, content = read - len(unpacker.unused_data), b"".join(parts)
    found = list(salvage(content, members=False))
    if len(found) == 1 and found[0].problem:
        raise Damaged(found[0].problem)
    where = lambda gap: f"{gap.problem}, bytes {gap.start} to {gap.end} of the member"
    return end, [f._replace(start=at, end=end, problem=where(f) if f.problem else None) for f in found]


def _record(data: bytes, at: int) -> tuple[int, list[Found]]:
    """The end of a plain record, and the record."""
    version = VERSION_LINE.match(data, at)
    if not version:
        raise Damaged("no gzip member and no version line")
    begin = data.find(END_OF_HEADERS, at, at + HEADER_BYTES) + len(END_OF_HEADERS)
    if begin < len(END_OF_HEADERS):
        raise Damaged("the headers do not end")
    headers, last = {}, None
    for line in data[version.end() : begin - len(END_OF_HEADERS)].decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            headers[last] += " " + line.strip()
            continue
        last, colon, value = line.partition(":")
        last = last.strip().lower()
        if not colon:
            raise Damaged("a line of the headers has no name")
        headers[last] = value.strip()
    length = headers.get("content-length", "")
    if not re.fullmatch(r"\d{1,18}", length, re.ASCII):
        raise Damaged("there is no length")
    end = begin + int(length)
    if data[end : end + len(END_OF_RECORD)] != END_OF_RECORD:
        raise Damaged("the record does not end where its length says")
    block = data[begin:end]
    _check(headers.get("warc-block-digest"), block, "block")
    if headers.get("warc-type") != "revisit":
        _check(headers.get("warc-payload-digest"), _payload(headers, block)[1], "payload")
    end += len(END_OF_RECORD)
    return end, [Found(at, end, None, headers, block)]


def _check(digest: str | None, data: bytes, what: str) -> None:
    if digest and digest.startswith("sha1:") and digest != f"sha1:{sha1(data)}":
        raise Damaged(f"the digest of the {what} is wrong")


def page_of(record_id: str | Column) -> Column:
    """The page id in the id of a record."""
    found = F.regexp_extract(record_id, PAGE.pattern, 1)
    return F.when(found != "", found.try_cast("long"))


def round_trip(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every page, as read back from archives.

    The archives lie in the shared folder and are deleted once they are read. A gap in them fails.
    """
    with shared_folder(pages.sparkSession) as folder:
        write_archives(pages, folder, least_bytes, archive_bytes)
        read = read_archives(pages.sparkSession, folder, payloads=False)
        sound = F.when(F.col("problem").isNull(), F.col("record_type"))
        sound = sound.otherwise(F.raise_error(F.concat("archive", F.lit(": "), "problem")))
        return checkpoint(
            read.select(
                page_of("record_id").alias("page_id"),
                "payload_bytes",
                "payload_digest",
                sound.alias("record_type"),
                page_of("refers_to").alias("refers_to"),
            )
        )
