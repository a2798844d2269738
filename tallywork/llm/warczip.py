"""WARC records inside ZIP archives, read by ranges.

An archive holds a stored (not compressed) WARC member and an index member with the place of
each record. The reader takes the end of the file for the central directory, ZIP64 where
its fields say so, finds the members, and reads records by offset; nothing is extracted.

Archives are written by Spark's own text writer to any folder it can reach: the line end it adds
is the archive's one-byte comment.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm.graph import few
from tallywork.session import checkpoint_dir, staged

ARCHIVE_BYTES = 16 << 20
RANGE_BYTES = 2 << 20
RECORDS, INDEX = "records.warc", "records.idx"

RECORD = "record_id string, record_type string, uri string, payload binary, payload_bytes long, payload_digest string, refers_to string"


class Broken(ValueError):
    """The bytes are no archive of the kind read here."""


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value: control characters and white space percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(record_id: str, uri: str, payload: bytes, refers_to: str | None) -> bytes:
    """A response record, or a revisit of another that keeps only what identifies the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{_line(record_id)}>",
        f"WARC-Target-URI: {_line(uri)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_digest(payload)}",
    ]
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{_line(refers_to)}>")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(members: list[tuple[str, bytes]]) -> bytes:
    """A ZIP archive of stored members, up to the comment of one byte that a line end will be."""
    out, directory = bytearray(), bytearray()
    for name, data in members:
        raw, crc, at = name.encode(), zlib.crc32(data), len(out)
        out += struct.pack("<4s5H3L2H", b"PK\x03\x04", 20, 0x800, 0, 0, 33, crc, len(data), len(data), len(raw), 0) + raw + data
        directory += struct.pack(
            "<4s6H3L5H2L", b"PK\x01\x02", 20, 20, 0x800, 0, 0, 33, crc, len(data), len(data), len(raw), 0, 0, 0, 0, 0, at
        ) + raw
    end = struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, len(members), len(members), len(directory), len(out), 1)
    return bytes(out + directory + end)


class Ranges:
    """Byte ranges of a file: of one that a file system opens, or of bytes that Spark has read."""

    def __init__(self, path: str, content: bytes | None = None):
        self.content = content
        if content is None:
            system, name = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
            self.file = system.open_input_file(name)
            self.size = self.file.size()
        else:
            self.size = len(content)

    def read(self, at: int, length: int) -> bytes:
        if at < 0 or length < 0 or at + length > self.size:
            raise Broken(f"range {at}+{length} is outside the file of {self.size} bytes")
        return self.content[at : at + length] if self.content is not None else self.file.read_at(length, at)


def directory(ranges: Ranges) -> dict[str, tuple[int, int]]:
    """``name -> (place of the data, length)`` of the stored members, from the central directory."""
    tail_at = max(0, ranges.size - 65557)
    tail = ranges.read(tail_at, ranges.size - tail_at)
    found = len(tail)
    while True:
        found = tail.rfind(b"PK\x05\x06", 0, found)
        if found < 0:
            raise Broken("no end of central directory")
        if found + 22 <= len(tail) and found + 22 + struct.unpack_from("<H", tail, found + 20)[0] == len(tail):
            break
    count, size, at = struct.unpack_from("<H2L", tail, found + 10)
    if count == 0xFFFF or size == 0xFFFFFFFF or at == 0xFFFFFFFF:
        locator = tail_at + found - 20
        mark, _, where, _ = struct.unpack("<4sLQL", ranges.read(locator, 20))
        if mark != b"PK\x06\x07":
            raise Broken("no ZIP64 locator")
        mark, *_, count, size, at = struct.unpack("<4sQ2H2L4Q", ranges.read(where, 56))
        if mark != b"PK\x06\x06":
            raise Broken("no ZIP64 end of central directory")
    central, place = ranges.read(at, size), 0
    members = {}
    for _ in range(count):
        if central[place : place + 4] != b"PK\x01\x02":
            raise Broken("no central directory entry")
        method, = struct.unpack_from("<H", central, place + 10)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<2L3H", central, place + 20)
        local, = struct.unpack_from("<L", central, place + 42)
        name = central[place + 46 : place + 46 + n_name].decode("utf-8", "replace")
        extra = central[place + 46 + n_name : place + 46 + n_name + n_extra]
        place += 46 + n_name + n_extra + n_note
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<2H", extra)
            if kind == 1:
                # Only the fields that overflow are there, in this order.
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            extra = extra[4 + length :]
        if method == 0:
            mark, n_name, n_extra = struct.unpack("<4s22x2H", ranges.read(local, 30))
            if mark != b"PK\x03\x04":
                raise Broken("no local header")
            members[name] = (local + 30 + n_name + n_extra, plain)
    return members


def places(ranges: Ranges, members: dict[str, tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """``(place, length)`` of the records, from the index; without one, by the records' own headers."""
    if RECORDS not in members:
        return
    at, size = members[RECORDS]
    if INDEX in members:
        for line in ranges.read(*members[INDEX]).split(b"\n"):
            if line:
                offset, length = map(int, line.split())
                yield at + offset, length
        return
    offset = 0
    while offset < size:
        ahead = 4096
        while True:
            head = ranges.read(at + offset, min(ahead, size - offset))
            stop = head.find(b"\r\n\r\n")
            if stop >= 0:
                break
            if ahead >= size - offset:
                raise Broken("a record without the end of its headers")
            ahead *= 2
        length = re.search(rb"\r\nContent-Length: *(\d+)", head[: stop + 2], re.I)
        whole = stop + 4 + (int(length[1]) if length else 0) + 4
        yield at + offset, whole
        offset += whole


def parse(raw: bytes) -> dict:
    """A record's fields; the digest and length of a revisit are those its headers state."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    stated = re.search(rb"\r\nContent-Length: *(\d+)", http, re.I)
    name = lambda key: fields[key][len("<urn:page:") : -1] if key in fields else None
    return {
        "record_id": name("warc-record-id"),
        "record_type": fields["warc-type"],
        "uri": fields.get("warc-target-uri"),
        "payload": None if revisit else payload,
        "payload_bytes": int(stated[1]) if revisit and stated else len(payload),
        "payload_digest": fields["warc-payload-digest"].partition(":")[2] if revisit else base32_digest(payload),
        "refers_to": name("warc-refers-to"),
    }


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives of about ARCHIVE_BYTES; a larger record has one of its own."""
    body, index = bytearray(), []

    def finish() -> pa.RecordBatch:
        data = archive([(RECORDS, bytes(body)), (INDEX, "".join(index).encode())])
        body.clear()
        index.clear()
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["archive"])

    for batch in batches:
        for row in batch.to_pylist():
            raw = record(str(row["record_id"]), row["uri"] or "", (row["payload"] or "").encode(), row["refers_to"])
            if body and len(body) + len(raw) > ARCHIVE_BYTES:
                yield finish()
            index.append(f"{len(body)} {len(raw)}\n")
            body += raw
    if body:
        yield finish()


def write(pages: DataFrame, folder: str) -> None:
    """Write a record for each row ``record_id, uri, payload, refers_to`` to archives in ``folder``."""
    rows = pages.select("record_id", "uri", "payload", "refers_to").mapInArrow(_write, "archive binary")
    # The writer passes the bytes on as they are, and one row makes one file.
    rows.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1).text(folder)


def reachable(folder: str) -> bool:
    """Whether a file system of pyarrow opens the folder; else Spark reads whole archives."""
    try:
        pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder if ":" in folder else f"file://{folder}"))
        return True
    except (pa.ArrowException, OSError, ValueError):
        return False


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of neighbouring records, of about RANGE_BYTES each."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            ranges = Ranges(path)
            first = lengths = None
            out = []
            for at, length in places(ranges, directory(ranges)):
                if lengths and (sum(lengths) + length > RANGE_BYTES or at != first + sum(lengths)):
                    out.append((path, first, lengths))
                    lengths = None
                if not lengths:
                    first, lengths = at, []
                lengths.append(length)
            if lengths:
                out.append((path, first, lengths))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in out], pa.string()),
                    pa.array([r[1] for r in out], pa.int64()),
                    pa.array([r[2] for r in out], pa.list_(pa.int64())),
                ],
                ["path", "first", "lengths"],
            )


def _table(rows: list[dict], with_payload: bool) -> pa.RecordBatch:
    kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}
    names = [c for c in ("record_id", "record_type", "uri", "payload", "payload_bytes", "payload_digest", "refers_to")]
    if not with_payload:
        for row in rows:
            row["payload"] = None
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names)


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives in ``folder``: record_id, record_type, uri, payload, payload_bytes, payload_digest, refers_to.

    Directories are read first, a task each archive; then ranges of records are dealt out, so a
    large archive is read by many tasks. An empty folder of archives gives no rows. Where only Spark
    reaches the folder, each archive comes as one value and is sliced in place.
    """
    files = spark.read.format("binaryFile").load(folder).where("length > 0")
    if reachable(folder):
        ranges = files.select("path").repartition(_tasks(spark)).mapInArrow(
            _locate, "path string, first long, lengths array<long>"
        )

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    raw = Ranges(row["path"]).read(row["first"], sum(row["lengths"]))
                    got, at = [], 0
                    for length in row["lengths"]:
                        got.append(parse(raw[at : at + length]))
                        at += length
                    yield _table(got, with_payload)

        return ranges.repartition(_tasks(spark)).mapInArrow(fetch, RECORD)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                ranges = Ranges("", content)
                yield _table([parse(ranges.read(*p)) for p in places(ranges, directory(ranges))], with_payload)

    return files.select("content").mapInArrow(slices, RECORD)


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def archive_pages(pages: DataFrame, folder: str | None = None, least: int = 0) -> str:
    """Write pages as WARC records in archives, equal payloads once, and return the folder.

    Of records with equal payloads of at least ``least`` bytes that with the largest page_id is a
    response, and all others revisit it; smaller ones are responses. A null html is empty; rows with a
    null page_id are responses; rows that repeat the largest page_id are responses too.
    """
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("digest", F.sha1("html"))
    groups = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(
        F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("size")
    )
    # Only payloads that repeat are joined with the pages.
    groups = few(staged(groups.where("size > 1").select(F.col("digest").alias("same"), "largest")))
    joined = rows.join(groups, F.col("digest") == F.col("same"), "left")
    other = F.col("page_id").isNotNull() & (F.col("page_id") != F.col("largest"))
    write(
        joined.select(
            F.col("page_id").cast("string").alias("record_id"),
            F.col("url").alias("uri"),
            F.col("html").alias("payload"),
            F.when(other, F.col("largest").cast("string")).alias("refers_to"),
        ),
        folder,
    )
    return folder
