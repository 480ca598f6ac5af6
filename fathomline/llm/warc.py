"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that are compressed on their own; a bundle is its frames, then a
seek table in a skippable frame, with the footer that the seekable format names. Any Zstandard
tool can unpack a bundle; with the table, one record is read by unpacking one frame. An index maps
record ids to (bundle, frame, offset in the frame, length).

Payloads that repeat are written once: of equal payloads of ``least`` bytes or more, the record
with the smallest id holds the payload, and the others are revisits that name it.

Bundles are rows (name, data) of a table in the shared folder, so any store that Spark can write
to will do, and a task that is lost is written again whole; ``export`` puts them out as files.

Defined cases: a null payload is empty; a record with a null id is always a response and is never
referred to; rows that share the smallest id and the payload are all responses; payloads under
``least`` bytes are all responses; an empty table gives no bundles and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import materialize

# Fixed values of the seekable format: a skippable frame, its end mark, entries of two numbers.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Bytes of records in a frame and in a bundle before compression; a longer record has a frame of its own.
FRAME, BUNDLE = 1 << 18, 1 << 24
_NAMES = uuid.UUID("6f5b1a52-5d3c-5c4e-9f8e-7d2a9c1b0e44")


def record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{digest}')}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record, response or (with ``refers_to``) revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.insert(4, f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    def __init__(self, level: int = 3):
        self.level = level
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[bytes, int]] = []
        self.index: list[dict] = []
        self.held: list[bytes] = []
        self.size = self.total = 0

    def add(self, name: str, data: bytes) -> None:
        if self.held and self.size + len(data) > FRAME:
            self._end_frame()
        self.index.append({"record_id": name, "frame": len(self.frames), "offset": self.size, "length": len(data)})
        self.held.append(data)
        self.size += len(data)
        self.total += len(data)

    def _end_frame(self) -> None:
        if self.held:
            self.frames.append((self.packer.compress(b"".join(self.held)), self.size))
            self.held, self.size = [], 0

    def finish(self) -> bytes:
        self._end_frame()
        entries = b"".join(struct.pack("<II", len(c), n) for c, n in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        table = struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer
        return b"".join(c for c, _ in self.frames) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start in the bundle, compressed size, size) of each frame, from the footer alone."""
    count, descriptor, mark = struct.unpack("<IBI", bundle[-9:])
    if mark != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if descriptor & 0x80 else 8
    at = len(bundle) - 9 - count * width
    out, start = [], 0
    for i in range(count):
        packed, size = struct.unpack_from("<II", bundle, at + i * width)
        out.append((start, packed, size))
        start += packed
    return out


def read_frame(bundle: bytes, frame: int) -> bytes:
    start, packed, size = seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=size)


def read_record(bundle: bytes, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; only its frame is unpacked."""
    return next(parse(read_frame(bundle, frame)[offset : offset + length]))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        n = int(head["Content-Length"])
        yield head, data[start : start + n]
        at = start + n + 4


BUNDLES = "name string, data binary, index array<struct<record_id:string,frame:int,offset:long,length:long>>"


def _write(date: str, level: int):
    def done(writer: BundleWriter) -> pa.RecordBatch:
        data = writer.finish()
        kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
        # named by content: a task that runs again writes the same bundles
        return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(data).hexdigest()[:32] + ".warc.zst"]), pa.array([data], pa.binary()), pa.array([writer.index], kind)], ["name", "data", "index"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(level)
        for batch in batches:
            ids, urls, refers = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for i in range(batch.num_rows):
                payload = (batch.column(2)[i].as_py() or "").encode()
                digest = base32_sha1(payload)
                writer.add(record_id(ids[i], digest), record(ids[i], urls[i], payload, digest, refers[i], date))
                if writer.total >= BUNDLE:
                    yield done(writer)
                    writer = BundleWriter(level)
        if writer.index:
            yield done(writer)

    return run


def bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """The archives of ``pages`` as rows (name, data, index), not yet written."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("d"))
    # only payloads that repeat take part in the join
    again = rows.where(F.octet_length("html") >= least).groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null").select("d", "first")
    again = materialize(again, "warc-repeats")  # a join of two exchanges splits a payload that many rows share
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    return rows.join(again, "d", "left").select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(_write(date, level), BUNDLES)


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def indexed_records(bundle: bytes, names: list[str], frames: list[int], offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(frame, headers, block) of each record that the index maps to a place; each frame is unpacked once.

    A place that holds another record, and records that the index leaves out, are errors.
    """
    table = seek_table(bundle)
    unpack = zstandard.ZstdDecompressor()
    at, data = -1, b""
    for name, frame, offset, length in zip(names, frames, offsets, lengths, strict=True):
        if frame != at:
            start, packed, size = table[frame]
            at, data = frame, unpack.decompress(bundle[start : start + packed], max_output_size=size)
        head, block = next(parse(data[offset : offset + length]), ({}, b""))
        if head.get("WARC-Record-ID") != name:
            raise ValueError(f"{name} is not at its place in the bundle")
        yield frame, head, block
    if sum(lengths) != sum(size for _, _, size in table):
        raise ValueError("the bundle holds records that its index lacks")


def read_back(archives: DataFrame) -> DataFrame:
    """The records of bundles (name, data, index), each by its place in the index; a response's digest is taken from its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def made(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                index = batch.column(1)[i].values
                places = [index.field(k).to_pylist() for k in ("record_id", "frame", "offset", "length")]
                out: list[list] = [[] for _ in names]
                last = 0
                for frame, head, block in indexed_records(batch.column(0)[i].as_py(), *places):
                    if frame != last:
                        yield made(out)
                        out, last = [[] for _ in names], frame
                    number = lambda key: int(head[key]) if key in head else None  # noqa: B023, E731
                    kind = head["WARC-Type"]
                    digest, length = head["WARC-Payload-Digest"].removeprefix("sha1:"), number("X-Payload-Length")
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if base32_sha1(payload) != digest:
                            raise ValueError(f"{head['WARC-Record-ID']}: the payload is not what was written")
                        length = len(payload)
                    for column, value in zip(out, (number("X-Page-Id"), head.get("WARC-Target-URI"), length, digest, kind, number("X-Refers-To-Page-Id")), strict=True):
                        column.append(value)
                yield made(out)

    return archives.select("data", "index").mapInArrow(run, RECORDS)


def archive(pages: DataFrame, **options) -> DataFrame:
    """Writes the bundles of ``pages`` into the shared folder; returns the table (name, data, index)."""
    return materialize(bundles(pages, **options), "warc")


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Puts bundles out as files of a folder that all executors mount; returns (name, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, os.path.join(folder, name))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)], pa.int64())], ["name", "bytes"])

    return archives.select("name", "data").mapInArrow(run, "name string, bytes long")
